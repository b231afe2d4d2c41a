import random

from urllib.parse import urljoin

from convarchive.llm import url_filters as u
from convarchive.llm.components import connected_components

LINK = '<link href="{0}" rel="canonical">'
PAGES = [
    (1, "http://a.example.org/es/1", ""),
    (2, "https://b.net/x", LINK.format("http://a.example.org/es/1")),
    (3, "http://B.NET:80/x#frag", None),
    (4, "http://c.net/y", '<META HTTP-EQUIV="refresh" CONTENT="0; URL=https://b.net/x">'),
    (5, "http://d.net/z", LINK.format("/w")),
    (6, "http://d.net/w", LINK.format("//e.net/q")),
    (7, "http://e.net/q", ""),
    (8, "http://x.com/fr/1", LINK.format("http://a.example.org/es/1")),
    (9, None, "<p>"),
    (10, "no scheme", LINK.format("http://a.example.org/es/1")),
    (11, "http://example.org", ""),
    (12, "http://sub.example.org/en/123?x", ""),
    (12, "http://sub.example.org/en/123?x", ""),
    (13, "http://example.organic/en/1", ""),
]


def run(spark, pages, rules=u.RULES, redirects=None):
    df = spark.createDataFrame([(*p, "r", "a", "n") for p in pages], "page_id long, url string, html string, rule string, action string, node string")
    got = u.filter_urls(df, u.rule_frame(spark, rules), redirects).collect()
    assert all((r.rule_input, r.action, r.node) == ("r", "a", "n") for r in got)
    return {r.page_id: r for r in got}


def test_rules_and_aliases(spark):
    got = run(spark, PAGES)
    assert got[1].verdict == "block" and got[1].rule == "example.org/es/"
    assert [got[i].verdict for i in (2, 3, 4)] == ["allow"] * 3 and got[8].rule == "com/fr/"  # an allowed alias comes first
    without = run(spark, [p for p in PAGES if p[0] != 8])
    assert [without[i].verdict for i in (2, 3, 4)] == ["block"] * 3 and without[2].verdict_by == "alias" and without[2].rule is None
    assert [got[i].verdict_by for i in (5, 6, 7)] == ["default"] * 3
    assert (got[9].host, got[9].path, got[9].verdict) == (got[10].host, got[10].path, got[10].verdict) == ("", "", "allow")
    assert (got[11].path, got[11].rule) == ("", None) and got[12].rule == "example.org/en/1" and got[13].rule is None
    assert got[3].host == "b.net:80" and got[12].path == "/en/123"


def test_redirect_table_and_empty(spark):
    redirects = spark.createDataFrame([("http://d.net/w", "http://a.example.org/es/1"), (None, "http://e.net/q")], "from_url string, to_url string")
    got = run(spark, [p for p in PAGES if p[0] != 8], redirects=redirects)
    assert [got[i].verdict for i in (5, 6, 7)] == ["block"] * 3
    assert run(spark, []) == {}


def test_components_against_union_find(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1200)] + [(2000, i) for i in range(2001, 2300)] + [(5, 5), (None, 3)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root}


def test_components_of_many_edges(spark):
    n = 1_100_000
    edges = spark.range(n).selectExpr("id * 2 AS a", "id * 2 + 1 AS b").unionByName(spark.range(n).selectExpr("id * 2 + 1 AS a", "(id - id % 2) * 2 AS b"))
    got = connected_components(edges)
    assert got.count() == 2 * n and got.where("component <> node - node % 4").count() == 0


def test_links_are_resolved_as_urls(spark):
    bases = ["http://a.net/b/c/d", "http://a.net/b/", "http://a.net", "http://a.net/?q=1", "https://a.net/b/c?x=/y/#z", "http://a.net/b/c/"]
    links = ["q", "../q", "./q", "?x=1", "/r", "//e.net/f", "http://g.net/h?i", "../../../q", "q/./r/../s", "..", ".", "q?x=../y", "/a/../b", "q/.hidden/x..y"]
    df = spark.createDataFrame([(b, x) for b in bases for x in links], "url string, link string")
    for r in df.select("url", "link", u.resource(u._absolute(df.link, df.url)).alias("to"), u.resource(df.url).alias("own")).collect():
        want = urljoin(r.url, r.link).split("://", 1)[1]
        assert r.to == (want if "/" in want.split("?")[0] else want.replace("?", "/?") if "?" in want else want + "/"), (r.url, r.link)
    none = spark.createDataFrame([("http://a.net/b", x) for x in ("#f", "mailto:a@b.c", "javascript:void(0)")], "url string, link string")
    assert [r[0] for r in none.select(u._absolute(none.link, none.url)).collect()] == [None] * 3


def test_relative_and_escaped_links_carry_a_block(spark):
    pages = [
        (1, "http://a.example.org/es/1?a=1&b=2", ""),
        (2, "http://b.net/x/y", LINK.format("http://a.example.org/es/1?a=1&amp;b=2")),
        (3, "http://b.net/x/z", LINK.format("y")),
        (4, "http://b.net/q", '<meta http-equiv="refresh" content="0; url=x/z">'),
        (5, "http://b.net/x/y/z?k", LINK.format("../y#top")),
    ]
    assert {i: r.verdict for i, r in run(spark, pages).items()} == dict.fromkeys(range(1, 6), "block")


def test_ties_and_very_long_pages(spark):
    rules = [("block", "a.net", "/b"), ("allow", "a.net", "/b"), ("block", "net", "/")]
    pages = [(1, "http://a.net/b/" + "c" * 200_000, "<p>" * 300_000 + LINK.format("/d")), (2, "http://a.net/d", ""), (3, "http://x.net/", "")]
    got = run(spark, pages, rules)
    assert [got[i].verdict for i in (1, 2, 3)] == ["allow", "block", "block"] and got[1].rule == "a.net/b"


def test_plan_of_links_stays_small(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", "<link rel=canonical href='/y?a&amp;b'>")], "page_id int, url string, html string")
    plan = u.link_edges(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 40_000 and plan.count("regexp_replace") < 60
