"""URL filters: rules on hosts and paths, carried over redirect and canonical-link equivalence.

Pages whose addresses are the same but for scheme, port 80 or 443, fragment and the case of the host are
one node. Redirects (``<meta http-equiv=refresh>`` and the ``redirects`` table) and canonical links join
nodes; connected components of this graph are aliases of one resource. A page under a rule of its own
keeps that verdict. Any other page is blocked if an alias is blocked by a rule and no alias is explicitly
allowed; the rest is allowed.

Links are resolved against the page's address: character references of links are decoded, relative paths,
dot segments and mere queries follow the usual rules for references; links of other schemes and mere fragments
join nothing. Of rules of one length that fit, allow goes before block.

Null or malformed urls have an empty host and path, fall under no rule and are allowed. Repeated rows are
each judged. Further columns of ``pages`` are left alone; one called like an output is kept under its name and
``_input``. An absent ``html`` column means no links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convarchive.llm.common import ascii_lower, let, put_back, require, set_aside, table
from convarchive.llm.components import connected_components

OUTPUTS = ("host", "path", "rule", "verdict", "verdict_by")
#: Rules of the registered query: (action, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def url_host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def resource(url: Column) -> Column:
    """What names the same resource: host without a default port, path and query; null if malformed."""
    host = F.regexp_replace(url_host(url), r":(80|443)$", "")
    rest = F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^#]*)", 1)
    return F.when(host != "", F.concat(host, F.when(F.substring(rest, 1, 1) == "/", rest).otherwise(F.concat(F.lit("/"), rest))))


def _without_dots(path: Column) -> Column:
    """A path that begins with a slash, without its dot segments."""
    parts = F.split(path, "/", -1)

    def step(a: Column, x: Column) -> Column:
        return F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))).when(x == ".", a).otherwise(F.concat(a, F.array(x)))

    kept = F.aggregate(F.slice(parts, 2, 1 << 30), F.array(F.lit("")), step)
    ends = F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise("")
    return F.when(F.contains(path, F.lit("/.")), F.concat(F.array_join(kept, "/"), ends)).otherwise(path)


def _decoded(link: Column) -> Column:
    """Without the character references that links have: those of ``& \" ' < >`` and ``/``."""
    plain = link
    for said, char in (("quot|#34|#x22", '"'), ("apos|#39|#x27", "'"), ("lt|#60|#x3c", "<"), ("gt|#62|#x3e", ">"), ("sol|#47|#x2f", "/"), ("amp|#38|#x26", "&")):
        plain = F.regexp_replace(plain, f"(?i)&(?:{said});", char)
    return F.when(F.contains(link, F.lit("&")), plain).otherwise(link)


def _absolute(link: Column, url: Column) -> Column:
    """The address a link on a page leads to; null for other schemes and mere fragments."""
    scheme = F.regexp_extract(url, r"^((?s:.*?)):\/\/", 1)
    origin = F.regexp_extract(url, r"^((?s:.*?)://[^/?#]*)", 1)
    base = url_path(url)
    folder = F.regexp_extract(base, r"^(?s:(.*/))", 1)
    folder = F.when(F.startswith(folder, F.lit("/")), folder).otherwise("/")
    path, rest = F.regexp_extract(link, r"^([^?#]*)", 1), F.regexp_extract(link, r"^[^?#]*((?s:.*))$", 1)
    straight = lambda p: let(p, _without_dots)
    return (
        F.when(F.startswith(link, F.lit("#")), F.lit(None))
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link))
        .when(F.startswith(link, F.lit("?")), F.concat(origin, base, link))
        .when(F.startswith(link, F.lit("/")), F.concat(origin, straight(path), rest))
        .otherwise(F.concat(origin, straight(F.concat(folder, path)), rest))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """``(a, b)``: resources that a page's canonical link or refresh redirect makes one."""
    html = F.coalesce(F.col("html"), F.lit("")) if "html" in pages.columns else F.lit("")
    tags = F.regexp_extract_all(html, F.lit(r"(?i)(<(?:link|meta)\b[^>]*>)"), 1)
    canonical = F.transform(
        F.filter(tags, lambda t: t.rlike(r"""(?i)\brel\s*=\s*["']?canonical\b""")),
        lambda t: F.regexp_extract(t, r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""", 1),
    )
    refresh = F.transform(
        F.filter(tags, lambda t: t.rlike(r"""(?i)\bhttp-equiv\s*=\s*["']?refresh\b""")),
        lambda t: F.regexp_extract(t, r"""(?i)\burl\s*=\s*["']?([^"'\s>;]+)""", 1),
    )
    # what is used more than once is computed inside the array or by ``let``, else the plan spells it out each time
    found = F.filter(F.concat(canonical, refresh), lambda x: x != "")
    links = pages.select("url", F.explode(F.transform(found, _decoded)).alias("link"))
    target = let(_absolute(F.col("link"), F.col("url")), resource)
    return links.select(resource(F.col("url")).alias("a"), target.alias("b")).where("a <> b")


def rule_frame(spark: SparkSession, rules) -> DataFrame:
    return spark.createDataFrame(list(rules), "action string, rule_host string, rule_path string")


def apply_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``action`` to distinct ``url`` rows: the longest rule that fits, allow on a tie."""
    urls = urls.withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))})
    labels = F.split(F.col("host"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = (
        urls.select("url", "path", F.explode(F.array_distinct(suffixes)).alias("rule_host"))
        .join(rules, "rule_host")
        .where(F.startswith("path", "rule_path"))
        .select("url", "action", F.concat("rule_host", "rule_path").alias("rule"))
    )
    first = F.struct(F.length("rule").alias("n"), (F.col("action") == "allow").alias("allow"), F.col("rule"), F.col("action"))
    best = fits.groupBy("url").agg(F.max(first).alias("best")).select("url", "best.rule", "best.action")
    return urls.join(best, "url", "left")


def filter_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """``pages`` rows with ``host``, ``path``, ``rule``, ``verdict`` and ``verdict_by`` (rule, alias or default).

    ``redirects`` may give further ``(from_url, to_url)`` pairs. Every page is judged; none is dropped.
    """
    given, pages = pages, set_aside(require(pages, "url"), *OUTPUTS, "node")
    judged = apply_rules(pages.select("url").where("url is not null").distinct(), rules).withColumn("node", resource(F.col("url")))
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(resource(F.col("from_url")).alias("a"), resource(F.col("to_url")).alias("b")))
    groups = connected_components(edges)
    judged = judged.join(groups, "node", "left").withColumn("group", F.coalesce("component", "node"))
    carried = judged.where("action is not null").groupBy("group").agg(F.min("action").alias("carried"))
    judged = judged.join(carried, "group", "left").select(
        "url",
        "rule",
        F.coalesce("action", "carried", F.lit("allow")).alias("verdict"),
        F.when(F.col("action").isNotNull(), "rule").when(F.col("carried").isNotNull(), "alias").otherwise("default").alias("verdict_by"),
    )
    out = pages.join(judged, "url", "left")
    out = out.withColumns(
        {
            "host": url_host(F.col("url")),
            "path": url_path(F.col("url")),
            "verdict": F.coalesce("verdict", F.lit("allow")),
            "verdict_by": F.coalesce("verdict_by", F.lit("default")),
        }
    )
    return put_back(out, given, (*OUTPUTS, "node"), ("node",))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filter_urls(table(spark, sf_dir, "pages"), rule_frame(spark, RULES))
    return out.select("page_id", "host", "path", "rule", "verdict")


#: Redirect and canonical edges are extracted and closed by recursion, as the operator does by components. Relative paths and
#: character references of links aren't in the SQL; tests hold them against brute force.
ORACLE = r"""
WITH RECURSIVE rules(action, rule_host, rule_path) AS (
  VALUES ('allow','org','/'), ('block','example.org','/es/'), ('block','example.org','/en/1'), ('allow','com','/fr/'), ('block','com','/de/')),
u AS (
  SELECT url, translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(url, '^(?s:.*?)://[^/?#]*([^#]*)', 1) AS rest
  FROM (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL)),
fit AS (
  SELECT url, rule_host || rule_path AS rule, action,
    row_number() OVER (PARTITION BY url ORDER BY length(rule_host || rule_path) DESC, action, rule_host || rule_path DESC) AS k
  FROM u JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
n AS (
  SELECT u.url, host, path, rule, action,
    CASE WHEN host <> '' THEN regexp_replace(host, ':(80|443)$', '') || CASE WHEN starts_with(rest, '/') THEN rest ELSE '/' || rest END END AS node
  FROM u LEFT JOIN fit ON u.url = fit.url AND k = 1),
tags AS (SELECT url, unnest(regexp_extract_all(html, '(?i)(<(?:link|meta)\b[^>]*>)', 1)) AS tag FROM pages),
links AS (
  SELECT url, CASE WHEN regexp_matches(tag, '(?i)\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
    WHEN regexp_matches(tag, '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?i)\burl\s*=\s*["'']?([^"''\s>;]+)', 1) ELSE '' END AS link
  FROM tags),
full_links AS (
  SELECT n.node AS a, CASE WHEN contains(link, '://') THEN link WHEN starts_with(link, '//') THEN 'http:' || link
    WHEN starts_with(link, '/') THEN regexp_extract(l.url, '^((?s:.*?)://[^/?#]*)', 1) || link END AS target
  FROM links l JOIN n ON n.url = l.url WHERE link <> ''),
edge AS (
  SELECT a, regexp_replace(lower(regexp_extract(target, '^(?s:.*?)://([^/?#]*)', 1)), ':(80|443)$', '') ||
    CASE WHEN starts_with(regexp_extract(target, '^(?s:.*?)://[^/?#]*([^#]*)', 1), '/') THEN '' ELSE '/' END ||
    regexp_extract(target, '^(?s:.*?)://[^/?#]*([^#]*)', 1) AS b
  FROM full_links WHERE target IS NOT NULL),
sym AS (SELECT a, b FROM edge WHERE a <> b UNION SELECT b, a FROM edge WHERE a <> b),
reach AS (SELECT DISTINCT a AS node, a AS other FROM sym UNION SELECT r.node, s.b FROM reach r JOIN sym s ON s.a = r.other),
alias AS (SELECT r.node, min(m.action) AS carried FROM reach r JOIN n m ON m.node = r.other WHERE m.action IS NOT NULL GROUP BY r.node),
same AS (SELECT node, min(action) AS carried FROM n WHERE action IS NOT NULL GROUP BY node)
SELECT p.page_id, coalesce(n.host, '') AS host, coalesce(n.path, '') AS path, n.rule,
  coalesce(n.action, alias.carried, same.carried, 'allow') AS verdict
FROM pages p LEFT JOIN n ON n.url = p.url LEFT JOIN alias ON alias.node = n.node LEFT JOIN same ON same.node = n.node
"""
