"""Searches by key: ids in JSON, phrases in texts, files by prefix, regenerated notes, titles, statistics."""

import json
import random

from pyspark.sql import functions as F

from convarchive.operators import intake, lineage, posts, repair, topics


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def ids_of(value):
    if isinstance(value, dict):
        for k, v in value.items():
            if k == "clip_id" and isinstance(v, str):
                yield v
            elif k == "clip_ids" and isinstance(v, list):
                yield from (x for x in v if isinstance(x, str))
            else:
                yield from ids_of(v)
    elif isinstance(value, list):
        for v in value:
            yield from ids_of(v)


def test_ids_are_texts_at_any_depth(spark):
    rnd = random.Random(3)

    def value(depth):
        kind = rnd.randrange(5 if depth < 6 else 2)
        if kind == 0:
            return rnd.choice(["a", "]", 'q"', "é\n", "", "clip_id"])
        if kind == 1:
            return rnd.choice([1, 2.5, None, True])
        if kind == 2:
            return [value(depth + 1) for _ in range(rnd.randrange(4))]
        return {rnd.choice(["clip_id", "clip_ids", "x", "y", "z"]): value(depth + 1) for _ in range(rnd.randrange(4))}

    texts = [json.dumps([value(1) for _ in range(8)], ensure_ascii=rnd.random() < 0.5) for _ in range(150)]
    texts += ["", "not json", None, '{"clip_id": ', json.dumps({"clip_ids": [{"a": "b"}, "c"]}), r'{"clip_id": "A"}']
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, j string")
    want = set()
    for k, t in enumerate(texts):
        try:
            want |= {(k, x) for x in ids_of(json.loads(t))}
        except (TypeError, ValueError):
            continue
    got = [(r.k, r.clip_id) for r in lineage.clip_ids(rows, "j", "k").collect()]
    assert set(got) == want and len(got) == len(want) > 50
    assert lineage.clip_ids(rows.where("false"), "j", "k").count() == 0


def test_phrases_are_found_as_contains_finds_them(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randrange(4)))
    texts = [" ".join(word() for _ in range(rnd.randrange(12))) for _ in range(60)] + ["", None, "a\nb c"]
    phrases = list({" ".join(word() for _ in range(rnd.randrange(1, 4))) for _ in range(120)} | {"\n", "a\nb", "b c", " ", "  "})
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = topics.holding(rows, spark.createDataFrame([(p,) for p in [*phrases, None, ""]], "phrase string"), "k")
    want = {(k, p) for k, t in enumerate(texts) for p in phrases if p and t is not None and p in t}
    assert {(r.k, r.phrase) for r in got.collect()} == want and got.count() == len(want)


def test_any_number_of_phrases_and_no_nested_loop(spark):
    rows = spark.range(50).select(F.col("id").alias("k"), F.concat(F.lit("some text about topic n"), F.col("id").cast("string"), F.lit(" and more")).alias("text"))
    n = F.col("id").cast("string")
    phrases = spark.range(100_000).select(F.concat(F.lit("topic n"), n, F.lit(" and")).alias("phrase")).unionByName(spark.range(100_000).select(F.concat(F.lit("zz"), n).alias("phrase")))
    got = topics.holding(rows, phrases, "k")
    assert got.count() == 50
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)


def test_statistics_files_by_the_heads_of_their_names(spark):
    files = spark.createDataFrame([("a_1.csv", 1), ("a_b_2.csv", 3), ("a_b_1.csv", 3), ("ab.csv", 9), ("_x", 2), (None, 5)], "name string, mtime int")
    slugs = spark.createDataFrame([("a",), ("a_b",), ("b",), ("",)], "slug string")
    got = intake.pick_stats(files, slugs)
    assert {(r.slug, r.stats) for r in got.collect()} == {("a", "a_b_2.csv"), ("a_b", "a_b_2.csv"), ("b", None), ("", "_x")}
    own = plan(got)
    assert "startswith" not in own.lower()


def test_regenerated_notes(spark):
    note = "intro\n![](x.png)\nend"
    notes = [("n1", "c1", "T", "2024-01-02T10", note), ("n2", None, "T", "2024-01-02", note), ("n3", "", "Other", None, note), ("n4", "c1", "T", None, "else"), ("n5", "c2", "T", None, note)]
    made = [("a", "c1", "intro\n![](y.png)\nend"), ("b", "c1", "intro\n![](x.png)\nend"), ("c", "c2", "intro\n[missing image:p]\nend"), ("d", "c2", "intro\n![](z.png)\nend")]
    manifest = [("c1", "T", "2024-01-02"), ("c9", "T", "2024-01-02"), (None, "Other", None)]
    got = repair.match_regenerated(
        spark.createDataFrame(notes, "note_id string, conv_id string, title string, date string, body string"),
        spark.createDataFrame(made, "note_id string, conv_id string, body string"), spark.createDataFrame(manifest, "conv_id string, title string, date string"),
    )
    assert {tuple(r) for r in got.collect()} == {
        ("n1", "faithful", "b", 3), ("n2", "faithful", "b", 3), ("n3", "no export", None, None), ("n4", "no exact version", None, None), ("n5", "regenerated", "d", 2)
    }
    assert {tuple(r) for r in repair.regeneration_report(got).collect()} == {("faithful", 2), ("no export", 1), ("no exact version", 1), ("regenerated", 1)}


def test_titles_in_any_case_and_composition(spark):
    p = spark.createDataFrame([(1, "Café", "2024-01-01"), (2, "Cafe", "2024-01-01"), (3, None, "2024-01-01")], "id int, title string, post_date string")
    s = spark.createDataFrame([("CAFÉ", "2024-01-01T08", 1, 5), ("café", "2024-01-01", 2, 7)], "title string, post_date string, row_no int, views int")
    got = posts.join_stats(p, s)
    assert {(r.id, r.views) for r in got.collect()} == {(1, 7), (2, None), (3, None)}
    assert "Python" not in plan(got)


def test_music_statistics(spark):
    schema = "clip_id string, liked boolean, deleted boolean, op string, origins array<string>, lyrics string, conversation_title string, duration double, badges array<string>, project string"
    clips = [
        ("a", True, False, "audio__create_song", [], "la", "C", 3000.0, ["Full Song"], "p"), ("b", False, None, "audio__modify_song", ["a"], "", "C", None, ["Cover"], ""), ("c", True, True, "audio__create_song", None, "la", "D", 9.0, None, "q"),
        ("d", None, False, None, None, None, None, 700.0, ["Cover", "Full Song"], None),
    ]
    df = spark.createDataFrame(clips, schema)
    assert lineage.flow_stats(df).first().asDict() == {"total": 3, "liked": 1, "originals": 1, "with_lineage": 1, "with_lyrics": 1, "conversations": 1, "seconds": 3700, "readable": "1 h 1 min", "without_duration": 1}
    assert lineage.flow_stats(df.where("deleted")).count() == 0
    assert lineage.suno_stats(df).first().asDict() == {"total": 3, "liked": 1, "complete": 2, "projects": 1, "without_project": 2, "seconds": 3700, "readable": "1 h"}
