"""Cases in which a reviewer found results to differ, each on a small table of its own."""

import duckdb

import __spark_entry__ as entry
from tools.verify import shape


def same_as_sql(spark, folder, name, **tables):
    """The query gives the rows of its SQL over ``tables`` of ``(rows, schema)``."""
    db = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        db.sql(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    got, want = shape(entry.queries()[name](spark, str(folder)).toPandas()), shape(db.sql(entry.oracle_sql()[name]).df())
    assert got[0] == want[0] and got[3] == want[3]


#: Every url stands on two pages, of other states and events.
PAGES = ([(i, f"http://a.org/{i % 31}", "<p>") for i in range(60)], "page_id long, url string, html string")


def test_pending_of_pages_with_one_url_stays_apart(spark, tmp_path):
    same_as_sql(spark, tmp_path, "N2_merge_pending", pages=PAGES)


def test_triage_of_pages_with_one_url_stays_apart(spark, tmp_path):
    same_as_sql(spark, tmp_path, "N5_apply_triage", pages=PAGES)


def test_triage_of_pages_without_url_or_with_odd_ids(spark, tmp_path):
    same_as_sql(spark, tmp_path, "N5_apply_triage", pages=([(i, None if i % 4 else f"http://a.org/{i}", "<p>") for i in range(-20, 40)] + [(None, "http://b.org", None), (None, None, None)], PAGES[1]))


def test_repair_plan_of_notes_with_one_name_is_the_same_in_any_order(spark):
    from convarchive.operators import repair

    notes = [(i, "d", "b", "b", "text", i) for i in range(6)]
    for some in (notes, notes[::-1]):
        plan = repair.repair_plan(spark.createDataFrame(some, "path int, dir string, base string, name string, body string, mtime int").coalesce(1)).collect()
        assert {r.path: r.action for r in plan} == {0: "keep"} | dict.fromkeys(range(1, 6), "trash")


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars int"


def test_repair_plan_strips_what_its_sql_strips(spark, tmp_path):
    ends = ["", "\x0b", "\u2028", " \u2028", " ", "\n", "\x85", " \x85", "\r\n", "\f", "\x1c", "\u00a0", " \u2029", "\n "]
    texts = [*["abc" + x for x in ends], *[x + "abc" for x in ends], None, "", " \n", "\x0b", "a\nb", "a \n b"]
    same_as_sql(spark, tmp_path, "J3_repair_plan", documents=([(3 * i + 1, t, "en", "web", i % 7) for i, t in enumerate(texts)], DOCUMENTS))


def test_repair_plan_puts_notes_without_a_name_last(spark, tmp_path):
    rows = [(None, "abc", "en", "web", 10), (1, "abc", "en", "web", 10), (2, "b", "en", "web", None), (None, "c", "fr", "web", 7), (4, "d", "fr", "web", 7), (5, "d", None, None, 7)]
    same_as_sql(spark, tmp_path, "J3_repair_plan", documents=(rows, DOCUMENTS))


def test_few_phrases_take_one_pass_and_many_the_index(spark, monkeypatch):
    from convarchive.operators import topics

    texts = spark.createDataFrame([(1, "a red fox ran"), (2, "the redfox"), (2, "red fox"), (None, "fox"), (3, None), (4, "")], "id int, text string")
    phrases = spark.createDataFrame([("red fox",), ("fox",), ("dfo",), ("",), (None,), ("fox",), ("n",)], "phrase string")
    want = {(1, "red fox"), (1, "fox"), (1, "n"), (2, "red fox"), (2, "fox"), (2, "dfo"), (None, "fox")}
    direct = topics.holding(texts, phrases, "id")
    assert "Join" not in direct._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(topics, "DIRECT", 0)
    assert set(map(tuple, direct.collect())) == set(map(tuple, topics.holding(texts, phrases, "id").collect())) == want
    assert topics.holding(texts, phrases.where("false"), "id").count() == 0


def test_clip_ids_take_one_job_at_any_depth(spark):
    from convarchive.operators import lineage

    deep = '{"x": [' * 60 + '{"clip_id": "a"}' + "]}" * 60
    rows = spark.createDataFrame([(1, deep), (2, r'{"clip_id": "b\ud800", "n": 1e999}'), (3, '{"clip_id": "c", "x": {"y": 1, "y": 2}}'), (4, '{"clip_id": NaN}'), (5, ' {"clip_ids": ["d", "d", 1]} tail')], "k int, j string")
    found = lineage.clip_ids(rows, "j", "k")
    assert "LogicalRDD" not in found.where("k > 0")._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]  # nothing was written before
    assert {tuple(r) for r in found.collect()} == {(1, "a"), (2, "b?"), (5, "d")}


def test_a_base_of_many_versions_is_no_single_task(spark, tmp_path, monkeypatch):
    from convarchive.operators import merge
    from convarchive.streaming import streams

    new = spark.createDataFrame([(f"n{i}", "b", f"text {i}") for i in range(40)], "note_id string, base string, body string")
    named = merge.append_versions(new, new.where("false"))
    assert {r.note_id for r in named.where("version_name = base").collect()} == {"n0"}
    monkeypatch.setattr(streams, "FILE_ROWS", 5)
    for k in (0, 1):
        new.where(f"crc32(note_id) % 2 = {k}").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        streams.stream_exports(spark, f"{tmp_path}/in", "note_id string, base string, body string", f"{tmp_path}/store", f"{tmp_path}/check").awaitTermination()
    streams.compact_store(spark, f"{tmp_path}/store")
    assert len(list((tmp_path / "store/data").glob("at=compaction*/part=0/*.parquet"))) > 2
    assert streams.read_store(spark, f"{tmp_path}/store").count() == 40


def test_library_files_are_looked_for_once_a_note(spark):
    from convarchive.operators import repair

    bodies = ["", None, "imgimg12 x", "im\nimg1", "a.b*c", "a.bxc", r"q\E|z", "é😀😀b", "img", "aaab"]
    files = ["img1", "img12", "imgimg12", "a.b*c", r"q\E|z", r"\E", "😀😀b", "", None, "aab", "ab", "m\nimg"]
    notes = spark.createDataFrame([(i, f"c{k}", b) for k in range(2) for i, b in enumerate(bodies)] + [(99, None, "x")], "note_id int, conv_id string, body string")
    library = spark.createDataFrame([(f"c{i % 2}", f) for i, f in enumerate(files)] + [("c0", f) for f in files[1::4]] + [(None, "x")], "conv_id string, file string")
    out = repair.attach_library_to_notes(notes, library)
    want = [(n.note_id, x.file) for n in notes.collect() for x in library.collect() if n.conv_id and n.conv_id == x.conv_id and None not in (n.body, x.file) and x.file not in n.body]
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert "NOT Contains(" not in out._jdf.queryExecution().optimizedPlan().toString()  # no text is held against a file


def test_few_words_are_told_within_their_rows(spark, monkeypatch):
    from convarchive.operators import topics

    notes = spark.createDataFrame([(1, "Thing", "a thing, THÍNG 123"), (2, None, "things some-thing"), (3, "other", None), (None, "x", "thing"), (4, "", "123 ab")], "note_id int, title string, body string")
    words = spark.createDataFrame([("thing",), ("thing",), ("123",), ("ab",), (None,), ("",), ("other",)], "token string")
    want = {(1, "thing"), (3, "other"), (None, "thing")}
    direct = topics.naming(notes, words)
    assert "Join" not in direct._jdf.queryExecution().optimizedPlan().toString()
    got = [tuple(r) for r in direct.collect()]
    monkeypatch.setattr(topics, "DIRECT", 0)
    assert len(got) == 3 and set(got) == {tuple(r) for r in topics.naming(notes, words).collect()} == want
    assert topics.naming(notes, words.where("false")).count() == 0
