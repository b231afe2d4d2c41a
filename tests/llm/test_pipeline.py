import corpus_pipeline
import pyarrow as pa
import pytest
from convarchive.llm import line_dedup, packing, pii, toxicity

from tests.llm import test_decontamination, test_jaccard, test_line_dedup, test_packing


def test_every_stage_on_its_input(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "packing":
            assert docs.columns == columns
        seen[name] = (before.orderBy("doc_id").collect(), docs.collect())
    before, after = seen["toxicity"]
    scored = toxicity.score_toxicity(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert {r.doc_id for r in after} == {r.doc_id for r in scored.where("score < threshold").collect()} and len(after) > 0.7 * len(before)
    before, after = seen["line_dedup"]
    texts = test_line_dedup.slow([(r.doc_id, r.text) for r in before])
    want = {r.doc_id: t for r, t in zip(before, texts, strict=True) if t == r.text or t.split()}
    assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after)
    before, after = seen["near_dedup"]
    assert {r.doc_id for r in after} == test_jaccard.slow_stay([(r.doc_id, r.text) for r in before])[0]
    before, after = seen["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {r.doc_id for r in after} == {r.doc_id for r in before if not test_decontamination.slow(r.text, items)[1]}
    before, after = seen["packing"]
    ids, _ = packing.words_of(packing.tokenizer_path()).ids(pa.array([r.text for r in before]))
    assert sum(r.length for r in after) == len(ids) + len(before)
    assert test_packing.check_layout(after, 4096) <= 1.02 * sum(r.length for r in after) / 4096 + 1


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 20


def test_odd_rows_of_every_stage(spark, sf):
    """Null and empty texts, repeated rows and doc_ids, inner names as columns, and an empty table."""
    prose = " ".join(f"word{i} and" for i in range(60))
    rows = [(1, None), (2, ""), (2, ""), (3, prose), (3, prose), (None, prose), (3, "other " + prose[40:]), (None, None), (4, " \n ")]
    docs = spark.createDataFrame([(i, t, "x", k, "n") for k, (i, t) in enumerate(rows)], "doc_id long, text string, __row string, place int, n_dropped_lines string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        got = out.collect()
        assert out.columns == docs.columns and all((r["__row"], r.n_dropped_lines) == ("x", "n") for r in got), name
        assert stage(spark, docs.where("false"), sf).count() == 0
        if name in ("toxicity", "decontamination"):
            assert sorted(r.place for r in got) == list(range(len(rows))), name
        if name == "near_dedup":
            assert [r.doc_id for r in got if r.text and r.text.strip()] == [3] and len(got) == 2
    assert {r.length for r in corpus_pipeline.packing(spark, docs.where("place in (0, 1, 8)"), sf).collect()} == {1}
    assert corpus_pipeline.packing(spark, docs.where("false"), sf).count() == 0


@pytest.mark.parametrize("operator", ["lines", "pii", "near"])
def test_rows_keep_their_numbers_when_cores_change(spark, sf, tmp_path, operator):
    """Borders of file splits follow the cores there are; what an operator found must stay with its row."""
    from convarchive.llm.jaccard import drop_similar

    run = {"lines": line_dedup.dedup_lines, "pii": lambda d: pii.replace_pii(d, "k"), "near": drop_similar}[operator]
    spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").repartition(6, "doc_id").write.parquet(f"{tmp_path}/docs")
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.openCostInBytes", "spark.sql.leafNodeDefaultParallelism")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        docs = spark.read.parquet(f"{tmp_path}/docs")
        want = sorted(map(str, run(docs).collect()))
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "4")
        out = run(docs)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "2")
        got = sorted(map(str, out.collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    if operator == "lines":  # rows of one doc_id go by their order, doc_ids are distinct here
        assert got == want
    assert len(got) == len(want) and got == want
