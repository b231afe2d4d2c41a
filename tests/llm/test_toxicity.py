import random
import re
import zlib

import corpus_pipeline
from convarchive.llm import toxicity

CLEAN = "the sun rose over a quiet green valley while birds sang and rivers ran past old stone mills".split()


def corpus(spark, n=900, extra="labels string, score string"):
    rnd = random.Random(3)
    rows, marks = [], []
    for i in range(n):
        words = [rnd.choice(CLEAN) + rnd.choice(["", "s", "ly"]) for _ in range(rnd.choice([3, 40, 400]))]
        bad = i % 4 == 0
        if bad:
            words.insert(rnd.randrange(len(words)), rnd.choice(["dolt", "nitwit"]))
        rows.append((i, " ".join(words), ["en", "de", None][i % 3], "x", "y"))
        marks.append((i, 1, int(bad), "t"))
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, {extra}")
    return docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int, text string")


def test_held_out_accuracy_and_inputs(spark):
    docs, labels = corpus(spark)
    out = toxicity.score_toxicity(docs, labels).withColumn("held", toxicity.fold() == 0).toPandas()
    held = out[out.held]
    assert len(held) > 100 and (held.predicted == (held.doc_id % 4 == 0)).mean() > 0.95
    again = toxicity.score_toxicity(docs.drop("lang", "labels"), labels).toPandas()
    assert dict(zip(out.doc_id, out.score, strict=True)) == dict(zip(again.doc_id, again.score, strict=True))
    assert out.score.between(0, 1).all()


def test_odd_rows(spark):
    docs, labels = corpus(spark, 300)
    odd = [(900, None), (901, ""), (902, " \n"), (902, " \n"), (None, "a dolt"), (903, "sun " * 120_000 + "nitwit")]
    docs = docs.unionByName(spark.createDataFrame([(i, t, "en", None, None) for i, t in odd], docs.schema))
    labels = labels.unionByName(spark.createDataFrame([(None, 1, 1, None), (900, None, None, None), (1, 0, 0, None)], labels.schema))
    out = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert out[900].score == out[901].score == out[902].score and out[902].predicted == 0
    assert out[903].score > out[901].score and out[None].predicted == 1


def test_empty_tables(spark):
    docs, labels = corpus(spark, 8)
    assert {r.score for r in toxicity.score_toxicity(docs, labels.where("false")).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.where("false"), labels).count() == 0


def test_stage_keeps_by_threshold_of_language(spark, tmp_path, monkeypatch):
    docs, labels = corpus(spark, 300)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    model, _ = toxicity.train(docs, labels)
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels).collect()}
    clean = sorted(s for i, s in scores.items() if i % 4)
    low = clean[len(clean) // 2]  # below 0.5, so 0.5 would keep more
    monkeypatch.setattr(toxicity, "train", lambda *a: (model, {"de": low}))
    kept = {r.doc_id for r in corpus_pipeline.toxicity(spark, docs, str(tmp_path)).collect()}
    assert low < 0.5 and kept == {r.doc_id for r in docs.collect() if scores[r.doc_id] < (low if r.lang == "de" else 0.5)}


def test_sample_is_bounded_in_rows_and_words(spark):
    docs, labels = corpus(spark, 300)
    docs = docs.unionByName(docs).unionByName(docs.withColumn("text", docs.text.substr(1, 40)))
    got = toxicity.labelled_sample(docs, labels, 50, 10_000_000)
    assert len(got) == 50 and got.duplicated(["doc_id", "ids"]).sum() == 0 and not any(zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id)
    few = toxicity.labelled_sample(docs, labels, 6000, 9000)
    assert 0 < sum(len(x) for x in few.ids) <= 9000 * 8 and max(len(x) for x in few.ids) <= 450 * 8


def test_clashing_columns_are_kept(spark):
    docs, labels = corpus(spark, 40)
    got = toxicity.score_toxicity(docs.withColumnRenamed("labels", "FLAGGED"), labels)
    assert {(r.score_input, r.FLAGGED_input) for r in got.collect()} == {("y", "x")}


def slow_logit(model, text):
    """One text word by word with plain loops."""
    import numpy as np

    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
    rows = [zlib.crc32(w.encode()) for w in words]
    x = [model.tables[0][h & 0xFFFF] + model.tables[1][h >> 16] for h in rows] or [np.zeros(toxicity.DIM)]
    z = float(model.bias)
    for k, f in enumerate(model.filters):
        for j in range(toxicity.FILTERS):
            best = max(sum(float(x[i + d] @ f[d][:, j]) for d in range(len(f)) if i + d < len(x)) for i in range(len(x)))
            z += max(best, 0.0) * float(model.out[k * toxicity.FILTERS + j])
    return 1 / (1 + np.exp(-(z * model.scale + model.shift)))


def test_scores_against_brute_force(spark):
    docs, labels = corpus(spark, 300)
    model, _ = toxicity.train(docs, labels)
    some = {r.doc_id: r.text for r in docs.limit(60).collect()} | {1000: "", 1001: "Nitwit", 1002: "a DOLT\x00b é ü-x"}
    frame = spark.createDataFrame([(i, t) for i, t in some.items()], "doc_id long, text string")
    labels_only = toxicity.score_toxicity(docs.select("doc_id", "text").where("doc_id >= 60").unionByName(frame), labels)
    for r in labels_only.where("doc_id < 60 or doc_id >= 1000").collect():
        assert abs(r.score - slow_logit(model, some[r.doc_id])) < 1e-4


def test_training_takes_all_labelled_rows_in_shares(spark, monkeypatch):
    docs, labels = corpus(spark)
    docs, labels = docs.unionByName(docs), labels.unionByName(labels)  # repeated rows count once
    monkeypatch.setattr(toxicity, "SHARE", 100)
    rows = toxicity.labelled(docs, labels)
    want = sum(zlib.crc32(str(i).encode()) % 5 > 0 for i in range(900))
    assert rows.count() == want and rows.rdd.getNumPartitions() > 5
    seen = toxicity.bucket_counts(rows)
    assert seen[1, 0, zlib.crc32(b"the") & 0xFFFF] + seen[0, 0, zlib.crc32(b"the") & 0xFFFF] == sum("the" in r.text.split() for r in docs.distinct().collect() if zlib.crc32(str(r.doc_id).encode()) % 5)
    out = toxicity.score_toxicity(docs, labels).withColumn("held", toxicity.fold() == 0).toPandas()
    held = out[out.held]
    assert (held.predicted == (held.doc_id % 4 == 0)).mean() > 0.95
