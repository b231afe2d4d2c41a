"""Hard negatives against a search through all rows, and the tree's bounds against all distances."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from convarchive.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, positives=5, negatives=10):
    sound = [(i, y, [math.floor(256 * float(np.float32(x))) for x in v]) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for k, (i, y, v) in enumerate(sound):
        if i % 10:
            continue
        scored = sorted((-dot(v, w), j, n, z) for n, (j, z, w) in enumerate(sound) if n != k)
        for s, j, _, _ in [x for x in scored if x[3] == y][:positives]:
            fits = [x for x in scored if x[3] != y and -30 * s <= -100 * x[0] <= -90 * s][:negatives]
            out += [(i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(fits)]
    return sorted(out)


def run(spark, rows, **more):
    found = hn.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, **more).drop("positive_rank")
    return sorted(tuple(r) for r in found.collect())


def clusters(n, seed=1, width=8):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(6, width))
    return [(k, int(rnd.integers(4)), [float(x) for x in centres[rnd.integers(6)] + 0.4 * rnd.normal(size=width)]) for k in range(n)]


def test_all_rows(spark):
    rows = clusters(400)
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("block", [7, 64])
def test_small_blocks_and_sample(spark, monkeypatch, block):
    monkeypatch.setattr(hn, "BLOCK_ROWS", block)
    monkeypatch.setattr(hn, "BLOCK_QUERIES", 5)
    monkeypatch.setattr(hn, "LEAF_SAMPLE", 4)
    monkeypatch.setattr(hn, "SAMPLE_ROWS", 60)
    rows = clusters(150, seed=2)
    assert run(spark, rows, positives=3, negatives=4) == brute(rows, 3, 4)


def test_ties_repeats_and_rows_that_take_no_part(spark):
    rows = clusters(40, seed=3) + [(k, 1, [1.0, 0.0]) for k in range(50, 75)] + [(k, 2, [0.5, 0.0]) for k in range(75, 100)]
    rows += [(50, 1, [1.0, 0.0]), (100, None, [1.0]), (101, 1, None), (102, 1, [float("nan")]), (103, 2, [1.0, None]), (104, 2, [float("inf")]), (None, 1, [1.0]), (110, 3, []), (120, 3, [-1.0] * 8)]
    assert run(spark, rows) == brute(rows)


def test_empty_and_clashing_columns(spark):
    assert run(spark, []) == []
    rows = clusters(60, seed=4)
    wide = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("v", "row", "leaf", "block", "score", "rank", "is_anchor")})
    assert sorted(tuple(r)[:6] for r in hn.mine(wide, F.col("vec_id") % 10 == 0).collect()) == brute(rows)


def test_overflow_is_told(spark):
    with pytest.raises(ValueError, match="overflow"):
        run(spark, [(0, 1, [1e30]), (1, 1, [1.0])])


def test_elimination_keeps_every_row_in_the_window(spark, monkeypatch):
    x = np.random.default_rng(5).integers(-90, 90, size=(300, 4)).astype(float)
    monkeypatch.setattr(hn, "LEAF_SAMPLE", 4)
    tree = hn.Tree()
    tree.grow(x[:120])
    rows = spark.createDataFrame([(k, v.astype(int).tolist()) for k, v in enumerate(x)], "row long, v array<long>")
    placed = hn.placed(rows, tree, 4).persist()
    leaf = {r.row: r.leaf for r in placed.collect()}
    tree = hn.with_ranges(tree, placed, 4)
    queries = x[:40]
    least, most = np.full(40, 14000.0), np.full(40, 16000.0)
    reached = {(leaf, int(q)) for leaf, own in tree.reached(queries, least, most) for q in own}
    needed = {(leaf[k], q) for q in range(40) for k in range(300) if 14000 <= queries[q] @ x[k] <= 16000}
    assert needed <= reached
    assert len(reached) < 20 * tree.leaves
