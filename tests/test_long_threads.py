"""Long threads by doubling, and numbers in groups, against plain loops."""

import random
import time

from pyspark.sql import functions as F

from convarchive.operators import ranking, threads


def walk(up, leaf):
    path = []
    while leaf is not None and leaf in up and leaf not in path:
        path.append(leaf)
        leaf = up[leaf]
    return path[::-1]


def test_long_walk_is_the_short_one(spark, monkeypatch):
    rnd = random.Random(4)
    trees = {c: {f"n{i}": (f"n{rnd.randrange(max(0, i - 4), i)}" if i else None) for i in range(rnd.choice([1, 5, 60, 90]))} for c in range(8)}
    trees[8] = {"a": "b", "b": "c", "c": "a", "d": "a"}  # a cycle with a tail
    trees[9] = {"a": "gone", "b": "a", "c": "c"}
    leaves = {c: list(t)[-1] for c, t in trees.items()} | {9: "b"}
    nodes = spark.createDataFrame([(c, n, p) for c, t in trees.items() for n, p in t.items()], "conv_id int, node_id string, parent_id string")
    asked = spark.createDataFrame(list(leaves.items()), "conv_id int, leaf_id string")
    want = sorted((c, i, n) for c, leaf in leaves.items() for i, n in enumerate(walk(trees[c], leaf)))
    assert sorted(map(tuple, threads._walk(nodes, asked).collect())) == want
    monkeypatch.setattr(threads, "SHORT", 0)
    assert sorted(map(tuple, threads._walk(nodes, asked).collect())) == want


def test_a_thread_of_many_nodes(spark):
    """Ten times the nodes take far less than ten times the squares."""
    took = []
    for n in (5_000, 50_000):
        k = F.col("id").cast("string")
        nodes = spark.range(n).select(F.lit("c").alias("conv_id"), k.alias("node_id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent_id"))
        began = time.time()
        got = threads._walk(nodes, spark.createDataFrame([("c", str(n - 1))], "conv_id string, leaf_id string"))
        assert got.where(F.col("pos").cast("string") == F.col("node_id")).count() == n
        took.append(time.time() - began)
    assert took[1] < 20 * took[0]


def test_numbers_in_groups(spark):
    rows = [(k, None if k % 7 == 0 else "g" if k % 3 else f"h{k % 5}", k * 37 % 101) for k in range(500)]
    df = spark.createDataFrame(rows, "id int, grp string, v int")
    got = {r.id: (r.nth, r.n) for r in ranking.numbered(df, [F.col("grp")], [F.col("v"), F.col("id")]).collect()}
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    want = {r[0]: (k + 1, len(g)) for g in groups.values() for k, r in enumerate(sorted(g, key=lambda r: (r[2], r[0])))}
    assert got == want
    assert ranking.numbered(df.where("false"), [F.col("grp")], [F.col("id")]).count() == 0
