"""Hard-negative mining with a multiway hyperplane tree in the manner of GNAT.

Vectors become integers, ``floor(scale * x)``, and a score is the inner product of two of them, so that every
comparison is exact. For each anchor the best rows of its label are its positives; for each positive the best rows
of other labels whose score lies in a window relative to the positive's score are its hard negatives.

The tree: a node has up to ``FAN`` split points, far from each other, and each vector belongs to the subtree of
the split point nearest to it. For every split point and every subtree beside it the node stores the range of
distances between the point and the subtree's vectors. The points are taken from a bounded sample; ranges, norms
and leaves are those of all rows. A window of scores is an annulus around the query (given the subtree's range of norms), and a
subtree goes as soon as the ranges of one split point show that it lies inside or outside the annulus altogether.
What is left are leaves, and they are scored exactly, as products of a block of queries and a block of rows. So the
result is that of a search through all rows, whatever the sample.

Blocks have a set size: a leaf that holds a third of all rows is many tasks, and what a block returns for a query
are its best rows only. The driver holds the split points and their ranges, whose number the sample bounds.

Rows with a null label, a null vector, or a null or non-finite component take no part; shorter vectors count as
ended by zeros. Rows with a null vec_id are neither anchors nor listed. Equal scores go by vec_id; repeated rows are rows of their own, and an
anchor's repeat may be its positive. A positive of negative score has no negatives. Integer components beyond
``LIMIT`` raise an error, as scores may overflow. An empty table gives no rows. Further columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convarchive.llm.common import require, stored, table

SCALE = 256
FAN = 8
#: The tree's split points come from at most so many rows, and at most so many numbers in all.
SAMPLE_ROWS, SAMPLE_NUMBERS = 4096, 1 << 21
#: A node with at most so many sampled rows is a leaf.
LEAF_SAMPLE = 48
#: Rows and queries of a block.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 1024
LIMIT = 1 << 24


@dataclass
class Node:
    points: np.ndarray
    children: list[int] = field(default_factory=list)
    #: By split point and subtree.
    low: np.ndarray | None = None
    high: np.ndarray | None = None


@dataclass
class Tree:
    """Children are nodes from 0, or leaves as ``-1 - leaf``."""

    nodes: list[Node] = field(default_factory=list)
    leaves: int = 0
    #: By leaf; of leaves without rows the least exceeds the most.
    least_norm: np.ndarray | None = None
    most_norm: np.ndarray | None = None

    def grow(self, sample: np.ndarray, depth: int = 0) -> int:
        points = _apart(sample) if len(sample) > LEAF_SAMPLE and depth < 8 else sample[:1]
        if len(points) < 2:
            self.leaves += 1
            return -self.leaves
        at = len(self.nodes)
        self.nodes.append(Node(points))
        near = distances(sample, points).argmin(1)
        self.nodes[at].children = [self.grow(sample[near == j], depth + 1) for j in range(len(points))]
        return at

    def descend(self, vectors: np.ndarray) -> tuple[np.ndarray, dict]:
        """The leaf of each vector, and the ranges met: ``(node, point, subtree) -> [low, high]`` squared distances."""
        leaf, ranges = np.zeros(len(vectors), np.int64), {}

        def down(at: int, own: np.ndarray) -> None:
            if at < 0:
                leaf[own] = -1 - at
                return
            node = self.nodes[at]
            d = distances(vectors[own], node.points)
            near = d.argmin(1)
            for j, child in enumerate(node.children):
                here = near == j
                if here.any():
                    for i, (a, b) in enumerate(zip(d[here].min(0).tolist(), d[here].max(0).tolist(), strict=True)):
                        ranges[at, i, j] = (a, b)
                    down(child, own[here])

        if self.nodes and len(vectors):
            down(0, np.arange(len(vectors)))
        return leaf, ranges

    def reached(self, vectors: np.ndarray, least: np.ndarray, most: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves, and which queries may find a row there whose score is from ``least`` to ``most``."""
        norms = (vectors * vectors).sum(1)

        def norm_range(at: int) -> tuple[float, float]:
            if at < 0:
                return self.least_norm[-1 - at], self.most_norm[-1 - at]
            found = [norm_range(c) for c in self.nodes[at].children]
            return min(a for a, _ in found), max(b for _, b in found)

        def down(at: int, own: np.ndarray, near: np.ndarray, far: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
            if not len(own):
                return
            a, b = norm_range(at)
            if a > b:
                return
            # score = (|q|^2 + |x|^2 - d^2) / 2; a margin of one for rounding
            fits = (norms[own] + b - near**2 >= 2 * least[own] - 1) & (norms[own] + a - far**2 <= 2 * most[own] + 1)
            own, near, far = own[fits], near[fits], far[fits]
            if at < 0:
                if len(own):
                    yield -1 - at, own
                return
            node = self.nodes[at]
            d = np.sqrt(distances(vectors[own], node.points))
            for j, child in enumerate(node.children):
                inner = np.maximum(d - node.high[:, j], node.low[:, j] - d).max(1)
                outer = (d + node.high[:, j]).min(1)
                yield from down(child, own, np.maximum(near, inner), np.minimum(far, outer))

        yield from down(0 if self.nodes else -1, np.arange(len(vectors)), np.zeros(len(vectors)), np.full(len(vectors), np.inf))


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances, exact."""
    return np.stack([((x - p) ** 2).sum(1) for p in points], 1)


def _apart(sample: np.ndarray) -> np.ndarray:
    """Up to ``FAN`` vectors, each the farthest from those before it."""
    d = distances(sample, sample.mean(0).round()[None])[:, 0]
    chosen: list[int] = []
    while len(chosen) < FAN and d.max() > 0:
        chosen.append(int(d.argmax()))
        own = distances(sample, sample[chosen[-1]][None])[:, 0]
        d = own if len(chosen) == 1 else np.minimum(d, own)
    return sample[chosen]


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows, ended by zeros; as doubles, which hold them and sums of their products exactly."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    out[np.arange(width)[None] < n[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def quantized(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """Rows that take part, with ``v``, the vector of integers."""
    require(embeddings, "vec_id", "label", "embedding")
    sound = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound).select("vec_id", "label", v.alias("v"))


def fit(rows: DataFrame, width: int) -> Tree:
    """A tree of ``rows(vec_id, v)``'s sample: those of the smallest hashes of their ids and vectors."""
    n = max(1, min(SAMPLE_ROWS, SAMPLE_NUMBERS // max(1, width)))
    sample = rows.orderBy(F.xxhash64("vec_id", "v")).limit(n).select("v").toArrow()
    tree = Tree()
    if sample.num_rows:
        tree.grow(_matrix(sample.column("v"), width))
    return tree


def placed(rows: DataFrame, tree: Tree, width: int) -> DataFrame:
    """Adds ``leaf``."""
    names = rows.columns

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            leaf, _ = tree.descend(_matrix(b.column("v"), width))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf)], [*names, "leaf"])

    return rows.mapInArrow(batches, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", leaf long")


def with_ranges(tree: Tree, rows: DataFrame, width: int) -> Tree:
    """The tree with the distance ranges and norms of ``rows(leaf, v)``."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, list[float]] = {}
        for b in found:
            x = _matrix(b.column("v"), width)
            _, ranges = tree.descend(x)
            norms, leaf = (x * x).sum(1), b.column("leaf").to_numpy()
            for k in np.unique(leaf).tolist():
                ranges[-1, k, 0] = (norms[leaf == k].min(), norms[leaf == k].max())
            for key, (a, c) in ranges.items():
                low, high = total.get(key, (a, c))
                total[key] = (min(a, low), max(c, high))
        cols = list(zip(*[(*k, float(a), float(c)) for k, (a, c) in total.items()], strict=True)) or [[]] * 5
        kinds = [pa.int64()] * 3 + [pa.float64()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["node", "i", "j", "low", "high"])

    told = rows.select("v", "leaf").mapInArrow(batches, "node long, i long, j long, low double, high double")
    tree.least_norm, tree.most_norm = np.full(tree.leaves, np.inf), np.full(tree.leaves, -np.inf)
    for node in tree.nodes:
        node.low, node.high = np.full((len(node.points),) * 2, np.inf), np.full((len(node.points),) * 2, -np.inf)
    # as many rows as the tree has leaves and pairs of siblings
    for r in told.groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        if r.node < 0:
            tree.least_norm[r.i], tree.most_norm[r.i] = r.low, r.high
        else:
            node = tree.nodes[r.node]
            node.low[r.i, r.j], node.high[r.i, r.j] = np.sqrt(r.low), np.sqrt(r.high)
    return tree


def reached_leaves(queries: DataFrame, tree: Tree, width: int) -> DataFrame:
    """``(anchor, leaf)`` of ``queries(anchor, v, least, most)``."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            anchor = b.column("anchor").to_numpy()
            least, most = b.column("least").to_numpy(), b.column("most").to_numpy()
            for leaf, own in tree.reached(_matrix(b.column("v"), width), least, most):
                yield pa.RecordBatch.from_arrays([pa.array(anchor[own]), pa.array(np.full(len(own), leaf))], ["anchor", "leaf"])

    return queries.select("anchor", "v", "least", "most").mapInArrow(batches, "anchor long, leaf long")


def _best(score: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Of the rows ``own`` the first ``k``: by score, from high to low, then by id."""
    if len(own) > k:
        own = own[score[own] >= np.partition(score[own], len(own) - k)[len(own) - k]]
    return own[np.lexsort((ids[own], -score[own]))][:k]


def _scored(width: int, k: int, same_label: bool):
    """Of a block of rows and a block of queries: each query's (each window's) best rows."""

    def group(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(5)]
        if queries.num_rows and rows.num_rows:
            ids, numbers = rows.column("vec_id").to_numpy(), rows.column("row").to_numpy()
            _, labels = np.unique(rows.column("label").to_pylist() + queries.column("label").to_pylist(), return_inverse=True)
            x, anchors = _matrix(rows.column("v"), width), queries.column("anchor").to_pylist()
            scores = (_matrix(queries.column("v"), width) @ x.T).astype(np.int64)
            windows = queries.column("windows").to_pylist()
            for q, anchor in enumerate(anchors):
                same, score = labels[: len(ids)] == labels[len(ids) + q], scores[q]
                for w in windows[q]:
                    # windows are given in hundredths of a score
                    fits = (same & (numbers != anchor) if same_label else ~same) & (100 * score >= w["low"]) & (100 * score <= w["high"])
                    for at in _best(score, ids, np.flatnonzero(fits), k).tolist():
                        for col, value in zip(out, (anchor, w["place"], score[at], ids[at], numbers[at]), strict=True):
                            col.append(int(value))
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["anchor", "place", "score", "vec_id", "row"])

    return group


def searched(rows: DataFrame, queries: DataFrame, leaves: DataFrame, width: int, k: int, same_label: bool) -> DataFrame:
    """``(anchor, place, score, vec_id, row, rank)``: the best ``k`` rows of each window of ``queries(anchor, label, v, windows)`` in the leaves reached."""
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    asked = leaves.withColumn("part", F.pmod(F.xxhash64("anchor"), F.lit(blocks)))
    wanted = rows.join(asked.select("leaf", "part").distinct(), "leaf")
    sent = asked.join(rows.select("leaf", "block").distinct(), "leaf").join(queries.select("anchor", "label", "v", "windows"), "anchor")
    keys = ["leaf", "block", "part"]
    # both sides come from the same rows: new names tell their columns apart
    sent = sent.select(*[F.col(c).alias(c) for c in sent.columns])
    met = sent.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInArrow(_scored(width, k, same_label), "anchor long, place long, score long, vec_id long, row long")
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "vec_id", "row")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(embeddings: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = SCALE) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank)``.

    ``anchor`` says of a row of ``(vec_id, label, embedding)`` whether it is one; ``low`` and ``high`` are the window's
    bounds in hundredths of the positive's score.
    """
    spark = embeddings.sparkSession
    own = quantized(embeddings, scale).withColumns({"row": F.monotonically_increasing_id(), "is_anchor": F.coalesce(anchor, F.lit(False))})
    rows = stored(own.where("vec_id is not null").withColumn("vec_id", F.col("vec_id").cast("long")))
    width, most, n = rows.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs))), F.count("*")).first()
    width, most = width or 0, most or 0
    if most > LIMIT or most * most * width >= 1 << 53:
        raise ValueError(f"a component of {most} at {width} components: scores may overflow")
    tree = fit(rows, width)
    placed_rows = stored(placed(rows, tree, width))
    sizes = placed_rows.groupBy("leaf").agg(F.count("*").alias("size"))
    blocked = placed_rows.join(sizes, "leaf").withColumn("block", F.pmod(F.xxhash64("row"), F.ceil(F.col("size") / BLOCK_ROWS)))
    blocked = stored(blocked.select("leaf", "block", "row", "vec_id", "label", "v", "is_anchor"))
    tree = with_ranges(tree, placed_rows, width)
    bound = 1 << 54
    whole = F.array(F.struct(F.lit(0).cast("long").alias("place"), F.lit(-bound).alias("low"), F.lit(bound).alias("high")))
    anchors = stored(blocked.where("is_anchor").select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "v", "leaf", whole.alias("windows")))
    # an anchor's own leaf first: the score of its last positive there bounds what other leaves must offer
    near = stored(searched(blocked, anchors, anchors.select("anchor", "leaf"), width, positives, True))
    least = near.where(F.col("rank") == positives).select("anchor", F.col("score").cast("double").alias("least"))
    asking = anchors.join(least, "anchor", "left").select("anchor", "v", F.coalesce("least", F.lit(float("-inf"))).alias("least"), F.lit(float("inf")).alias("most"))
    beyond = reached_leaves(asking, tree, width).join(anchors.select("anchor", "leaf"), ["anchor", "leaf"], "left_anti")
    far = searched(blocked, anchors, beyond, width, positives, True)
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id", "row")
    best = near.drop("rank").unionByName(far.drop("rank")).withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= positives)
    best = stored(best.select("anchor", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    window = F.struct("place", (F.col("positive_score") * low).alias("low"), (F.col("positive_score") * high).alias("high"))
    windows = best.where(F.col("positive_score") >= 0).groupBy("anchor").agg(F.collect_list(window).alias("windows"))
    asking = stored(anchors.drop("windows").join(windows, "anchor"))
    span = asking.select("anchor", "v", (F.array_min("windows.low") / 100).alias("least"), (F.array_max("windows.high") / 100).alias("most"))
    found = searched(blocked, asking, reached_leaves(span, tree, width), width, negatives, False)
    out = found.join(best, ["anchor", "place"]).join(anchors.select("anchor", "anchor_id"), "anchor")
    return out.select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"), F.col("place").alias("positive_rank")
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b)::INTEGER AS rank,
  s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10
"""
