"""Distributed connected components by alternating large-star and small-star steps.

Edges stay in Spark; each round is written to the shared checkpoint folder. A round sees one number at
the driver: a digest of the edge set, which stops changing when every component is a star.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convarchive.llm.common import kept


def _digest(edges: DataFrame) -> tuple:
    """Of a set of distinct edges: its size and 128 bits that can't overflow."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", F.lit("again"), "u"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; the component is its smallest node.

    Null ends and self-loops make no link; repeated edges count once. Without edges the result is empty.
    Nodes are of any type that orders. Hubs are met by partial minimum first, then by a join.
    """
    kind = edges.schema["a"].dataType
    u, v = F.col("a").cast(kind), F.col("b").cast(kind)
    now = kept(edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    before = _digest(now)
    if before[0]:
        for _ in range(max_rounds):
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            now = kept(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
            after = _digest(now)
            if after == before:
                break
            before = after
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
