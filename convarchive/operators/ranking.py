"""Row numbers within groups of any size.

A window numbers a group in one task. Here rows are range-sorted by group and order, so a large group is as many
partitions as it needs; each partition numbers its own rows, and what a group has in the partitions before
is added: a sum over partitions, not rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convarchive.sources.shared import new_folder


def numbered(rows: DataFrame, group: list[Column], order: list[Column], nth: str = "nth", total: str = "n") -> DataFrame:
    """``rows`` with ``nth`` (from 1) in its group by ``order`` and the group's ``total``.

    Group values may be null, which is a group. Rows that ``order`` can't tell apart are numbered in the order of their hash, and may
    lie in one partition; give a key that is distinct. What is sorted is written to the shared checkpoint folder.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups, keys = [f"__g{k}" for k in range(len(group))], [f"__o{k}" for k in range(len(order))]
    named = rows.select("*", *[c.alias(g) for c, g in zip(group, groups, strict=True)], *[c.alias(k) for c, k in zip(order, keys, strict=True)])
    # null comes first in groups, as in a range; in what orders a group, callers say where by a column of its own
    by = [*groups, *keys]
    dealt = named.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    path = f"{new_folder(spark)}/numbered"
    dealt.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}).drop(*keys).write.parquet(path)
    dealt = spark.read.parquet(path)
    counts = dealt.groupBy(*groups, "__part").agg(F.count("*").alias("__here"), F.min("__at").alias("__first"))
    # a row for each partition a group is in
    every = Window.partitionBy(*groups)
    before = F.coalesce(F.sum("__here").over(every.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*[F.col(g).alias(f"{g}_") for g in groups], F.col("__part").alias("__of"), "__first", before.alias("__before"), F.sum("__here").over(every).alias(total))
    same = F.col("__part") == F.col("__of")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}_"))
    met = dealt.join(counts, same)
    number = F.col("__before") + F.col("__at") - F.col("__first") + 1
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], number.alias(nth), total)
