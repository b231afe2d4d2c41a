"""Pending downloads and their triage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convarchive.functions.text import strip_space

#: Triage states; a missing one is the first.
UNTRIAGED, RESCUED, DISCARDED = "sin_triar", "rescatada", "descartada"


def pending_ref(credential: Column) -> Column:
    """The name of a download that doesn't give its credential away."""
    return F.substring(F.sha2(strip_space(credential), 256), 1, 16)


def merge_pending(known: DataFrame, seen: DataFrame, *within: str) -> DataFrame:
    """Seen downloads merged into known ones by ``ref``, in lists of their own ``within`` further columns: queries and conversations join, the known state stays."""
    rows = known.withColumn("old", F.lit(True)).unionByName(seen.withColumn("old", F.lit(False)), allowMissingColumns=True)
    joined = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    state = F.coalesce(F.max(F.when(F.col("old"), F.col("state"))), F.lit(UNTRIAGED))
    return rows.groupBy("ref", *within).agg(state.alias("state"), F.max("credential").alias("credential"), joined("queries"), joined("conversations"))


def sanitize(pending: DataFrame) -> DataFrame:
    """Triaged rows lose their credential; ``cleaned`` marks those that had one."""
    triaged = F.coalesce("state", F.lit(UNTRIAGED)) != UNTRIAGED
    return pending.withColumns({"cleaned": triaged & F.col("credential").isNotNull(), "credential": F.when(~triaged, F.col("credential"))})


def exposure(pending: DataFrame) -> DataFrame:
    """How many credentials are still there, and of those how many needn't be."""
    triaged = F.coalesce("state", F.lit(UNTRIAGED)) != UNTRIAGED
    return pending.where("credential is not null").agg(F.count("*").alias("exposed"), F.count_if(triaged).alias("needless"))


def untriaged(pending: DataFrame) -> DataFrame:
    return pending.where(F.coalesce("state", F.lit(UNTRIAGED)) == UNTRIAGED)


def apply_triage(pending: DataFrame, events: DataFrame, *within: str) -> DataFrame:
    """States after the newest of ``events(ref, ts, action, file, media_type)``: discard, or register with its file and bank, if it has one; lists that are kept apart as for ``merge_pending``.

    A missing ``ref`` is a value like any other, as it is in ``merge_pending``.
    """
    keys = ["ref", *within]
    last = events.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max(F.struct("ts", "action", "file", "media_type")).alias("e"))
    met = pending.join(last, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), "left").drop(*[f"__{k}" for k in keys])
    action = F.col("e.action")
    return met.withColumns(
        {
            "state": F.when(action == "discard", DISCARDED).when(action == "register", RESCUED).otherwise(F.coalesce("state", F.lit(UNTRIAGED))),
            "file": F.when(action == "register", F.col("e.file")),
            "bank": F.when((action == "register") & F.col("e.file").isNotNull(), F.when(F.startswith("e.media_type", F.lit("video")), "videos").otherwise("images")),
        }
    ).drop("e")
