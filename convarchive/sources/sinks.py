"""Sinks: notes, assets, manifests, and writing only what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convarchive.functions.text import sniff_ext


def write_notes(notes: DataFrame, path: str) -> None:
    """Notes as Parquet by year and month, ``0000/00`` without a date."""
    year, month = F.coalesce(F.date_format("date", "yyyy"), F.lit("0000")), F.coalesce(F.date_format("date", "MM"), F.lit("00"))
    notes.withColumns({"year": year, "month": month}).write.partitionBy("year", "month").mode("append").parquet(path)


def bank_rows(assets: DataFrame, bank: DataFrame) -> DataFrame:
    """Assets ``(path, content, …)`` that the bank lacks, once a content: named by the first 16 digits of their hash and their type.

    ``path`` is the smallest of a content's; further columns are those of that row. Only what the bank lacks is
    shuffled with its content; copies meet by hash first.
    """
    named = assets.withColumn("sha1", F.sha1("content")).join(bank.select("sha1"), "sha1", "left_anti")
    counted = named.groupBy("sha1").agg(F.min("path").alias("path"), F.count("*").alias("copies"))
    more = [c for c in named.columns if c not in ("sha1", "path")]
    once = named.join(counted, ["sha1", "path"]).groupBy("sha1", "path", "copies").agg(F.first(F.struct(*more)).alias("x")).select("sha1", "path", "copies", "x.*")
    ext = sniff_ext(F.col("content"))
    return once.withColumns({"ext": ext, "bytes": F.octet_length("content").cast("long"), "file": F.concat(F.substring("sha1", 1, 16), F.lit("."), ext)})


def write_assets(assets: DataFrame, bank: DataFrame, path: str) -> None:
    """Appends new assets with content and metadata; a bank is read by hash without its contents, which are a column of their own."""
    bank_rows(assets, bank).write.mode("append").parquet(path)


def append_manifest(log: DataFrame, path: str) -> None:
    """Import records as JSON lines, details cut at 400 characters."""
    log.withColumn("detail", F.substring("detail", 1, 400)).write.mode("append").json(path)


def changed_rows(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """``new`` with ``changed``: whether its ``body`` differs from the old one's or the key is new."""
    before = old.select(key, F.sha1("body").alias("__old"))
    return new.join(before, key, "left").withColumn("changed", ~F.sha1("body").eqNullSafe(F.col("__old"))).drop("__old")


def current(stored: DataFrame, key: str) -> DataFrame:
    """The newest version of each key of what ``write_if_changed`` wrote."""
    newest = stored.groupBy(key).agg(F.max("version").alias("version"))
    return stored.join(newest, [key, "version"], "left_semi")


def write_if_changed(new: DataFrame, old: DataFrame, key: str, path: str) -> DataFrame:
    """Writes changed rows as the next version of their keys and returns ``(written, skipped)``; ``current`` reads the newest.

    ``old`` may be what ``current`` gives. The counts come from what was written, so the comparison runs once.
    """
    spark = new.sparkSession
    last = old.agg(F.max("version")).first()[0] if "version" in old.columns else None
    version = (last or 0) + 1
    changed_rows(new, old, key).where("changed").drop("changed").withColumn("version", F.lit(version).cast("long")).write.mode("append").parquet(path)
    written = spark.read.parquet(path).where(F.col("version") == version).agg(F.count("*").alias("written"))
    return written.crossJoin(new.agg(F.count("*").alias("n"))).select("written", (F.col("n") - F.col("written")).alias("skipped"))
