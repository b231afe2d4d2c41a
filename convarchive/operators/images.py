"""Image libraries: reconciliation of inventories, manifests and files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States after which an asset is never tried again.
TERMINAL = ["ok", "repetida", "ausente"]


def reconcile_imagine(inventory: DataFrame, states: DataFrame, manifest: DataFrame, files: DataFrame) -> DataFrame:
    """``(status, n)`` over ``inventory(asset_id)``, ``states(asset_id, state)``, ``manifest(file, asset_id)`` and ``files(file, bytes, partial)``.

    Assets: never tried, failed, absent, ok without manifest, ok. Manifest files: missing, empty, partial.
    """
    listed = manifest.select("asset_id", F.lit(True).alias("listed")).distinct()
    met = inventory.select("asset_id").distinct().join(states, "asset_id", "left").join(listed, "asset_id", "left")
    asset = (
        F.when(F.col("state").isNull(), "never tried").when(F.col("state").isin("error", "sin key"), "failed").when(F.col("state") == "ausente", "absent")
        .when(F.col("listed").isNull() & (F.col("state") == "ok"), "ok without manifest").otherwise("ok")
    )
    file = F.when(F.col("bytes").isNull(), "file missing").when(F.col("bytes") == 0, "file empty").when(F.col("partial"), "file partial").otherwise("file ok")
    rows = met.select(asset.alias("status")).unionByName(manifest.join(files, "file", "left").select(file.alias("status")))
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def reconcile_copilot(index: DataFrame, files: DataFrame) -> DataFrame:
    """``(id, problem)`` of ``index(id, size_bytes, prompt)`` against ``files(id, bytes, has_meta, meta_ok, partial)``; files of no entry are outside the library."""
    checks = [
        (F.col("in_index").isNull(), "outside library"),
        (F.col("in_files").isNull(), "missing"),
        (F.col("partial"), "partial"),
        (F.col("bytes") == 0, "empty"),
        (F.col("size_bytes").isNotNull() & (F.col("bytes") != F.col("size_bytes")), "size mismatch"),
        (~F.col("has_meta"), "metadata missing"),
        (~F.col("meta_ok"), "metadata corrupt"),
        (F.col("prompt").isNull(), "no prompt"),
    ]
    met = index.withColumn("in_index", F.lit(True)).join(files.withColumn("in_files", F.lit(True)), "id", "full")
    problem = reduce(lambda c, x: c.when(*x), checks[1:], F.when(*checks[0]))
    return met.select("id", problem.alias("problem")).where("problem is not null")


def copilot_images(raw: DataFrame) -> DataFrame:
    """Metadata of library images without temporary addresses, a unique file name and its month."""
    ext = F.lower(F.coalesce(F.nullif(F.regexp_extract("name", r"\.([A-Za-z0-9]{2,4})$", 1), F.lit("")), F.lit("png")))
    stem = F.substring(F.regexp_replace(F.regexp_replace("name", r"\.[A-Za-z0-9]{2,4}$", ""), r"[^\p{L}\p{N}\-_.() ]", ""), 1, 60)
    named = raw.select("id", "prompt", "created", "size_bytes", stem.alias("stem"), ext.alias("ext"))
    named = named.withColumn("__key", F.lower("stem"))
    named = named.join(named.groupBy("__key", "ext").agg((F.count("*") > 1).alias("__taken")), ["__key", "ext"], "left")
    taken = F.coalesce("__taken", F.lit(False))
    file = F.concat("stem", F.when(taken, F.concat(F.lit("_"), F.substring("id", 1, 8))).otherwise(""), F.lit("."), "ext")
    return named.select("id", "prompt", "size_bytes", file.alias("file"), F.coalesce(F.date_format("created", "yyyy-MM"), F.lit("0000-00")).alias("month"))


def copilot_index(images: DataFrame) -> DataFrame:
    return images.groupBy("month").agg(F.count("*").alias("images"), F.sum("size_bytes").alias("bytes"))


def imagine_manifest(assets: DataFrame) -> DataFrame:
    """Manifest entries with the asset that an edit was made from (``aux`` keys of a parent that is in the inventory)."""
    known = assets.select(F.col("asset_id").alias("edit_of"))
    entry = assets.select(F.concat("asset_id", F.lit("."), F.regexp_extract("mime", r"/(\w+)$", 1)).alias("file"), "asset_id", "mime", "width", "height", "is_public", F.try_element_at("aux", F.lit("parent")).alias("parent"))
    met = entry.join(known, F.col("parent") == F.col("edit_of"), "left")
    return met.drop("parent")


def next_state(states: DataFrame, outcomes: DataFrame) -> DataFrame:
    """States ``(asset_id, state)`` after the newest of ``outcomes(asset_id, outcome, ts)``; terminal ones never change."""
    last = outcomes.groupBy("asset_id").agg(F.max(F.struct("ts", "outcome")).alias("o")).select("asset_id", "o.outcome")
    met = states.join(last, "asset_id", "full")
    state = F.when(F.col("state").isin(TERMINAL), F.col("state")).otherwise(F.coalesce("outcome", "state"))
    return met.select("asset_id", state.alias("state"))


def retry_queue(inventory: DataFrame, states: DataFrame) -> DataFrame:
    return inventory.join(states.where(F.col("state").isin(TERMINAL)), "asset_id", "left_anti")
