"""Aggregations, indexes and statistics over notes, assets and imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convarchive.operators.projects import project_view
from convarchive.operators.ranking import numbered

#: How a note names an attachment, in its present and its older form.
ATTACHMENT = "(?m)^(?:📎\\s*Archivo\\s+adjunto|📄\\s*Archivo\\s+cargado):\\s*\\*\\*(.+?)\\*\\*"


def tree_counts(notes: DataFrame) -> DataFrame:
    """Note counts at each level of project, year and month (null: all below)."""
    view = project_view(notes).withColumn("project", F.lower("project"))
    return view.rollup("project", "year", "month").agg(F.count("*").alias("notes"))


def tree_index(notes: DataFrame, max_per_month: int | None = None) -> DataFrame:
    """``(project, year, month, nth, note_id, more)``: notes by date, then title, the first ``max_per_month``; ``more``: how many the month has beyond.

    A month may hold any number of notes: all undated ones of a project are one, numbered over as many tasks as they need.
    """
    fields = [F.col("note_id"), F.lower("title").alias("__title"), F.col("date").isNotNull().alias("__dated"), "date"]
    view = project_view(notes).join(notes.select(*fields), "note_id")
    order = [F.col("__dated"), F.col("date"), F.coalesce("__title", F.lit("")), F.col("note_id")]
    out = numbered(view, [F.lower("project"), F.col("year"), F.col("month")], order)
    limit = F.lit(max_per_month) if max_per_month else F.col("n")
    return out.where(F.col("nth") <= limit).select("project", "year", "month", F.col("nth").cast("int").alias("nth"), "note_id", F.greatest(F.lit(0), F.col("n") - limit).alias("more"))


def attachment_index(notes: DataFrame) -> DataFrame:
    """``(name, notes)``: in how many notes, and which, each attached file is used."""
    names = notes.select("note_id", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(ATTACHMENT), 1))).alias("name"))
    return names.groupBy("name").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("note_id")).alias("notes"))


def bank_entries(notes: DataFrame, manifest: DataFrame, prefix: str) -> DataFrame:
    """Files of a bank that a note links or embeds, once a note at their first place, with display title and caption."""
    pattern = rf"!?\[[^\]]*\]\(\Q{prefix}\E/[^)]+\)"
    links = notes.select("note_id", F.posexplode(F.regexp_extract_all("body", F.lit(f"({pattern})"), 1)).alias("pos", "link"))
    parsed = links.select(
        "note_id", "pos", F.startswith("link", F.lit("!")).alias("embed"), F.regexp_extract("link", r"\[([^\]]*)\]", 1).alias("text"), F.regexp_extract("link", r"([^/(]+)\)$", 1).alias("file")
    )
    first = F.row_number().over(Window.partitionBy("note_id", "file").orderBy("pos"))
    once = parsed.withColumn("nth", first).where("nth = 1").drop("nth")
    pretty = F.regexp_replace(F.regexp_replace("file", r"\.[^.]*$", ""), "[-_]+", " ")
    met = once.join(manifest.select("file", "prompt"), "file", "left")
    return met.select("note_id", "pos", "file", "embed", F.coalesce(F.nullif("text", F.lit("")), pretty).alias("title"), F.col("prompt").alias("caption"))


def bank_catalog(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest entries that are on disk, newest first."""
    return manifest.join(files.select("file"), "file", "left_semi")


def provider_index(entries: DataFrame) -> DataFrame:
    """Items and conversations per bank of ``entries(bank, note_id, file)``."""
    return entries.groupBy("bank").agg(F.count("*").alias("items"), F.countDistinct("note_id").alias("conversations"))


def pending_list(pending: DataFrame, limit: int = 70) -> DataFrame:
    """Untriaged downloads, the prompt cut; show them newest first."""
    open_ = pending.where(F.coalesce("state", F.lit("sin_triar")) == "sin_triar")
    return open_.select("ref", "created", F.substring("prompt", 1, limit).alias("prompt"))


def vault_stats(notes: DataFrame) -> DataFrame:
    """Notes, bytes and first and last date overall and per month, provider and project, in one pass: ``(dimension, value, …)``."""
    named = notes.select(
        F.coalesce(F.date_format("date", "yyyy-MM"), F.lit("no date")).alias("month"), F.coalesce("provider", F.lit("chatgpt")).alias("provider"), F.coalesce("project", F.lit("none")).alias("project"), "bytes", "date"
    )
    cube = named.groupingSets([[], ["month"], ["provider"], ["project"]], "month", "provider", "project")
    out = cube.agg(F.grouping_id().alias("g"), F.count("*").alias("notes"), F.sum("bytes").alias("bytes"), F.min("date").alias("first"), F.max("date").alias("last"))
    dimension = F.when(F.col("g") == 7, "all").when(F.col("g") == 3, "month").when(F.col("g") == 5, "provider").otherwise("project")
    return out.select(dimension.alias("dimension"), F.coalesce("month", "provider", "project", F.lit("")).alias("value"), "notes", "bytes", "first", "last")


def asset_stats(assets: DataFrame) -> DataFrame:
    """Files and bytes per provider and bank with totals (null: all); names that start with ``_`` don't count."""
    return assets.where(~F.startswith("file", F.lit("_"))).rollup("provider", "bank").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def last_import(log: DataFrame, now) -> DataFrame:
    """The last import per provider and the days since then at ``now``, never negative."""
    out = log.groupBy("provider").agg(F.max("ts").alias("last"))
    return out.withColumn("days", F.greatest(F.lit(0), F.datediff(now, F.col("last"))))


def conv_index(convs: DataFrame) -> DataFrame:
    return convs.select("conv_id", "title", "date", F.array_join(F.array_sort("tags"), ", ").alias("tags"))


def tag_index(convs: DataFrame) -> DataFrame:
    return convs.select("conv_id", F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("conv_id")).alias("conversations"))


def import_records(convs: DataFrame, messages: DataFrame) -> DataFrame:
    """Message count and words of each imported conversation."""
    from convarchive.functions.text import word_count

    said = messages.groupBy("conv_id").agg(F.count("*").alias("messages"), F.sum(word_count(F.col("content"), "regex")).alias("words"))
    return convs.join(said, "conv_id", "left")


def dashboard(**parts: DataFrame) -> DataFrame:
    """``(source, metric, value)`` of one-row frames; a source that is None is absent, and so is a metric that is null."""
    out = None
    for source, frame in parts.items():
        if frame is None:
            continue
        long = frame.select(F.lit(source).alias("source"), F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in frame.columns])).alias("m"))
        long = long.select("source", "m.*").where("value is not null")
        out = long if out is None else out.unionByName(long)
    return out


def unnamed_count(convs: DataFrame) -> DataFrame:
    return convs.where("project_id is not null and project = 'none'").agg(F.countDistinct("project_id").alias("unnamed"))
