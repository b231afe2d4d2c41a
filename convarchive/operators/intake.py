"""Format detection, validation, schema drift and incremental intake of exports.

``members(archive, member)`` are the entries of archives, ``files(name, bytes, mtime, …)`` export files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Folders of a split export.
CATEGORIES = ["conversations", "projects", "memories", "frames", "light_metadata"]


def detect_provider(json: Column) -> Column:
    """The provider of an export's JSON by its structure, never by its name."""
    v = F.try_parse_json(json)
    has = lambda path: F.try_variant_get(v, path, "variant").isNotNull()
    return (
        F.when(has("$[0].chat_messages"), "claude")
        .when(has("$.conversations[0].responses"), "grok")
        .when(json.rlike(r"^﻿?\s*\"?Conversation\"?,\"?Time\"?,\"?Author\"?,\"?Message"), "copilot")
        .when(has("$[0].mapping") | has("$[0].messages") | has("$.conversations[0].mapping") | has("$.items[0].mapping"), "chatgpt")
    )


def classify_exports(members: DataFrame) -> DataFrame:
    """``(archive, kind, valid, message)``: what an archive holds, in a fixed order of precedence.

    ``members(archive, member[, error])``: an archive that could not be read has one row with an ``error`` and is told apart
    from one of unknown content, as its conversations are missing. A lone ``conversations.json`` in an archive named like a part of a
    split export is such a part. A publication is known and refused; how many further tables of it hold readers' data is said.
    """
    base = F.regexp_extract("member", r"([^/]*)$", 1)
    any_ = lambda pattern: F.coalesce(F.bool_or(base.rlike(pattern)), F.lit(False))
    error = F.max("error") if "error" in members.columns else F.lit(None).cast("string")
    flags = members.groupBy("archive").agg(
        error.alias("error"), any_(r"^conversations-\d+\.json$").alias("shards"), F.bool_or(F.col("member").rlike(rf"(^|/)({'|'.join(CATEGORIES)})-\d+/")).alias("split"),
        any_(r"^users\.json$").alias("users"), F.bool_or(F.startswith("member", F.lit("projects/"))).alias("projects"), any_(r"^conversations\.json$").alias("conversations"), any_(r"^prod-grok-backend\.json$").alias("grok"),
        any_(r"^posts\.csv$").alias("posts"), any_(r"\.html$").alias("html"), any_(r"\.csv$").alias("csv"), F.count_if(base.rlike(r"\.csv$") & (base != "posts.csv")).alias("tables"), F.count("member").alias("members"),
    )
    part = F.regexp_extract(F.lower("archive"), r"([^/]*)$", 1).rlike(r"^conversations-\d+(\.zip)?$") & (F.col("members") == 1)
    c = F.col
    kind = (
        F.when(c("error").isNotNull(), "corrupt").when(c("shards"), "chatgpt shards").when(c("split"), "claude split").when(c("conversations") & part, "claude part")
        .when(c("conversations") & (c("users") | c("projects")), "claude").when(c("conversations"), "chatgpt").when(c("grok"), "grok").when(c("posts"), "posts").when(c("html"), "html").when(c("csv"), "copilot").otherwise("unknown")
    )
    out = flags.select("archive", kind.alias("kind"), "error", "tables")
    message = (
        F.when(c("kind") == "corrupt", F.concat(F.lit("corrupt or unreadable, its conversations are not imported: "), c("error")))
        .when(c("kind") == "posts", F.concat(F.lit("a publication, not a chat export; further tables with readers' data: "), c("tables").cast("string")))
        .when(c("kind") == "claude part", "one part of a split export; the others come apart").when(c("kind") == "html", "degraded: HTML only").when(c("kind") == "unknown", "not an export")
    )
    return out.select("archive", "kind", (~c("kind").isin("corrupt", "posts", "unknown")).alias("valid"), message.alias("message"))


def classify_layouts(paths: DataFrame) -> DataFrame:
    """``(root, categories, valid)`` of folders laid out as ``<root>/<category>-NNN/…``; conversations are a must."""
    parsed = paths.select(F.regexp_extract("path", rf"^(.*)/(?:{'|'.join(CATEGORIES)})-\d+/", 1).alias("root"), F.regexp_extract("path", rf"/({'|'.join(CATEGORIES)})-\d+/", 1).alias("category")).where("category <> ''")
    out = parsed.groupBy("root").agg(F.array_sort(F.collect_set("category")).alias("categories"))
    return out.withColumn("valid", F.array_contains("categories", "conversations"))


def new_keys(conversations: DataFrame, known: DataFrame, sample: int = 20) -> DataFrame:
    """``(provider, keys)``: keys of each provider's first ``sample`` conversations ``(provider, pos, json)`` that ``known(provider, key)`` lacks."""
    nth = F.row_number().over(Window.partitionBy("provider").orderBy("pos"))
    keys = conversations.withColumn("nth", nth).where(F.col("nth") <= sample).select("provider", F.explode(F.json_object_keys("json")).alias("key")).distinct()
    return keys.join(known, ["provider", "key"], "left_anti").groupBy("provider").agg(F.array_sort(F.collect_set("key")).alias("keys"))


def manifest_categories(manifests: DataFrame, known: list[str] = CATEGORIES) -> DataFrame:
    """``(category, files, known)`` of the data files that manifests list."""
    rows = manifests.select(F.explode("data_files").alias("f"))
    return rows.groupBy("f.category").agg(F.count("*").alias("files")).withColumn("known", F.col("category").isin(known))


def fingerprint(name: Column, size: Column, is_dir: Column) -> Column:
    return F.concat_ws("|", name, F.when(is_dir, "dir"), size.cast("string"))


def pending_exports(files: DataFrame, registry: DataFrame, reprocess_all: bool = False) -> DataFrame:
    """Valid files that the registry lacks, oldest first."""
    valid = files.where("valid")
    return (valid if reprocess_all else valid.join(registry.select("fingerprint"), "fingerprint", "left_anti"))


def mark_processed(files: DataFrame, registry: DataFrame) -> DataFrame:
    """The registry ``(fingerprint, name, processed_at)`` with files added; the newest entry of a fingerprint wins."""
    both = registry.unionByName(files.select("fingerprint", "name", "processed_at"))
    return both.groupBy("fingerprint").agg(F.max(F.struct("processed_at", "name")).alias("r")).select("fingerprint", "r.name", "r.processed_at")


def intake_report(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Counts of valid, pending and done files and a light: err without a valid one, warn with an invalid or drifting one, else ok."""
    met = files.join(registry.select("fingerprint", F.lit(True).alias("done")).distinct(), "fingerprint", "left")
    out = met.agg(F.count("*").alias("files"), F.count_if("valid").alias("valid"), F.count_if(F.col("valid") & F.col("done").isNull()).alias("pending"), F.count_if(F.col("valid") & F.col("done")).alias("done"), F.bool_or("drift").alias("drift"))
    return out.withColumn("light", F.when(F.col("valid") == 0, "err").when((F.col("valid") < F.col("files")) | F.col("drift"), "warn").otherwise("ok"))


def detect_session(lines: DataFrame) -> DataFrame:
    """``(file, agent)`` by the first non-empty line of ``lines(file, line_no, line)``."""
    first = lines.where(F.col("line").rlike(r"\S")).groupBy("file").agg(F.min(F.struct("line_no", "line"))["line"].alias("line"))
    get = lambda p: F.get_json_object("line", p)
    agent = F.when(get("$.sessionId").isNotNull(), "claude-code").when((get("$.type") == "session_meta") & get("$.payload").isNotNull(), "codex")
    return first.select("file", agent.alias("agent"))


def latest_per_publication(files: DataFrame) -> DataFrame:
    """``files(name, mtime)`` named ``<slug>.zip``, ``<slug>-2.zip`` or ``<slug> (1).zip``: the newest of a slug is chosen, the rest are not."""
    slug = F.regexp_replace(F.lower("name"), r"(-\d+| \(\d+\))?\.zip$", "")
    nth = F.row_number().over(Window.partitionBy("slug").orderBy(F.desc("mtime"), "name"))
    return files.withColumn("slug", slug).withColumn("chosen", nth == 1)


def pick_stats(files: DataFrame, slugs: DataFrame) -> DataFrame:
    """``(slug, stats)``: the newest statistics file whose name starts with ``<slug>_``; a single publication takes any.

    A file is put down under what stands before each of its underscores, and slugs meet these by an equi-join.
    """
    best = F.max(F.struct("mtime", "name"))["name"]
    parts = F.split("name", "_", -1)
    heads = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "_"))
    under = files.where(F.contains("name", F.lit("_"))).select("name", "mtime", F.explode(heads).alias("slug"))
    newest = under.join(slugs.select("slug").distinct(), "slug", "left_semi").groupBy("slug").agg(best.alias("own"))
    own = slugs.select("slug").distinct().join(newest, "slug", "left")
    lone = F.broadcast(files.agg(best.alias("any")).crossJoin(slugs.agg((F.count("*") == 1).alias("lone"))))
    return own.crossJoin(lone).select("slug", F.coalesce("own", F.when(F.col("lone"), F.col("any"))).alias("stats"))


def infer_owner(ids: DataFrame, posts: DataFrame) -> DataFrame:
    """``(batch, slug)``: the publication of most ids, unless it has no more than twice the next or under half of them."""
    hits = ids.join(posts, "post_id").groupBy("batch", "slug").agg(F.countDistinct("post_id").alias("n"))
    order = Window.partitionBy("batch").orderBy(F.desc("n"), "slug")
    ranked = hits.withColumns({"nth": F.row_number().over(order), "second": F.coalesce(F.lead("n").over(order), F.lit(0))}).where("nth = 1")
    total = ids.groupBy("batch").agg(F.countDistinct("post_id").alias("total"))
    sure = (F.col("n") > 2 * F.col("second")) & (2 * F.col("n") >= F.col("total"))
    return total.join(ranked, "batch", "left").select("batch", F.when(sure, F.col("slug")).alias("slug"))


def is_stats_csv(columns: list[str]) -> bool:
    """Whether a CSV header is one of the two kinds of statistics files."""
    return {"title", "post_date"} <= set(columns) and bool({"views", "section_name"} & set(columns))
