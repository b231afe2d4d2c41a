"""Identity, versioning and lossless merge of conversation versions.

``notes(note_id, group_key, path, title, base_name, source, mtime, …)`` are versions; ``messages(note_id,
pos, role, content)`` their messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convarchive.functions.text import collapse_space, slugify, strip_space, word_count
from convarchive.sources.shared import new_folder


def fingerprint(role: Column, content: Column) -> Column:
    return F.sha1(F.concat(F.lower(role), F.lit("::"), collapse_space(content)))


def note_key(notes: DataFrame) -> DataFrame:
    """Adds ``content_hash`` (8 hex digits) and ``note_name``: date, slug and, where the slug is taken, the hash."""
    short = F.substring(F.sha1(strip_space(F.col("body"))), 1, 8)
    base = F.concat_ws("_", "date", slugify(F.col("title")))
    named = notes.withColumns({"content_hash": short, "base": base})
    # the first note keeps the name; a name of any number of notes is one row here
    first = named.groupBy("base").agg(F.min("note_id").alias("__first"))
    met = named.join(first, "base")
    name = F.when(F.col("note_id") > F.col("__first"), F.concat(F.col("base"), F.lit("-h"), F.col("content_hash"))).otherwise(F.col("base"))
    return met.select(*notes.columns, "content_hash", "base", name.alias("note_name"))


def append_versions(new: DataFrame, existing: DataFrame, scheme: str = "hash") -> DataFrame:
    """Rows of ``new(base, body)`` whose base name and trimmed content are not in ``existing``, with ``version_name``.

    The first version of a base keeps its name; later ones get a suffix of their hash, a counter, or (``time``) the
    ``created`` time of their first row. ``existing`` may have ``body_hash`` instead of ``body``.
    """
    body_hash = F.sha1(strip_space(F.col("body")))
    seen = existing.select("base", "body_hash" if "body_hash" in existing.columns else body_hash.alias("body_hash"))
    fresh = new.withColumn("body_hash", body_hash).join(seen, ["base", "body_hash"], "left_anti")
    more = [F.min_by("created", "note_id").alias("created")] if "created" in new.columns else []
    fresh = fresh.groupBy("base", "body_hash").agg(F.min("note_id").alias("note_id"), F.min_by("body", "note_id").alias("body"), *more)
    known = existing.groupBy("base").agg(F.count("*").alias("known"))
    if scheme == "counter":
        nth = F.row_number().over(Window.partitionBy("base").orderBy("note_id")) + F.coalesce("known", F.lit(0))
        named = fresh.join(known, "base", "left").withColumn("nth", nth)
    else:
        # only the first of a base matters: one small row a base, so that a base's texts need not meet in one task
        first = fresh.groupBy("base").agg(F.min(F.struct("note_id", "body_hash")).alias("first"))
        is_first = F.struct("note_id", "body_hash").eqNullSafe(F.col("first")) & F.col("known").isNull()
        named = fresh.join(known.join(first, "base", "right"), "base", "left").withColumn("nth", F.when(is_first, 1).otherwise(2)).drop("first")
    suffix = F.concat(F.lit("-h"), F.substring("body_hash", 1, 8)) if scheme == "hash" else F.concat(F.lit("-"), F.col("nth").cast("string"))
    if scheme == "time":
        stamp = F.coalesce(F.date_format("created", "yyyyMMdd-HHmmss"), F.concat(F.lit("h"), F.substring("body_hash", 1, 8)))
        again = F.row_number().over(Window.partitionBy("base", stamp).orderBy("note_id"))
        suffix = F.concat(F.lit("_"), stamp, F.when(again > 1, F.concat(F.lit("-"), again.cast("string"))).otherwise(""))
    if scheme == "hash":
        twin = F.row_number().over(Window.partitionBy("base", F.substring("body_hash", 1, 8)).orderBy("body_hash"))
        suffix = F.concat(suffix, F.when(twin > 1, F.concat(F.lit("-"), twin.cast("string"))).otherwise(""))
    return named.withColumn("version_name", F.concat(F.col("base"), F.when(F.col("nth") == 1, "").otherwise(suffix))).drop("known", "nth")


def group_key(conv_id: Column, file_name: Column) -> Column:
    """``id:<conv_id>`` when there is one, else the file name without its version suffix."""
    bare = F.regexp_replace(file_name, r"(-h[0-9a-f]{8}|-v?\d+)$", "")
    return F.coalesce(F.concat(F.lit("id:"), F.nullif(conv_id, F.lit(""))), bare)


def ranked_variants(notes: DataFrame, messages: DataFrame) -> DataFrame:
    """``notes`` with ``words``, ``bytes`` and ``rank``: most words, then most bytes, then path; rank 1 is the champion."""
    size = messages.groupBy("note_id").agg(F.sum(word_count(F.col("content"))).alias("words"), F.sum(F.length("content")).alias("bytes"))
    order = Window.partitionBy("group_key").orderBy(F.desc("words"), F.desc("bytes"), "path")
    sized = notes.join(size, "note_id", "left").fillna(0, ["words", "bytes"])
    return sized.withColumn("rank", F.row_number().over(order))


def merge_variants(notes: DataFrame, messages: DataFrame, ranked: DataFrame | None = None) -> DataFrame:
    """``(group_key, pos, role, content, recovered)``: all champion messages in order, then what only others have.

    The champion's own repeated messages stay. Messages of other variants follow by variant rank and
    position, the first of each fingerprint that the champion lacks. ``ranked`` is what ``ranked_variants`` gave, if it is there.
    """
    ranked = ranked_variants(notes, messages) if ranked is None else ranked
    placed = messages.join(ranked.select("note_id", "group_key", "rank"), "note_id").withColumn("fp", fingerprint(F.col("role"), F.col("content")))
    champion = placed.where("rank = 1").withColumn("recovered", F.lit(False))
    others = placed.where("rank > 1").join(champion.select("group_key", "fp"), ["group_key", "fp"], "left_anti")
    first = F.row_number().over(Window.partitionBy("group_key", "fp").orderBy("rank", "pos"))
    recovered = others.withColumn("nth", first).where("nth = 1").drop("nth").withColumn("recovered", F.lit(True))
    dense = F.row_number().over(Window.partitionBy("group_key").orderBy("recovered", "rank", "pos"))
    return champion.unionByName(recovered).select("group_key", dense.alias("pos"), "role", "content", "recovered")


def merged_conversations(notes: DataFrame, messages: DataFrame) -> DataFrame:
    """One row a group: title, source tag, message and recovered counts, and a digest of the merged text.

    Variants are ranked once, and written with their names to the shared checkpoint folder: a row a note.
    """
    path = f"{new_folder(notes.sparkSession)}/ranked"
    ranked_variants(notes.select("note_id", "group_key", "source", "mtime", "path", "title", "base_name"), messages).write.parquet(path)
    ranked = notes.sparkSession.read.parquet(path)
    merged = merge_variants(notes, messages, ranked)
    line = F.struct("pos", F.concat_ws("\x1f", F.lower("role"), "content").alias("line"))
    digest = F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\x1e"))
    text = merged.groupBy("group_key").agg(F.count("*").alias("messages"), F.count_if("recovered").alias("recovered"), digest.alias("digest"))
    out = resolve_titles(ranked).join(text, "group_key", "left")
    champion = ranked.where("rank = 1").select("group_key", "source")
    return out.join(champion, "group_key").withColumn("source", source_tag(F.col("source"), F.col("recovered")))


def resolve_titles(notes: DataFrame) -> DataFrame:
    """The newest variant's title and base name win; the oldest title stays as ``original_title`` where it differs."""
    newest, oldest = F.struct("mtime", "path", "title", "base_name"), F.struct("mtime", "path", "title")
    both = notes.groupBy("group_key").agg(F.max(newest).alias("new"), F.min(oldest).alias("old"), F.count("*").alias("variants"))
    original = F.when(F.col("old.title") != F.col("new.title"), F.col("old.title"))
    return both.select("group_key", F.col("new.title").alias("title"), F.col("new.base_name").alias("base_name"), original.alias("original_title"), "variants")


def disambiguate(groups: DataFrame) -> DataFrame:
    """``(group_key, dest)`` with ``output``: where several groups claim a destination, all get a suffix of their key's hash."""
    shared = groups.groupBy("dest").agg((F.count("*") > 1).alias("__shared"))
    tagged = F.concat(F.col("dest"), F.lit(" · "), F.substring(F.sha1("group_key"), 1, 6))
    met = groups.join(shared, groups["dest"].eqNullSafe(shared["dest"])).drop(shared["dest"])
    return met.select(*groups.columns, F.when(F.col("__shared"), tagged).otherwise(F.col("dest")).alias("output"))


def source_tag(source: Column, recovered: Column) -> Column:
    bare = F.regexp_replace(source, r"(_merged|_reverse)+$", "")
    return F.when(recovered > 0, F.concat(bare, F.lit("_merged"))).otherwise(bare)


def apply_pointer_links(messages: DataFrame, links: DataFrame) -> DataFrame:
    """Notices ``[missing image:<pointer>]`` become the link of ``links(pointer, link)`` where there is one."""
    notice = r"\[missing image:([^\]]+)\]"
    found = messages.select("note_id", "pos", F.posexplode(F.regexp_extract_all("content", F.lit(notice), 1)).alias("k", "pointer"))
    met = found.join(links, "pointer", "left")
    shown = F.coalesce("link", F.concat(F.lit("[missing image:"), F.col("pointer"), F.lit("]")))
    by_message = met.groupBy("note_id", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", shown.alias("shown")))), lambda x: x["shown"]).alias("shown"))
    around = F.split("content", notice, -1)
    rebuilt = F.array_join(F.flatten(F.zip_with(around, F.col("shown"), lambda a, s: F.array(a, F.coalesce(s, F.lit(""))))), "")
    out = messages.join(by_message, ["note_id", "pos"], "left")
    return out.withColumn("content", F.when(F.col("shown").isNull(), F.col("content")).otherwise(rebuilt)).drop("shown")


def merge_stats(notes: DataFrame, messages: DataFrame) -> DataFrame:
    return merged_conversations(notes, messages).agg(
        F.count("*").alias("groups"),
        F.sum("variants").alias("variants"),
        F.sum("messages").alias("messages"),
        F.sum("recovered").alias("recovered"),
        F.count("original_title").alias("renamed"),
    )


def merge_links(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(pointer, link)``: new over old."""
    both = old.withColumnRenamed("link", "old_link").join(new.withColumnRenamed("link", "new_link"), "pointer", "full")
    return both.select("pointer", F.coalesce("new_link", "old_link").alias("link"))


def dedupe_assets(assets: DataFrame) -> DataFrame:
    """One row a content hash: the first by bank order, then path."""
    first = F.row_number().over(Window.partitionBy("sha1").orderBy("bank_order", "path"))
    return assets.withColumn("nth", first).where("nth = 1").drop("nth")


def session_manifest(headers: DataFrame, turns: DataFrame, sources: DataFrame) -> DataFrame:
    """``(name, session_id, title, cwd, branch, turns, path)``: what each kept source of a session holds.

    ``headers(session_id, title, cwd, branch)``, ``turns(session_id, …)`` and ``sources(session_id, name, path)``. A session
    without turns was not taken in and has no entry; a source that was kept before keeps one entry, that of its last path.
    """
    counted = turns.groupBy("session_id").agg(F.count("*").alias("turns"))
    once = sources.groupBy("name").agg(F.max(F.struct("path", "session_id")).alias("s")).select("name", "s.path", "s.session_id")
    met = once.join(counted, "session_id").join(headers.select("session_id", "title", "cwd", "branch"), "session_id", "left")
    return met.select("name", "session_id", "title", "cwd", "branch", "turns", "path")


def preserve_sources(files: DataFrame, kept: DataFrame) -> DataFrame:
    """New ``files(path, content)`` under the first 16 digits of their sha1, with content and size; what ``kept(name)`` has is not written again."""
    named = files.withColumn("name", F.substring(F.sha1("content"), 1, 16)).join(kept.select("name"), "name", "left_anti")
    once = named.groupBy("name").agg(F.min("path").alias("path"), F.count("*").alias("copies"), F.first("content").alias("content"))
    return once.withColumn("bytes", F.octet_length("content").cast("long"))
