"""Repair and reconciliation: diagnoses and plans that compare two snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convarchive.functions.text import has_nul, has_private_use, raw_json_lines

#: Drift flags and whether the note itself is enough to repair it (else an export is needed).
FLAGS = {"raw_json": "note", "nul_bytes": "export", "raw_citations": "export", "missing_image": "export", "no_model": "export", "no_conv_id": "export"}
NOTICE = r"\[missing image:([^\]]+)\]"
#: Characters of a file's name by which texts are searched for places where it could begin.
HEAD = 3
#: White space at both ends of a text, without vertical tabs; line separators of other kinds end no text.
EDGES = r"\A[\t\n\f\r ]+|[\t\n\f\r ]+\z"
LINK = r"(!?\[[^\]]*\]\()([^)]+)(\))"


def drift_flags(notes: DataFrame) -> DataFrame:
    body = F.col("body")
    return notes.withColumns(
        {
            "raw_json": raw_json_lines(body) > 0,
            "nul_bytes": has_nul(body),
            "raw_citations": has_private_use(body),
            "missing_image": body.rlike(NOTICE),
            "no_model": F.col("model").isNull(),
            "no_conv_id": F.col("conv_id").isNull(),
        }
    )


def diagnose(notes: DataFrame) -> DataFrame:
    """``(flag, repair_from, provider, notes)``: how many notes of a provider show each drift."""
    flags = F.array(*[F.struct(F.lit(k).alias("flag"), F.lit(w).alias("repair_from"), F.col(k).alias("on")) for k, w in FLAGS.items()])
    rows = drift_flags(notes).select("provider", F.explode(flags).alias("f")).where("f.on").select("provider", "f.flag", "f.repair_from")
    return rows.groupBy("flag", "repair_from", "provider").agg(F.count("*").alias("notes"))


def repair(notes: DataFrame) -> DataFrame:
    """Notes with raw JSON lines, re-rendered from themselves; notes whose title is JSON are left alone."""
    from convarchive.operators.blocks import block_text

    damaged = notes.where((raw_json_lines(F.col("body")) > 0) & ~F.startswith("title", F.lit("{")))
    kind = lambda x: F.get_json_object(x, "$.content_type")
    shown = F.transform(F.split("body", "\n"), lambda x: F.when(x.startswith("{") & kind(x).isNotNull(), block_text(F.lower(kind(x)), x)).otherwise(x))
    return damaged.withColumn("body", F.array_join(shown, "\n"))


def repair_plan(notes: DataFrame) -> DataFrame:
    """``(path, action, new_name, mtime)`` of ``notes(path, dir, base, name, body, mtime)``.

    Of notes with equal final text in a folder and base the plainly named one stays and inherits the newest
    time; its twins go to the trash; a kept one with a version suffix takes the base name if that is free. Of notes with
    the same name the first path comes first; notes without a name come last.
    """
    digest = F.sha1(F.regexp_replace("body", EDGES, ""))
    order = [(F.col("name") != F.col("base")).cast("int").asc_nulls_last(), F.asc_nulls_last("name"), F.asc_nulls_last("path")]
    twins = Window.partitionBy("dir", "base", "sha")
    marked = notes.withColumn("sha", digest).withColumns(
        {"nth": F.row_number().over(twins.orderBy(*order)), "newest": F.max("mtime").over(twins)}
    )
    kept = F.col("nth") == 1
    place = Window.partitionBy("dir", "base").orderBy((~kept).cast("int"), *order)
    first = F.row_number().over(place) == 1
    action = F.when(~kept, "trash").when(first & (F.col("name") != F.col("base")), "rename").otherwise("keep")
    return marked.withColumn("action", action).select("path", "action", F.when(F.col("action") == "rename", F.col("base")).otherwise(F.col("name")).alias("new_name"), F.when(kept, F.col("newest")).alias("mtime"))


def hand_edited(merged: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """``(path, edited)``: whether a merged note has lines that merging anew doesn't produce."""
    both = merged.select("path", F.split("body", "\n").alias("a")).join(rebuilt.select("path", F.split("body", "\n").alias("b")), "path", "left")
    return both.select("path", (F.size(F.array_except("a", F.coalesce("b", F.array().cast("array<string>")))) > 0).alias("edited"))


def sync_plan(actual: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """``(path, plan)`` from ``(path, sha, conv_id)`` of what is there, what the old rules make and what the new ones make.

    New paths are written; equal ones are done; what the old rules made is overwritten; what differs from
    it is protected. Paths the new rules don't make are orphans if their conversation lives on elsewhere
    and they are as the old rules made them, else unknown.
    """
    met = actual.select("path", F.col("sha").alias("a"), "conv_id").join(before.select("path", F.col("sha").alias("b")), "path", "full")
    met = met.join(after.select("path", F.col("sha").alias("c")), "path", "full")
    alive = after.select("conv_id", F.lit(True).alias("alive")).where("conv_id is not null").distinct()
    met = met.join(alive, "conv_id", "left")
    own = F.col("a").eqNullSafe(F.col("b"))
    plan = (
        F.when(F.col("a").isNull() & F.col("c").isNotNull(), "new")
        .when(F.col("a").isNull(), "gone")
        .when(F.col("c").isNull() & own & F.coalesce("alive", F.lit(False)), "orphan")
        .when(F.col("c").isNull(), "unknown")
        .when(F.col("a") == F.col("c"), "same")
        .when(own, "write")
        .otherwise("protected")
    )
    return met.select("path", plan.alias("plan"))


def view_sync(actual: DataFrame, expected: DataFrame, known: DataFrame) -> DataFrame:
    """``(path, state)`` of ``actual(path, sha, conv_id)`` that ``expected(path, conv_id)`` lacks: stale copies of known notes, else unknown."""
    extra = actual.join(expected.select("path"), "path", "left_anti")
    by_sha = known.select("sha", F.lit(True).alias("copy")).distinct()
    by_conv = expected.select("conv_id", F.lit(True).alias("moved")).where("conv_id is not null").distinct()
    met = extra.join(by_sha, "sha", "left").join(by_conv, "conv_id", "left")
    return met.select("path", F.when(F.col("copy") | F.col("moved"), "stale").otherwise("unknown").alias("state"))


def recover_images(notes: DataFrame, members: DataFrame) -> DataFrame:
    """``(pointer, notes, export, file)``: missing images and where the newest export of ``members(export, mtime, pointer, file)`` has them."""
    wanted = notes.select("note_id", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(NOTICE), 1))).alias("pointer"))
    per = wanted.groupBy("pointer").agg(F.count("*").alias("notes"))
    best = members.groupBy("pointer").agg(F.max(F.struct("mtime", "export", "file")).alias("m")).select("pointer", "m.export", "m.file")
    return per.join(best, "pointer", "left")


def recovery_report(notes: DataFrame, members: DataFrame) -> DataFrame:
    """One row of counts: ``images`` that notes miss and their ``marks``, ``notes`` with one; how many images and marks the exports' ``members(pointer, …)`` can bring
    back (``recoverable``, ``recoverable_marks``) and can't (``unrecoverable``), and ``notes_to_change``."""
    marks = notes.select("note_id", F.explode(F.regexp_extract_all("body", F.lit(NOTICE), 1)).alias("pointer"))
    there = members.select("pointer", F.lit(True).alias("there")).distinct()
    per = marks.groupBy("pointer", "note_id").agg(F.count("*").alias("n")).join(there, "pointer", "left").withColumn("there", F.coalesce("there", F.lit(False)))
    have = F.col("there")
    return per.agg(
        F.countDistinct("pointer").alias("images"), F.coalesce(F.sum("n"), F.lit(0)).alias("marks"), F.countDistinct("note_id").alias("notes"), F.countDistinct(F.when(have, F.col("pointer"))).alias("recoverable"),
        F.countDistinct(F.when(~have, F.col("pointer"))).alias("unrecoverable"), F.coalesce(F.sum(F.when(have, F.col("n"))), F.lit(0)).alias("recoverable_marks"), F.countDistinct(F.when(have, F.col("note_id"))).alias("notes_to_change"),
    )


def attach_library_to_notes(notes: DataFrame, library: DataFrame) -> DataFrame:
    """``(note_id, file)`` of library images whose conversation has a note that doesn't link them yet.

    The result is a row a pair. Texts are searched once a note, not once a pair: what a text has where a file of its conversation could
    begin (by its first ``HEAD`` characters), as long as the longest of these, is all that pairs look at.
    """
    library = library.where("file is not null").select("conv_id", "file")
    quoted = F.concat(F.lit(r"\Q"), F.replace(F.left("file", F.lit(HEAD)), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    # a row a conversation, with each head once
    heads = library.groupBy("conv_id").agg(F.collect_set(F.left("file", F.lit(HEAD))).alias("heads"), F.array_join(F.array_sort(F.collect_set(quoted)), "|").alias("any"), F.max(F.length("file")).alias("most"))
    asked = notes.where("body is not null").select("note_id", "conv_id", "body").join(heads, "conv_id")
    at = F.concat(F.lit("(?s)(?=((?:"), "any", F.lit(").{0,"), F.col("most").cast("string"), F.lit("}))"))
    there = F.when(F.exists("heads", lambda h: F.contains("body", h)), F.array_distinct(F.regexp_extract_all("body", at, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    met = asked.select("note_id", "conv_id", there.alias("there")).join(library, "conv_id")
    return met.where(~F.exists("there", lambda w: F.startswith(w, F.col("file")))).select("note_id", "file")


def complete_metadata(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Manifest rows with generator, model and edit flag filled in by content hash where they lack."""
    fields = ["generator", "model", "is_edit"]
    extra = found.groupBy("sha1").agg(*[F.max(c).alias(f"new_{c}") for c in fields])
    met = manifest.join(extra, "sha1", "left")
    return met.withColumns({c: F.coalesce(c, f"new_{c}") for c in fields}).drop(*[f"new_{c}" for c in fields])


def relink(notes: DataFrame, moves: DataFrame) -> DataFrame:
    """Notes with links to ``moves(old, new)`` rewritten, and ``rewritten``: how many; wiki links stay."""
    rows = notes.select("note_id", F.posexplode(F.regexp_extract_all("body", F.lit(LINK), 2)).alias("k", "old"))
    met = rows.join(moves, "old", "left")
    paths = F.transform(F.array_sort(F.collect_list(F.struct("k", F.coalesce("new", "old").alias("to")))), lambda x: x["to"])
    by_note = met.groupBy("note_id").agg(paths.alias("to"), F.count("new").alias("rewritten"))
    out = notes.join(by_note.where("rewritten > 0"), "note_id", "left")
    heads = F.regexp_extract_all("body", F.lit(LINK), 1)
    around = F.split("body", LINK, -1)
    links = F.zip_with(heads, "to", lambda h, t: F.concat(h, t, F.lit(")")))
    text = F.array_join(F.flatten(F.zip_with(around, links, lambda a, link: F.array(a, F.coalesce(link, F.lit(""))))), "")
    return out.withColumns({"body": F.when(F.col("to").isNull(), F.col("body")).otherwise(text), "rewritten": F.coalesce("rewritten", F.lit(0))}).drop("to")


#: What stands for an image in a note: a link or a notice.
IMAGE = rf"!\[[^\]]*\]\([^)]*\)|{NOTICE}"


def _lines(body: Column) -> Column:
    return F.array_distinct(F.split(body, "\n"))


def match_regenerated(notes: DataFrame, regenerated: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(note_id, outcome, best, shared)``: what becomes of each of ``notes(note_id, conv_id, title, date, body)`` that are to be made anew.

    Candidates are the ``regenerated(note_id, conv_id, body)`` texts of the note's conversation; a note without one is
    looked up in ``manifest(conv_id, title, date)`` by title and day, and takes those of all conversations it finds. A candidate must have the
    same skeleton, the text with its images masked. Of those the one wins that shares most lines with the note, the
    last id on a tie. ``outcome``: no export, no exact version, faithful (the best is the note itself), or regenerated.

    No texts are paired. A skeleton and its conversation are one key; lines without an image are the same wherever it
    is, so only lines with one are counted, by an inverted index: such a line's hash under that key.
    """
    day = lambda c: F.substring(F.coalesce(c.cast("string"), F.lit("")), 1, 10)
    whole = F.coalesce("body", F.lit(""))
    key = F.sha1(F.regexp_replace(whole, IMAGE, "#")).alias("skeleton")
    marked = F.filter(_lines(whole), lambda x: x.rlike(IMAGE))
    text = [key, F.sha1(whole).alias("text"), marked.alias("marked"), (F.size(_lines(whole)) - F.size(marked)).alias("plain")]
    own = notes.select("note_id", F.nullif("conv_id", F.lit("")).alias("conv_id"), F.coalesce("title", F.lit("")).alias("title"), day(F.col("date")).alias("day"), *text)
    listed = manifest.where("conv_id is not null").select(F.col("conv_id").alias("of"), F.coalesce("title", F.lit("")).alias("title"), day(F.col("date")).alias("day")).distinct()
    by_title = own.where("conv_id is null").join(listed, ["title", "day"]).withColumn("conv_id", F.col("of")).drop("of")
    fields = ["note_id", "conv_id", "skeleton", "text", "marked", "plain"]
    asked = own.where("conv_id is not null").select(*fields).unionByName(by_title.select(*fields))
    made = regenerated.where("conv_id is not null").select(F.col("note_id").alias("other"), "conv_id", *text)
    # equal texts of a conversation are one candidate
    once = made.groupBy("conv_id", "skeleton", "text").agg(F.max("other").alias("other"), F.first("marked").alias("marked"))
    index = once.select("conv_id", "skeleton", "text", "other", F.explode("marked").alias("line"))
    hits = asked.select("note_id", "conv_id", "skeleton", F.explode("marked").alias("line")).join(index, ["conv_id", "skeleton", "line"])
    scored = hits.groupBy("note_id", "other", F.col("text").alias("best_text")).agg(F.countDistinct("line").alias("n"))
    # one that shares none of these lines
    any_of = once.groupBy("conv_id", "skeleton").agg(F.max(F.struct("other", "text")).alias("b"))
    rest = asked.join(any_of, ["conv_id", "skeleton"]).select("note_id", F.col("b.other").alias("other"), F.col("b.text").alias("best_text"), F.lit(0).cast("long").alias("n"))
    best = scored.unionByName(rest).groupBy("note_id").agg(F.max(F.struct("n", "other", "best_text")).alias("m"))
    known = asked.join(made.select("conv_id").distinct(), "conv_id", "left_semi").select("note_id", F.lit(True).alias("known")).distinct()
    met = own.select("note_id", "text", "plain").join(known, "note_id", "left").join(best, "note_id", "left")
    outcome = F.when(F.col("known").isNull(), "no export").when(F.col("m").isNull(), "no exact version").when(F.col("m.best_text") == F.col("text"), "faithful").otherwise("regenerated")
    return met.select("note_id", outcome.alias("outcome"), F.col("m.other").alias("best"), (F.col("plain") + F.col("m.n")).alias("shared"))


def regeneration_report(matched: DataFrame) -> DataFrame:
    """``(outcome, notes)``: how many notes came to what."""
    return matched.groupBy("outcome").agg(F.count("*").alias("notes"))


def verify_copy(source: DataFrame, target: DataFrame, tolerance: int = 2) -> DataFrame:
    """``(path, problem)`` of files ``(path, bytes, sha1, mtime)`` that a copy lacks or has different."""
    a = source.select("path", *[F.col(c).alias(f"a_{c}") for c in ("bytes", "sha1", "mtime")])
    b = target.select("path", *[F.col(c).alias(f"b_{c}") for c in ("bytes", "sha1", "mtime")])
    problem = (
        F.when(F.col("b_sha1").isNull(), "missing").when(F.col("a_sha1").isNull(), "extra").when(F.col("a_bytes") != F.col("b_bytes"), "size")
        .when(F.col("a_sha1") != F.col("b_sha1"), "content").when(F.abs(F.col("a_mtime") - F.col("b_mtime")) > tolerance, "time")
    )
    return a.join(b, "path", "full").select("path", problem.alias("problem")).where("problem is not null")
