"""Projects, tags and partitioning of notes and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convarchive.functions.text import slugify, strip_space
from convarchive.operators.topics import holding

#: Provider -> folder.
FOLDERS = {"chatgpt": "ChatGPT", "claude": "Claude", "grok": "Grok", "copilot": "Copilot"}


def project_id(gizmo_id: Column, template_id: Column) -> Column:
    return F.coalesce(F.nullif(gizmo_id, F.lit("")), F.when(template_id.startswith("g-p-"), template_id))


def normal_id(c: Column) -> Column:
    """The 32 hexadecimal digits of an id written ``g-…``, ``g-p-…`` or bare."""
    return F.nullif(F.regexp_extract(c, r"^(?:g-(?:p-)?)?([0-9a-f]{32})", 1), F.lit(""))


def project_name(convs: DataFrame, names: DataFrame) -> DataFrame:
    """``convs(…, project_id)`` with ``project``: its name in ``names(id, name)``, else ``none``."""
    known = names.select(normal_id(F.col("id")).alias("__id"), "name").where("__id is not null").groupBy("__id").agg(F.min("name").alias("name"))
    out = convs.withColumn("__id", normal_id(F.col("project_id"))).join(known, "__id", "left")
    return out.withColumn("project", F.coalesce("name", F.lit("none"))).drop("__id", "name")


def unnamed_projects(convs: DataFrame, ledger: DataFrame) -> DataFrame:
    """The ledger ``(project_id, chats, n)`` with the distinct ``(title, date)`` of this run's unnamed projects added."""
    now = convs.where("project_id is not null and project = 'none'").select("project_id", "title", "date")
    before = ledger.select("project_id", F.explode("chats").alias("c")).select("project_id", "c.title", "c.date")
    chats = F.array_sort(F.collect_list(F.struct("date", "title")))
    seen = now.unionByName(before).dropDuplicates().groupBy("project_id").agg(chats.alias("c"))
    return seen.select("project_id", F.transform("c", lambda x: F.struct(x["title"].alias("title"), x["date"].alias("date"))).alias("chats"), F.size("c").alias("n"))


def relabel_projects(notes: DataFrame, names: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notes whose project name changed under ``names``, and the ledger without the ids that have a name now."""
    renamed = project_name(notes.withColumnRenamed("project", "old_project"), names)
    changed = renamed.where(~F.col("project").eqNullSafe(F.col("old_project")) & (F.col("project") != "none"))
    known = names.select(normal_id(F.col("id")).alias("__id")).distinct()
    return changed, ledger.withColumn("__id", normal_id(F.col("project_id"))).join(known, "__id", "left_anti").drop("__id")


def project_view(notes: DataFrame) -> DataFrame:
    """``(project, year, month, note_id)``: notes by project and month, ``0000/00`` without a date."""
    return notes.select(
        F.coalesce(F.nullif(strip_space(F.col("project")), F.lit("")), F.lit("none")).alias("project"),
        F.coalesce(F.date_format("date", "yyyy"), F.lit("0000")).alias("year"),
        F.coalesce(F.date_format("date", "MM"), F.lit("00")).alias("month"),
        "note_id",
    )


def keyword_tags(notes: DataFrame, tags: DataFrame) -> DataFrame:
    """``(note_id, tag)`` for each ``tags(keyword, tag)`` whose keyword is in the lower-cased title or text; an empty keyword is in none."""
    text = notes.select("note_id", F.lower(F.concat_ws("\n", "title", "body")).alias("text"))
    asked = tags.select(F.lower("keyword").alias("phrase"), "tag")
    return holding(text, asked, "note_id").join(asked, "phrase").select("note_id", "tag").distinct()


def front_matter(notes: DataFrame, forced_project: str | None = None) -> DataFrame:
    """A note's front matter as columns: project (or the forced one), its tag and both dates."""
    project = F.lit(forced_project) if forced_project else F.coalesce("project", F.lit("none"))
    tag = F.when(project != "none", F.concat(F.lit("#project/"), slugify(project)))
    return notes.select("note_id", project.alias("project"), tag.alias("project_tag"), F.date_format("date", "yyyy-MM-dd").alias("created"), F.date_format(F.coalesce("updated", "date"), "yyyy-MM-dd").alias("updated"))


def provider_folder(provider: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in FOLDERS.items() for x in pair])
    low = F.coalesce(F.nullif(F.lower(strip_space(provider)), F.lit("")), F.lit("chatgpt"))
    return F.coalesce(known[low], F.initcap(low))


def only_ids(convs: DataFrame, ids: DataFrame) -> DataFrame:
    return convs.join(ids.select("conv_id"), "conv_id", "left_semi")
