"""Queries of projects, tags and partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from convarchive.operators import projects as p
from convarchive.plans import derived as v
from convarchive.plans.registry import query

CONVS = """cv AS (SELECT doc_id AS conv_id, 't' || (doc_id % 9) AS title, n_chars % 5 AS date,
  CASE WHEN doc_id % 3 = 0 THEN 'g-' || md5(source) END AS gizmo_id, CASE WHEN doc_id % 2 = 0 THEN 'g-p-' || md5(lang) ELSE 'x-' || lang END AS template_id FROM documents),
pi AS (SELECT *, coalesce(gizmo_id, CASE WHEN starts_with(template_id, 'g-p-') THEN template_id END) AS project_id FROM cv),
nm AS (SELECT md5(source) AS id, source AS name FROM documents WHERE source < 'src15' GROUP BY source),
pn AS (SELECT pi.*, coalesce(name, 'none') AS project FROM pi LEFT JOIN nm ON nm.id = regexp_extract(project_id, '^(?:g-(?:p-)?)?([0-9a-f]{32})', 1))"""


def convs(spark, d):
    doc = F.col("doc_id")
    c = v.table(spark, d, "documents").select(
        doc.alias("conv_id"), F.concat(F.lit("t"), (doc % 9).cast("string")).alias("title"), (F.col("n_chars") % 5).alias("date"),
        F.when(doc % 3 == 0, F.concat(F.lit("g-"), F.md5("source"))).alias("gizmo_id"), F.concat(F.when(doc % 2 == 0, F.concat(F.lit("g-p-"), F.md5("lang"))).otherwise(F.concat(F.lit("x-"), F.col("lang")))).alias("template_id"),
    )
    return c.withColumn("project_id", p.project_id(F.col("gizmo_id"), F.col("template_id")))


def names(spark, d):
    return v.table(spark, d, "documents").where("source < 'src15'").groupBy("source").agg(F.count("*")).select(F.md5("source").alias("id"), F.col("source").alias("name"))


def ledger(spark, d):
    c = convs(spark, d).where("conv_id % 2 = 0 and project_id is not null")
    return c.groupBy("project_id").agg(F.collect_set(F.struct(F.lit("old").alias("title"), F.lit(0).cast("long").alias("date"))).alias("chats"))


@query("F1_project_id", v.with_sql(CONVS, "SELECT conv_id, project_id FROM pi"))
def project_id(spark, d):
    return convs(spark, d).select("conv_id", "project_id")


@query("F2_project_name", v.with_sql(CONVS, "SELECT conv_id, project FROM pn"))
def project_name(spark, d):
    return p.project_name(convs(spark, d), names(spark, d)).select("conv_id", "project")


LEDGER = """un AS (SELECT project_id, title, date FROM pn WHERE project_id IS NOT NULL AND project = 'none' UNION SELECT project_id, 'old', 0 FROM pi WHERE conv_id % 2 = 0 AND project_id IS NOT NULL)"""


@query("F3_unnamed_projects", v.with_sql(CONVS, LEDGER, "SELECT project_id, count(*)::INT AS n, string_agg(title || ':' || date, ',' ORDER BY date, title) AS chats FROM un GROUP BY 1"))
def unnamed_projects(spark, d):
    out = p.unnamed_projects(p.project_name(convs(spark, d), names(spark, d)), ledger(spark, d))
    return out.select("project_id", "n", F.array_join(F.transform("chats", lambda c: F.concat(c["title"], F.lit(":"), c["date"].cast("string"))), ",").alias("chats"))


@query("F4_relabel_projects", v.with_sql(CONVS, "SELECT conv_id, 'old' AS old_project, project FROM pn WHERE project <> 'none'"))
def relabel_projects(spark, d):
    notes = convs(spark, d).withColumn("project", F.lit("old"))
    return p.relabel_projects(notes, names(spark, d), ledger(spark, d))[0].select("conv_id", "old_project", "project")


@query("F4_relabel_ledger", v.with_sql(CONVS, "SELECT DISTINCT project_id FROM pn WHERE conv_id % 2 = 0 AND project_id IS NOT NULL AND project = 'none'"))
def relabel_ledger(spark, d):
    return p.relabel_projects(convs(spark, d).withColumn("project", F.lit("old")), names(spark, d), ledger(spark, d))[1].select("project_id")


VIEW = """pv AS (SELECT note_id, coalesce(nullif(trim(project), ''), 'none') AS project, coalesce(strftime(date, '%Y'), '0000') AS year, coalesce(strftime(date, '%m'), '00') AS month, title, date FROM nt)"""


@query("F5_project_view", v.with_sql(v.DOC_NOTES, VIEW, "SELECT project, year, month, note_id FROM pv"))
def project_view(spark, d):
    return p.project_view(v.notes(spark, d))


@query("F6_keyword_tags", v.with_sql(v.DOC_NOTES, "SELECT DISTINCT note_id, tag FROM nt, (VALUES ('Thing', 'a'), ('und die', 'b'), ('note 1', 'c')) AS k(keyword, tag) WHERE contains(lower(title || chr(10) || body), lower(keyword))"))
def keyword_tags(spark, d):
    return p.keyword_tags(v.notes(spark, d), spark.createDataFrame([("Thing", "a"), ("und die", "b"), ("note 1", "c")], "keyword string, tag string"))


@query(
    "F7_front_matter",
    v.with_sql(v.DOC_NOTES, "SELECT note_id, coalesce(project, 'none') AS project, CASE WHEN coalesce(project, 'none') <> 'none' THEN '#project/' || project END AS project_tag, strftime(date, '%Y-%m-%d') AS created, strftime(date, '%Y-%m-%d') AS updated FROM nt"),
)
def front_matter(spark, d):
    return p.front_matter(v.notes(spark, d).withColumn("updated", F.lit(None).cast("date")))


@query("F8_provider_folder", v.with_sql(v.DOC_NOTES, "SELECT CASE coalesce(provider, 'chatgpt') WHEN 'chatgpt' THEN 'ChatGPT' WHEN 'claude' THEN 'Claude' ELSE 'Grok' END AS provider_folder, count(*) AS n FROM nt GROUP BY 1"))
def provider_folder(spark, d):
    return v.notes(spark, d).groupBy(p.provider_folder(F.upper("provider")).alias("provider_folder")).agg(F.count("*").alias("n"))


@query("F9_only_ids", "SELECT conv_id, turn FROM conversations WHERE conv_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def only_ids(spark, d):
    ids = v.table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("conv_id"))
    return p.only_ids(v.table(spark, d, "conversations"), ids).select("conv_id", "turn")
