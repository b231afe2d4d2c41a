"""Queries of indexes and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from convarchive.operators import indexes as x
from convarchive.operators import projects as p
from convarchive.plans import derived as v
from convarchive.plans import projects as pp
from convarchive.plans.registry import query


@query("G1_tree_counts", v.with_sql(v.DOC_NOTES, pp.VIEW, "SELECT lower(project) AS project, year, month, count(*) AS notes FROM pv GROUP BY ROLLUP (lower(project), year, month)"))
def tree_counts(spark, d):
    return x.tree_counts(v.notes(spark, d))


TREE = "tr AS (SELECT *, row_number() OVER (PARTITION BY lower(project), year, month ORDER BY date NULLS FIRST, lower(title), note_id) AS nth, count(*) OVER (PARTITION BY lower(project), year, month) AS n FROM pv)"


@query("G1_tree_index", v.with_sql(v.DOC_NOTES, pp.VIEW, TREE, "SELECT project, year, month, nth::INT AS nth, note_id, 0 AS more FROM tr"))
def tree_index(spark, d):
    return x.tree_index(v.notes(spark, d))


@query("G2_tree_index_limited", v.with_sql(v.DOC_NOTES, pp.VIEW, TREE, "SELECT project, year, month, nth::INT AS nth, note_id, greatest(0, n - 2) AS more FROM tr WHERE nth <= 2"))
def tree_index_limited(spark, d):
    return x.tree_index(v.notes(spark, d), 2)


def with_attachments(spark, d):
    line = lambda head, n: F.concat(F.lit(f"\n{head}: **f"), (F.col("doc_id") % n).cast("string"), F.lit(".pdf** more"))
    body = F.concat("body", line("📎 Archivo adjunto", 40), line("📄 Archivo cargado", 30), line("📎  Archivo  adjunto", 40))
    return v.notes(spark, d).withColumn("body", body)


@query(
    "G3_attachment_index",
    v.with_sql(v.DOC_NOTES, "a AS (SELECT note_id, 'f' || (doc_id % 40) || '.pdf' AS name FROM nt UNION SELECT note_id, 'f' || (doc_id % 30) || '.pdf' FROM nt)", "SELECT name, count(*) AS n, string_agg(note_id, ',' ORDER BY note_id) AS notes FROM a GROUP BY name"),
)
def attachment_index(spark, d):
    return x.attachment_index(with_attachments(spark, d)).withColumn("notes", F.array_join("notes", ","))


def linked(spark, d):
    one = F.concat(F.lit("\n![]("), F.lit("bank/img/p-"), (F.col("doc_id") % 20).cast("string"), F.lit("_x.png)"))
    two = F.concat(F.lit(" [see it](bank/q"), (F.col("doc_id") % 15).cast("string"), F.lit(".png) ![no](other/z.png)"), one)
    return v.notes(spark, d).withColumn("body", F.concat("body", one, two))


ENTRIES = """en AS (
  SELECT note_id, 0 AS pos, 'p-' || (doc_id % 20) || '_x.png' AS file, true AS embed, 'p ' || (doc_id % 20) || ' x' AS title, CASE WHEN doc_id % 20 < 5 THEN 'prompt' END AS caption FROM nt
  UNION ALL SELECT note_id, 1, 'q' || (doc_id % 15) || '.png', false, 'see it', NULL FROM nt)"""


def entries(spark, d):
    doc = v.table(spark, d, "documents").select((F.col("doc_id") % 20).alias("k")).distinct().where("k < 5")
    manifest = doc.select(F.concat(F.lit("p-"), F.col("k").cast("string"), F.lit("_x.png")).alias("file"), F.lit("prompt").alias("prompt"))
    return x.bank_entries(linked(spark, d), manifest, "bank")


@query("G4_bank_entries", v.with_sql(v.DOC_NOTES, ENTRIES, "SELECT * FROM en"))
def bank_entries(spark, d):
    return entries(spark, d)


@query("G5_bank_catalog", "SELECT 'f' || s_suppkey AS file, s_nationkey AS created FROM supplier WHERE s_suppkey % 3 = 0")
def bank_catalog(spark, d):
    s = v.table(spark, d, "supplier").select(F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("file"), F.col("s_nationkey").alias("created"), "s_suppkey")
    return x.bank_catalog(s.drop("s_suppkey"), s.where("s_suppkey % 3 = 0"))


@query("G6_provider_index", v.with_sql(v.DOC_NOTES, ENTRIES, "SELECT substr(file, 1, 1) AS bank, count(*) AS items, count(DISTINCT note_id) AS conversations FROM en GROUP BY 1"))
def provider_index(spark, d):
    return x.provider_index(entries(spark, d).withColumn("bank", F.substring("file", 1, 1)))


@query("G7_pending_list", "SELECT page_id AS ref, url AS created, substr(html, 1, 70) AS prompt FROM pages WHERE page_id % 3 < 2")
def pending_list(spark, d):
    state = F.when(F.col("page_id") % 3 == 0, "sin_triar").when(F.col("page_id") % 3 == 2, "descartada")
    return x.pending_list(v.table(spark, d, "pages").select(F.col("page_id").alias("ref"), F.col("url").alias("created"), F.col("html").alias("prompt"), state.alias("state")))


STATS = """st AS (SELECT coalesce(strftime(date, '%Y-%m'), 'no date') AS month, coalesce(provider, 'chatgpt') AS provider, coalesce(project, 'none') AS project, bytes, date FROM nt)"""


@query(
    "G8_vault_stats",
    v.with_sql(
        v.DOC_NOTES, STATS,
        "SELECT CASE WHEN grouping(month) = 0 THEN 'month' WHEN grouping(provider) = 0 THEN 'provider' WHEN grouping(project) = 0 THEN 'project' ELSE 'all' END AS dimension, coalesce(month, provider, project, '') AS value, "
        "count(*) AS notes, sum(bytes)::BIGINT AS bytes, min(date)::VARCHAR AS first, max(date)::VARCHAR AS last FROM st GROUP BY GROUPING SETS ((), (month), (provider), (project))",
    ),
)
def vault_stats(spark, d):
    return x.vault_stats(v.notes(spark, d)).withColumns({"first": F.col("first").cast("string"), "last": F.col("last").cast("string")})


@query("G9_asset_stats", "SELECT lang AS provider, source AS bank, count(*) AS files, sum(n_chars)::BIGINT AS bytes FROM documents WHERE doc_id % 6 <> 0 GROUP BY ROLLUP (lang, source)")
def asset_stats(spark, d):
    file = F.concat(F.when(F.col("doc_id") % 6 == 0, "_").otherwise("f"), F.col("doc_id").cast("string"))
    return x.asset_stats(v.table(spark, d, "documents").select(F.col("lang").alias("provider"), F.col("source").alias("bank"), file.alias("file"), F.col("n_chars").alias("bytes")))


@query("G10_last_import", "SELECT event_type AS provider, strftime(max(ts), '%Y-%m-%d') AS last, greatest(0, date_diff('day', max(ts)::DATE, DATE '2024-01-25'))::INT AS days FROM events GROUP BY 1")
def last_import(spark, d):
    log = v.table(spark, d, "events").select(F.col("event_type").alias("provider"), "ts")
    return x.last_import(log, F.lit("2024-01-25").cast("date")).withColumn("last", F.date_format("last", "yyyy-MM-dd"))


def tagged(spark, d):
    return v.table(spark, d, "documents").select(F.col("doc_id").alias("conv_id"), F.lit("t").alias("title"), F.col("n_chars").alias("date"), F.array("source", "lang").alias("tags"))


@query("G11_conv_index", "SELECT doc_id AS conv_id, 't' AS title, n_chars AS date, least(source, lang) || ', ' || greatest(source, lang) AS tags FROM documents")
def conv_index(spark, d):
    return x.conv_index(tagged(spark, d))


@query("G11_tag_index", "SELECT tag, count(*) AS n, count(DISTINCT doc_id) AS conversations FROM (SELECT doc_id, lang AS tag FROM documents UNION ALL SELECT doc_id, source FROM documents) GROUP BY 1")
def tag_index(spark, d):
    return x.tag_index(tagged(spark, d)).withColumn("conversations", F.size("conversations").cast("long"))


@query("G12_import_records", r"SELECT conv_id, count(*) AS messages, sum(len(regexp_extract_all(text, '[\p{L}\p{N}_]+')))::BIGINT AS words FROM conversations GROUP BY 1")
def import_records(spark, d):
    c = v.table(spark, d, "conversations")
    return x.import_records(c.select("conv_id").distinct(), c.withColumnRenamed("text", "content"))


@query(
    "G13_dashboard",
    "SELECT 'chat' AS source, 'notes' AS metric, count(*)::DOUBLE AS value FROM documents UNION ALL SELECT 'chat', 'bytes', sum(n_chars) FROM documents UNION ALL SELECT 'music', 'clips', count(*) FROM part",
)
def dashboard(spark, d):
    chat = v.table(spark, d, "documents").agg(F.count("*").alias("notes"), F.sum("n_chars").alias("bytes"))
    music = v.table(spark, d, "part").agg(F.count("*").alias("clips"), F.max(F.lit(None).cast("double")).alias("liked"))
    return x.dashboard(chat=chat, music=music, posts=None)


@query("G14_unnamed_count", v.with_sql(pp.CONVS, "SELECT count(DISTINCT project_id) AS unnamed FROM pn WHERE project_id IS NOT NULL AND project = 'none'"))
def unnamed_count(spark, d):
    return x.unnamed_count(p.project_name(pp.convs(spark, d), pp.names(spark, d)))
