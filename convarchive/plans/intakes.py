"""Queries of intake: detection, classification, drift and registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from convarchive.operators import intake as b
from convarchive.plans import derived as v
from convarchive.plans.registry import query

KEY = "doc_id"


def doc():
    return F.col("doc_id")


def text_of(*cases):
    """The doc_id-th of some texts, in turn."""
    return F.get(F.array(*map(F.lit, cases)), (doc() % len(cases)).cast("int"))


@query("B1_detect_provider", "SELECT doc_id, ['claude', 'grok', 'copilot', 'chatgpt', 'chatgpt', NULL, NULL][doc_id % 7 + 1] AS provider FROM documents")
def detect_provider(spark, d):
    json = text_of(
        '[{"uuid":"u","chat_messages":[]}]', '{"conversations":[{"conversation":{},"responses":[]}]}', '﻿"Conversation","Time","Author","Message"\r\n', '[{"title":"t","mapping":{}}]',
        '{"conversations":[{"mapping":{}}]}', '{"a":1}', "not json",
    )
    return v.table(spark, d, "documents").select("doc_id", b.detect_provider(json).alias("provider"))


MEMBERS = ["x/conversations-000.json", "conversations-001/part.json", "users.json", "conversations.json", "prod-grok-backend.json", "posts.csv", "chat.html", "a.csv", "readme.txt", "projects/p.json", None]
#: Two documents an archive. Every seventh is called like a part of a split export; the last kind of member stands for an archive that can't be read.
ARCHIVES = """mb AS (SELECT CASE WHEN doc_id // 2 % 7 = 3 THEN 'in/conversations-' || doc_id // 2 || '.zip' ELSE 'z' || doc_id // 2 END AS archive, doc_id // 2 % 7 = 3 AS p, CASE WHEN doc_id // 2 % 7 = 3 AND doc_id // 2 % 2 = 0 THEN 3 ELSE (doc_id + doc_id // 22) % 11 END AS k FROM documents
  WHERE NOT (doc_id // 2 % 7 = 3 AND doc_id // 2 % 2 = 0 AND doc_id % 2 = 1)),
fl AS (SELECT archive, any_value(p) AS p, count(*) FILTER (WHERE k <> 10) AS n, bool_or(k = 0) AS f0, bool_or(k = 1) AS f1, bool_or(k IN (2, 9)) AS f2, bool_or(k = 3) AS f3, bool_or(k = 4) AS f4, bool_or(k = 5) AS f5, bool_or(k = 6) AS f6, bool_or(k = 7) AS f7, bool_or(k = 10) AS f10,
  count(*) FILTER (WHERE k = 7) AS t FROM mb GROUP BY 1),
kd AS (SELECT archive, t, CASE WHEN f10 THEN 'corrupt' WHEN f0 THEN 'chatgpt shards' WHEN f1 THEN 'claude split' WHEN f3 AND p AND n = 1 THEN 'claude part' WHEN f3 AND f2 THEN 'claude' WHEN f3 THEN 'chatgpt' WHEN f4 THEN 'grok' WHEN f5 THEN 'posts' WHEN f6 THEN 'html' WHEN f7 THEN 'copilot' ELSE 'unknown' END AS kind FROM fl)"""


@query(
    "B2_classify_exports",
    v.with_sql(
        ARCHIVES,
        "SELECT archive, kind, kind NOT IN ('corrupt', 'posts', 'unknown') AS valid, CASE kind WHEN 'corrupt' THEN 'corrupt or unreadable, its conversations are not imported: bad magic' WHEN 'posts' THEN 'a publication, not a chat export; further tables with readers'' data: ' || t "
        "WHEN 'claude part' THEN 'one part of a split export; the others come apart' WHEN 'html' THEN 'degraded: HTML only' WHEN 'unknown' THEN 'not an export' END AS message FROM kd",
    ),
)
def classify_exports(spark, d):
    n = F.floor(doc() / 2)
    part = n % 7 == 3
    lone = part & (n % 2 == 0)
    archive = F.when(part, F.concat(F.lit("in/conversations-"), n.cast("string"), F.lit(".zip"))).otherwise(F.concat(F.lit("z"), n.cast("string")))
    k = F.when(lone, F.lit(3).cast("long")).otherwise((doc() + F.floor(doc() / 22)) % 11).cast("int")
    rows = v.table(spark, d, "documents").where(~(lone & (doc() % 2 == 1)))
    return b.classify_exports(rows.select(archive.alias("archive"), F.get(F.array(*map(F.lit, MEMBERS)), k).alias("member"), F.when(k == 10, "bad magic").alias("error")))


@query(
    "B3_classify_layouts",
    "SELECT '/r' || (doc_id % 7) AS root, string_agg(DISTINCT c, ',' ORDER BY c) AS categories, bool_or(c = 'conversations') AS valid FROM (SELECT doc_id, ['conversations', 'projects', 'memories', 'frames', 'light_metadata'][doc_id % 35 // 7 + 1] AS c FROM documents WHERE doc_id % 35 <> 3) GROUP BY 1",
)
def classify_layouts(spark, d):
    category = F.get(F.array(*map(F.lit, b.CATEGORIES)), F.floor(doc() % 35 / 7).cast("int"))
    path = F.concat(F.lit("/r"), (doc() % 7).cast("string"), F.lit("/"), F.when(doc() % 35 == 3, "other").otherwise(category), F.lit("-001/a.json"))
    return b.classify_layouts(v.table(spark, d, "documents").select(path.alias("path"))).withColumn("categories", F.array_join("categories", ","))


@query(
    "B4_new_keys",
    "WITH c AS (SELECT lang AS provider, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS nth FROM documents), k AS (SELECT DISTINCT provider, 'k' || (doc_id % 30) AS key FROM c WHERE nth <= 20) "
    "SELECT provider, string_agg(key, ',' ORDER BY key) AS keys FROM k WHERE substr(key, 2)::INT % 4 <> 0 GROUP BY 1",
)
def new_keys(spark, d):
    docs = v.table(spark, d, "documents")
    key = F.concat(F.lit("k"), (doc() % 30).cast("string"))
    rows = docs.select(F.col("lang").alias("provider"), doc().alias("pos"), F.to_json(F.create_map(F.lit("title"), F.col("lang"), key, F.lit("x"))).alias("json"))
    known = docs.where("doc_id % 30 % 4 = 0").select(F.col("lang").alias("provider"), key.alias("key")).unionByName(docs.select(F.col("lang").alias("provider"), F.lit("title").alias("key"))).distinct()
    some = docs.select(F.col("lang").alias("provider")).distinct().crossJoin(known.select("key").distinct())
    return b.new_keys(rows, some).withColumn("keys", F.array_join("keys", ","))


@query("B5_manifest_categories", "SELECT c AS category, count(*) AS files, c <> 'novel' AS known FROM (SELECT unnest(['conversations', CASE WHEN doc_id % 4 = 0 THEN 'novel' ELSE 'frames' END]) AS c FROM documents) GROUP BY 1")
def manifest_categories(spark, d):
    file = lambda c: F.struct(c.alias("category"), F.lit("u").alias("export_url"))
    return b.manifest_categories(v.table(spark, d, "documents").select(F.array(file(F.lit("conversations")), file(F.when(doc() % 4 == 0, "novel").otherwise("frames"))).alias("data_files")))


FILES = """fs AS (SELECT doc_id, 'f' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '|dir' ELSE '' END || '|' || n_chars AS fingerprint, 'f' || doc_id AS name, n_chars AS mtime, doc_id % 5 <> 0 AS valid, doc_id % 2 = 0 AS done FROM documents)"""


def files(spark, d):
    name = F.concat(F.lit("f"), doc().cast("string"))
    return v.table(spark, d, "documents").select(
        doc(), b.fingerprint(name, F.col("n_chars"), doc() % 3 == 0).alias("fingerprint"), name.alias("name"), F.col("n_chars").alias("mtime"), (doc() % 5 != 0).alias("valid"), (doc() % 7 == 0).alias("drift"), F.lit(5).alias("processed_at")
    )


def registry(spark, d):
    return files(spark, d).where("doc_id % 2 = 0").select("fingerprint", "name", F.lit(1).alias("processed_at"))


@query("B6_fingerprint", v.with_sql(FILES, "SELECT doc_id, fingerprint FROM fs"))
def fingerprint(spark, d):
    return files(spark, d).select("doc_id", "fingerprint")


@query("B7_pending_exports", v.with_sql(FILES, "SELECT name, mtime FROM fs WHERE valid AND NOT done"))
def pending_exports(spark, d):
    return b.pending_exports(files(spark, d), registry(spark, d)).select("name", "mtime")


@query("B7_reprocess_all", v.with_sql(FILES, "SELECT name, mtime FROM fs WHERE valid"))
def reprocess_all(spark, d):
    return b.pending_exports(files(spark, d), registry(spark, d), reprocess_all=True).select("name", "mtime")


@query("B8_mark_processed", v.with_sql(FILES, "SELECT fingerprint, name, CASE WHEN doc_id % 3 = 0 THEN 5 ELSE 1 END AS processed_at FROM fs WHERE done OR doc_id % 3 = 0"))
def mark_processed(spark, d):
    return b.mark_processed(files(spark, d).where("doc_id % 3 = 0"), registry(spark, d))


@query("B9_intake_report", v.with_sql(FILES, "SELECT count(*) AS files, count_if(valid)::BIGINT AS valid, count_if(valid AND NOT done)::BIGINT AS pending, count_if(valid AND done)::BIGINT AS done, true AS drift, 'warn' AS light FROM fs"))
def intake_report(spark, d):
    return b.intake_report(files(spark, d), registry(spark, d))


@query("B10_detect_session", "SELECT doc_id AS file, ['claude-code', 'codex', NULL][doc_id % 3 + 1] AS agent FROM documents")
def detect_session(spark, d):
    line = text_of('{"type":"user","sessionId":"s"}', '{"type":"session_meta","payload":{"id":"x"}}', "garbage")
    lines = v.table(spark, d, "documents").select(doc().alias("file"), F.posexplode(F.array(F.lit("  "), line, F.lit('{"sessionId":"late"}'))).alias("line_no", "line"))
    return b.detect_session(lines)


@query("B11_latest_per_publication", "WITH f AS (SELECT doc_id, source AS slug, n_chars, source || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '-' || doc_id ELSE ' (' || doc_id || ')' END || '.zip' AS name FROM documents) SELECT name, slug, row_number() OVER (PARTITION BY slug ORDER BY n_chars DESC, name) = 1 AS chosen FROM f")
def latest_per_publication(spark, d):
    n = doc().cast("string")
    name = F.concat("source", F.when(doc() % 3 == 0, "").when(doc() % 3 == 1, F.concat(F.lit("-"), n)).otherwise(F.concat(F.lit(" ("), n, F.lit(")"))), F.lit(".zip"))
    return b.latest_per_publication(v.table(spark, d, "documents").select(name.alias("name"), F.col("n_chars").alias("mtime"))).select("name", "slug", "chosen")


@query("B12_pick_stats", "SELECT lang AS slug, CASE WHEN lang <> 'fr' THEN arg_max(lang || '_' || doc_id, (n_chars, lang || '_' || doc_id)) END AS stats FROM documents GROUP BY lang")
def pick_stats(spark, d):
    docs = v.table(spark, d, "documents")
    name = F.concat("lang", F.when(F.col("lang") == "fr", "-").otherwise("_"), doc().cast("string"))
    return b.pick_stats(docs.select(name.alias("name"), F.col("n_chars").alias("mtime")), docs.select(F.col("lang").alias("slug")).distinct())


@query(
    "B13_infer_owner",
    "WITH i AS (SELECT source AS batch, lang AS slug, doc_id FROM documents), h AS (SELECT batch, slug, count(DISTINCT doc_id) AS n FROM i GROUP BY 1, 2), r AS (SELECT *, row_number() OVER w AS k, coalesce(lead(n) OVER w, 0) AS s, sum(n) OVER (PARTITION BY batch) AS total FROM h WINDOW w AS (PARTITION BY batch ORDER BY n DESC, slug)) "
    "SELECT batch, CASE WHEN n > 2 * s AND 2 * n >= total THEN slug END AS slug FROM r WHERE k = 1",
)
def infer_owner(spark, d):
    docs = v.table(spark, d, "documents")
    return b.infer_owner(docs.select(F.col("source").alias("batch"), doc().alias("post_id")), docs.select(doc().alias("post_id"), F.col("lang").alias("slug")))
