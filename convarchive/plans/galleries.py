"""Queries of galleries."""

from __future__ import annotations

from pyspark.sql import functions as F

from convarchive.operators import gallery as g
from convarchive.plans import derived as v
from convarchive.plans.registry import query


def linked_messages(spark, d):
    c = v.table(spark, d, "conversations")
    image = F.concat(F.lit("![x](i"), (F.col("conv_id") * 3 + F.col("turn") % 5).cast("string"), F.lit(".png)"))
    content = F.when(F.col("role") == "assistant", F.concat("text", F.lit(" "), image)).otherwise(F.col("text"))
    prompt = F.when((F.col("role") == "assistant") & (F.col("turn") % 3 == 1), F.concat(F.lit("p"), F.col("turn").cast("string")))
    return c.select(F.lpad(F.col("conv_id").cast("string"), 8, "0").alias("note_id"), F.col("turn").alias("pos"), "role", content.alias("content"), prompt.alias("prompt"))


CONTEXT = """lm AS (SELECT lpad(conv_id::VARCHAR, 8, '0') AS note_id, turn AS pos, role, text AS content, CASE WHEN role = 'assistant' AND turn % 3 = 1 THEN 'p' || turn END AS prompt,
  CASE WHEN role = 'assistant' THEN 'i' || (conv_id * 3 + turn % 5) || '.png' END AS file FROM conversations),
li2 AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY note_id ORDER BY pos) AS island, last_value(CASE WHEN role = 'user' THEN content END IGNORE NULLS) OVER (PARTITION BY note_id ORDER BY pos) AS request FROM lm),
lc AS (SELECT note_id, pos, request, last_value(prompt IGNORE NULLS) OVER (PARTITION BY note_id, island ORDER BY pos) AS prompt, file FROM li2),
cx AS (SELECT note_id, pos, request, prompt, file FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY note_id, pos) AS k FROM lc WHERE file IS NOT NULL) WHERE k = 1)"""


@query("I1_asset_context", v.with_sql(CONTEXT, "SELECT * FROM cx"))
def asset_context(spark, d):
    return g.asset_context(linked_messages(spark, d))


@query(
    "I2_collect_assets",
    v.with_sql(
        CONTEXT, "a AS (SELECT 'i' || doc_id || '.png' AS file, CASE doc_id % 4 WHEN 0 THEN 'chatgpt.generadas' WHEN 1 THEN 'grok.generadas_video' WHEN 2 THEN 'grok.imagine' ELSE 'other' END AS bank, doc_id, lang FROM documents)",
        "SELECT a.file, bank, note_id, CASE WHEN doc_id % 7 = 0 THEN lang ELSE CASE WHEN doc_id % 5 <> 0 THEN prompt END END AS prompt, CASE WHEN doc_id % 5 <> 0 THEN coalesce(CASE WHEN doc_id % 3 = 0 THEN 'G' END, CASE bank WHEN 'grok.generadas_video' THEN 'grok-chat' WHEN 'grok.imagine' THEN 'grok-imagine' END) END AS generator, "
        "coalesce(substr(request, 1, 70), a.file) AS title, doc_id AS created FROM a LEFT JOIN cx ON cx.file = a.file",
    ),
)
def collect_assets(spark, d):
    doc = F.col("doc_id")
    file = F.concat(F.lit("i"), doc.cast("string"), F.lit(".png")).alias("file")
    docs = v.table(spark, d, "documents")
    assets = docs.select(file, F.when(doc % 4 == 0, "chatgpt.generadas").when(doc % 4 == 1, "grok.generadas_video").when(doc % 4 == 2, "grok.imagine").otherwise("other").alias("bank"))
    none = F.lit(None).cast("string")
    manifest = docs.select(file, F.when(doc % 5 == 0, "uploaded").alias("origin"), F.when(doc % 3 == 0, "G").alias("generator"), F.when(doc % 7 == 0, F.col("lang")).alias("prompt"), none.alias("title"), doc.alias("created"))
    return g.collect_assets(assets, manifest, g.asset_context(linked_messages(spark, d)))


@query("I3_collect_copilot", "SELECT 'f' || event_id AS file, event_id AS bytes, strftime(ts, '%Y-%m-%d') || '|' || event_type AS key FROM events WHERE event_id % 3 = 0")
def collect_copilot(spark, d):
    e = v.table(spark, d, "events")
    file = F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("file")
    out = g.collect_copilot(e.select(file, F.col("ts").alias("created"), F.col("event_type").alias("prompt")), e.where("event_id % 3 = 0").select(file, F.col("event_id").alias("bytes")))
    return out.select("file", "bytes", "key")


@query(
    "I4_group_strips",
    "WITH i AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'conv:' || user_id ELSE event_type || ':' || strftime(ts, '%Y-%m-%d') END AS strip, ts, 'f' || event_id AS file, event_type AS title FROM events) "
    "SELECT strip, max(ts) AS latest, count(*) AS items, string_agg(file, ',' ORDER BY file) AS files, max(title) AS title FROM i GROUP BY strip",
)
def group_strips(spark, d):
    items = v.table(spark, d, "events").select(
        F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string")).alias("conv_id"), F.col("event_type").alias("provider"), F.col("ts").alias("created"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("file"), F.col("event_type").alias("title")
    )
    return g.group_strips(items).withColumn("files", F.array_join("files", ","))


@query(
    "I5_collect_posts",
    "WITH n AS (SELECT lang AS publication, doc_id // 3 AS post_id, doc_id AS note_id, n_chars AS mtime, CASE WHEN doc_id % 2 = 0 THEN 'u' || doc_id END AS image FROM documents) "
    "SELECT publication, post_id, note_id, image, mtime FROM (SELECT *, row_number() OVER (PARTITION BY publication, post_id ORDER BY mtime DESC, note_id) AS k FROM n) WHERE k = 1",
)
def collect_posts(spark, d):
    doc = F.col("doc_id")
    body = F.concat("text", F.when(doc % 2 == 0, F.concat(F.lit(" ![a](u"), doc.cast("string"), F.lit(") ![b](v)"))).otherwise(""))
    return g.collect_posts(v.table(spark, d, "documents").select(F.col("lang").alias("publication"), F.floor(doc / 3).alias("post_id"), doc.alias("note_id"), F.col("n_chars").alias("mtime"), body.alias("body")))


@query(
    "I6_choose_cover",
    "WITH p AS (SELECT page_id AS post_id, CASE WHEN page_id % 2 = 0 AND page_id % 3 = 0 THEN 'c' || page_id WHEN page_id % 5 <> 0 THEN 'i' || page_id END AS cover FROM pages) "
    "SELECT post_id, cover, cover IS NOT DISTINCT FROM CASE WHEN post_id % 4 = 0 THEN 'c' || post_id END AS reused FROM p",
)
def choose_cover(spark, d):
    page, key = v.table(spark, d, "pages"), F.col("page_id")
    named = lambda c: F.concat(F.lit(c), key.cast("string"))
    posts = page.select(key.alias("post_id"), (key % 2 == 0).alias("published"), F.when(key % 5 != 0, named("i")).alias("image"))
    covers = page.where("page_id % 3 = 0").select(key.alias("post_id"), named("c").alias("url"))
    return g.choose_cover(posts, covers, page.where("page_id % 4 = 0").select(key.alias("post_id"), named("c").alias("cover")))
