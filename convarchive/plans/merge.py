"""Queries of identity, versioning and merge."""

from __future__ import annotations

from pyspark.sql import functions as F

from convarchive.operators import merge as m
from convarchive.operators import threads
from convarchive.plans import derived as v
from convarchive.plans.registry import query


@query("E6_merge_variants", v.with_sql(v.MESSAGES, v.NOTES, v.RANKED, v.MERGED, "SELECT group_key, pos::INT AS pos, role, content, recovered FROM me"))
def merge_variants(spark, d):
    return m.merge_variants(v.version_notes(spark, d), v.version_messages(spark, d))


TITLES = """tt AS (
  SELECT group_key, arg_max(title, (mtime, path)) AS title, arg_max(base_name, (mtime, path)) AS base_name, arg_min(title, (mtime, path)) AS old, count(*) AS variants
  FROM vn GROUP BY group_key)"""
GROUPS = r"""gr AS (SELECT group_key, count(*) AS messages, count_if(recovered) AS recovered, sha1(string_agg(lower(role) || chr(31) || content, chr(30) ORDER BY pos)) AS digest FROM me GROUP BY 1),
mc AS (
  SELECT group_key, title, base_name, nullif(old, title) AS original_title, variants, messages, recovered::BIGINT AS recovered, digest,
    regexp_replace(source, '(_merged|_reverse)+$', '') || CASE WHEN recovered > 0 THEN '_merged' ELSE '' END AS source
  FROM tt JOIN gr USING (group_key) JOIN (SELECT group_key, source FROM rk WHERE rank = 1) USING (group_key))"""
ALL = (v.MESSAGES, v.NOTES, v.RANKED, v.MERGED, TITLES, GROUPS)


@query("E9_merged_conversations", v.with_sql(*ALL, "SELECT * FROM mc"))
def merged_conversations(spark, d):
    return m.merged_conversations(v.version_notes(spark, d), v.version_messages(spark, d))


@query("E11_merge_stats", v.with_sql(*ALL, 'SELECT count(*) AS "groups", sum(variants)::BIGINT AS variants, sum(messages)::BIGINT AS messages, sum(recovered)::BIGINT AS recovered, count(original_title) AS renamed FROM mc'))
def merge_stats(spark, d):
    return m.merge_stats(v.version_notes(spark, d), v.version_messages(spark, d))


@query("E4_champion", v.with_sql(v.MESSAGES, v.NOTES, v.RANKED, "SELECT group_key, note_id, words, bytes, rank::INT AS rank FROM rk"))
def champion(spark, d):
    return m.ranked_variants(v.version_notes(spark, d), v.version_messages(spark, d)).select("group_key", "note_id", "words", "bytes", "rank")


@query("E5_fingerprint", f"SELECT conv_id, turn, sha1(lower(role) || '::' || {v.COLLAPSED.format('text')}) AS fp FROM conversations")
def fingerprint(spark, d):
    return v.table(spark, d, "conversations").select("conv_id", "turn", m.fingerprint(F.col("role"), F.col("text")).alias("fp"))


@query("E7_resolve_titles", v.with_sql(v.NOTES, TITLES, "SELECT group_key, title, base_name, nullif(old, title) AS original_title, variants FROM tt"))
def resolve_titles(spark, d):
    return m.resolve_titles(v.version_notes(spark, d))


@query(
    "E1_note_key",
    v.with_sql(
        v.DOC_NOTES,
        r"nk AS (SELECT note_id, substr(sha1(regexp_replace(body, '^\s+|\s+$', '', 'g')), 1, 8) AS content_hash, concat_ws('_', date::VARCHAR, replace(lower(title), ' ', '-')) AS base FROM nt)",
        "SELECT note_id, content_hash, CASE WHEN row_number() OVER (PARTITION BY base ORDER BY note_id) > 1 THEN base || '-h' || content_hash ELSE base END AS note_name FROM nk",
    ),
)
def note_key(spark, d):
    return m.note_key(v.notes(spark, d)).select("note_id", "content_hash", "note_name")


def _new_and_old(spark, d):
    rows = v.notes(spark, d).select("note_id", F.concat(F.lit("b"), (F.col("doc_id") % 40).cast("string")).alias("base"), "body", "doc_id")
    return rows.where("doc_id % 2 = 0").drop("doc_id"), rows.where("doc_id % 5 = 0").drop("doc_id")


NEW_OLD = r"""aw AS (SELECT note_id, 'b' || (doc_id % 40) AS base, sha1(regexp_replace(body, '^\s+|\s+$', '', 'g')) AS h, doc_id FROM nt),
fr AS (SELECT base, h, min(note_id) AS note_id FROM aw a WHERE doc_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM aw b WHERE b.doc_id % 5 = 0 AND b.base = a.base AND b.h = a.h) GROUP BY 1, 2),
nn AS (SELECT fr.*, row_number() OVER (PARTITION BY base ORDER BY note_id) + coalesce(k, 0) AS nth, row_number() OVER (PARTITION BY base, substr(h, 1, 8) ORDER BY h) AS twin
  FROM fr LEFT JOIN (SELECT base, count(*) AS k FROM aw WHERE doc_id % 5 = 0 GROUP BY 1) USING (base))"""


@query("E2_append_versions", v.with_sql(v.DOC_NOTES, NEW_OLD, "SELECT note_id, base, base || CASE WHEN nth = 1 THEN '' ELSE '-h' || substr(h, 1, 8) || CASE WHEN twin > 1 THEN '-' || twin ELSE '' END END AS version_name FROM nn"))
def append_versions(spark, d):
    return m.append_versions(*_new_and_old(spark, d)).select("note_id", "base", "version_name")


@query("E2_append_versions_counter", v.with_sql(v.DOC_NOTES, NEW_OLD, "SELECT note_id, base, base || CASE WHEN nth = 1 THEN '' ELSE '-' || nth END AS version_name FROM nn"))
def append_versions_counter(spark, d):
    return m.append_versions(*_new_and_old(spark, d), scheme="counter").select("note_id", "base", "version_name")


@query(
    "E2_append_versions_time",
    v.with_sql(
        v.DOC_NOTES, NEW_OLD, "na AS (SELECT nn.note_id, nn.base, nn.h, nn.nth, nt.date FROM nn JOIN nt USING (note_id))",
        "st AS (SELECT *, coalesce(strftime(date, '%Y%m%d-%H%M%S'), 'h' || substr(h, 1, 8)) AS stamp FROM na)",
        "SELECT note_id, base, base || CASE WHEN nth = 1 THEN '' ELSE '_' || stamp || CASE WHEN k > 1 THEN '-' || k ELSE '' END END AS version_name FROM (SELECT *, row_number() OVER (PARTITION BY base, stamp ORDER BY note_id) AS k FROM st)",
    ),
)
def append_versions_time(spark, d):
    new, old = _new_and_old(spark, d)
    dates = v.notes(spark, d).select("note_id", F.col("date").cast("timestamp").alias("created"))
    return m.append_versions(new.join(dates, "note_id"), old, scheme="time").select("note_id", "base", "version_name")


@query(
    "E3_group_key",
    v.with_sql(
        v.DOC_NOTES,
        "fn AS (SELECT note_id, conv_id, 'n' || (doc_id % 30) || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '-h0a1b2c3d' ELSE '-v2' END AS file FROM nt)",
        "SELECT note_id, coalesce('id:' || conv_id, regexp_replace(file, '(-h[0-9a-f]{8}|-v?\\d+)$', '')) AS group_key FROM fn",
    ),
)
def group_key(spark, d):
    suffix = F.get(F.array(F.lit(""), F.lit("-h0a1b2c3d"), F.lit("-v2")), (F.col("doc_id") % 3).cast("int"))
    file = F.concat(F.lit("n"), (F.col("doc_id") % 30).cast("string"), suffix)
    return v.notes(spark, d).select("note_id", m.group_key(F.col("conv_id"), file).alias("group_key"))


@query(
    "E8_disambiguate",
    "WITH g AS (SELECT 'id:' || o_custkey AS group_key, max(strftime(o_orderdate::DATE, '%Y/%m/%d')) AS dest FROM orders GROUP BY 1) "
    "SELECT group_key, dest, CASE WHEN count(*) OVER (PARTITION BY dest) > 1 THEN dest || ' · ' || substr(sha1(group_key), 1, 6) ELSE dest END AS output FROM g",
)
def disambiguate(spark, d):
    day = F.date_format(F.col("o_orderdate").cast("date"), "yyyy/MM/dd")
    groups = v.table(spark, d, "orders").groupBy(F.concat(F.lit("id:"), F.col("o_custkey").cast("string")).alias("group_key")).agg(F.max(day).alias("dest"))
    return m.disambiguate(groups)


@query(
    "E10_apply_pointer_links",
    v.with_sql(
        "p AS (SELECT conv_id, turn, text, 'p' || (conv_id % 20) AS a, 'p' || (turn % 7 + 17) AS b FROM conversations)",
        "SELECT conv_id::VARCHAR AS note_id, turn AS pos, text || ' ' || CASE WHEN conv_id % 20 % 2 = 0 THEN 'link/' || a || '.png' ELSE '[missing image:' || a || ']' END || ' and ' || "
        "CASE WHEN (turn % 7 + 17) % 2 = 0 AND turn % 7 + 17 < 20 THEN 'link/' || b || '.png' ELSE '[missing image:' || b || ']' END AS content FROM p",
    ),
)
def apply_pointer_links(spark, d):
    c = v.table(spark, d, "conversations")
    notice = lambda n: F.concat(F.lit("[missing image:p"), n.cast("string"), F.lit("]"))
    content = F.concat("text", F.lit(" "), notice(F.col("conv_id") % 20), F.lit(" and "), notice(F.col("turn") % 7 + 17))
    messages = c.select(F.col("conv_id").cast("string").alias("note_id"), F.col("turn").alias("pos"), content.alias("content"))
    n = (F.col("conv_id") % 20).alias("n")
    links = c.select(n).distinct().where("n % 2 = 0").select(F.concat(F.lit("p"), F.col("n").cast("string")).alias("pointer"), F.concat(F.lit("link/p"), F.col("n").cast("string"), F.lit(".png")).alias("link"))
    return m.apply_pointer_links(messages, links)


@query(
    "E12_merge_links",
    "WITH o AS (SELECT 'p' || s_suppkey AS pointer, s_name AS link FROM supplier WHERE s_suppkey % 2 = 0), n AS (SELECT 'p' || s_suppkey AS pointer, 'new/' || s_name AS link FROM supplier WHERE s_suppkey % 3 = 0) "
    "SELECT pointer, coalesce(n.link, o.link) AS link FROM o FULL JOIN n USING (pointer)",
)
def merge_links(spark, d):
    s = v.table(spark, d, "supplier").select(F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("pointer"), "s_name", "s_suppkey")
    return m.merge_links(s.where("s_suppkey % 2 = 0").select("pointer", F.col("s_name").alias("link")), s.where("s_suppkey % 3 = 0").select("pointer", F.concat(F.lit("new/"), F.col("s_name")).alias("link")))


@query(
    "E13_dedupe_assets",
    "SELECT sha1, bank_order, path FROM (SELECT sha1(text) AS sha1, doc_id % 3 AS bank_order, 'f' || doc_id AS path, row_number() OVER (PARTITION BY sha1(text) ORDER BY doc_id % 3, 'f' || doc_id) AS k FROM documents) WHERE k = 1",
)
def dedupe_assets(spark, d):
    docs = v.table(spark, d, "documents")
    return m.dedupe_assets(docs.select(F.sha1("text").alias("sha1"), (F.col("doc_id") % 3).alias("bank_order"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path")))


@query(
    "E14_preserve_sources",
    "WITH f AS (SELECT 'f' || doc_id AS path, substr(sha1(text), 1, 16) AS name, doc_id, text FROM documents) "
    "SELECT name, min(path) AS path, count(*) AS copies, sha1(any_value(text)) AS digest, strlen(any_value(text)) AS bytes FROM f WHERE name NOT IN (SELECT name FROM f WHERE doc_id % 4 = 0) GROUP BY name",
)
def preserve_sources(spark, d):
    docs = v.table(spark, d, "documents")
    files = docs.select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))
    kept = docs.where("doc_id % 4 = 0").select(F.substring(F.sha1("text"), 1, 16).alias("name")).distinct()
    return m.preserve_sources(files, kept).select("name", "path", "copies", F.sha1("content").alias("digest"), "bytes")


@query(
    "E14_session_manifest",
    v.with_sql(
        v.EVENTS,
        "h AS (SELECT session_id, arg_min(title, line_no) FILTER (WHERE title IS NOT NULL) AS title, arg_min(cwd, line_no) FILTER (WHERE cwd IS NOT NULL) AS cwd, arg_min(branch, line_no) FILTER (WHERE branch IS NOT NULL) AS branch FROM se GROUP BY 1)",
        "k AS (SELECT *, sum((kind = 'human')::INT) OVER (PARTITION BY session_id ORDER BY line_no) AS island FROM se WHERE kind <> 'noise' AND NOT is_side)",
        "t AS (SELECT session_id, count(DISTINCT (island, kind = 'human')) AS turns FROM k WHERE island > 0 GROUP BY 1)",
        "SELECT substr(sha1('log ' || session_id), 1, 16) AS name, session_id, title, cwd, branch, turns, 'b/' || session_id AS path FROM h JOIN t USING (session_id)",
    ),
)
def session_manifest(spark, d):
    events = v.session_events(spark, d)
    key = F.col("session_id").cast("string")
    name = F.substring(F.sha1(F.concat(F.lit("log "), key)), 1, 16).alias("name")
    sources = events.select("session_id").distinct().select("session_id", name, F.explode(F.array(F.concat(F.lit("a/"), key), F.concat(F.lit("b/"), key))).alias("path"))
    return m.session_manifest(threads.session_header(events), threads.agent_turns(events), sources)
