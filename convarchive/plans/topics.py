"""Queries of the term cloud and topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from convarchive.operators import topics as t
from convarchive.plans import derived as v
from convarchive.plans.registry import query

TOPICS = {
    "Motion": ["thion", "einchie", "of the"],
    "Romance": ["lang=fr", "langue"],
    "Lists": ["quería", "de la", "und die"],
    "German": ["lang=de"],
    "Nothing": ["zzzz", "no such phrase"],
}
FOLD = "strip_accents(lower({0}))"
ORPHANS = "og AS (SELECT * FROM nt WHERE coalesce(lower(trim(project)), 'none') IN ('none', ''))"
TOKENS = f"""tk AS (SELECT DISTINCT note_id, token FROM (SELECT note_id, unnest(regexp_extract_all({FOLD.format("title || chr(10) || body")}, '[a-z0-9][a-z0-9_-]{{2,}}')) AS token FROM og) WHERE NOT regexp_matches(token, '^[0-9]+$'))"""
BASE = (v.DOC_NOTES, ORPHANS, TOKENS)
STOP = ", ".join(f"'{w}'" for w in t.STOPWORDS)
GENERIC = f"""ge AS (SELECT token, count(*) AS n FROM tk GROUP BY token
  HAVING count(*) BETWEEN 3 AND (SELECT greatest(floor(count(*) * 0.25), 3) FROM og) AND token NOT IN ({STOP}) ORDER BY n DESC, token LIMIT 100)"""
VOCAB = f"""vn2 AS (SELECT DISTINCT project, 0 AS source FROM nt WHERE project NOT IN ('none') UNION SELECT DISTINCT c_mktsegment, 1 FROM customer),
vt AS (SELECT project, source, unnest(list_distinct(list_filter(regexp_extract_all({FOLD.format("project")}, '[a-z0-9][a-z0-9_-]{{2,}}'), lambda x: NOT regexp_matches(x, '^[0-9]+$')) || [{FOLD.format("project")}])) AS token FROM vn2),
vo AS (SELECT token, arg_min(project, (source, project)) AS project, min(source) AS source FROM vt GROUP BY token)"""


def orphan_notes(spark, d):
    return t.orphans(v.notes(spark, d))


@query("H1_orphans", v.with_sql(v.DOC_NOTES, ORPHANS, "SELECT note_id, title FROM og"))
def orphans(spark, d):
    return orphan_notes(spark, d).select("note_id", "title")


@query("H2_tokens", v.with_sql(*BASE, "SELECT note_id, count(*) AS tokens, sha1(string_agg(token, ' ' ORDER BY token)) AS digest FROM tk GROUP BY 1"))
def tokens(spark, d):
    found = t.tokens(orphan_notes(spark, d))
    return found.groupBy("note_id").agg(F.count("*").alias("tokens"), F.sha1(F.array_join(F.array_sort(F.collect_list("token")), " ")).alias("digest"))


@query("H3_doc_freq", v.with_sql(*BASE, "SELECT token, count(*) AS n FROM tk GROUP BY token"))
def doc_freq(spark, d):
    return t.doc_freq(orphan_notes(spark, d))


@query("H4_generic_terms", v.with_sql(*BASE, GENERIC, "SELECT * FROM ge"))
def generic_terms(spark, d):
    return t.generic_terms(orphan_notes(spark, d))


def vocab_of(spark, d):
    first = v.notes(spark, d).where("project not in ('none')").select("project")
    return t.project_vocab([first, v.table(spark, d, "customer").select(F.col("c_mktsegment").alias("project"))])


@query("H5_project_vocab", v.with_sql(v.DOC_NOTES, VOCAB, "SELECT token, project, source FROM vo"))
def project_vocab(spark, d):
    return vocab_of(spark, d)


@query(
    "H6_term_cloud",
    v.with_sql(*BASE, GENERIC, VOCAB, "SELECT token, n, project FROM (SELECT * FROM ge UNION ALL SELECT token, count(*) FROM tk WHERE token IN (SELECT token FROM vo) AND token NOT IN (SELECT token FROM ge) GROUP BY 1) LEFT JOIN vo USING (token)"),
)
def term_cloud(spark, d):
    return t.term_cloud(orphan_notes(spark, d), vocab_of(spark, d))


@query(
    "H7_notes_for_term",
    v.with_sql(*BASE, "mt AS (SELECT note_id, title, date FROM og WHERE note_id IN (SELECT note_id FROM tk WHERE token = 'thing'))", "SELECT note_id, title, date::VARCHAR AS date, (SELECT count(*) FROM mt) AS total FROM mt ORDER BY mt.date DESC NULLS LAST, note_id LIMIT 200"),
)
def notes_for_term(spark, d):
    return t.notes_for_term(orphan_notes(spark, d), "Thing").withColumn("date", F.col("date").cast("string"))


RULES = "ru(topic, kind, field, value) AS (VALUES " + ", ".join(
    f"('{topic}', '{'field' if '=' in r else 'phrase' if ' ' in r else 'word'}', {repr(r.split('=')[0]) if '=' in r else 'NULL'}, {repr(r.split('=')[-1])})" for topic, rules in TOPICS.items() for r in rules
) + ")"
MATCH = f"""ma AS (
  SELECT topic, note_id, bool_or(content) AS content FROM (
    SELECT topic, note_id, true AS content FROM tk JOIN ru ON kind = 'word' AND token = {FOLD.format("value")}
    UNION ALL SELECT topic, note_id, true FROM og JOIN ru ON kind = 'phrase' AND contains({FOLD.format("body || chr(10) || title")}, {FOLD.format("value")})
    UNION ALL SELECT topic, note_id, false FROM og JOIN ru ON kind = 'field' AND ((field = 'lang' AND lang = value) OR (field = 'provider' AND provider = value))) GROUP BY 1, 2)"""


def matched(spark, d):
    return t.match_topics(orphan_notes(spark, d), t.rule_table(spark, TOPICS), ["lang", "provider"])


@query("H8_match_topics", v.with_sql(*BASE, RULES, MATCH, "SELECT * FROM ma"))
def match_topics(spark, d):
    return matched(spark, d)


@query(
    "H9_topic_stats",
    v.with_sql(
        *BASE, RULES, MATCH,
        "SELECT topic, bool_and(kind = 'field') AS structural, (SELECT count(*) FROM ma WHERE ma.topic = ru.topic) AS hits, "
        "(SELECT round(100.0 * count(DISTINCT note_id) / (SELECT count(*) FROM og), 1) FROM ma WHERE content) AS coverage FROM ru GROUP BY topic",
    ),
)
def topic_stats(spark, d):
    return t.topic_stats(matched(spark, d), orphan_notes(spark, d), t.rule_table(spark, TOPICS))


@query(
    "H10_blind_spots",
    v.with_sql(
        *BASE, RULES, MATCH,
        "SELECT note_id, CASE WHEN c IS NULL THEN 'no topic' ELSE 'only structural' END AS spot FROM og LEFT JOIN (SELECT note_id, bool_or(content) AS c FROM ma GROUP BY 1) USING (note_id) WHERE c IS NULL OR NOT c",
    ),
)
def blind_spots(spark, d):
    return t.blind_spots(matched(spark, d), orphan_notes(spark, d))


@query(
    "H11_stale_topics",
    "SELECT 'T' || s_suppkey AS topic, true AS generated FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0",
)
def stale_topics(spark, d):
    s = v.table(spark, d, "supplier")
    name = F.concat(F.lit("T"), F.col("s_suppkey").cast("string")).alias("topic")
    return t.stale_topics(s.select(name, (F.col("s_suppkey") % 2 == 0).alias("generated")), s.where("s_suppkey % 3 = 0").select(name))
