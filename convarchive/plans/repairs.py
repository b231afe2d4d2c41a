"""Queries of repair and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from convarchive.operators import repair as r
from convarchive.operators.blocks import OPEN
from convarchive.plans import derived as v
from convarchive.plans.registry import query


def doc():
    return F.col("doc_id")


def damaged(spark, d):
    body = F.concat(
        "body", F.when(doc() % 3 == 0, '\n{"content_type":"execution_output","text":"x"}').otherwise(""), F.when(doc() % 5 == 0, "\x00").otherwise(""), F.when(doc() % 7 == 0, OPEN).otherwise(""),
        F.when(doc() % 4 == 0, F.concat(F.lit("\n[missing image:p"), (doc() % 30).cast("string"), F.lit("]"))).otherwise(""),
    )
    return v.notes(spark, d).withColumns({"body": body, "model": F.when(doc() % 2 == 0, "m")})


FLAGGED = """fl AS (SELECT provider, unnest([CASE WHEN doc_id % 3 = 0 THEN 'raw_json:note' END, CASE WHEN doc_id % 5 = 0 THEN 'nul_bytes:export' END, CASE WHEN doc_id % 7 = 0 THEN 'raw_citations:export' END,
  CASE WHEN doc_id % 4 = 0 THEN 'missing_image:export' END, CASE WHEN doc_id % 2 = 1 THEN 'no_model:export' END, CASE WHEN conv_id IS NULL THEN 'no_conv_id:export' END]) AS f FROM nt)"""


@query("J1_diagnose", v.with_sql(v.DOC_NOTES, FLAGGED, "SELECT split_part(f, ':', 1) AS flag, split_part(f, ':', 2) AS repair_from, provider, count(*) AS notes FROM fl WHERE f IS NOT NULL GROUP BY ALL"))
def diagnose(spark, d):
    return r.diagnose(damaged(spark, d))


@query("J2_repair", v.with_sql(v.DOC_NOTES, "SELECT note_id, body || chr(10) || 'result' || chr(10) || 'x' AS body FROM nt WHERE doc_id % 3 = 0"))
def repair(spark, d):
    body = F.concat("body", F.when(doc() % 3 == 0, '\n{"content_type":"execution_output","text":"x"}').otherwise(""))
    return r.repair(v.notes(spark, d).withColumn("body", body)).select("note_id", "body")


PLAN = r"""pl AS (SELECT doc_id AS path, lang AS dir, source AS base, source || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '-h' || doc_id END AS name, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body, n_chars + doc_id AS mtime FROM documents),
tw AS (SELECT *, row_number() OVER (PARTITION BY dir, base, body ORDER BY (name <> base)::INT, name) AS nth, max(mtime) OVER (PARTITION BY dir, base, body) AS newest FROM pl),
ac AS (SELECT *, row_number() OVER (PARTITION BY dir, base ORDER BY (nth <> 1)::INT, (name <> base)::INT, name) AS k FROM tw)"""


@query("J3_repair_plan", v.with_sql(PLAN, "SELECT path, CASE WHEN nth > 1 THEN 'trash' WHEN k = 1 AND name <> base THEN 'rename' ELSE 'keep' END AS action, CASE WHEN nth = 1 AND k = 1 AND name <> base THEN base ELSE name END AS new_name, CASE WHEN nth = 1 THEN newest END AS mtime FROM ac"))
def repair_plan(spark, d):
    name = F.concat("source", F.when(doc() % 3 == 0, "").otherwise(F.concat(F.lit("-h"), doc().cast("string"))))
    # texts are told apart beyond their folder, so that equal names never tie
    return r.repair_plan(v.table(spark, d, "documents").where("true").select(doc().alias("path"), F.col("lang").alias("dir"), F.col("source").alias("base"), name.alias("name"), F.col("text").alias("body"), (F.col("n_chars") + doc()).alias("mtime")))


@query("J4_hand_edited", "SELECT doc_id AS path, doc_id % 3 = 0 OR doc_id % 10 = 9 AS edited FROM documents")
def hand_edited(spark, d):
    docs = v.table(spark, d, "documents")
    merged = docs.select(doc().alias("path"), F.concat("text", F.when(doc() % 3 == 0, "\nby hand").otherwise("")).alias("body"))
    return r.hand_edited(merged, docs.where("doc_id % 10 <> 9").select(doc().alias("path"), F.concat("text", F.lit("\nmore")).alias("body")))


SYNC = """s AS (SELECT doc_id, doc_id % 8 AS k FROM documents)"""


def _snapshots(spark, d):
    docs = v.table(spark, d, "documents").select(doc().alias("path"), (doc() % 8).alias("k"), F.md5("text").alias("sha"), (doc() % 100).alias("conv_id"))
    changed = lambda k: F.when(F.col("k").isin(*k), F.concat("sha", F.lit("x"))).otherwise(F.col("sha")).alias("sha")
    return docs, changed


@query(
    "J5_sync_plan",
    "WITH s AS (SELECT doc_id, doc_id % 8 AS k, doc_id % 100 AS c FROM documents), al AS (SELECT DISTINCT c FROM s WHERE k <= 4) "
    "SELECT doc_id AS path, CASE k WHEN 0 THEN 'new' WHEN 1 THEN 'same' WHEN 2 THEN 'write' WHEN 3 THEN 'protected' WHEN 4 THEN 'protected' WHEN 5 THEN CASE WHEN c IN (SELECT c FROM al) THEN 'orphan' ELSE 'unknown' END WHEN 6 THEN 'unknown' ELSE 'gone' END AS plan FROM s",
)
def sync_plan(spark, d):
    docs, changed = _snapshots(spark, d)
    actual = docs.where("k not in (0, 7)").select("path", changed([3, 6]), "conv_id")
    before = docs.where("k not in (0, 4)").select("path", "sha", "conv_id")
    after = docs.where("k <= 4").select("path", F.when(F.col("k").isin(2, 3, 4), F.concat("sha", F.lit("y"))).otherwise(F.col("sha")).alias("sha"), "conv_id")
    return r.sync_plan(actual, before, after)


@query(
    "J6_view_sync",
    "WITH s AS (SELECT doc_id, doc_id % 8 AS k, doc_id % 100 AS c FROM documents) SELECT doc_id AS path, CASE WHEN k < 4 OR c IN (SELECT c FROM s WHERE k > 5) THEN 'stale' ELSE 'unknown' END AS state FROM s WHERE k <= 5 "
    "AND true",
)
def view_sync(spark, d):
    docs, changed = _snapshots(spark, d)
    docs = docs.withColumn("sha", F.concat("sha", F.lit("-"), F.col("path").cast("string")))
    return r.view_sync(docs.select("path", "sha", "conv_id"), docs.where("k > 5").select("path", "conv_id"), docs.where("k < 4"))


@query(
    "J7_recover_images",
    v.with_sql(v.DOC_NOTES, "w AS (SELECT 'p' || (doc_id % 30) AS pointer, count(*) AS notes FROM nt WHERE doc_id % 4 = 0 GROUP BY 1), m AS (SELECT 'p' || (s_suppkey % 13) AS pointer, s_suppkey FROM supplier)",
               "SELECT pointer, notes, 'e' || arg_max(s_suppkey % 5, (s_suppkey % 5, 'e' || (s_suppkey % 5), 'f' || s_suppkey)) AS export, max('f' || s_suppkey) FILTER (WHERE s_suppkey % 5 = (SELECT max(n.s_suppkey % 5) FROM m n WHERE n.pointer = w.pointer)) AS file FROM w LEFT JOIN m USING (pointer) GROUP BY 1, 2"),
)
def recover_images(spark, d):
    key = F.col("s_suppkey")
    members = v.table(spark, d, "supplier").select(F.concat(F.lit("p"), (key % 13).cast("string")).alias("pointer"), (key % 5).alias("mtime"), F.concat(F.lit("e"), (key % 5).cast("string")).alias("export"), F.concat(F.lit("f"), key.cast("string")).alias("file"))
    return r.recover_images(damaged(spark, d), members)


@query(
    "J7_recovery_report",
    v.with_sql(
        v.DOC_NOTES,
        "w AS (SELECT note_id, 'p' || (doc_id % 30) AS pointer, CASE WHEN doc_id % 8 = 0 THEN 2 ELSE 1 END AS n FROM nt WHERE doc_id % 4 = 0)",
        "h AS (SELECT *, pointer IN (SELECT 'p' || (s_suppkey % 13) FROM supplier) AS there FROM w)",
        "SELECT count(DISTINCT pointer) AS images, sum(n)::BIGINT AS marks, count(DISTINCT note_id) AS notes, count(DISTINCT pointer) FILTER (WHERE there) AS recoverable, count(DISTINCT pointer) FILTER (WHERE NOT there) AS unrecoverable, "
        "coalesce(sum(n) FILTER (WHERE there), 0)::BIGINT AS recoverable_marks, count(DISTINCT note_id) FILTER (WHERE there) AS notes_to_change FROM h",
    ),
)
def recovery_report(spark, d):
    notice = F.concat(F.lit("[missing image:p"), (doc() % 30).cast("string"), F.lit("]"))
    body = F.concat("body", F.when(doc() % 8 == 0, F.concat(notice, F.lit("\n"), notice)).when(doc() % 4 == 0, notice).otherwise(""))
    members = v.table(spark, d, "supplier").select(F.concat(F.lit("p"), (F.col("s_suppkey") % 13).cast("string")).alias("pointer"))
    return r.recovery_report(v.notes(spark, d).select("note_id", body.alias("body")), members)


@query("J8_attach_library_to_notes", v.with_sql(v.DOC_NOTES, "SELECT note_id, 'img' || s_suppkey AS file FROM nt JOIN supplier ON conv_id = 'c' || (s_suppkey % 50) WHERE NOT contains(body || CASE WHEN doc_id % 2 = 0 THEN ' img7' ELSE '' END, 'img' || s_suppkey)"))
def attach_library_to_notes(spark, d):
    key = F.col("s_suppkey")
    library = v.table(spark, d, "supplier").select(F.concat(F.lit("c"), (key % 50).cast("string")).alias("conv_id"), F.concat(F.lit("img"), key.cast("string")).alias("file"))
    return r.attach_library_to_notes(v.notes(spark, d).withColumn("body", F.concat("body", F.when(doc() % 2 == 0, " img7").otherwise(""))), library)


@query(
    "J9_complete_metadata",
    "WITH f AS (SELECT md5(text) AS sha1, max(lang) AS g, max(source) AS m FROM documents WHERE doc_id % 2 = 0 GROUP BY 1) "
    "SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN 'own' END, g) AS generator, m AS model, true AS is_edit FROM documents LEFT JOIN f ON f.sha1 = md5(text)",
)
def complete_metadata(spark, d):
    docs = v.table(spark, d, "documents")
    none = F.lit(None).cast("string")
    manifest = docs.select("doc_id", F.md5("text").alias("sha1"), F.when(doc() % 3 == 0, "own").alias("generator"), none.alias("model"), F.lit(True).alias("is_edit"))
    found = docs.where("doc_id % 2 = 0").select(F.md5("text").alias("sha1"), F.col("lang").alias("generator"), F.col("source").alias("model"), F.lit(False).alias("is_edit"))
    return r.complete_metadata(manifest, found).drop("sha1")


@query("J10_relink", v.with_sql(v.DOC_NOTES, "SELECT note_id, body || ' ![a](' || CASE WHEN doc_id % 20 < 10 THEN 'new/' || (doc_id % 20) ELSE 'old/' || (doc_id % 20) END || ') [[old/1]] [b](x)' AS body, (doc_id % 20 < 10)::BIGINT AS rewritten FROM nt"))
def relink(spark, d):
    k = (doc() % 20).cast("string")
    notes = v.notes(spark, d).select("note_id", F.concat("body", F.lit(" ![a](old/"), k, F.lit(") [[old/1]] [b](x)")).alias("body"))
    moves = v.notes(spark, d).where("doc_id % 20 < 10").select(F.concat(F.lit("old/"), k).alias("old"), F.concat(F.lit("new/"), k).alias("new")).distinct()
    return r.relink(notes, moves)


#: Notes to be made anew: every fourth has no conversation and is found by title and day, some of these in no manifest. Of a conversation two
#: versions are made of each text, of which one or the other is nearer, or the text itself, or another text only.
REGENERATED = r"""jn AS (SELECT note_id, conv_id, title, strftime(date, '%Y-%m-%d') AS day, doc_id, body FROM nt),
ja AS (SELECT note_id, conv_id, title, day, body || chr(10) || '![](' || doc_id % 5 || '.png)' || chr(10) || '[missing image:p]' AS body FROM jn),
jm AS (SELECT DISTINCT coalesce(conv_id, 'd' || doc_id % 20) AS conv_id, title, day FROM jn WHERE doc_id % 8 <> 4),
jr AS (
  SELECT note_id || '-a' AS other, coalesce(conv_id, 'd' || doc_id % 20) AS conv_id, body || chr(10) || '![](' || doc_id % 3 || '.png)' || chr(10) || '![](q.png)' AS body FROM jn WHERE doc_id % 7 <> 1
  UNION ALL SELECT note_id || '-b', coalesce(conv_id, 'd' || doc_id % 20), body || chr(10) || '![](9.png)' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '[missing image:p]' ELSE '![](q.png)' END FROM jn WHERE doc_id % 7 <> 1
  UNION ALL SELECT note_id || '-c', conv_id, body FROM ja WHERE note_id::INT % 6 = 1 AND note_id::INT % 7 <> 1),
jc AS (SELECT a.*, a.conv_id AS of FROM ja a WHERE conv_id IS NOT NULL UNION ALL SELECT a.*, m.conv_id FROM ja a JOIN jm m ON a.title = m.title AND a.day IS NOT DISTINCT FROM m.day WHERE a.conv_id IS NULL),
jk AS (SELECT DISTINCT note_id FROM jc JOIN jr ON jc.of = jr.conv_id),
jp AS (
  SELECT c.note_id, r.other, r.body = c.body AS same, len(list_intersect(list_distinct(string_split(c.body, chr(10))), list_distinct(string_split(r.body, chr(10))))) AS shared
  FROM jc c JOIN jr r ON c.of = r.conv_id AND regexp_replace(c.body, '!\[[^\]]*\]\([^)]*\)|\[missing image:([^\]]+)\]', '#', 'g') = regexp_replace(r.body, '!\[[^\]]*\]\([^)]*\)|\[missing image:([^\]]+)\]', '#', 'g')),
jb AS (SELECT note_id, other, same, shared FROM jp QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY shared DESC, other DESC) = 1),
jo AS (SELECT note_id, CASE WHEN jk.note_id IS NULL THEN 'no export' WHEN other IS NULL THEN 'no exact version' WHEN same THEN 'faithful' ELSE 'regenerated' END AS outcome, other AS best, shared
  FROM jn LEFT JOIN jk USING (note_id) LEFT JOIN jb USING (note_id))"""


def regeneration(spark, d):
    k = doc()
    n = v.notes(spark, d).select("note_id", "conv_id", "title", F.date_format("date", "yyyy-MM-dd").alias("date"), "body", "doc_id")
    own = F.coalesce("conv_id", F.concat(F.lit("d"), (k % 20).cast("string")))
    line = lambda c: F.concat(F.lit("\n![]("), c, F.lit(".png)"))
    asked = n.withColumn("body", F.concat("body", line((k % 5).cast("string")), F.lit("\n[missing image:p]")))
    some = n.where("doc_id % 7 <> 1")
    made = lambda name, conv, body, rows: rows.select(F.concat("note_id", F.lit(name)).alias("note_id"), conv.alias("conv_id"), body.alias("body"))
    again = made("-a", own, F.concat("body", line((k % 3).cast("string")), line(F.lit("q"))), some)
    again = again.unionByName(made("-b", own, F.concat("body", line(F.lit("9")), F.when(k % 2 == 0, "\n[missing image:p]").otherwise("\n![](q.png)")), some))
    again = again.unionByName(made("-c", F.col("conv_id"), F.col("body"), asked.where("doc_id % 6 = 1 and doc_id % 7 <> 1")))
    return r.match_regenerated(asked, again, n.where("doc_id % 8 <> 4").select(own.alias("conv_id"), "title", "date"))


@query("J11_match_regenerated", v.with_sql(v.DOC_NOTES, REGENERATED, "SELECT note_id, outcome, best, shared::BIGINT AS shared FROM jo"))
def match_regenerated(spark, d):
    return regeneration(spark, d).withColumn("shared", F.col("shared").cast("long"))


@query("J11_regeneration_report", v.with_sql(v.DOC_NOTES, REGENERATED, "SELECT outcome, count(*) AS notes FROM jo GROUP BY 1"))
def regeneration_report(spark, d):
    return r.regeneration_report(regeneration(spark, d))


@query(
    "J12_verify_copy",
    "SELECT doc_id AS path, CASE doc_id % 8 WHEN 0 THEN 'missing' WHEN 1 THEN 'extra' WHEN 2 THEN 'size' WHEN 3 THEN 'content' ELSE 'time' END AS problem FROM documents WHERE doc_id % 8 < 5",
)
def verify_copy(spark, d):
    k = doc() % 8
    docs = v.table(spark, d, "documents").select(doc().alias("path"), F.col("n_chars").alias("bytes"), F.md5("text").alias("sha1"), F.lit(100).alias("mtime"), k.alias("k"))
    target = docs.where("k <> 0").withColumns({"bytes": F.col("bytes") + (F.col("k") == 2).cast("int"), "sha1": F.concat("sha1", F.when(F.col("k") == 3, "x").otherwise("")), "mtime": F.col("mtime") + F.when(F.col("k") == 4, 9).otherwise(1)})
    return r.verify_copy(docs.where("k <> 1"), target)
