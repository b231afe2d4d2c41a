"""Archive-shaped tables that Spark derives from the test tables, and the same as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convarchive.sources.shared import new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession) -> str:
    """A new folder under the session's checkpoint directory, which driver and executors share."""
    return new_folder(spark)


def with_sql(*parts: str, recursive: bool = False) -> str:
    """``WITH`` of some parts and a final select."""
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(parts[:-1]) + "\n" + parts[-1]


# Three exported versions of each conversation: A lacks the last turn, B is whole, C has the even turns and one of its own.


def version_messages(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    note = lambda v: F.concat(F.col("conv_id").cast("string"), F.lit(f"-{v}")).alias("note_id")
    one = lambda df, v, pos, content: df.select("conv_id", note(v), pos.alias("pos"), "role", content.alias("content"))
    turn, text = F.col("turn"), F.col("text")
    a = one(c.withColumn("last", last).where("turn < last"), "A", turn, text)
    even = one(c.where("turn % 2 = 0"), "C", turn, text)
    own = one(c.where("turn = 0"), "C", F.lit(1000).cast("long"), F.concat(text, F.lit(" v2")))
    return a.unionByName(one(c, "B", turn, text)).unionByName(even).unionByName(own)


MESSAGES = """vm AS (
  SELECT conv_id, conv_id || '-A' AS note_id, turn AS pos, role, text AS content FROM conversations c
  WHERE turn < (SELECT max(turn) FROM conversations x WHERE x.conv_id = c.conv_id)
  UNION ALL SELECT conv_id, conv_id || '-B', turn, role, text FROM conversations
  UNION ALL SELECT conv_id, conv_id || '-C', turn, role, text FROM conversations WHERE turn % 2 = 0
  UNION ALL SELECT conv_id, conv_id || '-C', 1000, role, text || ' v2' FROM conversations WHERE turn = 0)"""


def version_notes(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "conversations").select("conv_id").distinct()
    v = ids.select("conv_id", F.explode(F.array(*[F.struct(F.lit(n).alias("ver"), F.lit(i).alias("mtime")) for i, n in enumerate("ABC", 1)])).alias("v")).select("conv_id", "v.*")
    key = F.col("conv_id").cast("string")
    title = F.concat(F.when((F.col("ver") == "A") & (F.col("conv_id") % 7 == 0), "Old title ").otherwise("Title "), key)
    v = v.withColumns({"note_id": F.concat(key, F.lit("-"), F.col("ver")), "group_key": F.concat(F.lit("id:"), key), "title": title})
    return v.withColumns(
        {
            "path": F.concat("note_id", F.lit(".md")),
            "base_name": F.concat(F.lit("2024-01-01_"), F.replace(F.lower("title"), F.lit(" "), F.lit("-"))),
            "source": F.concat(F.when(F.col("conv_id") % 2 == 0, "chatgpt").otherwise("claude"), F.when(F.col("ver") == "B", "_merged").otherwise("")),
        }
    )


NOTES = """vn AS (
  SELECT *, conv_id || '-' || ver AS note_id, 'id:' || conv_id AS group_key, conv_id || '-' || ver || '.md' AS path,
    '2024-01-01_' || replace(lower(title), ' ', '-') AS base_name,
    CASE WHEN conv_id % 2 = 0 THEN 'chatgpt' ELSE 'claude' END || CASE WHEN ver = 'B' THEN '_merged' ELSE '' END AS source
  FROM (SELECT conv_id, ver, mtime, CASE WHEN ver = 'A' AND conv_id % 7 = 0 THEN 'Old title ' ELSE 'Title ' END || conv_id AS title
    FROM (SELECT DISTINCT conv_id FROM conversations), (VALUES ('A', 1), ('B', 2), ('C', 3)) AS v(ver, mtime)))"""

WORDS = r"len(list_filter(regexp_split_to_array({0}, '\s+'), lambda t: t <> ''))"
COLLAPSED = r"regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"
FINGERPRINT = f"sha1(lower(role) || '::' || {COLLAPSED.format('content')})"

RANKED = f"""rk AS (
  SELECT n.*, coalesce(w, 0) AS words, coalesce(b, 0) AS bytes, row_number() OVER (PARTITION BY group_key ORDER BY coalesce(w, 0) DESC, coalesce(b, 0) DESC, path) AS rank
  FROM vn n LEFT JOIN (SELECT note_id, sum({WORDS.format('content')})::BIGINT AS w, sum(length(content))::BIGINT AS b FROM vm GROUP BY 1) USING (note_id))"""

MERGED = f"""pl AS (SELECT m.*, group_key, rank, {FINGERPRINT} AS fp FROM vm m JOIN rk USING (note_id)),
mg AS (
  SELECT group_key, rank, pos, role, content, false AS recovered FROM pl WHERE rank = 1
  UNION ALL SELECT group_key, rank, pos, role, content, true FROM (
    SELECT *, row_number() OVER (PARTITION BY group_key, fp ORDER BY rank, pos) AS nth FROM pl p
    WHERE rank > 1 AND NOT EXISTS (SELECT 1 FROM pl q WHERE q.rank = 1 AND q.group_key = p.group_key AND q.fp = p.fp)) WHERE nth = 1),
me AS (SELECT group_key, row_number() OVER (PARTITION BY group_key ORDER BY recovered, rank, pos) AS pos, role, content, recovered FROM mg)"""

# Notes: one of each document. Project, provider and date are missing here and there.


def notes(spark: SparkSession, d: str) -> DataFrame:
    doc = F.col("doc_id")
    return table(spark, d, "documents").select(
        doc.cast("string").alias("note_id"),
        F.when(doc % 4 != 0, F.concat(F.lit("c"), (doc % 50).cast("string"))).alias("conv_id"),
        F.get(F.array(F.lit("chatgpt"), F.lit("claude"), F.lit("grok"), F.lit(None)), (doc % 4).cast("int")).alias("provider"),
        F.when(doc % 3 == 0, "none").when(doc % 5 == 0, None).otherwise(F.col("source")).alias("project"),
        F.when(doc % 11 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (doc % 365).cast("int"))).alias("date"),
        F.concat(F.lit("Note "), (doc % 97).cast("string")).alias("title"),
        F.col("lang").alias("lang"),
        F.col("text").alias("body"),
        F.length("text").cast("long").alias("bytes"),
        doc.alias("doc_id"),
    )


DOC_NOTES = """nt AS (
  SELECT doc_id::VARCHAR AS note_id, CASE WHEN doc_id % 4 <> 0 THEN 'c' || (doc_id % 50) END AS conv_id,
    CASE doc_id % 4 WHEN 0 THEN 'chatgpt' WHEN 1 THEN 'claude' WHEN 2 THEN 'grok' END AS provider,
    CASE WHEN doc_id % 3 = 0 THEN 'none' WHEN doc_id % 5 = 0 THEN NULL ELSE source END AS project,
    CASE WHEN doc_id % 11 <> 0 THEN DATE '2024-01-01' + (doc_id % 365)::INT END AS date,
    'Note ' || (doc_id % 97) AS title, lang, text AS body, length(text)::BIGINT AS bytes, doc_id
  FROM documents)"""

# A message tree of each conversation: turn n answers turn n - 1, and every third turn has a discarded sibling.
# Some conversations have a node id twice, others a node without an id.


def nodes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    parent = F.when(F.col("turn") > 0, (F.col("turn") - 1).cast("string"))
    main = c.select("conv_id", F.col("turn").cast("string").alias("node_id"), parent.alias("parent_id"), F.col("turn").alias("pos"), (F.col("turn") * 10).alias("created"), "role", F.col("text").alias("content"))
    side = c.where("turn % 3 = 2").select("conv_id", F.concat(F.lit("x"), F.col("turn").cast("string")).alias("node_id"), parent.alias("parent_id"), (F.col("turn") + 500).alias("pos"), (F.col("turn") * 10 - 5).alias("created"), "role", F.concat(F.lit("discarded "), F.col("text")).alias("content"))
    odd = c.where("turn = 0 and (conv_id % 11 = 3 or conv_id % 13 = 4)")
    odd = odd.select("conv_id", F.when(F.col("conv_id") % 11 == 3, "0").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), (F.col("turn") + 900).alias("pos"), (F.col("turn") + 1).alias("created"), "role", F.col("text").alias("content"))
    return main.unionByName(side).unionByName(odd)


NODES = """nd AS (
  SELECT conv_id, turn::VARCHAR AS node_id, CASE WHEN turn > 0 THEN (turn - 1)::VARCHAR END AS parent_id, turn AS pos, turn * 10 AS created, role, text AS content FROM conversations
  UNION ALL SELECT conv_id, 'x' || turn, CASE WHEN turn > 0 THEN (turn - 1)::VARCHAR END, turn + 500, turn * 10 - 5, role, 'discarded ' || text FROM conversations WHERE turn % 3 = 2
  UNION ALL SELECT conv_id, CASE WHEN conv_id % 11 = 3 THEN '0' END, NULL, 900, 1, role, text FROM conversations WHERE turn = 0 AND (conv_id % 11 = 3 OR conv_id % 13 = 4)),
so AS (SELECT conv_id FROM nd GROUP BY conv_id HAVING count(*) = count(DISTINCT node_id))"""


def stated_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Every conversation but each fifth states its leaf; each seventh states one that doesn't exist."""
    last = table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").cast("string").alias("leaf"))
    return last.where("conv_id % 5 <> 0").select("conv_id", F.when(F.col("conv_id") % 7 == 0, "nowhere").otherwise(F.col("leaf")).alias("leaf_id"))


LEAVES = """lf AS (
  SELECT conv_id, CASE WHEN conv_id % 7 = 0 THEN 'nowhere' ELSE max(turn)::VARCHAR END AS leaf_id FROM conversations WHERE conv_id % 5 <> 0 GROUP BY conv_id)"""

# Agent events: a user's events are a session, sign-ups are prompts.


def session_events(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.get(F.array(*map(F.lit, ["text", "tool", "thinking", "noise"])), (F.col("event_id") % 4).cast("int"))
    return table(spark, d, "events").select(
        F.col("user_id").alias("session_id"),
        F.row_number().over(w).alias("line_no"),
        "ts",
        F.when(F.col("event_type") == "signup", "human").otherwise(kind).alias("kind"),
        (F.col("event_id") % 10 == 0).alias("is_side"),
        F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("text"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("/home/"), F.col("event_type"))).alias("cwd"),
        F.when(F.col("event_id") % 5 == 0, F.col("event_type")).alias("branch"),
        F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("T"), F.col("event_id").cast("string"))).alias("title"),
        "event_id",
    )


EVENTS = """se AS (
  SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line_no, ts,
    CASE WHEN event_type = 'signup' THEN 'human' ELSE CASE event_id % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'tool' WHEN 2 THEN 'thinking' ELSE 'noise' END END AS kind,
    event_id % 10 = 0 AS is_side, event_type || ' ' || event_id AS text,
    CASE WHEN event_id % 3 = 0 THEN '/home/' || event_type END AS cwd, CASE WHEN event_id % 5 = 0 THEN event_type END AS branch,
    CASE WHEN event_id % 7 = 0 THEN 'T' || event_id END AS title, event_id FROM events)"""
