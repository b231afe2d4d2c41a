"""Queries of the streaming forms: drops of the test tables are streamed until none is left."""

from __future__ import annotations

from pyspark.sql import functions as F

from convarchive.plans import derived as v
from convarchive.plans.derived import shared
from convarchive.plans.registry import query
from convarchive.streaming import streams as o


def parts_of(df, least, rows):
    """How many files of so many rows a drop takes, so that no task grows with the input."""
    return max(least, -(-df.count() // rows))


def streamed(spark, df):
    """``df`` dropped as Parquet files in four parts, and read as a stream."""
    path = f"{shared(spark)}/drop"
    df.repartition(4).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def ran(spark, stream):
    root = shared(spark)
    o.run_available(stream, f"{root}/out", f"{root}/check")
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


@query("O1_stream_exports", r"SELECT 'b' || (doc_id % 40) AS base, count(DISTINCT regexp_replace(text, '^\s+|\s+$', '', 'g')) AS versions FROM documents GROUP BY 1")
def stream_exports(spark, d):
    root = shared(spark)
    rows = v.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("note_id"), F.concat(F.lit("b"), (F.col("doc_id") % 40).cast("string")).alias("base"), F.col("text").alias("body"))
    for k in (0, 1):  # a second drop repeats all of the first
        drop = rows.where(F.col("note_id").cast("long") % 2 <= k)
        parts = parts_of(drop, 3, o.FILE_ROWS)
        drop.repartition(parts).write.mode("append").json(f"{root}/in")
        # two batches a drop
        o.stream_exports(spark, f"{root}/in", "note_id string, base string, body string", f"{root}/store", f"{root}/check", -(-parts // 2)).awaitTermination()
        o.compact_store(spark, f"{root}/store")
    return o.read_store(spark, f"{root}/store").groupBy("base").agg(F.count("*").alias("versions"))


@query("O2_stream_dedup", f"SELECT conv_id AS group_key, sha1(lower(role) || '::' || {v.COLLAPSED.format('text')}) AS fp FROM conversations GROUP BY ALL")
def stream_dedup(spark, d):
    c = v.table(spark, d, "conversations").select(F.col("conv_id").alias("group_key"), F.timestamp_seconds(F.col("turn") + 1_700_000_000).alias("ts"), "role", F.col("text").alias("content"))
    return ran(spark, o.stream_dedup(streamed(spark, c.unionByName(c.withColumn("content", F.concat(F.lit(" "), "content")))))).select("group_key", "fp")


BURSTS = """g AS (SELECT *, lag(ts) OVER w AS before FROM se WHERE kind <> 'noise' WINDOW w AS (PARTITION BY session_id ORDER BY ts)),
b AS (SELECT *, sum((before IS NULL OR ts - before >= INTERVAL 30 MINUTE)::INT) OVER (PARTITION BY session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
bu AS (
  SELECT session_id, k, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS events, count_if(kind = 'human')::BIGINT AS prompts, count_if(kind = 'tool')::BIGINT AS tools FROM b GROUP BY session_id, k
  HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM se WHERE kind <> 'noise'))"""


def sessions(spark, d):
    return v.session_events(spark, d).select("session_id", F.col("ts").cast("timestamp").alias("ts"), "line_no", "kind", "text")


@query("O3_stream_bursts", v.with_sql(v.EVENTS, BURSTS, "SELECT session_id, started::VARCHAR AS started, ended::VARCHAR AS ended, events, prompts, tools FROM bu"))
def stream_bursts(spark, d):
    out = ran(spark, o.stream_turns(streamed(spark, sessions(spark, d).select("session_id", "ts", "kind"))))
    return out.withColumns({"started": F.col("started").cast("string"), "ended": F.col("ended").cast("string")})


@query(
    "O3_stream_turns",
    v.with_sql(
        v.EVENTS, BURSTS,
        "l AS (SELECT *, lag(kind) OVER (PARTITION BY session_id, k ORDER BY line_no) AS lk FROM b)",
        "t AS (SELECT *, sum((lk IS NULL OR kind = 'human' OR lk = 'human')::INT) OVER (PARTITION BY session_id, k ORDER BY line_no) AS turn FROM l)",
        "SELECT session_id, any_value(started)::VARCHAR AS started, turn::INT AS turn, CASE WHEN bool_or(kind = 'human') THEN 'user' ELSE 'assistant' END AS role, "
        "coalesce(string_agg(text, chr(10) || chr(10) ORDER BY line_no) FILTER (WHERE kind IN ('human', 'text')), '') AS text, count_if(kind = 'tool')::INT AS tools "
        "FROM t JOIN (SELECT session_id, k, started FROM bu) USING (session_id, k) GROUP BY session_id, k, turn",
    ),
)
def stream_turns(spark, d):
    out = ran(spark, o.stream_session_turns(streamed(spark, sessions(spark, d))))
    return out.withColumn("started", F.col("started").cast("string"))


AGENT_TURNS = r"""w AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE AS w FROM se WHERE kind <> 'noise' AND NOT is_side),
k AS (SELECT session_id, line_no, ts, kind, text, sum((kind = 'human')::INT) OVER (PARTITION BY session_id ORDER BY line_no) AS island FROM se, w WHERE kind <> 'noise' AND NOT is_side AND ts < w),
p AS (SELECT *, kind = 'human' AS u, lag(ts) OVER (PARTITION BY session_id, island, kind = 'human' ORDER BY line_no) AS before FROM k WHERE island > 0),
q AS (SELECT *, 1 + sum(coalesce(ts - before > INTERVAL 7 DAY, false)::INT) OVER (PARTITION BY session_id, island, u ORDER BY line_no) AS part FROM p),
t AS (
  SELECT session_id, island, u, part, min(line_no) AS l, min(ts) AS started, max(ts) AS ended, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY line_no) FILTER (WHERE kind IN ('human', 'text')), '') AS text,
    count_if(kind = 'thinking')::INT AS thoughts, count_if(kind = 'tool')::INT AS tools FROM q GROUP BY 1, 2, 3, 4),
n AS (SELECT *, dense_rank() OVER (PARTITION BY session_id ORDER BY island, u DESC) AS turn, lead(l) OVER (PARTITION BY session_id ORDER BY l) AS next FROM t)"""


@query(
    "O3_agent_turns",
    v.with_sql(
        v.EVENTS, AGENT_TURNS,
        "SELECT session_id, turn::INT AS turn, part::INT AS part, CASE WHEN u THEN 'user' ELSE 'assistant' END AS role, started::VARCHAR AS started, text, thoughts, tools FROM n, w WHERE next IS NOT NULL OR ended + INTERVAL 7 DAY < w",
    ),
)
def stream_agent_turns(spark, d):
    rows = v.session_events(spark, d).select("session_id", F.col("ts").cast("timestamp").alias("ts"), "line_no", "kind", "is_side", "text")
    out = ran(spark, o.stream_agent_turns(streamed(spark, rows)))
    return out.withColumn("started", F.col("started").cast("string"))


@query(
    "O4_stream_activity",
    "SELECT strftime(ts, '%Y-%m-%d') AS day, CASE WHEN event_type = 'view' THEN 'chatgpt' ELSE event_type END AS provider, count(*) AS imports FROM events "
    "WHERE ts::DATE + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM events) GROUP BY 1, 2",
)
def stream_activity(spark, d):
    rows = v.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("provider"))
    return ran(spark, o.stream_activity(streamed(spark, rows))).withColumn("day", F.date_format("day", "yyyy-MM-dd"))
