"""Queries of threads, turns and branch resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from convarchive.operators import threads as t
from convarchive.plans import derived as v
from convarchive.plans.registry import query

WALK = """kn AS (SELECT lf.* FROM lf WHERE conv_id IN (SELECT conv_id FROM so) AND EXISTS (SELECT 1 FROM nd WHERE nd.conv_id = lf.conv_id AND nd.node_id = lf.leaf_id)),
up AS (SELECT conv_id, leaf_id AS node_id, 0 AS k FROM kn UNION ALL SELECT up.conv_id, nd.parent_id, k + 1 FROM up JOIN nd USING (conv_id, node_id) WHERE nd.parent_id IS NOT NULL),
th AS (
  SELECT conv_id, node_id, max(k) OVER (PARTITION BY conv_id) - k AS pos FROM up
  UNION ALL SELECT conv_id, node_id, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN conv_id IN (SELECT conv_id FROM so) THEN created ELSE 0 END, pos) - 1 FROM nd WHERE conv_id NOT IN (SELECT conv_id FROM kn))"""
TIPS = """ti AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY created DESC, pos) AS nth FROM nd n WHERE NOT EXISTS (SELECT 1 FROM nd c WHERE c.conv_id = n.conv_id AND c.parent_id = n.node_id)),
la AS (SELECT conv_id, node_id AS leaf_id FROM ti WHERE nth = 1 AND conv_id IN (SELECT conv_id FROM so))"""


@query("C1_resolve_thread", v.with_sql(v.NODES, v.LEAVES, WALK, "SELECT conv_id, node_id, pos::INT AS pos FROM th", recursive=True))
def resolve_thread(spark, d):
    """C2 as well: each fifth conversation has no leaf, each seventh an unknown one."""
    return t.resolve_thread(v.nodes(spark, d), v.stated_leaves(spark, d))


@query("C2_thread_by_time", v.with_sql(v.NODES, "SELECT conv_id, node_id, (row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN conv_id IN (SELECT conv_id FROM so) THEN created ELSE 0 END, pos) - 1)::INT AS pos FROM nd"))
def thread_by_time(spark, d):
    nodes = v.nodes(spark, d)
    return t.resolve_thread(nodes, v.stated_leaves(spark, d).where("false"))


@query("C3_latest_leaf", v.with_sql(v.NODES, TIPS, "SELECT * FROM la"))
def latest_leaf(spark, d):
    return t.latest_leaves(v.nodes(spark, d))


@query(
    "C4_stated_or_latest_leaf",
    v.with_sql(v.NODES, v.LEAVES, TIPS, "SELECT conv_id, coalesce(lf.leaf_id, la.leaf_id) AS leaf_id FROM la LEFT JOIN (SELECT * FROM lf WHERE leaf_id <> 'nowhere') lf USING (conv_id)"),
)
def stated_or_latest_leaf(spark, d):
    return t.latest_leaves(v.nodes(spark, d), v.stated_leaves(spark, d))


@query(
    "C5_flat_thread",
    "SELECT 'u' || (user_id % 50) AS title, min(ts) AS created, max(ts) AS updated, count(*) AS messages, string_agg(event_type, ',' ORDER BY event_id) AS roles FROM events WHERE event_id % 6 <> 0 GROUP BY 1",
)
def flat_thread(spark, d):
    rows = v.table(spark, d, "events").select(
        F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string")).alias("title"), F.col("ts").alias("time"), F.col("event_type").alias("role"),
        F.when(F.col("event_id") % 6 == 0, " \n").otherwise(F.col("props")).alias("content"), F.col("event_id").alias("pos"),
    )
    return t.flat_thread(rows)


@query("C6_drop_empty", "SELECT conv_id, count(*) AS messages FROM conversations WHERE turn % 2 = 1 AND conv_id % 9 <> 0 GROUP BY 1")
def drop_empty(spark, d):
    c = v.table(spark, d, "conversations")
    blank = c.withColumn("content", F.when((F.col("turn") % 2 == 0) | (F.col("conv_id") % 9 == 0), " \t").otherwise(F.col("text")))
    convs, said = t.drop_empty(c.select("conv_id").distinct(), blank)
    return convs.join(said.groupBy("conv_id").agg(F.count("*").alias("messages")), "conv_id")


@query(
    "C7_normalize_role",
    "SELECT role, count(*) AS n FROM (SELECT CASE (conv_id + turn) % 4 WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' WHEN 2 THEN 'critic' ELSE lower(role) END AS role FROM conversations) GROUP BY 1",
)
def normalize_role(spark, d):
    from convarchive.functions.text import normalize_role

    raw = F.when((F.col("conv_id") + F.col("turn")) % 4 == 0, "Human").when((F.col("conv_id") + F.col("turn")) % 4 == 1, "AI").when((F.col("conv_id") + F.col("turn")) % 4 == 2, "Critic").otherwise(F.upper("role"))
    return v.table(spark, d, "conversations").select(normalize_role(raw).alias("role")).groupBy("role").agg(F.count("*").alias("n"))


@query(
    "C8_dominant_model",
    "WITH c AS (SELECT user_id AS conv_id, event_type AS model, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1, 2) "
    "SELECT conv_id, model, n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, model) AS k FROM c) WHERE k = 1",
)
def dominant_model(spark, d):
    e = v.table(spark, d, "events")
    return t.dominant_model(e.select(F.col("user_id").alias("conv_id"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("model")))


ISLANDS = """ke AS (SELECT * FROM {0} WHERE kind IN ('human', 'text', 'tool', 'thinking') AND NOT is_side),
il AS (SELECT *, sum((kind = 'human')::INT) OVER (PARTITION BY session_id ORDER BY line_no) AS island FROM ke),
tn AS (
  SELECT session_id, island, kind = 'human' AS is_user, min(ts) AS started, min(line_no) AS first_line,
    coalesce(string_agg(text, chr(10) || chr(10) ORDER BY line_no) FILTER (WHERE kind IN ('human', 'text')), '') AS text,
    count_if(kind = 'thinking')::BIGINT AS thoughts, count_if(kind = 'tool')::BIGINT AS tools
  FROM il WHERE island > 0 GROUP BY ALL),
tu AS (SELECT session_id, (row_number() OVER (PARTITION BY session_id ORDER BY first_line))::INT AS turn, CASE WHEN is_user THEN 'user' ELSE 'assistant' END AS role, started, text, thoughts, tools FROM tn)"""


@query("C9_agent_turns", v.with_sql(v.EVENTS, ISLANDS.format("se"), "SELECT * FROM tu"))
def agent_turns(spark, d):
    return t.agent_turns(v.session_events(spark, d))


CODEX = """cx AS (
  SELECT session_id, line_no, ts, false AS is_side, text,
    CASE WHEN kind = 'human' THEN 'human' WHEN kind = 'text' THEN 'text' WHEN kind = 'tool' THEN 'tool' END AS kind FROM se)"""


def _codex_lines(spark, d):
    e = v.session_events(spark, d)
    kind = F.col("kind")
    return e.select(
        "session_id", "line_no", "ts", F.when(kind.isin("human", "noise"), "event_msg").otherwise("response_item").alias("type"),
        F.when(kind == "human", "user_message").when(kind == "noise", "agent_message").when(kind == "text", "assistant").when(kind == "tool", "function_call").otherwise("developer").alias("subtype"), "text",
    )


@query("C10_codex_turns", v.with_sql(v.EVENTS, CODEX, ISLANDS.format("cx"), "SELECT * FROM tu"))
def codex_turns(spark, d):
    return t.agent_turns(t.codex_events(_codex_lines(spark, d)))


CALLS = """ca AS (SELECT session_id, line_no, 'k' || (event_id % 13) AS call_id, text FROM se WHERE kind = 'tool'),
rs AS (SELECT session_id, 'k' || (event_id % 17) AS call_id, arg_max(text, line_no) AS result FROM se WHERE kind = 'text' GROUP BY 1, 2)"""


def _calls(spark, d):
    e = v.session_events(spark, d)
    return e.where("kind = 'tool'").select("session_id", "line_no", F.concat(F.lit("k"), (F.col("event_id") % 13).cast("string")).alias("call_id"), "text")


@query("C11_join_tool_results", v.with_sql(v.EVENTS, CALLS, "SELECT session_id, line_no::INT AS line_no, call_id, text, result FROM ca LEFT JOIN rs USING (session_id, call_id)"))
def join_tool_results(spark, d):
    e = v.session_events(spark, d)
    results = e.where("kind = 'text'").select("session_id", "line_no", F.concat(F.lit("k"), (F.col("event_id") % 17).cast("string")).alias("call_id"), F.col("text").alias("result"))
    return t.join_tool_results(_calls(spark, d), results)


HEADER = """he AS (
  SELECT session_id, arg_min(cwd, line_no) FILTER (WHERE cwd IS NOT NULL) AS cwd, arg_min(branch, line_no) FILTER (WHERE branch IS NOT NULL) AS branch,
    arg_min(title, line_no) FILTER (WHERE title IS NOT NULL) AS title, min(ts) AS started, max(ts) AS ended FROM se GROUP BY 1)"""


@query("C12_session_header", v.with_sql(v.EVENTS, HEADER, "SELECT * FROM he"))
def session_header(spark, d):
    return t.session_header(v.session_events(spark, d))


@query(
    "C13_session_title",
    r"""WITH c AS (SELECT conv_id, arg_min(text, turn) AS prompt FROM conversations GROUP BY 1),
l AS (SELECT conv_id, regexp_replace(string_split(regexp_replace(prompt, '^\s+|\s+$', '', 'g'), chr(10))[1], '^\s+|\s+$', '', 'g') AS line FROM c)
SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN 'Title ' || conv_id WHEN length(line) > 70 THEN substr(line, 1, 70) || '…' WHEN line <> '' THEN line ELSE 'session' END AS title FROM l""",
)
def session_title(spark, d):
    first = v.table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("prompt"))
    title = F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit(" Title "), F.col("conv_id").cast("string")))
    return first.select("conv_id", t.session_title(title, F.col("prompt")).alias("title"))


@query(
    "C14_session_notes",
    v.with_sql(
        v.EVENTS, ISLANDS.format("se"),
        "an AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS answer FROM tu WHERE role = 'assistant')",
        "SELECT session_id, 'parent' AS note, turn, NULL::INT AS answer, length(text)::INT AS size FROM tu UNION ALL SELECT session_id, 'reasoning', turn, answer, thoughts FROM an WHERE thoughts > 0 "
        "UNION ALL SELECT a.session_id, 'tools', a.turn, answer, 2000 FROM an a",
    ),
)
def session_notes(spark, d):
    turns = t.agent_turns(v.session_events(spark, d))
    calls = turns.where("role = 'assistant'").select("session_id", "turn", F.repeat(F.lit("r"), F.lit(3000)).alias("result"))
    notes = t.session_notes(turns, calls)
    none = F.lit(None).cast("int").alias("answer")
    return (
        notes["parent"].select("session_id", F.lit("parent").alias("note"), "turn", none, F.length("text").alias("size"))
        .unionByName(notes["reasoning"].select("session_id", F.lit("reasoning").alias("note"), "turn", "answer", F.col("thoughts").cast("int").alias("size")))
        .unionByName(notes["tools"].select("session_id", F.lit("tools").alias("note"), "turn", "answer", F.length("result").alias("size")))
    )


INSTRUCTIONS = """i AS (SELECT user_id AS conv_id, event_id AS pos, CASE WHEN event_id % 3 > 0 THEN 'p' || (event_id // 200 % 3) END AS profile, CASE WHEN event_id % 7 = 3 THEN event_type END AS instructions FROM events),
s AS (SELECT *, coalesce(max((instructions IS NOT NULL)::INT) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_seen FROM i WHERE profile IS NOT NULL OR instructions IS NOT NULL),
u AS (SELECT *, lag(profile) OVER w AS bp, lag(instructions) OVER w AS bi, lag(pos) OVER w AS bpos FROM s WHERE instructions IS NOT NULL OR full_seen = 0 WINDOW w AS (PARTITION BY conv_id ORDER BY pos))"""


@query(
    "C15_instruction_changes",
    v.with_sql(
        INSTRUCTIONS,
        "SELECT conv_id, pos, CASE WHEN bpos IS NULL THEN 'first' WHEN instructions IS NOT NULL AND bp IS NOT NULL AND bi IS NULL AND bp = profile THEN 'completed' ELSE 'changed' END AS event, profile, instructions "
        "FROM u WHERE bpos IS NULL OR profile IS DISTINCT FROM bp OR instructions IS DISTINCT FROM bi",
    ),
)
def instruction_changes(spark, d):
    e = v.table(spark, d, "events")
    profile = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("p"), (F.floor(F.col("event_id") / 200) % 3).cast("string")))
    return t.instruction_changes(e.select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("pos"), profile.alias("profile"), F.when(F.col("event_id") % 7 == 3, F.col("event_type")).alias("instructions")))


@query(
    "C16_attach_recap",
    "WITH m AS (SELECT user_id AS conv_id, event_id AS pos, CASE event_type WHEN 'view' THEN 'reasoning' WHEN 'click' THEN 'recap' ELSE 'text' END AS kind, props AS content FROM events), "
    "l AS (SELECT *, lead(kind) OVER w AS nk, lead(content) OVER w AS nc, lag(kind) OVER w AS lk FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY pos)) "
    "SELECT conv_id, pos, kind, content, CASE WHEN kind = 'reasoning' AND nk = 'recap' THEN nc END AS recap FROM l WHERE NOT (kind = 'recap' AND coalesce(lk = 'reasoning', false))",
)
def attach_recap(spark, d):
    kind = F.when(F.col("event_type") == "view", "reasoning").when(F.col("event_type") == "click", "recap").otherwise("text")
    return t.attach_recap(v.table(spark, d, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("pos"), kind.alias("kind"), F.col("props").alias("content")))


@query(
    "C17_fold_artifacts",
    """WITH RECURSIVE o AS (
  SELECT user_id AS conv_id, event_id % 3 AS artifact_id, row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY event_id) AS k,
    CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'rewrite' ELSE 'update' END AS command, 'x = ' || event_id || '; 5 1' AS content, (event_id % 10)::VARCHAR AS old_str, '<' || event_type || '>' AS new_str FROM events),
f AS (
  SELECT conv_id, artifact_id, 0::BIGINT AS k, NULL::VARCHAR AS text FROM (SELECT DISTINCT conv_id, artifact_id FROM o)
  UNION ALL SELECT f.conv_id, f.artifact_id, o.k, CASE WHEN command <> 'update' THEN content WHEN strpos(text, old_str) > 0
    THEN substr(text, 1, strpos(text, old_str) - 1) || new_str || substr(text, strpos(text, old_str) + length(old_str)) ELSE text END
  FROM f JOIN o ON o.conv_id = f.conv_id AND o.artifact_id = f.artifact_id AND o.k = f.k + 1)
SELECT conv_id, artifact_id, arg_max(text, k) AS content, max(k)::INT AS operations FROM f GROUP BY 1, 2 HAVING count(text) > 0""",
)
def fold_artifacts(spark, d):
    command = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "rewrite").otherwise("update")
    return t.fold_artifacts(
        v.table(spark, d, "events").select(
            F.col("user_id").alias("conv_id"), (F.col("event_id") % 3).alias("artifact_id"), F.col("event_id").alias("pos"), command.alias("command"),
            F.concat(F.lit("x = "), F.col("event_id").cast("string"), F.lit("; 5 1")).alias("content"), (F.col("event_id") % 10).cast("string").alias("old_str"),
            F.concat(F.lit("<"), F.col("event_type"), F.lit(">")).alias("new_str"),
        )
    )


@query(
    "C18_reverse_blocks",
    "WITH b AS (SELECT conv_id, turn AS pos, role, sum((lower(role) = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS block FROM conversations) "
    "SELECT conv_id, pos, role, block::BIGINT AS block, (row_number() OVER (PARTITION BY conv_id ORDER BY block DESC, pos))::INT AS new_pos FROM b",
)
def reverse_blocks(spark, d):
    return t.reverse_blocks(v.table(spark, d, "conversations").select("conv_id", F.col("turn").alias("pos"), "role"))


@query(
    "C19_transcribe",
    "SELECT user_id AS conv_id, event_id AS pos, CASE event_type WHEN 'view' THEN 'user' WHEN 'click' THEN 'user' WHEN 'purchase' THEN 'assistant' ELSE 'tool' END AS role, "
    "CASE event_type WHEN 'signup' THEN '[tool' || (event_id % 3) || ']' ELSE props END AS content FROM events WHERE event_type <> 'error'",
)
def transcribe(spark, d):
    kinds = F.create_map(*map(F.lit, ["view", "user-prompt", "click", "retry-prompt", "purchase", "text", "signup", "tool-call", "error", "other"]))
    rows = v.table(spark, d, "events").select(
        F.col("user_id").alias("conv_id"), F.col("event_id").alias("pos"), kinds[F.col("event_type")].alias("part_kind"), F.col("props").alias("content"), F.concat(F.lit("tool"), (F.col("event_id") % 3).cast("string")).alias("tool_name")
    )
    return t.transcribe(rows)
