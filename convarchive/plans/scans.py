"""Queries of readers and sinks: exports are written from the test tables to the shared folder, then read."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convarchive.operators import threads as t
from convarchive.plans import derived as v
from convarchive.plans.derived import shared
from convarchive.plans.registry import query
from convarchive.sources import readers as r
from convarchive.sources import sinks as s


def dropped(df: DataFrame, suffix: str = "json") -> str:
    """``df``'s only column as text files; returns their folder."""
    path = f"{shared(df.sparkSession)}/{suffix}"
    df.write.text(path)
    return path


#: Rows of a test table that become one JSON document.
PER_FILE = 2000


def files(parts: DataFrame) -> str:
    """``parts(k, value)`` as one text file each; returns a pattern of their folders."""
    path = f"{shared(parts.sparkSession)}/json"
    parts.write.partitionBy("k").text(path)
    return f"{path}/*"


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with the number ``k`` of their file: files grow in number, not in size."""
    return rows.withColumn("k", F.pmod(key, F.lit(rows.count() // PER_FILE + 1)))


def exported(spark, d, conversations, wrap: str = "[%s]"):
    """Rows of a struct column as JSON documents."""
    head, tail = wrap.split("%s")
    parts = dealt(conversations, "conv_id").groupBy("k").agg(F.array_join(F.collect_list(F.to_json("c")), ",").alias("j"))
    return files(parts.select("k", F.concat(F.lit(head), "j", F.lit(tail)).alias("value")))


def mapped(rows: DataFrame, key: str, entry, wrap=lambda m: m) -> str:
    """Rows as JSON documents that map keys to values."""
    return files(dealt(rows, key).groupBy("k").agg(F.to_json(wrap(F.map_from_entries(F.collect_list(entry)))).alias("value")))


def chatgpt_path(spark, d, wrap="[%s]"):
    c = v.table(spark, d, "conversations")
    message = F.struct(F.struct("role").alias("author"), (F.col("turn") * 1.0).alias("create_time"), F.struct(F.lit("text").alias("content_type"), F.array("text").alias("parts")).alias("content"))
    node = F.struct(F.col("turn").cast("string").alias("k"), F.struct(F.when(F.col("turn") > 0, (F.col("turn") - 1).cast("string")).alias("parent"), message.alias("message")).alias("v"))
    per = c.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(node)).alias("mapping"), F.max("turn").cast("string").alias("current_node"))
    conv = F.struct(F.concat(F.lit("T"), F.col("conv_id").cast("string")).alias("title"), F.lit(1.7e9).alias("create_time"), F.col("conv_id").cast("string").alias("conversation_id"), "current_node", "mapping")
    return exported(spark, d, per.select("conv_id", conv.alias("c")), wrap)


NODES = "SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS node_id, CASE WHEN turn > 0 THEN (turn - 1)::VARCHAR END AS parent_id, role, text AS content FROM conversations"


@query("A1_read_chatgpt", NODES)
def read_chatgpt(spark, d):
    return r.read_chatgpt(spark, chatgpt_path(spark, d, '{"conversations":[%s]}'), split=True)["node"].select("conv_id", "node_id", "parent_id", "role", "content")


@query("A2_read_shards", "SELECT conv_id::VARCHAR AS conv_id, 'T' || conv_id AS title, max(turn)::VARCHAR AS leaf_id FROM conversations GROUP BY conv_id")
def read_shards(spark, d):
    return r.read_chatgpt(spark, chatgpt_path(spark, d))["conv"].select("conv_id", "title", "leaf_id")


def claude_path(spark, d):
    c = v.table(spark, d, "conversations")
    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    message = F.struct(
        F.col("turn").cast("string").alias("uuid"), F.when(F.col("role") == "user", "human").otherwise(F.col("role")).alias("sender"), F.when(F.col("turn") > 0, (F.col("turn") - 1).cast("string")).alias("parent_message_uuid"),
        F.array(block("text", F.col("text")), block("tool_use", F.lit(None).cast("string")), block("text", F.lit("end"))).alias("content"),
    )
    per = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))).alias("m"))
    conv = F.struct(F.col("conv_id").cast("string").alias("uuid"), F.lit("N").alias("name"), F.lit("2024-01-02T03:04:05Z").alias("created_at"), F.transform("m", lambda x: x["m"]).alias("chat_messages"))
    return exported(spark, d, per.select("conv_id", conv.alias("c")))


@query("A3_read_claude", NODES.replace("text AS content", "text || chr(10) || chr(10) || 'end' AS content"))
def read_claude(spark, d):
    return r.read_claude(spark, claude_path(spark, d), split=True)["node"].select("conv_id", "node_id", "parent_id", "role", "content")


@query(
    "A4_read_claude_layout",
    "SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'memories' ELSE 'projects' END AS category, CASE WHEN s_suppkey % 2 = 0 THEN '002' ELSE '001' END AS part, count(*) AS rows FROM supplier GROUP BY 1, 2",
)
def read_claude_layout(spark, d):
    root = shared(spark)
    rows = v.table(spark, d, "supplier").select("s_suppkey", "s_name")
    for c, third in (("projects", "s_suppkey % 3 <> 0"), ("memories", "s_suppkey % 3 = 0")):
        for part, half in (("001", "s_suppkey % 2 <> 0"), ("002", "s_suppkey % 2 = 0")):
            rows.where(third).where(half).select("s_name").write.json(f"{root}/{c}-{part}")
    found = r.read_claude_layout(spark, root, ["projects", "memories", "frames"])
    met = found["projects"].unionByName(found["memories"]).unionByName(found["frames"])
    return met.groupBy("category", "part").agg(F.sum(F.regexp_count("value", F.lit("s_name"))).alias("rows"))


@query(
    "A4_read_claude_export",
    "SELECT 'conversation' AS what, conv_id::VARCHAR AS id, turn::VARCHAR AS detail, text AS content FROM conversations UNION ALL SELECT 'project', 'p' || s_suppkey, 'd' || s_suppkey, s_name FROM supplier "
    "UNION ALL SELECT 'memory', 'm' || n_nationkey, NULL, n_name FROM nation",
)
def read_claude_export(spark, d):
    """Three categories of one part each, and second parts that don't count."""
    root = shared(spark)
    c = v.table(spark, d, "conversations")
    message = F.struct(F.col("turn").cast("string").alias("uuid"), F.col("text").alias("text"), F.lit("human").alias("sender"))
    convs = c.groupBy("conv_id").agg(F.collect_list(message).alias("chat_messages")).select(F.col("conv_id").cast("string").alias("uuid"), "chat_messages")
    key = F.col("s_suppkey").cast("string")
    docs = F.array(F.struct(F.concat(F.lit("d"), key).alias("filename"), F.col("s_name").alias("content")))
    projects = v.table(spark, d, "supplier").select(F.concat(F.lit("p"), key).alias("uuid"), docs.alias("docs"))
    entry = F.struct(F.concat(F.lit("m"), F.col("n_nationkey").cast("string")), "n_name")
    memories = v.table(spark, d, "nation").agg(F.map_from_entries(F.collect_list(entry)).alias("project_memories"))
    for name, rows in (("conversations", convs), ("projects", projects), ("memories", memories)):
        for part, kept in (("000", rows), ("001", rows.limit(1))):
            # a list, or one object for memories
            listed = kept.agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct("*"))), ","), F.lit("]")).alias("value"))
            (kept.select(F.to_json(F.struct("*"))) if name == "memories" else listed).coalesce(1).write.text(f"{root}/{name}-{part}")
    found = r.read_claude_export(spark, root)
    conv = found["node"].select(F.lit("conversation").alias("what"), F.col("conv_id").alias("id"), F.col("node_id").alias("detail"), "content")
    doc = found["doc"].select(F.lit("project").alias("what"), F.col("project_id").alias("id"), F.col("filename").alias("detail"), "content")
    memory = found["project_memory"].select(F.lit("memory").alias("what"), F.col("project_id").alias("id"), F.lit(None).cast("string").alias("detail"), F.col("memory").alias("content"))
    return conv.unionByName(doc).unionByName(memory)


@query("A5_read_claude_projects", "SELECT 'p' || s_suppkey AS project_id, 'f' || s_suppkey AS filename, s_name AS content FROM supplier WHERE s_suppkey % 2 = 0")
def read_claude_projects(spark, d):
    key = F.col("s_suppkey").cast("string")
    docs = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.struct(F.concat(F.lit("f"), key).alias("filename"), F.col("s_name").alias("content"))))
    project = F.struct(F.concat(F.lit("p"), key).alias("uuid"), F.col("s_name").alias("name"), docs.alias("docs"))
    path = exported(spark, d, v.table(spark, d, "supplier").select(F.col("s_suppkey").alias("conv_id"), project.alias("c")))
    return r.read_claude_projects(spark, path)["doc"].select("project_id", "filename", "content")


FRAMES = "WITH p AS (SELECT page_id, url FROM pages) "


def frame_files(spark, d):
    """Artifacts of two versions each, of which every third lacks the second page, and comments on every other one."""
    p = v.table(spark, d, "pages").select("page_id", "url", "html", F.concat(F.lit("a"), F.col("page_id").cast("string")).alias("a"))
    folder = F.concat(F.lit("x/"), "a", F.lit("/"))
    version = lambda n: F.struct(F.concat("a", F.lit(f"-{n}")).alias("id"), F.col("url").alias("title"))
    artifact = F.when(F.col("page_id") % 7 == 0, "{broken").otherwise(F.to_json(F.struct(F.col("a").alias("id"), F.lit("artifact").alias("kind"), F.array(version(1), version(2)).alias("versions"))))
    said = F.array(F.struct(F.lit("user").alias("author_role"), F.col("url").alias("text")), F.struct(F.lit("assistant").alias("author_role"), F.lit("ok").alias("text")))
    comments = F.to_json(F.struct(F.array(F.struct(F.lit(True).alias("resolved"), said.alias("comments"))).alias("threads")))
    pages = [p.where(f"{n} = 1 or page_id % 3 <> 0").select(F.concat(folder, F.lit("versions/"), "a", F.lit(f"-{n}.html")).alias("path"), F.octet_length("html").cast("long").alias("bytes")) for n in (1, 2)]
    return (
        p.select(F.concat(folder, F.lit("artifact.json")).alias("path"), artifact.alias("value")),
        p.where("page_id % 2 = 0").select(F.concat(folder, F.lit("artifact_comments.json")).alias("path"), comments.alias("value")),
        pages[0].unionByName(pages[1]),
    )


@query(
    "A6_read_claude_frames",
    "SELECT 'a' || page_id AS frame_id, v - 1 AS pos, 'a' || page_id || '-' || v AS version_id, CASE WHEN v = 1 OR page_id % 3 <> 0 THEN strlen(html) END AS bytes "
    "FROM pages, (VALUES (1), (2)) t(v) WHERE page_id % 7 <> 0",
)
def read_claude_frames(spark, d):
    return r.parse_claude_frames(*frame_files(spark, d))["version"].select("frame_id", "pos", "version_id", "bytes")


@query(
    "A6_frame_comments",
    "SELECT 'a' || page_id AS frame_id, p AS pos, CASE WHEN p = 0 THEN url ELSE 'ok' END AS text FROM pages, (VALUES (0), (1)) t(p) WHERE page_id % 2 = 0",
)
def frame_comments(spark, d):
    return r.parse_claude_frames(*frame_files(spark, d))["comment"].select("frame_id", "pos", "text")


@query("A7_read_claude_memories", "SELECT 's' || s_suppkey AS project_id, s_name AS memory FROM supplier")
def read_claude_memories(spark, d):
    """An export an account, of two files each, of which only the first counts."""
    memory = lambda name: F.to_json(F.struct(F.col("k").cast("string").alias("account_uuid"), F.lit("m").alias("conversations_memory"), F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), name))).alias("project_memories")))
    rows = dealt(v.table(spark, d, "supplier"), "s_suppkey").groupBy("k")
    first = rows.agg(memory(F.col("s_name")).alias("value")).withColumn("part", F.lit(1))
    second = rows.agg(memory(F.concat(F.lit("other "), F.col("s_name"))).alias("value")).withColumn("part", F.lit(2))
    path = f"{shared(spark)}/json"
    first.unionByName(second).write.partitionBy("k", "part").text(path)
    return r.read_claude_memories(spark, f"{path}/*/*")["project_memory"]


def grok_path(spark, d):
    c = v.table(spark, d, "conversations")
    when = F.struct(F.struct((F.col("turn") * 1000).cast("string").alias("$numberLong")).alias("$date"))
    response = F.struct(F.struct(F.col("turn").cast("string").alias("_id"), F.when(F.col("turn") > 0, (F.col("turn") - 1).cast("string")).alias("parent_response_id"), F.when(F.col("role") == "user", "human").otherwise(F.upper("role")).alias("sender"), F.col("text").alias("message"), when.alias("create_time")).alias("response"))
    per = c.groupBy("conv_id").agg(F.collect_list(response).alias("responses"))
    conv = F.struct(F.struct(F.col("conv_id").cast("string").alias("id"), F.lit("2024-01-02T03:04:05Z").alias("create_time")).alias("conversation"), "responses")
    return exported(spark, d, per.select("conv_id", conv.alias("c")), '{"conversations":[%s],"media_posts":[{"id":"m1","media_type":"video"},{"id":"m2","media_type":"image"},{"id":"m3","media_type":"image"}]}')


@query("A8_read_grok", NODES.replace("FROM", ", (turn)::DOUBLE AS seconds FROM"))
def read_grok(spark, d):
    return r.read_grok(spark, grok_path(spark, d), split=True)["node"].select("conv_id", "node_id", "parent_id", "role", "content", F.col("created").cast("double").alias("seconds"))


@query("A9_grok_media", "SELECT s_name AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'videos' ELSE 'images' END AS bank FROM supplier WHERE s_suppkey % 3 <> 0")
def grok_media(spark, d):
    media = v.table(spark, d, "supplier").select(F.col("s_name").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, "VIDEO").otherwise("image").alias("media_type"), "s_suppkey")
    blobs = media.where("s_suppkey % 3 <> 0").select(F.col("id").alias("uuid"), F.concat(F.lit("b/"), "id").alias("path"))
    return r.grok_media(media, blobs)[0].select("id", "bank")


@query("A10_read_copilot", "SELECT 'T' || conv_id AS title, role, text AS content FROM conversations")
def read_copilot(spark, d):
    path = f"{shared(spark)}/csv"
    rows = v.table(spark, d, "conversations").select(F.concat(F.lit("T"), F.col("conv_id").cast("string")).alias("Conversation"), F.lit("2024-01-02T03:04:05Z").alias("Time"), F.when(F.col("role") == "assistant", "AI").otherwise(F.initcap("role")).alias("Author"), F.col("text").alias("Message"))
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return r.read_copilot(spark, path).select("title", "role", "content")


def claude_code_path(spark, d):
    """A line an event; answers have two blocks, calls ids and inputs, and every call a line with its result."""
    e = v.session_events(spark, d)
    none, session = F.lit(None).cast("string"), F.col("session_id").cast("string").alias("sessionId")
    call = F.concat(F.lit("k"), F.col("event_id").cast("string"))
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    block = F.struct(
        F.when(F.col("kind") == "tool", "tool_use").otherwise(F.col("kind")).alias("type"), of("text", F.col("text")).alias("text"), of("tool", F.col("text")).alias("name"), of("thinking", F.col("text")).alias("thinking"),
        of("tool", call).alias("id"), of("tool", F.struct(F.col("event_id").alias("n"))).alias("input"),
    )
    more = F.struct(F.lit("text").alias("type"), F.concat(F.lit(" more "), "text").alias("text"), none.alias("name"), none.alias("thinking"), none.alias("id"), F.lit(None).cast("struct<n:long>").alias("input"))
    typed = F.struct(F.when(F.col("event_id") % 9 == 0, "hook").otherwise("human").alias("kind")).alias("origin")
    prompt = F.to_json(F.struct(F.lit("user").alias("type"), session, "cwd", typed, F.struct(F.col("text").alias("content")).alias("message")))
    answer = F.to_json(F.struct(F.lit("assistant").alias("type"), session, F.col("is_side").alias("isSidechain"), F.struct(F.when(F.col("kind") == "text", F.array(block, more)).otherwise(F.array(block)).alias("content")).alias("message")))
    parts = F.array(*[F.struct(F.lit(k).alias("type"), t.alias("text")) for k, t in (("text", F.concat(F.lit("out "), call)), ("image", F.lit("no")), ("text", F.lit("end")))])
    result = F.to_json(F.struct(F.lit("user").alias("type"), session, F.struct(F.array(F.struct(F.lit("tool_result").alias("type"), call.alias("tool_use_id"), parts.alias("content"))).alias("content")).alias("message")))
    line = F.when(F.col("kind") == "human", prompt).when(F.col("kind") == "noise", "{broken").otherwise(answer)
    return dropped(e.select(line.alias("value")).unionByName(e.where("kind = 'tool'").select(result.alias("value"))), "jsonl")


AGENT = """ae AS (
  SELECT session_id::VARCHAR AS session_id, 0 AS block_no, CASE WHEN kind = 'human' AND event_id % 9 = 0 THEN 'noise' ELSE kind END AS kind, CASE WHEN NOT (kind = 'human' AND event_id % 9 = 0) THEN text END AS text,
    CASE WHEN kind = 'human' THEN false ELSE is_side END AS is_side, CASE WHEN kind = 'tool' THEN 'k' || event_id END AS call_id, CASE WHEN kind = 'tool' THEN '{"n":' || event_id || '}' END AS input FROM se WHERE kind <> 'noise'
  UNION ALL SELECT session_id::VARCHAR, 1, 'text', 'more ' || text, is_side, NULL, NULL FROM se WHERE kind = 'text'
  UNION ALL SELECT session_id::VARCHAR, 0, 'result', 'out k' || event_id || chr(10) || 'end', false, 'k' || event_id, NULL FROM se WHERE kind = 'tool')"""


@query("A11_read_agent_events", v.with_sql(v.EVENTS, AGENT, "SELECT * FROM ae"))
def read_agent_events(spark, d):
    return r.read_agent_events(spark, claude_code_path(spark, d)).select("session_id", "block_no", "kind", "text", F.coalesce("is_side", F.lit(False)).alias("is_side"), "call_id", "input")


@query("A11_calls_with_results", v.with_sql(v.EVENTS, "SELECT session_id::VARCHAR AS session_id, 'k' || event_id AS call_id, text AS tool, 'out k' || event_id || chr(10) || 'end' AS result FROM se WHERE kind = 'tool'"))
def calls_with_results(spark, d):
    calls, results = t.calls_and_results(r.read_agent_events(spark, claude_code_path(spark, d)))
    return t.join_tool_results(calls, results).select("session_id", "call_id", "tool", "result")


@query(
    "A12_read_codex_events",
    "SELECT CASE WHEN event_type = 'signup' THEN 'event_msg' ELSE 'response_item' END AS type, CASE event_type WHEN 'signup' THEN 'user_message' WHEN 'click' THEN 'function_call' WHEN 'error' THEN 'function_call_output' WHEN 'view' THEN 'reasoning' ELSE 'assistant' END AS subtype, "
    "CASE event_type WHEN 'signup' THEN trim(props) WHEN 'click' THEN 'run' WHEN 'error' THEN props WHEN 'view' THEN trim(props) ELSE trim(props) || chr(10) || 'end' END AS text, "
    "CASE WHEN event_type IN ('click', 'error') THEN 'c' || event_id END AS call_id, CASE WHEN event_type = 'click' THEN props END AS input FROM events",
)
def read_codex_events(spark, d):
    e = v.table(spark, d, "events")
    call = F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("call_id")
    item = lambda kind, *more: F.to_json(F.struct(F.lit("response_item").alias("type"), F.struct(F.lit(kind).alias("type"), *more).alias("payload")))
    said = lambda *texts: F.array(*[F.struct(x.alias("text")) for x in texts])
    line = (
        F.when(F.col("event_type") == "signup", F.to_json(F.struct(F.lit("event_msg").alias("type"), F.struct(F.lit("user_message").alias("type"), F.col("props").alias("message")).alias("payload"))))
        .when(F.col("event_type") == "click", item("function_call", F.lit("run").alias("name"), call, F.col("props").alias("arguments")))
        .when(F.col("event_type") == "error", item("function_call_output", call, F.col("props").alias("output")))
        .when(F.col("event_type") == "view", item("reasoning", F.lit("x").alias("encrypted_content"), said(F.col("props")).alias("summary")))
        .otherwise(item("message", F.lit("assistant").alias("role"), said(F.col("props"), F.lit(None).cast("string"), F.lit("end")).alias("content")))
    )
    return r.read_agent_events(spark, dropped(e.select(line.alias("value")), "jsonl"), "codex").select("type", "subtype", "text", "call_id", "input")


@query("A13_parse_html_export")
def parse_html_export(spark, d):
    page = v.table(spark, d, "pages")
    html = F.concat(F.lit("<h2>Q</h2><p>one</p>"), F.replace("html", F.lit("<h1"), F.lit("<h2")), F.lit("<h3>A</h3>end"))
    return page.select("page_id", F.posexplode(r.parse_html_export(html)).alias("pos", "m")).select("page_id", "pos", "m.*")


@query(
    "A14_read_posts",
    "SELECT page_id::VARCHAR AS id, 'p-' || page_id AS slug, url AS title, CASE WHEN page_id % 4 <> 0 THEN sha1(html) END AS digest FROM pages",
)
def read_posts(spark, d):
    p = v.table(spark, d, "pages")
    post = F.concat(F.col("page_id").cast("string"), F.lit(".p-"), F.col("page_id").cast("string"))
    pages = p.where("page_id % 4 <> 0").select(F.concat(F.lit("x/posts/"), post, F.lit(".html")).alias("path"), F.col("html").alias("value"))
    out = r.join_posts(p.select(post.alias("post_id"), F.col("url").alias("title")), pages)
    return out.select("id", "slug", "title", F.sha1("html").alias("digest"))


@query("A15_read_post_stats", "SELECT s_name AS title, s_nationkey::VARCHAR AS views FROM supplier")
def read_post_stats(spark, d):
    root, sup = shared(spark), v.table(spark, d, "supplier")
    sup.select(F.col("s_name").alias("title"), F.lit("2024").alias("post_date"), F.col("s_nationkey").alias("views")).write.option("header", True).csv(f"{root}/stats")
    sup.select(F.col("s_name").alias("email"), F.col("s_suppkey").alias("active")).write.option("header", True).csv(f"{root}/list")
    return r.read_post_stats(spark, [f"{root}/stats", f"{root}/list"]).select("title", "views")


@query("A21_expand_archives", "SELECT 'z' || doc_id || '.zip' AS archive, CASE WHEN doc_id % 7 <> 0 THEN 'x/' || doc_id || '.txt' END AS member, CASE WHEN doc_id % 7 = 0 THEN 6 ELSE strlen(text) END::BIGINT AS bytes, CASE WHEN doc_id % 7 <> 0 THEN sha1(text) END AS digest FROM documents")
def expand_archives(spark, d):
    def zipped(batches):
        """Each row's text as a zip file with one member; every seventh is broken."""
        for b in batches:
            out = []
            for key, text in zip(b["key"], b["text"], strict=True):
                file = io.BytesIO()
                with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(f"x/{key}.txt", text)
                out.append(b"broken" if key % 7 == 0 else file.getvalue())
            yield b.assign(path=[f"z{k}.zip" for k in b["key"]], content=out)[["path", "content"]]

    files = v.table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text").mapInPandas(zipped, "path string, content binary")
    return r.archive_members(files).select("archive", "member", "bytes", F.sha1("content").alias("digest"))


@query("A16_read_suno", "SELECT 's' || p_partkey AS id, p_name AS title, p_retailprice::DOUBLE AS duration FROM part WHERE p_size % 5 <> 0")
def read_suno(spark, d):
    part = v.table(spark, d, "part")
    clip = F.struct(F.when(F.col("p_size") % 5 != 0, F.concat(F.lit("s"), F.col("p_partkey").cast("string"))).alias("id"), F.col("p_name").alias("title"), F.struct(F.col("p_retailprice").alias("duration")).alias("metadata"))
    path = exported(spark, d, part.select(F.col("p_partkey").alias("conv_id"), clip.alias("c")))
    return r.read_suno(spark, path).select("id", "title", "metadata.duration")


@query("A17_read_flowmusic", "SELECT 's' || p_partkey AS id, p_name AS title FROM part")
def read_flowmusic(spark, d):
    part = v.table(spark, d, "part")
    key = F.concat(F.lit("s"), F.col("p_partkey").cast("string"))
    path = mapped(part, "p_partkey", F.struct(key, F.struct(key.alias("id"), F.col("p_name").alias("title"))))
    return r.read_flowmusic(spark, path).select("id", "title")


@query("A18_read_image_library", "SELECT s_name AS key, CASE WHEN s_suppkey % 2 = 0 THEN 'ok' ELSE 'error' END AS value FROM supplier")
def read_image_library(spark, d):
    entry = F.struct("s_name", F.when(F.col("s_suppkey") % 2 == 0, "ok").otherwise("error"))
    return r.read_image_library(spark, mapped(v.table(spark, d, "supplier"), "s_suppkey", entry), "string")


@query("A19_read_library", "SELECT 'f' || s_suppkey AS file_id, 't' || (s_suppkey % 9) AS origination_thread_id FROM supplier WHERE s_suppkey % 3 <> 0")
def read_library(spark, d):
    key = F.col("s_suppkey")
    row = F.struct(F.concat(F.lit("f"), key.cast("string")).alias("file_id"), F.when(key % 3 != 0, "g").alias("image_gen_generation_id"), F.concat(F.lit("t"), (key % 9).cast("string")).alias("origination_thread_id"))
    path = exported(spark, d, v.table(spark, d, "supplier").select(key.alias("conv_id"), row.alias("c")))
    return r.read_library(spark, path).select("file_id", "origination_thread_id")


@query("A20_read_notes", r"SELECT conv_id::VARCHAR AS note_id, turn::INT AS pos, role, regexp_replace(text, '^\s+|\s+$', '', 'g') AS content FROM conversations")
def read_notes(spark, d):
    c = v.table(spark, d, "conversations")
    one = F.concat(F.lit("### "), "role", F.lit("\n\n"), "text", F.lit("\n\n"))
    notes = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", one.alias("t")))).alias("m"))
    value = F.concat(F.lit('---\ntitle: "A: b"\nconv_id: '), F.col("conv_id").cast("string"), F.lit("\n---\n"), F.array_join(F.transform("m", lambda x: x["t"]), ""))
    return r.parse_notes(notes.select(F.col("conv_id").cast("string").alias("path"), value.alias("value")))["msg"]


@query("A20_read_front_matter", "SELECT DISTINCT conv_id::VARCHAR AS note_id, 'A: b' AS title, conv_id::VARCHAR AS conv_id FROM conversations")
def read_front_matter(spark, d):
    c = v.table(spark, d, "conversations").select("conv_id").distinct()
    value = F.concat(F.lit('---\ntitle: "old"\ntitle: "A: b"\nconv_id: 1\nconv_id: '), F.col("conv_id").cast("string"), F.lit("\n---\nbody"))
    note = r.parse_notes(c.select(F.col("conv_id").cast("string").alias("path"), value.alias("value")))["note"]
    return note.select("note_id", F.col("front")["title"].alias("title"), F.col("front")["conv_id"].alias("conv_id"))


@query("A22_read_dim_map", "SELECT s_name AS key, unnest([s_name, 'x' || s_suppkey]) AS value FROM supplier")
def read_dim_map(spark, d):
    entry = F.struct("s_name", F.array("s_name", F.concat(F.lit("x"), F.col("s_suppkey").cast("string"))))
    return r.read_dim_map(spark, mapped(v.table(spark, d, "supplier"), "s_suppkey", entry))


@query("A23_write_notes", v.with_sql(v.DOC_NOTES, "SELECT coalesce(strftime(date, '%Y'), '0000')::INT AS year, coalesce(strftime(date, '%m'), '00')::INT AS month, count(*) AS notes, sum(bytes)::BIGINT AS bytes FROM nt GROUP BY 1, 2"))
def write_notes(spark, d):
    path = f"{shared(spark)}/notes"
    s.write_notes(v.notes(spark, d), path)
    return spark.read.parquet(path).groupBy(F.col("year").cast("int").alias("year"), F.col("month").cast("int").alias("month")).agg(F.count("*").alias("notes"), F.sum("bytes").alias("bytes"))


@query(
    "A24_write_assets",
    "SELECT substr(sha1(text), 1, 16) || '.bin' AS file, count(*) AS copies, sha1(any_value(text)) AS digest, min(doc_id::VARCHAR) AS path, strlen(any_value(text)) AS bytes "
    "FROM documents WHERE sha1(text) NOT IN (SELECT sha1(text) FROM documents WHERE doc_id % 3 = 0) GROUP BY sha1(text)",
)
def write_assets(spark, d):
    """The bank's bytes are read back and hashed anew."""
    docs = v.table(spark, d, "documents")
    path = f"{shared(spark)}/bank"
    s.write_assets(docs.select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content")), docs.where("doc_id % 3 = 0").select(F.sha1("text").alias("sha1")).distinct(), path)
    return spark.read.parquet(path).select("file", "copies", F.sha1("content").alias("digest"), "path", "bytes")


@query("A25_append_manifest", "SELECT doc_id, 'new' AS state, length(substr(text, 1, 400))::INT AS detail_chars FROM documents")
def append_manifest(spark, d):
    path = f"{shared(spark)}/manifest"
    rows = v.table(spark, d, "documents").select("doc_id", F.lit("new").alias("state"), F.col("text").alias("detail"))
    for k in (0, 1):
        s.append_manifest(rows.where(F.col("doc_id") % 2 == k), path)
    return spark.read.schema("doc_id long, state string, detail string").json(path).select("doc_id", "state", F.length("detail").alias("detail_chars"))


@query("A26_write_if_changed", "SELECT count_if(doc_id % 3 = 0 OR doc_id % 4 = 0)::BIGINT AS written, count_if(NOT (doc_id % 3 = 0 OR doc_id % 4 = 0))::BIGINT AS skipped FROM documents")
def write_if_changed(spark, d):
    docs, path = v.table(spark, d, "documents"), f"{shared(spark)}/changed"
    return s.write_if_changed(versions(docs), docs.where("doc_id % 4 <> 0").select("doc_id", F.col("text").alias("body")), "doc_id", path)


def versions(docs):
    return docs.select("doc_id", F.concat("text", F.when(F.col("doc_id") % 3 == 0, "!").otherwise("")).alias("body"))


@query("A26_current_rows", "SELECT doc_id, sha1(text || CASE WHEN doc_id % 3 = 0 THEN '!' ELSE '' END) AS digest FROM documents")
def current_rows(spark, d):
    """After a first and a second write every key has one current row."""
    docs, path = v.table(spark, d, "documents"), f"{shared(spark)}/changed"
    old = docs.select("doc_id", F.col("text").alias("body"))
    s.write_if_changed(old, old.where("false"), "doc_id", path)
    s.write_if_changed(versions(docs), s.current(spark.read.parquet(path), "doc_id"), "doc_id", path)
    return s.current(spark.read.parquet(path), "doc_id").select("doc_id", F.sha1("body").alias("digest"))
