"""Readers of provider exports, agent logs, posts, libraries and notes: files in, canonical tables out.

JSON files are parsed by Spark with explicit schemas: one task a file, or with ``split`` many tasks a file. Line-oriented
logs are split freely.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convarchive.functions.html import parse_html_export
from convarchive.functions.text import normalize_role, strip_space
from convarchive.operators.intake import CATEGORIES, is_stats_csv
from convarchive.sources.json_arrays import read_elements

CHATGPT = """title string, create_time double, createTime double, update_time double, gizmo_id string, conversation_id string, id string, conversation_template_id string, memory_scope string, current_node string,
  mapping map<string, struct<parent:string, message:struct<author:struct<role:string>, create_time:double, content:struct<content_type:string, parts:array<string>, text:string>, metadata:struct<model_slug:string>>>>,
  messages array<struct<role:string, content:string>>"""
CLAUDE = """uuid string, name string, created_at timestamp, updated_at timestamp, chat_messages array<struct<uuid:string, sender:string, parent_message_uuid:string, created_at:timestamp, text:string,
  content:array<struct<type:string, text:string, name:string, input:struct<id:string, command:string, type:string, title:string, language:string, content:string, old_str:string, new_str:string>>>,
  attachments:array<struct<file_name:string, file_type:string, file_size:bigint, extracted_content:string>>, files:array<struct<file_name:string, file_uuid:string>>>>"""
GROK = """conversations array<struct<conversation:struct<id:string, title:string, create_time:string, modify_time:string, leaf_response_id:string>, responses:array<struct<response:struct<_id:string, parent_response_id:string,
  sender:string, message:string, model:string, file_attachments:array<string>, create_time:struct<`$date`:struct<`$numberLong`:string>>>>>>>, media_posts array<struct<id:string, media_type:string, original_prompt:string, link:string, create_time:string>>"""
PROJECT = "uuid string, name string, description string, prompt_template string, is_private boolean, created_at timestamp, updated_at timestamp, docs array<struct<uuid:string, filename:string, content:string, created_at:timestamp>>"
FRAME = "id string, kind string, visibility string, updated_at timestamp, active_version string, versions array<struct<id:string, title:string, description:string, created_at:timestamp>>"
COMMENTS = "threads array<struct<created_at:timestamp, resolved:boolean, comments:array<struct<author_role:string, text:string, created_at:timestamp>>>>"
MEMORY = "account_uuid string, conversations_memory string, project_memories map<string,string>, memory_files array<struct<path:string, content:string, updated_at:timestamp>>"
SUNO = """id string, title string, created_at timestamp, is_liked boolean, is_trashed boolean, project struct<id:string, name:string>, metadata struct<duration:double, task:string, secondary_badges:array<struct<display_name:string>>,
  prompt:string, tags:string, cover_clip_id:string, edited_clip_id:string, mashup_clip_ids:array<string>>"""
FLOW = """struct<id:string, title:string, created_at:timestamp, duration:double, duration_status:string, is_favorite:boolean, deleted_at:string, op_type:string, source_clip_ids:array<string>, lyrics:string, conversation_id:string>"""
LIBRARY = "file_id string, file_name string, mime_type string, created_at timestamp, image_gen_generation_id string, origination_thread_id string"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def _fields(spark: SparkSession, schema: str) -> str:
    return spark.createDataFrame([], schema).schema.simpleString()


def _elements(spark: SparkSession, path: str, schema: str, *keys: str) -> DataFrame:
    """The objects of a huge file's arrays, parsed; one that doesn't parse is null throughout."""
    return read_elements(spark, path, list(keys)).select("key", F.from_json("json", schema).alias("c")).select("key", "c.*")


def read_chatgpt(spark: SparkSession, path: str, split: bool = False) -> dict[str, DataFrame]:
    """``conv`` and ``node`` of an export: a list, ``{conversations: […]}`` or ``{items: […]}``; shards come by a glob.

    A conversation without a mapping has its flat messages as a chain of nodes. With ``split`` one file is read by many
    tasks; a file that is a single conversation is not read then.
    """
    if split:
        c = _elements(spark, path, CHATGPT, "conversations", "items").drop("key")
    else:
        kind = _fields(spark, CHATGPT)
        raw = _json(spark, path, f"{CHATGPT}, conversations array<{kind}>, items array<{kind}>")
        nested = raw.select(F.explode(F.coalesce("conversations", "items")).alias("c")).select("c.*")
        c = raw.where("conversations is null and items is null").drop("conversations", "items").unionByName(nested)
    c = c.withColumn("conv_id", F.coalesce("conversation_id", "id", F.md5(F.concat_ws("|", "title", "create_time"))))
    time = lambda x: F.timestamp_seconds(x)
    conv = c.select(
        "conv_id", F.lit("chatgpt").alias("provider"), "title", time(F.coalesce("create_time", "createTime")).alias("created"), time(F.col("update_time")).alias("updated"),
        "gizmo_id", F.col("conversation_template_id").alias("template_id"), F.col("current_node").alias("leaf_id"),
    )
    tree = c.select("conv_id", F.posexplode(F.map_entries("mapping")).alias("pos", "e")).select("conv_id", "pos", F.col("e.key").alias("node_id"), F.col("e.value.parent").alias("parent_id"), F.col("e.value.message").alias("m"))
    text = F.coalesce(F.array_join("m.content.parts", "\n"), "m.content.text")
    tree = tree.select("conv_id", "node_id", "parent_id", "pos", F.col("m.create_time").alias("created"), normalize_role(F.col("m.author.role")).alias("role"), text.alias("content"), F.col("m.metadata.model_slug").alias("model"))
    flat = c.where("mapping is null").select("conv_id", F.posexplode("messages").alias("pos", "m"))
    flat = flat.select("conv_id", F.col("pos").cast("string").alias("node_id"), F.when(F.col("pos") > 0, (F.col("pos") - 1).cast("string")).alias("parent_id"), "pos", F.lit(None).cast("double").alias("created"), normalize_role(F.col("m.role")).alias("role"), F.col("m.content").alias("content"), F.lit(None).cast("string").alias("model"))
    return {"conv": conv, "node": tree.unionByName(flat)}


def read_claude(spark: SparkSession, path: str, split: bool = False) -> dict[str, DataFrame]:
    """``conv``, ``node`` (texts of a message's blocks), ``block`` and ``attachment`` of an export; with ``split`` one file is read by many tasks."""
    raw = (_elements(spark, path, CLAUDE).drop("key") if split else _json(spark, path, CLAUDE)).where("uuid is not null")
    conv = raw.select(F.col("uuid").alias("conv_id"), F.lit("claude").alias("provider"), F.col("name").alias("title"), F.col("created_at").alias("created"), F.col("updated_at").alias("updated"))
    m = raw.select(F.col("uuid").alias("conv_id"), F.posexplode("chat_messages").alias("pos", "m"))
    texts = F.transform(F.filter("m.content", lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"])
    node = m.select("conv_id", F.col("m.uuid").alias("node_id"), F.col("m.parent_message_uuid").alias("parent_id"), "pos", F.col("m.created_at").alias("created"), normalize_role(F.col("m.sender")).alias("role"), F.coalesce(F.nullif(F.array_join(texts, "\n\n"), F.lit("")), "m.text").alias("content"))
    block = m.select("conv_id", F.col("m.uuid").alias("node_id"), F.posexplode("m.content").alias("pos", "b")).select("conv_id", "node_id", "pos", "b.*")
    attachment = m.select("conv_id", F.col("m.uuid").alias("node_id"), F.explode("m.attachments").alias("a")).select("conv_id", "node_id", "a.*")
    return {"conv": conv, "node": node, "block": block, "attachment": attachment}


def read_claude_layout(spark: SparkSession, folder: str, categories: list[str] = CATEGORIES) -> dict[str, DataFrame]:
    """One frame of ``(category, part, path, value)`` a category of a split export; reading waits until one is used."""
    parts = {}
    for c in categories:
        try:
            files = spark.read.option("wholetext", True).text(f"{folder}/{c}-*/*.json")
        except AnalysisException:  # no such file
            files = spark.sql("SELECT '' AS value, struct('' AS file_path) AS _metadata WHERE false")
        found = F.regexp_extract("_metadata.file_path", rf"/({c})-(\d+)/[^/]+", 1)
        part = F.regexp_extract("_metadata.file_path", rf"/({c})-(\d+)/", 2)
        parts[c] = files.select(found.alias("category"), part.alias("part"), F.col("_metadata.file_path").alias("path"), "value").where("category <> ''")
    return parts


def read_claude_export(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The parsed tables of a split export, under the names of its categories' readers: conversations, projects, memories and frames.

    Of a category only the first part by name counts, ``<folder>/<category>-NNN``; one that isn't there has no tables, and
    without conversations it is no export and has none at all.
    """
    found: dict[str, DataFrame] = {}
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    parts = listed.select(F.regexp_extract("path", rf"^(.*/({'|'.join(CATEGORIES)})-\d+)/", 1).alias("part"), F.regexp_extract("path", rf"/({'|'.join(CATEGORIES)})-\d+/", 1).alias("category"))
    first = {r.category: r.part for r in parts.where("category <> ''").groupBy("category").agg(F.min("part").alias("part")).collect()}  # a row a category
    if "conversations" not in first:
        return found
    for category, read in (("conversations", read_claude), ("projects", read_claude_projects), ("memories", read_claude_memories)):
        if category in first:
            found |= read(spark, first[category])
    if "frames" in first:
        found |= read_claude_frames(spark, first["frames"])
    return found


def read_claude_projects(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    raw = _json(spark, path, PROJECT)
    docs = raw.select(F.col("uuid").alias("project_id"), F.explode_outer("docs").alias("d")).where("d is not null").select("project_id", F.col("d.uuid").alias("doc_id"), "d.filename", "d.content", "d.created_at")
    return {"project": raw.select(F.col("uuid").alias("project_id"), "name", "description", "prompt_template", "is_private", "created_at", "updated_at", F.size(F.coalesce("docs", F.array())).alias("docs")), "doc": docs}


def parse_claude_frames(artifacts: DataFrame, comments: DataFrame, pages: DataFrame) -> dict[str, DataFrame]:
    """``frame``, ``version`` (with path and size of ``<version>.html`` where it is there) and ``comment`` from ``(path, value)`` and ``(path, bytes)`` rows."""
    raw = artifacts.select(F.from_json("value", FRAME).alias("a")).select("a.*").where("id is not null")
    sizes = pages.select(F.regexp_extract("path", r"([^/]+)\.html$", 1).alias("version_id"), "path", "bytes")
    version = raw.select(F.col("id").alias("frame_id"), F.posexplode("versions").alias("pos", "v")).select("frame_id", "pos", F.col("v.id").alias("version_id"), "v.title", "v.created_at").join(sizes, "version_id", "left")
    said = comments.select(F.regexp_extract("path", r"([^/]+)/artifact_comments\.json$", 1).alias("frame_id"), F.posexplode(F.from_json("value", COMMENTS)["threads"]).alias("thread", "t"))
    comment = said.select("frame_id", "thread", "t.resolved", F.posexplode("t.comments").alias("pos", "c")).select("frame_id", "thread", "resolved", "pos", "c.*")
    return {"frame": raw.select(F.col("id").alias("frame_id"), "kind", "visibility", "updated_at", "active_version"), "version": version, "comment": comment}


def read_claude_frames(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The artifact folders of an export, of their pages only names and sizes."""
    whole = lambda name: spark.read.option("wholetext", True).option("pathGlobFilter", name).text(f"{folder}/*").select(F.col("_metadata.file_path").alias("path"), "value")
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").option("recursiveFileLookup", True).load(folder)
    return parse_claude_frames(whole("artifact.json"), whole("artifact_comments.json"), listing.select("path", F.col("length").alias("bytes")))


def read_claude_memories(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """General, project and file memories; of several files of an export, ``<export>/<part>/<file>``, only the first by name counts."""
    raw = _json(spark, path, MEMORY).withColumn("file", F.col("_metadata.file_path"))
    export = F.regexp_extract("file", r"^(.*)/[^/]+/[^/]+$", 1)
    raw = raw.join(raw.select("file").groupBy(export.alias("export")).agg(F.min("file").alias("file")).select("file"), "file", "left_semi")
    by_project = raw.select(F.explode(F.map_entries("project_memories")).alias("e")).select(F.col("e.key").alias("project_id"), F.col("e.value").alias("memory"))
    return {"memory": raw.select("account_uuid", "conversations_memory"), "project_memory": by_project, "memory_file": raw.select(F.explode("memory_files").alias("f")).select("f.*")}


def read_grok(spark: SparkSession, path: str, split: bool = False) -> dict[str, DataFrame]:
    """``conv``, ``node`` and ``media``; times are ISO texts or extended JSON. With ``split`` one file is read by many tasks."""
    if split:
        kinds = spark.createDataFrame([], GROK).schema
        convs, posts = (kinds[name].dataType.elementType for name in ("conversations", "media_posts"))
        found = read_elements(spark, path, ["conversations", "media_posts"])
        of = lambda key, kind: found.where(F.col("key") == key).select(F.from_json("json", kind).alias("x")).select("x.*")
        c, media = of("conversations", convs), of("media_posts", posts)
    else:
        raw = _json(spark, path, GROK)
        c = raw.select(F.explode("conversations").alias("c")).select("c.*")
        media = raw.select(F.explode("media_posts").alias("m")).select("m.*")
    conv = c.select(F.col("conversation.id").alias("conv_id"), F.lit("grok").alias("provider"), "conversation.title", F.try_to_timestamp("conversation.create_time").alias("created"), F.try_to_timestamp("conversation.modify_time").alias("updated"), F.col("conversation.leaf_response_id").alias("leaf_id"))
    r = c.select(F.col("conversation.id").alias("conv_id"), F.posexplode("responses.response").alias("pos", "r"))
    millis = F.col("r.create_time")["$date"]["$numberLong"].try_cast("long")
    node = r.select("conv_id", F.col("r._id").alias("node_id"), F.col("r.parent_response_id").alias("parent_id"), "pos", F.timestamp_millis(millis).alias("created"), normalize_role(F.col("r.sender")).alias("role"), F.col("r.message").alias("content"), F.col("r.model").alias("model"), F.col("r.file_attachments").alias("files"))
    return {"conv": conv, "node": node, "media": media}


def grok_media(media: DataFrame, blobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Media posts whose binary is there, with their bank, and those still pending."""
    met = media.join(blobs.select(F.col("uuid").alias("id"), "path"), "id", "left")
    bank = F.when(F.lower("media_type").contains("video"), "videos").otherwise("images")
    return met.where("path is not null").withColumn("bank", bank), met.where("path is null").drop("path")


def read_copilot(spark: SparkSession, path: str) -> DataFrame:
    """Messages ``(title, time, role, content, pos)`` of CSV exports; order is that of the file."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
    names = {c.lstrip("﻿").strip('"'): c for c in rows.columns}
    of = lambda n: F.col(f"`{names[n]}`")
    return rows.select(of("Conversation").alias("title"), F.try_to_timestamp(of("Time")).alias("time"), normalize_role(of("Author")).alias("role"), of("Message").alias("content"), F.monotonically_increasing_id().alias("pos"))


BLOCKS = "array<struct<type:string, text:string, thinking:string, name:string, id:string, tool_use_id:string, input:string, content:string>>"


def _texts(json: Column, plain: bool = False) -> Column:
    """A text as it is, of a list of blocks their texts line by line (``plain``: those of type text only); nothing gives ``''``."""
    parts = F.from_json(json, "array<struct<type:string,text:string>>")
    wanted = F.filter(parts, lambda b: (F.coalesce(b["text"], F.lit("")) != "") & ((b["type"] == "text") if plain else F.lit(True)))
    listed = F.when(F.startswith(json, F.lit("[")), F.array_join(F.transform(wanted, lambda b: b["text"]), "\n"))
    return F.coalesce(listed, json, F.lit(""))


def read_agent_events(spark: SparkSession, path: str, agent: str = "claude-code") -> DataFrame:
    """Events of agent logs, one JSON a line, as input of ``agent_turns`` (``codex_events`` for Codex): one row a content block.

    Calls and results have their ``call_id``, calls their ``input`` as JSON. A corrupt line is skipped; prompts are texts
    that a human typed, and what shows nothing is noise.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"), F.try_parse_json("value").alias("v")).where("v is not null")
    get = lambda p: F.get_json_object("line", p)
    ts = F.try_to_timestamp(get("$.timestamp"))
    if agent == "codex":
        kind = F.coalesce(get("$.payload.type"), F.lit(""))
        sub = F.when(kind == "message", get("$.payload.role")).otherwise(kind)
        reasoning = F.coalesce(F.nullif(_texts(get("$.payload.summary")), F.lit("")), _texts(get("$.payload.content")))
        text = (
            F.when(kind == "message", strip_space(_texts(get("$.payload.content"))))
            .when(kind == "reasoning", strip_space(reasoning))
            .when(kind.isin("function_call", "custom_tool_call"), get("$.payload.name"))
            .when(kind.isin("function_call_output", "custom_tool_call_output"), _texts(get("$.payload.output")))
            .otherwise(strip_space(F.coalesce(get("$.payload.message"), F.lit(""))))
        )
        called = F.coalesce(get("$.payload.arguments"), get("$.payload.input"))
        return lines.select(F.col("file").alias("session_id"), "line_no", ts.alias("ts"), get("$.type").alias("type"), sub.alias("subtype"), text.alias("text"), get("$.payload.call_id").alias("call_id"), called.alias("input"))
    content = get("$.message.content")
    listed = F.startswith(F.schema_of_variant(F.try_variant_get("v", "$.message.content", "variant")), F.lit("ARRAY"))
    lines = lines.select("*", F.posexplode_outer(F.when(listed, F.from_json(content, BLOCKS))).alias("block_no", "b"))
    by = get("$.type")
    human = (by == "user") & ~F.coalesce(listed, F.lit(False)) & (get("$.origin.kind") == "human")
    assistant = lambda kind, shown: (by == "assistant") & (F.col("b.type") == kind) & (strip_space(F.coalesce(shown, F.lit(""))) != "")
    said, thought, tool, result = (
        assistant("text", F.col("b.text")), assistant("thinking", F.col("b.thinking")),
        (by == "assistant") & (F.col("b.type") == "tool_use"), (by == "user") & (F.col("b.type") == "tool_result"),
    )
    kind = F.when(human, "human").when(said, "text").when(thought, "thinking").when(tool, "tool").when(result, "result").otherwise("noise")
    text = (
        F.when(human, strip_space(content)).when(said, strip_space(F.col("b.text"))).when(thought, strip_space(F.col("b.thinking")))
        .when(tool, F.col("b.name")).when(result, _texts(F.col("b.content"), plain=True))
    )
    return lines.select(
        F.coalesce(get("$.sessionId"), F.col("file")).alias("session_id"), "line_no", F.coalesce("block_no", F.lit(0)).alias("block_no"), ts.alias("ts"), kind.alias("kind"), (get("$.isSidechain") == "true").alias("is_side"),
        text.alias("text"), get("$.cwd").alias("cwd"), get("$.gitBranch").alias("branch"), F.coalesce(get("$.aiTitle"), get("$.customTitle")).alias("title"),
        F.when(tool, F.col("b.id")).when(result, F.col("b.tool_use_id")).alias("call_id"), F.when(tool, F.col("b.input")).alias("input"),
    )


def read_html_export(spark: SparkSession, path: str) -> DataFrame:
    """``(file, pos, title, role, content)`` of HTML exports."""
    files = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return files.select("file", F.posexplode(parse_html_export("value")).alias("pos", "m")).select("file", "pos", "m.*")


def join_posts(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows ``(post_id, …)`` with ``id``, ``slug`` and the HTML of ``pages(path, value)`` called ``<id>.<slug>.html``."""
    html = pages.select(F.regexp_extract("path", r"/(\d+)\.[^/]*\.html$", 1).alias("id"), F.col("value").alias("html"))
    rows = rows.withColumns({"id": F.substring_index("post_id", ".", 1), "slug": F.regexp_extract("post_id", r"^\d+\.(.*)$", 1)})
    return rows.join(html, "id", "left")


def read_posts(spark: SparkSession, folder: str) -> DataFrame:
    """Posts of ``posts.csv`` with the HTML of ``posts/<id>.<slug>.html``; lists of subscribers are never read."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{folder}/posts.csv")
    return join_posts(rows, spark.read.option("wholetext", True).text(f"{folder}/posts/*.html").select(F.col("_metadata.file_path").alias("path"), "value"))


def read_post_stats(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """The statistics files among some CSV files, by their headers."""
    out = None
    for p in paths:
        df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(p)
        if is_stats_csv(df.columns):
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_suno(spark: SparkSession, path: str) -> DataFrame:
    """Clips of ``_index.json`` (a list) or of one file each; rows without id are skipped."""
    return _json(spark, path, SUNO).where("id is not null")


def read_flowmusic(spark: SparkSession, path: str) -> DataFrame:
    """Clips of an index that maps ids to clips, or lists them."""
    whole = spark.read.option("wholetext", True).text(path)
    mapped = whole.where(~F.col("value").rlike(r"^\s*\[")).select(F.explode(F.map_values(F.from_json("value", f"map<string, {FLOW}>"))).alias("c"))
    listed = whole.where(F.col("value").rlike(r"^\s*\[")).select(F.explode(F.from_json("value", f"array<{FLOW}>")).alias("c"))
    return mapped.unionByName(listed).select("c.*").where("id is not null")


def read_image_library(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """``(key, …)`` of a JSON file that maps keys to values of a type, such as a state map or a manifest."""
    whole = spark.read.option("wholetext", True).text(path)
    rows = whole.select(F.explode(F.map_entries(F.from_json("value", f"map<string, {fields}>"))).alias("e"))
    return rows.select("e.key", "e.value.*" if fields.strip().startswith("struct") else "e.value")


def read_library(spark: SparkSession, path: str) -> DataFrame:
    """Generated images of a library file."""
    return _json(spark, path, LIBRARY).where("image_gen_generation_id is not null")


def parse_notes(files: DataFrame) -> dict[str, DataFrame]:
    """``note`` (front matter as a map, body) and ``msg`` of Markdown ``files(path, value)``; messages start at ``### Role``."""
    front = F.regexp_extract("value", r"^---\n((?s:.*?))\n---\n", 1)
    pairs = F.filter(F.split(front, "\n"), lambda x: x.rlike(r"^[^:\s][^:]*:"))
    named = F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.regexp_replace(F.trim(F.regexp_replace(x, r"^[^:]*:", "")), r'^"|"$', "").alias("v")))
    # of a repeated key the last line counts
    later = lambda x, i: F.exists(F.slice(named, i + 2, F.size(named)), lambda y: y["k"] == x["k"])
    as_map = F.map_from_entries(F.filter(named, lambda x, i: ~later(x, i)))
    body = F.regexp_replace("value", r"^---\n(?s:.*?)\n---\n", "")
    note = files.select(F.col("path").alias("note_id"), as_map.alias("front"), body.alias("body"))
    parts = F.split("body", r"(?m)^### ", -1)
    rows = note.select("note_id", F.posexplode(F.slice(parts, 2, F.size(parts))).alias("pos", "p"))
    return {"note": note, "msg": rows.select("note_id", "pos", F.trim(F.substring_index("p", "\n", 1)).alias("role"), F.regexp_replace(F.regexp_replace("p", r"^[^\n]*\n?", ""), r"^\s+|\s+$", "").alias("content"))}


def read_notes(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return parse_notes(spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path).select(F.col("_metadata.file_path").alias("path"), "value"))


def archive_members(files: DataFrame) -> DataFrame:
    """``(archive, member, bytes, content)`` of zip files ``(path, content)``; a broken archive has one row without a member."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for info in z.infolist():
                            if not info.is_dir():
                                yield pd.DataFrame({"archive": [path], "member": [info.filename], "bytes": [info.file_size], "content": [z.read(info)]})
                except zipfile.BadZipFile:
                    yield pd.DataFrame({"archive": [path], "member": [None], "bytes": [len(content)], "content": [None]})

    return files.select("path", "content").mapInPandas(members, "archive string, member string, bytes long, content binary")


def expand_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The members of the zip files of a folder, one task a file."""
    return archive_members(spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder))


def read_dim_map(spark: SparkSession, path: str) -> DataFrame:
    """``(key, value)`` of a small JSON map; lists give a row for each of their values."""
    whole = spark.read.option("wholetext", True).text(path)
    one = whole.select(F.explode(F.map_entries(F.from_json("value", "map<string, string>"))).alias("e")).select("e.key", "e.value")
    many = F.from_json("value", "array<string>")
    return one.select("key", F.explode(F.when(F.startswith("value", F.lit("[")), many).otherwise(F.array("value"))).alias("value"))
