"""Content blocks, citation markers, pointers and attachments of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convarchive.functions.text import strip_space

#: Artifact type -> (folder, extension).
ARTIFACT_TYPES = {
    "text/markdown": ("markdown", ".md"),
    "text/html": ("html", ".html"),
    "application/vnd.ant.code": ("codigo", ".txt"),
    "image/svg+xml": ("svg", ".svg"),
    "application/vnd.ant.react": ("react", ".jsx"),
    "application/vnd.ant.mermaid": ("mermaid", ".mmd"),
}
#: Fixed value: the folder of other types.
OTHER_TYPES = "otros"
#: Language of a code artifact -> extension.
LANGUAGES = {
    "python": ".py", "javascript": ".js", "typescript": ".ts", "jsx": ".jsx", "tsx": ".tsx", "html": ".html", "css": ".css",
    "json": ".json", "yaml": ".yaml", "sql": ".sql", "bash": ".sh", "shell": ".sh", "go": ".go", "rust": ".rs", "java": ".java",
    "c": ".c", "cpp": ".cpp", "csharp": ".cs", "ruby": ".rb", "php": ".php",
}
#: Citation markers are written between three private-use characters.
#: What kinds of markers stand for.
LINK_KINDS = ["cite", "link", "url", "link_title", "navlist"]
FILE_KINDS = ["filecite"]
IMAGE_KINDS = ["image_group", "image_v2", "i"]
TEXT_KINDS = [
    "entity", "entity_group", "entity_metadata", "products", "product", "product_entity", "product0", "video", "movie",
    "tv_show", "video_game", "businesses_map", "explore_more", "forecast", "genui", "memcite", "map",
]
REF_ID = r"^turn\d+[a-z]+\d+$"
OPEN, SEP, CLOSE = "", "", ""


#: How lines begin that a provider puts in front of custom instructions.
TEMPLATE_LINES = ["Follow the instructions below naturally", "All the following instructions should guide your behavior"]


def fenced(text: Column) -> Column:
    """What stands between the first and the last fence of three backticks, or all of the text."""
    inner = F.regexp_extract(text, r"^(?s:.*?)```(?s:(.*))```", 1)
    return strip_space(F.when(text.rlike(r"```(?s:.*)```"), inner).otherwise(text))


def custom_instructions(profile: Column, instructions: Column) -> Column:
    """Profile and instructions without the provider's template."""
    own = F.filter(F.split(fenced(instructions), "\n"), lambda x: ~strip_space(x).rlike("^(?:" + "|".join(TEMPLATE_LINES) + ")"))
    said = F.regexp_replace(strip_space(F.array_join(own, "\n")), "\n{3,}", "\n\n")
    part = lambda title, x: F.when(x != "", F.concat(F.lit(f"{title}\n"), x))
    return F.concat_ws("\n\n", part("profile", fenced(profile)), part("instructions", said))


def block_text(kind: Column, json: Column) -> Column:
    """Shown text of one content block without parts; empty blocks give ``''``, unknown kinds a labelled notice."""
    get = lambda path: F.coalesce(F.get_json_object(json, f"$.{path}"), F.lit(""))
    lines = F.split(strip_space(F.regexp_replace(F.regexp_replace(get("text"), r"\\r\\n|\\n", "\n"), r"\r\n?", "\n")), "\n")
    cut = lambda n: F.when(F.size(lines) > n, F.concat(F.array_join(F.slice(lines, 1, n), "\n"), F.lit("\n\n… (truncated)"))).otherwise(F.array_join(lines, "\n"))
    name = F.coalesce(F.nullif(get("domain"), F.lit("")), F.nullif(get("title"), F.lit("")), F.nullif(get("url"), F.lit("")), F.lit("unknown file"))
    thoughts = F.from_json(F.coalesce(F.get_json_object(json, "$.thoughts"), F.lit("[]")), "array<struct<summary:string,content:string>>")
    thought = lambda t: F.array_join(F.filter(F.array(t["summary"], t["content"]), lambda x: F.coalesce(strip_space(x), F.lit("")) != ""), "\n\n")
    code = strip_space(get("text"))
    # a document travels as code: JSON with its content and a name or type
    inner = lambda path: F.get_json_object(F.get_json_object(json, "$.text"), f"$.{path}")
    named = F.coalesce(F.nullif(inner("name"), F.lit("")), F.nullif(inner("type"), F.lit("")))
    canvas = F.when(F.startswith(code, F.lit("{")) & inner("content").isNotNull(), F.concat(F.lit("canvas: "), named, F.lit("\n"), inner("content")))
    both = F.array_join(F.filter(F.array(strip_space(get("summary")), strip_space(get("result"))), lambda x: x != ""), "\n\n")
    return (
        F.when(kind == "tether_quote", F.concat(F.lit("file: "), name, F.lit("\n"), cut(40)))
        .when(kind == "user_editable_context", custom_instructions(get("user_profile"), get("user_instructions")))
        .when((kind == "code") & code.isin("", "{}"), "")
        .when((kind == "code") & get("language").isin("json", "unknown", "") & canvas.isNotNull(), canvas)
        .when(kind == "code", F.concat(F.lit("tool\n"), get("text")))
        .when(kind == "execution_output", F.concat(F.lit("result\n"), get("text")))
        .when(kind == "thoughts", F.array_join(F.filter(F.transform(thoughts, thought), lambda x: x != ""), "\n\n"))
        .when(kind == "reasoning_recap", strip_space(get("content")))
        .when(kind == "tether_browsing_display", both)
        .when(kind == "system_error", F.concat(F.lit("error ("), F.coalesce(F.nullif(get("name"), F.lit("")), F.lit("error")), F.lit(")\n"), get("text")))
        .otherwise(F.concat(F.lit("unrendered block ("), F.coalesce(F.nullif(kind, F.lit("")), F.lit("unknown")), F.lit(")")))
    )


def part_quote(json: Column) -> Column:
    """Shown text of a quote that is one part of several, the older form: ten lines at most, each marked as quoted."""
    get = lambda path: F.nullif(F.get_json_object(json, f"$.{path}"), F.lit(""))
    name = F.coalesce(get("domain"), get("title"), get("file"), get("url"), F.lit("unknown file"))
    text = F.regexp_replace(F.regexp_replace(strip_space(F.coalesce(get("text"), F.lit(""))), r"\\r\\n|\\n", "\n"), r"\r\n?", "\n")
    lines = F.split(F.regexp_replace(text, r"\n$", ""), "\n")
    quoted = F.array_join(F.transform(F.slice(lines, 1, 10), lambda x: F.concat(F.lit("> "), x)), "\n")
    shown = F.when(text == "", "> (no content)").when(F.size(lines) > 10, F.concat(quoted, F.lit("\n> \n> ... (truncated)"))).otherwise(quoted)
    return F.concat(F.lit("file: **"), name, F.lit("**\n\n"), shown, F.lit("\n"))


def normalize_blocks(blocks: DataFrame) -> DataFrame:
    """``blocks(…, block)`` of JSON with ``content_type`` and ``content``; blocks that show nothing drop out."""
    kind = F.lower(F.coalesce(F.get_json_object("block", "$.content_type"), F.lit("")))
    out = blocks.withColumn("content_type", kind)
    return out.withColumn("content", block_text(F.col("content_type"), F.col("block"))).where("content <> ''")


def marker_rows(messages: DataFrame) -> DataFrame:
    """``(conv_id, pos, k, kind, refs)``: citation markers in order, with the ids they refer to."""
    body = F.regexp_extract_all("content", F.lit(f"{OPEN}([^{CLOSE}]*){CLOSE}"), 1)
    found = messages.select("conv_id", "pos", F.posexplode(body).alias("k", "body"))
    fields = F.split("body", SEP)
    return found.select("conv_id", "pos", "k", fields[0].alias("kind"), F.slice(fields, 2, F.size(fields)).alias("refs"))


def payload_name(field: Column) -> Column:
    """The name that a widget's field holds: plain text, or the second text of a list (the first is its category); null for ids and the rest."""
    listed = F.filter(F.from_json(field, "array<string>"), lambda x: (x != "") & ~x.rlike(REF_ID) & ~x.rlike(r"^[\d.]+$"))
    plain = strip_space(field)
    return F.when(F.startswith(plain, F.lit("[")), F.coalesce(F.get(listed, 1), F.get(listed, 0))).when((plain != "") & ~plain.rlike(REF_ID) & ~F.startswith(plain, F.lit("{")), plain)


def search_queries(field: Column) -> Column:
    """The queries of an image search's field: one text or a list of them; none for other fields."""
    said = F.when(F.startswith(strip_space(field), F.lit("{")), F.get_json_object(field, "$.query"))
    listed = F.filter(F.from_json(said, "array<string>"), lambda q: q != "")
    return F.coalesce(F.when(F.startswith(said, F.lit("[")), listed), F.when(said != "", F.array(said)), F.array().cast("array<string>"))


def _sources(reference: Column) -> Column:
    """A reference's text as the provider made it, else links to its items, else one to itself; null where it has none of these."""
    there = F.filter(F.coalesce(reference["items"], F.array().cast("array<struct<title:string,attribution:string,url:string>>")), lambda i: F.coalesce(i["url"], F.lit("")) != "")
    name = lambda i: F.coalesce(F.nullif(i["title"], F.lit("")), F.nullif(i["attribution"], F.lit("")), i["url"])
    links = F.transform(there, lambda i: F.concat(F.lit("["), name(i), F.lit("]("), i["url"], F.lit(")")))
    own = F.concat(F.lit("["), F.coalesce(reference["title"], reference["url"]), F.lit("]("), reference["url"], F.lit(")"))
    return F.coalesce(_alt(reference), F.when(F.size(links) > 0, F.concat(F.lit("("), F.array_join(links, " · "), F.lit(")"))), own)


def _alt(reference: Column) -> Column:
    return F.nullif(strip_space(F.coalesce(reference["alt"], F.lit(""))), F.lit(""))


def resolve_markers(messages: DataFrame, references: DataFrame) -> DataFrame:
    """``messages(conv_id, pos, content)`` with markers as links, sources, widget texts and image searches, or as notices where nothing is known.

    ``references(conv_id, ref_id, turn, kind, n, title, url[, alt, items])``: an explicit ``ref_id`` comes first, else the
    n-th reference of its kind in its turn. ``alt`` is a text ready made, ``items(title, attribution, url)`` what a group
    of sources holds. Stray marker characters go.
    """
    for name, kind in (("alt", "string"), ("items", "array<struct<title:string,attribution:string,url:string>>")):
        if name not in references.columns:
            references = references.withColumn(name, F.lit(None).cast(kind))
    what = F.struct("title", "url", "alt", "items")
    refs = marker_rows(messages).select("conv_id", "pos", "k", "kind", F.posexplode_outer("refs").alias("i", "ref"))
    parsed = refs.select("*", *[F.regexp_extract("ref", r"^turn(\d+)([a-z]+)(\d+)$", j).alias(n) for j, n in ((1, "turn"), (2, "type"), (3, "nth"))])
    named = references.where("ref_id is not null").select("conv_id", F.col("ref_id").alias("ref"), what.alias("named"))
    placed = references.select("conv_id", F.col("turn").cast("string").alias("turn"), F.col("kind").alias("type"), F.col("n").cast("string").alias("nth"), what.alias("placed"))
    met = parsed.join(named, ["conv_id", "ref"], "left").join(placed, ["conv_id", "turn", "type", "nth"], "left").withColumn("to", F.coalesce("named", "placed"))
    kind, title = F.col("kind"), F.coalesce("to.title", "to.url")
    shown = (
        F.when(kind.isin(LINK_KINDS), _sources(F.col("to")))
        .when(kind.isin(FILE_KINDS), F.concat(F.lit("(source: "), title, F.lit(")")))
        .when(kind.isin(IMAGE_KINDS), F.when(F.col("ref").rlike("^https?://"), F.col("ref")))
        .when(kind.isin(TEXT_KINDS), F.coalesce(_alt(F.col("to")), title, payload_name(F.col("ref"))))
    )
    one = met.groupBy("conv_id", "pos", "k").agg(
        F.first("kind").alias("kind"), F.array_sort(F.collect_list(F.when(shown.isNotNull(), F.struct("i", shown.alias("s"))))).alias("s"), F.min(F.get(search_queries(F.col("ref")), 0)).alias("query")
    )
    n, notice = F.size("s"), F.concat(F.lit("[unresolved "), F.coalesce(F.nullif("kind", F.lit("")), F.lit("marker")), F.lit("]"))
    images = F.concat(F.lit("["), n.cast("string"), F.lit(" web images"), F.coalesce(F.concat(F.lit(': "'), F.col("query"), F.lit('"')), F.lit("")), F.lit("]"))
    text = F.when((n == 0) & kind.isin(FILE_KINDS), "[cited attachment]").when(n == 0, notice).when(kind.isin(IMAGE_KINDS), images).otherwise(F.array_join(F.transform("s", lambda x: x["s"]), ", "))
    joined = one.select("conv_id", "pos", "k", text.alias("s"))
    all_of = joined.groupBy("conv_id", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda x: x["s"]).alias("shown"))
    around = F.split("content", f"{OPEN}[^{CLOSE}]*{CLOSE}", -1)
    rebuilt = F.array_join(F.flatten(F.zip_with(around, "shown", lambda a, s: F.array(a, F.coalesce(s, F.lit(""))))), "")
    out = messages.join(all_of, ["conv_id", "pos"], "left")
    text = F.when(F.col("shown").isNull(), F.col("content")).otherwise(rebuilt)
    return out.withColumn("content", F.regexp_replace(text, f"[{OPEN}{SEP}{CLOSE}]", "")).drop("shown")


def web_image_refs(messages: DataFrame, triage: DataFrame) -> DataFrame:
    """``(ref, url, queries, conversations, state)`` of image-search markers ``image_group``, with their triage state."""
    marked = marker_rows(messages).where(F.col("kind").isin(IMAGE_KINDS)).withColumn("queries", F.get(F.filter(F.transform("refs", search_queries), lambda q: F.size(q) > 0), 0))
    urls = marked.select("conv_id", "queries", F.explode("refs").alias("url")).where(F.col("url").rlike("^https?://")).select("conv_id", "url", F.explode_outer("queries").alias("query"))
    refs = urls.withColumn("ref", F.substring(F.sha2("url", 256), 1, 16))
    out = refs.groupBy("ref").agg(F.min("url").alias("url"), F.array_sort(F.collect_set("query")).alias("queries"), F.array_sort(F.collect_set("conv_id")).alias("conversations"))
    return out.join(triage.select("ref", "state"), "ref", "left").withColumn("state", F.coalesce("state", F.lit("sin_triar")))


def image_meta(parts: DataFrame) -> DataFrame:
    """Metadata of image parts ``(pointer, part[, model, attachments])`` (JSON): where it comes from, its prompt, size, and what made it.

    ``model`` is the conversation's at that turn, ``attachments`` a map from pointers to the names of uploads.
    """
    get = lambda p: F.get_json_object("part", f"$.{p}")
    gen = F.coalesce(get("metadata.dalle.gen_id"), get("metadata.generation.gen_id"))
    prompt = F.nullif(get("metadata.dalle.prompt"), F.lit(""))
    generated = gen.isNotNull() | prompt.isNotNull()
    model = F.col("model") if "model" in parts.columns else F.lit(None).cast("string")
    attachment = F.col("attachments")[F.col("pointer")] if "attachments" in parts.columns else F.lit(None).cast("string")
    return parts.select(
        "pointer",
        F.when(generated, "generated").otherwise("uploaded").alias("origin"),
        prompt.alias("prompt"),
        gen.alias("gen_id"),
        F.coalesce(get("metadata.generation.parent_gen_id"), get("metadata.dalle.parent_gen_id")).isNotNull().alias("is_edit"),
        get("width").cast("int").alias("width"),
        get("height").cast("int").alias("height"),
        F.when(generated, F.when(prompt.isNotNull(), "chatgpt-dalle").otherwise("chatgpt-imagen")).alias("generator"),
        F.when(generated, model).alias("model"),
        attachment.alias("attachment"),
    )


def resolve_pointers(refs: DataFrame, assets: DataFrame, omit: bool = False) -> DataFrame:
    """``refs(…, pointer)`` with ``state`` (linked, missing or omitted) and ``shown``; asset files are ``<id>-<uuid>.<ext>`` or ``<id>.dat``."""
    known = assets.select(F.regexp_extract("file", r"^(file[-_][A-Za-z0-9]+)", 1).alias("pointer"), "file").groupBy("pointer").agg(F.min("file").alias("file"))
    met = refs.join(known, "pointer", "left")
    state = F.when(F.lit(omit), "omitted").when(F.col("file").isNotNull(), "linked").otherwise("missing")
    shown = F.when(state == "linked", F.concat(F.lit("![]("), F.col("file"), F.lit(")"))).when(state == "missing", F.concat(F.lit("[missing image:"), F.col("pointer"), F.lit("]")))
    return met.select(*refs.columns, state.alias("state"), shown.alias("shown"))


def resolve_grok_files(refs: DataFrame, blobs: DataFrame) -> DataFrame:
    """``refs(…, uuid)`` as embed, link or notice by the blob's sniffed type; a blob's uuid is the last but one segment of its path."""
    parts = F.split("path", "/")
    known = blobs.select(F.get(parts, F.size(parts) - 2).alias("uuid"), "ext")
    met = refs.join(known, "uuid", "left")
    shown = F.when(F.col("ext").isNull(), "notice").when(F.col("ext").isin("png", "jpg", "gif", "webp"), "embed").otherwise("link")
    return met.withColumn("shown", shown)


def artifact_path(kind: Column, language: Column, name: Column) -> Column:
    """Folder, name and extension of an artifact."""
    table = lambda pairs: F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    folder = F.coalesce(table([(k, x) for k, (x, _) in ARTIFACT_TYPES.items()])[F.coalesce(kind, F.lit(""))], F.lit(OTHER_TYPES))
    ext = F.coalesce(table([(k, x) for k, (_, x) in ARTIFACT_TYPES.items()])[F.coalesce(kind, F.lit(""))], F.lit(".txt"))
    by_language = F.coalesce(table(LANGUAGES.items())[F.lower(F.coalesce(language, F.lit("")))], F.lit(".txt"))
    return F.concat(folder, F.lit("/"), name, F.when(kind == "application/vnd.ant.code", by_language).otherwise(ext))


def attach_library(messages: DataFrame, library: DataFrame, referenced: DataFrame, files: DataFrame) -> DataFrame:
    """Library images of a thread as trailing tool messages ``(conv_id, pos, role, content)``.

    ``library(file_id, conv_id, title, created)``; what is referenced already or has no file is skipped.
    """
    wanted = library.join(referenced.select("file_id"), "file_id", "left_anti").join(files.select("file_id"), "file_id", "left_semi")
    last = messages.groupBy("conv_id").agg(F.max("pos").alias("last"))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("created", "file_id"))
    content = F.concat(F.col("title"), F.lit(" ("), F.date_format("created", "yyyy-MM-dd HH:mm"), F.lit(")"))
    return wanted.join(last, "conv_id").select("conv_id", (F.col("last") + nth).alias("pos"), F.lit("tool").alias("role"), content.alias("content"))
