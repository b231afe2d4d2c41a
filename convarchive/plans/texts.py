"""Queries of text functions, content blocks, markers and pointers."""

from __future__ import annotations

from pyspark.sql import functions as F

from convarchive.functions import html, text
from convarchive.operators import lineage
from convarchive.operators import blocks as b
from convarchive.plans import derived as v
from convarchive.plans.registry import query

C = "conversations"
DOCS = "documents"


def docs(spark, d):
    return v.table(spark, d, DOCS)


@query("D1_render_parts", "SELECT conv_id, turn, CASE (turn % 3) WHEN 0 THEN text || chr(10) || '[image:f' || conv_id || ']' WHEN 1 THEN '[image:f' || conv_id || ']' || chr(10) || '[unrendered audio]' ELSE text END AS content FROM conversations")
def render_parts(spark, d):
    part = lambda k, t, p: F.struct(F.lit(k).alias("kind"), t.alias("text"), p.alias("pointer"))
    none, pointer = F.lit(None).cast("string"), F.concat(F.lit("f"), F.col("conv_id").cast("string"))
    t, i, a = part("text", F.col("text"), none), part("image", none, pointer), part("audio", none, none)
    parts = F.when(F.col("turn") % 3 == 0, F.array(t, i)).when(F.col("turn") % 3 == 1, F.array(i, a)).otherwise(F.array(t))
    return v.table(spark, d, C).select("conv_id", "turn", text.render_parts(parts).alias("content"))


KINDS = ["tether_quote", "code", "execution_output", "thoughts", "reasoning_recap", "tether_browsing_display", "system_error", "novel", "user_editable_context", "code"]


@query(
    "D2_normalize_blocks",
    r"""WITH c AS (SELECT conv_id, turn, (conv_id + turn) % 10 AS k, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM conversations)
SELECT * FROM (SELECT conv_id, turn, CASE k WHEN 0 THEN 'file: d' || conv_id || chr(10) || t WHEN 1 THEN CASE WHEN turn % 2 = 0 THEN '' ELSE 'tool' || chr(10) || text END WHEN 2 THEN 'result' || chr(10) || text
  WHEN 3 THEN 's' || chr(10) || chr(10) || text WHEN 4 THEN t WHEN 5 THEN t WHEN 6 THEN 'error (E)' || chr(10) || text WHEN 7 THEN 'unrendered block (novel)'
  WHEN 8 THEN 'profile' || chr(10) || 'me' || chr(10) || chr(10) || 'instructions' || chr(10) || 'be brief ' || conv_id ELSE 'canvas: N' || conv_id || chr(10) || 'doc ' || turn END AS content FROM c) WHERE content <> ''""",
)
def normalize_blocks(spark, d):
    k = ((F.col("conv_id") + F.col("turn")) % 10).cast("int")
    number = F.col("conv_id").cast("string")
    canvas = F.to_json(F.struct(F.concat(F.lit("N"), number).alias("name"), F.concat(F.lit("doc "), F.col("turn").cast("string")).alias("content")))
    said = F.concat(F.lit("Preface\n```\nFollow the instructions below naturally, always.\nbe brief "), number, F.lit("\n```"))
    kind = F.get(F.array(*map(F.lit, KINDS)), k)
    body = F.struct(
        kind.alias("content_type"), F.when((k == 1) & (F.col("turn") % 2 == 0), "{}").when(k == 9, canvas).otherwise(F.col("text")).alias("text"), F.lit("Given:\n```me```").alias("user_profile"), said.alias("user_instructions"), F.concat(F.lit("d"), F.col("conv_id").cast("string")).alias("domain"), F.lit("E").alias("name"),
        F.col("text").alias("content"), F.lit(" ").alias("summary"), F.col("text").alias("result"), F.array(F.struct(F.lit("s").alias("summary"), F.col("text").alias("content"))).alias("thoughts"),
    )
    return b.normalize_blocks(v.table(spark, d, C).select("conv_id", "turn", F.to_json(body).alias("block"))).select("conv_id", "turn", "content")


@query(
    "D2_part_quotes",
    r"""WITH p AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN text ELSE array_to_string(list_transform(range(1, 9 + turn), lambda i: 'l' || i), chr(10)) END AS t FROM conversations),
l AS (SELECT conv_id, turn, t, string_split(regexp_replace(t, '^\s+|\s+$', '', 'g'), chr(10)) AS l FROM p)
SELECT conv_id, turn, 'file: **' || CASE WHEN turn % 2 = 0 THEN 'd' || conv_id ELSE 'f.txt' END || '**' || chr(10) || chr(10) || CASE WHEN t = '' THEN '> (no content)' ELSE array_to_string(list_transform(l[1:10], lambda x: '> ' || x), chr(10)) || CASE WHEN len(l) > 10 THEN chr(10) || '> ' || chr(10) || '> ... (truncated)' ELSE '' END END || chr(10) AS content FROM l""",
)
def part_quotes(spark, d):
    turn = F.col("turn")
    many = F.array_join(F.transform(F.sequence(F.lit(1), (turn + 8).cast("int")), lambda i: F.concat(F.lit("l"), i.cast("string"))), "\n")
    said = F.when(turn % 3 == 0, "").when(turn % 3 == 1, F.col("text")).otherwise(many)
    part = F.to_json(F.struct(F.when(turn % 2 == 0, F.concat(F.lit("d"), F.col("conv_id").cast("string"))).alias("domain"), F.lit("f.txt").alias("file"), said.alias("text")))
    return v.table(spark, d, C).select("conv_id", "turn", b.part_quote(part).alias("content"))


@query("D7_attachment_lines", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '- attached: a' || doc_id || '.pdf (' || n_chars || ' tokens)' ELSE '- attached: b.txt' END AS lines FROM documents")
def attachment_lines(spark, d):
    a = lambda n, m, t: F.struct(n.alias("name"), F.lit(m).alias("mime"), t.alias("tokens"))
    none, img = F.lit(None).cast("long"), F.lit("i.png")
    one = F.array(a(F.concat(F.lit("a"), F.col("doc_id").cast("string"), F.lit(".pdf")), "application/pdf", F.col("n_chars")), a(img, "image/png", none))
    two = F.array(a(img, "image/jpeg", none), a(F.lit("b.txt"), None, none))
    return docs(spark, d).select("doc_id", text.attachment_lines(F.when(F.col("doc_id") % 2 == 0, one).otherwise(two)).alias("lines"))


@query("D8_claude_attachments", "SELECT doc_id, '> f' || doc_id || chr(10) || '> ' || replace(CASE WHEN length(text) > 800 THEN substr(text, 1, 800) || '…' ELSE text END, chr(10), chr(10) || '> ') AS quoted FROM documents")
def claude_attachments(spark, d):
    return docs(spark, d).select("doc_id", text.quoted_extract(F.concat(F.lit("f"), F.col("doc_id").cast("string")), F.col("text")).alias("quoted"))


def marked(spark, d):
    c = v.table(spark, d, C)
    ref = F.concat(F.lit("turn"), F.col("turn").cast("string"), F.lit("search"), (F.col("conv_id") % 3).cast("string"))
    url = F.concat(F.lit("https://img.example/"), (F.col("conv_id") % 9).cast("string"))
    cite = F.concat(F.lit(b.OPEN + "cite" + b.SEP), ref, F.lit(b.CLOSE))
    image = F.concat(F.lit(b.OPEN + "image_group" + b.SEP + '{"query":["cats","big dogs"]}' + b.SEP), url, F.lit(b.CLOSE))
    entity = F.concat(F.lit(b.OPEN + "entity" + b.SEP + '["place","P'), F.col("conv_id").cast("string"), F.lit('",0]' + b.CLOSE))
    file = F.concat(F.lit(b.OPEN + "filecite" + b.SEP + "turn0file9" + b.CLOSE))
    return c.select("conv_id", F.col("turn").alias("pos"), F.concat("text", F.lit(" "), cite, F.lit(" "), F.when(F.col("turn") == 0, image).otherwise(b.SEP), F.lit("end "), entity, F.lit(" "), file).alias("content"))


def references(spark, d):
    c = v.table(spark, d, C).where("turn % 2 = 0")
    item = lambda *x: F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(("title", "attribution", "url"), x, strict=True)])
    return c.select(
        "conv_id", F.lit(None).cast("string").alias("ref_id"), "turn", F.lit("search").alias("kind"), (F.col("conv_id") % 3).alias("n"), F.concat(F.lit("T"), F.col("turn").cast("string")).alias("title"), F.concat(F.lit("https://x/"), F.col("conv_id").cast("string")).alias("url"),
        F.when(F.col("turn") % 4 == 0, F.when(F.col("conv_id") % 2 == 0, " ([Site](https://alt/)) ").otherwise(" ")).alias("alt"),
        F.when(F.col("conv_id") % 3 == 0, F.array(item("One", None, "https://one/"), item("", "Two", "https://two/"), item("none", None, None))).alias("items"))


@query("D9_resolve_markers", "SELECT conv_id, turn AS pos, text || ' ' || CASE WHEN turn % 4 = 0 AND conv_id % 2 = 0 THEN '([Site](https://alt/))' WHEN turn % 2 = 0 AND conv_id % 3 = 0 THEN '([One](https://one/) · [Two](https://two/))' WHEN turn % 2 = 0 THEN '[T' || turn || '](https://x/' || conv_id || ')' ELSE '[unresolved cite]' END || ' ' || CASE WHEN turn = 0 THEN '[1 web images: \"cats\"]' ELSE '' END || 'end P' || conv_id || ' [cited attachment]' AS content FROM conversations")
def resolve_markers(spark, d):
    return b.resolve_markers(marked(spark, d), references(spark, d))


@query(
    "D10_web_image_refs",
    "WITH u AS (SELECT 'https://img.example/' || (conv_id % 9) AS url, conv_id FROM conversations WHERE turn = 0) "
    "SELECT substr(sha256(url), 1, 16) AS ref, url, string_agg(DISTINCT conv_id::VARCHAR, ',' ORDER BY conv_id::VARCHAR) AS conversations, CASE WHEN substr(sha256(url), 1, 16) < '8' THEN 'rescatada' ELSE 'sin_triar' END AS state, 'big dogs,cats' AS queries FROM u GROUP BY url",
)
def web_image_refs(spark, d):
    refs = marked(spark, d)
    some = v.table(spark, d, C).where("turn = 0").select(F.substring(F.sha2(F.concat(F.lit("https://img.example/"), (F.col("conv_id") % 9).cast("string")), 256), 1, 16).alias("ref")).distinct()
    out = b.web_image_refs(refs, some.where("ref < '8'").withColumn("state", F.lit("rescatada")))
    return out.withColumn("queries", F.array_join("queries", ",")).withColumn("conversations", F.array_join(F.array_sort(F.transform("conversations", lambda c: c.cast("string"))), ","))


@query("D11_image_meta", "SELECT 'p' || doc_id AS pointer, CASE WHEN doc_id % 2 = 0 THEN 'generated' ELSE 'uploaded' END AS origin, CASE WHEN doc_id % 2 = 0 THEN lang END AS prompt, CASE WHEN doc_id % 2 = 0 THEN 'g' || doc_id END AS gen_id, doc_id % 6 = 0 AS is_edit, (n_chars % 512)::INT AS width, 256 AS height, CASE WHEN doc_id % 2 = 0 THEN 'chatgpt-dalle' END AS generator, CASE WHEN doc_id % 2 = 0 THEN 'm' || (doc_id % 3) END AS model, CASE WHEN doc_id % 5 = 0 THEN 'a' || doc_id END AS attachment FROM documents")
def image_meta(spark, d):
    even = F.col("doc_id") % 2 == 0
    dalle = F.when(even, F.struct(F.col("lang").alias("prompt"), F.concat(F.lit("g"), F.col("doc_id").cast("string")).alias("gen_id"))).alias("dalle")
    generation = F.when(F.col("doc_id") % 6 == 0, F.struct(F.lit("q").alias("parent_gen_id"))).alias("generation")
    part = F.to_json(F.struct((F.col("n_chars") % 512).alias("width"), F.lit(256).alias("height"), F.struct(dalle, generation).alias("metadata")))
    key = F.col("doc_id").cast("string")
    attachments = F.when(F.col("doc_id") % 5 == 0, F.create_map(F.concat(F.lit("p"), key), F.concat(F.lit("a"), key)))
    rows = docs(spark, d).select(F.concat(F.lit("p"), key).alias("pointer"), part.alias("part"), F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string")).alias("model"), attachments.alias("attachments"))
    return b.image_meta(rows)


@query("D12_resolve_pointers", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'linked' ELSE 'missing' END AS state, CASE WHEN doc_id % 3 = 0 THEN '![](file-A' || doc_id || '-u.png)' ELSE '[missing image:file-A' || doc_id || ']' END AS shown FROM documents")
def resolve_pointers(spark, d):
    refs = docs(spark, d).select("doc_id", F.concat(F.lit("file-A"), F.col("doc_id").cast("string")).alias("pointer"))
    assets = refs.where("doc_id % 3 = 0").select(F.concat("pointer", F.lit("-u.png")).alias("file"))
    return b.resolve_pointers(refs, assets).select("doc_id", "state", "shown")


@query("D13_resolve_grok_files", "SELECT doc_id, 'u' || doc_id AS uuid, CASE doc_id % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'mp4' END AS ext, CASE doc_id % 3 WHEN 0 THEN 'embed' WHEN 1 THEN 'link' ELSE 'notice' END AS shown FROM documents")
def resolve_grok_files(spark, d):
    refs = docs(spark, d).select("doc_id", F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("uuid"))
    blobs = refs.where("doc_id % 3 < 2").select(F.concat(F.lit("ttl/x/"), F.col("uuid"), F.lit("/content")).alias("path"), F.when(F.col("doc_id") % 3 == 0, "png").otherwise("mp4").alias("ext"))
    return b.resolve_grok_files(refs, blobs)


@query("D14_artifact_path", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'codigo/a.py' WHEN 1 THEN 'html/a.html' WHEN 2 THEN 'otros/a.txt' ELSE 'codigo/a.txt' END AS path FROM documents")
def artifact_path(spark, d):
    k = (F.col("doc_id") % 4).cast("int")
    kind = F.get(F.array(*map(F.lit, ["application/vnd.ant.code", "text/html", "x/y", "application/vnd.ant.code"])), k)
    return docs(spark, d).select("doc_id", b.artifact_path(kind, F.when(k == 0, "Python"), F.lit("a")).alias("path"))


HEADS = ["89504E470D0A1A0A00000000", "FFD8FFE000104A4649460001", "47494638396101000100", "52494646000000005745425056503820", "000000186674797069736F6D", "3C68746D6C3E", "", "7B2261223A317D", "00112233"]


def blobs(spark, d):
    return docs(spark, d).select("doc_id", F.unhex(F.get(F.array(*map(F.lit, HEADS)), (F.col("doc_id") % 9).cast("int"))).alias("content"))


@query("D15_sniff_ext", "SELECT doc_id, ['png', 'jpg', 'gif', 'webp', 'mp4', 'bin', 'bin', 'bin', 'bin'][doc_id % 9 + 1] AS ext FROM documents")
def sniff_ext(spark, d):
    return blobs(spark, d).select("doc_id", text.sniff_ext(F.col("content")).alias("ext"))


@query("D16_is_asset", "SELECT doc_id, doc_id % 9 NOT IN (5, 6, 7) AS ok FROM documents")
def is_asset(spark, d):
    return blobs(spark, d).select("doc_id", text.is_asset(F.col("content")).alias("ok"))


LIBRARY = """li AS (SELECT 'f' || event_id AS file_id, user_id % 100 AS conv_id, event_type AS title, ts AS created, event_id FROM events),
al AS (SELECT conv_id, mx + row_number() OVER (PARTITION BY conv_id ORDER BY created, file_id) AS pos, 'tool' AS role, title || ' (' || strftime(created, '%Y-%m-%d %H:%M') || ')' AS content
  FROM li JOIN (SELECT conv_id, max(turn) AS mx FROM conversations GROUP BY 1) USING (conv_id) WHERE event_id % 3 <> 0 AND event_id % 7 <> 0)"""


def library(spark, d):
    e = v.table(spark, d, "events")
    return e.select(F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("file_id"), (F.col("user_id") % 100).alias("conv_id"), F.col("event_type").alias("title"), F.col("ts").alias("created"), "event_id")


@query("D17_attach_library", v.with_sql(LIBRARY, "SELECT * FROM al"))
def attach_library(spark, d):
    lib = library(spark, d)
    messages = v.table(spark, d, C).select("conv_id", F.col("turn").alias("pos"))
    return b.attach_library(messages, lib.drop("event_id"), lib.where("event_id % 3 = 0"), lib.where("event_id % 7 <> 0"))


@query(
    "D18_smart_title",
    r"WITH f AS (SELECT conv_id, arg_min(text, turn) AS t FROM conversations WHERE role = 'user' GROUP BY 1) "
    r"SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'Kept' ELSE array_to_string(regexp_extract_all(t, '[\p{L}\p{N}_]+')[1:8], ' ') END AS title FROM f",
)
def smart_title(spark, d):
    first = v.table(spark, d, C).where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("t"))
    return first.select("conv_id", text.smart_title(F.when(F.col("conv_id") % 3 == 0, "Kept").when(F.col("conv_id") % 3 == 1, "New chat"), F.col("t")).alias("title"))


@query(
    "D19_slugify",
    r"SELECT doc_id, substr(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) AS slug, "
    r"substr(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) AS ascii_slug FROM documents",
)
def slugify(spark, d):
    t = F.col("text")
    return docs(spark, d).select("doc_id", text.slugify(t).alias("slug"), text.slugify(t, "ascii").alias("ascii_slug"))


@query("D20_safe_name", r"SELECT doc_id, substr(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}\-_.() ]', '', 'g'), '^\s+|\s+$', '', 'g'), 1, 60) AS name FROM documents")
def safe_name(spark, d):
    return docs(spark, d).select("doc_id", text.safe_name(F.col("text"), 60).alias("name"))


@query("D21_word_count", rf"SELECT doc_id, {v.WORDS.format('text')}::INT AS split_words, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'))::INT AS regex_words FROM documents")
def word_count(spark, d):
    return docs(spark, d).select("doc_id", text.word_count(F.col("text")).alias("split_words"), text.word_count(F.col("text"), "regex").alias("regex_words"))


@query("D22_epoch_date", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def epoch_date(spark, d):
    return v.table(spark, d, "events").select("event_id", text.epoch_date(F.unix_timestamp("ts")).cast("string").alias("day"))


@query("D23_normalize_newlines", r"SELECT doc_id, regexp_replace(replace(text, chr(10), chr(10) || chr(10) || chr(10)), '\n{3,}', chr(10) || chr(10), 'g') AS text FROM documents")
def normalize_newlines(spark, d):
    return docs(spark, d).select("doc_id", text.normalize_newlines(F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n\r\n\n"))).alias("text"))


@query("D24_infer_date", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '2024-05-06' WHEN 1 THEN '2023-01-02' WHEN 2 THEN '2022-12-31' ELSE '0000-00-00' END AS date FROM documents")
def infer_date(spark, d):
    k = F.col("doc_id") % 4
    return docs(spark, d).select("doc_id", text.infer_date(F.when(k == 0, "2024-05-06T10:00"), F.when(k < 2, "2023-01-02_note.md"), F.when(k == 2, "On 2022-12-31").otherwise("no")).alias("date"))


@query("D25_html_to_markdown")
def html_to_markdown(spark, d):
    return v.table(spark, d, "pages").select("page_id", html.html_to_markdown("html").alias("markdown"))


@query("D26_to_number", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN n_chars + 0.5 WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE 1234 END::DOUBLE AS value FROM documents")
def to_number(spark, d):
    k = F.col("doc_id") % 4
    cell = F.when(k == 0, F.concat(F.lit(" "), F.col("n_chars").cast("string"), F.lit(".5"))).when(k == 1, "_-").when(k == 2, " ").otherwise("1,234")
    return docs(spark, d).select("doc_id", text.to_number(cell).alias("value"))


@query("D27_note_tag", r"SELECT doc_id, regexp_replace(regexp_replace(text, '[^\p{L}\p{N}_/]+', '-', 'g'), '^-+|-+$', '', 'g') AS tag FROM documents")
def note_tag(spark, d):
    return docs(spark, d).select("doc_id", text.note_tag(F.col("text")).alias("tag"))


@query("D30_excerpt", rf"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^\s*(#|!\[|>|\||---|\*\*\*|$)')), ' '), '\s+'), lambda t: t <> '')[1:50], ' ') || ' see' AS excerpt FROM documents")
def excerpt(spark, d):
    body = F.concat(F.lit("# Title\nsub\n> quote\n"), F.col("text"))
    return docs(spark, d).select("doc_id", F.concat(text.excerpt(body, F.lit("sub")), F.lit(" see")).alias("excerpt"))


@query("D31_title_markers", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS covers, CASE p_partkey % 3 WHEN 0 THEN 1 ELSE 0 END AS remixes FROM part")
def title_markers(spark, d):
    k = F.col("p_partkey") % 3
    title = F.concat("p_name", F.when(k == 0, " (Cover) (Remix) (Cover)").when(k == 1, "(Cover)").otherwise("Cover"))
    of = lambda m: F.aggregate(F.filter(text.title_markers(title), lambda x: x["marker"] == m), F.lit(0), lambda a, x: a + x["n"])
    return v.table(spark, d, "part").select("p_partkey", of("Cover").alias("covers"), of("Remix").alias("remixes"))


@query("D32_drift_flags", "SELECT doc_id, doc_id % 4 = 0 AS private_use, doc_id % 5 = 0 AS nul, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS raw_json FROM documents")
def drift_flags(spark, d):
    k = F.col("doc_id")
    body = F.concat("text", F.when(k % 4 == 0, b.OPEN).otherwise(""), F.when(k % 5 == 0, "\x00").otherwise(""), F.when(k % 3 == 0, '\n{"content_type": "code"}\n{"content_type"').otherwise("\n{}"))
    return docs(spark, d).select("doc_id", text.has_private_use(body).alias("private_use"), text.has_nul(body).alias("nul"), text.raw_json_lines(body).alias("raw_json"))


@query("D33_unwrap", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN value WHEN 1 THEN event_id END::DOUBLE AS value FROM events")
def unwrap(spark, d):
    k = F.col("event_id") % 3
    json = F.when(k == 0, F.to_json(F.struct(F.lit("ok").alias("status"), "value"))).when(k == 1, F.col("event_id").cast("string")).otherwise('{"status": "none"}')
    return v.table(spark, d, "events").select("event_id", text.unwrap(json).alias("value"))


#: Ids five levels down, in lists, beside values that are none, and under keys and with characters that are written as escapes.
IDS_JSON = """js AS (SELECT event_id, '{"parts": [{"content": {"clip_outputs": [{"clip_id": "a' || event_id || '", "x": {"clip_id": {"clip_ids": ["deep' || event_id % 5 || '"]}}}], "stems": [{"clip_id": 7}]}}, {"args": {"clip_ids": ["b' || event_id % 7 ||
  '", 3, {"clip_id": "inside"}, null, ["list"], "c]\\"' || event_id % 3 || '"], "text": "\\"clip_id\\": \\"said\\""}}], "clip_ids": {"clip_id": "d' || event_id % 2 || '"}, "clip\\u005fid": "e\\u00e9"}' AS j FROM events)"""


def ids_json(k):
    s = lambda c: c.cast("string")
    return F.concat(
        F.lit('{"parts": [{"content": {"clip_outputs": [{"clip_id": "a'), s(k), F.lit('", "x": {"clip_id": {"clip_ids": ["deep'), s(k % 5), F.lit('"]}}}], "stems": [{"clip_id": 7}]}}, {"args": {"clip_ids": ["b'), s(k % 7),
        F.lit('", 3, {"clip_id": "inside"}, null, ["list"], "c]\\"'), s(k % 3), F.lit('"], "text": "\\"clip_id\\": \\"said\\""}}], "clip_ids": {"clip_id": "d'), s(k % 2), F.lit('"}, "clip\\u005fid": "e\\u00e9"}'),
    )


@query(
    "D34_collect_ids",
    v.with_sql(
        IDS_JSON,
        "SELECT DISTINCT event_id, t.value->>'$' AS clip_id FROM js, json_tree(js.j) t WHERE t.type = 'VARCHAR' AND t.path NOT LIKE '%clip_ids[%' AND (t.key = 'clip_id' OR (t.path LIKE '%.clip_ids' AND t.fullkey LIKE '%]'))",
    ),
)
def collect_ids(spark, d):
    rows = v.table(spark, d, "events").select("event_id", ids_json(F.col("event_id")).alias("json"))
    return lineage.clip_ids(rows, "json", "event_id")
