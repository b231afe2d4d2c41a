"""Galleries: assets with the request and prompt they came from, in strips."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bank -> what made its images, where the manifest doesn't say.
GENERATORS = {"grok.generadas_imagen": "grok-chat", "grok.generadas_video": "grok-chat", "grok.imagine": "grok-imagine"}


def asset_context(messages: DataFrame) -> DataFrame:
    """First appearance of each linked file of ``messages(note_id, pos, role, content, prompt)``, with the last request
    before it and the last prompt since that request."""
    w = Window.partitionBy("note_id").orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    user = F.lower("role") == "user"
    islands = messages.withColumn("island", F.sum(user.cast("int")).over(upto)).withColumn("request", F.last(F.when(user, F.col("content")), ignorenulls=True).over(upto))
    since = Window.partitionBy("note_id", "island").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    carried = islands.withColumn("prompt", F.last("prompt", ignorenulls=True).over(since))
    links = carried.select("note_id", "pos", "request", "prompt", F.posexplode(F.regexp_extract_all("content", F.lit(r"!\[[^\]]*\]\(([^)]+)\)"), 1)).alias("k", "file"))
    first = F.row_number().over(Window.partitionBy("file").orderBy("note_id", "pos", "k"))
    return links.withColumn("nth", first).where("nth = 1").drop("nth", "k")


def collect_assets(assets: DataFrame, manifest: DataFrame, context: DataFrame) -> DataFrame:
    """``assets(file, bank)`` with title, prompt, generator and date: the manifest first, then the context, then the bank's default."""
    default = F.create_map(*[F.lit(x) for pair in GENERATORS.items() for x in pair])[F.col("bank")]
    met = assets.join(manifest.withColumnRenamed("prompt", "own_prompt"), "file", "left").join(context.select("file", "note_id", "request", "prompt"), "file", "left")
    generated = F.coalesce(F.col("origin"), F.lit("generated")) == "generated"
    return met.select(
        "file", "bank", "note_id", F.coalesce("own_prompt", F.when(generated, F.col("prompt"))).alias("prompt"), F.when(generated, F.coalesce("generator", default)).alias("generator"),
        F.coalesce("title", F.substring("request", 1, 70), "file").alias("title"), "created",
    )


def collect_copilot(notes: DataFrame, files: DataFrame) -> DataFrame:
    """Copilot images by note, with the key of their strip: day and prompt."""
    return notes.join(files.select("file", "bytes"), "file").withColumn("key", F.concat_ws("|", F.date_format("created", "yyyy-MM-dd"), "prompt"))


def group_strips(items: DataFrame) -> DataFrame:
    """Strips by conversation, else by provider and day, newest first."""
    key = F.coalesce(F.concat(F.lit("conv:"), F.col("conv_id")), F.concat_ws(":", "provider", F.date_format("created", "yyyy-MM-dd")))
    out = items.groupBy(key.alias("strip")).agg(F.max("created").alias("latest"), F.count("*").alias("items"), F.array_sort(F.collect_list("file")).alias("files"), F.max("title").alias("title"))
    return out


def collect_posts(notes: DataFrame) -> DataFrame:
    """The newest note of each ``(publication, post_id)`` with the first image of its body."""
    newest = F.row_number().over(Window.partitionBy("publication", "post_id").orderBy(F.desc("mtime"), "note_id"))
    image = F.nullif(F.regexp_extract("body", r"!\[[^\]]*\]\(([^)]+)\)", 1), F.lit(""))
    return notes.withColumn("nth", newest).where("nth = 1").select("publication", "post_id", "note_id", image.alias("image"), "mtime")


def choose_cover(posts: DataFrame, covers: DataFrame, before: DataFrame) -> DataFrame:
    """Cover of each post: the published one's own, else its first image; ``reused`` where the address is as before."""
    met = posts.join(covers.select("post_id", F.col("url").alias("own")), "post_id", "left").join(before.select("post_id", F.col("cover").alias("old")), "post_id", "left")
    cover = F.coalesce(F.when(F.col("published"), F.col("own")), F.col("image"))
    return met.withColumn("cover", cover).select("post_id", "cover", F.col("cover").eqNullSafe(F.col("old")).alias("reused"))
