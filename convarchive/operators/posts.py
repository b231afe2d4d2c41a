"""Posts of publications: statistics, status, indexes and what is absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convarchive.functions.text import word_count


#: Compares letters and accents, not case.
TITLES = "UNICODE_CI"


def join_stats(posts: DataFrame, stats: DataFrame) -> DataFrame:
    """Posts with their statistics row by title and day; of repeated rows the last (by ``row_no``) wins.

    Titles are compared under a Unicode collation that knows neither case nor how a letter is composed.
    """
    key = lambda df: df.withColumns({"__title": F.collate("title", TITLES), "__day": F.substring("post_date", 1, 10)})
    measures = [c for c in stats.columns if c not in ("title", "post_date", "row_no")]
    last = key(stats).groupBy("__title", "__day").agg(F.max(F.struct("row_no", *measures)).alias("s")).select("__title", "__day", *[F.col(f"s.{c}").alias(c) for c in measures], F.lit(True).alias("has_stats"))
    return key(posts).join(last, ["__title", "__day"], "left").drop("__title", "__day").fillna(False, ["has_stats"])


def post_status(is_published: Column, post_date: Column, has_stats: Column) -> Column:
    dated = F.nullif(post_date, F.lit("")).isNotNull()
    return F.when(is_published, "published").when(dated | F.coalesce(has_stats, F.lit(False)), "retired").otherwise("draft")


def post_notes(posts: DataFrame) -> DataFrame:
    """Note rows of posts: metadata, tags, words and a notice for podcasts without audio."""
    return posts.select(
        "publication", "post_id", "title", post_status(F.col("is_published"), F.col("post_date"), F.col("has_stats")).alias("status"), F.substring("post_date", 1, 10).alias("date"),
        word_count(F.coalesce("markdown", F.lit(""))).alias("words"), F.concat(F.lit("post/"), F.lower(F.coalesce("section", F.lit("none")))).alias("tag"),
        F.when((F.col("type") == "podcast") & F.col("podcast_url").isNull(), "audio not in the export").alias("notice"), "views",
    )


def post_index(notes: DataFrame) -> DataFrame:
    """``(publication, list, key, posts, titles)``: by month (newest first when read by key), retired and draft lists, sections."""
    rows = notes.select(
        "publication", "title", "date",
        F.explode(
            F.array(
                F.struct(F.when(F.col("status") == "published", "month").otherwise(F.col("status")).alias("list"), F.when(F.col("status") == "published", F.substring("date", 1, 7)).otherwise("").alias("key")),
                F.struct(F.lit("section").alias("list"), F.col("tag").alias("key")),
            )
        ).alias("x"),
    )
    listed = rows.groupBy("publication", "x.list", "x.key").agg(F.count("*").alias("posts"), F.sort_array(F.collect_list(F.struct("date", "title")), asc=False).alias("t"))
    return listed.select("publication", "list", "key", "posts", F.transform("t", lambda x: x["title"]).alias("titles"))


def post_stats(notes: DataFrame) -> DataFrame:
    """Totals per publication and overall (null)."""
    one = lambda s: F.count_if(F.col("status") == s).alias(s)
    return notes.rollup("publication").agg(one("published"), one("retired"), one("draft"), F.sum("words").alias("words"), F.sum("views").alias("views"))


def post_absences(posts: DataFrame) -> DataFrame:
    """``(metric, n)`` of what an export lacks: remote images, podcasts without audio, posts without statistics; comments only if there is such a column."""
    metrics = {
        "remote images": F.sum(F.regexp_count("html", F.lit(r"<img[^>]+src="))),
        "podcasts without audio": F.count_if((F.col("type") == "podcast") & F.col("podcast_url").isNull()),
        "without statistics": F.count_if(~F.col("has_stats")),
    }
    if "comments" in posts.columns:
        metrics["comments"] = F.sum("comments")
    one = posts.agg(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("long").alias("n")) for k, v in metrics.items()]).alias("m"))
    return one.select(F.explode("m").alias("m")).select("m.*")


def posts_without_html(posts: DataFrame, files: DataFrame) -> DataFrame:
    return posts.join(files.select("post_id"), "post_id", "left_anti").select("post_id", "title")
