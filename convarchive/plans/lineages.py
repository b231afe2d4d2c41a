"""Queries of music lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from convarchive.operators import lineage as k
from convarchive.plans import derived as v
from convarchive.plans.registry import query

#: Clips of parts: the parent is a third of the key; every 40th is its own parent, every 50th pair a cycle.
CLIPS = """cl AS (
  SELECT lpad(p_partkey::VARCHAR, 8, '0') AS clip_id, p_brand AS title, p_size AS created, CASE WHEN p_size % 5 <> 0 THEN p_retailprice END AS duration, p_size % 2 = 0 AS liked, p_size % 17 = 0 AS deleted,
    CASE p_size % 4 WHEN 0 THEN 'audio__create_song' WHEN 1 THEN 'audio__render_edit' WHEN 2 THEN 'audio__split_stems' ELSE 'odd' END AS op,
    CASE p_partkey % 10 WHEN 0 THEN ['Persona'] WHEN 5 THEN ['Full Song', 'Cover'] END AS secondary, CASE p_size % 7 WHEN 0 THEN '' WHEN 1 THEN 'la la' END AS lyrics, CASE WHEN p_size % 3 = 0 THEN p_type END AS project, CASE WHEN p_size % 6 = 0 THEN 'v' || (p_partkey % 40) END AS conversation_id,
    CASE WHEN p_partkey % 40 = 0 THEN p_partkey WHEN p_partkey % 50 = 1 THEN p_partkey + 1 WHEN p_partkey % 50 = 2 THEN p_partkey - 1 WHEN p_partkey > 2 THEN p_partkey // 3 END AS up FROM part),
cp AS (SELECT *, CASE WHEN lpad(up::VARCHAR, 8, '0') <> clip_id AND lpad(up::VARCHAR, 8, '0') IN (SELECT clip_id FROM cl) THEN lpad(up::VARCHAR, 8, '0') END AS parent_id FROM cl),
ch AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY created, clip_id) AS nth FROM cp),
dw AS (SELECT clip_id, clip_id AS root_id, 0 AS depth, '0' AS code FROM ch WHERE parent_id IS NULL UNION ALL SELECT ch.clip_id, root_id, depth + 1, code || '.' || nth FROM ch JOIN dw ON ch.parent_id = dw.clip_id)"""


def clips(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size")
    up = F.when(key % 40 == 0, key).when(key % 50 == 1, key + 1).when(key % 50 == 2, key - 1).when(key > 2, F.floor(key / 3))
    pad = lambda c: F.lpad(c.cast("string"), 8, "0")
    return v.table(spark, d, "part").select(
        pad(key).alias("clip_id"), F.col("p_brand").alias("title"), size.alias("created"), F.when(size % 5 != 0, F.col("p_retailprice").cast("double")).alias("duration"), (size % 2 == 0).alias("liked"), (size % 17 == 0).alias("deleted"),
        F.when(size % 4 == 0, "audio__create_song").when(size % 4 == 1, "audio__render_edit").when(size % 4 == 2, "audio__split_stems").otherwise("odd").alias("op"), F.when(size % 3 == 0, F.col("p_type")).alias("project"),
        F.when(size % 6 == 0, F.concat(F.lit("v"), (key % 40).cast("string"))).alias("conversation_id"), k.origins(pad(up), F.lit(None).cast("string"), F.array(F.lit("nowhere"), pad(up))).alias("origins"),
        F.when(key % 10 == 0, F.array(F.lit("Persona"))).when(key % 10 == 5, F.array(F.lit("Full Song"), F.lit("Cover"))).alias("secondary"), F.when(size % 7 == 0, "").when(size % 7 == 1, "la la").alias("lyrics"),
    )


def with_parent(spark, d):
    c = clips(spark, d)
    return c.join(k.primary_parent(c), "clip_id")


@query("K1_flatten_suno", "SELECT 's' || p_partkey AS clip_id, p_name AS title, p_size AS created, p_retailprice::DOUBLE AS duration, p_size % 2 = 0 AS liked, p_type AS op, 'c' || p_partkey || ',m' AS origins, 'B' AS badges, p_brand AS project FROM part")
def flatten_suno(spark, d):
    meta = F.struct(F.col("p_retailprice").alias("duration"), F.col("p_type").alias("task"), F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("cover_clip_id"), F.lit("e").alias("edited_clip_id"), F.array(F.lit("m"), F.lit("m")).alias("mashup_clip_ids"), F.array(F.struct(F.lit("B").alias("display_name"))).alias("secondary_badges"))
    raw = v.table(spark, d, "part").select(F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("title"), F.col("p_size").alias("created_at"), (F.col("p_size") % 2 == 0).alias("is_liked"), F.lit(None).cast("boolean").alias("is_trashed"), meta.alias("metadata"), F.struct(F.col("p_brand").alias("name")).alias("project"))
    return k.flatten_suno(raw).select("clip_id", "title", "created", "duration", "liked", "op", F.array_join("origins", ",").alias("origins"), F.array_join("badges", ",").alias("badges"), "project")


@query("K2_flatten_flow", "SELECT 's' || p_partkey AS clip_id, CASE WHEN p_size % 3 <> 0 THEN p_retailprice END::DOUBLE AS duration, p_size % 4 = 0 AS deleted, p_type AS op, 'a,b' AS origins FROM part")
def flatten_flow(spark, d):
    raw = v.table(spark, d, "part").select(
        F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("title"), F.col("p_size").alias("created_at"), F.col("p_retailprice").cast("double").alias("duration"), F.when(F.col("p_size") % 3 == 0, "pending").alias("duration_status"),
        F.lit(True).alias("is_favorite"), F.when(F.col("p_size") % 4 == 0, "2024").alias("deleted_at"), F.col("p_type").alias("op_type"), F.array(F.lit("a"), F.lit("b"), F.lit("a")).alias("source_clip_ids"), F.lit("v").alias("conversation_id"),
    )
    return k.flatten_flow(raw).select("clip_id", "duration", "deleted", "op", F.array_join("origins", ",").alias("origins"))


@query("K3_origins", v.with_sql(CLIPS, "SELECT clip_id, CASE WHEN up IS NULL THEN 'nowhere' ELSE lpad(up::VARCHAR, 8, '0') || ',nowhere' END AS origins FROM cl", recursive=True))
def origins(spark, d):
    return clips(spark, d).select("clip_id", F.array_join("origins", ",").alias("origins"))


@query("K4_primary_parent", v.with_sql(CLIPS, "SELECT clip_id, parent_id FROM cp", recursive=True))
def primary_parent(spark, d):
    return k.primary_parent(clips(spark, d))


@query("K5_dewey", v.with_sql(CLIPS, "SELECT clip_id, root_id, depth::INT AS depth, code FROM dw", recursive=True))
def dewey(spark, d):
    return k.dewey(with_parent(spark, d))


NAMES = "na AS (SELECT clip_id, title || ' · ' || code AS name FROM dw JOIN cl USING (clip_id))"


@query("K6_clip_names", v.with_sql(CLIPS, NAMES, "SELECT clip_id, name || CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN ' ' || substr(clip_id, 1, 8) ELSE '' END AS name FROM na", recursive=True))
def clip_names(spark, d):
    c = with_parent(spark, d)
    return k.clip_names(c.join(k.dewey(c), "clip_id"))


BADGES = """bd AS (SELECT cl.*, coalesce(secondary, list_concat([CASE op WHEN 'audio__create_song' THEN 'Original' WHEN 'audio__render_edit' THEN 'Edición' WHEN 'audio__split_stems' THEN 'Stem' ELSE 'Otro' END],
  CASE WHEN liked THEN ['Favorita'] ELSE [] END)) AS badges FROM cl)"""


def badged(spark, d):
    return clips(spark, d).withColumn("badges", k.badges(F.col("op"), F.col("secondary"), F.col("liked")))


@query("K7_badges", v.with_sql(CLIPS, BADGES, "SELECT clip_id, array_to_string(badges, ',') AS badge FROM bd", recursive=True))
def badges(spark, d):
    return badged(spark, d).select("clip_id", F.array_join("badges", ",").alias("badge"))


@query(
    "K8_families",
    v.with_sql(
        CLIPS, BADGES,
        "SELECT root_id, count(*) AS members, count_if(liked)::BIGINT AS liked, count_if(list_contains(badges, 'Full Song'))::BIGINT AS complete, max(depth)::INT AS depth, count(*) = 1 AS single, "
        "coalesce(string_agg(clip_id, ',' ORDER BY created::VARCHAR, clip_id) FILTER (WHERE list_contains(badges, 'Full Song')), '') AS complete_clips FROM dw JOIN bd USING (clip_id) GROUP BY root_id",
        recursive=True,
    ),
)
def families(spark, d):
    c = badged(spark, d)
    placed = k.dewey(c.join(k.primary_parent(c), "clip_id"))
    return k.families(c.join(placed, "clip_id")).withColumn("complete_clips", F.array_join("complete_clips", ","))


@query(
    "K9_clip_index",
    v.with_sql(
        CLIPS, BADGES,
        "SELECT section, value, count(DISTINCT clip_id) AS clips FROM (SELECT clip_id, 'liked' AS section, 'yes' AS value FROM bd WHERE liked UNION ALL SELECT clip_id, 'liked and complete', 'yes' FROM bd WHERE liked AND list_contains(badges, 'Full Song') "
        "UNION ALL SELECT clip_id, 'project', project FROM bd UNION ALL SELECT clip_id, 'operation', op FROM bd UNION ALL SELECT clip_id, 'conversation', conversation_id FROM bd UNION ALL SELECT clip_id, 'badge', unnest(badges) FROM bd) WHERE value IS NOT NULL GROUP BY 1, 2",
        recursive=True,
    ),
)
def clip_index(spark, d):
    return k.clip_index(badged(spark, d))


@query(
    "K10_suno_stats",
    v.with_sql(
        CLIPS, BADGES,
        "s AS (SELECT count(*) AS total, count_if(liked)::BIGINT AS liked, count_if(list_contains(badges, 'Full Song'))::BIGINT AS complete, count(DISTINCT project) AS projects, count_if(project IS NULL)::BIGINT AS without_project, coalesce(sum(duration::DOUBLE), 0) AS t FROM bd WHERE NOT deleted)",
        "SELECT total, liked, complete, projects, without_project, round_even(t, 0)::BIGINT AS seconds, CASE WHEN t < 3600 THEN round_even(t / 60, 0)::BIGINT || ' min' ELSE round_even(t / 3600, 0)::BIGINT || ' h' END AS readable FROM s",
        recursive=True,
    ),
)
def suno_stats(spark, d):
    return k.suno_stats(badged(spark, d))


@query(
    "K11_flow_stats",
    v.with_sql(
        CLIPS,
        "s AS (SELECT count(*) AS total, count_if(liked)::BIGINT AS liked, count_if(op = 'audio__create_song')::BIGINT AS originals, count_if(up IS NOT NULL)::BIGINT AS with_lineage, count_if(lyrics <> '')::BIGINT AS with_lyrics, "
        "count(DISTINCT 'About ' || conversation_id) AS conversations, coalesce(sum(duration::DOUBLE), 0) AS t, count_if(duration IS NULL)::BIGINT AS without_duration FROM cl WHERE NOT deleted)",
        "SELECT * EXCLUDE (t), round_even(t, 0)::BIGINT AS seconds, CASE WHEN t >= 3600 THEN floor(t / 3600)::BIGINT || ' h ' ELSE '' END || floor((t % 3600) / 60)::BIGINT || ' min' AS readable FROM s WHERE total > 0",
        recursive=True,
    ),
)
def flow_stats(spark, d):
    c = clips(spark, d)
    # the fixture's other origin is in no library
    own = F.filter("origins", lambda x: x != "nowhere")
    return k.flow_stats(c.withColumns({"origins": own, "conversation_title": F.concat(F.lit("About "), F.col("conversation_id"))}))


@query("K12_conversation_clips", v.with_sql(CLIPS, "SELECT 'v' || s_suppkey AS conversation_id, coalesce(string_agg(clip_id, ',' ORDER BY created, clip_id), '') AS clips, count(clip_id)::INT AS n FROM supplier LEFT JOIN cl ON conversation_id = 'v' || s_suppkey GROUP BY s_suppkey", recursive=True))
def conversation_clips(spark, d):
    convs = v.table(spark, d, "supplier").select(F.concat(F.lit("v"), F.col("s_suppkey").cast("string")).alias("conversation_id"))
    return k.conversation_clips(clips(spark, d), convs).withColumn("clips", F.array_join("clips", ","))


@query(
    "K13_verify_backup",
    "WITH i AS (SELECT p_partkey AS c, p_size FROM part), w AS (SELECT c, p_size, e FROM i, (VALUES ('mp3'), ('wav'), ('json')) AS f(e) WHERE NOT (e = 'wav' AND p_size % 4 = 0)) "
    "SELECT CASE WHEN c % 100 = 0 THEN 'duplicate id' WHEN p_size % 7 = 0 THEN 'missing' WHEN p_size % 11 = 0 THEN 'empty' WHEN p_size % 13 = 0 THEN 'partial' WHEN e = 'json' AND p_size % 5 = 0 THEN 'corrupt' ELSE 'ok' END AS status, count(*) AS n FROM w GROUP BY 1",
)
def verify_backup(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size")
    part = v.table(spark, d, "part")
    index = part.select(key.alias("clip_id"), F.when(size % 4 == 0, F.array(F.lit("wav"))).alias("absent"))
    index = index.unionByName(index.where("clip_id % 100 = 0"))
    files = part.where("p_size % 7 <> 0").select(key.alias("clip_id"), F.explode(F.array(F.lit("mp3"), F.lit("wav"), F.lit("json"))).alias("ext"), F.when(size % 11 == 0, 0).otherwise(9).alias("bytes"), (size % 13 == 0).alias("partial"), F.when(size % 5 == 0, '{"id": ').otherwise('{"id": 1}').alias("content"))
    return k.verify_backup(index, files, ["mp3", "wav", "json"])
