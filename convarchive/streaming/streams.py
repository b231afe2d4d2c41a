"""Structured-streaming forms of intake, dedup, turns and activity."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from convarchive.operators.merge import append_versions, fingerprint


#: Rows that a part of a store's folder is to hold; folders have as many parts as that takes.
PART_ROWS = 1_000_000
#: Rows that a task which writes texts is to hold; a part is several files where it has more.
FILE_ROWS = 20_000
STORED = "note_id string, base string, body string, version_name string, body_hash string, part int"
COMMITS = "name string, folder string, parts int, rows long, seen map<string,bigint>, covers array<string>"


def _commits(spark: SparkSession, store: str) -> list[Row]:
    """The folders that count: of each batch and compaction, but those that a compaction has put together. ``seen`` has the last batch of each stream."""
    try:
        rows = spark.read.schema(COMMITS).json(f"{store}/commits/*").collect()  # a row a batch or compaction
    except AnalysisException:  # nothing was committed yet
        return []
    covered = {name for r in rows for name in r.covers or ()}
    return sorted((r for r in rows if r.name not in covered), key=lambda r: r.name)


def _commit(spark: SparkSession, store: str, *row) -> None:
    # what is committed counts from the moment this small file is there
    spark.createDataFrame([row], COMMITS).coalesce(1).write.mode("overwrite").json(f"{store}/commits/{row[0]}")


def _part(parts: int) -> Column:
    return F.pmod(F.crc32("base"), F.lit(parts)).cast("int")


def _read(spark: SparkSession, store: str, commits: list[Row]) -> DataFrame:
    if not commits:
        return spark.createDataFrame([], STORED)
    reader = spark.read.schema(f"{STORED}, at string").option("basePath", f"{store}/data")
    return reader.parquet(*[f"{store}/{r.folder}" for r in commits]).drop("at")


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """All versions of a store: ``(note_id, base, body, version_name, body_hash)``."""
    return _read(spark, store, _commits(spark, store)).drop("part")


def compact_store(spark: SparkSession, store: str, part_rows: int = PART_ROWS) -> None:
    """Puts all committed folders of a store together in one, in as many parts as its rows need.

    It counts when its commit is there; a stream that runs meanwhile reads the old folders, so compact between runs. Old folders
    stay for their owner to clear.
    """
    commits = _commits(spark, store)
    rows = sum(r.rows for r in commits)
    if len(commits) < 2:
        return
    parts, name, seen = max(1, -(-rows // part_rows)), f"compaction-{uuid.uuid4().hex}", {}
    for r in commits:
        seen |= {k: max(n, seen.get(k, -1)) for k, n in r.seen.items()}
    folder = f"data/at={name}"
    tasks = max(parts, -(-rows // FILE_ROWS))
    salt = F.pmod(F.crc32("body_hash"), F.lit(-(-tasks // parts)))
    read_store(spark, store).withColumn("part", _part(parts)).repartition(tasks, "part", salt).write.partitionBy("part").parquet(f"{store}/{folder}")
    _commit(spark, store, name, folder, parts, rows, seen, [r.name for r in commits])


def stream_exports(spark: SparkSession, folder: str, schema: str, store: str, checkpoint: str, files_per_batch: int = 100, part_rows: int = PART_ROWS) -> StreamingQuery:
    """New JSON-lines files of ``(note_id, base, body)``, each read once: versions that the store lacks are added to it.

    Exactly once: a batch writes a folder of its own and then its commit, under the stream's checkpoint and its number. One that is
    repeated after a failure finds its commit and does nothing, or replaces what it had written. A stream that begins anew with another
    checkpoint reads all files again and finds their versions in the store. ``read_store`` reads what is committed. A folder keeps each body's hash and is divided by
    base, so a batch reads hashes of its own bases' parts only, and ``compact_store`` puts small folders together.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)
    key = hashlib.sha1(checkpoint.encode()).hexdigest()[:12]

    def intake(batch: DataFrame, number: int) -> None:
        own, commits = batch.sparkSession, _commits(batch.sparkSession, store)
        if any(number <= r.seen.get(key, -1) for r in commits):
            return
        known = own.createDataFrame([], "base string, body_hash string")
        bases = batch.select("base").distinct()
        for parts in {r.parts for r in commits}:
            touched = [r[0] for r in bases.select(_part(parts)).distinct().collect()]  # at most as many numbers as parts
            there = _read(own, store, [r for r in commits if r.parts == parts])
            known = known.unionByName(there.where(F.col("part").isin(touched)).select("base", "body_hash").join(bases, "base", "left_semi"))
        name = f"batch-{key}-{number}"
        at = f"data/at={name}"
        parts = max(1, -(-sum(r.rows for r in commits) // part_rows))
        fresh = append_versions(batch, known).withColumn("part", _part(parts))
        fresh.select("note_id", "base", "body", "version_name", "body_hash", "part").write.partitionBy("part").mode("overwrite").parquet(f"{store}/{at}")
        _commit(own, store, name, at, parts, own.read.schema(STORED).parquet(f"{store}/{at}").count(), {key: number}, None)

    return stream.writeStream.foreachBatch(intake).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_dedup(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Messages ``(group_key, ts, role, content)`` without repeats of a fingerprint in a group within the delay."""
    marked = stream.withColumn("fp", fingerprint(F.col("role"), F.col("content"))).withWatermark("ts", delay)
    return marked.dropDuplicatesWithinWatermark(["group_key", "fp"])


def stream_turns(stream: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Bursts of activity of agent sessions; one that still grows is held back until it has been quiet for the gap and the delay."""
    w = F.session_window("ts", gap)
    events = stream.where(F.col("kind") != "noise").withWatermark("ts", delay).groupBy("session_id", w.alias("w"))
    out = events.agg(F.count("*").alias("events"), F.count_if(F.col("kind") == "human").alias("prompts"), F.count_if(F.col("kind") == "tool").alias("tools"))
    return out.select("session_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events", "prompts", "tools")


def stream_session_turns(stream: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Turns of bursts that are over: ``(session_id, started, turn, role, text, tools)``.

    ``stream(session_id, ts, line_no, kind, text)``. Within a burst a prompt opens a user turn and all work up to the next
    prompt is one answer; work before the first prompt continues the last answer of the session's burst before.
    """
    w = F.session_window("ts", gap)
    events = stream.where(F.col("kind").isin("human", "text", "tool", "thinking")).withWatermark("ts", delay).groupBy("session_id", w.alias("w"))
    listed = events.agg(F.array_sort(F.collect_list(F.struct("line_no", "kind", "text"))).alias("e"))

    def step(a: Column, x: Column) -> Column:
        human = x["kind"] == "human"
        new = human | (F.size(a) == 0) | (F.element_at(a, -1)["role"] == "user")
        said = F.when(human | (x["kind"] == "text"), x["text"])
        opened = F.struct(F.when(human, "user").otherwise("assistant").alias("role"), F.coalesce(said, F.lit("")).alias("text"), (x["kind"] == "tool").cast("int").alias("tools"))
        last = F.element_at(a, -1)
        longer = F.struct(last["role"].alias("role"), F.concat_ws("\n\n", F.nullif(last["text"], F.lit("")), said).alias("text"), (last["tools"] + (x["kind"] == "tool").cast("int")).alias("tools"))
        return F.when(new, F.concat(a, F.array(opened))).otherwise(F.concat(F.slice(a, 1, F.size(a) - 1), F.array(longer)))

    none = F.array().cast("array<struct<role:string,text:string,tools:int>>")
    turns = listed.select("session_id", F.col("w.start").alias("started"), F.posexplode(F.aggregate("e", none, step)).alias("turn", "t"))
    return turns.select("session_id", "started", (F.col("turn") + 1).alias("turn"), "t.*")


TURN = "session_id {0}, turn int, part int, role string, started long, text string, thoughts int, tools int"


def stream_agent_turns(stream: DataFrame, quiet: str = "7 days", delay: str = "10 minutes", forget: str = "365 days") -> DataFrame:
    """The turns of ``threads.agent_turns`` as a stream: ``(session_id, turn, part, role, started, text, thoughts, tools)``.

    ``stream(session_id, ts, line_no, kind, is_side, text)``. A session's open turn is its state and stays open over bursts, so
    work without a prompt of its own continues the answer before. Events wait until the watermark has passed them
    and are taken by line. A turn is put out when the next one begins, or when the session has been quiet for
    ``quiet``; what continues it after such a pause is the turn's next ``part``. A session that says nothing for ``forget`` is
    forgotten, and numbers its turns anew. Events later than ``delay`` drop out.
    """
    pause, gone = (int(pd.Timedelta(x).total_seconds() * 1_000_000) for x in (quiet, forget))
    key = stream.select("session_id").schema[0].dataType.simpleString()
    columns = ["session_id", "turn", "part", "role", "started", "text", "thoughts", "tools"]

    def advance(session: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, out = state.getCurrentWatermarkMs() * 1000, []
        turn, part, last, opened, waiting = json.loads(state.get[0]) if state.exists else (0, 0, None, None, [])
        if not state.hasTimedOut:
            for b in batches:
                waiting += ([e["at"], e.get("line_no"), e["kind"], e.get("text")] for e in json.loads(f"[{','.join(b['event'])}]"))

        def close() -> None:
            nonlocal opened
            if opened:
                out.append((session[0], turn, part, opened["role"], opened["started"], "\n\n".join(opened["said"]), opened["thoughts"], opened["tools"]))
            opened = None

        for at, _, kind, text in sorted((e for e in waiting if e[0] < now), key=lambda e: (e[1] is None, e[1])):
            human = kind == "human"
            if turn == 0 and not human:
                continue  # nothing was asked yet
            role = "user" if human else "assistant"
            if opened is None and last is not None and not human and role == last[1]:
                part += 1
            elif opened is None or human or opened["role"] != role:
                close()
                turn, part = turn + 1, 1
            elif at - last[0] > pause:
                close()
                part += 1
            opened = opened or {"role": role, "started": at, "said": [], "thoughts": 0, "tools": 0}
            if human or kind == "text":
                opened["said"].append(text or "")
            opened["thoughts"] += kind == "thinking"
            opened["tools"] += kind == "tool"
            last = [at, role]
        waiting = [e for e in waiting if e[0] >= now]
        if opened and last[0] + pause < now:
            close()
        if waiting or last and last[0] + gone >= now:
            state.update((json.dumps([turn, part, last, opened, waiting]),))
            wake = [e[0] for e in waiting] + ([last[0] + pause] if opened else []) + ([last[0] + gone] if last else [])
            state.setTimeoutTimestamp(max(now // 1000 + 1, min(wake) // 1000))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=columns)

    events = stream.where(F.col("kind").isin("human", "text", "tool", "thinking") & ~F.coalesce("is_side", F.lit(False))).withWatermark("ts", delay)
    # each column costs each session's frame anew, many times what its few values take, so an event travels as one
    event = F.to_json(F.struct(F.unix_micros("ts").alias("at"), "line_no", "kind", "text"))
    events = events.where("ts is not null").select("session_id", "ts", event.alias("event")).groupBy("session_id")
    out = events.applyInPandasWithState(advance, TURN.format(key), "state string", "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumn("started", F.timestamp_micros("started"))


def stream_activity(stream: DataFrame, delay: str = "2 days", every: str = "1 day") -> DataFrame:
    """Imports per provider and day (a month is a sum of days); late rows count until the delay has passed."""
    counts = stream.withWatermark("ts", delay).groupBy(F.window("ts", every).alias("w"), F.coalesce("provider", F.lit("chatgpt")).alias("provider"))
    return counts.agg(F.count("*").alias("imports")).select(F.col("w.start").alias("day"), "provider", "imports")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over all that is there and appends its results as Parquet."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
