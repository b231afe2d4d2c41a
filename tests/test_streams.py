"""Agent turns as a stream against the batch operator."""

import random

from pyspark.sql import functions as F

from convarchive.operators import threads
from convarchive.streaming import streams


def test_turns_over_many_batches_are_those_of_the_batch_operator(spark, tmp_path):
    rnd, rows = random.Random(6), []
    for session in range(6):
        at = 1_700_000_000
        for line in range(60):
            at += rnd.choice([1, 30, 4_000, 100_000])
            rows.append((f"s{session}", line, at, rnd.choice(["human", "text", "tool", "thinking", "noise"]), rnd.random() < 0.1, f"t{line}"))
    df = spark.createDataFrame(rows, "session_id string, line_no int, at long, kind string, is_side boolean, text string").withColumn("ts", F.timestamp_seconds("at")).drop("at")
    want = {(r.session_id, r.turn, r.role, r.started, r.text, r.thoughts, r.tools) for r in threads.agent_turns(df).collect()}
    # time goes by in five batches; what comes at the end lets all turns close
    last = max(r[2] for r in rows)
    for k in range(5):
        low, high = (1_700_000_000 + (last - 1_700_000_000) * x // 5 for x in (k, k + 1))
        df.where((F.unix_seconds("ts") > low) & (F.unix_seconds("ts") <= high)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for at in (last + 10**7, last + 2 * 10**7):
        spark.createDataFrame([("end", 1, at, "text", False, "x")], "session_id string, line_no int, at long, kind string, is_side boolean, text string").withColumn("ts", F.timestamp_seconds("at")).drop("at").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    streams.run_available(streams.stream_agent_turns(stream, quiet="60 days"), f"{tmp_path}/out", f"{tmp_path}/check")
    got = spark.read.parquet(f"{tmp_path}/out").where("session_id <> 'end'").collect()
    assert {(r.session_id, r.turn, r.role, r.started, r.text, r.thoughts, r.tools) for r in got} == want
    assert len(got) == len(want) and all(r.part == 1 for r in got)


def test_a_store_takes_each_batch_once(spark, tmp_path):
    store, fields = f"{tmp_path}/store", "note_id string, base string, body string"

    def drop(name, rows):
        spark.createDataFrame(rows, fields).coalesce(1).write.mode("append").json(f"{tmp_path}/in")

    def run(check):
        streams.stream_exports(spark, f"{tmp_path}/in", fields, store, f"{tmp_path}/{check}", 1, part_rows=2).awaitTermination()
        return sorted((r.base, r.body, r.version_name) for r in streams.read_store(spark, store).collect())

    drop("a", [("1", "x", "one"), ("2", "y", "two")])
    drop("b", [("3", "x", "one"), ("4", "x", "other")])
    first = run("check")
    assert [(b, t) for b, t, _ in first] == [("x", "one"), ("x", "other"), ("y", "two")]
    # a stream that starts again from nothing reads all again, and finds it there
    assert run("again") == first and sum(r.rows for r in streams._commits(spark, store)) == 3
    # one that lost what it knew of its batches but not its place repeats them: they are committed
    key = streams.hashlib.sha1(f"{tmp_path}/check".encode()).hexdigest()[:12]
    assert max(r.seen.get(key, -1) for r in streams._commits(spark, store)) == 1
    # what a failed batch left without a commit is replaced by the batch
    spark.createDataFrame([("9", "z", "broken", "z", "h", 0)], streams.STORED).write.partitionBy("part").parquet(f"{store}/data/at=batch-{key}-2")
    assert streams.read_store(spark, store).where("base = 'z'").count() == 0
    drop("c", [("5", "y", "two"), ("6", "w", "new")])
    third = run("check")
    assert [(b, t) for b, t, _ in third] == [("w", "new"), *[(b, t) for b, t, _ in first]]
    streams.compact_store(spark, store, part_rows=2)
    assert sorted((r.base, r.body, r.version_name) for r in streams.read_store(spark, store).collect()) == third
    assert [(r.parts, r.rows) for r in streams._commits(spark, store)] == [(2, 4)]
    drop("d", [("7", "w", "new"), ("8", "w", "newer")])
    assert len(run("check")) == 5


def test_an_event_reaches_its_session_as_one_value(spark, tmp_path):
    fields = "session_id string, line_no int, at long, kind string, is_side boolean, text string"
    said = ['a "b" \\ [c], {d}\n\té \U0001f600', None, "", "\x01,"]
    rows = [("s", 1, 1_700_000_000, "human", None, "ask"), *[("s", 2 + i, 1_700_000_001 + i, "text", None, t) for i, t in enumerate(said)]]
    rows += [("s", 9, None, "text", None, "without a time"), ("end", 1, 1_710_000_000, "human", None, "x")]
    df = spark.createDataFrame(rows, fields).withColumn("ts", F.timestamp_seconds("at")).drop("at")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    out = streams.stream_agent_turns(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    plan = out._jdf.queryExecution().analyzed().toString().splitlines()
    below = plan[next(i for i, line in enumerate(plan) if "PandasWithState" in line) + 1 :]
    columns = next(line for line in below if "Project [" in line)
    assert "event#" in columns and "line_no#" not in columns.replace(columns[columns.find("to_json") : columns.find(" AS event")], "")
    streams.run_available(out, f"{tmp_path}/out", f"{tmp_path}/check")
    got = sorted((r.turn, r.role, r.text) for r in spark.read.parquet(f"{tmp_path}/out").where("session_id = 's'").collect())
    assert got == [(1, "user", "ask"), (2, "assistant", "\n\n".join(t or "" for t in said))]
