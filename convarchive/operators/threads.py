"""Threads, turns and branch resolution.

``nodes(conv_id, node_id, parent_id, pos, created, role, content)`` is a message tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convarchive.functions.text import strip_space
from convarchive.sources.shared import checkpoint_root


def sound(nodes: DataFrame) -> DataFrame:
    """``(conv_id)`` of the conversations whose node ids are all there and distinct."""
    return nodes.groupBy("conv_id").agg((F.count("*") == F.countDistinct("node_id")).alias("sound")).where("sound").select("conv_id")


#: Nodes of a conversation that is walked within one row; longer ones are walked by doubling.
SHORT = 500


def _walk(children: DataFrame, leaves: DataFrame) -> DataFrame:
    """Per conversation the node ids from the root to the leaf; a walk stops where it would meet a node again."""
    sizes = children.groupBy("conv_id").agg(F.count("*").alias("n"))
    known = leaves.where("leaf_id is not null").join(sizes, "conv_id")
    short = _short_walk(children, known.where(F.col("n") <= SHORT))
    long = known.where(F.col("n") > SHORT).select("conv_id", "leaf_id")
    return short if long.isEmpty() else short.unionByName(_long_walk(children, long))


def _short_walk(children: DataFrame, leaves: DataFrame) -> DataFrame:
    links = children.join(leaves.select("conv_id"), "conv_id", "left_semi").groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("node_id", "parent_id"))).alias("up"))
    met = leaves.join(links, "conv_id")

    def step(path: Column, _: Column) -> Column:
        above = F.try_element_at("up", F.element_at(path, -1))
        known = F.map_contains_key("up", F.coalesce(above, F.element_at(path, -1)))
        return F.when(above.isNull() | ~known, path).otherwise(F.concat(path, F.array(above)))

    # no walk has more steps than there are nodes; going round a cycle, it is cut where it repeats
    path = F.reverse(F.array_distinct(F.aggregate(F.sequence(F.lit(1), F.col("n")), F.array("leaf_id"), step)))
    return met.select("conv_id", F.posexplode(path).alias("pos", "node_id"))


def _long_walk(children: DataFrame, leaves: DataFrame) -> DataFrame:
    """The same by pointer doubling: after k rounds the first 2^k nodes from the leaf are known, and where each node's 2^k-th ancestor is.

    A round is two joins over nodes, written to the shared checkpoint folder, so a walk of d nodes takes log2(d) of
    them and no row holds a thread. On a cycle a node counts at its first place, as going round again finds nothing new.
    """
    checkpoint_root(children.sparkSession)
    nodes = children.join(leaves.select("conv_id"), "conv_id", "left_semi")
    there = nodes.select("conv_id", F.col("node_id").alias("to"))
    jumps = nodes.select("conv_id", "node_id", F.col("parent_id").alias("to")).join(there, ["conv_id", "to"]).select("conv_id", "node_id", "to").checkpoint()
    path, n, reach = leaves.select("conv_id", F.col("leaf_id").alias("node_id"), F.lit(0).cast("long").alias("away")), 0, 1
    while True:
        further = path.join(jumps, ["conv_id", "node_id"]).select("conv_id", F.col("to").alias("node_id"), (F.col("away") + reach).alias("away"))
        path = path.unionByName(further).groupBy("conv_id", "node_id").agg(F.min("away").alias("away")).checkpoint()
        before, n = n, path.count()
        if n == before:
            break
        jumps = jumps.join(jumps.select("conv_id", F.col("node_id").alias("to"), F.col("to").alias("next")), ["conv_id", "to"]).select("conv_id", "node_id", F.col("next").alias("to")).checkpoint()
        reach *= 2
    ends = path.groupBy("conv_id").agg(F.max("away").alias("top"))
    return path.join(ends, "conv_id").select("conv_id", (F.col("top") - F.col("away")).cast("int").alias("pos"), "node_id")


def resolve_thread(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """``(conv_id, pos, node_id)``: the branch from ``leaves(conv_id, leaf_id)`` to the root; regenerated branches drop out.

    A conversation without a known leaf keeps all nodes by creation time (missing: 0), then position; one with
    missing or repeated node ids keeps them in their original order.
    """
    whole = sound(nodes)
    known = leaves.join(nodes.select("conv_id", F.col("node_id").alias("leaf_id")), ["conv_id", "leaf_id"], "left_semi").join(whole, "conv_id", "left_semi")
    walked = _walk(nodes, known)
    time = F.when(F.col("whole"), F.coalesce("created", F.lit(0))).otherwise(F.lit(0))
    order = Window.partitionBy("conv_id").orderBy(time, "source_pos")
    rest = nodes.withColumnRenamed("pos", "source_pos").join(known, "conv_id", "left_anti").join(whole.withColumn("whole", F.lit(True)), "conv_id", "left")
    return walked.unionByName(rest.select("conv_id", (F.row_number().over(order) - 1).alias("pos"), "node_id"))


def latest_leaves(nodes: DataFrame, stated: DataFrame | None = None) -> DataFrame:
    """``(conv_id, leaf_id)``: the stated leaf where known, else the newest node that is no parent (the first on a tie).

    A conversation with missing or repeated node ids gets no leaf, stated or not, and so keeps its original order.
    """
    parents = nodes.select("conv_id", F.col("parent_id").alias("node_id")).where("node_id is not null").distinct()
    tips = nodes.join(parents, ["conv_id", "node_id"], "left_anti")
    first = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc(F.coalesce("created", F.lit(0))), "pos"))
    leaf = tips.withColumn("nth", first).where("nth = 1").select("conv_id", F.col("node_id").alias("leaf_id"))
    whole = sound(nodes)
    leaf = leaf.join(whole, "conv_id", "left_semi")
    if stated is None:
        return leaf
    known = stated.join(nodes.select("conv_id", F.col("node_id").alias("leaf_id")), ["conv_id", "leaf_id"], "left_semi").join(whole, "conv_id", "left_semi")
    return leaf.withColumnRenamed("leaf_id", "latest").join(known, "conv_id", "full").select("conv_id", F.coalesce("leaf_id", "latest").alias("leaf_id"))


def flat_thread(rows: DataFrame) -> DataFrame:
    """Conversations by title of flat ``(title, time, role, content, pos)`` rows; empty messages and groups drop out."""
    said = rows.where(strip_space(F.coalesce("content", F.lit(""))) != "")
    return said.groupBy("title").agg(
        F.min("time").alias("created"),
        F.max("time").alias("updated"),
        F.count("*").alias("messages"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "role"))), lambda x: x["role"]), ",").alias("roles"),
    )


def drop_empty(convs: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without empty messages and without conversations that have none left."""
    said = messages.where(strip_space(F.coalesce("content", F.lit(""))) != "")
    return convs.join(said, "conv_id", "left_semi"), said


def dominant_model(messages: DataFrame) -> DataFrame:
    """``(conv_id, model, n)``: the most frequent model, the alphabetically first on a tie."""
    counts = messages.where("model is not null").groupBy("conv_id", "model").agg(F.count("*").alias("n"))
    best = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("n"), "model"))
    return counts.withColumn("nth", best).where("nth = 1").drop("nth")


def agent_turns(events: DataFrame) -> DataFrame:
    """Turns of ``events(session_id, line_no[, block_no], ts, kind, is_side, text)``.

    A human prompt opens a user turn; all assistant work up to the next prompt is one turn. Noise and side
    chains drop out, as does what comes before the first prompt.
    """
    kept = events.where(F.col("kind").isin("human", "text", "tool", "thinking") & ~F.coalesce("is_side", F.lit(False)))
    place = ["line_no", *(["block_no"] if "block_no" in events.columns else [])]
    w = Window.partitionBy("session_id").orderBy(*place)
    human = F.col("kind") == "human"
    marked = kept.withColumn("island", F.sum(human.cast("int")).over(w)).where("island > 0")
    order = F.struct(*place, "kind", "text")
    of = lambda kind: F.transform(F.filter(F.array_sort(F.collect_list(order)), lambda x: x["kind"] == kind), lambda x: x["text"])
    turns = marked.groupBy("session_id", "island", human.alias("is_user")).agg(
        F.min("ts").alias("started"),
        F.min("line_no").alias("first_line"),
        F.array_join(F.when(F.col("is_user"), of("human")).otherwise(of("text")), "\n\n").alias("text"),
        F.count_if(F.col("kind") == "thinking").alias("thoughts"),
        F.count_if(F.col("kind") == "tool").alias("tools"),
    )
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("first_line"))
    return turns.select("session_id", number.alias("turn"), F.when(F.col("is_user"), "user").otherwise("assistant").alias("role"), "started", "text", "thoughts", "tools")


def codex_events(lines: DataFrame) -> DataFrame:
    """``lines(session_id, line_no, ts, type, subtype, text[, call_id, input])`` as the events of ``agent_turns``: prompts come from
    user-message events, answers, legible reasoning and calls from response items; developer text and echoed answers are noise."""
    said = F.coalesce("text", F.lit("")) != ""
    kind = (
        F.when((F.col("type") == "event_msg") & (F.col("subtype") == "user_message"), "human")
        .when((F.col("type") == "response_item") & (F.col("subtype") == "assistant") & said, "text")
        .when((F.col("type") == "response_item") & (F.col("subtype") == "reasoning") & said, "thinking")
        .when((F.col("type") == "response_item") & F.col("subtype").isin("function_call_output", "custom_tool_call_output"), "result")
        .when((F.col("type") == "response_item") & F.col("subtype").isin("function_call", "custom_tool_call"), "tool")
    )
    more = [c for c in ("call_id", "input") if c in lines.columns]
    return lines.select("session_id", "line_no", "ts", kind.alias("kind"), F.lit(False).alias("is_side"), "text", *more)


def calls_and_results(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The inputs of ``join_tool_results`` from events with ``call_id``: calls ``(session_id, line_no, call_id, tool, input)`` and results."""
    calls = events.where("kind = 'tool'").select("session_id", "line_no", "call_id", F.col("text").alias("tool"), "input")
    return calls, events.where("kind = 'result'").select("session_id", "line_no", "call_id", F.col("text").alias("result"))


def join_tool_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls with the result of the same id in the same session; the last one wins, none is null."""
    last = results.groupBy("session_id", "call_id").agg(F.max(F.struct("line_no", "result")).alias("r"))
    return calls.join(last, ["session_id", "call_id"], "left").withColumn("result", F.col("r.result")).drop("r")


def session_header(events: DataFrame) -> DataFrame:
    """First known directory, branch and title of a session, and its time span."""
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("line_no", c)))[c].alias(c)
    return events.groupBy("session_id").agg(first("cwd"), first("branch"), first("title"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


def session_title(title: Column, first_prompt: Column, limit: int = 70) -> Column:
    line = strip_space(F.substring_index(strip_space(F.coalesce(first_prompt, F.lit(""))), "\n", 1))
    cut = F.when(F.length(line) > limit, F.concat(F.substring(line, 1, limit), F.lit("…"))).otherwise(line)
    return F.coalesce(F.nullif(strip_space(title), F.lit("")), F.nullif(cut, F.lit("")), F.lit("session"))


def session_notes(turns: DataFrame, calls: DataFrame, level: int = 2) -> dict[str, DataFrame]:
    """The parent note's turns always; reasoning from level 1 and tools from level 2 only where there are any."""
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("turn"))
    numbered = turns.where("role = 'assistant'").withColumn("answer", number)
    out = {"parent": turns}
    if level >= 1:
        out["reasoning"] = numbered.where("thoughts > 0").select("session_id", "turn", "answer", "thoughts")
    if level >= 2:
        shown = F.when(F.lit(level < 3) & (F.length("result") > 2000), F.substring("result", 1, 2000)).otherwise(F.col("result"))
        out["tools"] = calls.join(numbered.select("session_id", "turn", "answer"), ["session_id", "turn"]).withColumn("result", shown)
    return out


def instruction_changes(messages: DataFrame) -> DataFrame:
    """Custom instructions as they change in a conversation, from ``(conv_id, pos, profile, instructions)``.

    The first is kept; a profile-only start is completed by the first full one; profile-only ones after a
    full one are ignored; equal neighbours are no change.
    """
    w = Window.partitionBy("conv_id").orderBy("pos")
    full = F.col("instructions").isNotNull()
    seen_full = F.coalesce(F.max(full).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    used = messages.where("profile is not null or instructions is not null").withColumn("seen_full", seen_full).where(full | ~F.col("seen_full"))
    before = F.lag(F.struct("profile", "instructions")).over(w)
    marked = used.withColumn("before", before).where(F.col("before").isNull() | ~F.struct("profile", "instructions").eqNullSafe(F.col("before")))
    completes = full & F.col("before.profile").isNotNull() & F.col("before.instructions").isNull() & (F.col("before.profile") == F.col("profile"))
    event = F.when(F.col("before").isNull(), "first").when(completes, "completed").otherwise("changed")
    return marked.select("conv_id", "pos", event.alias("event"), "profile", "instructions")


def attach_recap(messages: DataFrame) -> DataFrame:
    """A recap moves to the reasoning block right before it, and its own row goes."""
    w = Window.partitionBy("conv_id").orderBy("pos")
    joined = messages.withColumns({"next_kind": F.lead("kind").over(w), "next_text": F.lead("content").over(w), "last_kind": F.lag("kind").over(w)})
    recap = F.when((F.col("kind") == "reasoning") & (F.col("next_kind") == "recap"), F.col("next_text"))
    absorbed = (F.col("kind") == "recap") & F.coalesce(F.col("last_kind") == "reasoning", F.lit(False))
    return joined.withColumn("recap", recap).where(~absorbed).drop("next_kind", "next_text", "last_kind")


def fold_artifacts(ops: DataFrame) -> DataFrame:
    """Final text of each artifact of ``ops(conv_id, artifact_id, pos, command, content, old_str, new_str)``.

    ``create`` and ``rewrite`` set it; ``update`` replaces the first occurrence of ``old_str``, or nothing
    where it is absent or nothing was created.
    """
    steps = F.array_sort(F.collect_list(F.struct("pos", "command", "content", "old_str", "new_str")))
    listed = ops.groupBy("conv_id", "artifact_id").agg(steps.alias("steps"))

    def apply(text: Column, s: Column) -> Column:
        at = F.call_function("locate", s["old_str"], text)
        swapped = F.concat(F.substring(text, F.lit(1), at - 1), s["new_str"], F.substring(text, at + F.length(s["old_str"]), F.length(text)))
        updates = (s["command"] == "update") & (F.length(s["old_str"]) > 0) & (at > 0)
        return F.when(s["command"].isin("create", "rewrite"), s["content"]).when(updates, swapped).otherwise(text)

    final = F.aggregate("steps", F.lit(None).cast("string"), apply)
    return listed.select("conv_id", "artifact_id", final.alias("content"), F.size("steps").alias("operations")).where("content is not null")


def reverse_blocks(messages: DataFrame) -> DataFrame:
    """Newest block first; a block is a user message and all up to the next, its own order stays."""
    w = Window.partitionBy("conv_id").orderBy("pos")
    block = F.sum((F.lower("role") == "user").cast("int")).over(w)
    turned = Window.partitionBy("conv_id").orderBy(F.desc("block"), "pos")
    return messages.withColumn("block", block).withColumn("new_pos", F.row_number().over(turned))


def transcribe(parts: DataFrame) -> DataFrame:
    """Rows of a music-assistant transcript from ``(conv_id, pos, part_kind, content, tool_name)``."""
    role = F.when(F.col("part_kind").isin("user-prompt", "retry-prompt"), "user").when(F.col("part_kind") == "text", "assistant").when(F.col("part_kind") == "tool-call", "tool")
    shown = F.when(F.col("part_kind") == "tool-call", F.concat(F.lit("["), F.col("tool_name"), F.lit("]"))).otherwise(F.col("content"))
    return parts.select("conv_id", "pos", role.alias("role"), shown.alias("content")).where("role is not null")
