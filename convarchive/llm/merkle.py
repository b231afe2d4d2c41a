"""Merkle dataset manifest by time-forward processing.

Every row is a leaf: the SHA-256 of its fields, each as its UTF-8 byte count, ``:`` and value, or ``-`` for null.
Leaves of a source, in order, are put together in runs of ``FAN`` whose digests' digest is their parent, level by
level up to the source's subroot; subroots in the order of their sources likewise give the root.

The tree is processed forward in time: a node's label is (level, group, number), what a node has to tell its
parent is a message with the parent's label, and messages are read in the order of labels. The external priority
queue is a table in the shared folder that each level writes, dealt by label; the next level reads all messages of
a label together, at most ``FAN``, and puts its own digest into the queue. Then the sweep is reversed: from the
root down each node hands its children what stands beside them and above, the suffix of their proofs. Rows of a
level are a ``FAN``-th of the level below, so suffixes are delivered to parents of leaves only and leaves take
theirs in place. Rounds grow with the logarithm of the largest source.

Numbers within a group come from a range sort by group and order, counted within partitions; only how many rows
each partition has of a group is added up over partitions, so one source may hold all rows.

Nulls: a null field is ``-``, a null source is a source of its own, before all others, null doc_ids come last.
Rows of one doc_id in a source follow their leaves; equal rows are leaves of their own. An empty table has no rows
and no root. Of further columns nothing is used, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convarchive.llm.common import ascii_lower, require, stored, table

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**fields: Column) -> Column:
    """The leaf of the named fields, in the order of ``FIELDS``."""
    return F.sha2(F.concat(*[field(fields[f]) for f in FIELDS]), 256)


def _digest(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, ""), 256)


def numbered_in_groups(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``at`` (from 0) and ``n`` to rows with a ``group``: the place in its group's order and the group's size."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # equal rows may be many: their number in the input, which changes nothing else, lets them be split
    keys = ["group", *order, "__tie"]
    dealt = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    dealt = stored(dealt.drop("__tie").withColumns({"__part": F.spark_partition_id(), "__nth": F.monotonically_increasing_id()}))
    counts = dealt.groupBy("group", "__part").agg(F.count("*").alias("__here"), F.min("__nth").alias("__first"))
    # a group has as many rows here as it has partitions
    along = Window.partitionBy("group").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumns({"__before": F.coalesce(F.sum("__here").over(along), F.lit(0)), "n": F.sum("__here").over(Window.partitionBy("group"))})
    offsets = offsets.select("group", "__part", "__first", "__before", "n")
    met = dealt.join(offsets, ["group", "__part"])
    return met.withColumn("at", F.col("__before") + F.col("__nth") - F.col("__first")).drop("__part", "__nth", "__first", "__before")


def sweep_up(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The queue of each level, ``(group, at, children, lone)``, lowest first, and ``(group, subroot)``.

    ``leaves(group, at, n, node)``, of which ``node`` is a struct whose ``digest`` is a leaf's digest; ``children`` are
    nodes in order. The lowest level has all groups: a lone leaf is its own subroot.
    """
    levels, tops, n = [], [], F.col("n")
    messages, parent = leaves, F.floor(F.col("at") / FAN)
    while True:
        read = messages.groupBy("group", parent.alias("at"), "n").agg(F.sort_array(F.collect_list(F.struct("at", "node"))).alias("children"))
        read = read.withColumns({"children": F.transform("children", lambda c: c["node"]), "lone": (n == 1) & F.lit(not levels)})
        levels.append(stored(read))
        above = levels[-1].select("group", "at", F.ceil(n / FAN).alias("n"), F.col("children.digest").alias("parts"), "lone")
        above = above.select("group", "at", "n", F.when(F.col("lone"), F.col("parts")[0]).otherwise(_digest(F.col("parts"))).alias("digest"))
        tops.append(above.where(n == 1).select("group", F.col("digest").alias("subroot")))
        messages = above.where(n > 1).select("group", "at", "n", F.struct("digest").alias("node"))
        if messages.isEmpty():
            break
    found = tops[0]
    for top in tops[1:]:
        found = found.unionByName(top)
    return levels, found


def beside(children: Column, i: Column) -> Column:
    """What stands left and right of a node's child ``i`` (from 0)."""
    digests = children["digest"]
    left, right = F.slice(digests, 1, i), F.slice(digests, i + 2, FAN)
    return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))


NO_STEPS = "array<struct<left:string,right:string>>"


def sweep_down(levels: list[DataFrame], steps: DataFrame) -> DataFrame:
    """``(group, node, steps, subroot)`` of all leaves: what to hash with, level by level up to what ``steps(group, steps, subroot)`` gives for the group's top."""
    down, passed = None, F.struct("steps", "subroot").alias("above")
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        # a group's top is met by what its subroot was handed, the others by what the level above hands down
        handed = level.where(F.col("n") <= FAN).join(steps.select("group", passed), "group")
        if down is not None:
            handed = handed.unionByName(level.where(F.col("n") > FAN).join(down, ["group", "at"]), allowMissingColumns=True)
        child = handed.select("group", "at", "lone", "children", "above", F.posexplode("children").alias("i", "node"))
        own = F.when(F.col("lone"), F.col("above.steps")).otherwise(F.concat(F.array(beside(F.col("children"), F.col("i"))), F.col("above.steps")))
        out = child.select("group", (F.col("at") * FAN + F.col("i")).alias("at"), "node", own.alias("steps"), "above.subroot")
        if k:
            down = stored(out.select("group", "at", passed))
    return out.drop("at")


def fold(digest: Column, steps: Column) -> Column:
    """The root that a leaf's digest gives with the steps of its proof."""
    return F.aggregate(steps, digest, lambda a, s: F.sha2(F.concat(s["left"], a, s["right"]), 256))


def proof_digest(steps: Column) -> Column:
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(rows: DataFrame, leaf: Column, group: Column, order: list[str], keep: list[Column]) -> DataFrame:
    """``rows`` as leaves of one tree: what ``keep`` names, ``leaf``, ``subroot``, ``root`` and the proof's steps.

    ``group`` is a string that isn't null; leaves of a group go by ``order``, then by their digest.
    """
    node = F.struct(leaf.alias("digest"), *keep)
    leaves = rows.select(group.alias("group"), node.alias("node"), *[F.col(c).alias(f"__o{k}") for k, c in enumerate(order)], leaf.alias("__leaf"))
    ranks = [x for k, c in enumerate(order) for x in (f"__null{k}", f"__o{k}")]
    leaves = leaves.withColumns({f"__null{k}": F.col(f"__o{k}").isNull() for k in range(len(order))})
    # written, since a range sort reads its input twice
    placed = numbered_in_groups(stored(leaves), [*ranks, "__leaf"]).select("group", "at", "n", "node")
    levels, subroots = sweep_up(placed)
    subroots = stored(subroots)
    top = subroots.select(F.lit("").alias("group"), F.struct(F.col("subroot").alias("digest"), F.col("group").alias("source")).alias("node"), F.col("group").alias("source"))
    upper, roots = sweep_up(numbered_in_groups(top, ["source"]).select("group", "at", "n", "node"))
    # one row, none for an empty table
    root = ([r.subroot for r in roots.collect()] or [None])[0]
    handed = sweep_down(upper, roots.select("group", F.array().cast(NO_STEPS).alias("steps"), "subroot"))
    steps = stored(handed.select(F.col("node.source").alias("group"), "steps", F.col("node.digest").alias("subroot")))
    out = sweep_down(levels, steps).select("node.*", "subroot", F.lit(root).cast("string").alias("root"), "steps")
    return out.withColumnRenamed("digest", "leaf")


def merkle_manifest(documents: DataFrame) -> DataFrame:
    """``(doc_id, leaf, tampered_leaf, subroot, root, steps)`` a row; ``steps`` is the proof, from the leaf up.

    ``tampered_leaf`` is the leaf of the text with A-Z in lower case, to try proofs on.
    """
    require(documents, *FIELDS)
    columns = {f: F.col(f) for f in FIELDS}
    other = leaf_digest(**columns | {"text": ascii_lower(F.col("text"))})
    rows = documents.select(*FIELDS).select("doc_id", "source", leaf_digest(**columns).alias("leaf"), other.alias("tampered_leaf"))
    # null comes before the empty source
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    return manifest(rows, F.col("leaf"), source, ["doc_id"], [F.col("doc_id"), F.col("tampered_leaf")])


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle_manifest(table(spark, sf_dir, "documents"))
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    folded = fold(F.when(tampered, F.col("tampered_leaf")).otherwise(F.col("leaf")), F.col("steps"))
    out = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _oracle(doc_levels: int = 5, source_levels: int = 4) -> str:
    """SQL of the registered query, for sources of up to 16 ** doc_levels rows and as many as 16 ** source_levels sources."""
    value = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}::VARCHAR) || ':' || {x}::VARCHAR END"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = lambda text: "sha256(" + " || ".join(value(text if f == "text" else f) for f in FIELDS) + ")"
    # the bits of the reflected CRC: a byte comes in with the first of its eight steps
    step = "CASE WHEN xor(c, x) & 1 = 1 THEN xor(xor(c, x) >> 1, 3988292384) ELSE xor(c, x) >> 1 END"
    bits = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda b: [ascii(b)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"xor(list_reduce({bits}, lambda c, x: {step}, 4294967295::BIGINT), 4294967295)"
    parts = [
        f"d AS (SELECT doc_id, coalesce('=' || source, '') AS g, {leaf('text')} AS h, CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS t FROM documents)",
        "d0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS LAST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d)",
    ]

    def tree(name: str, levels: int) -> None:
        for k in range(levels + 1):
            if k:
                parts.append(f"{name}{k} AS (SELECT g, i // 16 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h, (any_value(n) + 15) // 16 AS n FROM {name}{k - 1} WHERE n > 1 GROUP BY g, i // 16)")
            over = "OVER (PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN"
            parts.append(
                f"{name}s{k} AS (SELECT g, i, coalesce(string_agg(h, '') {over} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,"
                f" coalesce(string_agg(h, '') {over} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k} WHERE n > 1)"
            )
        tops = " UNION ALL ".join(f"SELECT g, h FROM {name}{k} WHERE n = 1" for k in range(levels + 1))
        parts.append(f"{name}top AS ({tops})")

    tree("d", doc_levels)
    parts.append("u0 AS (SELECT g AS source, '' AS g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM dtop)")
    tree("u", source_levels)
    parts.append("p0 AS (SELECT d0.*, u0.h AS subroot, u0.i AS j, '' AS proof FROM d0 JOIN u0 ON d0.g = u0.source)")
    steps = [("ds", k, "s.g = p.g", "p.i") for k in range(doc_levels + 1)] + [("us", k, "true", "p.j") for k in range(source_levels + 1)]
    for m, (name, k, same, at) in enumerate(steps):
        folded = "CASE WHEN s.l IS NULL THEN p.t ELSE sha256(s.l || p.t || s.r) END"
        parts.append(
            f"p{m + 1} AS (SELECT p.* REPLACE ({folded} AS t, proof || coalesce(s.l || s.r, '') AS proof) FROM p{m} p LEFT JOIN {name}{k} s ON {same} AND s.i = {at} // {16**k})"
        )
    return (
        "WITH "
        + ",\n".join(parts)
        + f"\nSELECT doc_id, p.h AS leaf, subroot, utop.h AS root, sha256(proof) AS proof_sha256, t AS folded_root, t = utop.h AS verified FROM p{len(steps)} p, utop"
    )


ORACLE = _oracle()
