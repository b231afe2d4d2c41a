"""SimHash near-duplicate detection by meet-in-the-middle ball hashing.

A fingerprint has 64 bits: a bit is 1 if it is set in over half the XXH64 (seed 42) values of the text's
word shingles, repeats included. Every distinct fingerprint emits itself and its 64 one-bit variants; rows
meet on equal variants, so any two fingerprints at two or fewer differing bits meet. What meets at a
variant is summed into one 64-bit mask (which bit each member flipped) by partial aggregation: no list, no
pair within a group, and no cap. Members are linked to the group's smallest, checked by their distance,
and connected components of the links give the groups.

Null and wordless texts have fingerprint zero and are linked like any other. Texts with fewer words than a
shingle have one shingle. Exact copies and repeated rows share a fingerprint and so cost one row. A
component whose doc_ids are all null has a null id. Of further columns nothing is used, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convarchive.llm.common import kept, require, table
from convarchive.llm.components import connected_components

SHINGLE = 3
BITS = 64


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit integer."""
    found = (text or "").encode().lower().split()  # bytes: A-Z only, and the six ASCII spaces only
    if not found:
        return 0
    size = min(shingle, len(found))
    joined, ends = b" ".join(found), np.cumsum([len(w) + 1 for w in found])
    stop = (ends[size - 1 :] - 1).tolist()
    start = [0, *ends[: len(found) - size].tolist()]
    hash64 = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(stop), 1 << 15):  # in blocks: bounded memory for very long texts
        h = np.array([hash64(joined[a:b], 42) for a, b in zip(start[at : at + (1 << 15)], stop[at : at + (1 << 15)], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(stop), bitorder="little").view("<i8")[0])


def with_fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)``, one row a document."""
    require(documents, "doc_id", "text")
    kind = documents.select("doc_id").schema[0].dataType.simpleString()

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            fps = pa.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fps], ["doc_id", "fp"])

    return documents.select("doc_id", "text").mapInArrow(batches, f"doc_id {kind}, fp long")


def ball_links(fps: DataFrame) -> DataFrame:
    """``(a, b)``: links between distinct ``fp`` rows at two or fewer differing bits, enough to connect all such pairs."""
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = [1 << i if i < 63 else -(1 << 63) for i in range(BITS)]
    flips = F.array(*[F.struct(F.col("fp").bitwiseXOR(F.lit(b)).alias("variant"), F.lit(b).alias("flip")) for b in bits], F.struct(F.col("fp").alias("variant"), F.lit(0).cast("long").alias("flip")))
    balls = fps.repartition(n, "fp").select(F.explode(flips).alias("v")).select("v.variant", "v.flip")
    met = balls.groupBy("variant").agg(F.bit_or("flip").alias("mask"), F.max(F.col("flip") == 0).alias("centre"))
    met = met.where(F.bit_count("mask") + F.col("centre").cast("int") > 1)
    flipped = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(F.col("mask"), i) == 1),
        lambda i: F.col("variant").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)),
    )
    members = met.select(F.when(F.col("centre"), F.concat(F.array("variant"), flipped)).otherwise(flipped).alias("m"))
    links = members.select(F.array_min("m").alias("a"), F.explode("m").alias("b")).where("a <> b").distinct()
    return links.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fingerprint, component_id, fingerprints_in_component)``, one row a document."""
    marked = kept(with_fingerprints(documents, shingle))
    firsts = kept(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    groups = connected_components(ball_links(firsts.select("fp"))).select(F.col("node").alias("fp"), "component")
    placed = kept(firsts.join(groups, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component")))
    least = placed.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("texts"))
    by_fp = placed.join(least, "component").select("fp", "component_id", "component", "texts")
    return marked.join(by_fp, "fp").select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id", F.col("texts").alias("fingerprints_in_component"))


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
