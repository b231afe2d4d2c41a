"""Best-fit packing of documents into sequences, bulk-synchronously.

Each round, waiting pieces and open gaps are sorted by size together and swept from large to small: a piece
takes the latest gap not yet taken, which is the smallest one that holds it (its successor), larger pieces
first. The sweep is distributed: size classes (as many as a sequence has tokens, at most) get the number
of gaps still free before them, pieces and gaps of a class are ranked, and rank and class give each a level;
a piece and the gap it takes are neighbours on their level. Ranks resolve all conflicts. Then gaps shrink,
and the sweep repeats. A gap of several times the largest waiting piece is offered in several slots. When
no piece fits, as many sequences open as the waiting tokens need, each with one of the largest pieces.

No step gathers pieces in one task: classes are counted with a salt before they are ranked, a level holds
one gap and one piece of each class at most, and only sums and the number of waiting pieces reach the driver.

Null texts are empty; an empty text is the end token alone. Repeated rows and repeated or null doc_ids are
packed one by one. Texts longer than a sequence are cut, nothing else is. Further columns are left alone.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convarchive.llm.common import kept, require, shared_dir, table
from convarchive.llm.tokens import in_blocks, words_of

SEQUENCE = 4096
END_ID = 1


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_pieces(documents: DataFrame, path: str, sequence: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: one row a piece of at most ``sequence`` tokens."""
    require(documents, "doc_id", "text")
    kind = documents.select("doc_id").schema[0].dataType

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(path)
        for b in (part for whole in rows for part in in_blocks(whole, 1)):
            ids, starts = words.ids(b.column(1))
            n = np.diff(starts) + 1
            own = np.full(len(ids) + len(n), end_id, "<u4")
            ends = np.cumsum(n)
            real = np.ones(len(own), bool)
            real[ends - 1] = False
            own[real] = ids
            pieces = -(-n // sequence)
            of = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * sequence
            length = np.minimum(n[of] - start, sequence)
            at = (ends - n)[of] + start
            cut = memoryview(own.view(np.uint8))
            spans = [cut[4 * a : 4 * (a + k)] for a, k in zip(at.tolist(), length.tolist(), strict=True)]
            crc = pa.array(np.fromiter(map(zlib.crc32, spans), np.int64, len(spans)))
            out = [b.column(0).take(pa.array(of)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), crc]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                out, names = [*out, pa.array([bytes(x) for x in spans], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names)

    schema = f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return documents.select("doc_id", "text").mapInArrow(batches, schema)


def _ranked(events: DataFrame, salts: int) -> DataFrame:
    """Adds to ``(size, kind, id, slot)`` its class's ``place``, ``free`` (gaps free before it) and ``ahead`` (pieces before it), and its ``rank``.

    Kind 0 is a gap, 1 a piece. Classes are ordered by size from large to small, gaps before pieces.
    """
    events = events.withColumn("salt", F.pmod(F.xxhash64("id", "slot"), F.lit(salts)))
    counts = events.groupBy("size", "kind", "salt").agg(F.count("*").alias("n"))
    # at most twice as many rows as a sequence has tokens
    order = Window.orderBy(F.desc("size"), "kind")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    classes = counts.groupBy("size", "kind").agg(F.sum("n").alias("n"))
    classes = classes.withColumns(
        {
            "place": F.row_number().over(order),
            "sum": F.sum(F.when(F.col("kind") == 0, F.col("n")).otherwise(-F.col("n"))).over(upto),
            "ahead": F.sum(F.when(F.col("kind") == 1, F.col("n")).otherwise(0)).over(upto) - F.when(F.col("kind") == 1, F.col("n")).otherwise(0),
        }
    )
    classes = classes.withColumn("after", F.col("sum") - F.least(F.lit(0), F.min("sum").over(upto)))
    classes = classes.select("size", "kind", "place", "ahead", F.lag("after", 1, 0).over(order).alias("free"))
    salted = Window.partitionBy("size", "kind").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    lookup = counts.select("size", "kind", "salt", F.coalesce(F.sum("n").over(salted), F.lit(0)).alias("base")).join(classes, ["size", "kind"])
    within = Window.partitionBy("size", "kind", "salt").orderBy("id", "slot")
    return events.join(lookup, ["size", "kind", "salt"]).withColumn("rank", F.col("base") + F.row_number().over(within))


def _sweep(waiting: DataFrame, gaps: DataFrame, largest: int, salts: int) -> DataFrame:
    """``(key, size, bin)`` of all waiting pieces; ``bin`` is null where no gap is left for it."""
    slots = F.greatest(F.lit(1), F.floor(F.col("gap") / largest)).cast("int")
    offered = gaps.select("bin", "gap", slots.alias("n")).select("bin", "gap", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("slot"))
    size = F.when(F.col("slot") == F.col("n"), F.col("gap") - (F.col("n") - 1) * largest).otherwise(largest)
    events = waiting.select("size", F.lit(1).alias("kind"), F.col("key").alias("id"), F.lit(0).alias("slot")).unionByName(
        offered.select(size.cast("long").alias("size"), F.lit(0).alias("kind"), F.col("bin").alias("id"), "slot")
    )
    free, rank = F.col("free"), F.col("rank")
    level = F.when(F.col("kind") == 0, free + rank).when(rank <= free, free - rank + 1).otherwise(-1 - F.pmod(F.xxhash64("id"), F.lit(1 << 40)))
    along = Window.partitionBy("level").orderBy("place")
    met = _ranked(events, salts).withColumn("level", level).withColumn("last", F.lag(F.struct("kind", "id")).over(along))
    return met.where("kind = 1").select(F.col("id").alias("key"), "size", F.when(F.col("last.kind") == 0, F.col("last.id")).alias("bin"))


def pack(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """``(key, sequence_id, offset)`` of every row of ``pieces(key, length)``; keys are distinct longs, lengths at most ``sequence``."""
    spark = pieces.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    waiting = kept(pieces.select(F.col("key").cast("long"), F.col("length").cast("long").alias("size")))
    gaps = spark.createDataFrame([], "bin long, gap long")
    # places are written round by round, so that no plan grows with the rounds
    path, opening = f"{shared_dir(spark)}/placed-{uuid.uuid4().hex}", True
    fields = "key long, sequence_id long, offset long"
    spark.createDataFrame([], fields).write.parquet(path)
    while True:
        n, tokens, halves, largest = waiting.agg(F.count("*"), F.sum("size"), F.count_if(F.col("size") > sequence // 2), F.max("size")).first()
        if not n:
            break
        if opening:
            opened = max(-(-tokens // sequence), halves)
            events = waiting.select("size", F.lit(1).alias("kind"), F.col("key").alias("id"), F.lit(0).alias("slot"))
            seeds = kept(_ranked(events, salts).select(F.col("id").alias("key"), "size", (F.col("ahead") + F.col("rank") <= opened).alias("seed")))
            seeds.where("seed").select("key", F.col("key").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).write.mode("append").parquet(path)
            fresh = seeds.where("seed").select(F.col("key").alias("bin"), (sequence - F.col("size")).alias("gap")).where("gap > 0")
            gaps, waiting, opening = gaps.unionByName(fresh), seeds.where("not seed").select("key", "size"), False
            continue
        met = kept(_sweep(waiting, gaps, largest, salts))
        taken = met.where("bin is not null")
        inside = Window.partitionBy("bin").orderBy(F.desc("size"), "key").rowsBetween(Window.unboundedPreceding, -1)
        shifts = taken.select("key", "bin", F.coalesce(F.sum("size").over(inside), F.lit(0)).alias("shift"))
        places = shifts.join(gaps, "bin").select("key", F.col("bin").alias("sequence_id"), (sequence - F.col("gap") + F.col("shift")).alias("offset"))
        places.write.mode("append").parquet(path)
        filled = taken.groupBy("bin").agg(F.sum("size").alias("filled"))
        gaps = kept(gaps.join(filled, "bin", "left").select("bin", (F.col("gap") - F.coalesce("filled", F.lit(0))).alias("gap")).where("gap > 0"))
        before, waiting = n, met.where("bin is null").select("key", "size")
        opening = waiting.count() == before
    return spark.read.schema(fields).parquet(path)


def pack_documents(documents: DataFrame, path: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Pieces of ``documents`` with ``sequence_id`` and ``offset``."""
    pieces = token_pieces(documents, path or tokenizer_path(), sequence, end_id)
    keyed = kept(pieces.withColumn("key", F.monotonically_increasing_id()))
    return keyed.join(pack(keyed, sequence), "key").drop("key")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
