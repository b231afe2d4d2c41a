"""Elements of huge JSON arrays, read by many tasks.

An export is often one JSON document of gigabytes, which Spark's JSON reader gives to one task. Here the file is read
as text that is cut at ``}``, so that it splits like any text; a block knows neither whether it begins inside a string nor
how deep. So blocks are first summed up: how many quotes it has, and by how much its brackets change the depth for
either beginning. Running sums over a file's blocks (not its rows) give each block's beginning, and then every block cuts out
the objects that begin and end in it. What lies over a border, two pieces a block at most, is put together by a shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convarchive.sources.shared import new_folder

ESCAPED = re.compile(r"\\.", re.S)
MARKS = re.compile(r'["{}\[\]]')
KEY = re.compile(r'"((?:[^"\\]|\\.)*)"\s*:\s*$', re.S)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block: whether its quotes are odd, and the change of depth that begins outside and inside a string."""
    found: dict[tuple, list] = {}
    for file, block, value in _rows(batches):
        s = found.setdefault((file, block), [0, 0, 0, value.lstrip("﻿ \t\r\n")[:1]])
        for k, part in enumerate(ESCAPED.sub("", value).split('"')):
            s[0] ^= k > 0
            # s[1] for a beginning outside a string: outside are the parts after an even number of quotes
            s[1 + s[0]] += part.count("{") + part.count("[") - part.count("}") - part.count("]")
        s[1 + s[0]] -= 1  # the } that the row was cut at
    cols = list(zip(*[(f, b, bool(s[0]), s[1], s[2], s[3]) for (f, b), s in found.items()], strict=True)) or [[]] * 6
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["file", "block", "odd", "outside", "inside", "first"])


class _Block:
    """A block that begins at a depth, inside a string or not, read row by row."""

    def __init__(self, quoted: bool, depth: int, level: int) -> None:
        self.quoted, self.depth, self.level = quoted, depth, level
        self.inside = self.carried = depth > level  # in a value of the array, one that began before the block
        self.key, self.before, self.text = None, "", []

    def feed(self, value: str) -> Iterator[tuple[str, str | None, str]]:
        """Takes a row and the ``}`` it was cut at; gives ``(kind, key, text)`` of objects that end here: whole, or the end of one."""
        value += "}"
        start = 0
        for m in MARKS.finditer(ESCAPED.sub("  ", value)):
            mark, at = m[0], m.start()
            if mark == '"':
                self.quoted = not self.quoted
            elif self.quoted:
                continue
            elif mark in "{[":
                if self.depth == self.level:
                    self.inside, self.text, start = True, [], at
                elif self.depth < self.level:
                    if self.depth == 1:
                        named = KEY.search(self.before + value[start:at])
                        self.key = json.loads(f'"{named[1]}"') if named else None
                    self.before, start = "", at + 1
                self.depth += 1
            else:
                self.depth -= 1
                if self.depth == self.level and self.inside:
                    if mark == "}":
                        yield "end" if self.carried else "whole", self.key, "".join([*self.text, value[start : at + 1]])
                    self.inside, self.carried, self.text, start = False, False, [], at + 1
                elif self.depth < self.level:
                    self.before, start = "", at + 1
        if self.inside:
            self.text.append(value[start:])
        elif self.depth < self.level:
            self.before += value[start:]

    def rest(self) -> Iterator[tuple[str, str | None, str]]:
        """What goes on in the next block, and the last key."""
        if self.inside:
            yield "middle" if self.carried else "begin", self.key, "".join(self.text)
        yield "key", self.key, ""


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    now, block = None, None

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [[]] * 5
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        batch = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["file", "block", "kind", "key", "json"])
        out.clear()
        return batch

    for file, start, value, quoted, depth, level in _rows(batches):
        if (file, start) != now:
            if block:
                out += [(*now, *found) for found in block.rest()]
            now, block = (file, start), _Block(quoted, depth, level)
        out += [(file, start, *found) for found in block.feed(value)]
        if len(out) > 200:
            yield flush()
    if block:
        out += [(*now, *found) for found in block.rest()]
    yield flush()


def read_elements(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """``(file, key, json)``: the objects of JSON arrays in the files of ``path``, in no order.

    A file that begins with ``[`` is such an array (``key`` is null); one that begins with ``{`` has them under the top-level
    ``keys``. Values in these arrays that aren't objects are left out. A block is what Spark splits files into
    (``spark.sql.files.maxPartitionBytes``); compressed files are one block. What is cut is written to the shared checkpoint folder.
    """
    text = spark.read.option("lineSep", "}").text(path)
    text = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    sums = text.mapInArrow(_summed, "file string, block long, odd boolean, outside long, inside long, first string")
    along = Window.partitionBy("file").orderBy("block")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.withColumn("quoted", F.coalesce(F.sum(F.col("odd").cast("int")).over(before), F.lit(0)) % 2 == 1)
    change = F.when(F.col("quoted"), F.col("inside")).otherwise(F.col("outside"))
    level = F.when(F.first("first").over(along) == "[", 1).otherwise(2)
    begins = begins.select("file", "block", "quoted", F.coalesce(F.sum(change).over(before), F.lit(0)).alias("depth"), level.alias("level"))
    # a row a block, 100 bytes: a million blocks are over 100 TB. A join without a shuffle keeps the rows of a block in order
    placed = text.join(F.broadcast(begins), ["file", "block"]).select("file", "block", "value", "quoted", "depth", "level")
    folder = f"{new_folder(spark)}/cut"
    placed.mapInArrow(_cut, "file string, block long, kind string, key string, json string").write.parquet(folder)
    cut = spark.read.parquet(folder)
    # the key that a block begins under, and the block in which an object over its border begins
    last = cut.where("kind = 'key'").select("file", "block", F.last("key", ignorenulls=True).over(before).alias("under"))
    rank = F.when(F.col("kind") == "begin", 1).otherwise(0)
    opened = F.last(F.when(F.col("kind") == "begin", F.col("block")), ignorenulls=True).over(along.orderBy("block", rank))
    pieces = cut.where("kind in ('begin', 'middle', 'end')")
    owner = pieces.select("file", "block", "kind", opened.alias("of")).where("of is not null")
    met = pieces.join(owner, ["file", "block", "kind"])
    joined = met.groupBy("file", F.col("of").alias("block")).agg(
        F.max(F.when(F.col("kind") == "begin", F.col("key"))).alias("key"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "json"))), lambda x: x["json"]), "").alias("json"), F.bool_or(F.col("kind") == "end").alias("whole")
    )
    all_of = cut.where("kind = 'whole'").select("file", "block", "key", "json").unionByName(joined.where("whole").select("file", "block", "key", "json"))
    found = all_of.join(last, ["file", "block"], "left").join(begins.select("file", F.col("level")).distinct(), "file")
    key = F.when(F.col("level") == 2, F.coalesce("key", "under"))
    return found.select("file", key.alias("key"), "json", "level").where((F.col("level") == 1) | F.col("key").isin(keys)).drop("level")
