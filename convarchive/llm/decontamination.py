"""Benchmark decontamination: documents that contain windows of benchmark items, by a prefix-filtered set join.

An item's windows are its runs of ``window`` words (an item with fewer has one window). Containment needs
every word of a window, so a prefix of one word is necessary: the window's rarest by the words' counts in
all documents. Document words meet these prefix words; the window's second rarest word must stand at its
distance (the positional bound) and the window must end inside the document (the length bound). What is
left are candidate places with the words that stand there, and an equi-join with the items' windows on all
words verifies them exactly. Hits of a document are the union of its verified windows.

The benchmark's prefix words are broadcast in blocks of at most ``block`` windows, so the broadcast is
bounded whatever the benchmark's size: each block is one more step over the same rows.

Null and wordless texts have no words and no hits; wordless items have no windows; items may repeat, their
ids may too (windows then count for the id). Windows of items without an id hit words and contaminate, but there
is no id to list. Each document row is judged, repeated rows and ids alike. Of further columns nothing is used.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convarchive.llm.common import ascii_lower, kept, require, table

WINDOW = 10
BLOCK = 200_000
#: Bytes of words (0-9, a-z, and A-Z in lower case, and all from 0x80 on); the others divide words.
FOLD = bytes(b if chr(b).isdigit() and b < 128 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def doc_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(item_id, words)``: the distinct windows of each item."""
    require(benchmark, "item_id", "text")
    found = F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(f"({WORD})"), 1)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1))
    return (
        benchmark.select("item_id", found.alias("w"))
        .where(F.size("w") > 0)
        .select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("words"))
        .distinct()
    )


def word_counts(documents: DataFrame, vocabulary: set[bytes]) -> DataFrame:
    """``(word, n)`` of a bounded vocabulary over all documents."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in rows:
            for text in b.column(0).to_pylist():
                counts.update(filter(vocabulary.__contains__, doc_words(text)))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    return documents.select("text").mapInArrow(batches, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def prefixes(windows: list[list[str]], counts: dict[str, int]) -> dict[bytes, list[tuple[int, int, int, bytes]]]:
    """Prefix word -> (its place in a window, the window's length, distance to the second word, second word)."""
    found: dict[bytes, set] = defaultdict(set)
    for words in windows:
        rare = sorted(range(len(words)), key=lambda i: (counts.get(words[i], 0), words[i], i))
        first, second = rare[0], rare[min(1, len(rare) - 1)]
        found[words[first].encode()].add((first, len(words), second - first, words[second].encode()))
    return {w: sorted(x) for w, x in found.items()}


def _candidates(rows: DataFrame, anchors: dict, schema: str, last: bool) -> DataFrame:
    def batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, n_words = [], []
            for text, before in zip(b.column("text").to_pylist(), b.column("places").to_pylist(), strict=True):
                words = doc_words(text)
                places = set()
                for i in [i for i, w in enumerate(words) if w in anchors]:
                    for at, length, step, second in anchors[words[i]]:
                        start = i - at
                        if start >= 0 and start + length <= len(words) and words[i + step] == second:
                            places.add((start, length))
                found.append((before or []) + [{"start": s, "words": b" ".join(words[s : s + n]).decode(), "length": n} for s, n in sorted(places)])
                n_words.append(len(words))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("words", pa.string())]))
            cols = {"row": b.column("row"), "doc_id": b.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "places": pa.array(found, kind)}
            if not last:
                cols["text"] = b.column("text")
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return rows.mapInArrow(batches, schema + ("" if last else ", text string"))


def covered(spans: Column) -> Column:
    """How many places a sorted array of (start, length) covers."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(
        spans,
        zero,
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(a["end"], s["start"]))).alias("n"),
            F.greatest(a["end"], s["start"] + s["length"]).alias("end"),
        ),
        lambda a: a["n"],
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """``(doc_id, row, n_words, n_hit, items, spans, contaminated)`` a document row."""
    require(documents, "doc_id", "text")
    windows = kept(item_windows(benchmark, window).withColumn("block", F.lit(0)))
    n = windows.count()
    blocks = max(1, -(-n // block))
    kind = documents.select("doc_id").schema[0].dataType.simpleString()
    schema = f"row long, doc_id {kind}, n_words long, places array<struct<start:long,length:long,words:string>>"
    rows = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").withColumn(
        "places", F.array().cast("array<struct<start:long,length:long,words:string>>")
    )
    windows = windows.select("item_id", "words", F.pmod(F.xxhash64("words"), F.lit(blocks)).alias("block"))
    for k in range(blocks):
        own = [r.words for r in windows.where(F.col("block") == k).select("words").distinct().collect()]  # at most about `block`
        vocabulary = {w.encode() for words in own for w in words}
        counts = {r.word: r.n for r in word_counts(documents, vocabulary).collect()} if own else {}
        rows = _candidates(rows, prefixes(own, counts), schema, last=k == blocks - 1)
    exact = windows.select(F.array_join("words", " ").alias("words"), "item_id", F.lit(True).alias("hit")).distinct()
    places = rows.select("row", "doc_id", "n_words", F.explode_outer("places").alias("p")).select("row", "doc_id", "n_words", "p.*")
    hits = places.join(exact, "words", "left")
    spans = F.sort_array(F.collect_set(F.when(F.col("hit"), F.struct("start", "length"))))
    out = hits.groupBy("row", "doc_id", "n_words").agg(spans.alias("spans"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    out = out.withColumn("n_hit", covered(F.col("spans")))
    return out.select("doc_id", "row", "n_words", "n_hit", "items", "spans", (F.col("n_hit") > 0).alias("contaminated"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, array_to_string(w[i:i+9], ' ') AS s, len(w[i:i+9]) AS n FROM bw),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
ds AS (SELECT r, i, n, array_to_string(w[i:i+n-1], ' ') AS s FROM dw),
hit AS (SELECT r, i, ds.n, item_id FROM ds JOIN win USING (s)),
pos AS (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hit)),
h AS (SELECT r, count(*) AS n_hit FROM pos GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN it USING (r)
"""
