"""Substring dedup: passages that stand earlier in the corpus go, found by suffix automata of reference shards.

A window is ``window`` consecutive words. Each window is dealt by its minimizer, the least hash of its runs of
``GRAM`` words: equal windows have equal minimizers, wherever they stand. A minimizer that stands once in the
corpus can't belong to a repeated window, and its windows are left alone. The document in which any other one
stands first is its home, and a shard is a set of homes. So a passage that is copied as a whole stays in one
piece and in one shard, and every window is in exactly one shard, with all windows that equal it.

A shard's automaton is built online, its passages in the order of the corpus: a passage is streamed through
the automaton of all that is earlier (matching statistics), spans that match ``window`` words or more are
repeats, and the rest is added. Copies of a passage are one row there, with its first place. The reference grows
with the corpus and so is never broadcast as a whole: an automaton goes to the task that holds the passages of
its shard, which is bounded. The passages of a shard of over ``HOT`` times the set size (a home whose passages stand among ever
different words) are cut where their minimizers change and dealt by these; where that is too much still, they
are cut into windows. Copies of such pieces are one row again.

The order is that of doc_id, null last; rows of one doc_id follow the hash of their text, and equal rows their
place in the input. Null texts have no words; a text of fewer words than a window keeps all. Repeated rows are
judged one by one: the first keeps its text. Of further columns nothing is used, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convarchive.llm.common import numbered, require, stored, table

WINDOW = 20
#: Words of a gram whose hash may be a minimizer; windows have at least as many.
GRAM = 5
#: Words of a shard that is sought, and how many times that it may hold: an automaton takes about 600 bytes a word that is new to it,
#: so a task holds 360 MB at most, and far less where passages repeat each other.
SHARD_WORDS = 50_000
HOT = 12
PASSAGE, PASSAGE_SCHEMA = ["shard", "rank", "a", "n", "text"], "shard long, rank long, a int, n int, text string"
PASSAGE_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]


class SuffixAutomaton:
    """All substrings of the word lists added so far; lists don't run into each other."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.size = [-1], [0]

    def _state(self, size: int, link: int, out: dict) -> int:
        self.next.append(out)
        self.size.append(size)
        self.link.append(link)
        return len(self.size) - 1

    def _split(self, p: int, word, q: int) -> int:
        """The state for ``p``'s substrings and ``word``, where ``q`` has longer ones too."""
        new = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = new
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = new
            p = self.link[p]
        return new

    def add(self, words: list) -> list[int]:
        """Adds the list; for each word, how many words up to it had ended at an earlier place."""
        last, seen, out, size, link = 0, [], self.next, self.size, self.link
        for word in words:
            q = out[last].get(word)
            if q is not None:
                last = q if size[q] == size[last] + 1 else self._split(last, word, q)
                seen.append(size[last])
                continue
            new, p = self._state(size[last] + 1, 0, {}), last
            while p >= 0 and word not in out[p]:
                out[p][word] = new
                p = link[p]
            if p >= 0:
                q = out[p][word]
                link[new] = q if size[q] == size[p] + 1 else self._split(p, word, q)
            last = new
            seen.append(size[link[new]])
        return seen

    def statistics(self, words: list) -> list[int]:
        """For each word, how many words up to it occur in a list that was added."""
        state, length, found, out, size, link = 0, 0, [], self.next, self.size, self.link
        for word in words:
            to = out[state].get(word)
            while to is None and state:
                state = link[state]
                length = size[state]
                to = out[state].get(word)
            if to is not None:
                state, length = to, length + 1
            found.append(length)
        return found


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """``(start, end)`` of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def repeats(passages: list[list], window: int = WINDOW) -> list[list[tuple[int, int]]]:
    """For each passage, in order, the runs of its windows ``(first, beyond)`` that start earlier in these or in itself."""
    automaton, out = SuffixAutomaton(), []
    for words in passages:
        again = np.array(automaton.statistics(words)[window - 1 :]) >= window
        for a, b in runs(~again):
            again[a:b] = np.array(automaton.add(words[a : b + window - 1])[window - 1 :]) >= window
        out.append(runs(again))
    return out


class _Hashes(dict):
    """The hashes of words met so far, in bounded memory."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, 42)
        return found


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    out, done = values, 1
    while 2 * done <= width:
        out, done = np.minimum(out[:-done], out[done:]), 2 * done
    return np.minimum(out[: len(values) - width + 1], out[width - done :]) if done < width else out


def minimizers(words: list[bytes], hashes: dict, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one minimizer: its hash, the first window, how many, and whether it stands in the text again."""
    gram = min(GRAM, window)
    n = len(words)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, bool)
    own = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    grams = np.zeros(n - gram + 1, np.uint64)
    for k in range(gram):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + own[k : n - gram + 1 + k]
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    width = window - gram + 1
    least = _least(grams, width)
    start = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    size = np.diff(np.concatenate([start, [len(least)]]))
    # a gram is a minimizer if no window that holds it has a smaller one
    ends = np.zeros(width - 1, np.uint64)
    most = ~_least(~np.concatenate([ends, least, ends]), width)
    value, times = np.unique(grams[most == grams], return_counts=True)
    h = least[start]
    return h.view(np.int64), start.astype(np.int32), size.astype(np.int32), np.isin(h, value[times > 1])


def _flat(columns: list[list[np.ndarray]], kinds: list) -> list[pa.Array]:
    return [pa.array(np.concatenate([np.zeros(0, k), *c])) for c, k in zip(columns, kinds, strict=True)]


def _marks(window: int):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for whole in rows:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                found = [minimizers((t or "").encode().split(), hashes, window) for t in b.column("text").to_pylist()]
                rank = np.repeat(b.column("rank").to_numpy(), [len(x[0]) for x in found])
                cols = _flat([list(x) for x in zip(*found, strict=True)], [np.int64, np.int32, np.int32, bool])
                yield pa.RecordBatch.from_arrays([pa.array(rank, pa.int64()), *cols], ["rank", "h", "a", "n", "again"])

    return batches


def _passages(window: int):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                cols: list[list] = [[] for _ in range(5)]
                for text, rank, places in zip(b.column("text").to_pylist(), b.column("rank").to_pylist(), b.column("places").to_pylist(), strict=True):
                    words = text.encode().split()
                    joined: list[list[int]] = []
                    for a, n, shard in sorted((p["a"], p["n"], p["shard"]) for p in places):
                        if joined and joined[-1][2] == shard and joined[-1][0] + joined[-1][1] == a:
                            joined[-1][1] += n
                        else:
                            joined.append([a, n, shard])
                    for a, n, shard in joined:
                        for col, x in zip(cols, (shard, rank, a, n, b" ".join(words[a : a + n + window - 1]).decode()), strict=True):
                            col.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, PASSAGE_KINDS, strict=True)], PASSAGE)

    return batches


def _searched(window: int):
    spans = pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32())]))

    def group(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("rank", "ascending"), ("a", "ascending")])
        known: dict = {}
        passages = ([known.setdefault(w, w) for w in t.encode().split(b" ")] for t in rows.column("text").to_pylist())
        found = [[{"start": a, "size": b - a + window - 1} for a, b in x] for x in repeats(passages, window)]
        return pa.table([rows.column("shard"), rows.column("key"), rows.column("rank"), rows.column("a"), pa.array(found, spans)], names=["shard", "key", "first_rank", "first_a", "found"])

    return group


def _kept(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in rows:
        for block in range(0, whole.num_rows, 256):
            b = whole.slice(block, 256)
            n_words, n_removed, texts = [], [], []
            for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                words, stay, at = (text or "").encode().split(), [], 0
                for s in spans or ():
                    stay += words[at : s["start"]]
                    at = max(at, s["start"] + s["size"])
                stay += words[at:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(stay))
                texts.append(b" ".join(stay).decode())
            cols = [b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), b.column("spans"), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "spans", "text"])


def in_order(rows: DataFrame) -> DataFrame:
    """``(__row, rank)``: ranks ascend by doc_id, null last, then by the text's hash, then by the row's number."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["none", "doc_id", "hash", "__row"]
    keys = rows.select("__row", "doc_id", F.col("doc_id").isNull().alias("none"), F.xxhash64("text").alias("hash"))
    return stored(keys.repartitionByRange(n, *order).sortWithinPartitions(*order).select("__row", F.monotonically_increasing_id().alias("rank")))


def _distinct(passages: DataFrame) -> DataFrame:
    """Passages once, at their first place."""
    found = passages.groupBy("shard", "key").agg(F.min(F.struct("rank", "a")).alias("at"), F.first("n").alias("n"), F.first("text").alias("text"))
    return found.select("shard", "key", "at.rank", "at.a", "n", "text")


def _by_minimizer(passages: DataFrame, window: int, shards: int) -> DataFrame:
    """Passages cut where their windows' minimizers change, dealt by these."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in rows:
            cols: list[list] = [[] for _ in range(5)]
            for text, rank, a in zip(*(b.column(c).to_pylist() for c in ("text", "rank", "a")), strict=True):
                words = text.encode().split()
                h, start, size, _ = minimizers(words, hashes, window)
                for shard, at, n in zip((h.view(np.uint64) % np.uint64(shards)).tolist(), start.tolist(), size.tolist(), strict=True):
                    for col, x in zip(cols, (-1 - 2 * shard, rank, a + at, n, b" ".join(words[at : at + n + window - 1]).decode()), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, PASSAGE_KINDS, strict=True)], PASSAGE)

    return _keyed(passages.select("text", "rank", "a").mapInArrow(batches, PASSAGE_SCHEMA))


def _by_window(passages: DataFrame, window: int, shards: int) -> DataFrame:
    """The windows of passages as passages of their own, dealt by themselves."""
    starts = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k")
    cut = passages.select("rank", "a", F.split("text", " ").alias("w"), starts)
    cut = cut.select("rank", (F.col("a") + F.col("k")).alias("a"), F.array_join(F.slice("w", F.col("k") + 1, window), " ").alias("text"))
    shard = -2 - 2 * F.pmod(F.xxhash64("text"), F.lit(shards))
    return _keyed(cut.select(shard.alias("shard"), "rank", "a", F.lit(1).alias("n"), "text"))


def _keyed(passages: DataFrame) -> DataFrame:
    return stored(passages.withColumn("key", F.unhex(F.md5("text"))))


def repeated_spans(passages: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``(rank, spans)``: what is repeated of each of ``passages(shard, key, rank, a, n, text)``, counted in words of its document."""
    fields = "shard long, key binary, first_rank long, first_a int, found array<struct<start:int,size:int>>"
    groups, handed_on, seen = [], [], []
    for finer in (_by_minimizer, _by_window, None):
        seen.append(passages.select("shard", "key", "rank", "a", "n"))
        firsts = stored(_distinct(passages))
        sizes = firsts.groupBy("shard").agg(F.sum(F.col("n").cast("long") + (window - 1)).alias("words"))
        hot = stored(sizes.where(F.col("words") > HOT * shard_words))
        words = hot.agg(F.sum("words")).first()[0] if finer else None
        if not words:
            groups.append(firsts)
            break
        groups.append(firsts.join(hot, "shard", "left_anti"))
        large = firsts.join(hot, "shard", "left_semi")
        # their first places are judged by the pieces they are cut into
        handed_on.append(large.select("shard", "key", F.col("rank").alias("first_rank"), F.col("a").alias("first_a"), F.array().cast("array<struct<start:int,size:int>>").alias("found")))
        passages = finer(large, window, -(-3 * words // shard_words))
    whole = reduce(DataFrame.unionByName, [g.select("shard", "key", "rank", "a", "text") for g in groups])
    searched = stored(whole.groupBy("shard").applyInArrow(_searched(window), fields))
    searched = reduce(DataFrame.unionByName, [searched, *handed_on])
    whole = F.array(F.struct(F.col("a").alias("start"), (F.col("n") + (window - 1)).alias("size")))
    own = F.transform("found", lambda s: F.struct((F.col("a") + s["start"]).alias("start"), s["size"].alias("size")))
    first = (F.col("rank") == F.col("first_rank")) & (F.col("a") == F.col("first_a"))
    met = reduce(DataFrame.unionByName, seen).join(searched, ["shard", "key"])
    return met.select("rank", F.when(first, own).otherwise(whole).alias("spans")).where(F.size("spans") > 0)


def dedup_substrings(documents: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``(doc_id, n_words, n_removed, spans, text)`` a row: words removed, where (start and size, may overlap), and the words kept, joined by spaces."""
    if window < 1:
        raise ValueError("a window has at least one word")
    require(documents, "doc_id", "text")
    kind = documents.select("doc_id").schema[0].dataType.simpleString()
    rows = numbered(documents.select("doc_id", "text"))
    ranks = in_order(rows)
    marks = stored(rows.join(ranks, "__row").select("rank", "text").mapInArrow(_marks(window), "rank long, h long, a int, n int, again boolean"))
    homes = marks.groupBy("h").agg(F.min("rank").alias("home"), F.count("*").alias("times"), F.max("again").alias("again"))
    homes = stored(homes.where("times > 1 or again").select("h", "home", "times"))
    # a minimizer's run has about half as many windows as the window has grams
    words = (homes.agg(F.sum("times")).first()[0] or 0) * max(1, (window - GRAM + 2) // 2)
    shards = max(1, -(-words // shard_words))
    places = marks.join(homes, "h").select("rank", F.struct("a", "n", F.pmod(F.xxhash64("home"), F.lit(shards)).alias("shard")).alias("place"))
    places = places.groupBy("rank").agg(F.collect_list("place").alias("places")).join(ranks, "rank")
    passages = _keyed(rows.join(places, "__row").select("rank", "text", "places").mapInArrow(_passages(window), PASSAGE_SCHEMA))
    spans = repeated_spans(passages, window, shard_words)
    spans = spans.groupBy("rank").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans")).join(ranks, "rank")
    out = rows.join(spans.select("__row", "spans"), "__row", "left").select("doc_id", "text", "spans")
    return out.mapInArrow(_kept, f"doc_id {kind}, n_words long, n_removed long, spans array<struct<start:int,size:int>>, text string")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i+19], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
again AS (SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY s ORDER BY r, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 20)) AS p FROM again),
lost AS (SELECT r, count(*) AS n FROM gone GROUP BY r),
word AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN lost USING (r) LEFT JOIN kept USING (r)
"""
