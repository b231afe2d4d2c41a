"""LM scoring by online logistic context mixing over the bits of words.

A text is its words in lower case (A-Z) and one end. Each word is spelled by its bytes and a terminator;
every symbol is a path of binary decisions in a Huffman tree of the training symbols. Hashed contexts predict
each decision: inside a word the last one, two, three and five bytes and the whole prefix; for its first byte
the last one, two and three bytes of the word before, that word, and the two before. A context and a tree node
share a slot of a fixed table, which holds how often each bit followed. The predictions enter a logistic mixer in
the stretched domain; a gate (first byte or not, and how often the two longest contexts have been seen, in six
levels) picks the weights. Weights are refined online, block by block, on the training documents
of fold 1, against tables without that fold's counts, so that they show how far each context can be trusted; an
adaptive probability map then corrects the mixed probability by gate. The tables that score have the counts of all
training folds. The score is the sum of the decisions' log10 probabilities; ``bits_per_byte`` is its total per byte.

What follows a word's first byte depends on the word alone, so it is counted and scored once for each word of
the corpus, in a table of all words that Spark counts, and joined to the texts' words by their XXH64. The most
frequent words, at most ``common`` of them, are broadcast instead. Counts of words and contexts cover all training
documents. Bit tables have a fixed size (``n_slots(bits)``), so their loss by shared slots grows with
the corpus; they are summed block by block over the cluster, and only the finished tables pass the driver.

Null and empty texts are the end alone. Rows without doc_id are learned from. Repeated rows are scored alike; of
further columns nothing is used, whatever their names.
"""

from __future__ import annotations

import copy
import heapq
from collections.abc import Iterator
from functools import cached_property
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convarchive.llm.common import give_back, kept, require, stored, table
from convarchive.llm.tokens import cut_words, in_blocks

FOLDS, MIXED_FOLD = 10, 1
COMMON = 500_000
BITS = 22
CONTEXTS, LEVELS, MAP = 5, 6, 33
GATES = 2 * LEVELS * LEVELS
SEEN = (1, 2, 4, 12, 60)  # where the levels of how often a slot was seen begin
END, STOP = 256, 32  # symbols: the end of a text, the end of a word
END_WORD = b" "  # no word has a space
SLICE = 20_000  # words that are spelled at once
BLOCK, SMALL_BLOCK, LEARNED_BLOCK = 8_000_000, 2_000_000, 4_000_000  # bytes of text that are cut into words at once: alone, beside tables, in learning
CHUNK = 200_000  # tokens whose contexts are held at once
BLOCKS = 64
CARRY, LIGHT = 1 << 14, 16  # how much is taken at a time from a cell that gets full; weights below which pairs are put down together
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Contexts leave their lowest bits free, so that a context and a symbol fit into one number.
LOW = np.uint64(511)


def text_words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def word_keys(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(7)), np.uint64, len(words))


def bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words in a row, and where each word begins (one more at the end)."""
    words = words.cast(pa.large_binary())
    _, at, flat = words.buffers()
    if not len(words):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(at, np.int64)[words.offset : words.offset + len(words) + 1]
    return np.frombuffer(flat or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def listed(words: pa.Array) -> list[bytes]:
    flat, at = bytes_of(words)
    data, at = flat.tobytes(), at.tolist()
    return [data[a:b] for a, b in zip(at, at[1:], strict=False)]


def sums(pairs: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of equal numbers: one's place, the number, the sum of their weights."""
    order = np.argsort(pairs)
    found = pairs[order]
    new = np.flatnonzero(np.diff(found, prepend=~found[:1])) if len(found) else np.zeros(0, np.int64)
    return order[new], found[new], np.add.reduceat(weights[order], new) if len(new) else weights[:0]


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """All rows of some batches in batches of about so many rows, as equal beginnings of words are spelled once a batch."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * A
    return x ^ (x >> np.uint64(29))


class Code:
    """Paths of a Huffman tree over 257 symbols, from their counts (one more each)."""

    def __init__(self, counts: np.ndarray):
        heap = [(int(c) + 1, s, s) for s, c in enumerate(counts)]
        heapq.heapify(heap)
        parent: dict[int, tuple[int, int]] = {}
        node = 257
        while len(heap) > 1:
            (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            parent[x], parent[y] = (node, 0), (node, 1)
            heapq.heappush(heap, (a + b, node, node))
            node += 1
        paths = []
        for s in range(257):
            path, at = [], s
            while at in parent:
                at, bit = parent[at]
                path.append((at - 257, bit))
            paths.append(path[::-1])
        self.length = np.array([len(p) for p in paths], np.int64)
        self.offset = np.cumsum(self.length) - self.length
        self.place = np.array([n for p in paths for n, _ in p], np.uint64) * B
        self.bit = np.array([b for p in paths for _, b in p], np.int64)

    def decisions(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each decision: which symbol it belongs to, its node times ``B``, its bit."""
        n = self.length[symbols]
        of = np.repeat(np.arange(len(symbols)), n)
        at = np.arange(len(of)) + (self.offset[symbols] - (np.cumsum(n) - n))[of]
        return of, self.place[at], self.bit[at]


def table_bits(bits: int) -> list[int]:
    """The size of each context's table: the longer the context, the more there are of it."""
    return [bits - 4, bits - 2, bits - 1, bits, bits + 1]


def n_slots(bits: int) -> int:
    return sum(1 << b for b in table_bits(bits))


def slots(k: int, contexts: np.ndarray, of: np.ndarray, place: np.ndarray, bits: int) -> np.ndarray:
    """Slot of a context, in one row of all tables, for each decision; ``place`` is the node times ``B``."""
    sizes = table_bits(bits)
    at = contexts[of]
    at += place
    at *= A
    at >>= np.uint64(64 - sizes[k])
    at += np.uint64(sum(1 << b for b in sizes[:k]))
    return at.view(np.int64)


def inner_events(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Of all symbols after a word's first byte: the word's number, the symbol, its contexts by table."""
    flat = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.cumsum(size) - size
    of = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(flat)) - start[of]
    code = flat.astype(np.uint64) + np.uint64(1)
    back = [np.where(place >= k, np.roll(code, k), 0) for k in range(1, 6)]
    total = np.cumsum(mixed(code * B + place.astype(np.uint64)))
    prefix = np.roll(total, 1)
    prefix = prefix - (np.concatenate([[np.uint64(0)], total])[start])[of]
    after = np.flatnonzero(place > 0)
    one = back[0]
    two = one * np.uint64(257) + back[1]
    three = two * np.uint64(257) + back[2]
    five = (three * np.uint64(257) + back[3]) * np.uint64(257) + back[4]
    contexts = {k: mixed(c[after] * np.uint64(8) + np.uint64(k)) & ~LOW for k, c in enumerate((one, two, three, five, prefix))}
    return of[after], flat[after].astype(np.int64), contexts


def spread(raw: np.ndarray, k: int) -> np.ndarray:
    """Contexts of first symbols from what they stand for."""
    return (mixed(raw * np.uint64(8) + np.uint64(k)) ^ A) & ~LOW


class Tokens:
    """The tokens of some texts: ``words``, the code of each token (the end is one more), ``ends`` of the texts, and what contexts need of a word."""

    def __init__(self, texts: pa.Array):
        codes, self.words, starts = cut_words(pc.ascii_lower(texts))
        self.n = np.diff(starts) + 1
        self.ends = np.cumsum(self.n)
        self.codes = np.full(len(codes) + len(self.n), len(self.words), np.int64)
        real = np.ones(len(self.codes), bool)
        real[self.ends - 1] = False
        self.codes[real] = codes

    @cached_property
    def spelled(self) -> list[bytes]:
        return listed(self.words)

    @cached_property
    def keys(self) -> np.ndarray:
        return word_keys([*self.spelled, END_WORD])

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n)), self.n)

    @cached_property
    def first(self) -> np.ndarray:
        """The first symbol of each word, and the end."""
        flat, at = bytes_of(self.words)
        return np.append(flat[at[:-1]].astype(np.int64), END)

    def before(self, back: int) -> np.ndarray:
        """For each token, the code of the word so many places before it in its text; that of the end where there is none."""
        place = np.arange(len(self.codes)) - np.repeat(self.ends - self.n, self.n)
        return np.where(place >= back, np.concatenate([np.zeros(back, np.int64), self.codes[: max(0, len(self.codes) - back)]])[: len(self.codes)], len(self.words))

    @cached_property
    def tails(self) -> list[np.ndarray]:
        """Of each word, and of none, the contexts of what follows it: its last one, two and three bytes, and all of it."""
        flat, at = bytes_of(self.words)
        size = np.diff(at)
        byte = [np.where(size > k, flat[np.maximum(at[1:] - 1 - k, 0)], 0).astype(np.uint64) for k in range(3)]
        raw = [byte[0] + np.uint64(1)]
        for b in byte[1:]:
            raw.append(raw[-1] << np.uint64(9) | b)
        return [spread(np.append(c, np.uint64(0)), k) for k, c in enumerate([*raw, self.keys[:-1]])]

    def two_before(self, own: slice, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The contexts of the two words before each token."""
        keys = np.append(self.keys[:-1], np.uint64(0))
        return spread((keys * B)[one[own]] + keys[two[own]], 4)

    def first_events(self) -> Iterator[tuple[slice, np.ndarray, dict[int, np.ndarray]]]:
        """Of the tokens' first symbols, chunk by chunk: which tokens, the symbols, their contexts by table."""
        one, two = self.before(1), self.before(2)
        for start in range(0, len(self.codes), CHUNK):
            own = slice(start, min(start + CHUNK, len(self.codes)))
            yield own, self.first[self.codes[own]], {k: c[one[own]] for k, c in enumerate(self.tails)} | {4: self.two_before(own, one, two)}

    def count_firsts(self, counts: Counts) -> None:
        """Counts what ``first_events`` gives; all but the longest context depend on one word, and are taken once for it and a symbol."""
        one, two = self.before(1), self.before(2)
        for start in range(0, len(self.codes), CHUNK):
            own = slice(start, min(start + CHUNK, len(self.codes)))
            pairs = self.two_before(own, one, two) | self.first[self.codes[own]].view(np.uint64)
            pairs.sort()
            new = np.flatnonzero(np.diff(pairs, prepend=~pairs[:1]))
            counts.put(4, pairs[new], np.diff(new, append=len(pairs)))
        pairs = one << 9 | self.first[self.codes]
        pairs.sort()
        new = np.flatnonzero(np.diff(pairs, prepend=-1))
        word, symbols, n = pairs[new] >> 9, (pairs[new] & 511).view(np.uint64), np.diff(new, append=len(pairs))
        for k, c in enumerate(self.tails):
            counts.put(k, *sums(c[word] | symbols, n)[1:])


class Counts:
    """Bit counts of one task: 16 bits a cell, and for the few cells that hold more, how many times ``CARRY`` was taken out of them."""

    def __init__(self, code: Code, bits: int):
        self.code, self.bits = code, bits
        self.table = np.zeros(2 * n_slots(bits), np.uint16)
        self.carried: dict[int, int] = {}

    def carry(self, cells: np.ndarray, counts: np.ndarray) -> None:
        """Puts whole counts into different cells: what 16 bits hold, the rest as times of ``CARRY``."""
        times = np.where(counts >= 2 * CARRY, counts // CARRY, 0)
        self.table[cells] = counts - times * CARRY
        full = np.flatnonzero(times)
        for cell, n in zip(cells[full].tolist(), times[full].tolist(), strict=True):
            self.carried[cell] = self.carried.get(cell, 0) + n

    def put(self, k: int, pairs: np.ndarray, weights: np.ndarray) -> None:
        """Puts down pairs of context and symbol; those of light weight in pieces that add less than two ``CARRY`` to any cell."""
        light = weights < LIGHT
        heavy, n = pairs[~light], weights[~light]
        for at in range(0, len(heavy), 1 << 16):
            of, cells = self.cells(k, heavy[at : at + (1 << 16)])
            _, cells, sum_of = sums(cells, n[at : at + (1 << 16)][of])
            self.carry(cells, self.table[cells] + sum_of)
        pairs, weights, at = pairs[light], weights[light], 0
        for end in (np.flatnonzero(np.diff(np.cumsum(weights) // CARRY, append=-1)) + 1).tolist():
            of, cells = self.cells(k, pairs[at:end])
            np.add.at(self.table, cells, weights[at:end].astype(np.uint16)[of])
            full = np.unique(cells[self.table[cells] >= 2 * CARRY])
            self.carry(full, self.table[full].astype(np.int64))
            at = end

    def cells(self, k: int, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each decision: which pair it belongs to, and its place in the table."""
        of, place, bit = self.code.decisions((pairs & LOW).view(np.int64))
        return of, slots(k, pairs & ~LOW, of, place, self.bits) * 2 + bit

    def put_inner(self, words: list[bytes], n: np.ndarray) -> None:
        """Equal beginnings of words are put down once: they have the same contexts."""
        of, symbols, contexts = inner_events(words)
        symbols = symbols.view(np.uint64)
        at, pairs, n = sums(contexts[4] | symbols, n[of])
        self.put(4, pairs, n)
        for k in range(4):
            self.put(k, *sums(contexts[k][at] | symbols[at], n)[1:])

    def blocks(self) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """Of each block that isn't empty the counts up to 255, and the places and values of the larger ones."""
        flat = self.table.reshape(BLOCKS, -1)
        cells = np.array(sorted(self.carried), np.int64)
        more = np.array([self.carried[c] for c in cells.tolist()], np.int64) * CARRY
        bounds = np.searchsorted(cells, np.arange(BLOCKS + 1) * flat.shape[1])
        for i in range(BLOCKS):
            own = slice(bounds[i], bounds[i + 1])
            over = cells[own] - i * flat.shape[1]
            if flat[i].any() or len(over):
                large = np.union1d(np.flatnonzero(flat[i] > 255), over)
                values = flat[i][large].astype(np.int64)
                values[np.searchsorted(large, over)] += more[own]
                small = np.minimum(flat[i], 255).astype(np.uint8)
                small[over] = 255
                yield i, pa.compress(small.tobytes(), "zstd", asbytes=True), large.astype(np.uint32).tobytes(), values.astype(np.uint32).tobytes()

    def batches(self) -> Iterator[pa.RecordBatch]:
        """The blocks, a few in a batch, so that they aren't held twice beside the table."""
        types = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        blocks = self.blocks()
        while found := list(islice(blocks, 8)):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), types, strict=True)], ["block", "small", "place", "large"])


class Model:
    def __init__(self, code: Code, stretched: np.ndarray, levels: np.ndarray, bits: int):
        self.code, self.bits, self.stretched, self.levels = code, bits, stretched, levels
        self.weights = np.full((GATES, CONTEXTS), 0.2)
        self.map = np.zeros((GATES, MAP, 2))

    def inputs(self, symbols: np.ndarray, contexts: dict[int, np.ndarray], gate: int, cut: slice):
        of, place, bit = self.code.decisions(symbols[cut])
        x = np.zeros((CONTEXTS, len(of)), np.float32)
        gates = np.full(len(of), gate)
        for k, c in contexts.items():
            at = slots(k, c[cut], of, place, self.bits)
            x[k] = self.stretched[at]
            if k > 2:
                gates = gates * LEVELS + self.levels[at]
        return of, bit, x, gates

    def __getstate__(self) -> dict:
        """Tables travel compressed: they are broadcast, and mostly empty on small corpora."""
        packed = {k: (pa.compress(x.tobytes(), "zstd", asbytes=True), x.dtype.str, x.shape) for k, x in self.__dict__.items() if k in ("stretched", "levels")}
        return self.__dict__ | packed

    def __setstate__(self, state: dict) -> None:
        for k in ("stretched", "levels"):
            data, kind, shape = state[k]
            size = int(np.prod(shape)) * np.dtype(kind).itemsize
            state[k] = np.frombuffer(pa.decompress(data, size, "zstd"), kind).reshape(shape)
        self.__dict__.update(state)

    @staticmethod
    def level(z: np.ndarray) -> np.ndarray:
        return np.clip(np.rint(z * 2) + MAP // 2, 0, MAP - 1).astype(np.int64)

    def learn(self, symbols: np.ndarray, contexts: dict[int, np.ndarray], gate: int, weights: np.ndarray | None = None, rate: float = 0.05, block: int = 512) -> float:
        """Online: each block is predicted with the weights so far, then moves them."""
        done = 0.0
        for start in range(0, len(symbols), block * 32):
            # tables stay as they are, so that only weights are taken block by block
            cut = slice(start, start + block * 32)
            of, bit, x, gates = self.inputs(symbols, contexts, gate, cut)
            said = np.ones(len(bit)) if weights is None else weights[cut][of]
            mixes, at = np.empty(len(bit)), 0
            for upto in np.searchsorted(of, np.arange(block, len(symbols[cut]) + block, block)).tolist():
                own = slice(at, upto)
                g, w, xs = gates[own], said[own], x[:, own]
                z = mixes[own] = np.clip((xs * self.weights[g].T).sum(0), -15, 15)
                pull = w * (bit[own] - 1 / (1 + np.exp(-z)))
                n = np.bincount(g, w, GATES)
                step = rate * np.minimum(1, n / 50) / np.maximum(n, 1)
                for k in contexts:
                    self.weights[:, k] += step * np.bincount(g, pull * xs[k], GATES)
                at = upto
            self.map += np.bincount((gates * MAP + self.level(mixes)) * 2 + bit, said, self.map.size).reshape(self.map.shape)
            done += said.sum()
        return float(done)

    def scores(self, symbols: np.ndarray, contexts: dict[int, np.ndarray], gate: int) -> np.ndarray:
        """log10 probability of each symbol."""
        out = np.zeros(len(symbols))
        counted = self.map.sum(2)
        trust = counted / (counted + 200) / 2
        # the share of the map in a probability, by gate, level and bit; the rest is the mixer's
        mapped = trust[:, :, None] * np.stack([self.map[:, :, 0] + 0.5, self.map[:, :, 1] + 0.5], 2) / (counted + 1)[:, :, None]
        weights, mapped, rest = self.weights.astype(np.float32), mapped.astype(np.float32).ravel(), (1 - trust).astype(np.float32).ravel()
        for at in range(0, len(symbols), 1 << 14):
            cut = slice(at, at + (1 << 14))
            of, bit, x, g = self.inputs(symbols, contexts, gate, cut)
            z = np.zeros(len(bit), np.float32)
            for k in contexts:
                z += x[k] * weights[:, k][g]
            np.clip(z, -15, 15, out=z)
            place = g * MAP + self.level(z)
            p = rest[place] / (1 + np.exp(np.where(bit == 1, -z, z))) + mapped[place * 2 + bit]
            out[cut] = np.bincount(of, np.log10(p), len(symbols[cut]))
        return out

    def rest(self, words: list[bytes]) -> np.ndarray:
        """log10 probability of all symbols of a word but its first; 0 for the end."""
        out = np.zeros(len(words))
        for at in range(0, len(words), SLICE):
            part = [b"" if w == END_WORD else w for w in words[at : at + SLICE]]
            of, symbols, contexts = inner_events(part)
            # equal beginnings of words are scored once
            first, group = np.unique(contexts[4] | symbols.view(np.uint64), return_index=True, return_inverse=True)[1:]
            scores = self.scores(symbols[first], {k: c[first] for k, c in contexts.items()}, 1)
            out[at : at + SLICE] = np.bincount(of, scores[group], len(part))
        return out


def fold():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)), F.lit(2))


def word_table(rows: DataFrame) -> DataFrame:
    """``(word, n, n_fit)`` of all words and the end: counts in training documents, and in those not of the mixed fold; sorted in each partition."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in rows for part in in_blocks(whole, 0, BLOCK)):
            t = Tokens(b.column(0))
            kind = np.minimum(b.column(1).to_numpy(), 2)  # held out, mixed, counted
            w = len(t.words) + 1
            n = np.bincount(t.codes + w * kind[t.text_of()], minlength=3 * w).reshape(3, w)
            words = pa.concat_arrays([t.words.cast(pa.binary()), pa.array([END_WORD], pa.binary())])
            yield pa.RecordBatch.from_arrays([words, pa.array(n[1] + n[2]), pa.array(n[2])], ["word", "n", "n_fit"])

    parts = rows.select("text", "fold").mapInArrow(batches, "word binary, n long, n_fit long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_fit").alias("n_fit")).sortWithinPartitions("word")


def symbol_counts(words: DataFrame) -> np.ndarray:
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(257, np.int64)
        for b in rows:
            n, said = b.column(1).to_numpy(), listed(b.column(0))
            end = np.fromiter((w == END_WORD for w in said), bool, len(said))
            size = np.fromiter(map(len, said), np.int64, len(said))
            weights = np.repeat(np.where(end, 0, n), size)
            total[:256] += np.bincount(np.frombuffer(b"".join(said), np.uint8), weights, 256).astype(np.int64)
            total[STOP] += n[~end].sum()
            total[END] += n[end].sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(257), pa.int32()), pa.array(total)], ["symbol", "n"])

    got = words.select("word", "n").mapInArrow(batches, "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(257, np.int64)
    for r in got:
        out[r.symbol] = r.n
    return out


def bit_tables(training: DataFrame, words: DataFrame, code: Code, bits: int) -> DataFrame:
    """``(block, odds_fit, levels_fit, odds_all, levels_all)``: of a block's slots the stretched probability, 0 where nothing was
    seen, and the level of how much was; by the counts without the mixed fold and by all."""
    size = 2 * n_slots(bits) // BLOCKS
    fields = "small binary, place binary, large binary"

    def firsts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(code, bits)
        for b in (part for whole in rows for part in in_blocks(whole, 0, SMALL_BLOCK)):
            Tokens(b.column(0)).count_firsts(counts)
        yield from counts.batches()
        del counts
        give_back()

    def spelled(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(code, bits)
        for b in slices(rows, SLICE):
            counts.put_inner(listed(b.column(0)), b.column(1).to_numpy())
        yield from counts.batches()
        del counts
        give_back()

    def total(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sum_of: dict[int, np.ndarray] = {}
        for b in rows:
            for i, mixed_fold, *data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if i not in sum_of:
                    sum_of[i] = np.zeros((2, size), np.int64)
                own = sum_of[i][int(mixed_fold)]
                own += np.frombuffer(pa.decompress(data[0], size, "zstd"), np.uint8)
                own[np.frombuffer(data[1], np.uint32)] += np.frombuffer(data[2], np.uint32).astype(np.int64) - 255
        out: list[list[bytes]] = [[], [], [], []]
        for both in sum_of.values():
            both[1] += both[0]
            for j, n in enumerate(both):
                zeros, ones = n.reshape(-1, 2).T
                s = np.log((ones + 0.2) / (zeros + 0.2))
                out[2 * j].append(pa.compress(np.where(zeros + ones > 0, s, 0).astype(np.float16).tobytes(), "zstd", asbytes=True))
                out[2 * j + 1].append(pa.compress(np.digitize(zeros + ones, SEEN).astype(np.uint8).tobytes(), "zstd", asbytes=True))
        yield pa.RecordBatch.from_arrays([pa.array(list(sum_of), pa.int32()), *(pa.array(x, pa.binary()) for x in out)], ["block", "odds_fit", "levels_fit", "odds_all", "levels_all"])

    own = F.col("fold") == MIXED_FOLD
    spelling = words.where(F.col("word") != F.lit(bytearray(END_WORD)))
    fewer = max(1, spelling.rdd.getNumPartitions() // 4)
    parts = None
    for mixed_fold in (False, True):
        n = F.col("n") - F.col("n_fit") if mixed_fold else F.col("n_fit")
        counted = training.where(own if mixed_fold else ~own).select("text").mapInArrow(firsts, f"block int, {fields}")
        inner = spelling.select("word", n.alias("n")).where("n > 0").coalesce(fewer).mapInArrow(spelled, f"block int, {fields}")
        both = counted.unionByName(inner).select("block", F.lit(mixed_fold).alias("mixed_fold"), "small", "place", "large")
        parts = both if parts is None else parts.unionByName(both)
    return stored(parts.repartition(BLOCKS, "block").mapInArrow(total, "block int, odds_fit binary, levels_fit binary, odds_all binary, levels_all binary"))


def finished_tables(parts: DataFrame, which: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Odds and levels of all slots, at the driver: of a fixed size."""
    size = n_slots(bits) // BLOCKS
    odds, levels = np.zeros((BLOCKS, size), np.float16), np.zeros((BLOCKS, size), np.uint8)
    for r in parts.select("block", f"odds_{which}", f"levels_{which}").collect():
        odds[r[0]] = np.frombuffer(pa.decompress(bytes(r[1]), 2 * size, "zstd"), np.float16)
        levels[r[0]] = np.frombuffer(pa.decompress(bytes(r[2]), size, "zstd"), np.uint8)
    return odds.ravel(), levels.ravel()


def refine(model: Model, fold_rows: DataFrame) -> None:
    """Weights and probability map from online mixing in every partition, averaged by decisions."""
    shared = fold_rows.sparkSession.sparkContext.broadcast(model)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, done = copy.copy(shared.value), 0.0
        own.weights, own.map = own.weights.copy(), own.map.copy()
        for b in (part for whole in rows for part in in_blocks(whole, 0, LEARNED_BLOCK)):
            t = Tokens(b.column(0))
            for _, symbols, contexts in t.first_events():
                done += own.learn(symbols, contexts, 0)
            n, said = np.bincount(t.codes, minlength=len(t.words) + 1).astype(np.float64), t.spelled
            for at in range(0, len(said), SLICE):
                of, symbols, contexts = inner_events(said[at : at + SLICE])
                done += own.learn(symbols, contexts, 1, n[at : at + SLICE][of])
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([done], pa.float64()), pa.array([own.weights.tobytes()], pa.binary()), pa.array([own.map.tobytes()], pa.binary())], ["n", "weights", "map"])

    def total(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, w, m = 0.0, np.zeros(GATES * CONTEXTS), np.zeros(GATES * MAP * 2)
        for b in rows:
            for k, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n, w, m = n + k, w + k * np.frombuffer(x), m + np.frombuffer(y)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.float64()), pa.array([w.tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], ["n", "weights", "map"])

    schema = "n double, weights binary, map binary"
    got = fold_rows.select("text").mapInArrow(batches, schema).repartition(BLOCKS).mapInArrow(total, schema).collect()
    if got:
        n = sum(r.n for r in got)
        model.weights = sum(np.frombuffer(r.weights) for r in got).reshape(GATES, CONTEXTS) / n
        model.map = sum(np.frombuffer(r.map) for r in got).reshape(GATES, MAP, 2).copy()
    shared.destroy()


def frequent(words: DataFrame, common: int) -> DataFrame:
    """The most frequent training words, at most ``common`` of them: those above a bound on a logarithmic scale of counts."""
    scale = F.floor(F.log2("n") * 16).cast("int")
    steps = words.where("n > 0").groupBy(scale.alias("step")).count().orderBy(F.desc("step")).collect()  # a thousand rows at most
    least, sum_ = None, 0
    for r in steps:
        sum_ += r["count"]
        if sum_ > common:
            break
        least = r.step
    return words.where("n > 0").where(scale >= least) if least is not None else words.where("false")


def score_documents(documents: DataFrame, bits: int = BITS, common: int = COMMON) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte)``, one row a document."""
    require(documents, "doc_id", "text")
    spark = documents.sparkSession
    rows = documents.select("doc_id", "text", fold().alias("fold"))
    training = rows.where("fold <> 0")
    words = kept(word_table(rows))
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    code = Code(symbol_counts(words))
    parts = bit_tables(training, words, code, bits)
    model = Model(code, *finished_tables(parts, "fit", bits), bits)
    refine(model, rows.where(F.col("fold") == MIXED_FOLD))
    model.stretched, model.levels = finished_tables(parts, "all", bits)
    whole = n + 0.1 * (v + 1)
    finished = spark.sparkContext.broadcast(model)

    def finish(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(rows, SLICE):
            said = listed(b.column(0))
            keys, rest = word_keys(said).view(np.int64), finished.value.rest(said)
            base = np.log10((b.column(1).to_numpy() + 0.1) / whole)
            yield pa.RecordBatch.from_arrays([pa.array(keys), b.column(1), pa.array(base), pa.array(rest)], ["key", "n", "base", "rest"])

    # every word is finished once; keys, not words, go on from here
    known = stored(words.select("word", "n").mapInArrow(finish, "key long, n long, base double, rest double"))
    often = frequent(known, common).select("key", "base", "rest").toArrow()  # at most `common` rows
    keys = often.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[order], *(often.column(x).to_numpy()[order] for x in ("base", "rest"))))
    kind = documents.select("doc_id").schema[0].dataType

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, (known_keys, base_of, rest_of) = finished.value, shared.value
        for b in (part for whole in rows for part in in_blocks(whole, 3, SMALL_BLOCK)):
            t = Tokens(b.column("text"))
            n_texts, text_of = len(t.n), t.text_of()
            score = np.zeros(n_texts)
            for own, symbols, contexts in t.first_events():
                score += np.bincount(text_of[own], model.scores(symbols, contexts, 0), n_texts)
            # each text's distinct words and how often it has them
            w = len(t.words) + 1
            pairs = np.sort(text_of * w + t.codes)
            new = np.flatnonzero(np.diff(pairs, prepend=-1))
            text, word, c = pairs[new] // w, pairs[new] % w, np.diff(new, append=len(pairs))
            at = np.minimum(np.searchsorted(known_keys, t.keys), max(0, len(known_keys) - 1))
            met = (known_keys[at] == t.keys if len(known_keys) else np.zeros(w, bool))[word]
            of, ct, place = text[met], c[met], at[word[met]]
            base = np.bincount(of, ct * base_of[place], n_texts)
            score += np.bincount(of, ct * rest_of[place], n_texts)
            rare = pa.StructArray.from_arrays([pa.array(t.keys.view(np.int64)[word[~met]]), pa.array(c[~met])], ["key", "c"])
            ends = np.concatenate([[0], np.cumsum(np.bincount(text[~met], minlength=n_texts))]).astype(np.int32)
            size = pc.fill_null(pc.binary_length(b.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("doc_id"), b.column("fold"), pa.array(t.n), pa.array(np.bincount(of, ct, n_texts).astype(np.int64)), pa.array(base),
                 pa.array(score), size, pa.ListArray.from_arrays(pa.array(ends), rare)],
                ["row", "doc_id", "fold", "n_tokens", "known", "base", "score", "size", "rare"],
            )

    schema = f"row long, doc_id {kind.simpleString()}, fold long, n_tokens long, known long, base double, score double, size long, rare array<struct<key:long,c:long>>"
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("fold").cast("long").alias("fold"), "text")
    scored = rows.mapInArrow(batches, schema)
    # a row of its own carries what a document has; a hash of the row spreads these over the join
    fixed = ["doc_id", "fold", "n_tokens", "known", "base", "score", "size"]
    own = F.array(F.struct(F.xxhash64("row").alias("key"), F.lit(None).cast("long").alias("c")))
    spread = scored.select("row", *fixed, F.explode(F.concat(own, "rare")).alias("r"))
    spread = spread.select("row", "r.key", "r.c", *[F.when(F.col("r.c").isNull(), F.col(x)).alias(x) for x in fixed])
    finished_words = known.select("key", "n", F.col("base").alias("word_base"), "rest")
    met = spread.join(finished_words, "key", "left")
    totals = {"rare": F.sum(F.col("c") * F.col("word_base")), "spelled": F.sum(F.col("c") * F.col("rest")), "rare_known": F.sum(F.when(F.col("n") > 0, F.col("c")))}
    out = met.groupBy("row").agg(*[F.max(x).alias(x) for x in fixed], *[F.coalesce(x, F.lit(0)).alias(name) for name, x in totals.items()])
    score = F.col("score") + F.col("spelled")
    return out.select(
        "doc_id",
        (F.col("fold") == 0).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.col("rare_known")).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("rare")).alias("base_score"),
        score.alias("score"),
        F.when(F.col("size") > 0, -score * F.lit(float(np.log2(10))) / F.col("size")).alias("bits_per_byte"),
    )


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
