"""Toxicity: a small convolutional text classifier over hashed word embeddings, trained on all labelled rows.

Words (runs of ASCII letters, digits and everything from U+0080 on, A-Z in lower case) hash into two
embedding tables whose rows are added, so two words share an embedding only if both hashes agree. Filters
of width 1, 2 and 3 slide over all words of a text, are max-pooled, and feed a logistic output. All different labelled texts
outside the held-out fold are dealt to shares, a task each. Embeddings start from the counts of all of them; in each of ``EPOCHS`` rounds
every share learns its texts in numpy from the same model, and the model moves by the mean of the shares' steps. Only the model, of fixed
size, passes the driver. A fifth of the labelled rows is held back to scale the score and to find
each language's threshold, at which F1 is best there; languages with few positive rows keep 0.5. The score
itself never sees lang, source, labels or doc_id.

Null and empty texts are scored as no words. Without any toxic label all scores are 0. Null labels are not
used; several labels of one document count as their maximum. Repeated rows are scored alike and count once in
training. Further columns are left alone; one called like an output is kept under its name and ``_input``.
"""

from __future__ import annotations

import copy
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convarchive.llm.common import give_back, kept, require, set_aside, table
from convarchive.llm.decontamination import doc_words
from convarchive.llm.tokens import in_blocks

#: Labelled texts that a task learns in an epoch, about, and words that it holds at once.
SHARE, BLOCK_WORDS = 6000, 4_000_000
EPOCHS = 6
FOLDS = 5
#: Steps of the score between which thresholds are looked for.
GRID = 1 << 14
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 8, 8, (1, 2, 3)
OUTPUTS = ("score", "predicted", "threshold", "flagged")
PAD = BUCKETS  # a row of zeros
#: Rows of all that is learned, and the blocks that embeddings are summed in.
END = 2 * (BUCKETS + 1) + (sum(WIDTHS) * DIM * FILTERS + FILTERS * len(WIDTHS)) // DIM + 1
BLOCKS = 16
FILTER_BITS = 1 << 25
SEGMENT = 50_000
#: Bytes of text that are scored at once.
SCORED = 1_000_000


def word_hashes(text: str | None) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, doc_words(text)), np.uint32)


def word_ids(text: str | None) -> np.ndarray:
    """``(words, 2)`` rows of the two tables."""
    return split(word_hashes(text))


def split(h: np.ndarray) -> np.ndarray:
    return np.stack([h & 0xFFFF, h >> 16], axis=1).astype(np.int32)


def flat(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All words in one array, two pads after each document, and where each starts."""
    pad = np.full((2, 2), PAD, np.int32)
    parts = [x for d in docs for x in ((d if len(d) else pad[:1]), pad)]
    starts = np.cumsum([0, *(max(1, len(d)) + 2 for d in docs)])[:-1]
    return np.concatenate(parts), starts


class Classifier:
    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        self.tables = r.normal(0, 0.05, (2, BUCKETS + 1, DIM)).astype(np.float32)
        self.tables[:, PAD] = 0
        self.filters = [r.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.out = np.full(FILTERS * len(WIDTHS), 0.3, np.float32)
        self.bias = np.float32(-1)
        self.scale, self.shift = 1.0, 0.0
        self.sums = [np.full_like(p, 1e-6) for p in self.parameters()]
        self.row_sums = np.full((2, BUCKETS + 1), 1e-6, np.float32)
        self.bias_sum = 1e-6

    def parameters(self) -> list[np.ndarray]:
        return [*self.filters, self.out]

    def matrix(self) -> np.ndarray:
        """All that is learned as rows of ``DIM`` numbers: embeddings, filters, output, bias."""
        last = np.zeros((1, DIM), np.float32)
        last[0, 0] = self.bias
        return np.concatenate([self.tables.reshape(-1, DIM), *(p.reshape(-1, DIM) for p in self.parameters()), last])

    def squares(self) -> np.ndarray:
        """The sums of squared gradients, laid out like ``matrix``."""
        last = np.full((1, DIM), self.bias_sum, np.float32)
        return np.concatenate([np.repeat(self.row_sums.reshape(-1, 1), DIM, 1), *(q.reshape(-1, DIM) for q in self.sums), last])

    def move(self, at: np.ndarray, step: np.ndarray, squares: np.ndarray) -> None:
        """Adds to the rows ``at`` of ``matrix`` and ``squares``."""
        m, q = self.matrix(), self.squares()
        m[at] += step
        q[at] += squares
        n = 2 * (BUCKETS + 1)
        self.tables, self.row_sums = m[:n].reshape(self.tables.shape).copy(), q[:n, 0].reshape(self.row_sums.shape).copy()
        for p, s in zip(self.parameters(), self.sums, strict=True):
            k = p.size // DIM
            p[...], s[...] = m[n : n + k].reshape(p.shape), q[n : n + k].reshape(p.shape)
            n += k
        self.bias, self.bias_sum = np.float32(m[n, 0]), float(q[n, 0])

    def convolved(self, x: np.ndarray) -> np.ndarray:
        n = len(x) - 2
        return np.concatenate([sum(x[j : j + n] @ f[j] for j in range(len(f))) for f in self.filters], axis=1)

    def pooled(self, docs: list[np.ndarray]) -> np.ndarray:
        ids, starts = flat(docs)
        y = self.convolved(self.tables[0][ids[:, 0]] + self.tables[1][ids[:, 1]])
        y[np.concatenate([starts[1:] - 2, starts[1:] - 1])] = 0  # windows that begin on a pad reach into the next text
        return np.maximum(np.maximum.reduceat(y, starts, axis=0), 0)

    def logits(self, docs: list[np.ndarray]) -> np.ndarray:
        """In blocks of some 100,000 words; a longer text is met in overlapping segments."""
        best = np.zeros((len(docs), len(self.out)), np.float32)
        todo, owner, words = [], [], 0

        def done() -> None:
            nonlocal todo, owner, words
            if todo:
                np.maximum.at(best, owner, self.pooled(todo))
            todo, owner, words = [], [], 0

        for i, d in enumerate(docs):
            for at in range(0, max(1, len(d) - 2), SEGMENT):
                todo.append(d[at : at + SEGMENT + 2])
                owner.append(i)
                words += len(todo[-1])
                if words > 100_000:
                    done()
        done()
        return best @ self.out + self.bias

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        z = self.logits(docs).astype(np.float64) * self.scale + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def start_from(self, seen: np.ndarray, toxic: int, clean: int) -> None:
        """The first coordinate of an embedding begins at its bucket's log odds, shrunk where it is rare: ``seen`` counts clean and toxic texts by table and bucket."""
        for k in (0, 1):
            odds = np.log((seen[1, k] + 0.5) / (toxic + 1)) - np.log((seen[0, k] + 0.5) / (clean + 1))
            n = seen[:, k].sum(0)
            self.tables[k, :, 0] = np.where(n > 1, odds * n / (n + 4), 0) / 2
            self.tables[k, PAD] = 0
        for f in self.filters:
            f[:, 0] = np.abs(f[:, 0]) + 0.5 / len(f)

    def tops(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text and filter the highest value, and the words of the window it stands at; a long text is met in overlapping segments."""
        top = np.full((len(docs), len(self.out)), -np.inf, np.float32)
        win = np.full((len(docs), len(self.out), len(WIDTHS), 2), PAD, np.int32)
        parts = [(i, d[at : at + SEGMENT + 2]) for i, d in enumerate(docs) for at in range(0, max(1, len(d) - 2), SEGMENT)]
        columns, reach = np.arange(len(self.out)), np.arange(len(WIDTHS))
        while parts:
            n = max(1, int(np.searchsorted(np.cumsum([len(d) for _, d in parts]), 2 * SEGMENT)))
            some, parts = parts[:n], parts[n:]
            ids, starts = flat([d for _, d in some])
            y = self.convolved(self.tables[0][ids[:, 0]] + self.tables[1][ids[:, 1]])
            for (i, _), a, b in zip(some, starts, [*starts[1:], len(ids)], strict=True):
                place = a + y[a : b - 2].argmax(0)
                new = y[place, columns] > top[i]
                top[i, new] = y[place, columns][new]
                win[i, new] = ids[place[:, None] + reach][new]
        return top, win

    def learn(self, docs: list[np.ndarray], toxic: np.ndarray, seed: list[int], batch: int = 64, rate: float = 0.05) -> None:
        """Once over the texts in an order drawn from ``seed``, by gradients scaled with the root of their summed squares."""
        order = np.random.default_rng(seed).permutation(len(docs))
        for start in range(0, len(order), batch):
            some = order[start : start + batch]
            top, win = self.tops([docs[i] for i in some])
            x = self.tables[0][win[..., 0]] + self.tables[1][win[..., 1]]
            f = np.maximum(top, 0)
            g = (1 / (1 + np.exp(-(f @ self.out + self.bias))) - toxic[some]) / len(some)
            df = g[:, None] * self.out * (top > 0)
            grads, dx = [], []
            for k, w in enumerate(self.filters):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                d = df[:, cols]
                grads.append(np.stack([np.einsum("bf,bfd->df", d, x[:, cols, j]) for j in range(len(w))]))
                dx += [(win[:, cols, j].reshape(-1, 2), (d[:, :, None] * w[j].T[None]).reshape(-1, DIM)) for j in range(len(w))]
            grads.append(f.T @ g)
            for p, s, q in zip(self.parameters(), self.sums, grads, strict=True):
                s += q * q
                p -= rate * q / np.sqrt(s)
            self.bias_sum += float(g.sum() ** 2)
            self.bias -= np.float32(rate * g.sum() / np.sqrt(self.bias_sum))
            ids, d = np.concatenate([a for a, _ in dx]), np.concatenate([b for _, b in dx])
            for k in (0, 1):
                own, inverse = np.unique(ids[:, k], return_inverse=True)
                q = np.zeros((len(own), DIM), np.float32)
                np.add.at(q, inverse, d)
                self.row_sums[k, own] += (q * q).mean(1)
                self.tables[k, own] -= 0.3 * rate * q / np.sqrt(self.row_sums[k, own])[:, None]
                self.tables[k, PAD] = 0

    def calibrate(self, z: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> None:
        """Platt scaling by Newton's method with step halving, with the usual smoothed targets: how many texts of a kind have a logit ``z``."""
        n1, n0 = toxic.sum(), clean.sum()
        if not n1 or not n0:
            return
        z, n = np.concatenate([z, z]), np.concatenate([clean, toxic]).astype(np.float64)
        t = np.repeat([1 / (n0 + 2), (n1 + 1) / (n1 + 2)], len(clean))
        x, w, start = np.stack([z, np.ones_like(z)], 1), np.array([1.0, 0.0]), np.array([1.0, 0.0])

        def loss(w: np.ndarray) -> float:
            y = x @ w
            return float((n * (np.logaddexp(0, y) - t * y)).sum() + 5e-4 * ((w - start) ** 2).sum())

        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
            h = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
            step = np.linalg.solve(h, x.T @ (n * (p - t)) + 1e-3 * (w - start))
            size = 1.0
            while loss(w - size * step) > loss(w) and size > 1e-6:
                size /= 2  # a whole step can overshoot where the classes lie apart
            w = w - size * step
            if abs(size * step).max() < 1e-8:
                break
        self.scale, self.shift = max(w[0], 1e-3), w[1]


def thresholds(scored: DataFrame, model: Classifier, least: int = 20) -> dict[str, float]:
    """Per language of ``scored(lang, toxic, z)`` the threshold of best F1, halfway to the next lower score; 0.5 with fewer than ``least`` positive rows.

    Thresholds are looked for between ``GRID`` steps of the score, with the counts of all rows.
    """
    y = F.least(F.greatest(F.col("z") * float(model.scale) + float(model.shift), F.lit(-40.0)), F.lit(40.0))
    s = scored.where("lang is not null").select("lang", "toxic", (1 / (1 + F.exp(-y))).alias("s"))
    # at most GRID + 1 rows a language
    steps = s.groupBy("lang", F.floor(F.col("s") * GRID).alias("step")).agg(F.count("*").alias("n"), F.sum("toxic").alias("hits"), F.min("s").alias("low"), F.max("s").alias("high"))
    down = Window.partitionBy("lang").orderBy(F.desc("step"))
    every = Window.partitionBy("lang")
    steps = steps.select(
        "lang", "step", F.sum("n").over(every).alias("all"), F.sum("hits").over(every).alias("positive"),
        (2 * F.sum("hits").over(down) / (F.sum("n").over(down) + F.sum("hits").over(every))).alias("f1"),
        ((F.col("low") + F.coalesce(F.lead("high").over(down), F.lit(0.0))) / 2).alias("cut"),
    )
    best = steps.where(f"positive >= {least} and positive < all").groupBy("lang").agg(F.max(F.struct("f1", "step", "cut")).alias("b"))
    return {r.lang: r.cut for r in best.select("lang", "b.cut").collect()}  # a row a language


def fold(folds: int = FOLDS):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))


def labelled_sample(documents: DataFrame, labels: DataFrame, sample: int, sample_words: int) -> pd.DataFrame:
    """A sample to look at on one machine (training takes all rows): ``doc_id, lang, toxic, ids`` of at most ``sample`` different labelled rows outside the held-out fold, of ``sample_words`` words in all."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(fold() != 0)
    n = marks.count()
    # twice as many as wanted, as some may have no text or a long one
    part = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(1e6 * min(1.0, 2 * sample / max(n, 1)))))
    lang = F.col("lang") if "lang" in documents.columns else F.lit(None).cast("string")
    rows = documents.select("doc_id", lang.alias("lang"), "text").join(part, "doc_id")
    order = F.struct(F.xxhash64("doc_id").alias("a"), F.xxhash64("text").alias("b"))
    spoken = F.length(F.coalesce("text", F.lit(""))) - F.length(F.replace(F.coalesce("text", F.lit("")), F.lit(" "))) + 1
    rows = rows.where(spoken <= sample_words // 20)
    sizes = rows.groupBy(order.alias("place")).agg(F.max(spoken).alias("n")).orderBy("place").limit(sample).collect()
    most, last = 0, None
    for r in sizes:
        most += r.n
        if most > sample_words:
            break
        last = r.place
    if last is None:
        return pd.DataFrame({"doc_id": [], "lang": [], "toxic": [], "ids": []})
    upto = F.struct(F.lit(last.a).alias("a"), F.lit(last.b).alias("b"))
    rows = rows.where(order <= upto).groupBy(order.alias("place")).agg(*[F.first(c, ignorenulls=False).alias(c) for c in ("doc_id", "text", "toxic")], F.min("lang").alias("lang"))

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            ids = pa.array([word_ids(t).tobytes() for t in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), b.column("toxic"), ids], ["doc_id", "lang", "toxic", "ids"])

    kind = dict(rows.dtypes)
    got = rows.select("doc_id", "lang", "text", "toxic").mapInArrow(batches, f"doc_id {kind['doc_id']}, lang string, toxic {kind['toxic']}, ids binary").toPandas()
    return got.sort_values(["doc_id", "ids"], kind="stable")


def labelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``(back, toxic, lang, ids)`` of all different labelled rows outside the held-out fold, dealt to shares; ``back`` marks those that are held back from training."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).where(fold() != 0)
    shares = max(1, -(-marks.count() // SHARE))
    # a bit table of fixed size lets through all labelled rows and few others, so that no text is shuffled
    bit = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(FILTER_BITS))
    words = marks.select(bit.alias("k")).groupBy(F.expr("k div 64").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(k % 64 as int)))").alias("bits"))
    lang = F.col("lang") if "lang" in documents.columns else F.lit(None).cast("string")
    rows = documents.select("doc_id", F.xxhash64("text").alias("digest"), lang.alias("lang"), "text", bit.alias("k")).join(F.broadcast(words), F.expr("k div 64 = at"))
    rows = rows.where("getbit(bits, cast(k % 64 as int)) = 1").select("doc_id", "digest", "lang", "text")
    kind = dict(rows.dtypes)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in rows for part in in_blocks(whole, 3, SCORED)):
            ids = pa.array([word_hashes(t).tobytes() for t in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], ids], ["doc_id", "digest", "lang", "ids"])

    found = rows.mapInArrow(batches, f"doc_id {kind['doc_id']}, digest long, lang string, ids binary")
    met = found.repartition(shares, "doc_id").join(marks, "doc_id")
    once = met.groupBy("doc_id", "digest").agg(F.first("toxic").alias("toxic"), F.min("lang").alias("lang"), F.first("ids").alias("ids"))
    back = F.pmod(F.crc32(F.concat(F.lit("back "), F.col("doc_id").cast("string"))), F.lit(5)) == 0
    return kept(once.select(back.alias("back"), "toxic", "lang", "ids"))


def blocks(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Texts and marks of ``(toxic, ids)`` in blocks of ``BLOCK_WORDS``, so that a share of any size fits."""
    docs, toxic, words = [], [], 0
    for b in rows:
        for t, x in zip(b.column("toxic").to_pylist(), b.column("ids").to_pylist(), strict=True):
            docs.append(np.frombuffer(x, np.uint32))
            toxic.append(t)
            words += len(docs[-1])
            if words > BLOCK_WORDS:
                yield [split(d) for d in docs], np.array(toxic, np.float32)
                docs, toxic, words = [], [], 0
    if docs:
        yield [split(d) for d in docs], np.array(toxic, np.float32)


def bucket_counts(rows: DataFrame) -> np.ndarray:
    """How many clean and toxic texts have a word of each bucket, by table."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 2, BUCKETS + 1), np.int64)
        for docs, toxic in blocks(rows):
            for d, t in zip(docs, toxic, strict=True):
                for k in (0, 1):
                    seen[int(t), k, np.unique(d[:, k])] += 1
        flat = seen.reshape(2, -1)
        at = np.flatnonzero(flat.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(flat[0, at]), pa.array(flat[1, at])], ["at", "clean", "toxic"])

    got = rows.mapInArrow(batches, "at int, clean long, toxic long").groupBy("at").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()  # a row a bucket
    seen = np.zeros((2, 2 * (BUCKETS + 1)), np.int64)
    for k, name in enumerate(("clean", "toxic")):
        seen[k, got.column("at").to_numpy()] = got.column(name).to_numpy()
    return seen.reshape(2, 2, -1)


def epoch(model: Classifier, rows: DataFrame, number: int) -> None:
    """Every share learns its texts from the same model; a row of its matrix moves by the mean of the shares that moved it, by their texts."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # of fixed size
    size = 2 * (BUCKETS + 1) // BLOCKS  # the last block has filters, output and bias

    def batch(block: int, n: float, at: np.ndarray, steps: np.ndarray, squares: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([n]), *(pa.array([x.tobytes()], pa.binary()) for x in (at, steps, squares))], ["block", "n", "at", "steps", "squares"])

    def learned(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = copy.deepcopy(shared.value), 0
        m, q = own.matrix(), own.squares()
        for docs, toxic in blocks(rows):
            own.learn(docs, toxic, [1, number, n])
            n += len(docs)
        m, q = (own.matrix() - m).astype(np.float32), (own.squares() - q).astype(np.float32)
        at = np.flatnonzero(m.any(1) | q.any(1)).astype(np.uint32)
        block = np.minimum(at // size, BLOCKS)
        for k in np.unique(block):
            here = at[block == k]
            yield batch(k, float(n), here, m[here], q[here] if k == BLOCKS else q[here, :1])

    def mean(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in rows:
            for k, n, *data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at, steps, squares = np.frombuffer(data[0], np.uint32), *(np.frombuffer(x, np.float32) for x in data[1:])
                both = np.concatenate([steps.reshape(len(at), -1), squares.reshape(len(at), -1), np.ones((len(at), 1))], 1)
                own = sums.setdefault(k, np.zeros((size if k < BLOCKS else END - BLOCKS * size, both.shape[1])))
                own[at - k * size] += n * both
        for k, own in sums.items():
            at = np.flatnonzero(own[:, -1])
            own = (own[at, :-1] / own[at, -1:]).astype(np.float32)
            yield batch(k, 1.0, (at + k * size).astype(np.uint32), own[:, :DIM], own[:, DIM:])

    schema = "block int, n double, at binary, steps binary, squares binary"
    moved = rows.mapInArrow(learned, schema).repartition(BLOCKS, "block").mapInArrow(mean, schema)
    for r in moved.collect():  # at most a row of numbers for each of the matrix
        at, steps, squares = np.frombuffer(r.at, np.uint32), np.frombuffer(r.steps, np.float32), np.frombuffer(r.squares, np.float32)
        model.move(at, steps.reshape(len(at), -1), squares.reshape(len(at), -1))
    shared.destroy()


def logits(model: Classifier, rows: DataFrame) -> DataFrame:
    """``(lang, toxic, z)`` of all ``rows``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            z = np.concatenate([shared.value.logits(docs) for docs, _ in blocks([b])]) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("toxic"), pa.array(z.astype(np.float64))], ["lang", "toxic", "z"])

    return kept(rows.select("lang", "toxic", "ids").mapInArrow(batches, "lang string, toxic int, z double"))


def train(documents: DataFrame, labels: DataFrame) -> tuple[Classifier | None, dict[str, float]]:
    rows = labelled(documents, labels)
    n = {(r.back, r.toxic): r.n for r in rows.groupBy("back", "toxic").agg(F.count("*").alias("n")).collect()}  # four rows
    count = lambda toxic, *back: sum(n.get((b, toxic), 0) for b in back)
    if not count(1, True, False):
        return None, {}
    fitted, check = rows.where("not back"), rows.where("back")
    sides = (False,)
    if not count(1, True) or count(1, False) < 2:
        fitted, check, sides = rows, rows, (True, False)
    fitted = fitted.select("toxic", "ids")
    model = Classifier()
    model.start_from(bucket_counts(fitted), count(1, *sides), count(0, *sides))
    for number in range(EPOCHS):
        epoch(model, fitted, number)
    scored = logits(model, check)
    # logits in steps of 1/1024, each with its rows' mean
    step = F.round(F.least(F.greatest(F.col("z"), F.lit(-64.0)), F.lit(64.0)) * 1024)
    bins = scored.groupBy(step.alias("step")).agg(F.avg("z").alias("z"), F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("toxic")).orderBy("step").toArrow()
    model.calibrate(*(bins.column(c).to_numpy() for c in ("z", "clean", "toxic")))
    return model, thresholds(scored, model)


def score_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``documents`` with ``score``, ``predicted`` (score at least 0.5), ``threshold`` of its language and ``flagged``."""
    require(documents, "doc_id", "text")
    require(labels, "doc_id", "toxic")
    model, cuts = train(documents, labels)
    give_back()
    shared = documents.sparkSession.sparkContext.broadcast(model)  # two tables of fixed size

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            out = np.zeros(len(t))
            batch = pa.RecordBatch.from_arrays([t], ["text"])
            at = 0
            for part in in_blocks(batch, 0, SCORED):
                if shared.value:
                    out[at : at + part.num_rows] = shared.value.scores([word_ids(x) for x in part.column(0).to_pylist()])
                at += part.num_rows
            yield pa.array(out)

    cut = F.lit(0.5)
    if cuts and "lang" in documents.columns:
        known = F.create_map(*[x for k, v in sorted(cuts.items()) for x in (F.lit(k), F.lit(v))])
        cut = F.coalesce(known[F.coalesce(F.col("lang"), F.lit(""))], cut)
    documents = set_aside(documents, *OUTPUTS)
    out = documents.withColumn("score", score("text")).withColumn("threshold", cut)
    return out.withColumns({"predicted": (F.col("score") >= 0.5).cast("int"), "flagged": F.col("score") >= F.col("threshold")})


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", "predicted", "threshold", "flagged")
