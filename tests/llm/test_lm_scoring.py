import math
import zlib
from collections import Counter

import numpy as np
from convarchive.llm import lm_scoring as lm


def fold(i):
    return 2 if i is None else zlib.crc32(str(i).encode()) % 10


def slow_base(rows):
    tokens = [[*lm.text_words(t), b" "] for _, t in rows]
    c = Counter(w for (i, _), ws in zip(rows, tokens, strict=True) if fold(i) for w in ws)
    n, v = c.total(), len(c)
    return n, [(len(ws), sum(c[w] > 0 for w in ws), sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for ws in tokens]


def test_base_and_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    extra = [(9001, None), (9002, ""), (9003, "One one ONE é\x85É"), (None, "the of"), (9004, "the of and " * 70_000), (9004, "the of and " * 70_000)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).coalesce(2)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for common in (3, 300_000):
        got = sorted(lm.score_documents(docs, bits=16, common=common).collect(), key=lambda r: (str(r.doc_id), r.score))
        n, want = slow_base(rows)
        want = [w for _, w in sorted(((str(i), w) for (i, _), w in zip(rows, want, strict=True)), key=lambda x: x[0])]
        assert {r.train_tokens for r in got} == {n}
        for r, (size, known, base) in zip(got, want, strict=True):
            assert (r.n_tokens, r.n_known) == (size, known) and math.isclose(r.base_score, base, rel_tol=1e-9)
            assert r.held_out == (fold(r.doc_id) == 0) and r.score < 0 and math.isfinite(r.score)
    same = [r.score for r in got if r.doc_id == 9004]
    assert same[0] == same[1]


def test_probabilities_of_all_symbols_sum_to_one():
    r = np.random.default_rng(0)
    code = lm.Code(r.integers(0, 1000, 257) ** 2)
    model = lm.Model(code, r.normal(0, 2, lm.n_slots(12)).astype(np.float16), r.integers(0, lm.LEVELS, lm.n_slots(12)).astype(np.uint8), 12)
    model.weights = r.normal(0.3, 0.2, model.weights.shape)
    model.map = r.integers(0, 50, model.map.shape).astype(float)
    contexts = {k: np.repeat(c, 257) for k, c in enumerate(r.integers(0, 1 << 62, (5, 3)).astype(np.uint64))}
    p = 10 ** model.scores(np.tile(np.arange(257), 3), contexts, 0)
    assert np.allclose(p.reshape(3, 257).sum(1), 1)


def test_learns(spark):
    words = "alpha beta gamma delta".split()
    rows = [(i, " ".join(words[(i + k) % 4] for k in range(30))) for i in range(400)] + [(1000, "zq xv kj")]
    out = {r.doc_id: r for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), bits=14).collect()}
    held = [r for r in out.values() if r.held_out]
    assert held and sum(r.score for r in held) > 0.5 * sum(r.base_score for r in held)  # the order of words is learned
    assert out[1000].bits_per_byte > 3 * held[0].bits_per_byte


def test_empty_table(spark):
    assert lm.score_documents(spark.createDataFrame([], "doc_id long, text string"), bits=10).count() == 0
    only = lm.score_documents(spark.createDataFrame([(11, None)], "doc_id long, text string"), bits=10).collect()
    assert len(only) == 1 and only[0].n_tokens == 1


def cells(counts):
    """All counts of a task, out of its blocks."""
    out = np.zeros((lm.BLOCKS, len(counts.table) // lm.BLOCKS), np.int64)
    for b in counts.batches():
        for i, small, place, large in zip(*(c.to_pylist() for c in b.columns), strict=True):
            out[i] = np.frombuffer(lm.pa.decompress(small, out.shape[1], "zstd"), np.uint8)
            assert (out[i][np.frombuffer(place, np.uint32)] == 255).all()
            out[i][np.frombuffer(place, np.uint32)] = np.frombuffer(large, np.uint32)
    return out.ravel()


def test_counts_beyond_16_bits_are_whole():
    r = np.random.default_rng(0)
    code, counts = lm.Code(r.integers(0, 1000, 257)), lm.Counts(lm.Code(np.ones(257)), 12)
    counts.code, want = code, np.zeros(len(counts.table), np.int64)
    assert counts.table.itemsize == 2
    for scale in (3, 20_000, 70_000, 10_000_000, 1, 16_384):
        pairs = (r.integers(0, 1 << 62, 40).astype(np.uint64) & ~lm.LOW)[r.integers(0, 40, 5_000)] | r.integers(0, 257, 5_000).astype(np.uint64)
        weights = r.integers(0, scale + 1, 5_000) // r.choice([1, 1000], 5_000)
        of, at = counts.cells(1, pairs)
        np.add.at(want, at, weights[of])
        counts.put(1, pairs, weights)
    counts.put(1, pairs[:0], weights[:0])
    assert want.max() > 1 << 25 and (cells(counts) == want).all()


def test_equal_beginnings_of_words_are_counted_and_scored_once(monkeypatch):
    words = [b"sharedbeginning" + bytes([97 + i % 26, 97 + i // 26]) for i in range(300)]
    r = np.random.default_rng(0)
    n, code = r.integers(1, 400, len(words)), lm.Code(r.integers(0, 1000, 257))
    of, symbols, contexts = lm.inner_events(words)
    want, counts, put = lm.Counts(code, 12), lm.Counts(code, 12), []
    for k, c in contexts.items():
        want.put(k, c | symbols.astype(np.uint64), n[of])
    real = lm.Counts.put
    monkeypatch.setattr(lm.Counts, "put", lambda self, k, pairs, weights: (put.append(len(pairs)), real(self, k, pairs, weights)))
    counts.put_inner(words, n)
    assert (cells(counts) == cells(want)).all() and sum(put) < len(symbols)
    model = lm.Model(code, r.normal(0, 2, lm.n_slots(12)).astype(np.float16), r.integers(0, lm.LEVELS, lm.n_slots(12)).astype(np.uint8), 12)
    alone, scored = np.bincount(of, model.scores(symbols, contexts, 1), len(words)), []
    scores = lm.Model.scores
    monkeypatch.setattr(lm.Model, "scores", lambda self, symbols, *x: (scored.append(len(symbols)), scores(self, symbols, *x))[1])
    assert np.allclose(model.rest(words), alone, rtol=1e-12) and sum(scored) < len(symbols) / 5


def test_first_symbols_are_counted_like_their_events():
    texts = lm.pa.array(["The the cat the cat", None, "", "the cat \x01 é the the cat sat", "x"] * 3)
    for t in (lm.Tokens(texts), lm.Tokens(texts.slice(1, 2)), lm.Tokens(texts.slice(0, 0))):
        code = lm.Code(np.arange(257))
        want, counts = lm.Counts(code, 12), lm.Counts(code, 12)
        for _, symbols, contexts in t.first_events():
            for k, c in contexts.items():
                want.put(k, c | symbols.astype(np.uint64), np.ones(len(c), np.int64))
        t.count_firsts(counts)
        assert (cells(counts) == cells(want)).all() and counts.table.any() == (len(t.n) > 0)
