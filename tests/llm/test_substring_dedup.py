"""Substring dedup against brute force over all windows."""

import random

import pytest

from convarchive.llm import substring_dedup as sd


def brute(docs, window):
    """What stays of each ``(doc_id, text)``, in the operator's order."""
    first, gone, split = {}, [], [(t or "").encode().split() for _, t in docs]
    for d, words in enumerate(split):
        gone.append(set())
        for i in range(len(words) - window + 1):
            if first.setdefault(tuple(words[i : i + window]), (d, i)) != (d, i):
                gone[d].update(range(i, i + window))
    return [(doc, len(w), len(g), b" ".join(x for i, x in enumerate(w) if i not in g).decode()) for (doc, _), w, g in zip(docs, split, gone, strict=True)]


def run(spark, docs, window, **more):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return [(r.doc_id, r.n_words, r.n_removed, r.text) for r in sd.dedup_substrings(df, window, **more).collect()]


def corpus(n, seed=3):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("ab cd ef gh ij kl mn op qr st".split()) + str(rnd.randrange(9))
    passages = [[word() for _ in range(rnd.randrange(6, 40))] for _ in range(6)]
    docs = []
    for k in range(n):
        words = []
        for _ in range(rnd.randrange(4)):
            words += [word() for _ in range(rnd.randrange(12))] + rnd.choice(passages)[rnd.randrange(4) :]
        docs.append((k, " \t".join(words)))
    return docs


@pytest.mark.parametrize("window,more", [(8, {}), (6, {"shard_words": 60}), (3, {"shard_words": 20}), (1, {})])
def test_brute_force(spark, window, more):
    docs = corpus(60) + [(100, None), (101, ""), (102, "x " * 50), (103, "x y " * 30), (104, "short text")]
    assert sorted(run(spark, docs, window, **more)) == sorted(brute(docs, window))


def test_hot_shards_are_cut_and_stay_exact(spark):
    rnd = random.Random(5)
    common = " ".join(f"c{i}" for i in range(9))
    docs = [(k, " ".join(f"w{rnd.randrange(10**6)}" for _ in range(4)) + " " + common + " " + " ".join(f"v{rnd.randrange(3)}" for _ in range(6))) for k in range(80)]
    assert sorted(run(spark, docs, 10, shard_words=50)) == sorted(brute(docs, 10))


def test_order_ties_and_nulls(spark):
    text = " ".join(f"w{i}" for i in range(30))
    got = run(spark, [(None, text), (7, text), (7, text), (3, text + " more")], 20)
    assert sorted((r[0] is None, r[0], r[2]) for r in got) == [(False, 3, 0), (False, 7, 30), (False, 7, 30), (True, None, 30)]
    same = run(spark, [(7, text), (7, text)], 20)
    assert sorted(r[2] for r in same) == [0, 30]


def test_empty_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sd.dedup_substrings(empty).collect() == []
    wide = spark.createDataFrame([(1, "a b", 5, 6, 7)], "doc_id long, text string, rank int, __row int, spans int")
    assert [r.text for r in sd.dedup_substrings(wide).collect()] == ["a b"]


def test_automaton():
    rnd = random.Random(1)
    for _ in range(40):
        lists = [[rnd.choice("abc") for _ in range(rnd.randrange(1, 25))] for _ in range(5)]
        automaton, ends = sd.SuffixAutomaton(), []
        for words in lists:
            longest = lambda i, among: max((n for n in range(i + 2) if n == 0 or tuple(words[i + 1 - n : i + 1]) in among), default=0)  # noqa: E731, B023
            known = {tuple(w[a:b]) for w in ends for a in range(len(w)) for b in range(a + 1, len(w) + 1)}
            assert automaton.statistics(words) == [longest(i, known) for i in range(len(words))]
            want = []
            for i in range(len(words)):
                own = {tuple(words[a:b]) for a in range(i) for b in range(a + 1, i + 1)}
                want.append(longest(i, known | own))
            assert automaton.add(words) == want
            ends.append(words)
