import random

from convarchive.llm import line_dedup as d


def fold(line):
    return tuple("".join(c.lower() if "A" <= c <= "Z" else c for c in line).encode().split())


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow(rows):
    """Texts by brute force; rows are (doc_id, text) in input order."""
    lines = [(i is not None, i or 0, r, k, fold(x)) for r, (i, t) in enumerate(rows) if t is not None for k, x in enumerate(t.split("\n"))]
    lines.sort(key=lambda x: x[:4])
    seen, gone = [], set()
    for x in lines:
        w = x[4]
        if len(w) < 3:
            continue
        if any(w == v or min(len(w), len(v)) >= 10 and within_one(w, v) for v in seen):
            gone.add((x[2], x[3]))
        if w not in seen:
            seen.append(w)
    return [t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (r, k) not in gone) for r, (_, t) in enumerate(rows)]


def run(spark, rows, **kw):
    docs = spark.createDataFrame([(i, t, n, "x") for n, (i, t) in enumerate(rows)], "doc_id long, text string, line int, id string").coalesce(1)
    return [r.text for r in d.dedup_lines(docs, **kw).orderBy("line").collect()]


def test_against_brute_force(spark):
    rnd = random.Random(1)
    base = [[rnd.choice("abcdefgh") for _ in range(rnd.choice([2, 3, 9, 10, 11, 12, 13, 30]))] for _ in range(30)]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(rnd.randint(0, 6)):
            w = list(rnd.choice(base))
            for _ in range(rnd.choice([0, 0, 1, 1, 2])):
                k = rnd.randrange(len(w))
                w[k : k + rnd.randint(0, 1)] = [rnd.choice("ABCDEFGHxyz")] * rnd.randint(0, 1)
            lines.append(rnd.choice(["", " "]) + "  ".join(w))
        rows.append((rnd.choice([i, i, 7, None]), rnd.choice(["\n".join(lines)] * 9 + [None])))
    assert run(spark, rows) == slow(rows)


def test_long_lines_and_ties(spark):
    long = [f"w{i}" for i in range(2000)]
    rows = [(1, " ".join(long)), (2, " ".join([*long[:700], "x", *long[701:]])), (3, " ".join(long[1:])), (4, " ".join(["x", *long, "y"])), (4, "\n\n"), (5, ""), (6, None), (6, "a b c"), (6, "a b c")]
    assert run(spark, rows) == slow(rows) == [rows[0][1], "", "", rows[3][1], "\n\n", "", None, "a b c", ""]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert d.dedup_lines(docs).count() == 0


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r.text for r in d.op7_line_dedup(spark, sf).collect()}
    assert [got[i] for i, _ in rows] == slow(rows)
