import xxhash
from convarchive.llm import simhash


def slow_fingerprint(text, size=3):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    if not w:
        return 0
    s = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))]
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps):
    ids = list(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    extra = [(9001, None), (9002, ""), (9003, " \n\t"), (9004, "One"), (9005, "one"), (9006, "One two"), (9007, "É é\x85 x y z " * 20000), (9008, "É é\x85 x y z " * 20001)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fps = {r.doc_id: slow_fingerprint(r.text) for r in docs.collect()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r.component_id for i, r in got.items()} == slow_components(fps)
    assert got[9003].component_id == got[9002].component_id == got[9001].component_id


def test_chains_and_full_balls(spark):
    base = 0x5555_0000_FFFF_1234
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    ball = [base, *(base ^ 1 << i for i in range(64))]
    chain = [0, 0b11, 0b1111, 0b111111]
    fps = {i: x for i, x in enumerate(dict.fromkeys(ball + chain))}
    links = simhash.ball_links(spark.createDataFrame([(signed(x),) for x in fps.values()], "fp long"))
    from convarchive.llm.components import connected_components

    got = {}
    for r in connected_components(links).collect():
        got.setdefault(r.component, set()).add(r.node)
    slow = {}
    for i, c in slow_components(fps).items():
        slow.setdefault(c, set()).add(signed(fps[i]))
    assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in slow.values() if len(x) > 1)


def test_empty_and_repeated_rows(spark):
    schema = "doc_id long, text string, fp string, component_id string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = spark.createDataFrame([(1, "a b c", "x", None), (1, "a b c", "x", None), (None, "a b c", None, None), (2, "d e f g", None, None)], schema)
    assert sorted(map(str, ((r.doc_id, r.component_id) for r in simhash.near_duplicates(rows).collect()))) == ["(1, 1)", "(1, 1)", "(2, 2)", "(None, 1)"]
