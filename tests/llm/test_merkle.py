"""The Merkle manifest against a tree built by hand, with any number of leaves and sources."""

import hashlib
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from convarchive.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    said = [row[0], row[1], row[2], row[3], text]
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in said])


def tree(digests):
    """The root, and for each digest the pairs of what stands left and right of it, from below."""
    proofs, at, now = [[] for _ in digests], list(range(len(digests))), digests
    while len(now) > 1:
        for k, i in enumerate(at):
            run = now[i // 16 * 16 : i // 16 * 16 + 16]
            proofs[k].append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
        at, now = [i // 16 for i in at], [sha(*now[i : i + 16]) for i in range(0, len(now), 16)]
    return now[0], proofs


def brute(rows):
    key = lambda r: (r[1] is not None, (r[1] or "").encode())
    rows = sorted(rows, key=lambda r: (key(r), r[0] is None, r[0] or 0, leaf(r, r[4])))
    sources = [list(g) for _, g in groupby(rows, key=key)]
    trees = [tree([leaf(r, r[4]) for r in g]) for g in sources]
    root, upper = tree([t[0] for t in trees])
    out = []
    for g, (subroot, proofs), above in zip(sources, trees, upper, strict=True):
        for r, proof in zip(g, proofs, strict=True):
            own = proof + above
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            fold = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]) if tampered else r[4])
            for left, right in own:
                fold = sha(left, fold, right)
            out.append((str(r[0]), leaf(r, r[4]), subroot, root, sha(*[x + y for x, y in own]), fold, fold == root))
    return sorted(out)


def run(spark, tmp_path_factory, rows):
    folder = str(tmp_path_factory.mktemp("merkle"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(folder + "/documents.parquet")
    got = merkle.op12_merkle_manifest(spark, folder).collect()
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got)


@pytest.mark.parametrize("sizes", [[1], [1, 1, 1], [16, 17, 2], [300, 1, 16, 256, 257]])
def test_trees(spark, tmp_path_factory, sizes):
    rows = [(1000 * s + k, f"s{s}", "en", k, f"Text {k} É") for s, n in enumerate(sizes) for k in range(n)]
    got = run(spark, tmp_path_factory, rows)
    assert got == brute(rows)
    assert any(not r[6] for r in got) or len(rows) < 10


def test_nulls_ties_and_many_sources(spark, tmp_path_factory):
    rows = [(k, f"source {k}", None, None, None) for k in range(40)] + [(5, None, "de", 1, "A"), (5, "", "de", 1, "A"), (None, None, None, None, None)]
    rows += [(7, "x", "en", 3, "same")] * 20 + [(7, "x", "en", 3, "other")]
    assert run(spark, tmp_path_factory, rows) == brute(rows)


def test_empty_and_clashing_columns(spark):
    assert merkle.merkle_manifest(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(k, "s", "en", 1, f"t{k}") for k in range(40)]
    plain = spark.createDataFrame(rows, SCHEMA)
    wide = plain.withColumns({c: F.lit(1) for c in ("leaf", "root", "group", "at", "n", "node", "steps")})
    assert sorted(merkle.merkle_manifest(wide).collect()) == sorted(merkle.merkle_manifest(plain).collect())
