import random
import zlib

import numpy as np
import pyarrow as pa
from convarchive.llm import packing
from convarchive.llm.tokens import words_of
from tokenizers import Tokenizer


def check_layout(rows, sequence):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= sequence
    return len(by)


def test_ids_and_layout(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = [None, "", " \n", "It's   we'll O'Neil 12 x3", "<|endoftext|>a<|startoftext|>", "é ÀÉ ß ŸŽ İi̇ 日本語　x\x1cy\x85z", "µªº a b --- !!", "x" * 70_000]
    docs = docs.unionByName(spark.createDataFrame([(9000 + i, t) for i, t in enumerate(odd)], docs.schema))
    rows = packing.pack_documents(docs).collect()
    own = Tokenizer.from_file(packing.tokenizer_path())
    want = {}
    for r in docs.collect():
        ids = [*own.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[r.doc_id, k] = (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    n, least = check_layout(rows, 4096), sum(x[1] for x in want.values()) / 4096
    assert n <= 1.02 * least + 1


def test_cache_overflow_changes_nothing(monkeypatch):
    from convarchive.llm import tokens

    texts = [" ".join(f"wörd{chr(97 + i % 26)}{chr(97 + i // 26)}, don't" for i in range(400)), None, "", " a  B\t"]
    ids, starts = tokens.Words(packing.tokenizer_path()).ids(pa.array(texts))
    monkeypatch.setattr(tokens, "CACHE", 7)
    again = tokens.Words(packing.tokenizer_path()).ids(pa.array(texts))
    assert again[0].tolist() == ids.tolist() and again[1].tolist() == starts.tolist()
    own = words_of(packing.tokenizer_path()).tokenizer
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [own.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_tokenizer_of_other_steps():
    words = words_of(packing.tokenizer_path("byte_bpe_50k.json"))
    texts = ["A  b\n", "", None, "It's ÀÉ"]
    ids, starts = words.ids(pa.array(texts))
    assert not words.by_word
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [words.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_blocks_cover_every_row():
    from convarchive.llm import tokens

    batch = pa.RecordBatch.from_arrays([pa.array([*["x" * n for n in (3, 0, 50, 1, 1, 9)], None, "y" * 100])], ["t"])
    parts = list(tokens.in_blocks(batch, 0, block=10))
    assert [x for b in parts for x in b.column(0).to_pylist()] == batch.column(0).to_pylist() and len(parts) > 3


def test_sizes_of_all_kinds(spark):
    rnd = random.Random(5)
    for lengths in ([], [7], [4096] * 3, [2049] * 5, [1] * 3000, [rnd.randint(1, 4096) for _ in range(600)], [1365] * 200 + [3] * 50):
        pieces = spark.createDataFrame(list(enumerate(lengths)), "key long, length long")
        rows = packing.pack(pieces).join(pieces, "key").collect()
        assert len(rows) == len(lengths)
        n = check_layout(rows, 4096)
        assert n <= max(-(-sum(lengths) // 4096), sum(x > 2048 for x in lengths)) * 1.03 + 1 or lengths == [2049] * 5


def test_empty_repeated_and_clashing_columns(spark):
    schema = "doc_id long, text string, key string, size int, offset int"
    assert packing.pack_documents(spark.createDataFrame([], schema)).count() == 0
    rows = packing.pack_documents(spark.createDataFrame([(1, "a b", "k", 1, 2), (1, "a b", "k", 1, 2), (None, None, None, None, None)], schema)).collect()
    assert sorted(r.length for r in rows) == [1, 3, 3] and check_layout(rows, 4096) == 1
