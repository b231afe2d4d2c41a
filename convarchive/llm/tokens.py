"""Token ids of public tokenizers inside tasks, with bounded caches of words.

Where white space never joins two words (the file's own steps are looked at when it is loaded), a text's ids
are those of its words in order. Words of Latin letters with trailing punctuation then go to the model directly
after lower-casing (what the tokenizer's own steps do to them); any other word goes through the whole tokenizer.
With a tokenizer of other steps every text goes through it whole.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of each generation of the cache; two generations are held. Bounds the memory of a worker.
CACHE = 50_000
#: Bytes of text that are tokenized at once.
BLOCK = 6_000_000
SIMPLE = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"
#: The steps before the model that the short way stands for.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITS = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def divides_words(tokenizer) -> bool:
    """Whether the tokenizer lowers case and cuts at white space in the steps that ``Words`` stands for."""
    steps = json.loads(tokenizer.to_str())
    return (steps["normalizer"] or {}).get("normalizers") == NORMALIZERS and (steps["pre_tokenizer"] or {}).get("pretokenizers") == SPLITS


def ragged(codes: np.ndarray, starts: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``values[starts[c]:starts[c + 1]]`` of each code, one after the other, and where each begins (one more at the end)."""
    n = (starts[1:] - starts[:-1])[codes]
    ends = np.cumsum(n)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[:-1][codes] - (ends - n), n)
    return values[at], np.concatenate([[0], ends])


def cut_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The codes of all words in order, the distinct words, and where each text's words begin (one more at the end).

    Words are divided by U+0020 and U+0009 to U+000D; null is empty.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    coded = lists.flatten().dictionary_encode()
    codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    starts = lists.offsets.to_numpy().astype(np.int64)
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    if not real.all():
        stays = real[codes]
        starts = np.concatenate([[0], np.cumsum(stays)])[starts]
        codes = (np.cumsum(real) - 1)[codes[stays]]
        words = words.filter(pa.array(real))
    return codes, words, starts


class Words:
    """The ids of words, from the distinct ones of a batch and a cache of their parts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = divides_words(self.tokenizer)
        self.model = self.tokenizer.model
        self.pieces: dict[str, list[int]] = {}
        self.old: dict[str, list[int]] = {}
        self.letters = _byte_letters()

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def piece(self, text: str) -> list[int]:
        """The ids of lower-case letters or of punctuation, straight from the model."""
        ids = self.pieces.get(text)
        if ids is None:
            ids = self.old.get(text)
            if ids is None:
                seen = text if text.isascii() else text.encode().decode("latin-1").translate(self.letters)
                ids = array("I", [t.id for t in self.model.tokenize(seen)])
            if len(self.pieces) >= CACHE:
                self.old, self.pieces = self.pieces, {}
            self.pieces[text] = ids
        return ids

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of distinct words, and where each word's begin (one more at the end)."""
        parts = pc.extract_regex(words, SIMPLE)
        simple = pc.is_valid(parts).to_numpy(zero_copy_only=False)
        parts = parts.filter(pa.array(simple))
        stems = pc.utf8_lower(parts.field("letters")).dictionary_encode()
        marks = parts.field("marks").dictionary_encode()
        rest = words.filter(pa.array(~simple)).to_pylist()
        found = [*map(self.piece, stems.dictionary.to_pylist()), *(self.piece(x) if x else array("I") for x in marks.dictionary.to_pylist()), *map(self.whole, rest)]
        n_stems, n_marks = len(stems.dictionary), len(marks.dictionary)
        size = np.fromiter(map(len, found), np.int64, len(found))
        values = np.fromiter(chain.from_iterable(found), np.uint32, size.sum())
        # each word is two parts: letters and marks, or all of it and the part behind the last, which is empty
        two = np.full((len(words), 2), len(found))
        two[simple, 0] = stems.indices.to_numpy(zero_copy_only=False)
        two[simple, 1] = n_stems + marks.indices.to_numpy(zero_copy_only=False)
        two[~simple, 0] = n_stems + n_marks + np.arange(len(rest))
        ids, starts = ragged(two.ravel(), np.concatenate([[0], np.cumsum(size), [size.sum()]]), values)
        return ids, starts[::2]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts as unsigned 32-bit integers, and where each text's begin (one more at the end)."""
        if not self.by_word:
            found = [self.whole(t or "") for t in texts.to_pylist()]
            return np.fromiter(chain.from_iterable(found), np.uint32), np.cumsum([0, *map(len, found)])
        codes, words, starts = cut_words(texts)
        values, begins = self.of_words(words)
        ids, at = ragged(codes, begins, values)
        return ids, at[starts]


def in_blocks(batch: pa.RecordBatch, column: int, block: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in blocks of at most about ``block`` bytes of text, one row at least; Arrow's free memory is given back after each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + block, "right")))
        yield batch.slice(at, upto - at)
        pa.default_memory_pool().release_unused()
        at = upto


_LOADED: dict[str, Words] = {}


def words_of(path: str) -> Words:
    """One per worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = Words(path)
    return _LOADED[path]
