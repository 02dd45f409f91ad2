"""Byte-pair encoding with a segment tree over the ranks of adjacent pairs.

The leaves hold (rank, position) of the merge that each symbol makes with the one after it; the root is the leftmost
merge of lowest rank. Applying it changes three leaves, each in logarithmic time, until the root is empty. Words are
cut by the tokenizer file's own pattern and cached in bounded memory; whole texts are never cut at any length. A task
of ``encoded``, which other stages share workers with, empties the caches when it ends.

The vocabulary, the merges and the special tokens are read from a tokenizer file of the ``tokenizers`` library with
the layout of ``word_bpe_49k.json``: NFC, white space dropped, lower case, byte-level alphabet, a word-end suffix.
The strings of special tokens in a raw text become their ids, as the library has it.

Defined cases: a null text is an empty one; an empty text has no ids and decodes to an empty text; repeated rows give
repeated results; other columns are not read.
"""

from __future__ import annotations

import ctypes
import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries kept in each of the two generations of a worker's caches.
CACHE_WORDS = 150_000
#: Texts without a character of this kind are in NFC, and white space parts their words as ``str.split`` does.
_ODD = re.compile("[^\x00-\x1b\x20-\x7e\u00c0-\u024f]")
_NONE = 1 << 62


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class SegmentTree:
    """Minimum of integer keys with point updates."""

    def __init__(self, keys: list[int]):
        self.size = 1 << max(0, (len(keys) - 1).bit_length())
        self.node = node = [_NONE] * self.size + keys + [_NONE] * (self.size - len(keys))
        for k in range(self.size - 1, 0, -1):
            a, b = node[2 * k], node[2 * k + 1]
            node[k] = a if a < b else b

    def set(self, at: int, key: int) -> None:
        node = self.node
        k = at + self.size
        node[k] = key
        while k > 1:
            other = node[k ^ 1]
            if other < key:
                key = other
            k >>= 1
            if node[k] == key:
                break
            node[k] = key


class Cache(dict):
    """Two generations of words; the older goes when the newer is full."""

    def __init__(self, make, limit: int = CACHE_WORDS):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, word):
        got = self.old.get(word)
        if got is None:
            got = self.make(word)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        if len(word) <= 64:
            self[word] = got
        return got


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocab | self.special).items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a + b]))
        alphabet = byte_alphabet()
        self.inner = [self.vocab[c] for c in alphabet]
        self.final = [self.vocab[c + self.suffix] for c in alphabet]
        self.word = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.plain = re.compile(r"[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)|\d|(?:[^\s\w]|_)+")
        self.cache = Cache(self._word_written)
        self.chunks = Cache(self._chunk_written)

    def merge(self, symbols: list[int]) -> list[int]:
        """Ids after all merges."""
        n = len(symbols)
        if n < 2:
            return symbols
        ids, merges = symbols[:], self.merges
        bits = n.bit_length()
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        keys = [(m[0] << bits | k) if (m := merges.get((ids[k], ids[k + 1]))) else _NONE for k in range(n - 1)]
        tree = SegmentTree(keys)
        node, mask = tree.node, (1 << bits) - 1
        while (top := node[1]) != _NONE:
            at = top & mask
            gone = after[at]
            ids[at] = merges[ids[at], ids[gone]][1]
            ids[gone] = -1
            nxt = after[gone]
            after[at] = nxt
            if gone < n - 1:
                tree.set(gone, _NONE)
            if nxt < n:
                before[nxt] = at
                m = merges.get((ids[at], ids[nxt]))
                tree.set(at, m[0] << bits | at if m else _NONE)
            else:
                tree.set(at, _NONE)
            if (left := before[at]) >= 0:
                m = merges.get((ids[left], ids[at]))
                tree.set(left, m[0] << bits | left if m else _NONE)
        return [i for i in ids if i >= 0]

    def encode_word(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        symbols = [self.inner[b] for b in raw]
        symbols[-1] = self.final[raw[-1]]
        return self.merge(symbols)

    def forget(self) -> None:
        """Empty the caches, and give the system the memory that is free then."""
        for cache in (self.cache, self.chunks):
            cache.clear()
            cache.old = {}
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
            trim(0)

    def words(self, text: str) -> list[str]:
        """Words of a text without special tokens."""
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # lower case letter by letter: no final sigma
        return self.word.findall(text.lower())

    def _word_written(self, word: str) -> tuple[str, str]:
        ids = self.encode_word(word)
        return " ".join(map(str, ids)), " ".join([self.tokens[i] for i in ids])

    def _chunk_written(self, chunk: str) -> tuple[str, str]:
        """Of lower-case text without white space or odd characters."""
        cache, words = self.cache, self.plain.findall(chunk)
        if len(words) == 1:
            return cache[words[0]]
        parts = [cache[w] for w in words]
        return " ".join([p[0] for p in parts]), " ".join([p[1] for p in parts])

    def written(self, text: str) -> tuple[str, str]:
        """Decimal ids joined by spaces, and the decoded text."""
        parts = []
        pieces = self.cut.split(text) if self.cut else [text]
        for piece in pieces:
            if piece in self.special:
                parts.append((str(self.special[piece]), piece))
            elif _ODD.search(piece):
                cache = self.cache
                parts += [cache[w] for w in self.words(piece)]
            else:
                cache = self.chunks
                parts += [cache[c] for c in piece.lower().split()]
        return " ".join([p[0] for p in parts]), " ".join([p[1] for p in parts])

    def encode(self, text: str) -> list[int]:
        ids = self.written(text)[0]
        return [int(i) for i in ids.split(" ")] if ids else []

    def decode(self, ids: list[int]) -> str:
        """As the library without a decoder: tokens joined by spaces, unknown ids left out."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])


_loaded: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """The tokenizer at ``path``, read once in each process."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = loaded(path), hashlib.sha256
        for batch in batches:
            n, a, b = [], [], []
            for text in batch.column(1):
                ids, decoded = bpe.written(text.as_py() or "")
                n.append(ids.count(" ") + 1 if ids else 0)
                a.append(sha(ids.encode()).hexdigest())
                b.append(sha(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(of, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """All columns but those that are made here, then ids array<int> and decoded text."""
    keep = [c for c in docs.columns if c not in ("ids", "n_tokens", "decoded")]

    def one(bpe: Bpe, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, decoded = [np.zeros(0, np.int32)], []
        for text in batch.column(batch.num_columns - 1):
            s, d = bpe.written(text.as_py() or "")
            ids.append(np.fromstring(s, np.int32, sep=" ") if s else ids[0])
            decoded.append(d)
        n = np.array([len(x) for x in ids])  # the first belongs to no text
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(n), pa.int32()), pa.array(np.concatenate(ids)))
        columns = [batch.column(k) for k in range(len(keep))] + [pa.array(n[1:], pa.int64()), lists, pa.array(decoded, pa.string())]
        return pa.RecordBatch.from_arrays(columns, [*keep, "n_tokens", "ids", "decoded"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        try:
            for batch in batches:
                yield one(bpe, batch)
        finally:
            bpe.forget()  # the worker stays for other stages, and what it holds is the executor's memory

    source = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(of, f"{fields}, n_tokens long, ids array<int>, decoded string")
