"""A content-addressed store of token-id streams.

A text is encoded and its end id appended; rolling hashes over 16 ids cut the stream into chunks, so that equal
passages give equal chunks wherever they stand. A chunk's address is a 128-bit BLAKE2b of its bytes.

The store is a folder of three Parquet tables:

* ``pool``: rows of two kinds, dealt out and sorted by address. ``chunk``: address and data (ids as little-endian
  unsigned 16-bit integers where they fit, else 32-bit), each address once. ``recipe``: one for each document with its
  doc_id, n_tokens, the addresses and lengths of its chunks in order, and the Merkle root over the addresses.
* ``index``: doc_id, n_tokens, start (the ids of all documents before it) and root in ascending doc_id order, with the
  part of the order that a row is in and its place there.
* ``manifest``: for each part the numbers of documents and ids, and the Merkle root over a leaf for every document in
  order, made of its doc_id, n_tokens, start and root; and a row (part null) with the totals and the root over the parts.

Reading first recomputes the manifest from the index. Then it joins recipes to what is computed from the chunk bytes;
only addresses, lengths and checksums are moved, not ids. Each address is recomputed from the bytes, the root from the
addresses, and both must agree with the index. Recipes are joined by their root, which names their content, so copies
are rebuilt once. What doesn't agree, or is lost, is an error, or ``verified`` = false where ``strict`` isn't asked for.

Defined cases: a null text is an empty one, whose stream is the end id alone; rows that repeat a doc_id are stored as
documents of their own, in the order of their roots; a null doc_id comes first; an empty table gives an empty store.
Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm import text as tx
from kinloom.llm.bpe import Cache, byte_alphabet
from kinloom.llm.store import drop_staged, new_path, staged

END_ID = 2
LEAST, MEAN, MOST = 32, 128, 1024
#: Entries in each of two generations of a worker's cache of words, and in its table of chunks.
CACHE_WORDS, CACHE_CHUNKS = 20_000, 1 << 20
#: Addresses of chunks that a task remembers to have sent; others it may send again, which only costs time.
MOST_SEEN = 500_000
WINDOW = 16
_GEAR = np.random.default_rng(4801).integers(0, 1 << 32, 1 << 16, dtype=np.uint32)
#: White space other than space and line feed. Without it, and without white space next to white space or at the end,
#: each space belongs to the word after it and each line feed stands for itself.
_OTHER_SPACE = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Characters of text that are encoded together.
TOGETHER = 1 << 21


#: Random values of bytes for two independent hashes of a chunk.
_VALUES = np.random.default_rng(77).integers(1, 1 << 63, (2, 256), dtype=np.uint64) | np.uint64(1)


def _chunk_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of hash for each run of bytes."""
    up, down = tx.power_tables(len(raw) + 1)
    out = []
    for values in _VALUES:
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(values[raw] * up[: len(raw)], out=sums[1:])
        out.append(tx.mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
    return out[0], out[1]


class _Table:
    """Ids by the hash of what they encode: arrays with open addressing, emptied when ``limit`` entries are held."""

    def __init__(self, limit: int):
        self.limit = limit
        self.bits = (2 * limit - 1).bit_length()
        self.clear()

    def clear(self) -> None:
        self.one, self.two = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint64)
        self.entry = np.full(1 << self.bits, -1, np.int32)
        self.n = self.n_ids = 0
        self.first, self.size, self.ids = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, "<u4")

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Entries, -1 where there is none."""
        out = np.full(len(one), -1, np.int32)
        left, slot = np.arange(len(one)), (one >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            entry = self.entry[slot]
            same = (self.one[slot] == one[left]) & (self.two[slot] == two[left]) & (entry >= 0)
            out[left[same]] = entry[same]
            go = ~same & (entry >= 0)
            left, slot = left[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, one: np.ndarray, two: np.ndarray, values: list[bytes]) -> None:
        """Entries for different hashes that have none."""
        k, size = len(values), np.array([len(v) for v in values], np.int64) // 4
        while self.n + k > len(self.first):
            self.first, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size))
        while self.n_ids + int(size.sum()) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        new = np.arange(self.n, self.n + k)
        self.size[new] = size
        self.first[new] = self.n_ids + np.cumsum(size) - size
        self.ids[self.n_ids : self.n_ids + int(size.sum())] = np.frombuffer(b"".join(values), "<u4")
        self.n, self.n_ids = self.n + k, self.n_ids + int(size.sum())
        left, slot = np.arange(k), (one >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            free = self.entry[slot] < 0
            at, which = np.unique(slot[free], return_index=True)
            own = left[free][which]
            self.one[at], self.two[at], self.entry[at] = one[own], two[own], new[own]
            go = np.ones(len(left), bool)
            go[np.flatnonzero(free)[which]] = False
            left, slot = left[go], (slot[go] + 1) & ((1 << self.bits) - 1)

    def joined(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all entries laid end to end, and where each ends."""
        n = self.size[entries]
        ends = np.cumsum(n)
        return self.ids[np.repeat(self.first[entries] - ends + n, n) + np.arange(ends[-1])], ends


class Encoder:
    """The byte-level tokenizer of the ``tokenizers`` library, with its results by word kept in bounded memory."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.tokenize = self.whole.model.tokenize
        self.alphabet = byte_alphabet()
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.bytes_as = {b: c for b, c in enumerate(self.alphabet)}
        self.words = Cache(self._word, CACHE_WORDS)
        self.feed = self._word("\n")
        self.table = _Table(CACHE_CHUNKS)

    def _word(self, word: str) -> bytes:
        letters = word.encode().decode("latin-1").translate(self.bytes_as)
        return array("I", [t.id for t in self.tokenize(letters)]).tobytes()

    def _text(self, text: str) -> bytes:
        words = self.words
        return b"".join([words[w] for w in self.pattern.findall(text)])

    def _plain(self, text: str) -> bool:
        """White space parts the words of the text one by one, and no special token is in it."""
        if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[-1:] in (" ", "\n"):
            return False
        return not (_OTHER_SPACE.search(text) or any(s in text for s in self.special))

    def _single(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")
        return np.frombuffer(self._text(text), "<u4")

    def _chunk(self, chunk: str) -> bytes:
        """Of what stands between two spaces, with the one before it; or of a line feed and what follows it up to the next
        space; or, after a tab, which no chunk holds, of a mark that ends a word."""
        if chunk.isalpha():
            if chunk.isascii():
                return array("I", [t.id for t in self.tokenize("\u0120" + chunk)]).tobytes()
            return self._word(" " + chunk)
        if chunk[0] == "\n":
            return self.feed + (self._word(chunk[1:]) if chunk[1:].isalpha() else self._text(chunk[1:]))
        return self.words[chunk[1:]] if chunk[0] == "\t" else self._text(" " + chunk)

    def _together(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Of plain texts: each is put behind a line feed, whose id then makes room for the end of the text before."""
        raw = np.frombuffer("".join([" \n" + t.replace("\n", " \n") for t in texts]).encode(), np.uint8)
        starts = np.flatnonzero(raw == 0x20) + 1
        ends = np.append(starts[1:] - 1, len(raw))
        last = np.cumsum([t.count(" ") + t.count("\n") + 1 for t in texts]) - 1
        before, mark = raw[np.maximum(ends - 2, 0)] | 0x20, raw[ends - 1]
        marked = (ends - starts > 1) & (before >= 0x61) & (before <= 0x7A) & ((mark == 0x2C) | (mark == 0x2E))
        ends = ends - marked  # a comma or full stop right after a letter is a word of its own
        one, two = _chunk_hashes(raw, starts, ends)
        table = self.table
        if table.n > table.limit - len(starts) - 2:
            table.clear()
        if not table.n:
            table.add(np.array([1, 2], np.uint64), np.array([1, 2], np.uint64), [self._chunk("\t,"), self._chunk("\t.")])
        entry = table.find(one, two)
        lost = np.flatnonzero(entry < 0)
        if len(lost):
            _, which, inverse = np.unique(one[lost], return_index=True, return_inverse=True)
            own = lost[which]
            whole = raw.tobytes()
            at = table.n
            table.add(one[own], two[own], [self._chunk(whole[i:j].decode()) for i, j in zip(starts[own].tolist(), ends[own].tolist(), strict=True)])
            entry[lost] = at + inverse
        place = np.arange(len(entry)) + np.cumsum(marked) - marked
        every = np.zeros(len(entry) + int(marked.sum()), np.int64)
        every[place] = entry
        every[place[marked] + 1] = (mark[marked] == 0x2E).astype(np.int64)
        ids, done = table.joined(every)
        ends = done[place[last] + marked[last]]
        out = np.append(ids[1:], np.uint32(end_id)).astype("<u4", copy=False)
        out[ends - 1] = end_id
        return out, ends

    def encode_all(self, texts: list[str], end_id: int = END_ID) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Numbers of some of the texts, their ids laid end to end, each with the end id, and where each ends."""
        plain, odd, size = [], [], 0
        for k, text in enumerate(texts):
            if len(text) > TOGETHER or not self._plain(text):  # so a batch has fewer chunks than the table places
                odd.append(k)
                continue
            plain.append(k)
            size += len(text)
            if size > TOGETHER:
                yield plain, *self._together([texts[k] for k in plain], end_id)
                plain, size = [], 0
        if plain:
            yield plain, *self._together([texts[k] for k in plain], end_id)
        for k in odd:
            ids = np.append(self._single(texts[k]), np.uint32(end_id)).astype("<u4", copy=False)
            yield [k], ids, np.array([len(ids)])

    def encode(self, text: str) -> list[int]:
        """The ids of one text, without an end id."""
        return next(self.encode_all([text]))[1][:-1].tolist()


_loaded: dict[str, Encoder] = {}


def loaded(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def marks(ids: np.ndarray, mean: int = MEAN) -> np.ndarray:
    """Positions after which the hash of the last WINDOW ids ends in zeros."""
    n = len(ids)
    value = np.zeros(max(0, n - WINDOW + 1), np.uint32)
    gear = _GEAR[ids & 0xFFFF]
    for k in range(WINDOW):
        value += gear[k : k + len(value)] << np.uint32(WINDOW - 1 - k)
    return np.flatnonzero((value >> np.uint32(WINDOW - 1)) & np.uint32(mean - 1) == 0) + WINDOW


def cut_points(n: int, at: list[int], least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of a stream of ``n`` ids with marks ``at``: marks at least ``least`` ids after the last end, and
    an end after ``most`` ids without one. As ``least`` isn't less than the window, marks of a window that began before
    the stream don't count."""
    out, last = [], 0
    for m in at:
        while m - last > most:
            last += most
            out.append(last)
        if m - last >= least:
            last = m
            out.append(last)
    while n - last > most:
        last += most
        out.append(last)
    if last < n:
        out.append(n)
    return out


def address(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of the binary hash tree; an odd node moves up as it is."""
    level = leaves or [b""]
    while len(level) > 1:
        level = [address(level[k] + level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return address(len(leaves).to_bytes(8, "little") + level[0])


def unpack(data: bytes) -> np.ndarray:
    """The ids of a chunk; none of bytes that aren't one."""
    wide = 2 if data[:1] == b"\2" else 4
    whole = len(data) > 1 and len(data) % wide == 1
    return np.frombuffer(data, f"<u{wide}", offset=1).astype("<u4") if whole else np.zeros(0, "<u4")


_POOL = "kind string, address binary, doc_id long, n_tokens long, addresses binary, lengths binary, root binary, data binary"
_TYPES = [pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def _chunked(doc_ids: list, ids: np.ndarray, ends: np.ndarray, seen: set) -> pa.RecordBatch:
    """Rows of the pool for some documents' ids; chunks that the task has sent already (in ``seen``) aren't sent again."""
    at = marks(ids)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    first, last = np.searchsorted(at, starts, "right").tolist(), np.searchsorted(at, ends, "right").tolist()
    at = at.tolist()
    narrow = bool(ids.max() < 1 << 16)
    data = ids.astype("<u2").tobytes() if narrow else ids.tobytes()
    head, wide = (b"\2", 2) if narrow else (b"\4", 4)
    keys, chunks, recipes = [], [], []
    for k, (doc_id, start, end) in enumerate(zip(doc_ids, starts.tolist(), ends.tolist(), strict=True)):
        cuts = cut_points(end - start, at=[x - start for x in at[first[k] : last[k]]])
        leaves, begin = [], 0
        for stop in cuts:
            chunk = head + data[wide * (start + begin) : wide * (start + stop)]
            begin = stop
            key = address(chunk)
            leaves.append(key)
            if key not in seen:
                if len(seen) < MOST_SEEN:
                    seen.add(key)
                keys.append(key)
                chunks.append(chunk)
        root = merkle_root(leaves)
        recipes.append((address(repr(doc_id).encode() + root), doc_id, end - start, b"".join(leaves), array("I", map(int.__sub__, cuts, [0, *cuts])).tobytes(), root))
    n, m = len(keys), len(recipes)
    own = [list(c) for c in zip(*recipes, strict=True)] if m else [[]] * 6
    columns = [["chunk"] * n + ["recipe"] * m, keys + own[0], *([None] * n + c for c in own[1:]), chunks + [None] * m]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], [f.split(" ")[0] for f in _POOL.split(", ")])


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Write the store of all texts to the folder ``path``."""
    spark = docs.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = loaded(tokenizer), set()
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for own, ids, ends in encoder.encode_all(texts, end_id):
                yield _chunked([doc_ids[k] for k in own], ids, ends, seen)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(1)
            first = pa.array([last is None or key[0].as_py() != last])
            keep = pa.concat_arrays([first, pc.not_equal(key.slice(1), key.slice(0, len(key) - 1))])
            recipe = pc.equal(batch.column(0), "recipe")
            if not recipe[-1].as_py():
                last = key[-1].as_py()
            yield batch.filter(pc.or_(keep, recipe))

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pool = source.mapInArrow(encode, _POOL).repartition("address").sortWithinPartitions("address")
    pool.mapInArrow(once, _POOL).write.option("compression", "zstd").parquet(f"{path}/pool")
    _write_index(spark, path)


_INDEX = "doc_id long, n_tokens long, root binary, part long, place long, before long"


def _leaf(doc_id: int | None, n_tokens: int, start: int, root: bytes) -> bytes:
    """What the manifest covers of one document; ``start`` counts from the first document of the part."""
    return address(repr((doc_id, n_tokens, start)).encode() + root)


def _part_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of index rows by part and place: part, docs, ids, and the Merkle root over the leaves; gaps give no root."""
    now, leaves, ids, whole = None, [], 0, True

    def row() -> pa.RecordBatch:
        root = merkle_root(leaves) if whole else b""
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([len(leaves)], pa.int64()), pa.array([ids], pa.int64()), pa.array([root], pa.binary())], ["part", "docs", "ids", "root"])

    for batch in batches:
        for doc_id, n, root, part, place, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part != now:
                if now is not None:
                    yield row()
                now, leaves, ids, whole = part, [], 0, True
            whole = whole and place == len(leaves) and before == ids and root is not None
            leaves.append(_leaf(doc_id, n, before, root or b""))
            ids += n
    if now is not None:
        yield row()


def _parts_of(index: DataFrame) -> list:
    """A row for each part of the range partitioning, as many as there are shuffle partitions at most."""
    rows = index.select("doc_id", "n_tokens", "root", "part", "place", "before").repartition("part").sortWithinPartitions("part", "place")
    return rows.mapInArrow(_part_roots, "part long, docs long, ids long, root binary").orderBy("part").collect()


def _top(parts: list) -> bytes:
    return merkle_root([address(repr((r["part"], r["docs"], r["ids"])).encode() + bytes(r["root"])) for r in parts])


def _write_index(spark: SparkSession, path: str) -> None:
    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total, place = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            before = np.cumsum(n) - n + total
            total += int(n.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), part)), pa.array(np.arange(place, place + len(n))), pa.array(before)], [f.split(" ")[0] for f in _INDEX.split(", ")])
            place += len(n)

    recipes = spark.read.schema(_POOL).parquet(f"{path}/pool").where("kind = 'recipe'").select("doc_id", "n_tokens", "root")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    ordered = recipes.repartitionByRange(parts, "doc_id", "root").sortWithinPartitions("doc_id", "root")
    ordered = staged(ordered.mapInArrow(running, _INDEX), "running")
    totals = _parts_of(ordered)
    base, entries = 0, []
    for row in totals:
        entries.append((row["part"], base))
        base += row["ids"]
    start = spark.createDataFrame(entries, "part long, base long")
    index = ordered.join(F.broadcast(start), "part").withColumn("start", F.col("base") + F.col("before")).drop("base")
    index.select("doc_id", "n_tokens", "start", "root", "part", "place", "before").write.option("compression", "zstd").parquet(f"{path}/index")
    rows = [(r["part"], r["docs"], r["ids"], bytes(r["root"])) for r in totals] + [(None, sum(r["docs"] for r in totals), base, _top(totals))]
    spark.createDataFrame(rows, "part long, docs long, ids long, root binary").coalesce(1).write.parquet(f"{path}/manifest")
    drop_staged(ordered)


def verify_manifest(spark: SparkSession, path: str) -> None:
    """Raise ValueError unless the manifest is what the index gives."""
    stored = spark.read.parquet(f"{path}/manifest").collect()
    top = [r for r in stored if r["part"] is None]
    index = spark.read.parquet(f"{path}/index")
    found = _parts_of(index)
    known = {r["part"]: (r["docs"], r["ids"], bytes(r["root"])) for r in stored if r["part"] is not None}
    if known != {r["part"]: (r["docs"], r["ids"], bytes(r["root"])) for r in found}:
        raise ValueError("the index is not the one that the manifest was made of")
    if len(top) != 1 or (top[0]["docs"], top[0]["ids"], bytes(top[0]["root"])) != (sum(r["docs"] for r in found), sum(r["ids"] for r in found), _top(found)):
        raise ValueError("the manifest's totals or root do not agree with its parts")
    starts = {(r["part"], r["base"]) for r in index.select("part", (F.col("start") - F.col("before")).alias("base")).distinct().collect()}
    base, want = 0, set()
    for r in found:
        want.add((r["part"], base))
        base += r["ids"]
    if starts != want:
        raise ValueError("starts in the index do not agree with the manifest")


def _times_x(power: int) -> int:
    """x ** power modulo the CRC-32 polynomial, bits reflected."""
    out, base = 1 << 31, 1 << 30
    while power:
        if power & 1:
            out = _product(out, base)
        base = _product(base, base)
        power >>= 1
    return out


def _product(a: int, b: int) -> int:
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def _shift_tables(bit: int) -> np.ndarray:
    """What a checksum's four bytes become when 2 ** bit bytes follow."""
    power = _times_x(8 << bit)
    return np.array([[_product(power, b << 8 * k) for b in range(256)] for k in range(4)], np.uint32)


_tables: list[np.ndarray] = []


def crcs_joined(crc: np.ndarray, size: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of wholes from those of their pieces and their lengths in bytes; ``ends``: where each whole's pieces end.
    A checksum is linear, so each piece is moved by what follows it and all are added."""
    if not len(ends):
        return np.zeros(0, np.uint32)
    total = np.concatenate([[0], np.cumsum(size)])
    starts = np.concatenate([[0], ends[:-1]])
    after = np.repeat(total[ends], ends - starts) - total[1:]
    crc, bit = crc.astype(np.uint32), 0
    while (after >> bit).any():
        if bit == len(_tables):
            _tables.append(_shift_tables(bit))
        own, t = np.flatnonzero(after >> bit & 1), _tables[bit]
        c = crc[own]
        crc[own] = t[0][c & 255] ^ t[1][c >> 8 & 255] ^ t[2][c >> 16 & 255] ^ t[3][c >> 24]
        bit += 1
    sums = np.concatenate([[0], np.bitwise_xor.accumulate(crc)]).astype(np.uint32)
    return sums[ends] ^ sums[starts]


def _weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of chunks: address as stored, as recomputed from the bytes, checksum and number of the ids."""
    for batch in batches:
        data = batch.column(1).to_pylist()
        now = [address(d) for d in data]
        if all(d[:1] == b"\2" and len(d) % 2 for d in data):
            n = np.array([len(d) // 2 for d in data], np.int64)
            ids = memoryview(np.frombuffer(b"".join([d[1:] for d in data]), "<u2").astype("<u4").tobytes())
            ends = (4 * np.cumsum(n)).tolist()
            crc = [zlib.crc32(ids[i:j]) for i, j in zip([0, *ends[:-1]], ends, strict=True)] if ends else []
        else:
            whole = [unpack(d) for d in data]
            n, crc = np.array([len(w) for w in whole], np.int64), [zlib.crc32(w.tobytes()) for w in whole]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(now, pa.binary()), pa.array(crc, pa.int64()), pa.array(n)], ["address", "recomputed", "crc", "n"])


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of recipes: root, place and address of each chunk."""
    for batch in batches:
        sizes = np.array([len(a) // 16 for a in batch.column(1).to_pylist()], np.int64)
        owner = batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), int(sizes.sum()), [None, pa.py_buffer(b"".join(batch.column(1).to_pylist()))])
        yield pa.RecordBatch.from_arrays([owner, pa.array(place, pa.int32()), flat.cast(pa.binary())], ["root", "seq", "address"])


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a root and its chunks in order: checksum, number of ids, root and number of chunks; lost chunks give no root."""
    for batch in batches:
        lists = batch.column(1)
        flat = lists.flatten()
        ends = np.cumsum(lists.value_lengths().to_numpy())
        now = flat.field("recomputed").to_pylist()
        crc, n = (flat.field(c).fill_null(0).to_numpy() for c in ("crc", "n"))
        joined = crcs_joined(crc, 4 * n, ends)
        sums = np.concatenate([[0], np.cumsum(n)])
        root, lost, start = [], [], 0
        for end in ends.tolist():
            own = now[start:end]
            start = end
            lost.append(None in own)
            root.append(None if lost[-1] else merkle_root(own))
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        gone = np.array(lost, bool)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(joined.astype(np.int64), mask=gone), pa.array(sums[ends] - sums[starts], mask=gone), pa.array(root, pa.binary()), pa.array(ends - starts, pa.int64())], ["root", "ids_crc32", "total", "rebuilt", "n_chunks"])


def _recipe_steps(pool: DataFrame) -> DataFrame:
    return pool.where("kind = 'recipe'").select("root", "addresses").dropDuplicates(["root"]).mapInArrow(_steps, "root binary, seq int, address binary")


def read(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, n_chunks, verified: all from the files of the store. With ``strict`` a
    manifest, index, recipe or chunk that is lost or altered raises an error, now or when the rows are read."""
    if strict:
        verify_manifest(spark, path)
    pool = spark.read.schema(_POOL).parquet(f"{path}/pool")
    chunks = pool.where("kind = 'chunk'").select("address", "data").mapInArrow(_weighed, "address binary, recomputed binary, crc long, n long")
    parts = _recipe_steps(pool).join(chunks, "address", "left")
    whole = parts.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("seq", "recomputed", "crc", "n"))).alias("chunks"))
    whole = whole.mapInArrow(_rebuilt, "root binary, ids_crc32 long, total long, rebuilt binary, n_chunks long")
    index = spark.read.parquet(f"{path}/index").select("doc_id", "start", "n_tokens", "root")
    verified = F.coalesce((F.col("rebuilt") == F.col("root")) & (F.col("total") == F.col("n_tokens")), F.lit(False))
    if strict:
        verified = F.when(verified, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not as stored: document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).cast("boolean"))
    return index.join(whole, "root", "left").select("doc_id", "start", F.coalesce("total", "n_tokens").alias("n_tokens"), "ids_crc32", "n_chunks", verified.alias("verified"))


def streams(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids (array<int>): the id streams themselves, put together from their chunks."""
    pool = spark.read.schema(_POOL).parquet(f"{path}/pool")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.concatenate([unpack(c["data"]) for c in chunks]).astype(np.int32) for chunks in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["root", "ids"])

    parts = _recipe_steps(pool).join(pool.where("kind = 'chunk'").select("address", "data"), "address")
    whole = parts.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("seq", "data"))).alias("chunks"))
    return spark.read.parquet(f"{path}/index").join(whole.mapInArrow(joined, "root binary, ids array<int>"), "root").select("doc_id", "start", "ids")


def round_trip(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write the store, by default to a new folder beside the session's other shared files, and read it back."""
    spark = docs.sparkSession
    path = path or new_path(spark, "idstore")
    write(docs, path, tokenizer)
    return read(spark, path)
