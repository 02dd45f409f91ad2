"""Benchmark decontamination by greedy string tiling.

Word runs of ``min_match`` words are the seeds. Seeds of texts are joined with those of benchmark items by their hash,
and an item is a candidate for a text if its words that lie in shared seeds could reach the coverage threshold, which
loses nothing, as every tile is made of seeds. On candidates, running Karp-Rabin finds the longest matches of unmarked
words, marks them, and goes on with shorter ones down to ``min_match``, so passages are caught whatever the order of
their parts. Tiles are matched on words, not on hashes. An item leaks into a text if tiles cover at least ``coverage`` of
the item's words.

One pass over the texts is made whatever the size of the benchmark. A Bloom filter of the items' seeds, of at most
MOST_BITS bits, is sent to every task, so that only seeds that an item may have are shuffled; a benchmark that is too
large for it makes it let more through, and the join decides all the same.

Defined cases: null and empty texts and items have no words and never match; an item of fewer than ``min_match``
words matches as a whole; repeated rows give repeated results; an empty table gives an empty result; rows without a
doc_id are treated like others. Of documents only doc_id and text are looked at, of the benchmark only item_id and text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.llm import text as tx
from kinloom.llm.store import MOST_IDS, staged

U = np.uint64
MIN_MATCH = 5
COVERAGE = 0.5
#: Bits of the Bloom filter for each seed, places that a seed has in it, and the most bits that it may have.
BITS, PLACES, MOST_BITS = 64, 4, 1 << 27


def _mixed(values: np.ndarray) -> np.ndarray:
    return tx.mix(values + U(0x9E3779B97F4A7C15))


class _Windows:
    """Hashes of the runs of unmarked words of one list, for any length."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.words, self.marked = words, np.zeros(n, bool)
        steps = np.full(n + 1, 0x9E3779B97F4A7C15, np.uint64)
        steps[0] = 1
        up = np.multiply.accumulate(steps)
        steps[1:] = pow(0x9E3779B97F4A7C15, -1, 1 << 64)
        self.down = np.multiply.accumulate(steps)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(words) * up[:n])])

    def of(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of every run of ``size`` unmarked words."""
        n = len(self.words) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        before = np.concatenate([[0], np.cumsum(self.marked)])
        at = np.flatnonzero(before[size:] == before[:n])
        return at, (self.sums[at + size] - self.sums[at]) * self.down[at]


def tiles(pattern: list[int], text: list[int], min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word lists by running Karp-Rabin: (length, start in pattern, start in text). A match
    of some length holds one of every shorter length, so the longest is found by bisection over window hashes; all
    matches of that length are then marked, by start in pattern and then in text, as long as they don't overlap."""
    p, t = (_Windows(np.array(words, dtype=np.uint64)) for words in (pattern, text))
    least, top = max(1, min(min_match, len(pattern))), min(len(pattern), len(text))

    def shared(size: int) -> bool:
        return bool(np.isin(p.of(size)[1], t.of(size)[1]).any())

    out: list[tuple[int, int, int]] = []
    while top >= least and shared(least):
        low, high = least, top
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if shared(middle) else (low, middle - 1)
        (at, value), (to, other) = p.of(low), t.of(low)
        mine, theirs = np.isin(value, other), np.isin(other, value)
        places: dict[int, list[int]] = {}
        for j, h in zip(to[theirs][::-1].tolist(), other[theirs][::-1].tolist(), strict=True):
            places.setdefault(h, []).append(j)
        for i, h in zip(at[mine].tolist(), value[mine].tolist(), strict=True):
            if p.marked[i] or p.marked[i + low - 1]:
                continue
            left = places[h]  # the first places come last
            while left and (t.marked[left[-1]] or t.marked[left[-1] + low - 1]):
                left.pop()
            if left and (p.words[i : i + low] == t.words[left[-1] : left[-1] + low]).all():
                j = left.pop()
                p.marked[i : i + low] = t.marked[j : j + low] = True
                out.append((low, i, j))
        top = low - 1
    return out


def _numbered_words(item: bytes, text: bytes) -> tuple[list[int], list[int]]:
    """Both word lists with equal words, and no others, under equal numbers."""
    numbers: dict[bytes, int] = {}
    out = []
    for raw in (item, text):
        raw = raw.lower()
        starts, ends, _ = tx.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        out.append([numbers.setdefault(raw[i:j], len(numbers)) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)])
    return out[0], out[1]


def _places(seeds: np.ndarray, bits: int) -> list[np.ndarray]:
    out, value = [], seeds
    for _ in range(PLACES):
        value = _mixed(value)
        out.append(value & U(bits - 1))
    return out


def _item_seeds(min_match: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch):
                raw, at = tx.as_bytes(part.column(1))
                starts, ends, bounds = tx.words(raw, at)
                run, owner = tx.shingle_hashes(tx.word_hashes(raw, starts, ends), bounds, min_match)
                order = np.argsort(owner, kind="stable")
                run, owner = run[order], owner[order]
                n = np.diff(bounds)
                first = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(n)))])[:-1]
                place = np.arange(len(run)) - first[owner]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), pa.array(run.view(np.int64)), pa.array(place), pa.array(n[owner])], ["item", "seed", "place", "n_words"])

    return of


def _filter(seeds: DataFrame, bits: int) -> np.ndarray:
    """The Bloom filter of all seeds as 64-bit words, put together by the executors."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate([p.view(np.int64) for p in _places(batch.column(0).to_numpy().view(np.uint64), bits)])
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.int64(1), at & 63))], ["word", "bit"])

    rows = seeds.select("seed").mapInArrow(of, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(max(1, bits >> 6), np.int64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return out


def _touched(words: np.ndarray, bits: int, sizes: list[int]):
    """Of texts that may hold a seed: all columns and the different seeds that they may hold."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch):
                raw, at = tx.as_bytes(part.column(1))
                starts, ends, bounds = tx.words(raw, at)
                hashes = tx.word_hashes(raw, starts, ends)
                seeds, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for size in sizes:
                    run, owner = tx.shingle_hashes(hashes, bounds, size)
                    for place in range(PLACES):
                        if not len(run):
                            break
                        now = _places(run, bits)[place].view(np.int64)
                        held = (words[now >> 6] >> (now & 63) & 1).astype(bool)
                        run, owner = run[held], owner[held]
                    seeds.append(run)
                    owners.append(owner)
                pair = np.unique(np.stack([np.concatenate(owners).astype(np.uint64), np.concatenate(seeds)], 1), axis=0)
                rows, first = np.unique(pair[:, 0], return_index=True)
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(pair)).astype(np.int32)), pa.array(pair[:, 1].view(np.int64)))
                kept = part.take(pa.array(rows.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*kept.columns, lists], ["doc_id", "text", "key", "seeds"])

    return of


def _tiled(min_match: int, coverage: float):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], []]
            keep = []
            for text, item in zip(batch.column(3), batch.column(4), strict=True):
                pattern, words = _numbered_words(item.as_py().encode(), text.as_py().encode())
                found = tiles(pattern, words, min_match)
                share = sum(k for k, _, _ in found) / max(1, len(pattern))
                keep.append(share >= coverage)
                if keep[-1]:
                    for column, value in zip(rows, (share, len(found), max(k for k, _, _ in found)), strict=True):
                        column.append(value)
            hit = pa.array(keep, pa.bool_())
            own = [batch.column(k).filter(hit) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, t in zip(rows, (pa.float64(), pa.int64(), pa.int64()), strict=True))], ["doc_id", "key", "item_id", "coverage", "n_tiles", "longest"])

    return of


def _covered(places: Column, size: Column) -> Column:
    """Words of an item that lie in seeds at these places."""
    seen = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("sum"))

    def step(acc: Column, at: Column) -> Column:
        return F.struct((at + size).alias("end"), (acc["sum"] + at + size - F.greatest(acc["end"], at)).alias("sum"))

    return F.aggregate(F.array_sort(places), seen, step, lambda acc: acc["sum"])


def _leaks(docs: DataFrame, benchmark: DataFrame, coverage: float, min_match: int) -> DataFrame:
    """doc_id, key (a hash of the text), item_id, coverage, n_tiles, longest."""
    spark = docs.sparkSession
    items = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    items = staged(items, "items")
    seeds = staged(items.select("item", "text").mapInArrow(_item_seeds(min_match), "item long, seed long, place long, n_words long"), "seeds")
    sizes = [r["size"] for r in seeds.select(F.least("n_words", F.lit(min_match)).alias("size")).distinct().collect()]  # at most min_match
    n = max(1, seeds.count())
    bits = min(MOST_BITS, 1 << (BITS * n - 1).bit_length())
    words = _filter(seeds, bits)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sent = spark.sparkContext.broadcast(words)  # MOST_BITS at most

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _touched(sent.value, bits, sorted(sizes))(batches)

    held = source.withColumn("key", F.xxhash64("text")).mapInArrow(touched, "doc_id long, text string, key long, seeds array<long>")
    held = staged(held.withColumn("row", F.monotonically_increasing_id()), "touched")
    hits = held.select("row", F.explode("seeds").alias("seed")).join(seeds, "seed")
    hits = hits.groupBy("row", "item").agg(F.collect_set("place").alias("places"), F.max("n_words").alias("n_words"))
    pairs = hits.where(_covered(F.col("places"), F.least("n_words", F.lit(min_match))) >= F.lit(coverage) * F.col("n_words")).select("row", "item")
    both = pairs.join(held.select("row", "doc_id", "key", "text"), "row").join(items.select("item", "item_id", F.col("text").alias("own")), "item")
    both = both.select("doc_id", "key", "item_id", "text", "own")
    return both.mapInArrow(_tiled(min_match, coverage), "doc_id long, key long, item_id long, coverage double, n_tiles long, longest long")


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, min_match: int = MIN_MATCH) -> DataFrame:
    """One row for each document and item that leaks into it: doc_id, item_id, coverage, n_tiles, longest."""
    return _leaks(docs, benchmark, coverage, min_match).select("doc_id", "item_id", "coverage", "n_tiles", "longest")


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, min_match: int = MIN_MATCH) -> DataFrame:
    """The documents into which no item leaks; rows are told apart by doc_id, null included, and a hash of the text."""
    found = _leaks(docs, benchmark, coverage, min_match).select(F.col("doc_id").alias("id__"), F.col("key").alias("key__")).distinct()
    found = staged(found, "leaks")
    found = F.broadcast(found) if found.count() <= MOST_IDS else found
    own = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("id__")) & (own == F.col("key__")), "left_anti")
