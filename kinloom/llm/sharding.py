"""A uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Rows are numbered where they are first written, and dealt by a hash of number and contents to logical partitions of
bounded size, so many equal rows are dealt like others. The matrix entry (p, s), the number of rows that
partition p sends to shard s, is drawn row by row from the multivariate hypergeometric law of a uniform permutation,
so every shard gets exactly its size. Each partition orders its rows at random and deals runs of them to the shards;
each shard then puts what it got in a random order again, block by block. All randomness comes from the seed and the
numbered row, so a lost task is made again as it was, and the same files give the same shards.

Sizes of shards differ by one at most (law ``rows``); equal texts are rows of their own and are not kept together.

Defined cases: a null text has size 1 and the checksum of no bytes; rows that are equal in doc_id, size and checksum
are rows of their own; a null doc_id is a value like another; an
empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinloom.llm.store import staged

SHARDS = 16
SEED = 20240611
#: Rows in a logical partition: at least so many, and more where there would be over MOST_PARTS of them.
PART_ROWS = 2000
MOST_PARTS = 1 << 16


def _large_hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Ratio of uniforms for populations beyond numpy's 10**9."""
    total, k = good + bad, min(draws, good + bad - draws)
    low, high = min(good, bad), max(good, bad)
    p = low / total
    mean = k * p + 0.5
    width = math.sqrt((total - k) * k * p * (1 - p) / (total - 1) + 0.5)
    spread = 1.7155277699214135 * width + 0.8989161620588988
    mode = (k + 1) * (low + 1) // (total + 2)
    g = math.lgamma
    weight = lambda z: -(g(z + 1) + g(low - z + 1) + g(k - z + 1) + g(high - k + z + 1))
    top, most = weight(mode), min(min(k, low) + 1, math.floor(mean + 16 * width))
    while True:
        x, y = rng.random(), rng.random()
        at = mean + spread * (y - 0.5) / x if x else -1.0
        if not 0 <= at < most:
            continue
        z = math.floor(at)
        t = weight(z) - top
        if x * (4 - x) - 3 <= t or (x * (x - t) < 1 and 2 * math.log(x) <= t):
            break
    z = k - z if good > bad else z
    return good - z if k < draws else z


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    if not draws or not good:
        return 0
    if not bad:
        return draws
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    return _large_hypergeometric(rng, good, bad, draws)


def communication_matrix(counts: list[int], targets: list[int], seed: int) -> np.ndarray:
    """Rows sum to ``counts``, columns to ``targets``; drawn as a uniform permutation would make it."""
    rng = np.random.default_rng(seed)
    left = list(targets)
    out = np.zeros((len(counts), len(targets)), np.int64)
    for p, n in enumerate(counts):
        rest, need = sum(left), n
        for s, size in enumerate(left):
            rest -= size
            out[p, s] = got = hypergeometric(rng, size, rest, need)
            need -= got
        left = [a - int(b) for a, b in zip(left, out[p], strict=True)]
    return out


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, part_rows: int = PART_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    spark = docs.sparkSession
    raw = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"))
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    n = rows.count()
    per_part = max(part_rows, -(-n // MOST_PARTS))
    parts, blocks = max(1, -(-n // per_part)), max(1, -(-n // (shards * per_part)))
    own = ("doc_id", "text_crc32", "size", "row")
    drawn = lambda k: F.xxhash64(F.lit(seed), F.lit(k), *own)

    rows = rows.withColumn("part", F.pmod(drawn(1), F.lit(parts)))
    counts = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}
    targets = [n // shards + (s < n % shards) for s in range(shards)]
    matrix = communication_matrix([counts.get(p, 0) for p in range(parts)], targets, seed)
    ends = spark.createDataFrame([(p, row.tolist()) for p, row in enumerate(matrix.cumsum(axis=1))], "part long, ends array<long>")
    place = F.row_number().over(W.partitionBy("part").orderBy(drawn(2), *own))
    sent = rows.withColumn("place", place).join(F.broadcast(ends), "part")
    sent = sent.withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("place")))).withColumn("block", F.pmod(drawn(3), F.lit(blocks)))
    sent = staged(sent.select(*own, "shard", "block"), "sent")

    filled = sorted((r["shard"], r["block"], r["count"]) for r in sent.groupBy("shard", "block").count().collect())
    base, before, last = [], 0, -1
    for s, b, c in filled:
        before = 0 if s != last else before
        base.append((s, b, before))
        before, last = before + c, s
    starts = spark.createDataFrame(base, "shard int, block long, base long")
    rank = F.row_number().over(W.partitionBy("shard", "block").orderBy(drawn(4), *own))
    out = sent.withColumn("rank", rank).join(F.broadcast(starts), ["shard", "block"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("base") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
