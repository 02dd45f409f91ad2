"""Near-duplicate classes by ProbMinHash signatures, banding and exact verification.

Each text becomes a set of five-word shingles weighted by how often they occur. Every shingle is the source of a
Poisson process whose rate is its weight; an arrival lands in a uniformly chosen register, which keeps the shingle
that arrived first. A shingle stops as soon as its next arrival is later than the latest of the registers, as it can
then no longer win any. Two texts agree in a register with a probability equal to their probability Jaccard
similarity, 1 / sum_j max(x_j / x_i, y_j / y_i) summed over shared shingles i. Registers are grouped into bands; texts
that share a band are candidates, and their similarity is then computed exactly.

Texts with the same words in the same order are folded into one class first. In a band's bucket every class is
compared with one leader, the member that shares most buckets with others, which is the original where the rest are
its edited copies. Where a bucket isn't one component after that, a bucket of at most SMALL classes compares all pairs
that are still apart; a larger one compares each class outside the component of a leader drawn anew with that leader,
round after round, as long as rounds merge anything and ROUNDS at most. These rounds only save work: members of large
buckets that stay split are then joined exactly, so that no pair above the threshold is left between two components.

That join rests on two bounds. The similarity is the probability of a coupling of both normalised weightings, so it is
at most sum_i min(x_i / |x|, y_i / |y|). With shingles in one order for all texts, rarest first, two texts can then only
reach the threshold if they share a shingle among those before which at most 1 - threshold of the weight stands (prefix
filter). And 1 / sum_j max(x_j / a, y_j / b) is concave and homogeneous in a and b, so the similarity of outlines, the
sums of weights over cells of shingles, is never less than that of the texts. Pairs that pass both are verified.

Weights are damped, 1 + ln(n) / 4 for a shingle that occurs n times, so that one line repeated many times doesn't make
texts alike that share nothing else.

Rows are numbered where their sketches are written, and the number, not doc_id, is what joins and links carry; so
different texts under one doc_id, and rows without one, are compared like all others.

Defined cases: a null text is an empty one; texts without words form one class; texts of fewer than five words are
one shingle; repeated rows share a class; an empty table gives an empty result; a class of rows without a doc_id alone
is named by a hash. Of columns other than doc_id and text none is looked at; names that end in two underscores are
taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.llm import text as tx
from kinloom.llm.store import drop_staged, rows_of, staged

U = np.uint64
SHINGLE = 5
THRESHOLD = 0.8
BANDS = 24
ROWS = 4
SMALL = 16
ROUNDS = 4
#: Cells of an outline, and texts of one shingle that are compared in one piece.
CELLS = 256
BLOCK = 512


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def weighted_sets(run: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, shingle) in order, with the weight of each."""
    order = np.lexsort((run, owner))
    run, owner = run[order], owner[order]
    first = np.ones(len(run), bool)
    first[1:] = (run[1:] != run[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    return owner[at], run[at], 1 + np.log(np.diff(np.append(at, len(run)))) / 4


def signatures(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """One row of ``registers`` shingle hashes for each of ``n`` texts; texts without shingles keep zeros."""
    best = np.full(n * registers, np.inf)
    won = np.zeros(n * registers, np.uint64)
    filled = np.zeros(n, bool)
    filled[owner] = True
    clock = np.zeros(len(owner))
    alive = np.arange(len(owner))
    step = 0
    while len(alive):
        step += 1
        seed = tx.mix(shingle[alive] + U(step * 0x9E3779B97F4A7C15 % (1 << 64)))
        clock[alive] -= np.log(_uniform(seed)) / weight[alive]
        place = tx.mix(seed ^ U(0xA0761D6478BD642F)) % U(registers)
        cell = owner[alive] * registers + place.astype(np.int64)
        now = clock[alive]
        better = now < best[cell]
        cell, now, by = cell[better], now[better], alive[better]
        np.minimum.at(best, cell, now)
        kept = best[cell] == now
        won[cell[kept]] = shingle[by[kept]]
        latest = best.reshape(n, registers).max(axis=1)
        alive = alive[clock[alive] < latest[owner[alive]]]
    won[~np.repeat(filled, registers)] = 0
    return won.reshape(n, registers)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(sig), bands), np.uint64)
    for b in range(bands):
        total = np.full(len(sig), b + 1, np.uint64)
        for r in range(rows):
            total = tx.mix(total * U(0xD6E8FEB86659FD93) + sig[:, b * rows + r])
        out[:, b] = total
    return out.view(np.int64)


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Exact similarity of two sets of sorted distinct hashes with weights; 1 for two empty sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    only_x, only_y = x.sum() - x[i].sum(), y.sum() - y[j].sum()
    p, q = x[i].astype(float), y[j].astype(float)
    order = np.argsort(p / q, kind="stable")
    p, q = p[order], q[order]
    ratio = p / q
    low = np.searchsorted(ratio, ratio, "left")
    sum_q = np.concatenate([[0.0], np.cumsum(q)])[low] + only_y
    sum_p = p.sum() - np.concatenate([[0.0], np.cumsum(p)])[low] + only_x
    return float((1.0 / (sum_p / p + sum_q / q)).sum())


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """All columns, then k1__ and k2__, which identify the words in order, and bands__, the band keys."""
    source = docs.withColumn("text__", F.col("text").cast("string"))
    names = [*docs.columns, "k1__", "k2__", "bands__"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch, "text__"):
                raw, at = tx.as_bytes(part.column(part.num_columns - 1))
                starts, ends, bounds = tx.words(raw, at)
                hashes = tx.word_hashes(raw, starts, ends)
                k1, k2 = tx.sequence_keys(hashes, bounds)
                run, owner = tx.shingle_hashes(hashes, bounds, shingle)
                owner, run, weight = weighted_sets(run, owner)
                n = part.num_rows
                keys = band_keys(signatures(owner, run, weight, n, bands * rows), bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32)), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(k1), pa.array(k2), lists], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return source.mapInArrow(of, f"{fields}, k1__ long, k2__ long, bands__ array<long>")


def verify(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """The pairs (a, b) whose texts are at least ``threshold`` similar. ``texts``: cid, text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for part in tx.slices(batch, "text_a", "text_b"):
                sides = []
                for c in (2, 3):
                    raw, at = tx.as_bytes(part.column(c))
                    starts, ends, bounds = tx.words(raw, at)
                    run, owner = tx.shingle_hashes(tx.word_hashes(raw, starts, ends), bounds, shingle)
                    owner, run, weight = weighted_sets(run, owner)
                    sides.append((run, weight, np.searchsorted(owner, np.arange(part.num_rows + 1))))
                (ra, wa, ba), (rb, wb, bb) = sides
                keep += [probability_jaccard(ra[ba[k] : ba[k + 1]], wa[ba[k] : ba[k + 1]], rb[bb[k] : bb[k + 1]], wb[bb[k] : bb[k + 1]]) >= threshold - 1e-9 for k in range(part.num_rows)]
            hit = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(hit), batch.column(1).filter(hit)], ["a", "b"])

    left = texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(of, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(cid, label) for each end of an edge (a, b). Every round merges each vertex into that neighbour that has the most
    neighbours, ties broken by an order drawn anew for the round, unless it has more itself; so a star goes at once,
    and rounds grow with the logarithm of the largest component at most."""
    levels: list[DataFrame] = []
    now = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    step = 0
    while True:
        now = staged(now, "cc-edges")
        if now.isEmpty():
            break
        step += 1
        both = now.select("a", "b").union(now.select(F.col("b"), F.col("a")))
        rank = both.groupBy(F.col("a").alias("v")).agg(F.count("*").alias("n")).select("v", F.struct("n", F.xxhash64(F.lit(step), "v").alias("h"), F.col("v").alias("id")).alias("rank"))
        rank = staged(rank, "cc-rank")
        best = both.join(rank.select(F.col("v").alias("b"), "rank"), "b").groupBy(F.col("a").alias("v")).agg(F.max("rank").alias("best"))
        to = staged(rank.join(best, "v").select(F.col("v").alias("cid"), F.greatest("rank", "best")["id"].alias("label")), "cc-label")
        levels.append(to)
        ends = now.join(to.select(F.col("cid").alias("a"), F.col("label").alias("x")), "a").join(to.select(F.col("cid").alias("b"), F.col("label").alias("y")), "b")
        now = ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    if not levels:
        return now.select(F.col("a").alias("cid"), F.col("b").alias("label"))
    out = levels[0]
    for nxt in levels[1:]:
        out = relabelled(out, nxt)
    return out


def relabelled(label: DataFrame, further: DataFrame) -> DataFrame:
    """``label`` with its labels sent on by ``further``."""
    to = further.select(F.col("cid").alias("label"), F.col("label").alias("further"))
    return label.join(to, "label", "left").select("cid", F.coalesce("further", "label").alias("label"))


def _ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.where(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def merged(label: DataFrame, new: DataFrame) -> DataFrame:
    """``label`` (cid, label) with the labels joined, and texts without one given theirs, that links (a, b) connect."""
    fresh = new.select(F.col("a").alias("cid")).union(new.select("b")).distinct().join(label, "cid", "left_anti")
    all_ids = label.unionByName(fresh.select("cid", F.col("cid").alias("label")))
    of = lambda c: all_ids.select(F.col("cid").alias(c), F.col("label").alias(f"{c}_label"))
    further = components(new.join(of("a"), "a").join(of("b"), "b").select(F.col("a_label").alias("a"), F.col("b_label").alias("b")))
    return staged(relabelled(all_ids, further), "label")


def shares(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """cid, token, share: every different shingle of a text and its part of the text's weight. ``texts``: cid, text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch):
                owner, run, share = _shares(part.column(1), shingle)
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(part.column(0))[owner]), pa.array(run.view(np.int64)), pa.array(share)], ["cid", "token", "share"])

    return texts.select("cid", "text").mapInArrow(of, "cid long, token long, share double")


def _shares(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw, at = tx.as_bytes(column)
    starts, ends, bounds = tx.words(raw, at)
    run, owner = tx.shingle_hashes(tx.word_hashes(raw, starts, ends), bounds, shingle)
    owner, run, weight = weighted_sets(run, owner)
    return owner, run, weight / np.bincount(owner, weight, len(column))[owner]


def outlines(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """cid, label, outline: the shares of a text's shingles summed in CELLS cells. ``texts``: cid, label, text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch):
                owner, run, share = _shares(part.column(2), shingle)
                cell = (tx.mix(run) % U(CELLS)).astype(np.int64)
                sums = np.bincount(owner * CELLS + cell, share, part.num_rows * CELLS)
                full = sums.astype("<f4").reshape(-1, CELLS)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([row.tobytes() for row in full], pa.binary())], ["cid", "label", "outline"])

    return texts.select("cid", "label", "text").mapInArrow(of, "cid long, label long, outline binary")


def row_similarity(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The probability Jaccard similarity of each row of ``x`` with that of ``y``."""
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(y > 0, x / y, np.inf)
        order = np.argsort(ratio, axis=1)
        p, q, ratio = (np.take_along_axis(m, order, 1).astype(float) for m in (x, y, ratio))
        least = np.cumsum(p[:, ::-1], axis=1)[:, ::-1] + np.where(q > 0, ratio, 0) * (np.cumsum(q, axis=1) - q)
        return np.where((p > 0) & (q > 0), p / least, 0).sum(axis=1)


def _near(label: np.ndarray, block: np.ndarray, lo: int, hi: int, outline: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows of one cell that are apart and whose outlines allow the threshold."""
    xs, ys = [], []
    for k in range(len(label) - 1):
        other = np.arange(k + 1, len(label))
        other = other[(label[other] != label[k]) & (np.minimum(block[other], block[k]) == lo) & (np.maximum(block[other], block[k]) == hi)]
        if len(other):
            other = other[np.minimum(outline[other], outline[k]).sum(axis=1) >= least]
            xs.append(np.full(len(other), k))
            ys.append(other)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(xs or none), np.concatenate(ys or none)


def apart(texts: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """All pairs (a, b) of different labels that can be ``threshold`` similar, and some that are not. ``texts``: cid,
    label, text."""
    held = staged(shares(texts, shingle), "shares")
    often = held.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    ordered = held.join(often, "token", "left").select("cid", "token", "share", F.coalesce("n", F.lit(1)).alias("n"))
    before = F.sum("share").over(Window.partitionBy("cid").orderBy("n", "token").rowsBetween(Window.unboundedPreceding, -1))
    prefix = ordered.withColumn("before", F.coalesce(before, F.lit(0.0))).where((F.col("n") > 1) & (F.col("before") <= 1 - threshold + 1e-6))
    outline = staged(outlines(texts, shingle), "outlines")
    prefix = staged(prefix.select("token", "cid").join(outline.select("cid", "label"), "cid"), "prefix")
    mixed = prefix.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("lo <> hi")
    block = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    dealt = prefix.join(mixed.select("token", "blocks"), "token").select("token", "cid", block.alias("block"), "blocks")
    dealt = dealt.select("token", "cid", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    dealt = dealt.select("token", F.least("block", "j").alias("lo"), F.greatest("block", "j").alias("hi"), "cid", "block").join(outline, "cid")
    dealt = dealt.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi")
    least = threshold - 1e-4

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        seen: set[tuple[int, int]] = set()

        def pairs(rows: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table]:
            key = np.stack([rows.column(c).to_numpy() for c in ("token", "lo", "hi")])
            cut = np.append(np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))), rows.num_rows)
            cut = cut if last else cut[:-1]  # the last cell may go on in the next batch
            cid, label, block = (rows.column(c).to_numpy() for c in ("cid", "label", "block"))
            outline = np.frombuffer(b"".join(rows.column("outline").to_pylist()), "<f4").reshape(-1, CELLS)
            a, b, at = [], [], []
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                x, y = _near(label[i:j], block[i:j], key[1, i], key[2, i], outline[i:j], least)
                for u, v in zip((i + x).tolist(), (i + y).tolist(), strict=True):
                    p, q = cid[u], cid[v]
                    pair = (p, q) if p < q else (q, p)
                    if pair not in seen:
                        if len(seen) >= 1 << 17:  # repeats only cost time
                            seen.clear()
                        seen.add(pair)
                        a.append(pair[0])
                        b.append(pair[1])
                        at.append((u, v))
            u, v = np.array(at, np.int64).reshape(-1, 2).T
            can = np.zeros(len(at), bool)
            for k in range(0, len(at), 1024):
                can[k : k + 1024] = row_similarity(outline[u[k : k + 1024]], outline[v[k : k + 1024]]) >= least
            hit = pa.array(can)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()).filter(hit), pa.array(b, pa.int64()).filter(hit)], ["a", "b"]), rows.slice(cut[-1])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            out, kept = pairs(rows if kept is None else pa.concat_tables([kept, rows]), False)
            yield out
        if kept is not None:
            yield pairs(kept, True)[0]

    found = dealt.select("token", "lo", "hi", "cid", "label", "block", "outline").mapInArrow(of, "a long, b long")
    return found.distinct()


def _row_classes(docs: DataFrame, threshold: float, bands: int, rows: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their sketches and a number row__ for each, staged; and row__, first (the row that stands for its
    class), class_id, n_checked_links of every row."""
    drawn = staged(sketch(docs, bands, rows, shingle).withColumn("row__", F.monotonically_increasing_id()), "sketch")
    doc_id = F.col("doc_id").cast("long")
    rank = F.struct(doc_id.isNull().alias("none"), doc_id.alias("doc_id"), F.col("row__").alias("row"))
    distinct = drawn.groupBy("k1__", "k2__").agg(F.min(rank).alias("rank"), F.first("bands__").alias("bands"))
    distinct = staged(distinct.select("k1__", "k2__", F.col("rank.row").alias("cid"), "rank", "bands"), "distinct")
    bucket = distinct.select(F.explode("bands").alias("key"), "cid")
    shared = bucket.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    member = staged(bucket.join(shared, "key"), "member")
    weight = staged(member.groupBy("cid").agg(F.sum("n").alias("weight")), "weight")
    texts = drawn.select(F.col("row__").alias("cid"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = staged(rows_of(texts, weight.select("cid"), "cid"), "texts")

    lead = member.join(weight, "cid").groupBy("key").agg(F.max(F.struct("weight", F.col("cid").alias("lead")))["lead"].alias("lead"))
    tried = staged(_ordered(member.join(lead, "key"), "cid", "lead"), "pairs")
    links = staged(verify(tried, texts, threshold, shingle), "links")
    label = staged(components(links), "label")
    for step in range(ROUNDS):
        held = member.join(label, "cid", "left").select("key", "cid", "n", F.coalesce("label", "cid").alias("label"))
        drawn_lead = F.min(F.struct(F.xxhash64(F.lit(step), "cid").alias("h"), F.col("cid"), F.col("label")))
        split = held.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), drawn_lead.alias("lead")).where("lo <> hi")
        held = staged(held.join(split.select("key", F.col("lead.cid").alias("lead"), F.col("lead.label").alias("lead_label")), "key"), "held")
        pairs = _ordered(held.where(F.col("n") > SMALL).where("label <> lead_label"), "cid", "lead")
        if not step:
            few = held.where(F.col("n") <= SMALL)
            other = few.select("key", F.col("cid").alias("other"), F.col("label").alias("label2"))
            pairs = pairs.union(_ordered(few.join(other, "key").where("label < label2"), "cid", "other")).distinct()
        pairs = staged(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            break
        new = staged(verify(pairs, texts, threshold, shingle), "links")
        tried = staged(tried.union(pairs), "pairs")
        if new.isEmpty():
            if step:
                break  # what large buckets still hold apart is joined exactly below
            continue
        links = staged(links.union(new), "links")
        label = merged(label, new)
    held = member.where(F.col("n") > SMALL).join(label, "cid", "left").select("key", "cid", F.coalesce("label", "cid").alias("label"))
    held = staged(held, "held")
    split = held.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    split = staged(held.join(split, "key", "left_semi").select("cid", "label").distinct(), "split")
    left_over = staged(rows_of(texts, split.select("cid"), "cid").join(split, "cid").select("cid", "label", "text"), "split")
    pairs = staged(apart(left_over, threshold, shingle).join(tried, ["a", "b"], "left_anti"), "pairs")
    if not pairs.isEmpty():
        new = staged(verify(pairs, texts, threshold, shingle), "links")
        if not new.isEmpty():
            links = staged(links.union(new), "links")
            label = merged(label, new)
    ends = links.select(F.col("a").alias("cid")).union(links.select(F.col("b").alias("cid"))).groupBy("cid").agg(F.count("*").alias("n"))
    label = distinct.select("k1__", "k2__", "cid", "rank").join(label, "cid", "left").join(ends, "cid", "left")
    label = label.select("k1__", "k2__", "cid", "rank", F.coalesce("label", "cid").alias("label"), F.coalesce("n", F.lit(0)).cast("long").alias("n_checked_links"))
    label = staged(label, "labels")
    first = label.groupBy("label").agg(F.min("rank").alias("first"), F.min("k1__").alias("name"))
    named = label.join(first, "label").select("k1__", "k2__", F.col("first.row").alias("first"), F.coalesce("first.doc_id", "name").alias("class_id"), "n_checked_links")
    out = drawn.select("row__", "doc_id", "k1__", "k2__").join(named, ["k1__", "k2__"]).select("row__", F.col("doc_id").cast("long").alias("doc_id"), "first", "class_id", "n_checked_links")
    out = staged(out, "classes")
    for x in (texts, member, distinct):
        drop_staged(x)
    return drawn, out


def classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """One row for each document: doc_id, class_id (the least doc_id of its class), n_checked_links (links of its
    text to different texts among the pairs that were compared; texts already in one class may stay uncompared)."""
    drawn, out = _row_classes(docs.select("doc_id", "text"), threshold, bands, rows, shingle)
    drop_staged(drawn)
    return out.select("doc_id", "class_id", "n_checked_links")


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """One row of each class with all its columns: that of least doc_id, null last; any one of rows equal in that."""
    drawn, out = _row_classes(docs, threshold, bands, rows, shingle)
    gone = staged(out.where("row__ <> first").select("row__"), "copies")
    return rows_of(drawn, gone, "row__", "left_anti").select(*docs.columns)
