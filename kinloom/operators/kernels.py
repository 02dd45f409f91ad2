"""Dense numeric kernels in numpy, run per key through Arrow."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hidden Markov models


def forward_backward(pi: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """Posteriors (time x state) and log10 likelihood. a: (time-1) x state x state; b: time x state."""
    n, k = b.shape
    alpha, scale = np.zeros((n, k)), np.zeros(n)
    for t in range(n):
        v = (pi if t == 0 else alpha[t - 1] @ a[t - 1]) * b[t]
        scale[t] = v.sum()
        alpha[t] = v / scale[t]
    beta = np.ones((n, k))
    for t in range(n - 2, -1, -1):
        beta[t] = a[t] @ (b[t + 1] * beta[t + 1]) / scale[t + 1]
    gamma = alpha * beta
    return gamma / gamma.sum(axis=1, keepdims=True), float(np.log10(scale).sum())


def viterbi(pi: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    log = lambda x: np.log10(x + 1e-15)
    n, k = b.shape
    best, back = log(pi) + log(b[0]), np.zeros((n, k), int)
    for t in range(1, n):
        way = best[:, None] + log(a[t - 1])
        back[t] = way.argmax(axis=0)
        best = way.max(axis=0) + log(b[t])
    path = [int(best.argmax())]
    for t in range(n - 1, 0, -1):
        path.append(int(back[t, path[-1]]))
    return np.array(path[::-1])


def haplotype_model(x: np.ndarray, h1: np.ndarray, h2: np.ndarray, p: np.ndarray, lam: float, f: float, error: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two states (apart, identical by descent): start, transitions along ``x``, emissions of allele pairs."""
    pi = np.array([1 - f, f])
    stay = np.exp(-lam * np.diff(x))[:, None, None]
    away = np.tile(pi, (2, 1))
    a = away + (np.eye(2) - away) * stay
    flip = np.array([[1 - error, error], [error, 1 - error]])
    q, zero = 1 - p, np.zeros_like(p)
    pure = np.stack([np.stack([p * p, p * q, p * q, q * q], -1), np.stack([p, zero, zero, q], -1)], 1)
    b = (pure @ np.kron(flip, flip))[np.arange(len(x)), :, 2 * h1 + h2 - 3]
    return pi, a, b


def ibd_posterior(x, h1, h2, p, lam: float, f: float, error: float = 0.01) -> np.ndarray:
    """Posterior of identity where the best path has it, else 0."""
    model = haplotype_model(np.asarray(x, float), np.asarray(h1), np.asarray(h2), np.asarray(p, float), lam, f, error)
    gamma, _ = forward_backward(*model)
    return np.where(viterbi(*model) == 1, gamma[:, 1], 0.0)


def hmm_segments(haps: DataFrame, lam: float = 0.05, f: float = 0.2, least: int = 20) -> DataFrame:
    """x, y, start, stop, confidence: runs of positive posterior between neighbouring samples' haplotypes."""
    freq = haps.groupBy("snp").agg(F.avg((F.col("v") == 1).cast("double")).alias("p"))
    a, b = haps.select("snp", F.col("smp").alias("x"), F.col("v").alias("h1")), haps.select("snp", F.col("smp").alias("y"), F.col("v").alias("h2"))
    pairs = a.join(b, "snp").where("x < y").join(freq, "snp")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("snp")
        post = ibd_posterior(part["snp"], part["h1"], part["h2"], part["p"].clip(0.01, 0.99), lam, f)
        on = np.concatenate([[0], (post > 0).astype(int), [0]])
        start, stop = np.flatnonzero(np.diff(on) == 1), np.flatnonzero(np.diff(on) == -1)
        keep = stop - start >= least
        snp = part["snp"].to_numpy()
        rows = [(int(snp[i]), int(snp[j - 1]) + 1, float(post[i:j].mean())) for i, j in zip(start[keep], stop[keep], strict=True)]
        out = pd.DataFrame(rows, columns=["start", "stop", "confidence"])
        return out.assign(x=part["x"].iloc[0], y=part["y"].iloc[0])[["x", "y", "start", "stop", "confidence"]]

    return pairs.groupBy("x", "y").applyInPandas(run, "x long, y long, start long, stop long, confidence double")


# Cliques and imputation


def union_find(edges, nodes=()) -> dict:
    root = {n: n for n in nodes}

    def find(n):
        root.setdefault(n, n)
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in list(root)}


def naive_cliques(edges: list[tuple], least_degree: int = 4) -> list[list]:
    """Components without nodes of fewer links than min(n - 1, least_degree), dropped once; groups of two and more."""
    label = union_find(edges)
    near: dict = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    groups: dict = {}
    for n, c in label.items():
        groups.setdefault(c, []).append(n)
    out = []
    for members in groups.values():
        kept = sorted(n for n in members if len(near[n] & set(members)) >= min(len(members) - 1, least_degree))
        if len(kept) > 1:
            out.append(kept)
    return sorted(out)


def affinity_cliques(edges: list[tuple], weights: list[float], theta: float = 0.5, least: float = 0.85, vectors: int = 5, sweeps: int = 5, seed: int = 0) -> list[list]:
    """Components after dropping edges that are light, or whose ends differ under relaxed random vectors."""
    nodes = sorted({n for e in edges for n in e})
    at = {n: k for k, n in enumerate(nodes)}
    w = np.zeros((len(nodes), len(nodes)))
    for (a, b), x in zip(edges, weights, strict=True):
        w[at[a], at[b]] = w[at[b], at[a]] = x
    degree = np.maximum(w.sum(axis=1), 1e-12)
    x = np.random.RandomState(seed).uniform(-1, 1, (len(nodes), vectors))
    for _ in range(sweeps):
        x = x + 0.7 * (w @ x / degree[:, None] - x)
    norm = (x * x).sum(axis=1)
    keep = [(a, b) for (a, b), v in zip(edges, weights, strict=True) if v >= least and (x[at[a]] @ x[at[b]]) ** 2 / (norm[at[a]] * norm[at[b]]) >= theta]
    groups: dict = {}
    for n, c in union_find(keep).items():
        groups.setdefault(c, []).append(n)
    return sorted(sorted(g) for g in groups.values() if len(g) > 1)


def disjoint_groups(covered: DataFrame, region: int = 4096) -> DataFrame:
    """k, lo, hi, members: components of the pairs (a, b) on each atom. Atoms are handed over by region, as a call for
    each would cost more than its work."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        pairs: dict = {}
        for lo, hi, a, b in zip(part["lo"].tolist(), part["hi"].tolist(), part["a"].tolist(), part["b"].tolist(), strict=True):
            pairs.setdefault((lo, hi), []).append((a, b))
        rows = []
        for (lo, hi), edges in pairs.items():
            groups: dict = {}
            for n, c in union_find(edges).items():
                groups.setdefault(c, []).append(n)
            rows += [(lo, hi, sorted(g)) for g in groups.values()]
        out = pd.DataFrame(rows, columns=["lo", "hi", "members"])
        return out.assign(k=part["k"].iloc[0])[["k", "lo", "hi", "members"]]

    return covered.groupBy("k", F.floor(F.col("lo") / region).alias("region")).applyInPandas(run, "k long, lo long, hi long, members array<long>")


def other_allele(h: int, same: int, other: int) -> int:
    """The allele opposite a known one, h, in a genotype of which one allele may be missing; 0 if that leaves it open.
    ``same`` is the genotype's allele at the place of h."""
    if same not in (0, h, other):
        return same
    return other if same == h or (same == 0 and other == 3 - h) else 0


def impute_snp(genotype: dict[int, tuple[int, int]], cliques: list[list[tuple[int, int]]], threshold: float = 0.66, most: int = 1000) -> dict[tuple[int, int], int]:
    """Alleles of (sample, allele) haplotypes at one SNP, spread through cliques from homozygous training samples.

    A queue begins with both haplotypes of each homozygous sample. Each popped one's clique takes the consensus of its
    known members; any member with a genotype, called in part or whole, of which just one haplotype is known is then
    completed from it and queued. A haplotype once known stays known, so a queue has at most two entries a sample."""
    ratio = threshold / (1 - threshold)
    group = {h: k for k, c in enumerate(cliques) for h in c}
    hap: dict[tuple[int, int], int] = {}
    queue: deque = deque()
    for s in sorted(genotype):
        a, b = genotype[s]
        if a and a == b:
            hap[s, 0] = hap[s, 1] = a
            queue += [(s, 0), (s, 1)]
    pops = 0
    while queue:
        pops += 1
        if pops > most:
            raise ValueError("the queue doesn't end")
        h = queue.popleft()
        members = cliques[group[h]] if h in group else [h]
        n1, n2 = (sum(hap.get(m) == v for m in members) for v in (1, 2))
        value = 1 if n1 >= ratio * n2 else 2 if n2 >= ratio * n1 else 0
        if value:
            hap.update((m, value) for m in members)
        for s in [m[0] for m in members]:
            own = hap.get((s, 0), 0), hap.get((s, 1), 0)
            if any(genotype.get(s, ())) and (own[0] == 0) != (own[1] == 0):
                side = 0 if own[0] else 1
                if other := other_allele(own[side], genotype[s][side], genotype[s][1 - side]):
                    hap[s, 1 - side] = other
                    queue.append((s, 1 - side))
    for s, (a, b) in genotype.items():
        known = (hap.get((s, 0), 0) != 0) + (hap.get((s, 1), 0) != 0)
        if (a != 0) + (b != 0) > known:
            hap[s, 0], hap[s, 1] = a, b
    return {h: v for h, v in hap.items() if v}


def impute_snps(place, smp, a0, a1, of, grp, member, allele, threshold: float = 0.66) -> tuple[np.ndarray, ...]:
    """``impute_snp`` for many SNPs at once: place, smp, allele, v of the known haplotypes, in that order.

    place, smp, a0, a1: the calls; of, grp, member, allele: the cliques' members (``of`` is their place). A haplotype in
    several cliques of a SNP acts through the last by grp. Each SNP has its own queue, and each step takes one haplotype
    from every queue that isn't empty, so the order within a SNP is that of ``impute_snp``."""
    ratio = threshold / (1 - threshold)
    order = np.lexsort((allele, member, grp, of))
    of, grp, member, allele = of[order], grp[order], member[order], allele[order]
    samples, code = np.unique(np.concatenate([smp, member]), return_inverse=True)
    keys, slot = np.unique(np.concatenate([place, of]) * len(samples) + code, return_inverse=True)
    at = keys // len(samples)
    n = len(keys)
    g = np.zeros((n, 2), np.int64)
    g[slot[: len(place)]] = np.column_stack([a0, a1])
    hap = np.zeros(2 * n, np.int64)

    # Cliques, and each haplotype without one by itself
    members = 2 * slot[len(place) :] + allele
    first = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (grp[1:] != grp[:-1])][: len(of)])
    size = np.diff(np.r_[first, len(of)])
    clique = np.full(2 * n, -1)
    np.maximum.at(clique, members, np.repeat(np.arange(len(first)), size))
    alone = np.flatnonzero(clique < 0)
    clique[alone] = len(first) + np.arange(len(alone))
    start, size = np.r_[first, len(of) + np.arange(len(alone))], np.r_[size, np.ones(len(alone), np.int64)]
    members = np.r_[members, alone]

    # Queues side by side: no haplotype comes twice, so each SNP has room for all of its own
    same = (g[:, 0] != 0) & (g[:, 0] == g[:, 1])
    hap[np.repeat(same, 2)] = np.repeat(g[same, 0], 2)
    queue = np.zeros(2 * n, np.int64)
    places = int(at[-1]) + 1 if n else 0
    head = 2 * np.searchsorted(at, np.arange(places))
    known = np.flatnonzero(np.repeat(same, 2))
    owner = at[known >> 1]
    count = np.bincount(owner, minlength=places)
    queue[head[owner] + _places(count)] = known
    tail = head + count
    live = np.flatnonzero(head < tail)
    while len(live):
        c = clique[queue[head[live]]]
        head[live] += 1
        width = size[c]
        begin = np.cumsum(width) - width
        owner = np.repeat(np.arange(len(live)), width)
        m = members[np.repeat(start[c], width) + _places(width)]
        n1, n2 = (np.add.reduceat(hap[m] == v, begin, dtype=np.int64) for v in (1, 2))
        value = np.where(n1 >= ratio * n2, 1, np.where(n2 >= ratio * n1, 2, 0))[owner]
        hap[m[value > 0]] = value[value > 0]
        s = m >> 1
        x, y = hap[2 * s], hap[2 * s + 1]
        half = np.flatnonzero(g[s].any(axis=1) & ((x == 0) != (y == 0)))
        s, side, h = s[half], (x[half] == 0).astype(np.int64), (x + y)[half]
        mine, yours = g[s, side], g[s, 1 - side]
        other = np.where((mine != 0) & (mine != h) & (mine != yours), mine, np.where((mine == h) | ((mine == 0) & (yours == 3 - h)), yours, 0))
        to = 2 * s + 1 - side
        once = np.sort(np.unique(to, return_index=True)[1])
        once = once[other[once] != 0]
        to, owner = to[once], owner[half][once]
        hap[to] = other[once]
        count = np.bincount(owner, minlength=len(live))
        queue[tail[live][owner] + _places(count)] = to
        tail[live] += count
        live = live[head[live] < tail[live]]
    both = hap.reshape(-1, 2)
    fuller = (g != 0).sum(axis=1) > (both != 0).sum(axis=1)
    both[fuller] = g[fuller]
    found = np.flatnonzero(hap)
    return at[found >> 1], samples[(keys % max(len(samples), 1))[found >> 1]], found & 1, hap[found]


def _places(count: np.ndarray) -> np.ndarray:
    """0, 1, .. for each of runs of these lengths."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def impute(calls: DataFrame, cliques: DataFrame, most: int = 1 << 17) -> DataFrame:
    """snp, smp, allele, v. cliques: snp, grp, smp, allele. A SNP comes in one row, and many are done at once, up to about
    ``most`` calls and members, as a call for each would cost more than its work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            snps, lists = batch.columns
            ends = lists.offsets.to_numpy()
            begin = 0
            while begin < len(snps):
                end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + most, "right")) - 1)
                yield imputed(snps.slice(begin, end - begin), lists.slice(begin, end - begin).flatten(), np.diff(ends[begin : end + 1]))
                begin = end

    def imputed(snps: pa.Array, rows: pa.StructArray, n: np.ndarray) -> pa.RecordBatch:
        member, grp, *rest = rows.flatten()
        if any(c.null_count for c in (snps, *rest)):
            raise ValueError("a call or a clique's member has a null")
        member = member.to_numpy(zero_copy_only=False)
        call, member = ~member, member & grp.is_valid().to_numpy(zero_copy_only=False)
        place, grp = np.repeat(np.arange(len(n)), n), grp.fill_null(0).to_numpy()
        smp, x, y = (c.to_numpy() for c in rest)
        if not np.isin(x[member], (0, 1)).all():
            raise ValueError("haplotypes of a sample are 0 and 1")
        at, *got = impute_snps(place[call], smp[call], x[call], y[call], place[member], grp[member], smp[member], x[member])
        types = (pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([snps.take(pa.array(at)), *(pa.array(c, t) for c, t in zip(got, types, strict=True))], ["snp", "smp", "allele", "v"])

    def packed(df: DataFrame, member: bool, grp: Column, x: Column, y: Column) -> DataFrame:
        return df.select(F.col("snp").cast("long"), F.struct(F.lit(member), grp.cast("long"), F.col("smp").cast("long"), x.cast("int"), y.cast("int")).alias("row"))

    rows = packed(calls, False, F.lit(None), F.col("a0"), F.col("a1")).union(packed(cliques, True, F.col("grp"), F.col("allele"), F.lit(0)))
    return rows.groupBy("snp").agg(F.collect_list("row").alias("rows")).mapInArrow(run, "snp long, smp long, allele int, v int")


def consensus(values: DataFrame, by: list[str], how: str = "majority") -> DataFrame:
    """Consensus of 0/1/2 alleles: the largest, or round-half-even of twice the mean of known ones where that is even."""
    known = F.nullif("v", F.lit(0))
    twice = F.bround(2 * F.avg(known))
    value = F.coalesce(F.max(known), F.lit(0)) if how == "max" else F.coalesce(F.when(twice % 2 == 0, twice / 2), F.lit(0)).cast("int")
    return values.groupBy(*by).agg(value.alias("v"))


def gene_drop(persons: list[tuple[int, int, int]], seed: int) -> dict[int, tuple[int, int]]:
    """Founder-allele labels of every person (id, father, mother; parents first), each transmitted by a fair draw."""
    rng = np.random.default_rng(seed)
    out: dict[int, tuple[int, int]] = {}
    for k, (i, father, mother) in enumerate(persons):
        pick = lambda parent, side, k=k: out[parent][rng.integers(2)] if parent in out else 2 * k + side
        out[i] = (pick(father, 0), pick(mother, 1))
    return out
