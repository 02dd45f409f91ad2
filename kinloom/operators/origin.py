"""Parent of origin: which of a sample's two haplotypes came from the father, by kinship with the haplotypes' relatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _median(values: Column) -> Column:
    v, n = F.array_sort(values), F.size(values)
    at = lambda k: F.get(v, F.floor(k).cast("int"))
    return F.when(n > 0, (at((n - 1) / 2) + at(n / 2)) / 2)


def flip_measure(cliques: DataFrame, founders: DataFrame, kin: DataFrame, least: int = 3) -> DataFrame:
    """place, smp, n0, n1, sep of each quasi-founder at each place where both of its cliques have ``least`` members.

    ``cliques``: place, smp, allele, grp, haplotypes that descend from one; ``founders``: smp, father, mother of the
    quasi-founders, all others and the sample's own sibs don't count as members; ``kin``: id, smp, k, a parent's kinship with
    a sample (pairs that are absent don't count in the medians). sep, from -1 to 1, is the logarithm l of the ratio of the
    diagonals of the 2 x 2 median kinships, as l / (1 + abs(l)); null where a median isn't positive. Members are kept as one
    array for each clique, bounded by the number of samples, and pairs of members are never rows."""
    own = cliques.join(founders.select("smp"), "smp", "left_semi")
    members = own.groupBy("place", "grp").agg(F.collect_set("smp").alias("members"))
    sibs = founders.groupBy("father", "mother").agg(F.collect_set("smp").alias("sibs"))
    maps = kin.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("smp", "k"))).alias("k"))
    side = lambda p: maps.select(F.col("id").alias(p), F.col("k").alias(f"{p}_k"))
    family = founders.join(sibs, ["father", "mother"]).join(side("father"), "father").join(side("mother"), "mother")
    rows = own.join(members, ["place", "grp"]).join(family.select("smp", "sibs", "father_k", "mother_k"), "smp")
    rows = rows.withColumn("others", F.array_except("members", "sibs"))
    known = lambda p: F.filter(F.transform("others", lambda x: F.try_element_at(F.col(f"{p}_k"), x)), lambda x: x.isNotNull())
    rows = rows.select("place", "smp", "allele", F.size("others").cast("long").alias("n"), _median(known("father")).alias("f"), _median(known("mother")).alias("m"))
    of = lambda c, a: F.max(F.when(F.col("allele") == a, F.col(c))).alias(f"{c}{a}")
    both = rows.groupBy("place", "smp").agg(*[of(c, a) for c in "nfm" for a in (0, 1)]).where((F.col("n0") >= least) & (F.col("n1") >= least))
    up, down = F.col("f0") * F.col("m1"), F.col("m0") * F.col("f1")
    log = F.when((up > 0) & (down > 0), F.ln(up / down))
    return both.select("place", "smp", "n0", "n1", (log / (1 + F.abs(log))).alias("sep"))


def flip_decision(measure: DataFrame, threshold: float = 0.25, agreement: float = 0.9) -> DataFrame:
    """smp, n_plus, n_minus, n, m, phase: places beyond the threshold on either side, the larger one's share of them, and the
    side that at least ``agreement`` of them take (1: as it is, -1: to be flipped, 0: undetermined; a tie is -1's)."""
    plus, minus = F.count_if(F.col("sep") > threshold), F.count_if(F.col("sep") < -threshold)
    out = measure.groupBy("smp").agg(plus.alias("n_plus"), minus.alias("n_minus"), F.count("*").alias("n"))
    m = F.greatest("n_plus", "n_minus") / (F.col("n_plus") + F.col("n_minus") + 1e-15)
    side = F.when(F.col("n_plus") > F.col("n_minus"), 1).otherwise(-1)
    return out.select("*", m.alias("m"), F.when(m >= agreement, side).otherwise(0).alias("phase"))
