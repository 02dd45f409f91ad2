"""Counts, rates, concordance and association over genotype tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.functions import recode as rc

NINE = {"NN": (0, 0), "N0": (0, 1), "N1": (0, 2), "0N": (1, 0), "00": (1, 1), "01": (1, 2), "1N": (2, 0), "10": (2, 1), "11": (2, 2)}


def genotype_counts(recoded: DataFrame, by: str = "snp") -> DataFrame:
    return recoded.groupBy(by).agg(*[F.count_if(F.col("g") == g).alias(n) for g, n in ((2, "n11"), (3, "n12"), (4, "n22"), (0, "n00"))])


def call_rate(recoded: DataFrame, by: str) -> DataFrame:
    filled = (F.col("a0") != 0).cast("int") + (F.col("a1") != 0).cast("int")
    return recoded.groupBy(by).agg(F.round(F.avg(rc.called(F.col("g")).cast("double")), 6).alias("call_rate"), F.round(F.sum(filled) / (2.0 * F.count("*")), 6).alias("fill"))


def nine_way(calls: DataFrame, by: str) -> DataFrame:
    """Counts of the nine genotypes, allele rate and genotype rate."""
    n = F.count("*").cast("double")
    counts = [F.count_if((F.col("a0") == a) & (F.col("a1") == b)).alias(f"c{k}") for k, (a, b) in NINE.items()]
    rate = F.round(1 - F.count_if((F.col("a0") == 0) & (F.col("a1") == 0)) / n, 6)
    return calls.groupBy(by).agg(*counts, rate.alias("allele_rate"), F.round(F.count_if((F.col("a0") != 0) & (F.col("a1") != 0)) / n, 6).alias("genotype_rate"))


def concordance(pairs: DataFrame, by: str) -> DataFrame:
    """Share of equal genotypes among those called in both; 1 without any."""
    both = (F.col("x") > 0) & (F.col("y") > 0)
    return pairs.groupBy(by).agg(F.round(F.coalesce(F.avg(F.when(both, (F.col("x") == F.col("y")).cast("double"))), F.lit(1.0)), 6).alias("concordance"))


def by_maf(recoded: DataFrame, bins: int) -> DataFrame:
    """SNPs and their mean call rate in bins of minor allele frequency, by integer arithmetic."""
    c = recoded.groupBy("snp").agg(*[F.count_if(F.col("g") == g).alias(n) for g, n in ((2, "n11"), (3, "n12"), (4, "n22"))], F.count_if(F.col("g") > 0).alias("n"), F.count("*").alias("m")).where("n > 0")
    minor = F.least(2 * F.col("n11") + F.col("n12"), 2 * F.col("n22") + F.col("n12"))
    return c.groupBy(F.floor(minor * bins / (2 * F.col("n"))).alias("bin")).agg(F.count("*").alias("snps"), F.round(F.avg(F.col("n") / F.col("m")), 6).alias("mean_call_rate"))


def hap_differences(haps: DataFrame) -> DataFrame:
    """Positions in common and those that differ, for each pair of samples."""
    a, b = haps.select("snp", F.col("smp").alias("x"), F.col("v").alias("va")), haps.select("snp", F.col("smp").alias("y"), F.col("v").alias("vb"))
    differ = rc.hap_diff(F.col("va"), F.col("vb")) == 1
    return a.join(b, "snp").where("x < y").groupBy("x", "y").agg(F.count("*").alias("snps"), F.count_if(differ).alias("differ"))


def symmetric(segments: DataFrame) -> DataFrame:
    """Each segment seen from both haplotypes: s, a with partner t, b."""
    one = segments.select(F.col("s0").alias("s"), F.col("a0").alias("a"), F.col("s1").alias("t"), F.col("a1").alias("b"), "snp_start", "snp_stop")
    return one.union(segments.select("s1", "a1", "s0", "a0", "snp_start", "snp_stop"))


def by_snp(calls: DataFrame, *columns: str) -> DataFrame:
    """One row a SNP: snp, at, a map from sample to a struct of the columns. Relatives are then looked up in place."""
    return calls.groupBy("snp").agg(F.map_from_entries(F.collect_list(F.struct("smp", F.struct(*columns)))).alias("at"))


def trio_kinds(kids: DataFrame) -> DataFrame:
    """The different (smp, father_smp, mother_smp) of some children: what follows from samples is computed once each."""
    return kids.select("smp", "father_smp", "mother_smp").distinct()


def with_samples(persons: DataFrame, samples: DataFrame) -> DataFrame:
    """persons with smp, father_smp and mother_smp (null: none) from samples: id, smp. A father or mother of 0 is none."""
    side = lambda p: samples.where("id <> 0").select(F.col("id").alias(p), F.col("smp").alias(f"{p}_smp"))
    return persons.join(samples, "id", "left").join(side("father"), "father", "left").join(side("mother"), "mother", "left")


def mendel_errors(persons: DataFrame, calls: DataFrame) -> DataFrame:
    """Inconsistent trios: a heterozygous child of equal homozygous parents, or one homozygous against a parent.
    ``persons``: id, smp, father_smp, mother_smp. Genotypes are read once, a row for each SNP."""
    kids = persons.where("smp is not null and father_smp is not null and mother_smp is not null")
    rows = by_snp(calls, "a0", "a1").select("at", F.explode(F.map_keys("at")).alias("smp")).join(trio_kinds(kids), "smp")
    own = {p: F.try_element_at("at", F.col(c)) for p, c in (("id", "smp"), ("father", "father_smp"), ("mother", "mother_smp"))}
    rows = rows.select("smp", "father_smp", "mother_smp", *[x.alias(p) for p, x in own.items()]).where("father is not null and mother is not null")
    hom = lambda p: rc.homozygous(F.col(f"{p}.a0"), F.col(f"{p}.a1"))
    het = hom("father") & hom("mother") & (F.col("father.a0") == F.col("mother.a0")) & rc.heterozygous(F.col("id.a0"), F.col("id.a1"))
    against = lambda p: hom(p) & hom("id") & (F.col(f"{p}.a0") != F.col("id.a0"))
    kinds = rows.groupBy("smp", "father_smp", "mother_smp").agg(F.count_if(het).alias("het_of_equal_homs"), F.count_if(against("father")).alias("opposite_father"), F.count_if(against("mother")).alias("opposite_mother"))
    return kids.join(kinds, ["smp", "father_smp", "mother_smp"]).select("id", "het_of_equal_homs", "opposite_father", "opposite_mother")


def r2(genotypes: DataFrame, reach: int, least: int) -> DataFrame:
    """Squared correlation, in units of 1e-5, of SNPs at most ``reach`` apart over their common samples; integers all
    the way, so that no rounding depends on the order of rows."""
    a = genotypes.select("smp", F.col("snp").alias("snp1"), F.col("g").cast("long").alias("x"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(reach)), lambda k: F.col("snp") + k)).alias("snp2"))
    b = genotypes.select("smp", F.col("snp").alias("snp2"), F.col("g").cast("long").alias("y"))
    total = lambda c, name: F.sum(c).alias(name)
    x, y = F.col("x"), F.col("y")
    out = a.join(b, ["smp", "snp2"]).groupBy("snp1", "snp2").agg(F.count("*").alias("n"), total(x, "sx"), total(y, "sy"), total(x * x, "sxx"), total(y * y, "syy"), total(x * y, "sxy"))
    out = out.select("snp1", "snp2", "n", *[F.expr(e) for e in ("n*sxy-sx*sy AS c", "n*sxx-sx*sx AS vx", "n*syy-sy*sy AS vy")])
    return out.where((F.col("n") >= least) & (F.col("vx") > 0) & (F.col("vy") > 0)).select("snp1", "snp2", "n", F.expr("c*c*100000 div (vx*vy)").alias("r2_e5"))


def override(imputed: DataFrame, typed: DataFrame) -> DataFrame:
    """Typed genotypes where they have more called alleles, tagged 0; else the imputed ones."""
    n = lambda a, b: (F.col(a) != 0).cast("int") + (F.col(b) != 0).cast("int")
    more = F.coalesce(n("b0", "b1") < n("a0", "a1"), F.lit(False))
    j = imputed.join(typed, ["snp", "smp"], "left")
    return j.select("snp", "smp", F.when(more, F.col("a0")).otherwise(F.col("b0")).alias("o0"), F.when(more, F.col("a1")).otherwise(F.col("b1")).alias("o1"), F.when(more, 0).otherwise(F.col("tag")).alias("tag"))


def poo_counts(imputed: DataFrame) -> DataFrame:
    """Heterozygotes by known parent of origin, call rate and minor allele frequency (-1 without calls)."""
    b0, b1, tag = F.col("b0"), F.col("b1"), F.col("tag")
    full = (b0 != 0) & (b1 != 0)
    n = F.count_if(full)
    share = F.sum(F.when(full, b0 + b1 - 2).otherwise(0)) / (2.0 * n)
    return imputed.groupBy("snp").agg(
        F.count_if((tag == 2) & (b0 == 2) & (b1 == 1)).alias("n221"), F.count_if((tag == 2) & (b0 == 1) & (b1 == 2)).alias("n212"),
        F.count_if(tag.isin(0, 1) & full & (b0 != b1)).alias("other_het"), F.round(F.avg(full.cast("double")), 6).alias("call_rate"),
        F.when(n == 0, F.lit(-1.0)).otherwise(F.round(F.least(share, 1 - share), 6)).alias("maf"),
    )


def identity_states(bits: DataFrame) -> DataFrame:
    """Masks of which haplotypes of a pair are identical at a place, and how often each occurs."""
    return bits.groupBy("k", "x").agg(F.bit_or("bit").alias("mask")).groupBy("mask").agg(F.count("*").alias("n"))


def slice_matches(haps: DataFrame, size: int) -> DataFrame:
    """Pairs of samples with equal words of alleles over slices of ``size`` positions."""
    word = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("snp", "v"))), lambda x: x["v"].cast("string")), "")
    w = haps.groupBy("smp", F.floor(F.col("snp") / size).alias("slice")).agg(word.alias("word"), F.sum("snp").alias("sig"))
    a, b = w.withColumnRenamed("smp", "x"), w.withColumnRenamed("smp", "y")
    return a.join(b, ["slice", "word", "sig"]).where("x < y").groupBy("x", "y").agg(F.count("*").alias("slices"))
