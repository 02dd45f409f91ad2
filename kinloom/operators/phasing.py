"""The relational stages of phasing: what follows from one genotype, and from trios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.functions import recode as rc
from kinloom.operators import stats


def from_homozygous(calls: DataFrame) -> DataFrame:
    """h0, h1 of homozygous genotypes, 0 of others."""
    g0, g1 = F.col("a0"), F.col("a1")
    h = F.when(rc.homozygous(g0, g1), g0).otherwise(0)
    return calls.select("*", h.alias("h0"), h.alias("h1"))


def from_parents(phased: DataFrame, kinds: DataFrame) -> DataFrame:
    """A homozygous father fixes the first haplotype of a child, then a homozygous mother the second; the other one
    follows from the child's genotype. Alleles that the child's genotype doesn't have are left out. ``phased``: snp, smp,
    a0, a1, h0, h1; ``kinds``: smp, father_smp, mother_smp (null: none). A row for each kind of trio and SNP."""
    rows = stats.by_snp(phased, "a0", "a1", "h0", "h1").select("snp", "at", F.explode("at").alias("smp", "own")).join(kinds, "smp")
    side = lambda p: F.try_element_at("at", F.col(f"{p}_smp"))
    same = lambda p: F.when(side(p)["h0"] == side(p)["h1"], side(p)["h0"]).alias(f"{p}_v")
    j = rows.select("snp", "smp", "father_smp", "mother_smp", "own.*", same("father"), same("mother"))
    g0, g1 = F.col("a0"), F.col("a1")
    take = lambda h, v: F.when((F.col(h) == 0) & ((F.col(v) == g0) | (F.col(v) == g1)) & (F.col(v) != 0), F.col(v)).otherwise(F.col(h))
    j = j.withColumn("h0", take("h0", "father_v")).withColumn("h1", rc.complete_haplotype(F.col("h1"), F.col("h0"), g0, g1))
    j = j.withColumn("h1", take("h1", "mother_v")).withColumn("h0", rc.complete_haplotype(F.col("h0"), F.col("h1"), g0, g1))
    return j.drop("father_v", "mother_v")


def trio_errors(calls: DataFrame, kinds: DataFrame) -> DataFrame:
    """snp, smp of children whose genotype their parents can't have given: heterozygous of equal homozygous parents, or
    homozygous against a homozygous parent."""
    rows = stats.by_snp(calls, "a0", "a1").select("snp", "at", F.explode("at").alias("smp", "own")).join(kinds, "smp")
    side = lambda p: F.try_element_at("at", F.col(f"{p}_smp"))
    hom = lambda c: rc.homozygous(c["a0"], c["a1"])
    own = F.col("own")
    het = hom(side("father")) & hom(side("mother")) & (side("father")["a0"] == side("mother")["a0"]) & rc.heterozygous(own["a0"], own["a1"])
    against = [hom(side(p)) & hom(own) & (side(p)["a0"] != own["a0"]) for p in ("father", "mother")]
    bad = F.coalesce(het, F.lit(False)) | F.coalesce(against[0], F.lit(False)) | F.coalesce(against[1], F.lit(False))
    return rows.where(bad).select("snp", "smp").distinct()


def clear_errors(phased: DataFrame, errors: DataFrame) -> DataFrame:
    """Zero genotype and haplotypes where (snp, smp) is an error."""
    marked = phased.join(errors.select("snp", "smp", F.lit(True).alias("bad__")).distinct(), ["snp", "smp"], "left")
    return marked.select(*[F.when(F.col("bad__"), F.lit(0)).otherwise(F.col(c)).alias(c) if c in ("a0", "a1", "h0", "h1") else F.col(c) for c in phased.columns])


def impute_parents(calls: DataFrame, haps: DataFrame, family: DataFrame) -> DataFrame:
    """snp, smp, a0, a1 with a parent's first missing allele taken from a child both of whose haplotypes are known; of
    several children the last one's. ``haps``: snp, smp, h0 (the father's), h1; ``family``: smp, father, mother (null:
    none). A sample is father only or mother only."""
    child = haps.where("h0 <> 0 and h1 <> 0").join(family, "smp")
    given = child.select("snp", F.inline(F.array(F.struct(F.col("father").alias("parent"), F.col("h0").alias("v")), F.struct(F.col("mother").alias("parent"), F.col("h1").alias("v")))), F.col("smp").alias("child"))
    last = given.where("parent is not null").groupBy("snp", F.col("parent").alias("smp")).agg(F.max_by("v", "child").alias("v"))
    a0, a1, v = F.col("a0"), F.col("a1"), F.col("v")
    j = calls.join(last, ["snp", "smp"], "left")
    return j.select("snp", "smp", F.when((a0 == 0) & v.isNotNull(), v).otherwise(a0).alias("a0"), F.when((a0 != 0) & (a1 == 0) & v.isNotNull(), v).otherwise(a1).alias("a1"))


def fill_rates(phased: DataFrame, *by: str) -> DataFrame:
    filled = (F.col("h0") != 0).cast("int") + (F.col("h1") != 0).cast("int")
    return phased.groupBy(*by).agg(F.sum(filled).alias("filled"), (2 * F.count("*")).alias("total"))
