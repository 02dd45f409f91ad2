"""Readers and writers of the text layouts of genotype data, and the same as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_tfam(spark: SparkSession, path: str) -> DataFrame:
    """family, id, father, mother, sex, phenotype of a space-separated pedigree."""
    c = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(c[0].alias("family"), *[c[k + 1].cast("long").alias(n) for k, n in enumerate(("id", "father", "mother", "sex", "phenotype"))])


def write_tfam(persons: DataFrame, path: str) -> None:
    persons.select(F.concat_ws(" ", "family", *[F.col(c).cast("string") for c in ("id", "father", "mother", "sex", "phenotype")])).write.text(path)


def read_tped(spark: SparkSession, path: str) -> DataFrame:
    """chrom, name, cm, bp, pos (sample place), a0, a1: a row for each SNP and sample."""
    c = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where("trim(value) <> ''").select(c[0].cast("int").alias("chrom"), c[1].alias("name"), c[2].cast("double").alias("cm"), c[3].cast("long").alias("bp"), F.slice(c, 5, F.size(c)).alias("cells"))
    pairs = F.transform(F.sequence(F.lit(0), (F.size("cells") / 2 - 1).cast("int")), lambda k: F.struct(F.get("cells", (2 * k).cast("int")).cast("int").alias("a0"), F.get("cells", (2 * k + 1).cast("int")).cast("int").alias("a1")))
    return rows.select("chrom", "name", "cm", "bp", F.posexplode(pairs)).select("chrom", "name", "cm", "bp", "pos", "col.a0", "col.a1")


def write_tped(calls: DataFrame, path: str) -> None:
    cells = F.transform(F.array_sort(F.collect_list(F.struct("pos", "a0", "a1"))), lambda x: F.concat_ws(" ", x["a0"].cast("string"), x["a1"].cast("string")))
    rows = calls.groupBy("chrom", "name", "cm", "bp").agg(F.array_join(cells, " ").alias("cells"))
    rows.select(F.concat_ws(" ", F.col("chrom").cast("string"), "name", F.col("cm").cast("string"), F.col("bp").cast("string"), "cells")).write.text(path)


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """variant_id, chrom, start, stop, kind, ref, alt, xref, pos, tag, a0, a1 of a tab-separated table whose cells are two
    letters of 0, 1, N, after a tag digit in imputed ones."""
    c = F.split("value", "\t")
    names = ("variant_id", "chr", "start", "stop", "kind", "ref", "alt", "xref")
    rows = spark.read.text(path).select(*[c[k].alias(n) for k, n in enumerate(names)], F.posexplode(F.slice(c, 9, F.size(c))).alias("pos", "cell"))
    letters, code = F.substring("cell", -2, 2), lambda x: F.translate(x, "N01", "012").cast("int")
    return rows.select(
        F.col("variant_id").cast("long").alias("variant_id"), F.regexp_extract("chr", r"^(?:chr)?(\w+)$", 1).alias("chrom"), F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"),
        "kind", "ref", "alt", "xref", "pos", F.when(F.length("cell") == 3, F.substring("cell", 1, 1).cast("int")).alias("tag"), code(F.substring(letters, 1, 1)).alias("a0"), code(F.substring(letters, 2, 1)).alias("a1"),
    )


def write_variants(calls: DataFrame, path: str) -> None:
    letter = lambda a: F.translate(a.cast("string"), "012", "N01")
    cell = F.transform(F.array_sort(F.collect_list(F.struct("pos", "tag", "a0", "a1"))), lambda x: F.concat(F.coalesce(x["tag"].cast("string"), F.lit("")), letter(x["a0"]), letter(x["a1"])))
    head = ("variant_id", "chrom", "start", "stop", "kind", "ref", "alt", "xref")
    rows = calls.groupBy(*head).agg(F.array_join(cell, "\t").alias("cells"))
    rows.select(F.concat_ws("\t", F.col("variant_id").cast("string"), F.concat(F.lit("chr"), "chrom"), *[F.col(c).cast("string") for c in head[2:]], "cells")).write.text(path)


_SEGMENT = ("snp_start", "snp_stop", "bp_start", "bp_stop", "s0", "a0", "s1", "a1")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    c = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(*[c[k].cast("long").alias(n) for k, n in enumerate(_SEGMENT)])


def write_segments(segments: DataFrame, path: str) -> None:
    """Each pair once, the smaller sample first."""
    first = F.col("s0") < F.col("s1")
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    out = segments.select(*_SEGMENT[:4], pick("s0", "s1").alias("s0"), pick("a0", "a1").alias("a0"), pick("s1", "s0").alias("s1"), pick("a1", "a0").alias("a1")).distinct()
    out.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in _SEGMENT])).write.text(path)


def read_ibdld(spark: SparkSession, path: str) -> DataFrame:
    """fam, id1, id2, chrom and start, stop, snp1, snp2, n, kb of each group of six fields of ragged lines."""
    c = F.split("value", "\t")
    rows = spark.read.text(path).select(c[0].alias("fam"), c[1].cast("long").alias("id1"), c[2].cast("long").alias("id2"), c[3].cast("int").alias("chrom"), c.alias("c"))
    rows = rows.where("size(c) >= 10").select("fam", "id1", "id2", "chrom", "c", F.explode(F.sequence(F.lit(4), F.size("c") - 6, F.lit(6))).alias("k"))
    kinds = ("long", "long", "string", "string", "int", "double")
    return rows.select("fam", "id1", "id2", "chrom", *[F.get("c", F.col("k") + i).cast(t).alias(n) for i, (n, t) in enumerate(zip(("start", "stop", "snp1", "snp2", "n", "kb"), kinds, strict=True))])


def read_vcf(spark: SparkSession, path: str, least_quality: int = 30) -> DataFrame:
    """chrom, bp, ref, alt, pos, a0, a1 of biallelic calls on autosomes; calls of low quality are missing."""
    c = F.split("value", "\t")
    keys = F.split(c[8], ":")
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.regexp_replace(c[0], "^chr", "").alias("chrom"), c[1].cast("long").alias("bp"), c[3].alias("ref"), c[4].alias("alt"), keys.alias("keys"), F.posexplode(F.slice(c, 10, F.size(c))).alias("pos", "cell"))
    field = lambda name: F.get(F.split("cell", ":"), (F.array_position("keys", name) - 1).cast("int"))
    good = F.coalesce(field("GQ").cast("int") >= least_quality, F.lit(True))
    gt = F.split(field("GT"), "[/|]")
    allele = lambda x: F.when(~good | x.isNull() | (x == "."), 0).otherwise(x.cast("int") + 1)
    return rows.where(F.col("chrom").rlike("^[0-9]+$")).select("chrom", "bp", "ref", "alt", "pos", allele(F.get(gt, F.lit(0))).alias("a0"), allele(F.get(gt, F.lit(1))).alias("a1"))


def write_lgen(calls: DataFrame, path: str) -> None:
    calls.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in ("smp", "snp", "a0", "a1")])).write.text(path)


def write_impute2(calls: DataFrame, path: str) -> None:
    """Cells ?, 0, 1 for alleles 0, 1, 2; genotypes called in part are cleared."""
    part = (F.col("a0") == 0) | (F.col("a1") == 0)
    code = lambda a: F.translate(F.when(part, 0).otherwise(F.col(a)).cast("string"), "012", "?01")
    cell = F.array_sort(F.collect_list(F.struct("smp", F.concat_ws(" ", code("a0"), code("a1")).alias("c"))))
    calls.groupBy("snp").agg(F.array_join(F.transform(cell, lambda x: x["c"]), " ").alias("cells")).select(F.concat_ws(" ", F.col("snp").cast("string"), "cells")).write.text(path)


def write_long(calls: DataFrame, path: str) -> None:
    """A line snp,sample,allele,allele for each genotype."""
    calls.select(F.concat_ws(",", *[F.col(c).cast("string") for c in ("snp", "smp", "a0", "a1")])).write.text(path)


def read_segment_sets(spark: SparkSession, path: str) -> DataFrame:
    """snp_start, snp_stop, bp_start, bp_stop, haps (an array of smp, allele) of lines of numbers."""
    c = F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("long"))
    rows = spark.read.text(path).where("trim(value) <> ''").select(c.alias("c"))
    haps = F.transform(F.sequence(F.lit(2), (F.size("c") / 2 - 1).cast("int")), lambda k: F.struct(F.get("c", 2 * k).alias("smp"), F.get("c", 2 * k + 1).alias("allele")))
    return rows.select(*[F.col("c")[k].alias(n) for k, n in enumerate(_SEGMENT[:4])], F.when(F.size("c") > 4, haps).otherwise(F.slice(haps, 1, 0)).alias("haps"))


def write_segment_sets(segments: DataFrame, path: str) -> None:
    haps = F.transform("haps", lambda h: F.concat_ws(" ", h["smp"].cast("string"), h["allele"].cast("string")))
    segments.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in _SEGMENT[:4]], haps)).write.text(path)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """chrom, snps (in the order of the line): a frame of independent SNPs a line. A chromosome may have many."""
    c = F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("long"))
    return spark.read.text(path).where("trim(value) <> ''").select(c.alias("c")).select(F.col("c")[0].alias("chrom"), F.slice("c", 2, F.size("c")).alias("snps"))


def write_frames(frames: DataFrame, path: str) -> None:
    frames.select(F.concat_ws(" ", F.col("chrom").cast("string"), F.transform("snps", lambda x: x.cast("string")))).write.text(path)


def kinship_lines(pairs: DataFrame) -> DataFrame:
    """place, line of a matrix layout of symmetric values id1, id2, k: a line of ids in order, then one of values for each
    (0 where a pair is absent). A line is as long as there are ids."""
    both = pairs.select("id1", "id2", "k").union(pairs.select("id2", "id1", "k").where("id1 <> id2"))
    ids = both.select(F.col("id1").alias("id")).distinct().agg(F.array_sort(F.collect_set("id")).alias("ids"))
    rows = both.groupBy("id1").agg(F.map_from_entries(F.collect_set(F.struct("id2", "k"))).alias("k")).crossJoin(F.broadcast(ids))
    value = lambda i: F.coalesce(F.try_element_at(F.col("k"), i), F.lit(0.0)).cast("string")
    lines = rows.select(F.array_position("ids", F.col("id1")).alias("place"), F.array_join(F.transform("ids", value), " ").alias("line"))
    return ids.select(F.lit(0).cast("long").alias("place"), F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("line")).union(lines)


def transpose(matrix: DataFrame) -> DataFrame:
    """row, cells of a text matrix (row, cells) turned over."""
    cells = matrix.select("row", F.posexplode("cells").alias("column", "cell"))
    return cells.groupBy(F.col("column").alias("row")).agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "cell"))), lambda x: x["cell"]).alias("cells"))
