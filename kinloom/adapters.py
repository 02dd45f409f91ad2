"""Genomic relations made of the star-schema test tables, by integer arithmetic on all their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLES = 64
BP = 10_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _allele(k):
    return F.when(k == 0, 0).when(k < 7, 1).otherwise(2).cast("int")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """snp, smp, a0, a1: a genotype for each part and group of suppliers that occur together."""
    pairs = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("snp"), (F.col("l_suppkey") % SAMPLES).alias("smp")).distinct()
    return pairs.select("snp", "smp", _allele((F.col("snp") * 7 + F.col("smp") * 13) % 11).alias("a0"), _allele((F.col("snp") * 5 + F.col("smp") * 3) % 11).alias("a1"))


def imputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """snp, smp, b0, b1, tag: another version of the same genotypes, with some alleles missing or different."""
    c = calls(spark, sf_dir)
    k = (F.col("snp") * 3 + F.col("smp") * 11) % 13
    b = lambda a, gone: F.when(k == gone, 0).when(k == 7, F.when(F.col(a) == 0, 0).otherwise(3 - F.col(a))).otherwise(F.col(a)).cast("int")
    return c.select("snp", "smp", b("a0", 2).alias("b0"), b("a1", 3).alias("b1"), ((F.col("snp") + F.col("smp")) % 5).cast("int").alias("tag"))


def haps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """snp, smp, v: one allele at each SNP, in long runs shared between samples."""
    pairs = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("snp"), (F.col("l_suppkey") % 12).alias("smp")).distinct()
    f = (F.col("smp") + F.floor(F.col("snp") / 50)) % 8
    v = 1 + ((f * 3 + F.col("snp") * 7 + (f * F.col("snp")) % 5) % 3) % 2
    return pairs.select("snp", "smp", v.cast("int").alias("v"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair segments: snp_start, snp_stop, bp_start, bp_stop (half-open), s0, a0, s1, a1."""
    li = load(spark, sf_dir, "lineitem")
    start, stop = F.col("l_orderkey"), F.col("l_orderkey") + F.col("l_quantity").cast("long")
    out = li.select(
        start.alias("snp_start"), stop.alias("snp_stop"), (start * BP).alias("bp_start"), (stop * BP).alias("bp_stop"),
        (F.col("l_suppkey") % 50).alias("s0"), (F.col("l_linenumber") % 2).cast("int").alias("a0"),
        (F.col("l_partkey") % 50).alias("s1"), F.when(F.col("l_partkey") % 100 >= 50, 1).otherwise(0).alias("a1"),
    )
    return out.where("s0 <> s1")


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, father, mother (0: none), sex, genotyped: customers as a pedigree of fixed couples."""
    k = F.col("c_custkey")
    pair = F.floor(k / 4) - F.floor(k / 4) % 2
    child = k >= 50
    return load(spark, sf_dir, "customer").select(
        k.alias("id"), F.when(child, pair).otherwise(0).cast("long").alias("father"),
        F.when(child & (k % 37 != 0), pair + 1).otherwise(0).cast("long").alias("mother"),
        (1 + k % 2).cast("int").alias("sex"), (k % 3 != 0).alias("genotyped"),
    )


def ld_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """snp1, snp2, r2 between parts that are close by key."""
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("snp1"))
    pairs = part.select("snp1", F.explode(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: F.col("snp1") + k)).alias("snp2")).join(part.select(F.col("snp1").alias("snp2")), "snp2", "left_semi")
    k = ((F.col("snp1") + F.col("snp2")) * 17) % 10
    return pairs.where(k < 4).select("snp1", "snp2", (0.6 + k / 10).alias("r2"))


def snps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """snp, bp, name of typed SNPs."""
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("snp"), (F.col("p_partkey") * BP).alias("bp"), F.col("p_name").alias("name"))


#: The same relations for DuckDB.
SQL = {
    "calls": """calls AS (SELECT snp, smp,
  CASE WHEN (snp*7+smp*13)%11=0 THEN 0 WHEN (snp*7+smp*13)%11<7 THEN 1 ELSE 2 END AS a0,
  CASE WHEN (snp*5+smp*3)%11=0 THEN 0 WHEN (snp*5+smp*3)%11<7 THEN 1 ELSE 2 END AS a1
  FROM (SELECT DISTINCT l_partkey AS snp, l_suppkey%64 AS smp FROM lineitem))""",
    "imputed": """imputed AS (SELECT snp, smp,
  CASE WHEN (snp*3+smp*11)%13=2 THEN 0 WHEN (snp*3+smp*11)%13=7 THEN CASE WHEN a0=0 THEN 0 ELSE 3-a0 END ELSE a0 END AS b0,
  CASE WHEN (snp*3+smp*11)%13=3 THEN 0 WHEN (snp*3+smp*11)%13=7 THEN CASE WHEN a1=0 THEN 0 ELSE 3-a1 END ELSE a1 END AS b1,
  CAST((snp+smp)%5 AS INTEGER) AS tag FROM calls)""",
    "haps": """haps AS (SELECT snp, smp, CAST(1+((f*3+snp*7+(f*snp)%5)%3)%2 AS INTEGER) AS v FROM
  (SELECT snp, smp, (smp+snp//50)%8 AS f FROM (SELECT DISTINCT l_partkey AS snp, l_suppkey%12 AS smp FROM lineitem)))""",
    "segments": """segments AS (SELECT l_orderkey AS snp_start, l_orderkey+CAST(l_quantity AS BIGINT) AS snp_stop,
  l_orderkey*10000 AS bp_start, (l_orderkey+CAST(l_quantity AS BIGINT))*10000 AS bp_stop, l_suppkey%50 AS s0,
  CAST(l_linenumber%2 AS INTEGER) AS a0, l_partkey%50 AS s1, CASE WHEN l_partkey%100>=50 THEN 1 ELSE 0 END AS a1
  FROM lineitem WHERE l_suppkey%50 <> l_partkey%50)""",
    "persons": """persons AS (SELECT c_custkey AS id, CASE WHEN c_custkey>=50 THEN c_custkey//4-(c_custkey//4)%2 ELSE 0 END AS father,
  CASE WHEN c_custkey>=50 AND c_custkey%37<>0 THEN c_custkey//4-(c_custkey//4)%2+1 ELSE 0 END AS mother,
  CAST(1+c_custkey%2 AS INTEGER) AS sex, c_custkey%3<>0 AS genotyped FROM customer)""",
    "parents": """parents AS (SELECT father AS parent, id AS child, 0 AS typ FROM persons WHERE father<>0
  UNION ALL SELECT mother, id, 1 FROM persons WHERE mother<>0)""",
    "ld": """ld AS (SELECT a.p_partkey AS snp1, b.p_partkey AS snp2, 0.6+(((a.p_partkey+b.p_partkey)*17)%10)/10.0 AS r2
  FROM part a JOIN part b ON b.p_partkey BETWEEN a.p_partkey+1 AND a.p_partkey+5 WHERE ((a.p_partkey+b.p_partkey)*17)%10<4)""",
    "snps": "snps AS (SELECT p_partkey AS snp, p_partkey*10000 AS bp, p_name AS name FROM part)",
}


def with_sql(names: str, body: str, recursive: bool = False) -> str:
    if "imputed" in names.split() and "calls" not in names.split():
        names = "calls " + names
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(SQL[n] for n in names.split()) + "\n" + body
