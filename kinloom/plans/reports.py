"""Reports, filters, lookups and recodes over genotype tables and their annotations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinloom import adapters as ad
from kinloom.adapters import with_sql
from kinloom.functions import recode as rc
from kinloom.operators import joins
from kinloom.plans.register import query

_R = "r AS (SELECT *, CASE WHEN a0=0 OR a1=0 THEN -(a0+a1) ELSE a0+a1 END AS g FROM calls)"
_J = """j AS (SELECT snp, smp, a0, a1, b0, b1, tag, CASE WHEN a0=0 OR a1=0 THEN -(a0+a1) ELSE a0+a1 END AS x,
  CASE WHEN b0=0 OR b1=0 THEN -(b0+b1) ELSE b0+b1 END AS y FROM calls JOIN imputed USING (snp, smp))"""


def _recoded(s, d) -> DataFrame:
    return ad.calls(s, d).withColumn("g", rc.recode(F.col("a0"), F.col("a1")))


def _pairs(s, d) -> DataFrame:
    both = ad.calls(s, d).join(ad.imputed(s, d), ["snp", "smp"])
    return both.withColumns({"x": rc.recode(F.col("a0"), F.col("a1")), "y": rc.recode(F.col("b0"), F.col("b1"))})


def _n(condition: Column) -> Column:
    return F.count_if(condition)


def _round(c: Column) -> Column:
    return F.round(c, 6)


# summaries and totals


@query("""SELECT l_returnflag AS flag, ROUND(AVG(k), 6) AS mean, ROUND(STDDEV_POP(k), 6) AS std, MEDIAN(k)::DOUBLE AS middle, MIN(k) AS least, MAX(k) AS most
  FROM (SELECT l_returnflag, l_partkey%1000 AS k FROM lineitem) GROUP BY 1""")
def q_summary_stats(s, d):
    """Mean, population deviation, median and extremes."""
    k = F.col("k")
    t = ad.load(s, d, "lineitem").select(F.col("l_returnflag").alias("flag"), (F.col("l_partkey") % 1000).alias("k"))
    return t.groupBy("flag").agg(_round(F.avg(k)).alias("mean"), _round(F.stddev_pop(k)).alias("std"), F.percentile(k, F.lit(0.5)).alias("middle"), F.min(k).alias("least"), F.max(k).alias("most"))


@query(with_sql("imputed", """SELECT COALESCE(chrom, -1) AS chrom, COALESCE(tag, -1) AS tag, COUNT(*) AS n, COUNT(*) FILTER (b0<>0 AND b1<>0) AS called,
  ROUND(COUNT(*) FILTER (b0<>0 AND b1<>0)/CAST(COUNT(*) AS DOUBLE), 6) AS rate FROM (SELECT snp%22 AS chrom, tag, b0, b1 FROM imputed) GROUP BY ROLLUP (chrom, tag)"""))
def q_rollup_rates(s, d):
    """Counts and rates by chromosome and tag, with totals (-1)."""
    full = (F.col("b0") != 0) & (F.col("b1") != 0)
    out = ad.imputed(s, d).withColumn("chrom", F.col("snp") % 22).rollup("chrom", "tag").agg(F.count("*").alias("n"), _n(full).alias("called"))
    return out.select(F.coalesce("chrom", F.lit(-1)).alias("chrom"), F.coalesce("tag", F.lit(-1)).alias("tag"), "n", "called", _round(F.col("called") / F.col("n")).alias("rate"))


@query(with_sql("calls imputed", f""", {_J}, w AS (SELECT smp, AVG(CASE WHEN x=y THEN 1.0 ELSE 0.0 END) AS c FROM j WHERE x>0 AND y>0 GROUP BY smp ORDER BY c, smp LIMIT 10)
  SELECT snp, ROUND(COALESCE(AVG(CASE WHEN x>0 AND y>0 THEN CASE WHEN x=y THEN 1.0 ELSE 0.0 END END), 1.0), 6) AS concordance FROM j WHERE smp IN (SELECT smp FROM w) GROUP BY snp"""))
def q_worst_samples(s, d):
    """Concordance of each SNP among the ten samples that agree least (a top-k report)."""
    j = _pairs(s, d)
    same = F.when((F.col("x") > 0) & (F.col("y") > 0), (F.col("x") == F.col("y")).cast("double"))
    worst = j.groupBy("smp").agg(F.avg(same).alias("c")).where("c is not null").orderBy("c", "smp").limit(10)
    return j.join(F.broadcast(worst.select("smp")), "smp", "left_semi").groupBy("snp").agg(_round(F.coalesce(F.avg(same), F.lit(1.0))).alias("concordance"))


@query(with_sql("calls imputed", f""", {_J}, c AS (SELECT snp, smp%8 AS grp, AVG(CASE WHEN x=y THEN 1.0 ELSE 0.0 END) AS c FROM j WHERE x>0 AND y>0 GROUP BY 1, 2),
  k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY grp ORDER BY c, snp) AS k FROM c) SELECT grp, snp, ROUND(c, 6) AS concordance FROM k WHERE k=1"""))
def q_most_discordant(s, d):
    """In each group of samples, the SNP of least concordance."""
    c = _pairs(s, d).where("x > 0 and y > 0").groupBy((F.col("smp") % 8).alias("grp"), "snp").agg(F.avg((F.col("x") == F.col("y")).cast("double")).alias("c"))
    least = c.groupBy("grp").agg(F.min(F.struct("c", "snp")).alias("m"))
    return least.select("grp", F.col("m.snp").alias("snp"), _round(F.col("m.c")).alias("concordance"))


@query("""SELECT p_name AS name, COUNT(*) AS n, MIN(p_partkey) AS first FROM part GROUP BY 1 HAVING COUNT(*)>1 ORDER BY n DESC, name LIMIT 20""")
def q_multi_mapped(s, d):
    """The names that stand for most rows (a top-k report)."""
    return ad.load(s, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first")).where("n > 1").orderBy(F.desc("n"), "name").limit(20)


@query(with_sql("segments", """SELECT s0, snp_start, snp_stop, s1, a0, a1, ROW_NUMBER() OVER (PARTITION BY s0 ORDER BY snp_start, snp_stop, s1, a0, a1)-1 AS place FROM segments""").replace("SELECT s0, snp_start", "SELECT s0, snp_start", 1))
def q_sorted_segments(s, d):
    """Segments in canonical order with their place in it."""
    order = ("snp_start", "snp_stop", "s1", "a0", "a1")
    return ad.segments(s, d).select("s0", *order, (F.row_number().over(W.partitionBy("s0").orderBy(*order)) - 1).cast("long").alias("place"))


@query(with_sql("calls", f""", {_R}, c AS (SELECT snp, COUNT(*) FILTER (g=2) AS c2, COUNT(*) FILTER (g=3) AS c3, COUNT(*) FILTER (g=4) AS c4, COUNT(*) FILTER (g=0) AS c0 FROM r GROUP BY snp)
  SELECT snp, ROUND(c2/n, 6) AS f11, ROUND(c3/n, 6) AS f12, ROUND(c4/n, 6) AS f22, ROUND(c0/n, 6) AS f00 FROM (SELECT *, CAST(c2+c3+c4+c0 AS DOUBLE) AS n FROM c) WHERE n>0"""))
def q_genotype_freq(s, d):
    """Genotype frequencies over the four counted genotypes."""
    c = _recoded(s, d).groupBy("snp").agg(*[_n(F.col("g") == g).alias(f"c{g}") for g in (2, 3, 4, 0)])
    n = F.col("c2") + F.col("c3") + F.col("c4") + F.col("c0")
    return c.where(n > 0).select("snp", *[_round(F.col(c) / n).alias(f) for c, f in (("c2", "f11"), ("c3", "f12"), ("c4", "f22"), ("c0", "f00"))])


@query(with_sql("calls", """, a AS (SELECT snp, a0 AS a FROM calls UNION ALL SELECT snp, a1 FROM calls) SELECT COALESCE(snp, -1) AS snp, COUNT(*) FILTER (a=1) AS n1, COUNT(*) FILTER (a=2) AS n2,
  ROUND(COUNT(*) FILTER (a=2)/CAST(COUNT(*) FILTER (a<>0) AS DOUBLE), 6) AS f2 FROM a GROUP BY ROLLUP (snp) HAVING COUNT(*) FILTER (a<>0)>0"""))
def q_filled_allele_freq(s, d):
    """Allele frequency over filled alleles, by SNP and overall (-1)."""
    a = ad.calls(s, d).select("snp", F.explode(F.array("a0", "a1")).alias("a")).rollup("snp").agg(_n(F.col("a") == 1).alias("n1"), _n(F.col("a") == 2).alias("n2"))
    return a.where("n1 + n2 > 0").select(F.coalesce("snp", F.lit(-1)).alias("snp"), "n1", "n2", _round(F.col("n2") / (F.col("n1") + F.col("n2"))).alias("f2"))


@query(with_sql("calls", """, n AS (SELECT snp, COUNT(*) FILTER (a0=1)+COUNT(*) FILTER (a1=1) AS n1, COUNT(*) FILTER (a0=2)+COUNT(*) FILTER (a1=2) AS n2 FROM calls GROUP BY snp)
  SELECT snp, n1, n2 FROM n WHERE n1+n2>0 AND 2*n1>=n1+n2"""))
def q_major_first(s, d):
    """SNPs whose first allele has at least half of the filled ones."""
    n = ad.calls(s, d).groupBy("snp").agg((_n(F.col("a0") == 1) + _n(F.col("a1") == 1)).alias("n1"), (_n(F.col("a0") == 2) + _n(F.col("a1") == 2)).alias("n2"))
    return n.where("n1 + n2 > 0 and 2 * n1 >= n1 + n2")


@query("""SELECT p_size%22 AS chrom, COUNT(*) FILTER (p_partkey%4=0) AS snp, COUNT(*) FILTER (p_partkey%4=1) AS ins, COUNT(*) FILTER (p_partkey%4=2) AS del, COUNT(*) FILTER (p_partkey%4=3) AS sub, COUNT(*) AS total FROM part GROUP BY 1""")
def q_variant_pivot(s, d):
    """Variants by chromosome and type, with the right total."""
    kind = F.element_at(F.array(*[F.lit(k) for k in ("snp", "ins", "del", "sub")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    out = ad.load(s, d, "part").select((F.col("p_size") % 22).alias("chrom"), kind.alias("kind")).groupBy("chrom").pivot("kind", ["snp", "ins", "del", "sub"]).count().na.fill(0)
    return out.withColumn("total", F.col("snp") + F.col("ins") + F.col("del") + F.col("sub"))


@query("""SELECT ROUND(AVG(p_size), 6) AS size, ROUND(AVG(p_partkey), 6) AS partkey, COUNT(*) AS n FROM part""")
def q_column_averages(s, d):
    return ad.load(s, d, "part").agg(_round(F.avg("p_size")).alias("size"), _round(F.avg("p_partkey")).alias("partkey"), F.count("*").alias("n"))


@query("""SELECT p_size>25 AS is_qc, p_partkey%7=0 AS is_singleton, p_partkey%2=0 AS is_known, p_partkey%4 AS vartype, COUNT(*) AS n FROM part GROUP BY 1, 2, 3, 4""")
def q_flag_groups(s, d):
    k = F.col("p_partkey")
    return ad.load(s, d, "part").groupBy((F.col("p_size") > 25).alias("is_qc"), (k % 7 == 0).alias("is_singleton"), (k % 2 == 0).alias("is_known"), (k % 4).alias("vartype")).agg(F.count("*").alias("n"))


@query(with_sql("calls imputed", f""", {_J} SELECT smp, COUNT(*) FILTER (x>0 AND y>0) AS both_called, COUNT(*) FILTER (x>0 AND y>0 AND x=y) AS equal,
  ROUND(COUNT(*) FILTER (x>0 AND y>0 AND x=y)/CAST(NULLIF(COUNT(*) FILTER (x>0 AND y>0), 0) AS DOUBLE), 6) AS concordance,
  ROUND(0.5*(COUNT(*) FILTER (y<>0)+COUNT(*) FILTER (y>0))/COUNT(*), 6) AS partial_rate, ROUND(COALESCE(AVG(CASE WHEN x>0 AND y>0 THEN CASE WHEN x=y THEN 1.0 ELSE 0.0 END END), 0), 6) AS older FROM j GROUP BY smp"""))
def q_vector_concordance(s, d):
    """Concordance of two vectors (null without data, 0 in the older form), and the partial rate, half partial half full."""
    x, y = F.col("x"), F.col("y")
    both = (x > 0) & (y > 0)
    c = F.avg(F.when(both, (x == y).cast("double")))
    return _pairs(s, d).groupBy("smp").agg(_n(both).alias("both_called"), _n(both & (x == y)).alias("equal"), _round(c).alias("concordance"), _round(0.5 * (_n(y != 0) + _n(y > 0)) / F.count("*")).alias("partial_rate"), _round(F.coalesce(c, F.lit(0.0))).alias("older"))


@query(with_sql("calls imputed", f""", {_J}, m AS (SELECT snp, SUM(CASE WHEN x>0 THEN x-2 ELSE 0 END) AS minor, COUNT(*) FILTER (x>0) AS n, COUNT(*) FILTER (x=3 AND smp%2=0) AS training_hets FROM j GROUP BY snp)
  SELECT training_hets, COUNT(*) AS variants, SUM(eq)::BIGINT AS equal, SUM(un)::BIGINT AS unequal FROM (SELECT m.snp, training_hets, COUNT(*) FILTER (x=y) AS eq, COUNT(*) FILTER (x<>y) AS un
  FROM m JOIN j ON j.snp=m.snp WHERE n>0 AND 10*minor<=4*n AND x>2 AND y>0 GROUP BY 1, 2) GROUP BY 1"""))
def q_rare_variants(s, d):
    """Concordance of carriers of rare alleles, by the number of heterozygous training samples."""
    j = _pairs(s, d)
    x, y = F.col("x"), F.col("y")
    m = j.groupBy("snp").agg(F.sum(F.when(x > 0, x - 2).otherwise(0)).alias("minor"), _n(x > 0).alias("n"), _n((x == 3) & (F.col("smp") % 2 == 0)).alias("training_hets"))
    per = j.where((x > 2) & (y > 0)).groupBy("snp").agg(_n(x == y).alias("eq"), _n(x != y).alias("un")).join(m.where("n > 0 and 10 * minor <= 4 * n"), "snp")
    return per.groupBy("training_hets").agg(F.count("*").alias("variants"), F.sum("eq").alias("equal"), F.sum("un").alias("unequal"))


@query(with_sql("calls imputed", f""", {_J} SELECT smp, COUNT(*) FILTER (x=0) AS missing, COUNT(*) FILTER (x<>0) AS filled, COUNT(*) FILTER (x>0) AS called, COUNT(*) FILTER (x<0) AS partial_call,
  COUNT(*) FILTER (x>0 AND y>0 AND x<>y) AS error, COUNT(*) FILTER (x<0 AND y>0 AND NOT (-x=b0 OR -x=b1)) AS partial_error, COUNT(*) FILTER (x<=0 AND y<>0) AS imputed, COUNT(*) FILTER (x<=0 AND y>0) AS full_imputed,
  COUNT(*) FILTER (x=0 AND y<0) AS partial_imputed, COUNT(*) FILTER (x<=0 AND y=0) AS still_missing, COUNT(*) FILTER (x=0 OR x<0) AS to_impute FROM j GROUP BY smp"""))
def q_where_sets(s, d):
    """The index sets of imputation against the original, as counts."""
    x, y = F.col("x"), F.col("y")
    sets = {
        "missing": x == 0, "filled": x != 0, "called": x > 0, "partial_call": x < 0, "error": (x > 0) & (y > 0) & (x != y), "partial_error": (x < 0) & (y > 0) & ~((-x == F.col("b0")) | (-x == F.col("b1"))),
        "imputed": (x <= 0) & (y != 0), "full_imputed": (x <= 0) & (y > 0), "partial_imputed": (x == 0) & (y < 0), "still_missing": (x <= 0) & (y == 0), "to_impute": x <= 0,
    }
    return _pairs(s, d).groupBy("smp").agg(*[_n(c).alias(k) for k, c in sets.items()])


_FILTERS = {"all_pairs": "true", "called": "x>0 AND y>0", "genotype_called": "x>0", "imputed_called": "y>0", "has_minor": "x IN (-2,3,4)", "called_minor": "x>0 AND y>0 AND x IN (3,4)"}


@query(with_sql("calls imputed", f", {_J} SELECT snp, " + ", ".join(f"COUNT(*) FILTER ({c}) AS n_{k}, COUNT(*) FILTER (({c}) AND x=y) AS eq_{k}" for k, c in _FILTERS.items()) + " FROM j GROUP BY snp"))
def q_comparison_filters(s, d):
    """Pairs that each comparison filter takes, and how many agree; a filter is any boolean Column of x and y."""
    return _pairs(s, d).groupBy("snp").agg(*[c for k, f in _FILTERS.items() for c in (_n(F.expr(f)).alias(f"n_{k}"), _n(F.expr(f"({f}) AND x=y")).alias(f"eq_{k}"))])


@query(with_sql("persons calls", """, f AS (SELECT smp, SUM((a0<>0)::INT+(a1<>0)::INT) AS filled, 2*COUNT(*) AS size FROM calls GROUP BY smp)
  SELECT id, 10*filled>=8*size AS enough FROM persons JOIN f ON f.smp=id%64 WHERE genotyped"""))
def q_samples_by_fill(s, d):
    """Genotyped persons by whether at least 80 % of their alleles are filled."""
    filled = F.sum((F.col("a0") != 0).cast("int") + (F.col("a1") != 0).cast("int"))
    f = ad.calls(s, d).groupBy("smp").agg((10 * filled >= 16 * F.count("*")).alias("enough"))
    return ad.persons(s, d).where("genotyped").select("id", (F.col("id") % ad.SAMPLES).alias("smp")).join(f, "smp").select("id", "enough")


@query(with_sql("calls", """SELECT snp, COUNT(*) FILTER (a0=1 AND a1=1 OR a0=1 AND a1=2 OR a0=2 AND a1=2) AS n FROM calls GROUP BY snp HAVING COUNT(*) FILTER (a0=1 AND a1=1 OR a0=1 AND a1=2 OR a0=2 AND a1=2)>=CEIL(0.5*COUNT(*))"""))
def q_call_count_filter(s, d):
    """SNPs with enough cells 00, 01 and 11; 10 isn't counted."""
    n = _n((F.col("a0") != 0) & (F.col("a1") >= F.col("a0")))
    return ad.calls(s, d).groupBy("snp").agg(n.alias("n"), F.ceil(0.5 * F.count("*")).alias("least")).where("n >= least").drop("least")


_BASES = "SELECT p_partkey AS snp, SUBSTR('ACGTN', 1+(p_partkey*3)%5, 1) AS a, SUBSTR('ACGTN', 1+(p_partkey*7+p_size)%5, 1) AS ref, SUBSTR('ACGT', 1+p_size%4, 1) AS alt FROM part"


@query(f"WITH b AS ({_BASES}) SELECT snp, a, ref, alt FROM b WHERE a<>'N' AND ref<>'N' AND TRANSLATE(ref, 'ACGT', 'TGCA')<>alt")
def q_flipped_strand(s, d):
    """Known bases whose reference isn't the complement of the alternative."""
    k, z = F.col("p_partkey"), F.col("p_size")
    at = lambda letters, place: F.substring(F.lit(letters), (1 + place).cast("int"), F.lit(1))
    b = ad.load(s, d, "part").select(k.alias("snp"), at("ACGTN", (k * 3) % 5).alias("a"), at("ACGTN", (k * 7 + z) % 5).alias("ref"), at("ACGT", z % 4).alias("alt"))
    return b.where((F.col("a") != "N") & (F.col("ref") != "N") & (rc.complement(F.col("ref")) != F.col("alt")))


_WHERE = {
    "sample": "s0=7 OR s1=7", "hap": "(s0=7 AND a0=1) OR (s1=7 AND a1=1)", "sample_range": "s0 BETWEEN 5 AND 20 AND s1 BETWEEN 5 AND 20", "sample_set": "s0 IN (1,4,9,16) AND s1 IN (1,4,9,16,25)",
    "snp_range": "GREATEST(snp_start,100)<LEAST(snp_stop,900)", "bp_range": "GREATEST(bp_start,1000000)<=LEAST(bp_stop-1,9000000)", "at_bp": "bp_start<=5000000 AND 5000000<bp_stop", "larger": "bp_stop-bp_start>300000",
}


@query(with_sql("segments", "SELECT a0, " + ", ".join(f"COUNT(*) FILTER ({c}) AS by_{k}" for k, c in _WHERE.items()) + " FROM segments GROUP BY a0"))
def q_segment_filters(s, d):
    """Segments that each filter takes: by sample, haplotype, ranges and sets of samples, SNP and base-pair ranges, length."""
    return ad.segments(s, d).groupBy("a0").agg(*[_n(F.expr(c)).alias(f"by_{k}") for k, c in _WHERE.items()])


@query(with_sql("ld", "SELECT snp1, snp2, r2 FROM ld WHERE snp1%22=3 AND r2>=0.75 AND snp1 IN (SELECT l_partkey FROM lineitem WHERE l_quantity>40) AND snp2 IN (SELECT l_partkey FROM lineitem WHERE l_quantity<10)"))
def q_ld_edges_in(s, d):
    """Edges of one chromosome, of enough linkage, with both ends in lists."""
    li = ad.load(s, d, "lineitem")
    ends = [li.where(c).select(F.col("l_partkey").alias(k)) for k, c in (("snp1", "l_quantity > 40"), ("snp2", "l_quantity < 10"))]
    return ad.ld_edges(s, d).where("snp1 % 22 = 3 and r2 >= 0.75").join(ends[0], "snp1", "left_semi").join(ends[1], "snp2", "left_semi").select("snp1", "snp2", "r2")


@query("SELECT p_size%22 AS chrom, COUNT(*) AS n FROM part WHERE p_size%22 IN (1, 21) GROUP BY 1")
def q_chrom_count(s, d):
    return ad.load(s, d, "part").groupBy((F.col("p_size") % 22).alias("chrom")).agg(F.count("*").alias("n")).where("chrom in (1, 21)")


@query(with_sql("persons", "SELECT id FROM persons WHERE father=0 AND mother=0"))
def q_founders(s, d):
    p = ad.persons(s, d)
    edges = p.select("id", F.explode(F.array("father", "mother")).alias("parent")).where("parent <> 0")
    return p.select("id").join(edges, "id", "left_anti")


# joins and lookups


@query(with_sql("segments", "SELECT s0, a0, s1, a1, snp_start, snp_stop FROM segments WHERE bp_start<=5000000 AND 5000000<bp_stop AND (s0 IN (SELECT n_nationkey FROM nation) OR s1 IN (SELECT n_nationkey FROM nation))"))
def q_ibd_at_bp(s, d):
    """Segments over a base pair that touch a set of samples."""
    wanted = ad.load(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("w")).distinct()
    at = ad.segments(s, d).where("bp_start <= 5000000 and 5000000 < bp_stop")
    for c in ("s0", "s1"):
        at = at.join(wanted.select(F.col("w").alias(c), F.lit(True).alias(f"has_{c}")), c, "left")
    return at.where("has_s0 or has_s1").select("s0", "a0", "s1", "a1", "snp_start", "snp_stop")


@query(with_sql("snps", """, q AS (SELECT n_nationkey AS region, n_nationkey*370000+5000 AS q0, n_nationkey*370000+505000 AS q1 FROM nation)
  SELECT region, MIN(snp) AS first, MAX(snp)+1 AS stop, COUNT(*) AS n FROM q JOIN snps ON bp>=q0 AND bp<=q1 GROUP BY region"""))
def q_range_index(s, d):
    """The half-open run of SNPs between two base pairs."""
    k = F.col("n_nationkey") * 370_000
    q = ad.load(s, d, "nation").select(F.col("n_nationkey").alias("region"), (k + 5000).alias("q0"), (k + 505_001).alias("q1"))
    p = ad.snps(s, d).select("snp", "bp", (F.col("bp") + 1).alias("bp1"))
    j = joins.range_join(q, p, "q0", "q1", "bp", "bp1", 500_000)
    return j.groupBy("region").agg(F.min("snp").alias("first"), (F.max("snp") + 1).alias("stop"), F.count("*").alias("n"))


@query(with_sql("persons", "SELECT father, mother, id, ROW_NUMBER() OVER (PARTITION BY father, mother ORDER BY id) AS place FROM persons WHERE father<>0 AND mother<>0"))
def q_trios_sorted(s, d):
    """Trios in order of their families."""
    t = ad.persons(s, d).where("father <> 0 and mother <> 0")
    return t.select("father", "mother", "id", F.row_number().over(W.partitionBy("father", "mother").orderBy("id")).cast("long").alias("place"))


_KIN = "kin AS (SELECT s_nationkey AS id1, s_suppkey%25 AS id2, MIN(s_suppkey) AS k FROM supplier GROUP BY 1, 2)"


@query(f"WITH {_KIN}, n AS (SELECT LEAST(id1,id2) AS x, GREATEST(id1,id2) AS y, MIN(k) AS k FROM kin GROUP BY 1, 2) SELECT a.n_nationkey AS id1, b.n_nationkey AS id2, n.k AS kinship FROM nation a JOIN nation b ON b.n_nationkey=(a.n_nationkey*3)%25 JOIN n ON n.x=LEAST(a.n_nationkey,b.n_nationkey) AND n.y=GREATEST(a.n_nationkey,b.n_nationkey)")
def q_pair_lookup(s, d):
    """Kinship of wanted pairs, whichever of the two comes first in the table."""
    a = F.col("n_nationkey")
    want = ad.load(s, d, "nation").select(a.alias("id1"), ((a * 3) % 25).alias("id2")).withColumns({"x": F.least("id1", "id2"), "y": F.greatest("id1", "id2")})
    return want.join(_kin(s, d), ["x", "y"]).select("id1", "id2", F.col("k").alias("kinship"))


def _kin(s, d) -> DataFrame:
    pair = ad.load(s, d, "supplier").select(F.col("s_nationkey").cast("long").alias("id1"), (F.col("s_suppkey") % 25).alias("id2"), F.col("s_suppkey").alias("k"))
    return pair.groupBy(F.least("id1", "id2").alias("x"), F.greatest("id1", "id2").alias("y")).agg(F.min("k").alias("k"))


@query(f"WITH {_KIN}, k2 AS (SELECT LEAST(id1,id2) AS x, GREATEST(id1,id2) AS y, MIN(k) AS k FROM kin GROUP BY 1, 2) SELECT x AS id1, y AS id2, k FROM k2 UNION SELECT y, x, k FROM k2")
def q_symmetrised(s, d):
    """Every pair in both orders, those of one with itself once."""
    k = _kin(s, d)
    return k.select(F.col("x").alias("id1"), F.col("y").alias("id2"), "k").union(k.where("x <> y").select("y", "x", "k"))


@query(f"WITH {_KIN}, p AS (SELECT a.n_nationkey AS id1, b.n_nationkey AS id2 FROM nation a JOIN nation b ON a.n_nationkey<=b.n_nationkey), n AS (SELECT LEAST(id1,id2) AS x, GREATEST(id1,id2) AS y, MIN(k) AS k FROM kin GROUP BY 1, 2) SELECT id1, id2, COALESCE(k, 0) AS k, k IS NULL AS absent FROM p LEFT JOIN n ON x=id1 AND y=id2")
def q_missing_pairs(s, d):
    """All pairs id1 <= id2 of a dimension, absent ones with nothing."""
    ids = ad.load(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("id1"))
    every = ids.select("id1", F.explode(F.sequence(F.col("id1"), F.lit(24).cast("long"))).alias("id2"))
    out = every.join(_kin(s, d).toDF("id1", "id2", "k"), ["id1", "id2"], "left")
    return out.select("id1", "id2", F.coalesce("k", F.lit(0)).alias("k"), F.isnull("k").alias("absent"))


@query("""SELECT s_suppkey, COALESCE(k.c_custkey, -1) AS first, COALESCE(k.c_name, '') AS name FROM supplier LEFT JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer WHERE c_acctbal<0) k ON k.c_nationkey=s_nationkey AND k.n=1""")
def q_first_match(s, d):
    """The first match of each row in a stated order, blanks where there is none."""
    first = ad.load(s, d, "customer").where("c_acctbal < 0").groupBy("c_nationkey").agg(F.min(F.struct("c_custkey", "c_name")).alias("m"))
    j = ad.load(s, d, "supplier").join(first, F.col("s_nationkey") == F.col("c_nationkey"), "left")
    return j.select("s_suppkey", F.coalesce("m.c_custkey", F.lit(-1)).alias("first"), F.coalesce("m.c_name", F.lit("")).alias("name"))


@query(with_sql("segments", """, t AS (SELECT s0, s1, a1, SUM(bp_stop-bp_start)::BIGINT AS total FROM segments WHERE s0 IN (3, 8) GROUP BY 1, 2, 3), x AS (SELECT * FROM t WHERE s0=3), y AS (SELECT * FROM t WHERE s0=8)
  SELECT COALESCE(x.s1, y.s1) AS s1, COALESCE(x.a1, y.a1) AS a1, COALESCE(x.total, 0) AS one, COALESCE(y.total, 0) AS other FROM x FULL JOIN y ON x.s1=y.s1 AND x.a1=y.a1"""))
def q_sharing_compared(s, d):
    """What two samples share with each haplotype; nothing is 0."""
    t = ad.segments(s, d).where("s0 in (3, 8)").groupBy("s0", "s1", "a1").agg(F.sum(F.col("bp_stop") - F.col("bp_start")).alias("total"))
    side = lambda k, name: t.where(F.col("s0") == k).select("s1", "a1", F.col("total").alias(name))
    return side(3, "one").join(side(8, "other"), ["s1", "a1"], "full").na.fill(0, ["one", "other"])


_OVERRIDE = """o AS (SELECT *, (a0<>0)::INT+(a1<>0)::INT AS na, (b0<>0)::INT+(b1<>0)::INT AS nb FROM imputed JOIN calls USING (snp, smp)),
  s AS (SELECT snp, COUNT(*) FILTER (a0=a1 AND a0<>0 AND b0=b1 AND b0=3-a0)>10 AS flip, COUNT(*) FILTER (na=1 AND nb=2 AND b0=b1 AND a0+a1=3-b0)>5 AS abort FROM o GROUP BY snp)"""


@query(with_sql("calls imputed", f""", {_OVERRIDE} SELECT o.snp, smp, CASE WHEN na>nb AND NOT abort THEN CASE WHEN flip AND a0<>0 THEN 3-a0 ELSE a0 END ELSE b0 END AS o0,
  CASE WHEN na>nb AND NOT abort THEN CASE WHEN flip AND a1<>0 THEN 3-a1 ELSE a1 END ELSE b1 END AS o1, flip, abort FROM o JOIN s ON s.snp=o.snp"""))
def q_override_rules(s, d):
    """Typed alleles over imputed ones where more are called: turned round where over ten homozygotes are opposite, and
    not at all where over five partial calls mismatch."""
    j = ad.imputed(s, d).join(ad.calls(s, d), ["snp", "smp"])
    n = lambda a, b: (F.col(a) != 0).cast("int") + (F.col(b) != 0).cast("int")
    hom = rc.homozygous(F.col("a0"), F.col("a1")) & (F.col("b0") == F.col("b1")) & (F.col("b0") == 3 - F.col("a0"))
    partial = (n("a0", "a1") == 1) & (n("b0", "b1") == 2) & (F.col("b0") == F.col("b1")) & (F.col("a0") + F.col("a1") == 3 - F.col("b0"))
    rules = j.groupBy("snp").agg((_n(hom) > 10).alias("flip"), (_n(partial) > 5).alias("abort"))
    j = j.join(rules, "snp")
    take = (n("a0", "a1") > n("b0", "b1")) & ~F.col("abort")
    own = lambda a, b: F.when(take, F.when(F.col("flip"), rc.swap(F.col(a))).otherwise(F.col(a))).otherwise(F.col(b))
    return j.select("snp", "smp", own("a0", "b0").alias("o0"), own("a1", "b1").alias("o1"), "flip", "abort")


@query(with_sql("calls imputed", "SELECT snp, smp, CASE WHEN a0<>0 AND a1<>0 THEN a0 ELSE b0 END AS o0, CASE WHEN a0<>0 AND a1<>0 THEN a1 ELSE b1 END AS o1, CASE WHEN a0<>0 AND a1<>0 THEN 9 ELSE tag END AS tag FROM imputed JOIN calls USING (snp, smp)"))
def q_override_wgs(s, d):
    """Sequenced genotypes, where fully called, over imputed ones, matched by variant and sample."""
    full = (F.col("a0") != 0) & (F.col("a1") != 0)
    j = ad.imputed(s, d).join(ad.calls(s, d), ["snp", "smp"])
    return j.select("snp", "smp", F.when(full, F.col("a0")).otherwise(F.col("b0")).alias("o0"), F.when(full, F.col("a1")).otherwise(F.col("b1")).alias("o1"), F.when(full, 9).otherwise(F.col("tag")).alias("tag"))


# statistics


@query("""WITH n AS (SELECT o_custkey AS k, COUNT(*) FILTER (o_orderkey%2=0) AS x, COUNT(*) FILTER (o_orderkey%2=1) AS y FROM orders GROUP BY 1),
  t AS (SELECT k, x, y, COALESCE((SELECT SUM(EXP(LGAMMA(x+y+1)-LGAMMA(i+1)-LGAMMA(x+y-i+1)-(x+y)*LN(2))) FROM UNNEST(range(LEAST(x,y)+1, GREATEST(x,y)+1)) AS u(i)), 0) AS inside FROM n)
  SELECT k, x, y, CAST(FLOOR((1-inside)*1000000+0.0001) AS BIGINT) AS p_e6 FROM t""")
def q_binomial(s, d):
    """Two-sided tail of a fair coin for the two sides of each key."""
    n = ad.load(s, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(_n(F.col("o_orderkey") % 2 == 0).alias("x"), _n(F.col("o_orderkey") % 2 == 1).alias("y"))
    return n.select("k", "x", "y", F.floor(rc.binomial_p(F.col("x"), F.col("y")) * 1_000_000 + 0.0001).alias("p_e6"))


@query(with_sql("calls imputed", f""", {_J}, h AS (SELECT snp, LEAST(((snp*7+smp*3)%100)*20//100, 19) AS bin, COUNT(*) AS n FROM j WHERE x=3 AND y=3 GROUP BY 1, 2), k AS (SELECT snp FROM h GROUP BY 1 HAVING SUM(n)>=2)
  SELECT bin, SUM(n)::BIGINT AS hets, COUNT(DISTINCT snp) AS variants FROM h WHERE snp IN (SELECT snp FROM k) GROUP BY bin"""))
def q_impute2_histogram(s, d):
    """Heterozygous pairs by bin of certainty, of variants with enough of them."""
    h = _pairs(s, d).where("x = 3 and y = 3").select("snp", F.least(F.floor((F.col("snp") * 7 + F.col("smp") * 3) % 100 * 20 / 100), F.lit(19)).cast("long").alias("bin"))
    h = h.groupBy("snp", "bin").agg(F.count("*").alias("n"))
    enough = h.groupBy("snp").agg(F.sum("n").alias("t")).where("t >= 2")
    return h.join(enough, "snp", "left_semi").groupBy("bin").agg(F.sum("n").alias("hets"), F.count("*").alias("variants"))


@query("SELECT (p_partkey%100)//5 AS bin, COUNT(*) AS n, ROUND(AVG(p_partkey%100), 6) AS mean_f, ROUND(AVG(p_size), 6) AS mean_l, ROUND(STDDEV_POP(p_size), 6) AS std_l FROM part GROUP BY 1")
def q_lambda_bins(s, d):
    """Mean inbreeding, and mean and deviation of the rate, by bin."""
    f = F.col("p_partkey") % 100
    t = ad.load(s, d, "part").select(f.alias("f"), "p_size").groupBy(F.floor(F.col("f") / 5).alias("bin"))
    return t.agg(F.count("*").alias("n"), _round(F.avg("f")).alias("mean_f"), _round(F.avg("p_size")).alias("mean_l"), _round(F.stddev_pop("p_size")).alias("std_l"))


@query("""WITH k AS (SELECT s_suppkey AS id, (s_suppkey*3)%7 AS d1, s_suppkey%5 AS d3, s_suppkey%3 AS d5, s_suppkey%4 AS d7, s_suppkey%6 AS d8 FROM supplier)
  SELECT id, ROUND((d1+d3+d5+d7+d8)/25.0, 6) AS p_ibd, ROUND((d1+0.5*(d3+d5+d7)+0.25*d8)/25.0, 6) AS phi FROM k""")
def q_p_ibd(s, d):
    """Probability of any sharing by descent between two persons, and kinship."""
    k = F.col("s_suppkey")
    states = {1: (k * 3) % 7, 3: k % 5, 5: k % 3, 7: k % 4, 8: k % 6}
    return ad.load(s, d, "supplier").select(k.alias("id"), _round(sum(states.values()) / 25).alias("p_ibd"), _round(rc.kinship(states) / 25).alias("phi"))


@query(with_sql("calls", "SELECT snp, smp%16 AS person, COUNT(*) AS copies, COUNT(DISTINCT a0*3+a1) AS genotypes FROM calls WHERE a0<>0 AND a1<>0 GROUP BY 1, 2 HAVING COUNT(DISTINCT a0*3+a1)>1"))
def q_conflicting(s, d):
    """Persons typed more than once with different genotypes."""
    c = ad.calls(s, d).where("a0 <> 0 and a1 <> 0").groupBy("snp", (F.col("smp") % 16).alias("person"))
    return c.agg(F.count("*").alias("copies"), F.count_distinct(F.col("a0") * 3 + F.col("a1")).alias("genotypes")).where("genotypes > 1")


@query("SELECT p_name AS name FROM part GROUP BY 1 HAVING COUNT(*)=1")
def q_seen_once(s, d):
    return ad.load(s, d, "part").groupBy(F.col("p_name").alias("name")).count().where("count = 1").select("name")


@query(with_sql("calls", f""", {_R}, h AS (SELECT snp, COUNT(*) FILTER (g=2) AS a, COUNT(*) FILTER (g=3) AS b, COUNT(*) FILTER (g=4) AS c FROM r GROUP BY snp), e AS (SELECT *, a+b+c AS n, (2*a+b) AS p, (2*c+b) AS q FROM h WHERE a+b+c>0)
  SELECT snp, ROUND(CASE WHEN p=0 OR q=0 THEN 0 ELSE POWER(4.0*a*n-p*p, 2)/(4.0*n*p*p)+POWER(2.0*b*n-2.0*p*q/2, 2)/(2.0*n*p*q)+POWER(4.0*c*n-q*q, 2)/(4.0*n*q*q) END, 6) AS chi2 FROM e"""))
def q_hardy_weinberg(s, d):
    """Chi-squared of the genotype counts against those that the allele frequency expects."""
    g = F.col("g")
    h = _recoded(s, d).groupBy("snp").agg(_n(g == 2).alias("a"), _n(g == 3).alias("b"), _n(g == 4).alias("c")).where("a + b + c > 0")
    h = h.selectExpr("snp", "a", "b", "c", "a+b+c as n", "2*a+b as p", "2*c+b as q")
    return h.select("snp", _round(F.expr("CASE WHEN p=0 OR q=0 THEN 0D ELSE POWER(4.0D*a*n-p*p, 2)/(4.0D*n*p*p)+POWER(2.0D*b*n-2.0D*p*q/2, 2)/(2.0D*n*p*q)+POWER(4.0D*c*n-q*q, 2)/(4.0D*n*q*q) END")).alias("chi2"))


# sequences


@query(with_sql("haps", """, o AS (SELECT smp, snp, v-1 AS v, LAG(v-1, 1, 0) OVER w AS l1, LEAD(v-1, 1, 0) OVER w AS r1, LAG(v-1, 2, 0) OVER w AS l2, LEAD(v-1, 2, 0) OVER w AS r2 FROM haps WINDOW w AS (PARTITION BY smp ORDER BY snp))
  SELECT smp, COUNT(*) FILTER (1<f AND f<4 AND v=1) AS hits, SUM(f)::BIGINT AS total FROM (SELECT *, 4*v+l1+r1+l2+r2 AS f FROM o) GROUP BY smp"""))
def q_fast_max(s, d):
    """A weighted sum of a mark and its neighbours, and where it lies between 1 and the centre's weight."""
    w = W.partitionBy("smp").orderBy("snp")
    v = F.col("v") - 1
    f = 4 * v + sum(g(v, k, 0).over(w) for g in (F.lag, F.lead) for k in (1, 2))
    t = ad.haps(s, d).select("smp", v.alias("v"), f.alias("f"))
    return t.groupBy("smp").agg(_n((F.col("f") > 1) & (F.col("f") < 4) & (F.col("v") == 1)).alias("hits"), F.sum("f").alias("total"))


@query("SELECT n_nationkey AS a, (n_nationkey+1)%25 AS b, (n_nationkey+2)%25 AS c FROM nation")
def q_ntuples(s, d):
    """Consecutive triples of a cycle in order of the key: the last ones go on at the first."""
    n = ad.load(s, d, "nation").select(F.col("n_nationkey").alias("k"))
    w = W.partitionBy(F.lit(1)).orderBy("k")  # a dimension of fixed size
    whole = W.partitionBy(F.lit(1))
    t = n.select("k", F.lead("k", 1).over(w).alias("b"), F.lead("k", 2).over(w).alias("c"), F.sort_array(F.collect_list("k").over(whole)).alias("every"), F.row_number().over(w).alias("i"), F.count("*").over(whole).alias("n"))
    wrap = lambda c, k: F.coalesce(F.col(c), F.element_at("every", ((F.col("i") - 1 + k) % F.col("n") + 1).cast("int")))
    return t.select(F.col("k").alias("a"), wrap("b", 1).alias("b"), wrap("c", 2).alias("c"))


@query(with_sql("snps", "SELECT snp//128 AS block, MIN(snp) AS first, MAX(snp)+1 AS stop, COUNT(*) AS n FROM snps GROUP BY 1"))
def q_blocks(s, d):
    """SNPs in blocks of fixed width."""
    return ad.snps(s, d).groupBy(F.floor(F.col("snp") / 128).alias("block")).agg(F.min("snp").alias("first"), (F.max("snp") + 1).alias("stop"), F.count("*").alias("n"))


@query(with_sql("haps", "SELECT smp, COALESCE(MIN(snp) FILTER (v=2 AND snp>=60), -1) AS after, COALESCE(MAX(snp) FILTER (v=2 AND snp<=60), -1) AS before FROM haps GROUP BY smp"))
def q_first_occurrence(s, d):
    """The first place with a value from a start on, in both directions."""
    at = lambda f, c: F.coalesce(f(F.when(c & (F.col("v") == 2), F.col("snp"))), F.lit(-1))
    return ad.haps(s, d).groupBy("smp").agg(at(F.min, F.col("snp") >= 60).alias("after"), at(F.max, F.col("snp") <= 60).alias("before"))


@query(with_sql("haps", """, c AS (SELECT smp, snp, CASE WHEN LAG(v) OVER (PARTITION BY smp ORDER BY snp) <> v THEN 1 ELSE 0 END AS c FROM haps), n AS (SELECT snp, SUM(c) AS changed, COUNT(*) AS children FROM c GROUP BY snp)
  SELECT c.snp, c.smp, CASE WHEN changed=1 THEN 'child' WHEN changed=children OR changed=children-1 THEN 'template' ELSE 'indecisive' END AS side FROM c JOIN n ON n.snp=c.snp WHERE c.c=1"""))
def q_recombination(s, d):
    """Changes along each child: its own where it changes alone, the template's where all others do."""
    w = W.partitionBy("smp").orderBy("snp")
    c = ad.haps(s, d).select("snp", "smp", F.coalesce((F.lag("v").over(w) != F.col("v")).cast("int"), F.lit(0)).alias("c"))
    n = c.groupBy("snp").agg(F.sum("c").alias("changed"), F.count("*").alias("children"))
    side = F.when(F.col("changed") == 1, "child").when(F.col("changed") >= F.col("children") - 1, "template").otherwise("indecisive")
    return c.where("c = 1").join(n, "snp").select("snp", "smp", side.alias("side"))


@query(with_sql("snps", "SELECT snp, COALESCE(bp-LAG(bp) OVER (PARTITION BY snp//1000 ORDER BY snp), 0) AS gap FROM snps"))
def q_inter_snp(s, d):
    """Base pairs since the SNP before on the chromosome, 0 for its first."""
    w = W.partitionBy(F.floor(F.col("snp") / 1000)).orderBy("snp")
    return ad.snps(s, d).select("snp", F.coalesce(F.col("bp") - F.lag("bp").over(w), F.lit(0)).alias("gap"))


@query(with_sql("calls snps", f""", {_R}, x AS (SELECT snp, smp, g FROM r WHERE g>0) SELECT p.snp AS snp1, q.snp AS snp2, COUNT(a.smp) AS n FROM snps p JOIN snps q ON q.snp>=p.snp AND q.snp<p.snp+8 AND q.bp<p.bp+50000
  LEFT JOIN (SELECT a.snp AS s1, b.snp AS s2, a.smp FROM x a JOIN x b ON a.smp=b.smp AND b.snp BETWEEN a.snp AND a.snp+7) a ON a.s1=p.snp AND a.s2=q.snp WHERE p.snp%5=0 GROUP BY 1, 2"""))
def q_ld_window(s, d):
    """A sliding window: an anchor every five SNPs, partners from itself on while fewer than eight SNPs and 50 kb away, and
    the samples that are called at both."""
    p = ad.snps(s, d).select("snp", "bp")
    a = p.where("snp % 5 = 0").select(F.col("snp").alias("snp1"), F.col("bp").alias("bp1"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.col("snp") + k)).alias("snp2"))
    pair = a.join(p.toDF("snp2", "bp2"), "snp2").where("bp2 < bp1 + 50000").select("snp1", "snp2")
    x = _recoded(s, d).where("g > 0").select("snp", "smp")
    both = pair.join(x.toDF("snp1", "smp"), "snp1").join(x.toDF("snp2", "smp"), ["snp2", "smp"]).groupBy("snp1", "snp2").agg(F.count("*").alias("n"))
    return pair.join(both, ["snp1", "snp2"], "left").na.fill(0, ["n"])


@query("SELECT p_size AS len, SUM(COUNT(*)) OVER (PARTITION BY p_size%5 ORDER BY p_size)::BIGINT AS covered, p_size%5 AS grp FROM part GROUP BY p_size")
def q_coverage_curve(s, d):
    """A running total over sorted sizes in each group."""
    n = ad.load(s, d, "part").groupBy(F.col("p_size").alias("len")).agg(F.count("*").alias("n")).withColumn("grp", F.col("len") % 5)
    return n.select("len", F.sum("n").over(W.partitionBy("grp").orderBy("len")).alias("covered"), "grp")


# recodes and names


@query("SELECT p_partkey AS k, 'dbsnp.'||p_size||':rs'||(p_partkey%97)||';dbsnp.'||(p_size+p_partkey%3)||':rs'||(p_partkey%89) AS names, CASE WHEN p_partkey%3>0 THEN 'rs'||(p_partkey%89) ELSE CASE WHEN 'rs'||(p_partkey%97)>'rs'||(p_partkey%89) THEN 'rs'||(p_partkey%97) ELSE 'rs'||(p_partkey%89) END END AS rs, 'rs'||(p_partkey%97)||';rs'||(p_partkey%89) AS plain, 'c'||(p_size%22)||'_'||p_partkey||'_'||(p_partkey+1)||'_snp' AS key FROM part")
def q_names(s, d):
    """The name of the latest build of a list, names without builds, and a variant's key."""
    k, z = F.col("p_partkey"), F.col("p_size")
    text = F.concat(F.lit("dbsnp."), z, F.lit(":rs"), k % 97, F.lit(";dbsnp."), z + k % 3, F.lit(":rs"), k % 89)
    pairs = F.transform(F.split("names", ";"), lambda x: F.struct(F.regexp_extract(x, r"\.([0-9]+):", 1).cast("int").alias("build"), F.substring_index(x, ":", -1).alias("rs")))
    t = ad.load(s, d, "part").select(k.alias("k"), text.alias("names"), F.concat_ws("_", F.concat(F.lit("c"), z % 22), k, k + 1, F.lit("snp")).alias("key"))
    return t.select("k", "names", F.array_max(pairs)["rs"].alias("rs"), F.regexp_replace("names", r"dbsnp\.[0-9]+:", "").alias("plain"), "key")


_PROB = "SELECT p_partkey AS k, (p_partkey*7)%100 AS x, (p_partkey*3)%(101-(p_partkey*7)%100) AS y FROM part"


@query(f"WITH t AS (SELECT k, x, y, 100-x-y AS z FROM ({_PROB})) SELECT k, CASE WHEN GREATEST(x,y,z)<60 THEN '?' WHEN x=GREATEST(x,y,z) THEN '0' WHEN y=GREATEST(x,y,z) THEN '1' ELSE '2' END AS dose, CASE WHEN GREATEST(x,y,z)<60 THEN -1 WHEN x=GREATEST(x,y,z) THEN 0 WHEN y=GREATEST(x,y,z) THEN 1 ELSE 2 END AS dosage FROM t")
def q_dose(s, d):
    """The most likely of three genotypes where it is likely enough, as a sign and as a number."""
    k = F.col("p_partkey")
    t = ad.load(s, d, "part").select(k.alias("k"), ((k * 7) % 100).alias("x"), ((k * 3) % (101 - (k * 7) % 100)).alias("y"))
    three = F.array("x", "y", 100 - F.col("x") - F.col("y"))
    best = F.when(F.array_max(three) >= 60, F.array_position(three, F.array_max(three)) - 1)
    return t.select("k", F.coalesce(best.cast("string"), F.lit("?")).alias("dose"), F.coalesce(best, F.lit(-1)).cast("int").alias("dosage"))


@query(with_sql("calls", f""", {_R}, c AS (SELECT snp, COUNT(*) FILTER (g=3) AS hets, COUNT(*) FILTER (g=4) AS hom_alt, COUNT(*) FILTER (g>0) AS n, COUNT(*) AS m FROM r GROUP BY snp)
  SELECT snp, hets=1 AND hom_alt=0 AS singleton, snp%3=0 AS known, CASE WHEN hets=1 AND hom_alt=0 AND snp%4=1 THEN 100*n>=99*m WHEN snp%3=0 THEN 100*n>=90*m ELSE 100*n>=99*m END AS qc FROM c"""))
def q_variant_flags(s, d):
    """Singletons, known variants and quality: known ones need a call rate of 0.9, others and singleton insertions 0.99."""
    g = F.col("g")
    c = _recoded(s, d).groupBy("snp").agg(_n(g == 3).alias("hets"), _n(g == 4).alias("alt"), _n(g > 0).alias("n"), F.count("*").alias("m"))
    single, known = (F.col("hets") == 1) & (F.col("alt") == 0), F.col("snp") % 3 == 0
    least = F.when(single & (F.col("snp") % 4 == 1), 99).when(known, 90).otherwise(99)
    return c.select("snp", single.alias("singleton"), known.alias("known"), (100 * F.col("n") >= least * F.col("m")).alias("qc"))


@query(with_sql("segments", """, m AS (SELECT s0, s1, snp_start, snp_stop, bp_start+50000 AS b0, bp_stop-50000 AS b1 FROM segments) SELECT s0, COUNT(*) AS kept, SUM((b1-b0)//10000)::BIGINT AS snps FROM m WHERE b1>b0 GROUP BY s0"""))
def q_middle_part(s, d):
    """Segments without half a margin on each side; those with nothing left are dropped."""
    m = ad.segments(s, d).select("s0", (F.col("bp_start") + 50_000).alias("b0"), (F.col("bp_stop") - 50_000).alias("b1")).where("b1 > b0")
    return m.groupBy("s0").agg(F.count("*").alias("kept"), F.sum(F.floor((F.col("b1") - F.col("b0")) / 10_000)).alias("snps"))


# sets


@query("SELECT * FROM (SELECT c_nationkey AS k, 'both' AS side FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier) UNION ALL SELECT * FROM (SELECT c_nationkey, 'customer' FROM customer EXCEPT SELECT s_nationkey, 'customer' FROM supplier) UNION ALL SELECT * FROM (SELECT s_nationkey, 'supplier' FROM supplier EXCEPT SELECT c_nationkey, 'supplier' FROM customer)")
def q_set_operations(s, d):
    c, p = ad.load(s, d, "customer").select(F.col("c_nationkey").alias("k")), ad.load(s, d, "supplier").select(F.col("s_nationkey").alias("k"))
    out = [(c.intersect(p), "both"), (c.subtract(p), "customer"), (p.subtract(c), "supplier")]
    return out[0][0].withColumn("side", F.lit("both")).union(out[1][0].withColumn("side", F.lit("customer"))).union(out[2][0].withColumn("side", F.lit("supplier")))


@query(with_sql("persons", "SELECT father, mother, COUNT(*) FILTER (genotyped) AS members, COUNT(*) FILTER (genotyped)>=2 AS at_least_two, COUNT(*) FILTER (genotyped AND id%5=0)>0 AS has_fifth FROM persons WHERE father<>0 AND mother<>0 GROUP BY 1, 2"))
def q_members(s, d):
    """How many of a family are in a set, and whether at least so many are."""
    f = ad.persons(s, d).where("father <> 0 and mother <> 0").groupBy("father", "mother").agg(F.collect_list(F.when(F.col("genotyped"), F.col("id"))).alias("in_set"))
    return f.select("father", "mother", F.size("in_set").cast("long").alias("members"), (F.size("in_set") >= 2).alias("at_least_two"), F.exists("in_set", lambda x: x % 5 == 0).alias("has_fifth"))


@query(with_sql("calls", "SELECT part, COUNT(*) AS n, COUNT(DISTINCT smp) AS samples FROM (SELECT 0 AS part, smp FROM calls WHERE snp%2=0 UNION ALL SELECT 1, smp FROM calls WHERE snp%2=1) GROUP BY part"))
def q_concat(s, d):
    """Two problems over the same samples laid end to end by SNP."""
    c = ad.calls(s, d)
    both = c.where("snp % 2 = 0").withColumn("part", F.lit(0)).unionByName(c.where("snp % 2 = 1").withColumn("part", F.lit(1)))
    return both.groupBy("part").agg(F.count("*").alias("n"), F.count_distinct("smp").alias("samples"))


@query(with_sql("haps", """, g AS (SELECT snp, STRING_AGG(smp::VARCHAR, ',' ORDER BY smp) AS members FROM haps WHERE v=2 GROUP BY snp), o AS (SELECT *, CASE WHEN members IS NOT DISTINCT FROM LAG(members) OVER w AND snp=LAG(snp) OVER w+1 THEN 0 ELSE 1 END AS c FROM g WINDOW w AS (PARTITION BY snp//1000 ORDER BY snp)),
  i AS (SELECT *, SUM(c) OVER (PARTITION BY snp//1000 ORDER BY snp) AS k FROM o) SELECT MIN(snp) AS start, MAX(snp)+1 AS stop, members FROM i GROUP BY snp//1000, k, members"""))
def q_merge_consecutive(s, d):
    """Neighbouring pieces with equal members become one."""
    g = ad.haps(s, d).where("v = 2").groupBy("snp").agg(F.array_join(F.transform(F.array_sort(F.collect_list("smp")), lambda x: x.cast("string")), ",").alias("members")).withColumn("chrom", F.floor(F.col("snp") / 1000))
    w = W.partitionBy("chrom").orderBy("snp")
    new = F.coalesce(((F.lag("members").over(w) != F.col("members")) | (F.lag("snp").over(w) + 1 != F.col("snp"))).cast("int"), F.lit(1))
    i = g.withColumn("c", new).withColumn("k", F.sum("c").over(w))
    return i.groupBy("chrom", "k", "members").agg(F.min("snp").alias("start"), (F.max("snp") + 1).alias("stop")).select("start", "stop", "members")


@query(with_sql("segments", """, h AS (SELECT snp_start, snp_stop, s0 AS s, a0 AS a FROM segments UNION SELECT snp_start, snp_stop, s1, a1 FROM segments)
  SELECT snp_start, snp_stop, COUNT(*) AS haps, COUNT(DISTINCT s) AS samples, COUNT(DISTINCT s)<COUNT(*) AS ibd2 FROM h GROUP BY 1, 2"""))
def q_ibd2_groups(s, d):
    """Haplotypes by range, and whether a sample stands in one with both of its own."""
    g = ad.segments(s, d)
    h = g.select("snp_start", "snp_stop", F.col("s0").alias("s"), F.col("a0").alias("a")).union(g.select("snp_start", "snp_stop", "s1", "a1")).distinct()
    t = h.groupBy("snp_start", "snp_stop").agg(F.count("*").alias("haps"), F.count_distinct("s").alias("samples"))
    return t.withColumn("ibd2", F.col("samples") < F.col("haps"))


# text layouts


@query(with_sql("imputed", """SELECT snp, STRING_AGG(CASE WHEN b0=0 OR b1=0 THEN '0 0' ELSE TRANSLATE(b0||' '||b1, '12', 'AG') END, ' ' ORDER BY smp) AS line, STRING_AGG(TRANSLATE(b0||'/'||b1, '012', '.AG'), ' ' ORDER BY smp) AS slashed FROM imputed GROUP BY snp"""))
def q_letter_lines(s, d):
    """A line for each SNP: letters, both alleles 0 where one is missing; and letters parted by a slash."""
    b0, b1 = F.col("b0").cast("string"), F.col("b1").cast("string")
    cell = F.when((F.col("b0") == 0) | (F.col("b1") == 0), F.lit("0 0")).otherwise(F.translate(F.concat_ws(" ", b0, b1), "12", "AG"))
    rows = F.array_sort(F.collect_list(F.struct("smp", cell.alias("x"), F.translate(F.concat_ws("/", b0, b1), "012", ".AG").alias("y"))))
    out = ad.imputed(s, d).groupBy("snp").agg(rows.alias("r"))
    return out.select("snp", F.array_join(F.col("r.x"), " ").alias("line"), F.array_join(F.col("r.y"), " ").alias("slashed"))


@query(with_sql("imputed", "SELECT snp, smp*2+side AS pseudo, CASE WHEN side=0 THEN b0 ELSE b1 END AS a FROM imputed CROSS JOIN (VALUES (0), (1)) AS v(side) WHERE tag IN (2, 4) AND b0<>0 AND b1<>0"))
def q_origin_pseudo_samples(s, d):
    """Each haplotype of known origin as a homozygous sample of its own."""
    known = ad.imputed(s, d).where("tag in (2, 4) and b0 <> 0 and b1 <> 0")
    return known.select("snp", "smp", F.posexplode(F.array("b0", "b1")).alias("side", "a")).select("snp", (F.col("smp") * 2 + F.col("side")).alias("pseudo"), "a")


@query(with_sql("imputed", """, c AS (SELECT snp, smp, TRANSLATE(b0||''||b1, '012', 'N01') AS c FROM imputed) SELECT REGEXP_REPLACE(CASE WHEN c='NN' AND smp%2=0 THEN '' ELSE c END, '^(N[01]|[01]N)$', 'NN') AS cell, COUNT(*) AS n FROM c GROUP BY 1"""))
def q_normalised_cells(s, d):
    """Half calls become missing ones."""
    c = F.translate(F.concat(F.col("b0").cast("string"), F.col("b1").cast("string")), "012", "N01")
    c = F.when((c == "NN") & (F.col("smp") % 2 == 0), F.lit("")).otherwise(c)
    return ad.imputed(s, d).select(F.regexp_replace(c, "^(N[01]|[01]N)$", "NN").alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey AS region, MIN(p_partkey)-10 AS start, MAX(p_partkey)+10 AS stop FROM nation JOIN part ON p_size=n_nationkey+1 GROUP BY 1")
def q_gene_coordinates(s, d):
    """The range of each name with a margin on both sides."""
    j = ad.load(s, d, "nation").join(ad.load(s, d, "part"), F.col("p_size") == F.col("n_nationkey") + 1)
    return j.groupBy(F.col("n_nationkey").alias("region")).agg((F.min("p_partkey") - 10).alias("start"), (F.max("p_partkey") + 10).alias("stop"))


@query(with_sql("persons", """, p AS (SELECT id, ROW_NUMBER() OVER (PARTITION BY sex ORDER BY id)-1 AS place, sex FROM persons WHERE genotyped) SELECT p.id, place, sex FROM p WHERE id IN (SELECT o_custkey FROM orders)"""))
def q_ids_in_other(s, d):
    """Places of one study's samples that another one has too."""
    p = ad.persons(s, d).where("genotyped").select("id", (F.row_number().over(W.partitionBy("sex").orderBy("id")) - 1).cast("long").alias("place"), "sex")
    return p.join(ad.load(s, d, "orders").select(F.col("o_custkey").alias("id")), "id", "left_semi")


@query(with_sql("ld", "SELECT snp1%22 AS chrom, COUNT(*) AS edges, COUNT(DISTINCT snp1) AS anchors FROM ld GROUP BY 1"))
def q_ld_by_chrom(s, d):
    return ad.ld_edges(s, d).groupBy((F.col("snp1") % 22).alias("chrom")).agg(F.count("*").alias("edges"), F.count_distinct("snp1").alias("anchors"))


@query(with_sql("ld", "SELECT snp1 AS snp FROM ld UNION SELECT snp2 FROM ld"))
def q_ld_snps(s, d):
    e = ad.ld_edges(s, d)
    return e.select(F.col("snp1").alias("snp")).union(e.select("snp2")).distinct()


@query(with_sql("calls", f""", {_R}, m AS (SELECT snp, SUM(CASE WHEN g>0 THEN 4-g ELSE 0 END) < SUM(CASE WHEN g>0 THEN g-2 ELSE 0 END) AS flip FROM r GROUP BY snp) SELECT c.snp, smp, CASE WHEN NOT flip AND a0<>0 THEN 3-a0 ELSE a0 END AS m0, CASE WHEN NOT flip AND a1<>0 THEN 3-a1 ELSE a1 END AS m1 FROM calls c JOIN m ON m.snp=c.snp"""))
def q_minor_first(s, d):
    """Alleles recoded so that 1 is the rarer one, or 2 where both are as frequent."""
    g = F.col("g")
    m = _recoded(s, d).groupBy("snp").agg((F.sum(F.when(g > 0, 4 - g).otherwise(0)) < F.sum(F.when(g > 0, g - 2).otherwise(0))).alias("flip"))
    own = lambda a: F.when(F.col("flip"), F.col(a)).otherwise(rc.swap(F.col(a)))
    return ad.calls(s, d).join(m, "snp").select("snp", "smp", own("a0").alias("m0"), own("a1").alias("m1"))


@query(with_sql("ld", "SELECT snp2 AS near, r2 FROM ld WHERE snp1=100 AND snp2 BETWEEN 90 AND 110 UNION ALL SELECT snp1, r2 FROM ld WHERE snp2=100 AND snp1 BETWEEN 90 AND 110"))
def q_variants_near(s, d):
    """Variants of a region with their linkage to one of them, strongest first."""
    e = ad.ld_edges(s, d)
    both = e.select("snp1", "snp2", "r2").union(e.select("snp2", "snp1", "r2")).where("snp1 = 100 and snp2 between 90 and 110")
    return both.select(F.col("snp2").alias("near"), "r2").orderBy(F.desc("r2"), "near")
