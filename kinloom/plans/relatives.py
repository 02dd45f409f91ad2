"""Queries about relatives: neighbours, induced pedigrees, parents filled from children, parent of origin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom import adapters as ad
from kinloom.adapters import with_sql
from kinloom.operators import graph, joins, origin, phasing, sequence
from kinloom.plans.register import query

DEPTH = 2


def _around(s, d) -> DataFrame:
    p = ad.persons(s, d)
    return graph.neighbours(p, p.where("id % 20 = 0"), DEPTH)


_AROUND = """, e AS (SELECT parent AS a, child AS b FROM parents UNION SELECT child, parent FROM parents),
  q AS (SELECT id FROM persons WHERE id%20=0), one AS (SELECT DISTINCT q.id, e.b FROM q JOIN e ON e.a=q.id),
  n AS (SELECT id, neighbour, MIN(distance)::INTEGER AS distance FROM (SELECT id, id AS neighbour, 0 AS distance FROM q UNION ALL SELECT id, b, 1 FROM one
    UNION ALL SELECT DISTINCT one.id, e.b, 2 FROM one JOIN e ON e.a=one.b) GROUP BY 1,2)"""


@query(with_sql("persons parents", _AROUND + " SELECT * FROM n"))
def q_neighbours(s, d):
    return _around(s, d)


@query(with_sql("persons parents", _AROUND + """, g AS (SELECT n.id, n.neighbour FROM n JOIN persons p ON p.id=n.neighbour WHERE p.genotyped),
  w AS (SELECT id, neighbour FROM g UNION SELECT g.id, r.parent FROM g JOIN parents r ON r.child=g.neighbour) SELECT id, COUNT(*) AS n, SUM(neighbour)::BIGINT AS total FROM w GROUP BY id"""))
def q_neighbours_with_parents(s, d):
    """Genotyped neighbours, with the parents that complete their pedigree."""
    p = ad.persons(s, d)
    near = _around(s, d).join(p.where("genotyped").select(F.col("id").alias("neighbour")), "neighbour", "left_semi").select("id", "neighbour")
    up = near.join(graph.parent_edges(p), near["neighbour"] == F.col("child")).select("id", F.col("parent").alias("neighbour"))
    return near.union(up).distinct().groupBy("id").agg(F.count("*").alias("n"), F.sum("neighbour").alias("total"))


@query(with_sql("persons", """SELECT id, ROW_NUMBER() OVER (ORDER BY NOT genotyped, id)-1 AS node FROM persons"""))
def q_numbered_pedigree(s, d):
    """Persons recoded so that genotyped ones come first."""
    return graph.numbered(ad.persons(s, d), 256).select("id", "node")


@query(with_sql("persons parents", """, i AS (SELECT id FROM persons WHERE genotyped UNION SELECT r.parent FROM parents r JOIN persons p ON p.id=r.child WHERE p.genotyped),
  k AS (SELECT p.*, ROW_NUMBER() OVER (ORDER BY NOT genotyped, id)-1 AS node FROM persons p WHERE id IN (SELECT id FROM i))
  SELECT k.node, k.id, f.node AS father, m.node AS mother FROM k LEFT JOIN k f ON f.id=k.father LEFT JOIN k m ON m.id=k.mother"""))
def q_sub_pedigree(s, d):
    """The pedigree of the genotyped persons and their parents."""
    p = ad.persons(s, d)
    genotyped = p.where("genotyped")
    return graph.sub_pedigree(p, genotyped.select("id").union(graph.parent_edges(genotyped).select("parent")))


@query(with_sql("calls imputed", """, g AS (SELECT snp, 2*(smp//4) AS smp, b0 AS v, smp AS child FROM imputed WHERE smp>=4 AND b0<>0 AND b1<>0
    UNION ALL SELECT snp, 2*(smp//4)+1, b1, smp FROM imputed WHERE smp>=4 AND b0<>0 AND b1<>0),
  l AS (SELECT snp, smp, ARG_MAX(v, child) AS v FROM g GROUP BY 1,2)
  SELECT snp, smp, CASE WHEN a0=0 AND v IS NOT NULL THEN v ELSE a0 END AS a0, CASE WHEN a0<>0 AND a1=0 AND v IS NOT NULL THEN v ELSE a1 END AS a1 FROM calls LEFT JOIN l USING (snp, smp)"""))
def q_impute_parents(s, d):
    """A parent's missing allele from a phased child."""
    haps = ad.imputed(s, d).select("snp", "smp", F.col("b0").alias("h0"), F.col("b1").alias("h1"))
    father = 2 * F.floor(F.col("smp") / 4)
    family = haps.select("smp").distinct().where("smp >= 4").select("smp", father.alias("father"), (father + 1).alias("mother"))
    return phasing.impute_parents(ad.calls(s, d), haps, family)


def _measure(s, d) -> DataFrame:
    at = ad.load(s, d, "lineitem").select(F.floor(F.col("l_partkey") / 16).alias("place"), (F.col("l_suppkey") % ad.SAMPLES).alias("smp")).distinct()
    grp = (F.col("smp") * 5 + F.col("place") * 3 + F.col("allele") * 7 + F.floor(F.col("smp") / 3)) % 3
    cliques = at.select("place", "smp", F.explode(F.array(F.lit(0), F.lit(1))).alias("allele")).withColumn("grp", grp)
    founders = at.select("smp").distinct().where("smp % 5 <> 0").select("smp", (1000 + F.floor(F.col("smp") / 4)).alias("father"), (2000 + F.floor(F.col("smp") / 5)).alias("mother"))
    ids = founders.select(F.explode(F.array("father", "mother")).alias("id")).distinct()
    kin = ids.crossJoin(F.broadcast(founders.select("smp"))).select("id", "smp", (((F.col("id") * 13 + F.col("smp") * 7) % 17 + 1) / 64.0).alias("k"))
    return origin.flip_measure(cliques, founders, kin)


_K = "((({0})*13+other*7)%17+1)::DOUBLE/64"
_MEASURE = f"""WITH c AS (SELECT place, smp, allele, (smp*5+place*3+allele*7+smp//3)%3 AS grp FROM (SELECT DISTINCT l_partkey//16 AS place, l_suppkey%64 AS smp FROM lineitem), (VALUES (0),(1)) v(allele) WHERE smp%5<>0),
  o AS (SELECT DISTINCT place, grp, smp AS other FROM c),
  k AS (SELECT place, smp, allele, COUNT(*) AS n, MEDIAN({_K.format('1000+smp//4')}) AS f, MEDIAN({_K.format('2000+smp//5')}) AS m
    FROM c JOIN o USING (place, grp) WHERE NOT (other//4=smp//4 AND other//5=smp//5) GROUP BY 1,2,3),
  t AS (SELECT x.place, x.smp, x.n AS n0, y.n AS n1, LN((x.f*y.m)/(x.m*y.f)) AS l FROM k x JOIN k y ON x.place=y.place AND x.smp=y.smp AND x.allele=0 AND y.allele=1 AND x.n>=3 AND y.n>=3),
  w AS (SELECT place, smp, n0, n1, l/(1+ABS(l)) AS sep FROM t)"""


@query(_MEASURE + " SELECT place, smp, n0, n1, ROUND(sep, 6) AS sep FROM w")
def q_poo_measure(s, d):
    """How strongly kinship separates the two cliques of each quasi-founder."""
    return _measure(s, d).withColumn("sep", F.round("sep", 6))


@query(_MEASURE + """, z AS (SELECT smp, COUNT(*) FILTER (sep>0.05) AS n_plus, COUNT(*) FILTER (sep< -0.05) AS n_minus, COUNT(*) AS n FROM w GROUP BY smp)
  SELECT smp, n_plus, n_minus, n, ROUND(GREATEST(n_plus, n_minus)/(n_plus+n_minus+1e-15), 6) AS m,
  CASE WHEN GREATEST(n_plus, n_minus)/(n_plus+n_minus+1e-15)>=0.6 THEN CASE WHEN n_plus>n_minus THEN 1 ELSE -1 END ELSE 0 END AS phase FROM z""")
def q_poo_decision(s, d):
    """Which quasi-founders are the wrong way round."""
    return origin.flip_decision(_measure(s, d), 0.05, 0.6).withColumn("m", F.round("m", 6))


@query(with_sql("haps", """, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY smp ORDER BY snp)-1 AS i, COUNT(*) OVER (PARTITION BY smp) AS n FROM haps),
  j AS (SELECT smp, snp, n, ((i+k)%(2*n)+2*n)%(2*n) AS p FROM r, (SELECT UNNEST(RANGE(-4, 5)) AS k)),
  x AS (SELECT smp, snp, CASE WHEN p<n THEN p ELSE 2*n-1-p END AS i FROM j)
  SELECT x.smp, x.snp, MEDIAN(r.v)::INTEGER AS m FROM x JOIN r ON r.smp=x.smp AND r.i=x.i GROUP BY 1,2"""))
def q_median9(s, d):
    """A median filter of width 9."""
    return sequence.median(ad.haps(s, d), ["smp"], "snp", "v", 9)


@query("""WITH m AS (SELECT s_suppkey%4 AS chrom, s_suppkey*70000 AS bp, s_suppkey*11+s_suppkey%7 AS cm FROM supplier),
  p AS (SELECT p_partkey AS snp, p_partkey%4 AS chrom, p_partkey*10000 AS bp FROM part)
  SELECT p.snp, ROUND(CASE WHEN l.bp IS NULL OR r.bp IS NULL THEN 0 WHEN l.bp=r.bp THEN l.cm ELSE l.cm+(r.cm-l.cm)*(p.bp-l.bp)/(r.bp-l.bp)::DOUBLE END, 6)::DOUBLE AS cm
  FROM p ASOF LEFT JOIN m l ON l.chrom=p.chrom AND l.bp<=p.bp ASOF LEFT JOIN m r ON r.chrom=p.chrom AND r.bp>=p.bp""")
def q_map_positions(s, d):
    """Genetic positions from a map, 0 beyond its ends."""
    k, j = F.col("s_suppkey"), F.col("p_partkey")
    grid = ad.load(s, d, "supplier").select((k % 4).alias("chrom"), (k * 70000).alias("bp"), (k * 11 + k % 7).cast("double").alias("cm"))
    points = ad.load(s, d, "part").select(j.alias("snp"), (j % 4).alias("chrom"), (j * 10000).alias("bp"))
    return joins.interpolate(points, grid, "bp", "cm", ["chrom"], F.lit(0.0)).select("snp", F.round("cm", 6).alias("cm"))
