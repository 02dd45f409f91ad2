"""Registered queries over the test tables, each with the SQL that it must agree with where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinloom import adapters as ad
from kinloom.adapters import with_sql
from kinloom.functions import recode as rc
from kinloom.operators import graph, intervals, joins, kernels, phasing, sequence, stats
from kinloom.plans.register import ORACLES, QUERIES, query  # noqa: F401

def _n(condition):
    return F.count_if(condition)


RECODED = "r AS (SELECT *, CASE WHEN a0=0 OR a1=0 THEN -(a0+a1) ELSE a0+a1 END AS g FROM calls)"


def _recoded(s, d) -> DataFrame:
    return ad.calls(s, d).withColumn("g", rc.recode(F.col("a0"), F.col("a1")))


@query(with_sql("calls", f""", {RECODED} SELECT snp, COUNT(*) FILTER (g=2) AS n11, COUNT(*) FILTER (g=3) AS n12,
  COUNT(*) FILTER (g=4) AS n22, COUNT(*) FILTER (g=0) AS n00 FROM r GROUP BY snp"""))
def q_genotype_counts(s, d):
    return stats.genotype_counts(_recoded(s, d))


@query(with_sql("calls", f""", {RECODED}, c AS (SELECT snp, COUNT(*) FILTER (g=2) AS n11, COUNT(*) FILTER (g=3) AS n12,
  COUNT(*) FILTER (g=4) AS n22 FROM r GROUP BY snp) SELECT snp, ROUND((2*n11+n12)/(2.0*(n11+n12+n22)), 6) AS f1 FROM c WHERE n11+n12+n22>0"""))
def q_allele_freq(s, d):
    c = stats.genotype_counts(_recoded(s, d)).where("n11+n12+n22 > 0")
    return c.select("snp", F.round(rc.allele_frequency(F.col("n11"), F.col("n12"), F.col("n22")), 6).alias("f1"))


@query(with_sql("calls", f""", {RECODED} SELECT snp, ROUND(AVG(CASE WHEN g>0 THEN 1.0 ELSE 0.0 END), 6) AS call_rate,
  ROUND(SUM(CASE WHEN a0<>0 THEN 1 ELSE 0 END + CASE WHEN a1<>0 THEN 1 ELSE 0 END)/(2.0*COUNT(*)), 6) AS fill FROM r GROUP BY snp"""))
def q_call_rate_snp(s, d):
    return stats.call_rate(_recoded(s, d), "snp")


@query(with_sql("calls", f""", {RECODED} SELECT smp, ROUND(AVG(CASE WHEN g>0 THEN 1.0 ELSE 0.0 END), 6) AS call_rate,
  ROUND(SUM(CASE WHEN a0<>0 THEN 1 ELSE 0 END + CASE WHEN a1<>0 THEN 1 ELSE 0 END)/(2.0*COUNT(*)), 6) AS fill FROM r GROUP BY smp"""))
def q_call_rate_sample(s, d):
    return stats.call_rate(_recoded(s, d), "smp")


_NINE = {"NN": (0, 0), "N0": (0, 1), "N1": (0, 2), "0N": (1, 0), "00": (1, 1), "01": (1, 2), "1N": (2, 0), "10": (2, 1), "11": (2, 2)}


@query(with_sql("calls", "SELECT snp, " + ", ".join(f"COUNT(*) FILTER (a0={a} AND a1={b}) AS \"c{k}\"" for k, (a, b) in _NINE.items()) + """,
  ROUND(1 - COUNT(*) FILTER (a0=0 AND a1=0)/CAST(COUNT(*) AS DOUBLE), 6) AS allele_rate,
  ROUND(COUNT(*) FILTER (a0<>0 AND a1<>0)/CAST(COUNT(*) AS DOUBLE), 6) AS genotype_rate FROM calls GROUP BY snp"""))
def q_genotype9(s, d):
    return stats.nine_way(ad.calls(s, d), "snp")


@query(with_sql("calls imputed", """, j AS (SELECT snp, smp, a0+a1 AS x, b0+b1 AS y FROM calls JOIN imputed USING (snp, smp)
  WHERE a0<>0 AND a1<>0 AND b0<>0 AND b1<>0), k AS (SELECT DISTINCT snp FROM calls)
  SELECT k.snp, ROUND(COALESCE(AVG(CASE WHEN x=y THEN 1.0 ELSE 0.0 END), 1.0), 6) AS concordance FROM k LEFT JOIN j ON k.snp=j.snp GROUP BY k.snp"""))
def q_concordance_snp(s, d):
    return stats.concordance(_pairs(s, d), "snp")


def _pairs(s, d) -> DataFrame:
    both = ad.calls(s, d).join(ad.imputed(s, d), ["snp", "smp"])
    return both.withColumns({"x": rc.recode(F.col("a0"), F.col("a1")), "y": rc.recode(F.col("b0"), F.col("b1"))})


@query(with_sql("calls imputed", """, j AS (SELECT snp, smp, a0, a1, b0, b1 FROM calls JOIN imputed USING (snp, smp))
  SELECT smp, COUNT(*) FILTER (b0<>0 AND b1<>0) AS full_n, COUNT(*) FILTER ((b0<>0)<>(b1<>0)) AS partial_n,
  COUNT(*) FILTER (b0=0 AND b1=0) AS missing_n, COUNT(*) FILTER ((a0=0 OR a1=0) AND b0<>0 AND b1<>0) AS imputed_n,
  COUNT(*) FILTER ((a0<>0 AND a1<>0) AND NOT (b0<>0 AND b1<>0)) AS lost_n FROM j GROUP BY smp"""))
def q_imputation_counts(s, d):
    j = _pairs(s, d)
    x, y = F.col("x"), F.col("y")
    return j.groupBy("smp").agg(_n(y > 0).alias("full_n"), _n(y < 0).alias("partial_n"), _n(y == 0).alias("missing_n"), _n((x <= 0) & (y > 0)).alias("imputed_n"), _n((x > 0) & (y <= 0)).alias("lost_n"))


@query(with_sql("calls", f""", {RECODED}, c AS (SELECT snp, COUNT(*) FILTER (g=2) AS n11, COUNT(*) FILTER (g=3) AS n12,
  COUNT(*) FILTER (g=4) AS n22, COUNT(*) FILTER (g>0) AS n, COUNT(*) AS m FROM r GROUP BY snp),
  f AS (SELECT snp, LEAST(2*n11+n12, 2*n22+n12) AS minor, 2*n AS total, n, m FROM c WHERE n>0)
  SELECT CAST((minor*50)//total AS BIGINT) AS bin, COUNT(*) AS snps, ROUND(AVG(n/CAST(m AS DOUBLE)), 6) AS mean_call_rate FROM f GROUP BY 1"""))
def q_maf_bins(s, d):
    return stats.by_maf(_recoded(s, d), 50)


@query(with_sql("calls imputed", """, j AS (SELECT CASE WHEN a0=0 OR a1=0 THEN -(a0+a1) ELSE a0+a1 END AS x,
  CASE WHEN b0=0 OR b1=0 THEN -(b0+b1) ELSE b0+b1 END AS y FROM calls JOIN imputed USING (snp, smp)),
  t AS (SELECT CASE WHEN x=0 OR y=0 THEN 0 WHEN x>0 AND y>0 THEN CASE WHEN x=y THEN 2 WHEN ABS(x-y)=1 THEN 1 ELSE 0 END
    WHEN x>0 THEN CASE WHEN x=3 OR x=-2*y THEN 1 ELSE 0 END WHEN y>0 THEN CASE WHEN y=3 OR y=-2*x THEN 1 ELSE 0 END
    ELSE CASE WHEN x=y THEN 1 ELSE 0 END END AS state FROM j) SELECT state, COUNT(*) AS n FROM t GROUP BY state"""))
def q_ibs_state(s, d):
    return _pairs(s, d).groupBy(rc.ibs_state(F.col("x"), F.col("y")).alias("state")).agg(F.count("*").alias("n"))


@query(with_sql("haps", """SELECT a.smp AS x, b.smp AS y, COUNT(*) AS snps, SUM(CASE WHEN a.v<>b.v THEN 1 ELSE 0 END)::BIGINT AS differ
  FROM haps a JOIN haps b ON a.snp=b.snp AND a.smp<b.smp GROUP BY 1, 2"""))
def q_hap_diff(s, d):
    return stats.hap_differences(ad.haps(s, d))


@query(with_sql("calls imputed", """, j AS (SELECT b0 AS h0, b1 AS h1, a0 AS g0, a1 AS g1 FROM calls JOIN imputed USING (snp, smp)),
  p AS (SELECT *, CASE WHEN h0=0 AND h1<>0 AND g0<>0 AND g1<>0 THEN CASE WHEN g0=h1 THEN g1 WHEN g1=h1 THEN g0 ELSE h0 END ELSE h0 END AS n0 FROM j),
  q AS (SELECT *, CASE WHEN h1=0 AND n0<>0 AND g0<>0 AND g1<>0 THEN CASE WHEN g0=n0 THEN g1 WHEN g1=n0 THEN g0 ELSE h1 END ELSE h1 END AS n1 FROM p)
  SELECT n0, n1, COUNT(*) AS n FROM q GROUP BY n0, n1"""))
def q_complete_haplotype(s, d):
    j = _pairs(s, d).select(F.col("b0").alias("h0"), F.col("b1").alias("h1"), F.col("a0").alias("g0"), F.col("a1").alias("g1"))
    first = j.withColumn("n0", rc.complete_haplotype(F.col("h0"), F.col("h1"), F.col("g0"), F.col("g1")))
    return first.withColumn("n1", rc.complete_haplotype(F.col("h1"), F.col("n0"), F.col("g0"), F.col("g1"))).groupBy("n0", "n1").agg(F.count("*").alias("n"))


@query(with_sql("haps", """, g AS (SELECT snp, smp, v, snp - ROW_NUMBER() OVER (PARTITION BY smp, v ORDER BY snp) AS island FROM haps)
  SELECT smp, MIN(snp) AS start, MAX(snp)+1 AS stop FROM g WHERE v=2 GROUP BY smp, island HAVING COUNT(*)>=2"""))
def q_islands(s, d):
    return sequence.segments_with_value(ad.haps(s, d), ["smp"], "snp", "v", 2, 2)


@query(with_sql("haps", """, o AS (SELECT smp, snp, v, CASE WHEN v IS NOT DISTINCT FROM LAG(v) OVER (PARTITION BY smp ORDER BY snp) THEN 0 ELSE 1 END AS c FROM haps),
  i AS (SELECT *, SUM(c) OVER (PARTITION BY smp ORDER BY snp) AS k FROM o)
  SELECT smp, MIN(v) AS v, MIN(snp) AS first, MAX(snp) AS last, COUNT(*) AS n FROM i GROUP BY smp, k"""))
def q_run_lengths(s, d):
    return sequence.runs(ad.haps(s, d), ["smp"], "snp", "v")


@query("""WITH e AS (SELECT user_id, ts, event_id, event_type, LAG(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
  SELECT user_id, COUNT(*) AS changes FROM e WHERE before IS NOT NULL AND before<>event_type GROUP BY user_id""")
def q_change_points(s, d):
    e = ad.load(s, d, "events").select("user_id", F.struct("ts", "event_id").alias("at"), "event_type")
    return sequence.change_points(e, ["user_id"], "at", "event_type").groupBy("user_id").agg(F.count("*").alias("changes"))


@query(with_sql("haps", """, o AS (SELECT smp, snp, v-1 AS v, ROW_NUMBER() OVER w AS i, COUNT(*) OVER (PARTITION BY smp) AS n,
  LAG(v-1,1) OVER w AS b1, LAG(v-1,2) OVER w AS b2, LEAD(v-1,1) OVER w AS f1, LEAD(v-1,2) OVER w AS f2 FROM haps WINDOW w AS (PARTITION BY smp ORDER BY snp))
  SELECT smp, snp, CASE WHEN v+COALESCE(b1,v)+COALESCE(f1,v)+COALESCE(b2,b1,f1,v)+COALESCE(f2,f1,b1,v)>=3 THEN 1 ELSE 0 END AS m FROM o"""))
def q_median5(s, d):
    h = ad.haps(s, d).withColumn("v", F.col("v") - 1)
    return h.select("smp", "snp", sequence.median5(h, ["smp"], "snp", "v").alias("m"))


@query(with_sql("segments", """, r AS (SELECT snp_start, s0, s1, snp_stop, ROW_NUMBER() OVER (PARTITION BY snp_start ORDER BY snp_stop-snp_start DESC, s0 DESC, s1 DESC) AS k FROM segments)
  SELECT snp_start, s0, s1, snp_stop-snp_start AS length FROM r WHERE k=1"""))
def q_best_segment(s, d):
    seg = ad.segments(s, d).select("snp_start", (F.col("snp_stop") - F.col("snp_start")).alias("length"), F.struct("s0", "s1").alias("pair"))
    best = sequence.best_per_position(seg, ["snp_start"], "length", "pair")
    return best.select("snp_start", "pair.s0", "pair.s1", "length")


_GRID = "grid AS (SELECT DISTINCT c_nationkey AS grp, CAST(c_custkey*100 AS BIGINT) AS pos FROM customer), pts AS (SELECT DISTINCT s_nationkey AS grp, CAST(s_suppkey*1130 AS BIGINT) AS pos FROM supplier)"
_SIDES = _GRID + """, l AS (SELECT p.grp, p.pos, MAX(g.pos) AS l_pos FROM pts p LEFT JOIN grid g ON g.grp=p.grp AND g.pos<=p.pos GROUP BY 1,2),
  b AS (SELECT l.grp, l.pos, l.l_pos, MIN(g.pos) AS r_pos FROM l LEFT JOIN grid g ON g.grp=l.grp AND g.pos>=l.pos GROUP BY 1,2,3)"""


def _points(s, d) -> tuple[DataFrame, DataFrame]:
    grid = ad.load(s, d, "customer").select(F.col("c_nationkey").alias("grp"), (F.col("c_custkey") * 100).alias("pos")).distinct()
    return ad.load(s, d, "supplier").select(F.col("s_nationkey").alias("grp"), (F.col("s_suppkey") * 1130).alias("pos")).distinct(), grid


@query(f"WITH {_SIDES} SELECT grp, pos, CASE WHEN r_pos IS NULL OR (l_pos IS NOT NULL AND pos-l_pos<r_pos-pos) THEN l_pos ELSE r_pos END AS n_pos FROM b")
def q_nearest_snp(s, d):
    p, g = _points(s, d)
    return joins.nearest(p, g, "pos", [], ["grp"])


@query(f"WITH {_SIDES} SELECT grp, pos, CASE WHEN r_pos IS NULL OR (l_pos IS NOT NULL AND pos-l_pos<=r_pos-pos) THEN l_pos ELSE r_pos END AS n_pos FROM b")
def q_nearest_sorted(s, d):
    p, g = _points(s, d)
    return joins.nearest(p, g, "pos", [], ["grp"], tie_right=False)


@query(f"WITH {_SIDES} SELECT grp, pos, l_pos FROM b")
def q_nearest_left(s, d):
    p, g = _points(s, d)
    return joins.asof_left(p, g, "pos", [], ["grp"])


@query(f"""WITH {_SIDES} SELECT grp, pos, ROUND(CASE WHEN l_pos IS NULL THEN r_pos%97 WHEN r_pos IS NULL THEN l_pos%97 WHEN l_pos=r_pos THEN l_pos%97
  ELSE l_pos%97 + (r_pos%97 - l_pos%97)*(pos-l_pos)/CAST(r_pos-l_pos AS DOUBLE) END, 6) AS lam FROM b""")
def q_lambda_interp(s, d):
    p, g = _points(s, d)
    out = joins.interpolate(p, g.withColumn("lam", (F.col("pos") % 97).cast("double")), "pos", "lam", ["grp"])
    return out.select("grp", "pos", F.round("lam", 6).alias("lam"))


@query(with_sql("segments snps", """SELECT snp, COUNT(*) AS n, COUNT(DISTINCT s0) AS left_samples FROM snps JOIN segments ON snp_start<=snp AND snp<snp_stop GROUP BY snp"""))
def q_segments_at_snp(s, d):
    return _at_snps(s, d).groupBy("snp").agg(F.count("*").alias("n"), F.countDistinct("s0").alias("left_samples"))


def _at_snps(s, d) -> DataFrame:
    p = ad.snps(s, d).select("snp", (F.col("snp") + 1).alias("snp_end"))
    return joins.range_join(p, ad.segments(s, d), "snp", "snp_end", "snp_start", "snp_stop", 64)


@query(with_sql("segments snps", """SELECT snp, ROUND(SUM(0.001+0.999*(1-EXP((bp_start-bp)/m))*(1-EXP((bp-bp_stop)/m))), 4) AS weight FROM
  (SELECT snp, bp, bp_start, bp_stop, 4e5+(2e6-4e5)/(1+(bp_stop-bp_start)/2e6) AS m FROM snps JOIN segments ON snp_start<=snp AND snp<snp_stop) GROUP BY snp"""))
def q_ibd_edge_weight(s, d):
    w = rc.edge_weight(F.col("bp_start"), F.col("bp_stop"), F.col("snp") * ad.BP)
    return _at_snps(s, d).groupBy("snp").agg(F.round(F.sum(w), 4).alias("weight"))


_PAIR = "SELECT a.s0 AS hap, a.snp_start AS x0, a.snp_stop AS x1, b.snp_start AS y0, b.snp_stop AS y1, a.s1 AS xs, b.s1 AS ys FROM segments a JOIN segments b ON a.s0=b.s0 AND a.a0=b.a0 AND a.snp_start<b.snp_stop AND b.snp_start<a.snp_stop AND a.s1<b.s1"


@query(with_sql("segments", f"SELECT hap, COUNT(*) AS n, SUM(LEAST(x1,y1)-GREATEST(x0,y0))::BIGINT AS shared FROM ({_PAIR}) GROUP BY hap"))
def q_segments_overlap(s, d):
    g = ad.segments(s, d)
    x = g.select("s0", "a0", F.col("s1").alias("xs"), F.col("snp_start").alias("x0"), F.col("snp_stop").alias("x1"))
    y = g.select("s0", "a0", F.col("s1").alias("ys"), F.col("snp_start").alias("y0"), F.col("snp_stop").alias("y1"))
    both = joins.range_join(x, y, "x0", "x1", "y0", "y1", 64, ["s0", "a0"]).where("xs < ys")
    return both.groupBy(F.col("s0").alias("hap")).agg(F.count("*").alias("n"), F.sum(F.least("x1", "y1") - F.greatest("x0", "y0")).alias("shared"))


_SYM = "sym AS (SELECT s0 AS s, a0 AS a, s1 AS t, a1 AS b, snp_start, snp_stop FROM segments UNION ALL SELECT s1, a1, s0, a0, snp_start, snp_stop FROM segments)"


@query(with_sql("segments", f", {_SYM} SELECT s, a, t, COUNT(*) AS n, MAX(snp_stop-snp_start) AS longest FROM sym WHERE t IN (SELECT n_nationkey FROM nation) GROUP BY s, a, t"))
def q_find_segments(s, d):
    targets = ad.load(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("t"))
    sym = stats.symmetric(ad.segments(s, d)).join(targets, "t", "left_semi")
    return sym.groupBy("s", "a", "t").agg(F.count("*").alias("n"), F.max(F.col("snp_stop") - F.col("snp_start")).alias("longest"))


def _union_sql(name: str, source: str) -> str:
    return f"""{name}0 AS (SELECT *, MAX(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ({source})),
  {name}1 AS (SELECT *, SUM(CASE WHEN reach IS NULL OR a>reach THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM {name}0),
  {name} AS (SELECT k, MIN(a) AS a, MAX(b) AS b FROM {name}1 GROUP BY k, i)"""


_UA = _union_sql("ua", "SELECT s0 AS k, snp_start AS a, snp_stop AS b FROM segments")
_UB = _union_sql("ub", "SELECT s1 AS k, snp_start AS a, snp_stop AS b FROM segments")


def _sides(s, d) -> tuple[DataFrame, DataFrame]:
    g = ad.segments(s, d)
    pick = lambda c: g.select(F.col(c).alias("k"), F.col("snp_start").alias("a"), F.col("snp_stop").alias("b"))
    return pick("s0"), pick("s1")


@query(with_sql("segments", f", {_UA} SELECT k, a, b FROM ua"))
def q_interval_union(s, d):
    return intervals.union(_sides(s, d)[0], ["k"], "a", "b")


@query(with_sql("segments", f", {_UA}, {_UB} SELECT ua.k, GREATEST(ua.a,ub.a) AS a, LEAST(ua.b,ub.b) AS b FROM ua JOIN ub ON ua.k=ub.k AND ua.a<ub.b AND ub.a<ua.b"))
def q_interval_and(s, d):
    return intervals.intersection(*_sides(s, d), ["k"], 256, "a", "b")


@query(with_sql("segments", f", {_union_sql('u', 'SELECT s0 AS k, snp_start AS a, snp_stop AS b FROM segments UNION ALL SELECT s1, snp_start, snp_stop FROM segments')} SELECT k, COUNT(*) AS n, SUM(b-a)::BIGINT AS length FROM u GROUP BY k"))
def q_interval_or(s, d):
    u = intervals.either(*_sides(s, d), ["k"], "a", "b")
    return u.groupBy("k").agg(F.count("*").alias("n"), F.sum(F.col("b") - F.col("a")).alias("length"))


_SAMPLE_PAIRS = _union_sql("p", "SELECT LEAST(s0,s1)*1000+GREATEST(s0,s1) AS k, snp_start AS a, snp_stop AS b FROM segments")


def _by_pair(s, d) -> DataFrame:
    g = ad.segments(s, d)
    return g.select((F.least("s0", "s1") * 1000 + F.greatest("s0", "s1")).alias("k"), F.col("snp_start").alias("a"), F.col("snp_stop").alias("b"))


@query(with_sql("segments", f", {_SAMPLE_PAIRS} SELECT k, STRING_AGG(a || ' ' || b, ' ' ORDER BY a) AS ends FROM p GROUP BY k"))
def q_segment2ibd(s, d):
    u = intervals.union(_by_pair(s, d), ["k"], "a", "b")
    return u.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "b"))), lambda x: F.concat_ws(" ", x["a"].cast("string"), x["b"].cast("string"))), " ").alias("ends"))


@query(with_sql("segments", f", {_UA}, {_UB}, i AS (SELECT ua.k, SUM(LEAST(ua.b,ub.b)-GREATEST(ua.a,ub.a)) AS n FROM ua JOIN ub ON ua.k=ub.k AND ua.a<ub.b AND ub.a<ua.b GROUP BY 1), "
  "la AS (SELECT k, SUM(b-a) AS n FROM ua GROUP BY k), lb AS (SELECT k, SUM(b-a) AS n FROM ub GROUP BY k) "
  "SELECT COALESCE(la.k,lb.k) AS k, COALESCE(la.n,0)::BIGINT AS length_a, COALESCE(lb.n,0)::BIGINT AS length_b, COALESCE(i.n,0)::BIGINT AS shared FROM la FULL JOIN lb ON la.k=lb.k LEFT JOIN i ON i.k=COALESCE(la.k,lb.k)"))
def q_compare_segments(s, d):
    a, b = _sides(s, d)
    size = lambda x, n: x.groupBy("k").agg(F.sum(F.col("b") - F.col("a")).alias(n))
    out = size(intervals.union(a, ["k"], "a", "b"), "length_a").join(size(intervals.union(b, ["k"], "a", "b"), "length_b"), "k", "full")
    return out.join(size(intervals.intersection(a, b, ["k"], 256, "a", "b"), "shared"), "k", "left").na.fill(0)


@query(with_sql("segments", f", {_UA} SELECT k, ROUND(100.0*SUM(b-a)/(SELECT MAX(snp_stop) FROM segments), 6) AS coverage FROM ua GROUP BY k"))
def q_coverage(s, d):
    g = ad.segments(s, d)
    u = intervals.union(_sides(s, d)[0], ["k"], "a", "b").groupBy("k").agg(F.sum(F.col("b") - F.col("a")).alias("n"))
    return u.join(F.broadcast(g.agg(F.max("snp_stop").alias("end"))), F.lit(True)).select("k", F.round(100 * F.col("n") / F.col("end"), 6).alias("coverage"))


@query(with_sql("segments", """, e AS (SELECT DISTINCT k, x FROM (SELECT s0 AS k, snp_start AS x FROM segments UNION ALL SELECT s0, snp_stop FROM segments)),
  t AS (SELECT k, x AS lo, LEAD(x) OVER (PARTITION BY k ORDER BY x) AS hi FROM e)
  SELECT t.k, lo, hi, COUNT(*) AS depth FROM t JOIN segments g ON g.s0=t.k AND lo<snp_stop AND snp_start<hi WHERE hi IS NOT NULL GROUP BY 1,2,3"""))
def q_atoms(s, d):
    return intervals.covered_atoms(_sides(s, d)[0], ["k"], 64, "a", "b").groupBy("k", "lo", "hi").agg(F.count("*").alias("depth"))


@query(with_sql("persons parents", "SELECT p.parent, p.child, p.typ FROM parents p JOIN persons a ON a.id=p.parent AND a.genotyped JOIN persons b ON b.id=p.child AND b.genotyped"))
def q_duos(s, d):
    p = ad.persons(s, d)
    typed = p.where("genotyped").select("id")
    e = graph.parent_edges(p)
    return e.join(typed.withColumnRenamed("id", "parent"), "parent", "left_semi").join(typed.withColumnRenamed("id", "child"), "child", "left_semi").select("parent", "child", "typ")


@query(with_sql("persons", "SELECT c.id AS child, c.father, c.mother FROM persons c JOIN persons f ON f.id=c.father AND f.genotyped JOIN persons m ON m.id=c.mother AND m.genotyped WHERE c.genotyped"))
def q_trios(s, d):
    p = ad.persons(s, d)
    typed = p.where("genotyped").select("id")
    return p.where("genotyped").join(typed.withColumnRenamed("id", "father"), "father", "left_semi").join(typed.withColumnRenamed("id", "mother"), "mother", "left_semi").select(F.col("id").alias("child"), "father", "mother")


@query(with_sql("persons", "SELECT father, mother, STRING_AGG(id::VARCHAR, ',' ORDER BY id) AS children, COUNT(*) AS n FROM persons WHERE father<>0 AND mother<>0 GROUP BY 1,2"))
def q_families(s, d):
    return graph.families(ad.persons(s, d)).withColumn("children", F.array_join(F.transform("children", lambda c: c.cast("string")), ","))


@query(with_sql("persons parents", "SELECT id FROM persons p WHERE genotyped AND NOT EXISTS (SELECT 1 FROM parents e JOIN persons q ON q.id=e.parent AND q.genotyped WHERE e.child=p.id)"))
def q_quasi_founders(s, d):
    p = ad.persons(s, d)
    typed = p.where("genotyped").select(F.col("id").alias("parent"))
    have = graph.parent_edges(p).join(typed, "parent", "left_semi").select(F.col("child").alias("id"))
    return p.where("genotyped").select("id").join(have, "id", "left_anti")


@query(with_sql("persons parents", """, f AS (SELECT id, 0 AS depth FROM persons WHERE id NOT IN (SELECT child FROM parents)
  UNION SELECT e.child, f.depth+1 FROM f JOIN parents e ON e.parent=f.id) SELECT id, MAX(depth)::BIGINT AS depth FROM f GROUP BY id""", True))
def q_node_depth(s, d):
    return graph.levels(ad.persons(s, d)).select("id", F.col("depth").cast("long").alias("depth"))


_UP = "up AS (SELECT id, id AS anc, 0 AS dist FROM persons UNION SELECT u.id, e.parent, u.dist+1 FROM up u JOIN parents e ON e.child=u.anc), um AS (SELECT id, anc, MIN(dist) AS dist FROM up GROUP BY 1,2)"


@query(with_sql("persons parents", f""", {_UP}, c AS (SELECT x.id AS x, y.id AS y, x.anc, x.dist+y.dist AS dist FROM um x JOIN um y ON x.anc=y.anc AND y.id=x.id+9),
  r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY x, y ORDER BY dist, anc) AS k FROM c) SELECT x, y, anc AS lca, dist::BIGINT AS distance FROM r WHERE k=1""", True))
def q_lca(s, d):
    p = ad.persons(s, d)
    pairs = p.select(F.col("id").alias("x"), (F.col("id") + 9).alias("y"))
    out = graph.lowest_common_ancestor(pairs, graph.ancestors(p, 24))
    return out.select("x", "y", "lca", F.col("distance").cast("long").alias("distance"))


@query(with_sql("persons parents", f", {_UP} SELECT u.id, u.anc AS surrogate, u.dist::BIGINT AS distance FROM um u JOIN persons q ON q.id=u.anc AND q.genotyped WHERE u.dist BETWEEN 2 AND 3", True))
def q_surrogate_parents(s, d):
    p = ad.persons(s, d)
    up = graph.ancestors(p, 3).where("distance between 2 and 3")
    return up.join(p.where("genotyped").select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select("id", F.col("ancestor").alias("surrogate"), F.col("distance").cast("long").alias("distance"))


_HOM = "h AS (SELECT c.snp, p.id, c.a0, c.a1 FROM persons p JOIN calls c ON c.smp=p.id%64)"


@query(with_sql("calls persons", f""", {_HOM} SELECT COUNT(*) FILTER (f.a0=f.a1 AND f.a0=m.a0 AND m.a0=m.a1 AND f.a0<>0 AND k.a0<>k.a1 AND k.a0<>0 AND k.a1<>0) AS het_of_equal_homs,
  COUNT(*) FILTER (f.a0=f.a1 AND f.a0<>0 AND k.a0=k.a1 AND k.a0<>0 AND k.a0<>f.a0) AS opposite_father,
  COUNT(*) FILTER (m.a0=m.a1 AND m.a0<>0 AND k.a0=k.a1 AND k.a0<>0 AND k.a0<>m.a0) AS opposite_mother, t.id
  FROM persons t JOIN h k ON k.id=t.id JOIN h f ON f.id=t.father AND f.snp=k.snp JOIN h m ON m.id=t.mother AND m.snp=k.snp WHERE t.father<>0 AND t.mother<>0 GROUP BY t.id"""))
def q_mendel_errors(s, d):
    return stats.mendel_errors(_sampled(s, d), ad.calls(s, d))


def _sampled(s, d) -> DataFrame:
    """Persons with the samples that stand for them and their parents."""
    p = ad.persons(s, d)
    return stats.with_samples(p, p.select("id", (F.col("id") % ad.SAMPLES).alias("smp")))


@query(with_sql("calls snps", f""", {RECODED}, x AS (SELECT r.snp, smp, g FROM r WHERE g>0) SELECT a.snp AS snp1, b.snp AS snp2, COUNT(*) AS n, ((COUNT(*)*SUM(a.g*b.g)-SUM(a.g)*SUM(b.g))*(COUNT(*)*SUM(a.g*b.g)-SUM(a.g)*SUM(b.g))*100000
  // ((COUNT(*)*SUM(a.g*a.g)-SUM(a.g)*SUM(a.g))*(COUNT(*)*SUM(b.g*b.g)-SUM(b.g)*SUM(b.g))))::BIGINT AS r2_e5
  FROM x a JOIN x b ON a.smp=b.smp AND b.snp BETWEEN a.snp+1 AND a.snp+2 GROUP BY 1,2 HAVING COUNT(*)>=8 AND STDDEV_POP(a.g)>0 AND STDDEV_POP(b.g)>0"""))
def q_r2_pairs(s, d):
    return stats.r2(_recoded(s, d).where("g > 0"), 2, 8)


@query(with_sql("ld", """, e AS (SELECT snp1 AS a, snp2 AS b FROM ld WHERE r2>=0.75), n AS (SELECT a FROM e UNION SELECT b FROM e),
  s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), t AS (SELECT a AS node, a AS c FROM n UNION SELECT s.b, t.c FROM t JOIN s ON s.a=t.node AND t.c<=s.b)
  SELECT node, MIN(c) AS component FROM t GROUP BY node""", True))
def q_ld_components(s, d):
    return graph.components(ad.ld_edges(s, d).where("r2 >= 0.75"), "snp1", "snp2")


@query(with_sql("calls ld", f""", {RECODED}, e AS (SELECT snp1 AS a, snp2 AS b FROM ld WHERE r2>=0.75), n AS (SELECT a FROM e UNION SELECT b FROM e),
  s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), t AS (SELECT a AS node, a AS c FROM n UNION SELECT s.b, t.c FROM t JOIN s ON s.a=t.node AND t.c<=s.b),
  comp AS (SELECT node, MIN(c) AS component FROM t GROUP BY node), rate AS (SELECT snp, ROUND(AVG(CASE WHEN g>0 THEN 1.0 ELSE 0.0 END), 6) AS cr FROM r GROUP BY snp),
  b AS (SELECT rate.snp, cr, COALESCE(component, rate.snp) AS block FROM rate LEFT JOIN comp ON node=rate.snp),
  k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY block ORDER BY cr DESC, snp DESC) AS i, COUNT(*) OVER (PARTITION BY block) AS size FROM b) SELECT block, snp AS kept, size FROM k WHERE i=1""", True))
def q_ld_prune(s, d):
    rate = stats.call_rate(_recoded(s, d), "snp").select("snp", "call_rate")
    return graph.prune(ad.ld_edges(s, d), rate, 0.75)


@query()
def q_frames(s, d):
    return graph.frames(ad.ld_edges(s, d).where("r2 >= 0.75"), ad.snps(s, d))


@query("""WITH k AS (SELECT n_nationkey AS id1, s_suppkey AS id2, s_suppkey%7 AS d1, s_suppkey%5 AS d3, s_suppkey%3 AS d5, n_nationkey%4 AS d7, n_nationkey%6 AS d8 FROM nation JOIN supplier ON s_nationkey=n_nationkey)
  SELECT id1, id2, ROUND((d1+0.5*(d3+d5+d7)+0.25*d8)/25.0, 6) AS phi FROM k""")
def q_kinship(s, d):
    j = ad.load(s, d, "nation").join(ad.load(s, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"))
    n, k = F.col("n_nationkey"), F.col("s_suppkey")
    phi = rc.kinship({1: k % 7, 3: k % 5, 5: k % 3, 7: n % 4, 8: n % 6})
    return j.select(n.alias("id1"), k.alias("id2"), F.round(phi / 25, 6).alias("phi"))


_MORE = "(CASE WHEN b0<>0 THEN 1 ELSE 0 END + CASE WHEN b1<>0 THEN 1 ELSE 0 END) < (CASE WHEN a0<>0 THEN 1 ELSE 0 END + CASE WHEN a1<>0 THEN 1 ELSE 0 END)"


@query(with_sql("calls imputed", f"""SELECT snp, smp, CASE WHEN {_MORE} THEN a0 ELSE b0 END AS o0, CASE WHEN {_MORE} THEN a1 ELSE b1 END AS o1,
  CASE WHEN {_MORE} THEN 0 ELSE tag END AS tag FROM imputed LEFT JOIN calls USING (snp, smp)"""))
def q_override_imputed(s, d):
    return stats.override(ad.imputed(s, d), ad.calls(s, d))


@query(with_sql("imputed", """SELECT snp, COUNT(*) FILTER (tag=2 AND b0=2 AND b1=1) AS n221, COUNT(*) FILTER (tag=2 AND b0=1 AND b1=2) AS n212,
  COUNT(*) FILTER (tag IN (0,1) AND b0<>b1 AND b0<>0 AND b1<>0) AS other_het, ROUND(AVG(CASE WHEN b0<>0 AND b1<>0 THEN 1.0 ELSE 0.0 END), 6) AS call_rate,
  CASE WHEN COUNT(*) FILTER (b0<>0 AND b1<>0)=0 THEN -1 ELSE ROUND(LEAST(SUM(CASE WHEN b0<>0 AND b1<>0 THEN b0+b1-2 ELSE 0 END)/(2.0*COUNT(*) FILTER (b0<>0 AND b1<>0)),
  1-SUM(CASE WHEN b0<>0 AND b1<>0 THEN b0+b1-2 ELSE 0 END)/(2.0*COUNT(*) FILTER (b0<>0 AND b1<>0))), 6) END AS maf FROM imputed GROUP BY snp"""))
def q_poo_counts(s, d):
    return stats.poo_counts(ad.imputed(s, d))


@query(with_sql("segments", """, m AS (SELECT DISTINCT s0*100+s1 AS k, snp_start//8 AS x, 1<<CAST(a0*2+a1 AS INTEGER) AS bit FROM segments),
  t AS (SELECT k, x, BIT_OR(bit) AS mask FROM m GROUP BY k, x) SELECT mask::BIGINT AS mask, COUNT(*) AS n FROM t GROUP BY 1"""))
def q_idcoef_states(s, d):
    g = ad.segments(s, d).select((F.col("s0") * 100 + F.col("s1")).alias("k"), F.floor(F.col("snp_start") / 8).alias("x"), F.expr("shiftleft(1L, cast(a0*2+a1 as int))").alias("bit"))
    return stats.identity_states(g)


@query(with_sql("haps", """, w AS (SELECT smp, snp//10 AS slice, STRING_AGG(v::VARCHAR, '' ORDER BY snp) AS word, COUNT(*) AS n, MIN(snp) AS a, SUM(snp)::BIGINT AS sig FROM haps GROUP BY 1,2)
  SELECT x.smp AS x, y.smp AS y, COUNT(*) AS slices FROM w x JOIN w y ON x.slice=y.slice AND x.word=y.word AND x.sig=y.sig AND x.smp<y.smp GROUP BY 1,2"""))
def q_germline_slices(s, d):
    return stats.slice_matches(ad.haps(s, d), 10)


@query(with_sql("calls imputed", """, j AS (SELECT *, a0<>0 AND a1<>0 AND b0<>0 AND b1<>0 AS ok FROM calls JOIN imputed USING (snp, smp))
  SELECT snp, COUNT(*) FILTER (ok) AS called, COUNT(*) FILTER (ok AND a0+a1<>b0+b1) AS discordant, COUNT(*) FILTER (ok AND a0<>a1) AS hets,
  COUNT(*) FILTER (ok AND a0<>a1 AND a0+a1<>b0+b1) AS het_discordant FROM j GROUP BY snp"""))
def q_impute2_concordance(s, d):
    x, y = F.col("x"), F.col("y")
    both, het = (x > 0) & (y > 0), x == 3
    return _pairs(s, d).groupBy("snp").agg(_n(both).alias("called"), _n(both & (x != y)).alias("discordant"), _n(both & het).alias("hets"), _n(both & het & (x != y)).alias("het_discordant"))


@query(with_sql("calls imputed", """, j AS (SELECT snp, COUNT(*) FILTER (a0<>a1 AND a0<>0 AND a1<>0) AS hets, AVG(CASE WHEN b0<>0 AND b1<>0 THEN 1.0 ELSE 0.0 END) AS cr,
  AVG(CASE WHEN a0+a1=b0+b1 THEN 1.0 ELSE 0.0 END) AS con FROM calls JOIN imputed USING (snp, smp) GROUP BY snp), t AS (SELECT * FROM (VALUES (1),(2),(3)) h(h) CROSS JOIN (VALUES (0.5),(0.7),(0.9)) c(c))
  SELECT h, c::DOUBLE AS c, COUNT(*) AS snps, ROUND(AVG(cr), 6) AS mean_cr FROM t JOIN j ON hets>=h AND con>=c GROUP BY 1,2"""))
def q_qc_grid(s, d):
    per = _pairs(s, d).groupBy("snp").agg(_n(F.col("x") == 3).alias("hets"), F.avg((F.col("y") > 0).cast("double")).alias("cr"), F.avg((F.col("a0") + F.col("a1") == F.col("b0") + F.col("b1")).cast("double")).alias("con"))
    grid = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.lit(c).alias("c")) for h in (1, 2, 3) for c in (0.5, 0.7, 0.9)])).alias("t")
    return per.select("*", grid).where("hets >= t.h and con >= t.c").groupBy("t.h", "t.c").agg(F.count("*").alias("snps"), F.round(F.avg("cr"), 6).alias("mean_cr"))


@query("""SELECT CASE WHEN p_size<=10 THEN 1 WHEN p_size<=30 AND p_retailprice>=1200 THEN 2 WHEN p_type LIKE 'PROMO%' THEN 3 ELSE 0 END AS category, COUNT(*) AS n FROM part GROUP BY 1""")
def q_common_novel(s, d):
    c = F.when(F.col("p_size") <= 10, 1).when((F.col("p_size") <= 30) & (F.col("p_retailprice") >= 1200), 2).when(F.col("p_type").startswith("PROMO"), 3).otherwise(0)
    return ad.load(s, d, "part").groupBy(c.alias("category")).agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT p_brand, p_type, CASE WHEN p_size<=0 THEN 0 WHEN p_size>50 THEN 11 ELSE (p_size-1)//5+1 END AS bin FROM part)
  SELECT bin::BIGINT AS bin, p_brand AS category, COUNT(*) AS n, COUNT(DISTINCT p_type) AS kinds FROM b GROUP BY 1,2""")
def q_category_report(s, d):
    size = F.col("p_size")
    b = F.when(size <= 0, 0).when(size > 50, 11).otherwise(F.floor((size - 1) / 5) + 1)
    return ad.load(s, d, "part").groupBy(b.cast("long").alias("bin"), F.col("p_brand").alias("category")).agg(F.count("*").alias("n"), F.countDistinct("p_type").alias("kinds"))


@query("""SELECT p_partkey, COUNT(DISTINCT l_suppkey) AS suppliers FROM part LEFT JOIN lineitem ON p_partkey=l_partkey GROUP BY p_partkey HAVING COUNT(DISTINCT l_suppkey)>1""")
def q_left_join_having(s, d):
    j = ad.load(s, d, "part").join(ad.load(s, d, "lineitem"), F.col("p_partkey") == F.col("l_partkey"), "left")
    return j.groupBy("p_partkey").agg(F.countDistinct("l_suppkey").alias("suppliers")).where("suppliers > 1")


@query("""SELECT o_orderkey, COALESCE(c_name, 'none') AS name, CASE WHEN c_acctbal>0 THEN o_orderpriority ELSE o_orderstatus END AS note FROM orders LEFT JOIN customer ON o_custkey=c_custkey""")
def q_annotation_override(s, d):
    j = ad.load(s, d, "orders").join(ad.load(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.select("o_orderkey", F.coalesce("c_name", F.lit("none")).alias("name"), F.when(F.col("c_acctbal") > 0, F.col("o_orderpriority")).otherwise(F.col("o_orderstatus")).alias("note"))


@query(with_sql("haps", """, x AS (SELECT a.smp AS x, b.smp AS y, a.snp, CASE WHEN a.v=b.v THEN 0 ELSE 1 END AS d FROM haps a JOIN haps b ON a.snp=b.snp AND a.smp+1=b.smp),
  p AS (SELECT *, SUM(d) OVER (PARTITION BY x, y ORDER BY snp) AS k FROM x) SELECT x, y, MIN(snp) AS start, MAX(snp)+1 AS stop, (k%2)::INTEGER AS phase FROM p GROUP BY x, y, k"""))
def q_phase_edges(s, d):
    h = ad.haps(s, d)
    a, b = h.select("snp", F.col("smp").alias("x"), F.col("v").alias("va")), h.select("snp", F.col("smp").alias("y"), F.col("v").alias("vb"))
    j = a.join(b, "snp").where("x + 1 = y").select("x", "y", "snp", rc.hap_diff(F.col("va"), F.col("vb")).alias("edge"))
    return sequence.phases(j, ["x", "y"], "snp", "edge").withColumn("phase", F.col("phase").cast("int"))


@query(with_sql("segments", """, t AS (SELECT LEAST(s0,s1) AS x, GREATEST(s0,s1) AS y, SUM(bp_stop-bp_start) AS total FROM segments GROUP BY 1,2) SELECT x, y, total::BIGINT AS total FROM t"""))
def q_total_sharing(s, d):
    g = ad.segments(s, d)
    return g.groupBy(F.least("s0", "s1").alias("x"), F.greatest("s0", "s1").alias("y")).agg(F.sum(F.col("bp_stop") - F.col("bp_start")).alias("total"))


@query(with_sql("imputed", """, c AS (SELECT CASE WHEN b0=0 OR b1=0 THEN 'NN' ELSE TRANSLATE(b0::VARCHAR||b1::VARCHAR, '012', 'N01') END AS cell, tag FROM imputed) SELECT tag || cell AS cell, COUNT(*) AS n FROM c GROUP BY 1"""))
def q_letters(s, d):
    i = ad.imputed(s, d)
    cell = F.when((F.col("b0") == 0) | (F.col("b1") == 0), "NN").otherwise(F.concat(rc.to_letter(F.col("b0")), rc.to_letter(F.col("b1"))))
    return i.groupBy(F.concat(F.col("tag").cast("string"), cell).alias("cell")).agg(F.count("*").alias("n"))


@query(with_sql("calls", """SELECT snp, smp, COUNT(*) OVER (PARTITION BY snp) AS width, RANK() OVER (PARTITION BY snp ORDER BY a0+a1 DESC, smp) AS place FROM calls"""))
def q_rank_in_snp(s, d):
    w = W.partitionBy("snp")
    return ad.calls(s, d).select("snp", "smp", F.count("*").over(w).alias("width"), F.rank().over(w.orderBy(F.desc(F.col("a0") + F.col("a1")), "smp")).cast("long").alias("place"))


@query()
def k_hmm_hap(s, d):
    return kernels.hmm_segments(ad.haps(s, d))


@query()
def k_impute_cliques(s, d):
    calls = ad.calls(s, d)
    sides = calls.select("snp", "smp", F.explode(F.array(F.lit(0), F.lit(1))).alias("allele"))
    return kernels.impute(calls, sides.select("snp", (F.floor(F.col("smp") / 4) * 2 + F.col("allele")).alias("grp"), "smp", "allele"))


@query(with_sql("imputed", """, m AS (SELECT snp, smp//8 AS grp, AVG(CASE WHEN b0<>0 THEN b0 END) AS mean FROM imputed GROUP BY 1,2)
  SELECT snp, grp, CASE WHEN mean IS NULL THEN 0 WHEN ROUND_EVEN(2*mean, 0)%2=0 THEN (ROUND_EVEN(2*mean, 0)/2)::INTEGER ELSE 0 END AS v FROM m"""))
def q_consensus_majority(s, d):
    i = ad.imputed(s, d).select("snp", F.floor(F.col("smp") / 8).alias("grp"), F.col("b0").alias("v"))
    return kernels.consensus(i, ["snp", "grp"])


@query(with_sql("calls persons", """, h AS (SELECT c.snp, p.id AS smp, c.a0, c.a1, CASE WHEN c.a0=c.a1 THEN c.a0 ELSE 0 END AS h FROM persons p JOIN calls c ON c.smp=p.id%64),
  j AS (SELECT k.snp, k.smp, k.a0, k.a1, k.h, f.h AS fv, m.h AS mv FROM h k JOIN persons p ON p.id=k.smp LEFT JOIN h f ON f.smp=p.father AND f.snp=k.snp AND p.father<>0 LEFT JOIN h m ON m.smp=p.mother AND m.snp=k.snp AND p.mother<>0),
  s1 AS (SELECT *, CASE WHEN h=0 AND fv<>0 AND (fv=a0 OR fv=a1) THEN fv ELSE h END AS h0 FROM j),
  s2 AS (SELECT *, CASE WHEN h=0 AND h0<>0 AND a0<>0 AND a1<>0 THEN CASE WHEN a0=h0 THEN a1 WHEN a1=h0 THEN a0 ELSE h END ELSE h END AS h1 FROM s1),
  s3 AS (SELECT *, CASE WHEN h1=0 AND mv<>0 AND (mv=a0 OR mv=a1) THEN mv ELSE h1 END AS k1 FROM s2),
  s4 AS (SELECT *, CASE WHEN h0=0 AND k1<>0 AND a0<>0 AND a1<>0 THEN CASE WHEN a0=k1 THEN a1 WHEN a1=k1 THEN a0 ELSE h0 END ELSE h0 END AS k0 FROM s3)
  SELECT smp, SUM(CASE WHEN k0<>0 THEN 1 ELSE 0 END + CASE WHEN k1<>0 THEN 1 ELSE 0 END)::BIGINT AS filled, 2*COUNT(*) AS total FROM s4 GROUP BY smp"""))
def q_phase_trivial(s, d):
    p = _sampled(s, d)
    phased = phasing.from_parents(phasing.from_homozygous(ad.calls(s, d)), stats.trio_kinds(p))
    rates = phasing.fill_rates(phased, "smp", "father_smp", "mother_smp")
    same = F.lit(True)
    for c in ("smp", "father_smp", "mother_smp"):
        same = same & p[c].eqNullSafe(rates[c])
    return p.join(rates, same).select(p["id"].alias("smp"), "filled", "total")


@query()
def k_group_to_disjoint(s, d):
    """Connected groups of haplotypes on every piece between end points."""
    g = ad.segments(s, d).select((F.col("s0") % 10).alias("k"), "snp_start", "snp_stop", (F.col("s0") * 2 + F.col("a0")).alias("a"), (F.col("s1") * 2 + F.col("a1")).alias("b"))
    return kernels.disjoint_groups(intervals.covered_atoms(g, ["k"], 64, "snp_start", "snp_stop")).withColumn("members", F.array_join(F.transform("members", lambda m: m.cast("string")), ","))


@query(with_sql("calls imputed", """SELECT snp, smp, CASE WHEN tag=3 AND a0<>0 AND a1<>0 AND b0<>0 AND b1<>0 AND a0+a1=b0+b1 THEN a0 ELSE b0 END AS o0,
  CASE WHEN tag=3 AND a0<>0 AND a1<>0 AND b0<>0 AND b1<>0 AND a0+a1=b0+b1 THEN a1 ELSE b1 END AS o1 FROM imputed JOIN calls USING (snp, smp)"""))
def q_override_ld(s, d):
    """Phased alleles of equal dosage laid over genotypes that were imputed by linkage."""
    j = _pairs(s, d)
    take = (F.col("tag") == 3) & (F.col("x") > 0) & (F.col("y") > 0) & (F.col("a0") + F.col("a1") == F.col("b0") + F.col("b1"))
    return j.select("snp", "smp", F.when(take, F.col("a0")).otherwise(F.col("b0")).alias("o0"), F.when(take, F.col("a1")).otherwise(F.col("b1")).alias("o1"))


@query(with_sql("imputed", """, w AS (SELECT *, CASE WHEN smp%5=0 THEN -1 ELSE 1 END AS phase FROM imputed)
  SELECT snp, smp, CASE WHEN phase<0 THEN b1 ELSE b0 END AS o0, CASE WHEN phase<0 THEN b0 ELSE b1 END AS o1, CASE WHEN tag=1 THEN 2 ELSE tag END AS tag FROM w"""))
def q_flip_origin(s, d):
    """Alleles swapped where a sample's origin is reversed; aligned phased genotypes are tagged so."""
    flip = F.col("smp") % 5 == 0
    return ad.imputed(s, d).select("snp", "smp", F.when(flip, F.col("b1")).otherwise(F.col("b0")).alias("o0"), F.when(flip, F.col("b0")).otherwise(F.col("b1")).alias("o1"), F.when(F.col("tag") == 1, 2).otherwise(F.col("tag")).alias("tag"))


@query("""WITH m AS (SELECT o_custkey%100 AS clique, o_orderstatus AS side, MEDIAN(o_orderkey%1000) AS kin, COUNT(*) AS n FROM orders GROUP BY 1,2)
  SELECT clique, COUNT(*) AS sides, SUM(n)::BIGINT AS members, MAX(kin)::DOUBLE AS top, MIN(kin)::DOUBLE AS low FROM m WHERE n>=3 GROUP BY clique""")
def q_poo_medians(s, d):
    """Median relatedness for each clique and side, of sides with at least three members."""
    m = ad.load(s, d, "orders").groupBy((F.col("o_custkey") % 100).alias("clique"), F.col("o_orderstatus").alias("side")).agg(F.percentile(F.col("o_orderkey") % 1000, F.lit(0.5)).alias("kin"), F.count("*").alias("n"))
    return m.where("n >= 3").groupBy("clique").agg(F.count("*").alias("sides"), F.sum("n").alias("members"), F.max("kin").alias("top"), F.min("kin").alias("low"))


@query(with_sql("calls", f""", {RECODED}, c AS (SELECT snp, AVG(CASE WHEN g>0 THEN 1.0 ELSE 0.0 END) AS cr, LEAST(SUM(CASE WHEN g>0 THEN g-2 ELSE 0 END), SUM(CASE WHEN g>0 THEN 4-g ELSE 0 END)) AS minor, COUNT(*) FILTER (g>0) AS n FROM r GROUP BY snp)
  SELECT snp FROM c WHERE cr>=0.6 AND n>0 AND minor*20>=2*n"""))
def q_marker_qc(s, d):
    """SNPs that pass call rate and minor allele frequency."""
    g = F.col("g")
    c = _recoded(s, d).groupBy("snp").agg(F.avg((g > 0).cast("double")).alias("cr"), F.least(F.sum(F.when(g > 0, g - 2).otherwise(0)), F.sum(F.when(g > 0, 4 - g).otherwise(0))).alias("minor"), _n(g > 0).alias("n"))
    return c.where("cr >= 0.6 and n > 0 and minor * 20 >= 2 * n").select("snp")


@query(with_sql("ld", """, x AS (SELECT snp1, snp2, r2 FROM ld), y AS (SELECT snp1, snp2, r2-0.1 AS r2 FROM ld WHERE snp1%3<>0)
  SELECT x.snp1%50 AS block, COUNT(*) AS n, ROUND(MAX(ABS(x.r2-y.r2)), 6) AS most FROM x JOIN y USING (snp1, snp2) GROUP BY 1"""))
def q_compare_ld(s, d):
    """Two linkage results on their common pairs."""
    x = ad.ld_edges(s, d)
    y = x.where("snp1 % 3 <> 0").select("snp1", "snp2", (F.col("r2") - 0.1).alias("q2"))
    return x.join(y, ["snp1", "snp2"]).groupBy((F.col("snp1") % 50).alias("block")).agg(F.count("*").alias("n"), F.round(F.max(F.abs(F.col("r2") - F.col("q2"))), 6).alias("most"))


@query(with_sql("segments", """, t AS (SELECT s0, a0, s1, SUM(bp_stop-bp_start)::BIGINT AS total FROM segments GROUP BY 1,2,3), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY s0, a0 ORDER BY total DESC, s1) AS k FROM t)
  SELECT s0, a0, s1, total FROM r WHERE k<=3"""))
def q_closest_relatives(s, d):
    """The three samples that share most with each haplotype (a top-k report)."""
    t = ad.segments(s, d).groupBy("s0", "a0", "s1").agg(F.sum(F.col("bp_stop") - F.col("bp_start")).alias("total"))
    return t.withColumn("k", F.row_number().over(W.partitionBy("s0", "a0").orderBy(F.desc("total"), "s1"))).where("k <= 3").drop("k")


@query("""SELECT user_id, event_type, COUNT(*) AS n, ROUND(AVG(CASE WHEN event_id%2=0 THEN 1.0 ELSE 0.0 END), 6) AS even FROM events GROUP BY user_id, event_type HAVING COUNT(*)>1""")
def q_duplicates(s, d):
    """Keys that occur more than once."""
    e = ad.load(s, d, "events")
    return e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.avg((F.col("event_id") % 2 == 0).cast("double")), 6).alias("even")).where("n > 1")


@query("""WITH g AS (SELECT n_nationkey AS by, unnest(range(0, n_nationkey+3)) AS k, n_name AS name FROM nation) SELECT by AS nation, COUNT(*)::BIGINT AS n, SUM(k)::BIGINT AS total, MAX(REVERSE(TRANSLATE(name, 'ACGT', 'TGCA'))) AS turned FROM g GROUP BY by""".replace(" by,", " grp,").replace("SELECT by ", "SELECT grp ").replace("GROUP BY by", "GROUP BY grp"))
def q_reverse_complement(s, d):
    """Exploded ranges, and names as bases turned round."""
    g = ad.load(s, d, "nation").select(F.col("n_nationkey").alias("nation"), F.explode(F.sequence(F.lit(0), F.col("n_nationkey") + 2)).alias("k"), F.col("n_name").alias("name"))
    return g.groupBy("nation").agg(F.count("*").alias("n"), F.sum("k").alias("total"), F.max(rc.reverse_complement(F.col("name"))).alias("turned"))


from kinloom.plans import relatives, reports  # noqa: E402, F401
