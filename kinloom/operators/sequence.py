"""Operators on ordered positions: runs, change points, filters, phases between edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def runs(df: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """Run-length encoding: by, value, first, last, n of each maximal run of equal values in the order of ``at``."""
    w = W.partitionBy(*by).orderBy(at)
    changed = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)
    marked = df.select(*by, at, value, changed.alias("new__")).withColumn("run__", F.sum("new__").over(w))
    return marked.groupBy(*by, "run__").agg(F.first(value).alias(value), F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).drop("run__")


def segments_with_value(df: DataFrame, by: list[str], at: str, value: str, wanted, least: int = 1) -> DataFrame:
    """Half-open runs [start, stop) of adjacent positions where the value is ``wanted``, at least ``least`` long."""
    hit = df.where(F.col(value) == wanted)
    island = (F.col(at) - F.row_number().over(W.partitionBy(*by).orderBy(at))).alias("island__")
    out = hit.select(*by, at, island).groupBy(*by, "island__").agg(F.min(at).alias("start"), (F.max(at) + 1).alias("stop")).drop("island__")
    return out.where(F.col("stop") - F.col("start") >= least)


def change_points(df: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before."""
    w = W.partitionBy(*by).orderBy(at)
    return df.select("*", F.lag(value).over(w).alias("before")).where(F.col("before").isNotNull() & (F.col("before") != F.col(value)))


def median5(df: DataFrame, by: list[str], at: str, value: str) -> Column:
    """Median of five of a 0/1 column, the ends reflected (the edge value twice)."""
    w = W.partitionBy(*by).orderBy(at)
    v = F.col(value)
    before, after = F.lag(value, 1).over(w), F.lead(value, 1).over(w)
    before2 = F.coalesce(F.lag(value, 2).over(w), F.when(before.isNotNull(), before), after, v)
    after2 = F.coalesce(F.lead(value, 2).over(w), F.when(after.isNotNull(), after), before, v)
    ones = v + F.coalesce(before, v) + F.coalesce(after, v) + before2 + after2
    return F.when(ones >= 3, 1).otherwise(0)


def median(df: DataFrame, by: list[str], at: str, value: str, width: int) -> DataFrame:
    """by, at, m: the median of an odd ``width`` of values around each, sequences being reflected at their ends (the edge
    value twice, as often as a short sequence needs it). No values are null."""
    if width % 2 == 0:
        raise ValueError("the width is odd")
    half, w = width // 2, W.partitionBy(*by).orderBy(at)
    rows = df.select(*by, at, (F.row_number().over(w) - 1).alias("i"), F.count("*").over(W.partitionBy(*by)).cast("int").alias("n"), F.collect_list(value).over(w.rowsBetween(-half, half)).alias("near"))
    turned = lambda k: F.when(k < F.col("n"), k).otherwise(2 * F.col("n") - 1 - k)
    place = lambda k: turned(F.pmod(F.col("i") + k, 2 * F.col("n"))) - F.greatest(F.lit(0), F.col("i") - half)
    around = F.transform(F.sequence(F.lit(-half), F.lit(half)), lambda k: F.get("near", place(k).cast("int")))
    return rows.select(*by, at, F.get(F.array_sort(around), F.lit(half)).alias("m"))


def max_except_centre(value: str, w, half: int) -> Column:
    """0 where the value isn't 1, else the largest of its neighbours."""
    around = F.greatest(F.coalesce(F.max(value).over(w.rowsBetween(-half, -1)), F.lit(0)), F.coalesce(F.max(value).over(w.rowsBetween(1, half)), F.lit(0)))
    return F.when(F.col(value) == 1, around).otherwise(0)


def phases(df: DataFrame, by: list[str], at: str, edge: str, first: int = 0) -> DataFrame:
    """Segments between edges with a phase that alternates: by, start, stop (half-open), phase."""
    w = W.partitionBy(*by).orderBy(at)
    part = F.sum(edge).over(w)
    out = df.select(*by, at, part.alias("part")).groupBy(*by, "part").agg(F.min(at).alias("start"), (F.max(at) + 1).alias("stop"))
    return out.select(*by, "start", "stop", ((F.col("part") + first) % 2).alias("phase"))


def best_per_position(df: DataFrame, by: list[str], score: str, tie: str) -> DataFrame:
    """The row of the largest score for each key; ties go to the larger ``tie``."""
    rest = [c for c in df.columns if c not in by]
    best = df.groupBy(*by).agg(F.max(F.struct(score, tie, *[c for c in rest if c not in (score, tie)])).alias("b"))
    return best.select(*by, *[F.col(f"b.{c}").alias(c) for c in rest])
