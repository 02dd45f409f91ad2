"""Joins that have no equality key of their own: by range, and to the nearest neighbour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def range_join(left: DataFrame, right: DataFrame, l_start: str, l_stop: str, r_start: str, r_stop: str, width: int, on: list[str] | None = None) -> DataFrame:
    """Pairs of half-open intervals that overlap. Both sides are put in bins of ``width``, joined by equality of bin
    (and of ``on``), and each pair is kept in one bin only, that of the later start. Column names must differ but for
    those in ``on``."""
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width))).alias("bin__")
    x = left.where(F.col(l_start) < F.col(l_stop)).select("*", bins(l_start, l_stop))
    y = right.where(F.col(r_start) < F.col(r_stop)).select("*", bins(r_start, r_stop))
    out = x.join(y, ["bin__", *(on or [])]).where((F.col(l_start) < F.col(r_stop)) & (F.col(r_start) < F.col(l_stop)))
    return out.where(F.col("bin__") == F.floor(F.greatest(l_start, r_start) / width)).drop("bin__")


def _sided(points: DataFrame, grid: DataFrame, by: list[str], at: str, payload: list[str], before: bool) -> DataFrame:
    """Each point with the payload of the grid row before (or after) it, the place itself included."""
    p = points.select(*points.columns, F.lit(1).alias("is_point__"), *[F.lit(None).cast(t).alias(f"g_{c}") for c, t in _types(grid, [at, *payload])])
    g = grid.select(*[F.col(c) if c in (*by, at) else F.lit(None).cast(t).alias(c) for c, t in _types(points, points.columns)], F.lit(0).alias("is_point__"), *[F.col(c).alias(f"g_{c}") for c in (at, *payload)])
    w = W.partitionBy(*by).orderBy(F.col(at).asc() if before else F.col(at).desc(), "is_point__").rowsBetween(W.unboundedPreceding, 0)
    side = "l" if before else "r"
    both = p.unionByName(g)
    return both.select(*points.columns, "is_point__", *[F.last(f"g_{c}", ignorenulls=True).over(w).alias(f"{side}_{c}") for c in (at, *payload)]).where("is_point__ = 1").drop("is_point__")


def _types(df: DataFrame, names: list[str]) -> list[tuple[str, str]]:
    kinds = dict(df.dtypes)
    return [(n, kinds[n]) for n in names]


def asof_left(points: DataFrame, grid: DataFrame, at: str, payload: list[str], by: list[str] | None = None) -> DataFrame:
    """Backward as-of join: l_<at> and l_<payload> of the last grid row at or before each point, else null."""
    return _sided(points, grid, by or [], at, payload, True)


def bracket(points: DataFrame, grid: DataFrame, at: str, payload: list[str], by: list[str] | None = None) -> DataFrame:
    """The grid rows on both sides of each point, as l_ and r_ columns."""
    return _sided(_sided(points, grid, by or [], at, payload, True), grid, by or [], at, payload, False)


def nearest(points: DataFrame, grid: DataFrame, at: str, payload: list[str], by: list[str] | None = None, tie_right: bool = True) -> DataFrame:
    """The nearest grid row, as n_ columns; a tie goes to the right, or the left."""
    b = bracket(points, grid, at, payload, by)
    x, left, right = F.col(at), F.col(f"l_{at}"), F.col(f"r_{at}")
    closer = (x - left) < (right - x) if tie_right else (x - left) <= (right - x)
    use_left = right.isNull() | (left.isNotNull() & closer)
    return b.select(*points.columns, *[F.when(use_left, F.col(f"l_{c}")).otherwise(F.col(f"r_{c}")).alias(f"n_{c}") for c in (at, *payload)])


def interpolate(points: DataFrame, grid: DataFrame, at: str, value: str, by: list[str] | None = None, outside: Column | None = None) -> DataFrame:
    """Piecewise-linear value at each point; beyond the grid its end values, or ``outside``."""
    b = bracket(points, grid, at, [value], by)
    x, l, r, lv, rv = F.col(at), F.col(f"l_{at}"), F.col(f"r_{at}"), F.col(f"l_{value}"), F.col(f"r_{value}")  # noqa: E741
    inside = F.when(l == r, lv).otherwise(lv + (rv - lv) * (x - l) / (r - l))
    beyond = F.coalesce(lv, rv) if outside is None else outside
    return b.select(*points.columns, F.when(l.isNull() | r.isNull(), beyond).otherwise(inside).alias(value))
