"""Algebra of intervals within keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinloom.operators.joins import range_join


def union(df: DataFrame, by: list[str], start: str = "start", stop: str = "stop") -> DataFrame:
    """Disjoint union of intervals; those that touch become one."""
    w = W.partitionBy(*by).orderBy(start, stop)
    reach = F.max(stop).over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = df.select(*by, start, stop, F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0).alias("new__"))
    marked = marked.withColumn("island__", F.sum("new__").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*by, "island__").agg(F.min(start).alias(start), F.max(stop).alias(stop)).drop("island__")


def intersection(a: DataFrame, b: DataFrame, by: list[str], width: int, start: str = "start", stop: str = "stop") -> DataFrame:
    """What lies in both unions."""
    x = union(a, by, start, stop).select(*by, F.col(start).alias("xa"), F.col(stop).alias("xb"))
    y = union(b, by, start, stop).select(*by, F.col(start).alias("ya"), F.col(stop).alias("yb"))
    return range_join(x, y, "xa", "xb", "ya", "yb", width, by).select(*by, F.greatest("xa", "ya").alias(start), F.least("xb", "yb").alias(stop))


def either(a: DataFrame, b: DataFrame, by: list[str], start: str = "start", stop: str = "stop") -> DataFrame:
    return union(a.select(*by, start, stop).unionByName(b.select(*by, start, stop)), by, start, stop)


def atoms(df: DataFrame, by: list[str], start: str = "start", stop: str = "stop") -> DataFrame:
    """The pieces between neighbouring end points of a key: by, lo, hi."""
    ends = df.select(*by, F.col(start).alias("lo")).union(df.select(*by, F.col(stop))).distinct()
    return ends.withColumn("hi", F.lead("lo").over(W.partitionBy(*by).orderBy("lo"))).where("hi is not null")


def covered_atoms(df: DataFrame, by: list[str], width: int, start: str = "start", stop: str = "stop") -> DataFrame:
    """Every atom with every interval that covers it."""
    return range_join(atoms(df, by, start, stop), df, "lo", "hi", start, stop, width, by)
