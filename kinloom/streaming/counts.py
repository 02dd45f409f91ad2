"""Streaming forms of operators that are stateless or running sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.operators import stats


def override_stream(imputed: DataFrame, typed: DataFrame) -> DataFrame:
    """Typed genotypes laid over a stream of imputed ones; no state is kept."""
    return stats.override(imputed, typed)


def genotype_counts_stream(recoded: DataFrame) -> DataFrame:
    """Running genotype counts for each SNP."""
    return stats.genotype_counts(recoded)


def windowed_counts(events: DataFrame, width: str, late: str) -> DataFrame:
    """Events by type in tumbling windows; rows later than ``late`` are left out, and their state goes."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "event_type", "n")
