"""Sinks for scored pairs and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matches(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.where(F.col("sim") >= threshold)


def collected(scored: DataFrame, threshold: float) -> DataFrame:
    """One row: comparisons executed and matches kept."""
    return scored.agg(F.count(F.lit(1)).alias("comparisons"), F.count_if(F.col("sim") >= threshold).alias("matches"))


def write_tsv(metrics: DataFrame, path: str, append: bool = True) -> None:
    metrics.write.mode("append" if append else "overwrite").csv(path, sep="\t", header=True)


def write_csv(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").csv(path, header=True)
