"""Profiles: the canonical input (ds, id, seq, text) from tables with any columns.

The engine is schema-agnostic: the values of all chosen columns are pooled into one text. `seq` is the arrival order and
`increment` the group of arrivals a profile belongs to.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.operators.ranking import ranked


def read(spark: SparkSession, path: str, fmt: str | None = None, **options: str) -> DataFrame:
    """A table in any format that Spark reads; the format follows from the ending unless it is given."""
    kind = fmt or next((k for k in ("parquet", "orc", "json", "csv", "tsv") if path.rstrip("/").endswith(f".{k}")), "parquet")
    if kind in ("csv", "tsv"):
        options = {"header": "true", "sep": "\t" if kind == "tsv" else ","} | options
        kind = "csv"
    return spark.read.format(kind).options(**options).load(path)


def numbered(table: DataFrame, *keys: str) -> DataFrame:
    """table with `id`, the place of each row in the order of its keys, from 0: ids for keys of any type, or an arrival order from
    columns such as times. Rows of equal keys get places of their own."""
    return ranked(table, *(F.col(k) for k in keys))[0].withColumn("id", F.col("rank") - 1).drop("rank")


def _as_profiles(table: DataFrame, key: str, text: Column, ds: int, order: str | None) -> DataFrame:
    return table.select(F.lit(ds).alias("ds"), F.col(key).cast("long").alias("id"), F.col(order or key).cast("long").alias("seq"), text.alias("text"))


def profiles(table: DataFrame, key: str, columns: Sequence[str], ds: int = 0, order: str | None = None) -> DataFrame:
    """One source: id from a stable key of numbers (see `numbered` for others), arrival by the column order, or by id."""
    return _as_profiles(table, key, F.concat_ws(" ", *(F.col(c).cast("string") for c in columns)), ds, order)


def attribute_profiles(table: DataFrame, key: str, attrs: str, ds: int = 0, order: str | None = None) -> DataFrame:
    """One source whose attributes are an array of (name, value); only the values are read."""
    return _as_profiles(table, key, F.array_join(F.transform(attrs, lambda a: a["value"]), " "), ds, order)


def interleave(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two sources in turn: by id, then by source."""
    both = first.withColumn("ds", F.lit(0)).unionByName(second.withColumn("ds", F.lit(1)))
    return both.withColumn("seq", F.col("id") * 2 + F.col("ds"))


def increment(size: int, seq: Column | str = "seq") -> Column:
    return F.floor((F.col(seq) if isinstance(seq, str) else seq) / size).cast("long")


def prefix(source: DataFrame, part: int) -> DataFrame:
    """The first 1/part of the arrivals."""
    return source.where(F.col("seq") < F.lit(source.count() // part))


def ground_truth(table: DataFrame, e1: str = "e1", e2: str = "e2", limit1: int | None = None, limit2: int | None = None, dirty: bool = False) -> DataFrame:
    """Distinct true pairs, those of known ids only where limits are given; dirty pairs have no direction."""
    out = table.select(F.col(e1).cast("long").alias("e1"), F.col(e2).cast("long").alias("e2"))
    if limit1 is not None:
        out = out.where(F.col("e1") < limit1)
    if limit2 is not None:
        out = out.where(F.col("e2") < limit2)
    if dirty:
        out = out.select(F.least("e1", "e2").alias("e1"), F.greatest("e1", "e2").alias("e2"))
    return out.distinct()
