"""Total orders without a single task: range partitions, counted once, then numbered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.sources.storage import cut


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows with rank 1..k; Spark keeps k rows of each partition, never sorting all."""
    first = df.orderBy(*order).limit(k)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def ranked(df: DataFrame, *order: Column) -> tuple[DataFrame, int]:
    """All rows with rank 1..n in a total order, and n. One range exchange; only a count for each partition is broadcast."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(placed.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "ranked")
    counts = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = [], 0
    for part in sorted(counts):
        starts.append((part, total))
        total += counts[part]
    offsets = df.sparkSession.createDataFrame(starts, "_part int, _start long")
    return placed.join(F.broadcast(offsets), "_part").withColumn("rank", F.col("_start") + F.col("_at") + 1).drop("_part", "_at", "_start"), total


def running_sums(df: DataFrame, values: dict[str, Column], size: int = 100_000) -> DataFrame:
    """Running sums of values by `rank`, over blocks of ranks: sums of blocks first, then within each block."""
    blocks = df.withColumn("_block", F.floor((F.col("rank") - 1) / size)).withColumns({f"_value_{n}": v for n, v in values.items()})
    sums = blocks.groupBy("_block").agg(*(F.sum(f"_value_{n}").alias(f"_sum_{n}") for n in values))
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_block", *(F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in values))
    inside = Window.partitionBy("_block").orderBy("rank")
    within = blocks.withColumns({f"_within_{n}": F.sum(f"_value_{n}").over(inside) for n in values}).join(before, "_block")
    out = within.withColumns({n: F.col(f"_before_{n}") + F.col(f"_within_{n}") for n in values})
    return out.drop("_block", *(f"_{part}_{n}" for part in ("value", "within", "before") for n in values))


def running_sum(df: DataFrame, value: Column, name: str, size: int = 100_000) -> DataFrame:
    """One running sum by `rank`."""
    return running_sums(df, {name: value}, size)
