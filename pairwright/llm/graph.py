"""Connected components of a distributed edge list: alternating large-star and small-star rounds (Kiveris et al. 2014).

Every round is a minimum per node, combined before the shuffle, and a join that adaptive execution may split; rounds are cut to
the shared folder, and only a count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with u > v. Large: each node hands its larger neighbours to its least one; small: its smaller ones and itself."""
    if large:
        edges = edges.union(edges.select("v", "u"))
    low = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = edges.join(low, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m"))
    return out.where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of its component, for every node of edges (a, b). Loops and repeats don't matter; no edges,
    no rows."""
    now = cut(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = _checksum(now)
    while before[0]:
        after = cut(_star(_star(now, True), False), "edges")
        drop(now)
        now, seen = after, _checksum(after)
        if seen == before:
            break
        before = seen
    labels = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.union(labels.select("label", "label")).distinct()
