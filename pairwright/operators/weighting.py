"""Pair weights from block counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pairs import block_lists, with_tokens


def block_counts(kept: DataFrame) -> DataFrame:
    """(ds, id, nb)"""
    return kept.groupBy("ds", "id").agg(F.count(F.lit(1)).alias("nb"))


def _with_counts(pairs: DataFrame, kept: DataFrame, ds1: int, ds2: int) -> DataFrame:
    counts = block_counts(kept)
    one = counts.where(F.col("ds") == ds1).select(F.col("id").alias("e1"), F.col("nb").alias("nb1"))
    two = counts.where(F.col("ds") == ds2).select(F.col("id").alias("e2"), F.col("nb").alias("nb2"))
    return pairs.join(one, "e1").join(two, "e2")


def jaccard_of_blocks(pairs: DataFrame, kept: DataFrame, ds1: int = 0, ds2: int = 0, scale: float = 1.0) -> DataFrame:
    """(e1, e2, cbs, w): shared blocks over all blocks of either, times scale (100 for the BJS ranker)."""
    w = F.col("cbs") * scale / (F.col("nb1") + F.col("nb2") - F.col("cbs"))
    return _with_counts(pairs, kept, ds1, ds2).select("e1", "e2", "cbs", w.alias("w"))


def normalized(raw: DataFrame) -> DataFrame:
    """cbs over the distinct tokens that the arriving entity met."""
    keys = raw.groupBy("e2").agg(F.countDistinct("token").alias("keys"))
    pairs = raw.groupBy("e1", "e2").agg(F.count(F.lit(1)).alias("cbs"))
    return pairs.join(keys, "e2").select("e1", "e2", (F.col("cbs") / F.col("keys")).alias("w"))


def over_running_max(pairs: DataFrame, size: int = 100_000) -> DataFrame:
    """cbs over the greatest cbs so far in arrival order (e2), in two levels: maxima of groups of arrivals, then inside each."""
    best = pairs.groupBy("e2").agg(F.max("cbs").alias("m")).withColumn("g", F.floor(F.col("e2") / size))
    groups = best.groupBy("g").agg(F.max("m").alias("gm"))
    before = groups.select("g", F.max("gm").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    inside = F.max("m").over(Window.partitionBy("g").orderBy("e2"))
    so_far = best.withColumn("inside", inside).join(before, "g").select("e2", F.greatest(F.lit(1), "inside", F.coalesce("before", F.lit(0))).alias("most"))
    return pairs.join(so_far, "e2").select("e1", "e2", (F.col("cbs") / F.col("most")).alias("w"))


def block_pairs(n: Column | str = "n") -> Column:
    n = F.col(n) if isinstance(n, str) else n
    return n * (n - 1) / 2


def arcs(raw: DataFrame) -> DataFrame:
    """Sum over shared blocks of one over the block's comparisons."""
    return raw.groupBy("e1", "e2").agg(F.sum(1.0 / block_pairs()).alias("w"))


def approximate_common(pairs: DataFrame, kept: DataFrame) -> DataFrame:
    """(e1, e2, cbs) by intersecting the two block lists, for pairs of one source however they were found."""
    return with_tokens(pairs.select("e1", "e2"), block_lists(kept)).select("e1", "e2", F.size(F.array_intersect("t1", "t2")).cast("long").alias("cbs"))


def arriving_common(raw: DataFrame) -> DataFrame:
    """(e1, e2, node_ds, node, cbs) of two sources, from (e1, e2, token, arriving_ds): pairs grouped by the end that arrived last."""
    node = F.when(F.col("arriving_ds") == 1, F.col("e2")).otherwise(F.col("e1"))
    return raw.groupBy("e1", "e2", F.col("arriving_ds").alias("node_ds"), node.alias("node")).agg(F.count(F.lit(1)).alias("cbs"))


WEIGHTINGS = ("cbs", "js", "bjs", "ncbs", "cbs_max", "arcs")


def weighed_by(name: str, pairs: DataFrame, raw: DataFrame, kept: DataFrame, two: bool = False) -> DataFrame:
    """Pairs (e1, e2, cbs) with w by the weighting of a name; raw: pairs by token, kept: postings."""
    if name == "cbs":
        return pairs.withColumn("w", F.col("cbs").cast("double"))
    if name in ("js", "bjs"):
        return jaccard_of_blocks(pairs, kept, 0, int(two), 100.0 if name == "bjs" else 1.0)
    if name == "cbs_max":
        return over_running_max(pairs).join(pairs.select("e1", "e2", "cbs"), ["e1", "e2"])
    if name == "ncbs":
        return normalized(raw).join(pairs.select("e1", "e2", "cbs"), ["e1", "e2"])
    if name == "arcs":
        comparisons = F.col("n1") * F.col("n2") if two else block_pairs()
        return raw.groupBy("e1", "e2").agg(F.sum(1.0 / comparisons).alias("w")).join(pairs.select("e1", "e2", "cbs"), ["e1", "e2"])
    raise ValueError(f"no weighting is called {name}")
