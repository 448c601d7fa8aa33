"""Comparison cleaning: pruning weighted pairs by their neighbourhoods.

Node-wise forms look at the arriving entity's neighbourhood (e2 with earlier entities); the batch forms at all pairs of a node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ranked


def _arriving(by: tuple[str, ...] = ("e2",)):
    return Window.partitionBy(*by)


def redundancy_removed(raw: DataFrame) -> DataFrame:
    return raw.groupBy("e1", "e2").agg(F.count(F.lit(1)).alias("cbs"))


def above_mean(pairs: DataFrame, weight: str = "cbs", strict: bool = False, by: tuple[str, ...] = ("e2",)) -> DataFrame:
    """WNP2: at or above the mean of the arriving entity's neighbourhood; strict: above it (WNP), so ties alone keep nothing.
    by: the columns that name the arriving entity."""
    out = pairs.withColumn("_mean", F.avg(weight).over(_arriving(by)))
    return out.where(F.col(weight) > F.col("_mean") if strict else F.col(weight) >= F.col("_mean")).drop("_mean")


def below_mean(pairs: DataFrame, weight: str = "cbs") -> DataFrame:
    """What WNP2 drops."""
    return pairs.withColumn("_mean", F.avg(weight).over(_arriving())).where(F.col(weight) < F.col("_mean")).drop("_mean")


def cardinality(pairs: DataFrame, by: tuple[str, ...] = ("e2",)) -> DataFrame:
    """CNP: the top ceil(raw / distinct - 1) pairs of the arriving entity."""
    k = F.ceil(F.sum("cbs").over(_arriving(by)) / F.count(F.lit(1)).over(_arriving(by)) - 1)
    at = F.row_number().over(_arriving(by).orderBy(F.desc("cbs"), "e1", "e2"))
    return pairs.withColumns({"_k": k, "_at": at}).where("_at <= _k").drop("_k", "_at")


def sides(pairs: DataFrame) -> DataFrame:
    """Each pair seen from both ends: node, other."""
    here = pairs.withColumns({"node": F.col("e1"), "other": F.col("e2")})
    return here.unionByName(pairs.withColumns({"node": F.col("e2"), "other": F.col("e1")}))


def _passing(pairs: DataFrame, test: Column, both: bool) -> DataFrame:
    """Pairs that pass at either end or, for the reciprocal forms, at both."""
    seen = sides(pairs).withColumn("_pass", test.cast("int"))
    kept = seen.groupBy("e1", "e2").agg(F.sum("_pass").alias("_n"), F.first("w").alias("w"))
    return kept.where(F.col("_n") >= (2 if both else 1)).drop("_n")


def node_pruned(pairs: DataFrame, both: bool = False) -> DataFrame:
    """Weighted node pruning of (e1, e2, w); both: reciprocal."""
    return _passing(pairs, F.col("w") >= F.avg("w").over(Window.partitionBy("node")), both)


def node_topped(pairs: DataFrame, k: int, both: bool = False) -> DataFrame:
    """Cardinality node pruning of (e1, e2, w); both: reciprocal."""
    return _passing(pairs, F.row_number().over(Window.partitionBy("node").orderBy(F.desc("w"), "other")) <= k, both)


def edge_pruned(pairs: DataFrame) -> DataFrame:
    """WEP: at or above the mean of all."""
    mean = pairs.agg(F.avg("w")).first()[0]
    return pairs.where(F.col("w") >= F.lit(mean))


#: Pairs that are taken by a top-k, which merges them in one task; beyond it all pairs are ranked over range partitions.
TOP = 100_000


def edge_topped(pairs: DataFrame, k: int) -> DataFrame:
    """CEP: the top k of all."""
    order = (F.desc("w"), F.col("e1"), F.col("e2"))
    if k <= TOP:
        return pairs.orderBy(*order).limit(k)
    return ranked(pairs, *order)[0].where(F.col("rank") <= k).drop("rank")


def batch_cleaned(pairs: DataFrame, name: str, k: int = 1) -> DataFrame:
    """The batch cleaning of a name: no, hs, wnp, cnp, wep, cep, rcnp, rwnp (rcnpjs and rcnparcs are rwnp too)."""
    if name in ("no", "hs"):
        return pairs
    if name in ("wnp", "rwnp", "rcnpjs", "rcnparcs"):
        return node_pruned(pairs, both=name != "wnp")
    if name in ("cnp", "rcnp"):
        return node_topped(pairs, k, both=name == "rcnp")
    if name == "wep":
        return edge_pruned(pairs)
    if name == "cep":
        return edge_topped(pairs, k)
    raise ValueError(f"no cleaning is called {name}")


CLEANERS = {
    "hs": lambda p, by=("e2",): p,
    "wnp": lambda p, by=("e2",): above_mean(p, strict=True, by=by),
    "wnp2": lambda p, by=("e2",): above_mean(p, by=by),
    "cnp": cardinality,
}
