"""Clusters of matched pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairwright.sources.storage import cut, drop


def components(edges: DataFrame) -> DataFrame:
    """(id, cluster) for every end of edges (e1, e2): the least id that is reachable. Each round takes the least label among
    neighbours and then the label's own label, so long chains shorten fast; rounds are cut to the shared folder."""
    both = cut(edges.select("e1", "e2").union(edges.select("e2", "e1")).distinct().toDF("id", "other"), "edges")
    labels = cut(both.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("cluster")), "labels")
    last = labels
    while True:
        seen = labels.select(F.col("id").alias("other"), F.col("cluster").alias("c"))
        near = both.join(seen, "other").groupBy("id").agg(F.min("c").alias("near"))
        now = labels.join(near, "id").select("id", "cluster", F.least("cluster", "near").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("cluster").alias("jump"))
        now = cut(now.join(jump, "low").select("id", F.col("cluster").alias("before"), F.least("low", "jump").alias("cluster")), "labels")
        drop(last)
        if now.where("before != cluster").isEmpty():
            drop(both)
            return now.select("id", "cluster")
        labels, last = now.select("id", "cluster"), now


def unique_mapping(scored: DataFrame, threshold: float) -> DataFrame:
    """Clean-clean one-to-one mapping (e1, e2, sim): rounds of mutually best pairs, the same as taking pairs best first and
    skipping ends already taken."""
    left = cut(scored.where(F.col("sim") > threshold).select("e1", "e2", "sim"), "candidates")
    taken = None
    while not left.isEmpty():
        order = (F.desc("sim"), F.col("e1"), F.col("e2"))
        at = left.withColumns({"a": F.row_number().over(Window.partitionBy("e1").orderBy(*order)), "b": F.row_number().over(Window.partitionBy("e2").orderBy(*order))})
        won = cut(at.where("a = 1 AND b = 1").select("e1", "e2", "sim"), "mapped")
        taken = won if taken is None else taken.union(won)
        before, left = left, cut(left.join(won.select("e1"), "e1", "left_anti").join(won.select("e2"), "e2", "left_anti"), "candidates")
        drop(before)
    return taken if taken is not None else left


def truth_clusters(pairs: DataFrame) -> DataFrame:
    """Clusters of two members or more of true pairs."""
    return components(pairs.where("e1 != e2"))


def components_two(scored: DataFrame, threshold: float) -> DataFrame:
    """(ds, id, cluster) of two sources' matches above the threshold: ids of the second are moved behind those of the first, by the
    greatest e1 of the matches plus one, and cluster is the least moved id that is reachable."""
    edges = cut(scored.where(F.col("sim") > threshold).select("e1", "e2"), "matches")
    offset = (edges.agg(F.max("e1")).first()[0] or 0) + 1
    found = components(edges.select("e1", (F.col("e2") + offset).alias("e2")))
    second = F.col("id") >= offset
    return found.select(second.cast("int").alias("ds"), F.when(second, F.col("id") - offset).otherwise(F.col("id")).alias("id"), "cluster")


def collected(scored: DataFrame, threshold: float, two: bool = False) -> DataFrame:
    """What the matches mean: a one-to-one mapping of two sources, the components of one."""
    return unique_mapping(scored, threshold) if two else components(scored.where(F.col("sim") > threshold))
