"""Prioritization: total orders of pairs (e1, e2, w), best first, ties by (e1, e2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cleaning import sides
from .ranking import ranked, top
from .weighting import block_pairs

#: Neighbours that an entity queues at most before pairs go to the second tier.
NEIGHBOURS = 60


def best() -> tuple[Column, ...]:
    return F.desc("w"), F.col("e1"), F.col("e2")


def global_top(pairs: DataFrame, k: int) -> DataFrame:
    """I-PCS and PGTC: the k best pairs with their rank."""
    return top(pairs, k, *best())


def _at_node(pairs: DataFrame) -> DataFrame:
    return sides(pairs).withColumn("at", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("w"), "other")))


def local_top(pairs: DataFrame, k: int) -> DataFrame:
    """PLTC and the union of CEP and CNP: every entity's k best pairs, once each, in the global order."""
    kept = _at_node(pairs).where(F.col("at") <= k).select("e1", "e2", "w").distinct()
    return ranked(kept, *best())[0]


def by_increment(pairs: DataFrame, size: int) -> DataFrame:
    """Local sort: rank inside the increment of the arriving entity."""
    groups = pairs.withColumn("increment", F.floor(F.col("e2") / size).cast("long"))
    return groups.withColumn("rank", F.row_number().over(Window.partitionBy("increment").orderBy(*best())).cast("long"))


def tiers(pairs: DataFrame, n: int = 4) -> DataFrame:
    """I-APCS: n tiers of equal size by weight, and the rank, which is the order they are emptied in."""
    order, total = ranked(pairs, *best())
    small, larger = divmod(total, n)
    cutoff = larger * (small + 1)
    tier = F.when(F.col("rank") <= cutoff, F.floor((F.col("rank") - 1) / (small + 1)) + 1).otherwise(larger + F.floor((F.col("rank") - 1 - cutoff) / max(small, 1)) + 1)
    return order.withColumn("tier", tier.cast("long"))


def least_blocks(raw: DataFrame) -> DataFrame:
    """(e1, e2, bp, token, cbs): each pair with its shared token of least (comparisons, token)."""
    bp = block_pairs().cast("long")
    found = raw.groupBy("e1", "e2").agg(F.min(F.struct(bp.alias("bp"), F.col("token"))).alias("least"), F.count(F.lit(1)).alias("cbs"))
    return found.select("e1", "e2", "least.bp", "least.token", "cbs")


def block_order(raw: DataFrame, by_token: bool = False) -> DataFrame:
    """I-PBS: smallest block first, then shared blocks; by_token keeps a block's pairs together (PBS)."""
    order = (F.col("bp"), F.col("token"), F.desc("cbs"), F.col("e1"), F.col("e2")) if by_token else (F.col("bp"), F.desc("cbs"), F.col("e1"), F.col("e2"))
    return ranked(least_blocks(raw), *order)[0]


def rounds(pairs: DataFrame) -> DataFrame:
    """I-PES, batch form: a pair's round is its better place at its two ends; pairs beyond an entity's NEIGHBOURS are tier 2."""
    placed = _at_node(pairs).groupBy("e1", "e2").agg(F.min("at").cast("long").alias("round"), F.first("w").alias("w"))
    placed = placed.withColumn("tier", F.when(F.col("round") <= NEIGHBOURS, 1).otherwise(2))
    return ranked(placed, F.col("round"), *best())[0]


def entity_order(pairs: DataFrame, k: int) -> DataFrame:
    """PES: first the best pair of every entity by weight; then entities by mean weight, each with its next k pairs."""
    at = _at_node(pairs).withColumn("likelihood", F.avg("w").over(Window.partitionBy("node")))
    first = at.where("at = 1").select("e1", "e2", "w").distinct()
    later = at.where((F.col("at") > 1) & (F.col("at") <= k + 1)).join(first.select("e1", "e2"), ["e1", "e2"], "left_anti")
    owner = F.row_number().over(Window.partitionBy("e1", "e2").orderBy(F.desc("likelihood"), "node"))
    later = later.withColumn("_n", owner).where("_n = 1")
    one = first.select(F.lit(1).alias("stage"), F.lit(0.0).alias("likelihood"), F.lit(0).cast("long").alias("entity"), "e1", "e2", "w")
    two = later.select(F.lit(2).alias("stage"), "likelihood", F.col("node").alias("entity"), "e1", "e2", "w")
    return ranked(one.union(two), F.col("stage"), F.desc("likelihood"), F.col("entity"), *best())[0]


def entity_weights(kept: DataFrame) -> DataFrame:
    """(id, w): sum over an entity's blocks of one over the block's comparisons."""
    sized = kept.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("n > 1")
    return sized.groupBy("id").agg(F.sum(1.0 / block_pairs()).alias("w"))


def entity_ranks(pairs: DataFrame) -> DataFrame:
    """(id, mean, best): mean and greatest weight of each entity."""
    return sides(pairs).groupBy(F.col("node").alias("id")).agg(F.avg("w").alias("mean_w"), F.max("w").alias("max_w"))


def block_ranks(raw: DataFrame, pairs: DataFrame) -> DataFrame:
    """(token, mean_w, good): mean weight of a block's pairs, and whether it is above the mean of these means."""
    means = raw.select("e1", "e2", "token").join(pairs.select("e1", "e2", "w"), ["e1", "e2"]).groupBy("token").agg(F.avg("w").alias("mean_w"))
    overall = means.agg(F.avg(F.round("mean_w", 9))).first()[0]
    return means.withColumn("good", F.round("mean_w", 9) > F.lit(overall))


def buckets(pairs: DataFrame, n: int = 10, most: int | None = None) -> DataFrame:
    """Bucket queue: bucket = min(n, floor(w * n)), best bucket first; inside it the order is the global one. most: the lowest
    buckets go, each as a whole, until no more than so many pairs are left."""
    out = pairs.withColumn("bucket", F.least(F.lit(n), F.floor(F.col("w") * n)).cast("long"))
    if most is None:
        return out
    counts = out.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"))  # n + 1 rows at most
    kept = counts.withColumn("upto", F.sum("c").over(Window.orderBy(F.desc("bucket")))).where(F.col("upto") <= most)
    return out.join(F.broadcast(kept.select("bucket")), "bucket", "left_semi")


#: Halvings of a bucket at most.
HALVINGS = 10


def sub_buckets(pairs: DataFrame, n: int = 10, most: int = 100) -> DataFrame:
    """Bucket queue with halving: a bucket of more than `most` pairs is cut in halves of its range, and these again, HALVINGS times at
    most. (e1, e2, w, depth, bucket): bucket numbers the ranges of that depth. Counts of the finest ranges decide, of which there
    are n * 2**HALVINGS + 1."""
    fine = 1 << HALVINGS
    out = pairs.withColumn("leaf", F.least(F.lit(n), F.floor(F.col("w") * n * fine) / fine))
    out = out.withColumn("leaf", F.floor(F.col("leaf") * fine).cast("long"))
    counts = out.groupBy("leaf").agg(F.count(F.lit(1)).alias("c"))
    depth = F.lit(HALVINGS)
    for d in reversed(range(HALVINGS)):
        held = F.sum("c").over(Window.partitionBy(F.expr(f"leaf div {1 << (HALVINGS - d)}")))
        depth = F.when(held <= most, d).otherwise(depth)
    depths = counts.withColumn("depth", depth).select("leaf", F.col("depth").cast("long").alias("depth"))
    named = out.join(F.broadcast(depths), "leaf")
    return named.withColumn("bucket", F.floor(F.col("leaf") / F.pow(F.lit(2.0), HALVINGS - F.col("depth"))).cast("long")).drop("leaf")


def bounded_tiers(pairs: DataFrame, first: int, shrink: int = 10) -> DataFrame:
    """Tiered queue with bounds: the best `first` pairs are tier 1, each tier behind holds a shrink-th of the one before, and what
    none has room for is dropped: (rank, tier, ...)."""
    bounds, room = [], first
    while room:
        bounds.append((bounds[-1] if bounds else 0) + room)
        room //= shrink
    kept = top(pairs, bounds[-1], *best()) if bounds else pairs.limit(0).withColumn("rank", F.lit(0).cast("long"))
    tier = F.lit(None)
    for i in reversed(range(len(bounds))):
        tier = F.when(F.col("rank") <= bounds[i], i + 1).otherwise(tier)
    return kept.withColumn("tier", tier.cast("long"))


def arrival_order(pairs: DataFrame) -> DataFrame:
    """No priorities: pairs as they come up."""
    return ranked(pairs, F.col("e2"), F.col("e1"))[0]


def immediate_and_later(pairs: DataFrame, k: int, factor: int) -> DataFrame:
    """PPS: the k best pairs of each arrival go out at once, in order of arrival; of the rest each e1 keeps its k * factor best, which
    follow at the end, entities by their mean weight over all of the rest: (rank, stage, e1, e2, w)."""
    at = pairs.withColumn("at", F.row_number().over(Window.partitionBy("e2").orderBy(F.desc("w"), "e1")))
    now = at.where(F.col("at") <= k).select(F.lit(1).alias("stage"), F.col("e2").alias("turn"), F.lit(0.0).alias("likelihood"), F.lit(0).cast("long").alias("entity"), "e1", "e2", "w")
    mine = Window.partitionBy("e1")
    rest = at.where(F.col("at") > k).withColumns({"likelihood": F.avg("w").over(mine), "place": F.row_number().over(mine.orderBy(F.desc("w"), "e2"))})
    later = rest.where(F.col("place") <= k * factor).select(F.lit(2).alias("stage"), F.lit(0).cast("long").alias("turn"), F.round("likelihood", 9).alias("likelihood"), F.col("e1").alias("entity"), "e1", "e2", "w")
    order = (F.col("stage"), F.col("turn"), F.desc("likelihood"), F.col("entity"), F.desc("w"), F.col("e1"), F.col("e2"))
    return ranked(now.union(later), *order)[0].drop("turn", "likelihood", "entity")


def entities_in_good_blocks(raw: DataFrame, pairs: DataFrame) -> DataFrame:
    """Entities by mean weight, each with its pairs from blocks whose mean weight is above the mean of these means; a pair goes with
    the end of greater mean: (rank, entity, e1, e2, w)."""
    good = block_ranks(raw, pairs).where("good").select("token")
    inside = raw.join(good, "token", "left_semi").select("e1", "e2").distinct().join(pairs.select("e1", "e2", "w"), ["e1", "e2"])
    means = entity_ranks(pairs).select("id", F.round("mean_w", 9).alias("mean_w"))
    one, two = means.toDF("e1", "m1"), means.toDF("e2", "m2")
    both = inside.join(one, "e1").join(two, "e2")
    first = (F.col("m1") > F.col("m2")) | ((F.col("m1") == F.col("m2")) & (F.col("e1") < F.col("e2")))
    owned = both.select("e1", "e2", "w", F.when(first, F.col("e1")).otherwise(F.col("e2")).alias("entity"), F.greatest("m1", "m2").alias("mean"))
    return ranked(owned, F.desc("mean"), F.col("entity"), F.desc("w"), F.col("e1"), F.col("e2"))[0].drop("mean")


def by_block_cardinality(raw: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs by weight over the comparisons of their least block: (rank, e1, e2, w)."""
    least = least_blocks(raw).select("e1", "e2", "bp")
    shared = pairs.select("e1", "e2", "w").join(least, ["e1", "e2"]).select("e1", "e2", F.round(F.col("w") / F.col("bp"), 9).alias("w"))
    return ranked(shared, *best())[0]


def page(order: DataFrame, request: int, k: int) -> DataFrame:
    """What the request of a number (from 0) pulls from ranked pairs when each takes k."""
    return order.where((F.col("rank") > request * k) & (F.col("rank") <= (request + 1) * k))


def leftovers(raw: DataFrame, emitted: DataFrame) -> DataFrame:
    """Fallback walk: pairs not emitted yet, smallest block first."""
    return least_blocks(raw).join(emitted.select("e1", "e2"), ["e1", "e2"], "left_anti").orderBy("bp", F.desc("cbs"), "e1", "e2")


#: Prioritizers of weighed pairs by name; what needs blocks or increments is in plans.pipeline. pq5 and pq10 differ from pq in how many
#: pairs a request pulls (`page`), and bf in its weight, which is the similarity of the matcher of that name.
PRIORITIZERS = {
    **dict.fromkeys(("icps", "pgtc", "pq", "pq5", "pq10", "bf"), lambda p, k: ranked(p, *best())[0] if k is None else top(p, k, *best())),
    "iacps": lambda p, k: tiers(p),
    "ieps": lambda p, k: rounds(p),
    "no": lambda p, k: arrival_order(p),
    "pltc": lambda p, k: local_top(p, 5),
    "pes": lambda p, k: entity_order(p, 10),
    "cepcnpent": lambda p, k: entity_order(p, 10),
    "pps": lambda p, k: immediate_and_later(p, 10, 10),
    "tm": lambda p, k: ranked(buckets(p), F.desc("bucket"), *best())[0],
    "etm": lambda p, k: ranked(sub_buckets(p), *best())[0],
}


def prioritized_by(name: str, pairs: DataFrame, k: int | None = None) -> DataFrame:
    """Weighed pairs with rank by the prioritizer of a name; k: how many are wanted, where the order allows to stop there."""
    if name not in PRIORITIZERS:
        raise ValueError(f"no prioritizer is called {name}")
    return PRIORITIZERS[name](pairs, k)
