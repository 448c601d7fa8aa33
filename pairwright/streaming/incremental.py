"""Increments as a Structured Streaming query: each micro-batch is one increment of profiles.

`Blocks` keeps the token blocks of one or two sources up over batches: postings by batch, and a table (token, n0, n1, banned) that
stands for them wherever only sizes matter, so a batch never counts the postings again. `Incremental` yields the common-block
counts of all new pairs; a pair's later end is always in the newest batch, so no pair is yielded twice. `Members` keeps the blocks of
one source as lists of members, for pairs that only travel as packed numbers (operators.packed).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairwright.functions.text import postings
from pairwright.operators import evaluate, packed
from pairwright.sources.storage import fresh_path

from .state import Table


class Blocks:
    """Kept postings over batches. One source: a token takes its first cap - 1 arrivals. Two sources (sizes n0, n1): a token is
    banned from the first arrival that finds rho times the size of its own source, less one, on the other side."""

    def __init__(self, spark: SparkSession, cap: float, sizes: tuple[int, int] | None = None, rho: float = 0.5):
        self.spark, self.cap, self.sizes, self.rho = spark, cap, sizes, rho
        self.postings = Table(spark, "postings", "token string, ds int, id long, seq long, c long")
        self.counts = Table(spark, "blocks", "token string, n0 long, n1 long, banned boolean", whole=True)

    def add(self, batch: DataFrame, number: int) -> DataFrame:
        """The kept postings of a batch, with c, the members that each met: earlier ones of its block, of the other source if there are two."""
        held = self.counts.before(number)
        fresh = postings(batch).join(held, "token", "left").fillna({"n0": 0, "n1": 0, "banned": False}).where("NOT banned")
        by = Window.partitionBy("token").orderBy("seq", "id")
        if self.sizes is None:
            rn = F.row_number().over(by)  # alone, so that Spark limits the group before the shuffle
            kept = fresh.withColumn("rn", rn).where((F.col("rn") == 1) | (F.col("rn") < self.cap)).withColumn("c", F.col("rn") - 1 + F.col("n0")).where((F.col("c") == 0) | (F.col("c") + 1 < self.cap))
            bans = None
        else:
            before = by.rowsBetween(Window.unboundedPreceding, -1)
            other = F.when(F.col("ds") == 0, F.col("n1") + F.count_if(F.col("ds") == 1).over(before)).otherwise(F.col("n0") + F.count_if(F.col("ds") == 0).over(before))
            limit = F.when(F.col("ds") == 0, F.lit(self.rho * self.sizes[0])).otherwise(F.lit(self.rho * self.sizes[1]))
            seen = fresh.withColumn("c", other)
            ban = F.min(F.when((F.col("c") >= 1) & (F.col("c") + 1 >= limit), F.col("seq"))).over(Window.partitionBy("token"))
            seen = seen.withColumn("ban", ban)
            kept = seen.where("ban IS NULL OR seq < ban")
            bans = seen.where("ban IS NOT NULL").select("token").distinct()
        kept = self.postings.write(kept.select("token", F.col("ds").cast("int").alias("ds"), "id", "seq", F.col("c").cast("long").alias("c")), number)
        new = kept.groupBy("token").agg(F.count_if(F.col("ds") == 0).alias("m0"), F.count_if(F.col("ds") == 1).alias("m1"))
        merged = held.join(new, "token", "full").fillna({"n0": 0, "n1": 0, "m0": 0, "m1": 0, "banned": False})
        merged = merged.select("token", (F.col("n0") + F.col("m0")).alias("n0"), (F.col("n1") + F.col("m1")).alias("n1"), "banned")
        if bans is not None:
            told = merged.join(bans.withColumn("b", F.lit(True)), "token", "full")
            merged = told.select("token", F.coalesce("n0", F.lit(0)).alias("n0"), F.coalesce("n1", F.lit(0)).alias("n1"), (F.coalesce("banned", F.lit(False)) | F.coalesce("b", F.lit(False))).alias("banned"))
        self.counts.write(merged, number)
        return kept

    def pairs(self, kept: DataFrame, number: int) -> DataFrame:
        """(e1, e2, token, node_ds, node) for the members that postings of a batch met; node arrived last. e1 is the earlier end, or
        that of the first source."""
        known = self.postings.before(number).unionByName(kept).select("token", F.col("ds").alias("d1"), F.col("id").alias("i1"), F.col("seq").alias("s1"))
        arrived = kept.select("token", "ds", "id", "seq")
        if self.sizes is None:
            met = arrived.join(known, "token").where("s1 < seq")
            return met.select(F.col("i1").alias("e1"), F.col("id").alias("e2"), "token", F.col("ds").alias("node_ds"), F.col("id").alias("node"))
        first = F.col("ds") == 0
        # side by side: a join by token alone would try all pairs of either source too
        met = [arrived.where(F.col("ds") == d).join(known.where(F.col("d1") == 1 - d), "token").where("s1 < seq") for d in (0, 1)]
        return met[0].unionByName(met[1]).select(F.when(first, F.col("id")).otherwise(F.col("i1")).alias("e1"), F.when(first, F.col("i1")).otherwise(F.col("id")).alias("e2"), "token", F.col("ds").alias("node_ds"), F.col("id").alias("node"))


class Members:
    """The members of each block of one source over batches, in order of arrival, under the cap; tokens are hashed."""

    def __init__(self, spark: SparkSession, cap: float):
        self.cap, self.table = cap, Table(spark, "members", packed.MEMBERS, whole=True)

    def add(self, batch: DataFrame, number: int) -> DataFrame:
        """All blocks after a batch; old: how many of the members were there before it."""
        return self.table.write(packed.members(batch, self.table.before(number), self.cap), number)

    @staticmethod
    def fresh(blocks: DataFrame) -> DataFrame:
        """Those of these blocks in which a batch made pairs."""
        return blocks.where(F.size("ids") > F.greatest("old", F.lit(1)))


class Incremental:
    """Common-block counts of one source, batch by batch."""

    def __init__(self, spark: SparkSession, cap: float):
        self.blocks, self.out, self.batches = Blocks(spark, cap), Table(spark, "pairs", "e1 long, e2 long, cbs long, increment long"), 0

    def step(self, batch: DataFrame, number: int) -> None:
        """One increment. A batch that is run again after a failure writes the same rows over its own earlier ones."""
        kept = self.blocks.add(batch, number)
        pairs = self.blocks.pairs(kept, number).groupBy("e1", "e2").agg(F.count(F.lit(1)).alias("cbs"))
        self.out.write(pairs.withColumn("increment", F.lit(number).cast("long")), number)
        self.batches = max(self.batches, number + 1)

    def pairs(self) -> DataFrame:
        return self.out.all(self.batches)


def stage_increments(source: DataFrame, size: int, path: str) -> list[int]:
    """Write (ds, id, seq, text) by increment in one pass, and one marker file for each; the increments in order."""
    grouped = source.withColumn("increment", F.floor(F.col("seq") / size).cast("int"))
    grouped.repartitionByRange("increment", "seq").sortWithinPartitions("increment", "seq").write.partitionBy("increment").parquet(f"{path}/data")
    groups = [r["increment"] for r in source.sparkSession.read.parquet(f"{path}/data").select("increment").distinct().orderBy("increment").collect()] if not source.isEmpty() else []
    if groups:
        source.sparkSession.range(0, len(groups), 1, len(groups)).write.parquet(f"{path}/markers")
    return groups


def stream(source: DataFrame, size: int, step: Callable[[DataFrame, int], None], every: str | None = None) -> int:
    """Call step(increment, number) for one increment of `size` arrivals after the other, each as a micro-batch of a Structured
    Streaming query, and return how many there were. A micro-batch is set off by one marker and takes the next increment by its
    number, so neither the order nor the age of files matters. every: a trigger interval such as '2 seconds', to throttle the input."""
    spark = source.sparkSession
    path = fresh_path(spark, "increments")
    groups = stage_increments(source, size, path)
    if not groups:
        return 0
    columns = source.columns

    def run(_: DataFrame, number: int) -> None:
        step(spark.read.schema(source.schema).parquet(f"{path}/data/increment={groups[number]}").select(columns), number)

    markers = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{path}/markers")
    writer = markers.writeStream.foreachBatch(run).option("checkpointLocation", fresh_path(spark, "progress"))
    if every is None:
        writer.trigger(availableNow=True).start().awaitTermination()
    else:
        query = writer.trigger(processingTime=every).start()
        query.processAllAvailable()
        query.stop()
    return len(groups)


def run(source: DataFrame, size: int, cap: float, listener: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Stream a source through `Incremental`, one increment at a time, until none is left; (e1, e2, cbs, increment)."""
    state = Incremental(source.sparkSession, cap)

    def step(batch: DataFrame, number: int) -> None:
        state.step(batch, number)
        if listener is not None:
            listener(state.out.of(number), number)

    stream(source, size, step)
    return state.pairs()


def measured(source: DataFrame, size: int, cap: float, truth: DataFrame) -> DataFrame:
    """Stream a source increment by increment and count the new pairs of each: (increment, comparisons, found), found being those that
    are true; increments without pairs have no row. The pairs are counted where they are made, and none is stored."""
    spark = source.sparkSession
    members, out = Members(spark, cap), Table(spark, "measures", f"increment long, {evaluate.TALLY}")
    few = truth.count() <= evaluate.BROADCAST_PAIRS
    tally, known = evaluate.tallied(truth) if few else (None, None)

    def step(batch: DataFrame, number: int) -> None:
        fresh = members.fresh(members.add(batch, number))
        if few:
            counts = packed.common_blocks(fresh, then=tally, schema=evaluate.TALLY)
        else:
            counts = evaluate.flagged(packed.common_blocks(fresh), truth).select(F.lit(1).alias("comparisons"), F.col("hit").alias("found"))
        sums = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("comparisons", "found")))
        out.write(sums.select(F.lit(number).cast("long").alias("increment"), "comparisons", "found"), number)

    batches = stream(source, size, step)
    if known is not None:
        known.destroy()
    return out.all(batches).where("comparisons > 0")
