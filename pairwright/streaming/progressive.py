"""Progressive resolution over increments: after each increment the best K of all pairs that wait go out, the rest stay queued, and
once the input has ended the queue drains by further requests of K.

A batch's pairs are ghosted, weighed, cleaned by the node that arrived and put into the queue, a table by batch like all other
state; a request takes the first K of the queue in the order of the prioritizer. A policy (streaming.policy) gives K: fixed, or
from the rates of arrival and service. A budget ends the releases by count, a limit of seconds by time.

    icps, iacps   weight, best first (tiers of iacps only bound memory; the order is that of the weight)
    ilsps         as icps, but only pairs of the newest increment wait
    ieps          entity rounds over what is queued: a pair's round is its better place at its two ends (first NEIGHBOURS, then the rest)
    ipbs          the smallest block first, by its comparisons when the pair came up, then shared blocks
    no            in order of arrival

Where a budget is left and the order is that of the weight, a pair behind as many better ones as the budget has left can't go out any
more, so only the best of a batch are queued (`best`); they are found where the batch's pairs are counted, as packed numbers.

`bound` keeps at most so many pairs queued, the best in that order (None: all). Where no pair is left, a request may go on to
`fallback`: pairs of blocks that cleaning had dropped, smallest block first.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairwright.operators import cleaning, packed, prioritize, ranking

from .incremental import Blocks, Members, stream
from .policy import Fixed
from .sides import SMALL, Sides
from .state import Table

#: bp is null where only the best of a batch are queued.
PAIR = "e1 long, e2 long, w double, cbs long, bp long, node_ds int, node long, increment long"
ORDERS = ("icps", "iacps", "ilsps", "ieps", "ipbs", "no")


@dataclass(frozen=True)
class Settings:
    """What a stream does with its pairs. sizes: of the two sources, for two; beta: ghosting, 0 for none."""

    prioritizer: str = "icps"
    weighting: str = "cbs"
    cleaning: str = "wnp2"
    cap: float = 50
    sizes: tuple[int, int] | None = None
    rho: float = 0.5
    beta: float = 0.0
    bound: int | None = None
    budget: int | None = None
    seconds: float | None = None
    fallback: bool = False

    def __post_init__(self):
        if not any(self.prioritizer.startswith(p) for p in ORDERS):
            raise ValueError(f"no prioritizer is called {self.prioritizer}")
        if self.weighting not in ("cbs", "js", "bjs"):
            raise ValueError(f"no weighting is called {self.weighting}")
        if self.cleaning not in cleaning.CLEANERS:
            raise ValueError(f"no cleaning is called {self.cleaning}")


def _comparisons(two: bool) -> Column:
    return F.col("n0") * F.col("n1") if two else F.expr("n0 * (n0 - 1) div 2")


WEIGHED = "e1 long, e2 long, cbs long, w double"


def _best(k: int, scale: float | None):
    """The k best of a worker's pairs, by weight, e1, e2. scale: of cbs over all blocks of either end; None: w is cbs."""

    def run(batches):
        held, n, least = [], 0, -np.inf

        def first():
            e1, e2, cbs, w = (np.concatenate(x) for x in zip(*held, strict=True))
            if len(w) > k:  # all that the k-th best may be, then in order
                some = np.flatnonzero(w >= np.partition(w, len(w) - k)[len(w) - k])
                some = some[np.lexsort((e2[some], e1[some], -w[some]))[:k]]
                e1, e2, cbs, w = e1[some], e2[some], cbs[some], w[some]
            return e1, e2, cbs, w

        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy()  # noqa: B023, E731
            e1, e2, cbs = (column(c) for c in ("e1", "e2", "cbs"))
            w = cbs.astype(np.float64) if scale is None else cbs * scale / (column("nb1") + column("nb2") - cbs)
            some = w >= least
            held.append((e1[some], e2[some], cbs[some], w[some]))
            n += int(some.sum())
            if n > 4 * k + 100_000:
                held = [first()]
                n, least = len(held[0][0]), held[0][3].min() if len(held[0][0]) == k else -np.inf
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in first()], names=["e1", "e2", "cbs", "w"])

    return run


class Progressive:
    """Blocks, queue and releases of one stream."""

    def __init__(self, spark: SparkSession, settings: Settings, policy=None):
        self.spark, self.settings, self.policy = spark, settings, policy or Fixed(100)
        self.two = settings.sizes is not None
        self.blocks = Blocks(spark, settings.cap, settings.sizes, settings.rho)
        self.counts = Table(spark, "entity-blocks", "ds int, id long, nb long")
        self.queue = Table(spark, "queue", PAIR, whole=True)
        self.dropped = Table(spark, "dropped", PAIR)
        self.released = Table(spark, "released", f"request long, rank long, {PAIR}")
        self.members, self.chosen = Members(spark, settings.cap), Table(spark, "best", PAIR)
        self.sides = Sides(spark, settings.sizes, settings.rho) if self.two else None
        self.requests, self.sent, self.began, self.last = 0, {}, time.monotonic(), None

    def weighed(self, kept: DataFrame, number: int) -> DataFrame:
        """The new pairs of a batch with cbs, bp (of their least block) and w."""
        s = self.settings
        alive = kept.where("c >= 1")
        if s.beta:
            least = F.min(F.col("c") + 1).over(Window.partitionBy("ds", "id"))
            alive = alive.withColumn("least", least).where((F.col("c") + 1) * s.beta < F.col("least"))
        raw = self.blocks.pairs(kept, number).join(alive.select("token", F.col("ds").alias("node_ds"), F.col("id").alias("node")), ["token", "node_ds", "node"], "left_semi")
        sizes = self.blocks.counts.of(number).select("token", _comparisons(self.two).alias("bp"))
        pairs = raw.join(sizes, "token").groupBy("e1", "e2", "node_ds", "node").agg(F.count(F.lit(1)).alias("cbs"), F.min("bp").alias("bp"))
        if s.weighting == "cbs":
            return pairs.withColumn("w", F.col("cbs").cast("double"))
        self.counts.write(kept.groupBy("ds", "id").agg(F.count(F.lit(1)).alias("nb")), number)
        nb = self.counts.all(number + 1)
        one = nb.where("ds = 0").select(F.col("id").alias("e1"), F.col("nb").alias("nb1"))
        two = nb.where(F.col("ds") == (1 if self.two else 0)).select(F.col("id").alias("e2"), F.col("nb").alias("nb2"))
        scale = 100.0 if s.weighting == "bjs" else 1.0
        return pairs.join(one, "e1").join(two, "e2").withColumn("w", F.col("cbs") * scale / (F.col("nb1") + F.col("nb2") - F.col("cbs"))).drop("nb1", "nb2")

    def ordered(self, queue: DataFrame) -> tuple[DataFrame, tuple[Column, ...]]:
        """The queue with what its order needs, and the order."""
        name = self.settings.prioritizer
        if name.startswith("ipbs"):
            return queue, (F.col("bp"), F.desc("cbs"), F.col("e1"), F.col("e2"))
        if name == "no":
            return queue, (F.col("increment"), F.col("node"), F.col("node_ds"), F.col("e1"), F.col("e2"))
        if name == "ieps":
            ends = [queue.withColumns({"end": F.lit(0), "at": F.col("e1")}), queue.withColumns({"end": F.lit(1 if self.two else 0), "at": F.col("e2")})]
            other = F.when(F.col("at") == F.col("e1"), F.col("e2")).otherwise(F.col("e1"))
            place = F.row_number().over(Window.partitionBy("end", "at").orderBy(F.desc("w"), other))
            rounds = ends[0].unionByName(ends[1]).withColumn("place", place).groupBy(*queue.columns).agg(F.min("place").alias("round"))
            return rounds, ((F.col("round") > prioritize.NEIGHBOURS), F.col("round"), *prioritize.best())
        return queue, prioritize.best()

    @property
    def few(self) -> bool:
        """Whether `best` has all that the budget can ever let out."""
        s = self.settings
        ends = s.budget is not None and s.budget <= cleaning.TOP and s.prioritizer.startswith(("icps", "iacps", "ilsps"))
        two = not self.two or (s.weighting == "cbs" and min(s.sizes) <= SMALL)
        return ends and two and s.cleaning in ("wnp2", "hs") and not (s.beta or s.fallback)

    def best(self, batch: DataFrame, number: int) -> DataFrame:
        """The best cleaned pairs of a batch, as many as the budget has left."""
        s, left = self.settings, self._unsent(number)
        if self.two:
            return self._best_of_two(batch, left, number)
        blocks = self.members.add(batch, number)
        fresh, mean = self.members.fresh(blocks), s.cleaning == "wnp2"
        if s.weighting == "cbs":
            found = packed.common_blocks(fresh, mean, _best(left, None), WEIGHED)
        else:
            came = blocks.select(F.explode(F.expr("slice(ids, old + 1, size(ids) - old)")).alias("id"))
            self.counts.write(came.groupBy("id").agg(F.count(F.lit(1)).alias("nb")).select(F.lit(0).alias("ds"), "id", "nb"), number)
            found = packed.common_sizes(fresh, self.counts.all(number + 1), mean, _best(left, 100.0 if s.weighting == "bjs" else 1.0), WEIGHED)
        first = found.select("e1", "e2", "w", "cbs", F.lit(0).alias("node_ds"), F.col("e2").alias("node"))
        return self._chosen(first, left, number)

    def _best_of_two(self, batch: DataFrame, left: int, number: int) -> DataFrame:
        """Pairs whose small end arrived last are cleaned here, as they are made in many places; the others are cleaned by the workers."""
        mean, small = self.settings.cleaning == "wnp2", self.sides.small
        met = self.sides.pairs(batch, number, mean)
        best, ends = _best(left, None), ("e1", "e2")
        done = met.where("NOT late").select("e1", "e2", "cbs").mapInArrow(best, WEIGHED)
        late = met.where("late").select("e1", "e2", "cbs")
        late = (cleaning.above_mean(late, by=(ends[small],)) if mean else late).withColumn("w", F.col("cbs").cast("double"))
        node = lambda df, side: df.select("e1", "e2", "w", "cbs", F.lit(side).alias("node_ds"), F.col(ends[side]).alias("node"))
        return self._chosen(node(done, 1 - small).unionByName(node(late, small)), left, number)

    def _chosen(self, pairs: DataFrame, left: int, number: int) -> DataFrame:
        """The first of these pairs, written once. No order that is the weight's reads the size of their least block: bp is null."""
        first = pairs.orderBy(*prioritize.best()).limit(left)
        names = [c.split()[0] for c in PAIR.split(", ")]
        return self.chosen.write(first.withColumns({"bp": F.lit(None).cast("long"), "increment": F.lit(number).cast("long")}).select(names), number)

    def _unsent(self, number: int) -> int:
        """What the budget has left for a request and those behind it."""
        return max(0, self.settings.budget - sum(n for request, n in self.sent.items() if request != number))

    def _left(self, number: int) -> int | None:
        """How many pairs may still go out with a request; None: no limit."""
        s = self.settings
        if s.seconds is not None and time.monotonic() - self.began >= s.seconds:
            return 0
        return None if s.budget is None else self._unsent(number)

    def _release(self, queue: DataFrame, number: int) -> DataFrame:
        """One request: K pairs go out, and the rest is the queue."""
        k = self.policy.next()
        left = self._left(number)
        k = k if left is None else max(0, min(k, left))
        plan, order = self.ordered(queue)
        first = ranking.top(plan, k, *order).select(F.lit(number).cast("long").alias("request"), "rank", *queue.columns)
        sent = self.released.write(first, number)
        self.sent[number] = sent.count()
        self.requests = max(self.requests, number + 1)
        rest = queue.join(sent.select("e1", "e2"), ["e1", "e2"], "left_anti")
        bounds = [self.settings.bound] if self.settings.bound is not None else []
        bounds += [self._unsent(number + 1)] if self.few else []
        if bounds:
            plan, order = self.ordered(rest)
            rest = ranking.top(plan, min(bounds), *order).select(queue.columns)
        return rest.select(queue.columns)

    def _cleaned(self, batch: DataFrame, number: int) -> DataFrame:
        """The cleaned pairs of a batch; what cleaning dropped is written for the fallback."""
        kept = self.blocks.add(batch, number)
        fresh = self.weighed(kept, number).withColumn("increment", F.lit(number).cast("long"))
        names = [c.split()[0] for c in PAIR.split(", ")]
        cleaned = cleaning.CLEANERS[self.settings.cleaning](fresh, by=("node_ds", "node")).select(names)
        if self.settings.fallback:
            self.dropped.write(fresh.select(names).join(cleaned.select("e1", "e2"), ["e1", "e2"], "left_anti"), number)
        return cleaned

    def step(self, batch: DataFrame, number: int) -> None:
        """One increment, and the request behind it."""
        began = time.monotonic()
        if self.last is not None and hasattr(self.policy, "arrived"):
            self.policy.arrived(began - self.last)
        self.last = began
        cleaned = self.best(batch, number) if self.few else self._cleaned(batch, number)
        waiting = cleaned if self.settings.prioritizer == "ilsps" else self.queue.before(number).unionByName(cleaned)
        self.queue.write(self._release(waiting, number), number)
        if hasattr(self.policy, "served"):
            self.policy.served(time.monotonic() - began)

    def drain(self) -> None:
        """Requests after the end of the input, until the queue is empty or the budget spent; then the fallback, if there is one."""
        if hasattr(self.policy, "ended"):
            self.policy.ended = True
        number, extra = self.requests, self.settings.fallback
        batches = number
        queue = self.queue.before(number)
        while (left := self._left(number)) is None or left > 0:
            if queue.isEmpty():
                if not extra:
                    return
                extra, queue = False, self.dropped.all(batches)
                continue
            if not extra and self.settings.fallback:
                order = (F.col("bp"), F.desc("cbs"), F.col("e1"), F.col("e2"))
                k = self.policy.next() if left is None else min(self.policy.next(), left)
                first = ranking.top(queue, k, *order).select(F.lit(number).cast("long").alias("request"), "rank", *queue.columns)
                sent = self.released.write(first, number)
                self.sent[number] = sent.count()
                self.requests = number + 1
                rest = queue.join(sent.select("e1", "e2"), ["e1", "e2"], "left_anti").select(queue.columns)
            else:
                rest = self._release(queue, number)
            queue = self.queue.write(rest, number)
            number += 1

    def pairs(self) -> DataFrame:
        """(request, rank, e1, e2, w, cbs, bp, node_ds, node, increment) of all that went out; rank is that within the request."""
        return self.released.all(self.requests)


def run(source: DataFrame, size: int, settings: Settings = Settings(), policy=None, every: str | None = None) -> DataFrame:
    """Stream a source in increments of `size` arrivals, drain the queue behind it, and return the releases."""
    state = Progressive(source.sparkSession, settings, policy)
    stream(source, size, state.step, every)
    state.drain()
    return state.pairs()
