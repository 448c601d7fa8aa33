"""The three ways to run the engine as one configured call."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.functions.text import postings, token_sets
from pairwright.operators import blocking, cleaning, evaluate, matching, pairs, prioritize, ranking, weighting
from pairwright.sources.storage import broadcast_if
from pairwright.streaming import incremental
from pairwright.streaming import progressive as stream_progressive

#: Ids broadcast at most (8 bytes each).
BROADCAST_IDS = 1_000_000


@dataclass(frozen=True)
class Config:
    """mode: dirty (one source with duplicates) or clean_clean (two without). blocker: tb (no limit), tbr (cap: block size an arrival
    may not reach) or etbr (the same with ghosting). beta: ghosting, 0 for none. cleaning: hs, wnp, wnp2 or cnp by arrival, or a batch
    cleaning of cleaning.batch_cleaned, prefixed by batch: (batch:rwnp). weighting: one of weighting.WEIGHTINGS. prioritizer: one of
    prioritize.PRIORITIZERS, ipbs to ipbs4 or pbs (smallest block first), ilsps (by increment), rblk (entities in good blocks) or rcmp
    (weight over block comparisons). matcher: js, ed, overlap, bf or no. budget: comparisons to execute, None for all."""

    mode: str = "dirty"
    cap: float = blocking.CAP
    rho: float = 0.5
    beta: float = 0.0
    cleaning: str = "wnp2"
    weighting: str = "cbs"
    prioritizer: str = "icps"
    matcher: str = "js"
    threshold: float = 0.1
    increment: int = 100
    budget: int | None = None
    blocker: str = "tbr"

    @property
    def two(self) -> bool:
        if self.mode not in ("dirty", "clean_clean"):
            raise ValueError(f"no mode is called {self.mode}")
        return self.mode == "clean_clean"


def candidates(source: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """Kept postings, and raw pairs by token."""
    posted = postings(source)
    if config.two:
        if config.beta:
            raise ValueError("ghosting (beta) has no clean_clean form in batch; progressive_streaming has one")
        if config.blocker not in ("tb", "tbr"):
            raise ValueError(f"blocker {config.blocker} has no clean_clean form here")
        n1, n2 = (source.where(F.col("ds") == d).count() for d in (0, 1))
        kept = posted if config.blocker == "tb" else blocking.capped_two(posted, config.rho, n1, n2)
        return kept, pairs.clean_clean_pairs(kept)
    kept, alive = blocking.blocked_by(config.blocker)(posted, config.cap, config.beta)
    raw = pairs.dirty_pairs(kept)
    if alive is not None:
        raw = raw.join(alive.select("token", F.col("id").alias("e2")), ["token", "e2"], "left_semi")
    return kept, raw


def cleaned_by(name: str, found: DataFrame) -> DataFrame:
    """Pairs (e1, e2, cbs) that the cleaning of a name leaves."""
    if name.startswith("batch:"):
        out = cleaning.batch_cleaned(found.select("e1", "e2", F.col("cbs").alias("w")), name.removeprefix("batch:"))
        return out.select("e1", "e2", F.col("w").alias("cbs"))
    if name not in cleaning.CLEANERS:
        raise ValueError(f"no cleaning is called {name}")
    return cleaning.CLEANERS[name](found)


def ordered(raw: DataFrame, weighed: DataFrame, config: Config) -> DataFrame:
    """Weighed pairs with rank in the order of the prioritizer."""
    name = config.prioritizer
    if name == "pbs" or name in ("ipbs", "ipbs2", "ipbs3", "ipbs4"):
        inside = raw.join(weighed.select("e1", "e2"), ["e1", "e2"], "left_semi")
        return prioritize.block_order(inside, by_token=name == "pbs").withColumn("w", F.col("cbs").cast("double"))
    if name == "ilsps":
        return prioritize.by_increment(weighed, config.increment)
    if name == "rblk":
        return prioritize.entities_in_good_blocks(raw, weighed)
    if name == "rcmp":
        return prioritize.by_block_cardinality(raw, weighed)
    return prioritize.prioritized_by(name, weighed, config.budget if config.budget is not None and config.budget <= cleaning.TOP else None)


def _scored(found: DataFrame, source: DataFrame, config: Config) -> DataFrame:
    if config.matcher == "no":
        return matching.scored(found, "no")
    sets = token_sets(source, hashed=config.matcher not in ("ed", "bf"))
    return matching.scored(pairs.with_tokens(found, sets, 0, int(config.two)), config.matcher)


def baseline(source: DataFrame, config: Config = Config()) -> DataFrame:
    """Without priorities: block, prune, generate, clean, match: (e1, e2, sim)."""
    _, raw = candidates(source, config)
    cleaned = cleaned_by(config.cleaning, pairs.common_blocks(raw))
    return _scored(cleaned.select("e1", "e2"), source, config).select("e1", "e2", "sim")


def progressive(source: DataFrame, config: Config = Config()) -> DataFrame:
    """With priorities, up to the budget: (rank, e1, e2, w, sim). A small budget is met by a top-k, without sorting all pairs."""
    kept, raw = candidates(source, config)
    cleaned = cleaned_by(config.cleaning, pairs.common_blocks(raw))
    first = ordered(raw, weighting.weighed_by(config.weighting, cleaned, raw, kept, config.two), config)
    if config.budget is not None:
        first = first.where(F.col("rank") <= config.budget)
    return _scored(first.select("rank", "e1", "e2", "w"), source, config).select("rank", "e1", "e2", "w", "sim")


def progressive_streaming(source: DataFrame, config: Config = Config(), policy=None, sizes: tuple[int, int] | None = None, every: str | None = None, **more) -> DataFrame:
    """With priorities, increment by increment: (request, rank, e1, e2, w, sim, increment). After each increment of config.increment
    arrivals the policy's K best of all waiting pairs go out, and the rest after the input. sizes: of the two sources, counted if they
    aren't given. more: bound, seconds, fallback of streaming.progressive.Settings; every: a trigger interval that throttles the input."""
    if config.blocker != "tbr":
        raise ValueError(f"blocker {config.blocker} has no streaming form")
    if config.two and sizes is None:
        sizes = tuple(source.where(F.col("ds") == d).count() for d in (0, 1))
    asked = {f: getattr(config, f) for f in ("prioritizer", "weighting", "cleaning", "cap", "rho", "beta", "budget")}
    released = stream_progressive.run(source, config.increment, stream_progressive.Settings(**asked, sizes=sizes if config.two else None, **more), policy, every)
    if config.matcher != "no":  # only the released ends' tokens are needed
        ends = released.select("e1").union(released.select("e2")).distinct().toDF("id")
        source = source.join(broadcast_if(ends, ends.count(), BROADCAST_IDS), "id", "left_semi").select(source.columns)
    return _scored(released.select("request", "rank", "e1", "e2", "w", "increment"), source, config).select("request", "rank", "e1", "e2", "w", "sim", "increment")


def stream_log(released: DataFrame, truth: DataFrame, total: int, config: Config) -> DataFrame:
    """The collector's log of what a stream released (request, rank, e1, e2, sim and the rest), in the order of its requests."""
    order = ranking.ranked(released.withColumnRenamed("rank", "place").drop("increment"), F.col("request"), F.col("place"))[0]
    return evaluate.metrics_log(order.withColumnRenamed("request", "increment"), truth, total, config.prioritizer, config.weighting)


def streaming(source: DataFrame, config: Config = Config()) -> DataFrame:
    """Increment by increment: (e1, e2, cbs, increment), all pairs of one source's capped blocks. Nothing is cleaned, ordered or
    scored, whatever the defaults of Config; a field that asks for more than increment and cap is an error."""
    plain = Config(increment=config.increment, cap=config.cap)
    asked = [f.name for f in fields(Config) if getattr(config, f.name) != getattr(plain, f.name)]
    if asked:
        raise ValueError(f"streaming has no form of: {', '.join(asked)}")
    return incremental.run(source, config.increment, config.cap)


def evaluated(found: DataFrame, truth: DataFrame) -> DataFrame:
    return evaluate.completeness(found, truth)


def rerun(weighed: DataFrame, bounds: list[int], k: int) -> DataFrame:
    """Batch method run again over growing prefixes: for each bound on the arrival, the k best pairs not executed before;
    (run, rank, e1, e2, w). One pass for each bound."""
    done = None
    for run, bound in enumerate(bounds):
        open_ = weighed.where(F.col("e2") < bound)
        if done is not None:
            open_ = pairs.unseen(open_, done)
        got = prioritize.global_top(open_, k).select(F.lit(run).cast("long").alias("run"), "rank", "e1", "e2", "w")
        done = got if done is None else done.union(got)
    return done
