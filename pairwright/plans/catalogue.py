"""Queries by name: each takes (spark, folder of tables) and returns a DataFrame.

Unless a query says otherwise its source is `documents`, arrival is by doc_id, blocks take their first CAP - 1 arrivals, weights
w are shared blocks over all blocks of either end, and true pairs are those of token Jaccard TRUE or more or of equal
texts, among all pairs: recall is measured and components are built on these, not on what the blocks kept.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions.text import postings, rounded, token_sets
from pairwright.operators import blocking, cleaning, clustering, evaluate, matching, packed, pairs, prioritize, truth, weighting
from pairwright.plans import pipeline
from pairwright.sources import profiles
from pairwright.sources.storage import cut
from pairwright.streaming import entity_queue, exact, incremental
from pairwright.streaming.policy import Fixed

CAP = blocking.CAP
BETA = 0.05
RATIO = 0.8
RHO = 0.5
TRUE = 0.8
INCREMENT = 100
RUNS = 5
#: Comparisons for each request of a stream, and in all.
REQUEST = 1000
BUDGET = 8000


class Base:
    """The tables that queries share, as lazy plans."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    @cached_property
    def source(self) -> DataFrame:
        return profiles.profiles(profiles.read(self.spark, f"{self.dir}/documents.parquet"), "doc_id", ["text"])

    @cached_property
    def both(self) -> DataFrame:
        second = profiles.profiles(profiles.read(self.spark, f"{self.dir}/benchmark.parquet"), "item_id", ["text"])
        return profiles.interleave(self.source, second)

    @cached_property
    def kept(self) -> DataFrame:
        return blocking.capped(postings(self.source), CAP)

    @cached_property
    def kept_two(self) -> DataFrame:
        n1, n2 = (self.both.where(F.col("ds") == d).count() for d in (0, 1))
        return blocking.capped_two(postings(self.both), RHO, n1, n2)

    @cached_property
    def raw(self) -> DataFrame:
        return pairs.dirty_pairs(self.kept)

    @cached_property
    def cbs(self) -> DataFrame:
        return pairs.common_blocks(self.raw)

    @cached_property
    def js(self) -> DataFrame:
        return weighting.jaccard_of_blocks(self.cbs, self.kept)

    @cached_property
    def by_cbs(self) -> DataFrame:
        return self.cbs.select("e1", "e2", F.col("cbs").alias("w"))

    @cached_property
    def wnp2(self) -> DataFrame:
        return cleaning.above_mean(self.cbs)

    @cached_property
    def blocks(self) -> DataFrame:
        return packed.blocks(self.source, CAP)

    @cached_property
    def wnp2_common(self) -> DataFrame:
        """WNP2 pairs with what both ends have: for similarities and weights without their token arrays."""
        return packed.common_tokens(self.source, self.blocks, CAP, mean=True)

    @cached_property
    def wnp2_packed(self) -> DataFrame:
        return packed.common_blocks(self.blocks, mean=True)

    @cached_property
    def wnp2_js(self) -> DataFrame:
        return weighting.jaccard_of_blocks(self.wnp2, self.kept).select("e1", "e2", "w")

    @cached_property
    def overlaps_two(self) -> DataFrame:
        found = pairs.common_blocks(pairs.clean_clean_pairs(self.kept_two))
        return matching.scored(pairs.with_tokens(found.select("e1", "e2"), token_sets(self.both, hashed=True), 0, 1), "overlap")

    @cached_property
    def sets(self) -> DataFrame:
        """Written once: scoring reads them three times."""
        return cut(token_sets(self.source, hashed=True), "token-sets")

    def scored(self, found: DataFrame, matcher: str = "js") -> DataFrame:
        return matching.scored(pairs.with_tokens(found.select("e1", "e2"), self.sets), matcher)

    @cached_property
    def every(self) -> truth.Truth:
        """The truth over all pairs, also those that no block keeps."""
        documents = profiles.read(self.spark, f"{self.dir}/documents.parquet")
        return truth.Truth(documents.select(F.col("doc_id").cast("long").alias("id"), "text"), TRUE)

    @cached_property
    def truth(self) -> DataFrame:
        """The true pairs among the candidates: all that any order or cleaning of them can find."""
        return cut(self.every.among(self.blocks, CAP), "truth")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[Base], DataFrame]) -> Callable[[Base], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Base(spark, sf_dir))
    return f


@query
def tokenize_documents(b: Base) -> DataFrame:
    return postings(b.source).select("id", "token")


@query
def token_block_sizes(b: Base) -> DataFrame:
    return blocking.block_sizes(postings(b.source))


@query
def block_comparison_count(b: Base) -> DataFrame:
    return blocking.comparisons(postings(b.source))


@query
def block_comparison_count_clean_clean(b: Base) -> DataFrame:
    return blocking.comparisons(postings(b.both), clean_clean=True)


@query
def block_pruning_arrival_order(b: Base) -> DataFrame:
    return b.kept.select("token", "id", F.col("rn").cast("long").alias("rn"))


@query
def block_pruning_clean_clean(b: Base) -> DataFrame:
    return b.kept_two.select("token", F.col("ds").cast("long").alias("ds"), "id")


@query
def block_ghosting(b: Base) -> DataFrame:
    return blocking.ghosted(b.kept, BETA).select("id", "token", F.col("c").cast("long").alias("c"))


@query
def block_filtering(b: Base) -> DataFrame:
    return blocking.filtered(b.kept, RATIO).select("id", "token", "n")


@query
def size_based_purging(b: Base) -> DataFrame:
    return blocking.purged(postings(b.source), CAP)


@query
def raw_comparisons_dirty(b: Base) -> DataFrame:
    return b.raw.groupBy(profiles.increment(INCREMENT, "e2").alias("increment")).agg(F.count(F.lit(1)).alias("comparisons"))


@query
def raw_comparisons_clean_clean(b: Base) -> DataFrame:
    return pairs.clean_clean_pairs(b.kept_two).groupBy("e2").agg(F.count(F.lit(1)).alias("comparisons"))


@query
def cbs_pairs(b: Base) -> DataFrame:
    return b.cbs


@query
def wnp(b: Base) -> DataFrame:
    return cleaning.above_mean(b.cbs, strict=True)


@query
def wnp2(b: Base) -> DataFrame:
    return b.wnp2


@query
def cnp(b: Base) -> DataFrame:
    return cleaning.cardinality(b.cbs)


def _w(df: DataFrame) -> DataFrame:
    return df.select("e1", "e2", rounded("w").alias("w"))


@query
def js_weight(b: Base) -> DataFrame:
    return _w(b.js)


@query
def bjs_weight(b: Base) -> DataFrame:
    return _w(weighting.jaccard_of_blocks(b.wnp2, b.kept, scale=100.0))


@query
def normalized_cbs(b: Base) -> DataFrame:
    return _w(weighting.normalized(b.raw))


@query
def cbs_max(b: Base) -> DataFrame:
    return _w(weighting.over_running_max(b.cbs))


@query
def arcs_weight(b: Base) -> DataFrame:
    return _w(weighting.arcs(b.raw))


@query
def wep(b: Base) -> DataFrame:
    return cleaning.edge_pruned(b.by_cbs)


@query
def cep(b: Base) -> DataFrame:
    half = blocking.block_sizes(b.kept).agg(F.sum("n")).first()[0] or 0
    return cleaning.edge_topped(b.by_cbs, half // 2)


@query
def reciprocal_wnp(b: Base) -> DataFrame:
    return cleaning.node_pruned(b.by_cbs, both=True)


@query
def reciprocal_cnp(b: Base) -> DataFrame:
    total = blocking.block_sizes(b.kept).agg(F.sum("n")).first()[0] or 0
    return cleaning.node_topped(b.by_cbs, max(1, total // max(1, b.source.count())), both=True)


@query
def jaccard_match(b: Base) -> DataFrame:
    return b.wnp2_common.select("e1", "e2", rounded(packed.jaccard()).alias("sim"))


@query
def overlap_match(b: Base) -> DataFrame:
    return b.wnp2_common.select("e1", "e2", rounded(packed.overlap()).alias("sim"))


@query
def edit_distance_match(b: Base) -> DataFrame:
    scored = packed.edit_distances(b.source, b.blocks, CAP, mean=True).select("e1", "e2", packed.edit_distance().alias("d"))
    return scored.select("e1", "e2", rounded("d").alias("ed_distance"), F.round(1 - F.col("d"), 6).alias("ed_similarity"))


@query
def ipcs_topk(b: Base) -> DataFrame:
    return prioritize.global_top(b.js, 1000).select("rank", "e1", "e2", rounded("w").alias("w"))


@query
def ipbs_order(b: Base) -> DataFrame:
    return prioritize.block_order(b.raw).select("rank", "e1", "e2", "bp", "cbs")


@query
def ipes_rounds(b: Base) -> DataFrame:
    return prioritize.rounds(b.js).select("rank", "e1", "e2", "round", F.col("tier").cast("long").alias("tier"), rounded("w").alias("w"))


@query
def iapcs_tiers(b: Base) -> DataFrame:
    return prioritize.tiers(b.js).select("rank", "tier", "e1", "e2", rounded("w").alias("w"))


@query
def local_sort_by_increment(b: Base) -> DataFrame:
    return prioritize.by_increment(b.js, INCREMENT).select("increment", "rank", "e1", "e2", rounded("w").alias("w"))


@query
def pgtc(b: Base) -> DataFrame:
    return prioritize.global_top(b.by_cbs, 5000)


@query
def pltc(b: Base) -> DataFrame:
    return prioritize.local_top(b.by_cbs, 5)


@query
def pbs(b: Base) -> DataFrame:
    return prioritize.block_order(b.raw, by_token=True).select("rank", "e1", "e2", "bp", "token", "cbs")


@query
def pes(b: Base) -> DataFrame:
    return prioritize.entity_order(b.by_cbs, 10).select("rank", F.col("stage").cast("long").alias("stage"), "entity", "e1", "e2", "w")


@query
def cep_cnp_union(b: Base) -> DataFrame:
    total = blocking.block_sizes(b.kept).agg(F.sum("n")).first()[0] or 0
    return prioritize.local_top(b.by_cbs, 10 * max(1, total // max(1, b.source.count())))


@query
def entity_weight_arcs(b: Base) -> DataFrame:
    return prioritize.entity_weights(b.kept).select("id", rounded("w").alias("w"))


@query
def entity_rank(b: Base) -> DataFrame:
    return prioritize.entity_ranks(b.by_cbs).select("id", rounded("mean_w").alias("mean_w"), "max_w")


@query
def block_rank(b: Base) -> DataFrame:
    return prioritize.block_ranks(b.raw, b.by_cbs).select("token", rounded("mean_w").alias("mean_w"), "good")


@query
def bucket_queue_order(b: Base) -> DataFrame:
    return prioritize.buckets(b.js).select("bucket", "e1", "e2", rounded("w").alias("w"))


@query
def connected_components(b: Base) -> DataFrame:
    return clustering.components(b.every.edges())


@query
def unique_mapping(b: Base) -> DataFrame:
    return clustering.unique_mapping(b.overlaps_two, 0.1).select("e1", "e2", rounded("sim").alias("sim"))


@query
def pc_pq_metrics(b: Base) -> DataFrame:
    return evaluate.completeness(b.wnp2_packed.select("e1", "e2"), b.truth, b.every.count())


@query
def progressive_recall_curve(b: Base) -> DataFrame:
    weighed = packed.common_tokens(b.source, b.blocks, CAP, tokens=False).select("e1", "e2", packed.weight().alias("w"))
    return evaluate.recall_curve_of(weighed, b.truth, b.every.count())


@query
def recall_precision_at_threshold(b: Base) -> DataFrame:
    return evaluate.at_threshold(b.wnp2_common.select("e1", "e2", packed.jaccard().alias("sim")), b.truth, 0.5, b.every.count())


@query
def mean_comparison_size(b: Base) -> DataFrame:
    return evaluate.mean_size(b.scored(b.wnp2)).select(rounded("mean_size").alias("mean_size"))


@query
def stream_incremental_cbs(b: Base) -> DataFrame:
    return incremental.run(b.source, _streamed(b), CAP).select("e1", "e2", "cbs")


def _streamed(b: Base) -> int:
    """Arrivals in an increment when the source streams in RUNS of them."""
    return max(1, -(-b.source.count() // RUNS))


@query
def stream_incremental_metrics(b: Base) -> DataFrame:
    return incremental.measured(b.source, _streamed(b), CAP, b.truth)


@query
def exact_ghosting_fold(b: Base) -> DataFrame:
    return exact.counted(token_sets(b.source, hashed=True), CAP, BETA)


@query
def clean_clean_end_to_end(b: Base) -> DataFrame:
    found = pipeline.baseline(b.both, pipeline.Config(mode="clean_clean", rho=RHO))
    return found.select("e1", "e2", rounded("sim").alias("sim"))


@query
def incremental_rerun_baseline(b: Base) -> DataFrame:
    size = _streamed(b)
    return pipeline.rerun(b.by_cbs, [size * (i + 1) for i in range(RUNS)], 1000)


@query
def fallback_block_walk(b: Base) -> DataFrame:
    return prioritize.leftovers(b.raw, b.wnp2).select("e1", "e2", "bp", "cbs")


# ---- ground truth over all pairs, and what is measured by it


@query
def ground_truth_classes(b: Base) -> DataFrame:
    """Documents of equal token sets (without tokens: of equal texts) under the least id of each."""
    return b.every.members.select("id", F.col("class").alias("cluster"))


@query
def ground_truth_links(b: Base) -> DataFrame:
    """The true pairs between these classes; pairs inside of them aren't made."""
    return b.every.near.select(F.col("a").alias("e1"), F.col("b").alias("e2"))


@query
def ground_truth_clusters(b: Base) -> DataFrame:
    return clustering.truth_clusters(b.every.edges())


@query
def completeness_of_all_truth(b: Base) -> DataFrame:
    return evaluate.completeness(b.wnp2_packed.select("e1", "e2"), b.truth, b.every.count())


@query
def metrics_log(b: Base) -> DataFrame:
    """The collector's log of I-PCS over WNP2 pairs, JS weights and Jaccard."""
    scored = b.wnp2_common.select("e1", "e2", packed.weight().alias("w"), packed.jaccard().alias("sim"), (F.col("n1") + F.col("n2")).alias("n_tokens"))
    found = prioritize.ranked(scored, *prioritize.best())[0].withColumn("increment", profiles.increment(INCREMENT, "e2"))
    return evaluate.metrics_log(found, b.truth, b.every.count(), "icps", "js")


@query
def match_event_log(b: Base) -> DataFrame:
    weighed = packed.common_tokens(b.source, b.blocks, CAP, mean=True, tokens=False).select("e1", "e2", packed.weight().alias("w"))
    return evaluate.event_log(evaluate.recall_curve_of(weighed, b.truth, b.every.count()), "icps")


# ---- blocking: limits relative to the source, none, lookups


@query
def block_pruning_rho(b: Base) -> DataFrame:
    """The limit as a share of the source: BETA times its profiles."""
    kept = blocking.capped(postings(b.source), BETA * b.source.count())
    return kept.select("token", "id", F.col("rn").cast("long").alias("rn"))


@query
def raw_comparisons_uncapped(b: Base) -> DataFrame:
    return blocking.uncapped_comparisons(postings(b.source), INCREMENT)


@query
def block_probe_classes(b: Base) -> DataFrame:
    return blocking.probed(postings(b.source), CAP).groupBy("id", "found").agg(F.count(F.lit(1)).alias("n"))


@query
def block_lookup(b: Base) -> DataFrame:
    """The blocks of the tokens of the benchmark among the documents."""
    other = profiles.profiles(profiles.read(b.spark, f"{b.dir}/benchmark.parquet"), "item_id", ["text"])
    return blocking.blocks_of(b.kept, postings(other)).select("token", "id")


@query
def associated_entities(b: Base) -> DataFrame:
    """Who shares kept tokens of four letters or more with the documents, and how many."""
    found = blocking.associated(b.kept, b.source, F.length("token") >= 4)
    return found.groupBy("id", "other").agg(F.count(F.lit(1)).alias("n"))


# ---- weights and cleaning


@query
def wnp2_dropped(b: Base) -> DataFrame:
    return cleaning.below_mean(b.cbs)


@query
def approximate_cbs(b: Base) -> DataFrame:
    return weighting.approximate_common(b.wnp2, b.kept)


@query
def js_by_arrival_clean_clean(b: Base) -> DataFrame:
    """Two sources: WNP2 by the end that arrived last, then JS."""
    found = weighting.arriving_common(pairs.clean_clean_pairs(b.kept_two))
    kept = cleaning.above_mean(found, by=("node_ds", "node"))
    return _w(weighting.jaccard_of_blocks(kept, b.kept_two, 0, 1))


# ---- priorities


@query
def pps_stage(b: Base) -> DataFrame:
    return prioritize.immediate_and_later(b.by_cbs, 3, 5).select("rank", F.col("stage").cast("long").alias("stage"), "e1", "e2", "w")


@query
def bounded_tiers(b: Base) -> DataFrame:
    return prioritize.bounded_tiers(b.js, 2000).select("rank", "tier", "e1", "e2", rounded("w").alias("w"))


@query
def bucket_queue_bounded(b: Base) -> DataFrame:
    return prioritize.buckets(b.js, 10, 2000).select("bucket", "e1", "e2", rounded("w").alias("w"))


@query
def bucket_queue_halved(b: Base) -> DataFrame:
    return prioritize.sub_buckets(b.js, 10, 500).select("bucket", "depth", "e1", "e2", rounded("w").alias("w"))


@query
def arrival_order(b: Base) -> DataFrame:
    return prioritize.prioritized_by("no", b.by_cbs).select("rank", "e1", "e2", "w")


@query
def similarity_queue(b: Base) -> DataFrame:
    found = b.wnp2_common.select("e1", "e2", F.round(packed.overlap(), 9).alias("w"))
    return prioritize.prioritized_by("bf", found, 1000).select("rank", "e1", "e2", rounded("w").alias("w"))


@query
def entities_in_good_blocks(b: Base) -> DataFrame:
    return prioritize.entities_in_good_blocks(b.raw, b.by_cbs).select("rank", "entity", "e1", "e2", "w")


@query
def block_cardinality_order(b: Base) -> DataFrame:
    return prioritize.by_block_cardinality(b.raw, b.by_cbs).select("rank", "e1", "e2", rounded("w").alias("w"))


@query
def ipes_sequential(b: Base) -> DataFrame:
    """The sequential fold of I-PES, in requests of REQUEST behind every INCREMENT arrivals."""
    weighed = packed.common_tokens(b.source, b.blocks, CAP, mean=True, tokens=False).select("e1", "e2", packed.weight().alias("w"))
    return entity_queue.folded(weighed, INCREMENT, REQUEST)


# ---- matching and clustering


@query
def bloom_match(b: Base) -> DataFrame:
    found = matching.scored(pairs.with_tokens(prioritize.global_top(b.js, REQUEST).select("e1", "e2"), token_sets(b.source)), "bf")
    return found.select("e1", "e2", rounded("sim").alias("sim"))


@query
def clean_clean_components(b: Base) -> DataFrame:
    return clustering.components_two(b.overlaps_two, 0.5).select(F.col("ds").cast("long").alias("ds"), "id", "cluster")


# ---- progressive streams: RUNS increments, REQUEST pairs behind each, then on; BUDGET // REQUEST requests in all, full or not


def _stream(b: Base, source: DataFrame, size: int, **config) -> DataFrame:
    found = pipeline.progressive_streaming(source, pipeline.Config(increment=size, budget=BUDGET, matcher="no", **config), Fixed(REQUEST))
    return _asked(found).select("request", "rank", "e1", "e2", rounded("w").alias("w"))


def _asked(released: DataFrame) -> DataFrame:
    """Where an increment has fewer pairs than REQUEST, the stream goes on until its budget is spent, which is a request more."""
    return released.where(F.col("request") < BUDGET // REQUEST)


@query
def stream_ipcs(b: Base) -> DataFrame:
    return _stream(b, b.source, _streamed(b), weighting="js")


@query
def stream_ipes(b: Base) -> DataFrame:
    return _stream(b, b.source, _streamed(b), weighting="bjs", prioritizer="ieps")


@query
def stream_ipbs(b: Base) -> DataFrame:
    return _stream(b, b.source, _streamed(b), prioritizer="ipbs")


@query
def stream_local_sort(b: Base) -> DataFrame:
    return _stream(b, b.source, _streamed(b), prioritizer="ilsps")


@query
def stream_ghosted(b: Base) -> DataFrame:
    return _stream(b, b.source, _streamed(b), cleaning="hs", beta=BETA)


@query
def stream_clean_clean(b: Base) -> DataFrame:
    return _stream(b, b.both, 2 * _streamed(b), mode="clean_clean", rho=RHO)


@query
def stream_metrics_log(b: Base) -> DataFrame:
    """The log of stream_ipcs, scored by Jaccard; increment is the request."""
    config = pipeline.Config(increment=_streamed(b), budget=BUDGET, weighting="js")
    found = pipeline.progressive_streaming(b.source, config, Fixed(REQUEST))
    return pipeline.stream_log(_asked(found), b.truth, b.every.count(), config)
