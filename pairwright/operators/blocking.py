"""Token blocking: the inverted index as a table of postings, and the rules that keep its blocks small.

`capped` is the rule everything else builds on: a token takes its first cap - 1 arrivals and no more. Spark keeps at most so
many rows of a token before the shuffle (a window group limit), so the commonest token costs no more than any other.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.functions.text import postings
from pairwright.sources.storage import broadcast_if, cut

from .ranking import ranked

CAP = 50
#: Tokens broadcast at most (about 30 bytes each).
BROADCAST_TOKENS = 500_000


def block_sizes(posted: DataFrame) -> DataFrame:
    """(token, n) of blocks with two entities or more."""
    return posted.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def side_sizes(posted: DataFrame) -> DataFrame:
    """(token, n1, n2) of tokens on both sides of two sources."""
    sides = posted.groupBy("token").agg(F.count_if(F.col("ds") == 0).alias("n1"), F.count_if(F.col("ds") == 1).alias("n2"))
    return sides.where("n1 > 0 AND n2 > 0")


def comparisons(posted: DataFrame, clean_clean: bool = False) -> DataFrame:
    """One row: blocks, and the comparisons they ask for."""
    sizes = side_sizes(posted) if clean_clean else block_sizes(posted)
    pairs = F.col("n1") * F.col("n2") if clean_clean else F.expr("n * (n - 1) div 2")
    return sizes.agg(F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum(pairs), F.lit(0)).alias("comparisons"))


def capped(posted: DataFrame, cap: float = CAP) -> DataFrame:
    """Arrival-order pruning of one source: (token, ds, id, seq, rn); a block refuses what would make it reach the cap."""
    rn = F.row_number().over(Window.partitionBy("token").orderBy("seq", "id"))
    return posted.withColumn("rn", rn).where((F.col("rn") == 1) | (F.col("rn") < cap))


def capped_two(posted: DataFrame, rho: float, n1: int, n2: int) -> DataFrame:
    """Arrival-order pruning of two sources: a token is banned from the first arrival that finds rho times the size of its own
    source, less one, on the opposite side; postings before that stay. (token, ds, id, seq).

    Only a token with so many postings on a side can be banned at all; its postings alone are ranked, over range partitions, to
    find the arrival that fills each side. All other tokens are left as they are, so no task holds a token's block."""
    full = {0: max(1, ceil(rho * n2 - 1e-9) - 1), 1: max(1, ceil(rho * n1 - 1e-9) - 1)}  # of ds, what bans the next arrival of the other
    sides = posted.groupBy("token").agg(F.count_if(F.col("ds") == 0).alias("n1"), F.count_if(F.col("ds") == 1).alias("n2"))
    heavy = cut(sides.where((F.col("n1") >= full[0]) & (F.col("n2") > 0) | (F.col("n2") >= full[1]) & (F.col("n1") > 0)).select("token"), "heavy")
    n = heavy.count()
    if not n:
        return posted.select("token", "ds", "id", "seq")
    rows = ranked(posted.join(broadcast_if(heavy, n, BROADCAST_TOKENS), "token", "left_semi"), F.col("token"), F.col("ds"), F.col("seq"))[0]
    starts = rows.groupBy("token", "ds").agg(F.min("rank").alias("start"))
    filled = F.col("rank") - F.col("start") + 1 == F.when(F.col("ds") == 0, full[0]).otherwise(full[1])
    at = rows.join(starts, ["token", "ds"]).where(filled).select("token", (1 - F.col("ds")).alias("ds"), F.col("seq").alias("after"))
    bans = cut(rows.join(at, ["token", "ds"]).where("seq > after").groupBy("token").agg(F.min("seq").alias("ban")), "bans")
    banned = posted.join(broadcast_if(bans, n, BROADCAST_TOKENS), "token", "left").where("ban IS NULL OR seq < ban")
    return banned.select("token", "ds", "id", "seq")


def probed(posted: DataFrame, cap: float = CAP) -> DataFrame:
    """What each arrival finds at its tokens: empty, admissible or oversize; oversize includes all arrivals behind a refused one."""
    rn = F.row_number().over(Window.partitionBy("token").orderBy("seq", "id"))
    kind = F.when(rn == 1, "empty").when(rn < cap, "admissible").otherwise("oversize")
    return posted.withColumn("found", kind)


def uncapped_comparisons(posted: DataFrame, size: int) -> DataFrame:
    """(increment, comparisons) of plain token blocking, by counting: an arrival is compared with all earlier ones of its blocks. No
    pair is made, and windows run over increments of a token, not over its block."""
    counts = posted.groupBy("token", F.floor(F.col("seq") / size).alias("increment")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("token").orderBy("increment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    made = F.col("n") * before + F.expr("n * (n - 1) div 2")
    return counts.withColumn("made", made).groupBy("increment").agg(F.sum("made").alias("comparisons")).where("comparisons > 0")


def blocks_of(kept: DataFrame, tokens: DataFrame) -> DataFrame:
    """The postings of the tokens in a table (token)."""
    return kept.join(tokens.select("token").distinct(), "token", "left_semi")


def associated(kept: DataFrame, ids: DataFrame, predicate: Column | None = None) -> DataFrame:
    """(id, token, other): who shares a block with the entities (ds, id) of a table, in tokens that meet the predicate."""
    chosen = kept if predicate is None else kept.where(predicate)
    mine = chosen.join(ids.select("ds", "id").distinct(), ["ds", "id"], "left_semi").select("token", "id")
    return mine.join(chosen.select("token", F.col("id").alias("other")), "token").where("id != other").select("id", "token", "other")


def models_of(sets: DataFrame, kept: DataFrame, tokens: DataFrame) -> DataFrame:
    """The token sets of all entities that the tokens of a table reach."""
    return sets.join(blocks_of(kept, tokens).select("ds", "id").distinct(), ["ds", "id"], "left_semi")


def ghosted(kept: DataFrame, beta: float) -> DataFrame:
    """Block ghosting, relational form: an arriving entity keeps the blocks under 1/beta times its smallest; (id, token, c) with
    c the earlier arrivals of the block."""
    met = kept.withColumn("c", F.col("rn") - 1).where("c >= 1") if "rn" in kept.columns else kept.where("c >= 1")
    least = F.min(F.col("c") + 1).over(Window.partitionBy("ds", "id"))
    return met.withColumn("least", least).where((F.col("c") + 1) * beta < F.col("least")).drop("least")


def with_sizes(kept: DataFrame) -> DataFrame:
    """Postings with n, the size of their block. Blocks are bounded by the cap, so this window is too."""
    return kept.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("token")))


def filtered(kept: DataFrame, ratio: float) -> DataFrame:
    """Block filtering: each entity stays in its ceil(ratio * k) smallest blocks."""
    by = Window.partitionBy("ds", "id")
    sized = with_sizes(kept).where("n > 1").withColumn("k", F.count(F.lit(1)).over(by))
    return sized.withColumn("at", F.row_number().over(by.orderBy("n", "token"))).where(F.col("at") <= F.ceil(F.col("k") * ratio)).drop("k", "at")


def purged(posted: DataFrame, most: Column | float) -> DataFrame:
    """Size-based purging: (token, n, block_pairs) of the blocks of most entities or fewer."""
    return block_sizes(posted).where(F.col("n") <= most).withColumn("block_pairs", F.expr("n * (n - 1) div 2"))


def without(posted: DataFrame, banned: DataFrame) -> DataFrame:
    """Postings but those of banned tokens."""
    return posted.join(banned.select("token"), "token", "left_anti")


def blocked_by(name: str):
    """The blocker of a name, from (postings, cap, beta) to (kept, alive): kept postings, and those (token, id) in which an arrival is
    compared. tb: no limit; tbr: capped, with ghosting where beta is given; etbr: capped, always ghosted."""
    if name not in ("tb", "tbr", "etbr"):
        raise ValueError(f"no blocker is called {name}")

    def block(posted: DataFrame, cap: float, beta: float) -> tuple[DataFrame, DataFrame | None]:
        kept = capped(posted, float("inf") if name == "tb" else cap)
        if name == "etbr" or (name == "tbr" and beta):
            return kept, ghosted(kept, beta).select("token", "id")
        return kept, None

    return block


def token_blocks(source: DataFrame, cap: float = CAP) -> DataFrame:
    """The kept postings of a source in one step."""
    return capped(postings(source), cap)
