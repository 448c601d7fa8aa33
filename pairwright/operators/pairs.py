"""Comparison generation. Blocks are bounded by the cap, so each is gathered as one short array and its pairs are unfolded from
it: one exchange by token and no self-join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.sources.storage import broadcast_if


def dirty_pairs(kept: DataFrame) -> DataFrame:
    """(e1, e2, token, n): e1 arrived before e2."""
    blocks = kept.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("seq", "id"))).alias("members")).where(F.size("members") > 1)
    late = F.posexplode("members").alias("at", "b")
    each = blocks.select("token", "members", late)
    return each.select(F.explode(F.slice("members", 1, F.col("at"))).alias("a"), "b", "token", F.size("members").cast("long").alias("n")).select(F.col("a.id").alias("e1"), F.col("b.id").alias("e2"), "token", "n")


def clean_clean_pairs(kept: DataFrame) -> DataFrame:
    """(e1, e2, token, n1, n2, arriving_ds): e1 of the first source, e2 of the second. Tokens of one source alone go before the join;
    the join may split a token's block."""
    sizes = kept.groupBy("token").agg(F.count_if(F.col("ds") == 0).alias("n1"), F.count_if(F.col("ds") == 1).alias("n2")).where("n1 > 0 AND n2 > 0")
    one = kept.where("ds = 0").select("token", F.col("id").alias("e1"), F.col("seq").alias("s1"))
    two = kept.where("ds = 1").select("token", F.col("id").alias("e2"), F.col("seq").alias("s2"))
    return one.join(two.join(sizes, "token"), "token").select("e1", "e2", "token", "n1", "n2", (F.col("s2") > F.col("s1")).cast("int").alias("arriving_ds"))


def common_blocks(raw: DataFrame) -> DataFrame:
    """(e1, e2, cbs): repeats become a count."""
    return raw.groupBy("e1", "e2").agg(F.count(F.lit(1)).alias("cbs"))


#: Tokens of all sets together up to which the sets are broadcast (8 bytes each when hashed, some 25 as strings).
BROADCAST_TOKENS = 4_000_000


def block_lists(kept: DataFrame) -> DataFrame:
    """(ds, id, tokens): the hashed kept tokens of each entity."""
    return kept.groupBy("ds", "id").agg(F.collect_list(F.xxhash64("token")).alias("tokens"))


def with_tokens(pairs: DataFrame, sets: DataFrame, ds1: int = 0, ds2: int = 0) -> DataFrame:
    """Pairs with both token arrays, t1 and t2, joined late: ids travel alone until here. Sets are broadcast only while their
    counted tokens are few; beyond it the joins shuffle."""
    total = sets.agg(F.sum(F.size("tokens"))).first()[0] or 0
    one = sets.where(F.col("ds") == ds1).select(F.col("id").alias("e1"), F.col("tokens").alias("t1"))
    two = sets.where(F.col("ds") == ds2).select(F.col("id").alias("e2"), F.col("tokens").alias("t2"))
    return pairs.join(broadcast_if(one, total, BROADCAST_TOKENS), "e1").join(broadcast_if(two, total, BROADCAST_TOKENS), "e2")


def unseen(pairs: DataFrame, executed: DataFrame) -> DataFrame:
    """Exact repeat filter."""
    return pairs.join(executed.select("e1", "e2").distinct(), ["e1", "e2"], "left_anti")
