"""Similarities of pairs with token arrays t1 and t2."""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Bind a costly expression to a lambda variable, so that Catalyst can't copy it into the places that use it."""
    return F.transform(F.array(value), body)[0]


def jaccard() -> Column:
    def share(common: Column) -> Column:
        union = F.size("t1") + F.size("t2") - common
        return F.when(union > 0, common / union).otherwise(0.0)

    return let(F.size(F.array_intersect("t1", "t2")), share)


def may_reach(pairs: DataFrame, kept: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (e1, e2, cbs) of one source whose Jaccard may reach the threshold, by counts alone: tokens that both have but don't
    share as blocks were refused to the later arrival, so there are at most as many as it lost. sizes: (id, n) tokens."""
    counts = sizes.join(kept.groupBy("id").agg(F.count(F.lit(1)).alias("nb")), "id", "left").select("id", "n", (F.col("n") - F.coalesce("nb", F.lit(0))).alias("lost"))
    one = counts.select(F.col("id").alias("e1"), F.col("n").alias("n1"))
    two = counts.select(F.col("id").alias("e2"), F.col("n").alias("n2"), F.col("lost").alias("lost2"))
    most = F.least("n1", "n2", F.col("cbs") + F.col("lost2"))
    reach = most >= (F.col("n1") + F.col("n2") - most) * (threshold - 1e-9)
    return pairs.join(one, "e1").join(two, "e2").where(reach).select("e1", "e2", "cbs")


def overlap() -> Column:
    least = F.least(F.size("t1"), F.size("t2"))
    return F.when(least > 0, F.size(F.array_intersect("t1", "t2")) / least).otherwise(0.0)


def token_edits() -> Column:
    """Levenshtein distance of the sorted token sequences t1 and t2. Tokens that both have stand in the same order on either side,
    so a cheapest alignment is a chain of some of them, with as many edits between two as the longer gap has tokens. Neighbours on
    both sides are always taken together, so the chain is sought among the runs of such neighbours."""
    place = lambda x: F.struct(F.array_position("t1", x).alias("i"), F.array_position("t2", x).alias("j"))
    adjoin = lambda p, q: (p["i"] + 1 == q["i"]) & (p["j"] + 1 == q["j"])
    n, m = F.size("t1").cast("long"), F.size("t2").cast("long")

    def runs(c: Column) -> Column:
        first = F.filter(c, lambda p, k: (k == 0) | ~adjoin(F.get(c, k - 1), p))
        last = F.filter(c, lambda p, k: (k == F.size(c) - 1) | ~adjoin(p, F.get(c, k + 1)))
        return F.arrays_zip(first.alias("first"), last.alias("last"))

    def chained(done: Column, run: Column) -> Column:
        cost = F.array_min(F.transform(done, lambda q: q["d"] + F.greatest(run["first"]["i"] - q["i"], run["first"]["j"] - q["j"]) - 1))
        return F.concat(done, F.array(F.struct(run["last"]["i"].alias("i"), run["last"]["j"].alias("j"), cost.alias("d"))))

    common = F.transform(F.array_intersect("t1", "t2"), place)
    start = F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).cast("long").alias("d")))
    behind = F.struct((n + 1).alias("i"), (m + 1).alias("j"))
    end = F.array(F.struct(behind.alias("first"), behind.alias("last")))
    all_runs = F.transform(F.array(common), runs)[0]
    return F.aggregate(F.concat(all_runs, end), start, chained, lambda done: F.element_at(done, -1)["d"])


def edit_distance() -> Column:
    most = F.greatest(F.size("t1"), F.size("t2"))
    return F.when(most > 0, token_edits() / most).otherwise(0.0)


#: A Bloom filter's bits and hashes unless they are given.
BLOOM_BITS, BLOOM_HASHES = 4096, 4


def optimal_bloom(items: int, rate: float) -> tuple[int, int]:
    """Bits and hashes for so many items at a rate of false positives."""
    bits = max(1, ceil(-items * log(rate) / log(2) ** 2))
    return bits, max(1, ceil(bits / max(items, 1) * log(2)))


def bloom(tokens: Column | str, bits: int = BLOOM_BITS, hashes: int = BLOOM_HASHES) -> Column:
    """The set bits of a filter of string tokens, in order: each token sets (h1 + i * h2) mod bits for i below hashes, h1 and h2 being
    the first and second 32 bits of its MD5."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens

    def part(digest: Column, at: int) -> Column:
        return F.conv(F.substring(digest, at, 8), 16, 10).cast("long")

    def places(digest: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(part(digest, 1) + i * part(digest, 9), F.lit(bits)))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.transform(tokens, lambda t: F.md5(t)), places))))


def might_contain(filter_: Column, token: Column, bits: int = BLOOM_BITS, hashes: int = BLOOM_HASHES) -> Column:
    """False: the token is not in the filter."""
    return F.size(F.array_except(bloom(F.array(token), bits, hashes), filter_)) == 0


def bloom_elements(filter_: Column, bits: int = BLOOM_BITS, hashes: int = BLOOM_HASHES) -> Column:
    """How many tokens a filter holds, as its set bits suggest."""
    return F.round(-F.ln(1 - F.size(filter_) / bits) * bits / hashes).cast("long")


def bloom_containment(b1: Column, b2: Column, n1: Column, n2: Column, bits: int = BLOOM_BITS) -> Column:
    """Common set bits over those of the emptier filter, less a malus where the fuller one is saturated: by how much the tokens of
    its text exceed the bits, over the tokens of the other, 1 at most. n1, n2: tokens of either text."""
    c1, c2 = F.size(b1), F.size(b2)
    swap = c1 < c2
    most, least = F.when(swap, n2).otherwise(n1), F.when(swap, n1).otherwise(n2)
    malus = F.when(F.greatest(c1, c2) > bits - 0.1, F.least(F.lit(1.0), (most - bits + 0.1) / F.greatest(least, F.lit(1)))).otherwise(0.0)
    return F.when(F.least(c1, c2) > 0, F.size(F.array_intersect(b1, b2)) / F.least(c1, c2) - malus).otherwise(0.0)


def identity(pairs: DataFrame) -> DataFrame:
    """No matcher: pairs keep the similarity they came with, else their weight, else 0."""
    if "sim" in pairs.columns:
        return pairs
    return pairs.withColumn("sim", F.col("w").cast("double") if "w" in pairs.columns else F.lit(0.0))


MATCHERS = {
    "js": jaccard,
    "ed": lambda: 1 - edit_distance(),
    "overlap": overlap,
    "bf": lambda: let(F.struct(bloom("t1").alias("a"), bloom("t2").alias("b"), F.size("t1").alias("n"), F.size("t2").alias("m")), lambda x: bloom_containment(x["a"], x["b"], x["n"], x["m"])),
}


def scored(pairs: DataFrame, matcher: str = "js") -> DataFrame:
    """Pairs (with t1, t2) and sim; for `ed` the similarity 1 - distance, so that thresholds select matches; `bf` needs tokens as
    strings; `no` leaves pairs as they are."""
    if matcher == "no":
        return identity(pairs)
    if matcher not in MATCHERS:
        raise ValueError(f"no matcher is called {matcher}")
    return pairs.withColumn("sim", MATCHERS[matcher]())
