"""Tokens of a profile: the distinct lower-case runs of ASCII letters and digits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One separator at a time, ASCII only, as the JVM reads it.
SEPARATOR = r"[\W_]"


def _words(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATOR), lambda t: F.length(t) > 0)


def tokens(text: Column | str) -> Column:
    return F.array_sort(F.array_distinct(_words(text)))


def hashed_tokens(text: Column | str) -> Column:
    """Distinct tokens as 64-bit hashes, in no order."""
    return F.array_distinct(F.transform(_words(text), lambda t: F.xxhash64(t)))


def token_sets(source: DataFrame, hashed: bool = False, ordered: bool = False) -> DataFrame:
    """(ds, id, seq, tokens); hashed: tokens as 64-bit hashes, which set operations handle faster and which travel lighter; ordered:
    the hashes in the order of their tokens, for what reads sequences."""
    hashes = F.transform(F.sort_array(F.array_distinct(_words("text"))), lambda t: F.xxhash64(t)) if ordered else hashed_tokens("text")
    return source.select("ds", "id", "seq", (hashes if hashed else tokens("text")).alias("tokens"))


def postings(source: DataFrame) -> DataFrame:
    """(token, ds, id, seq)"""
    return source.select(F.explode(F.array_distinct(_words("text"))).alias("token"), "ds", "id", "seq")


def pair_key(e1: Column | str, e2: Column | str) -> Column:
    """Both ids packed into one long; ids up to 2**31."""
    return F.shiftleft(F.col(e1) if isinstance(e1, str) else e1, 32).bitwiseOR((F.col(e2) if isinstance(e2, str) else e2).bitwiseAND(F.lit(0xFFFFFFFF)))


def rounded(x: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, digits)
