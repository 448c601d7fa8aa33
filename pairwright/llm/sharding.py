"""Sharding: a keyed Feistel permutation over global row numbers gives a reproducible shuffle with computable shard and slot.

Rows are numbered 0..N-1 in the order of (doc_id, crc, size); the permutation sends row number r to p, and p gives
shard = p mod K and slot = p div K. So shard counts differ by one at most (law `rows`), slots have no gaps, and any
process can compute where a row lies, or which row lies at a place (`locate`), from N, K and the seed alone.

Defined results: a null text has 0 bytes (size 1) and CRC 0; null doc_ids come first; repeated rows get places of their own,
and which of two identical rows gets which place is immaterial; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, documents
from .scan import U64, mix

SHARDS = 8
SEED = 20240601
ROUNDS = 6


class Permutation:
    """A bijection on 0..n-1: a balanced Feistel network over the next even power of two, walked along its cycles until the
    value falls below n. The domain is under 4n, so a walk takes less than four steps on average."""

    def __init__(self, n: int, seed: int = SEED):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = U64((1 << self.half) - 1)
        self.keys = mix(np.arange(1, ROUNDS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) ^ mix(np.array([seed], dtype=U64)))

    def _once(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> U64(self.half), x & self.mask
        for key in keys:
            if back:
                left, right = right ^ (mix(left ^ key) & self.mask), left
            else:
                left, right = right, left ^ (mix(right ^ key) & self.mask)
        return left << U64(self.half) | right

    def _walk(self, values: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        out = np.asarray(values).astype(U64)
        todo = np.arange(len(out))
        while len(todo):
            out[todo] = self._once(out[todo], keys, back)
            todo = todo[out[todo] >= U64(self.n)]
        return out.astype(np.int64)

    def forward(self, rows: np.ndarray) -> np.ndarray:
        return self._walk(rows, self.keys, False)

    def backward(self, places: np.ndarray) -> np.ndarray:
        return self._walk(places, self.keys[::-1], True)


def locate(shard: int, slot: int, n: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """The global row number at a place."""
    return int(Permutation(n, seed).backward(np.array([slot * shards + shard]))[0])


def number_rows(keys: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """Global row numbers `_row` in the given order, and how many rows there are.

    One range exchange of the narrow rows; they are written once, so that partition counts and rows come from the same
    partitioning. The only thing broadcast is one offset for each partition."""
    placed = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.withColumns({"_part": F.spark_partition_id(), "_local": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    placed = cut(placed, "rows")
    counts = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, starts = 0, []
    for part in sorted(counts):
        starts.append((part, total))
        total += counts[part]
    offsets = keys.sparkSession.createDataFrame(starts, "_part int, _start long")
    return placed.join(F.broadcast(offsets), "_part").withColumn("_row", F.col("_start") + F.col("_local")).drop("_part", "_local", "_start"), total


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    numbered, total = number_rows(keys, ["doc_id", "text_crc32", "size"])
    permutation = Permutation(total, seed)

    @F.pandas_udf(T.LongType())
    def place(rows: pd.Series) -> pd.Series:
        return pd.Series(permutation.forward(rows.to_numpy()))

    at = numbered.withColumn("_place", place("_row"))
    return at.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("_place") % shards).cast("int").alias("shard"),
        F.expr(f"_place div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op1_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))
