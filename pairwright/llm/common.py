"""Helpers shared by the corpus operators: words, text keys and column names that can't clash."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.sources.storage import broadcast_if, cut, drop, shared_dir  # noqa: F401  used by the operators

#: Word separators of every contract in this folder: space, tab, LF, VT, FF, CR.
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: The same as a Java pattern.
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Texts in one Arrow batch, at most: a batch lies in the JVM and in its worker at once, and grows by doubling while it is filled.
TEXTS = 1000


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Inside, what runs hands texts to Python workers at most TEXTS at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if 0 < int(before) <= TEXTS:
        yield
        return
    spark.conf.set(name, str(TEXTS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_key(text: Column | str = "text") -> list[Column]:
    """Two longs, _t1 and _t2, that name a text (128 bits, so that different texts don't meet); null is a text of its own."""
    text = F.col(text) if isinstance(text, str) else text
    null = text.isNull()
    return [F.xxhash64(text, null).alias("_t1"), F.xxhash64(F.lit(1), text, null).alias("_t2")]


def packed(docs: DataFrame, *columns: str) -> DataFrame:
    """docs as one struct column `row`, with copies of the named columns beside it (null where docs has none): whatever names docs
    has, operators may add theirs. `row.*` gives docs back."""
    have = [F.col(f"row.`{c}`").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in columns]
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).select("row", *have)


def words(text: Column) -> Column:
    """Array of the words of a text; empty for a null text or one without words."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def let(value: Column, body) -> Column:
    """Bind a costly expression to a lambda variable, so that Catalyst can't copy it into the places that use it."""
    return F.transform(F.array(value), body)[0]
