"""WARC records and a Merkle fixity audit of replicas.

Records of a file are ordered by offset. Each record is a leaf (the SHA-256 of its bytes); a node hashes the offset range and
the hashes of up to FAN children in order, up to one root for each file. Two replicas are compared at the roots, and only the
children of nodes that differ are compared further, so an audit of sound replicas moves one row for each file, and damage is
located in as many small joins as the tree has levels. A lost or added record shifts all behind it; so the leaves of the ranges
that differ are then matched by record and digest, and those that merely moved are not reported.

Defined results: null url or html is empty; repeated rows are records of their own; a record of one replica whose bytes the other
has nowhere in that range is `changed` if the other has one of the same record_id and uri left, else `missing` or `extra`; seq,
offset and length are those of the first replica, of the second for `extra`; extra columns are ignored; an empty table gives no
rows. Files written with `write_warc` hold plain WARC/1.1 records. `read_warc` raises an error at a damaged header, a missing
length or a cut record; it holds one file in a worker (2 GB at most), and offsets are those of the decompressed bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop

FAN = 16
#: Records in a file on average.
FILE_RECORDS = 1000
#: In the drill of op9, one record in so many has a byte changed in the second replica.
DRILL = 97


def records(pages: DataFrame, files: int | None = None) -> DataFrame:
    """file, record_id, uri, record (bytes): pages as WARC records, dealt to files by hash."""
    html, uri = F.coalesce("html", F.lit("")), F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]", "")
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), uri, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    count = files if files is not None else max(1, pages.count() // FILE_RECORDS)
    dealt = F.pmod(F.xxhash64("page_id", uri, html), F.lit(count)).cast("int")
    return pages.select(F.col("page_id").alias("record_id"), uri.alias("uri"), F.concat(head, html, F.lit("\r\n\r\n")).cast("binary").alias("record"), dealt.alias("file"))


def leaves(made: DataFrame) -> DataFrame:
    """file, seq, offset, length, hash, record_id, uri from records (file, record_id, uri, record); only digests are shuffled."""
    hashed = made.select("file", "record_id", "uri", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("hash"))
    by = Window.partitionBy("file").orderBy("record_id", "uri", "length", "hash")
    return hashed.withColumns({"seq": F.row_number().over(by).cast("long") - 1, "offset": F.sum("length").over(by) - F.col("length")})


def _parents(nodes: DataFrame) -> DataFrame:
    """The nodes one level up: (file, idx, start, end, hash)."""
    kids = F.array_sort(F.collect_list(F.struct("idx", "start", "end", "hash")))
    up = nodes.groupBy("file", F.expr(f"idx div {FAN}").alias("up")).agg(kids.alias("kids"))
    text = F.array_join(F.transform("kids", lambda k: F.concat_ws(":", k["start"], k["end"], k["hash"])), ";")
    return up.select("file", F.col("up").alias("idx"), F.col("kids")[0]["start"].alias("start"), F.element_at("kids", -1)["end"].alias("end"), F.sha2(text.cast("binary"), 256).alias("hash"))


def tree(leaf: DataFrame) -> list[DataFrame]:
    """Levels from the leaves (file, idx, start, end, hash) to the roots."""
    levels = [leaf.select("file", F.col("seq").alias("idx"), F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("end"), "hash")]
    last = levels[0].agg(F.max("idx")).first()[0] or 0
    while last > 0:
        levels.append(cut(_parents(levels[-1]), "nodes"))
        last //= FAN
    return levels


def _differ(a: DataFrame, b: DataFrame) -> DataFrame:
    left, right = (x.select("file", "idx", F.struct("start", "end", "hash").alias(n)) for x, n in ((a, "a"), (b, "b")))
    return left.join(right, ["file", "idx"], "full").where(~F.col("a").eqNullSafe(F.col("b")))


def _unmatched(a: DataFrame, b: DataFrame, *by: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """a and b matched one to one by (file, *by), the nth with the nth: (both), (a only), (b only)."""
    nth = F.row_number().over(Window.partitionBy("file", *by).orderBy("seq"))
    key = ["file", *by]
    left, right = (x.withColumn("nth", nth).withColumn(n, F.struct("record_id", "uri", "seq", "offset", "length", "hash")) for x, n in ((a, "a"), (b, "b")))
    same = F.col("l.nth") == F.col("r.nth")
    for c in key:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    met = left.alias("l").join(right.alias("r"), same, "full").select(F.coalesce("l.file", "r.file").alias("file"), "a", "b")
    return met.where("a IS NOT NULL AND b IS NOT NULL"), met.where("b IS NULL").select("file", "a.*"), met.where("a IS NULL").select("file", "b.*")


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """The records (of `leaves`) that differ: file, seq, offset, length, record_id, uri, hash_a, hash_b, status."""
    one, two = tree(a), tree(b)
    levels = max(len(one), len(two))
    while len(one) < levels:
        one.append(_parents(one[-1]))
    while len(two) < levels:
        two.append(_parents(two[-1]))
    bad = _differ(one[-1], two[-1])
    for level in range(levels - 2, -1, -1):
        front = cut(bad.select("file", F.col("idx").alias("up")).distinct(), "front")
        inside = [x[level].withColumn("up", F.expr(f"idx div {FAN}")).join(front, ["file", "up"], "left_semi") for x in (one, two)]
        bad = _differ(*inside)
    at = cut(bad.select("file", F.col("idx").alias("seq")), "differing")
    drop(*one[1:], *two[1:])
    mine, other = (x.join(at, ["file", "seq"], "left_semi").select("file", "seq", "offset", "length", "record_id", "uri", "hash") for x in (a, b))
    _, lost, found = _unmatched(mine, other, "record_id", "uri", "hash")
    changed, lost, found = _unmatched(cut(lost, "unmatched"), cut(found, "unmatched"), "record_id", "uri")
    none = F.lit(None).cast("string")
    place = [F.col("file"), *(F.col(c) for c in ("seq", "offset", "length", "record_id", "uri"))]

    def rows(x: DataFrame, hash_a: Column, hash_b: Column, status: str) -> DataFrame:
        return x.select(*place, hash_a.alias("hash_a"), hash_b.alias("hash_b"), F.lit(status).alias("status"))

    pairs = changed.select("file", "a.*", F.col("b.hash").alias("hash_b"))
    return rows(pairs, F.col("hash"), F.col("hash_b"), "changed").union(rows(lost, F.col("hash"), none, "missing")).union(rows(found, none, F.col("hash"), "extra"))


def damaged(record: Column, seed: Column) -> Column:
    """The bytes with one byte of the middle replaced by another."""
    middle = F.expr("cast(octet_length(record) div 2 as int)")
    old = F.substring("record", middle, 1)
    new = F.when(F.hex(old) == "58", F.unhex(F.lit("59"))).otherwise(F.unhex(F.lit("58")))
    return F.when(seed % DRILL == 0, F.concat(F.substring(record, 1, middle - 1), new, F.expr("substring(record, cast(octet_length(record) div 2 as int) + 1)"))).otherwise(record)


def write_warc(made: DataFrame, path: str, compression: str = "none") -> None:
    """One WARC file for each task, records in order; the record's closing blank lines are the writer's line separator."""
    text = made.withColumn("value", F.expr("substring(record, 1, octet_length(record) - 4)").cast("string"))
    ordered = text.repartition("file").sortWithinPartitions("file", "record_id", "uri")
    ordered.select("value").write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """file (path), offset, length, uri, payload, record of every record of the WARC files (plain or gzip) under a path that Spark reads."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import gzip
        import re

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                rows, at = [], 0
                while at < len(data):
                    split = data.find(b"\r\n\r\n", at)
                    head = data[at : max(split, at)].decode("utf-8", "replace")
                    size = re.search(r"(?im)^content-length:\s*(\d+)", head)
                    if not head.startswith("WARC/") or not size:
                        raise ValueError(f"{name}: no record header with a length at byte {at}")
                    end = split + 4 + int(size[1])
                    if end + 4 > len(data):
                        raise ValueError(f"{name}: the record at byte {at} is cut off")
                    uri = re.search(r"(?im)^warc-target-uri:\s*(.*?)\s*$", head)
                    rows.append((name, at, end + 4 - at, uri[1] if uri else None, data[split + 4 : end], data[at : end + 4]))
                    at = end + 4
                yield pd.DataFrame(rows, columns=["file", "offset", "length", "uri", "payload", "record"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "file string, offset long, length long, uri string, payload binary, record binary")


def op9_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of pages with the audit's verdict: two replicas are laid out, the second after a drill that damages one
    record in DRILL, chosen by the hash of page_id."""
    made = records(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    first = cut(leaves(made), "leaves")
    hurt = made.withColumn("record", damaged(F.col("record"), F.xxhash64("record_id")))
    second = cut(leaves(hurt), "leaves")
    found = cut(audit(first, second), "audit").select("file", "seq", "hash_b", "status")
    out = first.join(found.where("status != 'extra'"), ["file", "seq"], "left")
    return out.select(F.col("record_id").alias("page_id"), "file", "seq", "offset", "length", F.col("hash").alias("sha256"), F.coalesce("status", F.lit("ok")).alias("status"), F.when(F.col("status").isNull(), F.col("hash")).otherwise(F.col("hash_b")).alias("replica_sha256"))

