"""MinHash near-duplicates: bottom-k sketches from one hash function.

1. One Arrow pass hashes the words and 5-word shingles of each whole text; a row keeps the size of its shingle set, its SKETCH
   least shingle hashes and a 128-bit digest of its word sequence. Equal sequences are one class from here on, so thousands of
   copies cost one row.
2. The PUBLISH least values of a class go to inverted lists. Texts over the threshold share at least `_shared` of them (six
   standard deviations below what is expected), so two such classes have a value in common among the rarest of each, as many as
   leave `_shared` - 1 others (prefix filtering, Chaudhuri et al. 2006), rarest meaning least list. Only these are looked at: what a
   text has of its own comes first, passages that many texts share come last and are seldom reached.
   A list of up to LIST classes yields its pairs. A longer one never does: each member meets one leader of the list. Classes with
   `_shared` values or more in long lists are crowded: only a pair of two such classes may have none but long lists in common.
   Crowded classes also publish a prefix of their full shingle set, rarest shingle first, as long as the threshold asks for, so
   linked sets always share a shingle of it. Its lists are treated like the others, with the positional bound on what two sets
   can still share.
3. The overlap of the union sketch estimates the Jaccard similarity; pairs more than six standard deviations below the
   threshold go.
4. Exact Jaccard on full sets of shingle hashes decides. First one pair per class, then those whose classes are still apart; pairs
   inside one component can't change the result and are not looked at.
5. What long prefix lists still hold is settled exactly: while such a list spans several components, members outside its
   largest one are compared with all members of the others, so every pair that might join two components is tried. There is no
   cap. That is quadratic in the members of one list that share rare shingles, have fitting sizes and yet aren't linked.

Long lists are dealt by (key, salt), about CHUNK members to a salt, wherever they are joined or ranked, so no task holds one.

Chance enters at three places. Step 2: a link at the threshold shares fewer values with a probability under 2e-7 (0.8) or 6e-7
(0.85; both are binomial, for large sets; sets within the sketch are exact). Step 3: under 1e-7. Step 4 compares 64-bit hashes of
shingles, of which two in one pair of texts of 20,000 words collide with a probability of about 2e-11. Links well over the
threshold have far smaller odds, and a lost link matters only where no other path joins the two.

Defined results: null or empty texts and texts without words have an empty set and are linked with nothing, each its own
component; repeated rows are members of one class; a group without any doc_id has a null component; extra columns are ignored or
pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if, cut, documents, drop, let, packed, small_batches, text_key
from .graph import components
from .scan import U64, hash_segments, mix, random_table, slices, word_hashes

WORDS = 5
SKETCH = 48
PUBLISH = 32
LIST = 32
#: Members of a long list to a salt, on average.
CHUNK = 256
#: Standard deviations by which an estimate may be wrong.
SIGMA = 6
#: Rows broadcast at most to pick or drop texts (24 bytes each).
BROADCAST_IDS = 1_000_000
_PLACES = random_table(WORDS, 41)
_SHORT, _SALT = random_table(2, 43)


def shingle_hashes(words: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (as signed longs) of each row."""
    total = np.zeros(max(0, len(words) - WORDS + 1), dtype=U64)
    for j in range(WORDS):
        total += words[j : len(words) - WORDS + 1 + j] * _PLACES[j]
    total = mix(total).view(np.int64)
    out, at = [], 0
    for n in counts.tolist():
        if n >= WORDS:
            out.append(np.unique(total[at : at + n - WORDS + 1]))
        elif n:
            whole = (words[at : at + n] * _PLACES[:n]).sum(dtype=U64, keepdims=True)
            out.append(mix(whole + np.full(1, n, dtype=U64) * _SHORT + _SALT).view(np.int64))
        else:
            out.append(total[:0])
        at += n
    return out


def digests(words: np.ndarray, counts: np.ndarray) -> pa.Array:
    """128-bit digests of the word sequences; equal for equal sequences."""
    two = np.zeros((len(counts), 2), dtype=U64)
    own = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[own]
    two[own, 0] = hash_segments(words, starts)
    two[own, 1] = hash_segments(mix(words ^ _SALT) | U64(1), starts) + counts[own].astype(U64)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(counts), [None, pa.py_buffer(two.tobytes())]).cast(pa.binary())


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    sizes = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in arrays], out=sizes[1:])
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([np.empty(0, dtype=np.int64), *arrays])))


def _scan(keep: int | None):
    """A mapper over (doc_id, text, _t1, _t2) batches; keep: how many least hashes, or the whole sets."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, raw, offsets in slices(batch.column(1)):
                words, counts = word_hashes(raw, offsets)
                sets = shingle_hashes(words, counts)
                sizes = pa.array([len(x) for x in sets], pa.int64())
                own = [batch.column(c)[first:last] for c in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays([*own, digests(words, counts), sizes, _lists([x[:keep] for x in sets])], ["doc_id", "_t1", "_t2", "node", "n", "hashes"])

    return scan


def scanned(docs: DataFrame, keep: int | None) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", *text_key()).mapInArrow(_scan(keep), f"doc_id {kind}, _t1 long, _t2 long, node binary, n long, hashes array<long>")


def _close(a, b, percent: int):
    """Whether two members (n, left) may reach the threshold: by their sizes, and by how many shingles are left at the one they
    have in common (with none known, left is the size)."""
    sizes = F.least(a["n"], b["n"]) * 100 >= F.greatest(a["n"], b["n"]) * percent
    return sizes & (F.least(a["left"], b["left"]) * (100 + percent) >= (a["n"] + b["n"]) * percent)


def _all_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of lists (key, node, n, left) that are known to be short."""
    grouped = lists.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "node", "left"))).alias("members"))

    def pairs(members):
        def of(x, i):
            later = F.filter(F.slice(members, i + 2, F.lit(LIST)), lambda y: _close(x, y, percent))
            return F.transform(later, lambda y: F.struct(F.least(x["node"], y["node"]).alias("a"), F.greatest(x["node"], y["node"]).alias("b")))

        return F.flatten(F.transform(members, of))

    return grouped.select(F.explode(let(F.col("members"), pairs)).alias("p")).select("p.a", "p.b").where("a != b").distinct()


def _salt(c: str = "c"):
    """The salt of a node in a list of c members."""
    return F.pmod(F.xxhash64("node"), F.expr(f"{c} div {CHUNK} + 1")).cast("int").alias("salt")


def _salted(keys: DataFrame) -> DataFrame:
    """Rows of lists (key, c, ...) once for each salt of the list."""
    return keys.select("*", F.explode(F.sequence(F.lit(0), F.expr(f"cast(c div {CHUNK} as int)"))).alias("salt"))


def _stars(lists: DataFrame, percent: int) -> DataFrame:
    """Each member of a list (key, node, n, left, c) with the leader of the list: the member that has most shingles left, so of a
    group of variants one near their origin."""
    leaders = _salted(lists.groupBy("key").agg(F.max(F.struct("left", F.xxhash64("node", "key").alias("h"), "node", "n")).alias("lead"), F.max("c").alias("c"))).drop("c")
    met = lists.select("key", _salt(), F.struct("node", "n", "left").alias("me")).join(leaders, ["key", "salt"])
    met = met.where((F.col("me.node") != F.col("lead.node")) & _close(F.col("me"), F.col("lead"), percent))
    return met.select(F.least("me.node", "lead.node").alias("a"), F.greatest("me.node", "lead.node").alias("b")).distinct()


def _estimated(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs whose union sketch doesn't rule the threshold out."""
    t = percent / 100
    least = t - SIGMA * sqrt(t * (1 - t) / SKETCH)
    a, b = (sketches.select(F.col("node").alias(x), F.col("hashes").alias(f"h{x}")) for x in "ab")
    union = F.slice(F.array_sort(F.array_union("ha", "hb")), 1, SKETCH)
    common = let(union, lambda u: F.size(F.array_intersect(u, F.array_intersect("ha", "hb"))) >= F.size(u) * least)
    return pairs.join(a, "a").join(b, "b").where(common).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a, b = (sets.select(F.col("node").alias(x), F.col("hashes").alias(f"h{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b").withColumn("i", F.size(F.array_intersect("ha", "hb")))
    return both.where(F.col("i") * 100 >= (F.size("ha") + F.size("hb") - F.col("i")) * percent).select("a", "b")


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(key, node, n, left) for the rarest shingles of each full set, as many as any linked set must share one of; left counts
    the set from that shingle on. Shingles that no other set has are dropped after they took their places."""
    each = sets.select("node", F.size("hashes").alias("n"), F.explode("hashes").alias("key"))
    often = each.groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    at = F.row_number().over(Window.partitionBy("node").orderBy("df", "key"))
    placed = each.join(often, "key").withColumn("left", F.col("n") - at + 1)
    return placed.where((F.col("left") * 100 >= F.col("n") * percent) & (F.col("df") > 1)).select("key", "node", F.col("n").cast("long").alias("n"), F.col("left").cast("long").alias("left"))


def _shared(percent: int):
    """How many of its p published values a class shares with any that it is linked with."""
    t = percent / 100
    return F.greatest(F.lit(1), F.ceil(F.col("p") * (t - SIGMA * sqrt(t * (1 - t) / PUBLISH))))


def _rarest(lists: DataFrame, percent: int) -> DataFrame:
    """(key, node, n, left, c, crowded): of lists (key, node, n, p, c) those that any linked class meets one of. Values that no other
    class has are not among the rows, but take the first places."""
    by = Window.partitionBy("node")
    at = F.col("p") - F.count(F.lit(1)).over(by) + F.row_number().over(by.orderBy("c", "key"))
    long = F.count_if(F.col("c") > LIST).over(by)
    placed = lists.withColumns({"at": at, "crowded": long >= _shared(percent)}).where(F.col("at") <= F.col("p") - _shared(percent) + 1)
    return placed.select("key", "node", "n", F.col("n").alias("left"), "c", "crowded")


def _sized(lists: DataFrame) -> DataFrame:
    """Lists of two members or more, with their sizes as c."""
    return lists.join(lists.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "key")


class _Links:
    """Verified links so far, as the components they make."""

    def __init__(self, sketches: DataFrame, sets, percent: int):
        self.sketches, self.sets, self.percent = sketches, sets, percent
        self.labels = None

    def add(self, pairs: DataFrame) -> None:
        found = cut(_verified(pairs, self.sets, self.percent), "links")
        if self.labels is None:
            self.labels = cut(components(found), "labels")
        elif not found.isEmpty():
            before, self.labels = self.labels, cut(components(self.labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(found)), "labels")
            drop(before)
        drop(found)

    def apart(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose ends aren't in one component yet."""
        a, b = (self.labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
        ends = pairs.join(a, "a", "left").join(b, "b", "left")
        return ends.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def _settle(links: _Links, long: DataFrame) -> None:
    """Compare across the components of each long list (key, node, n, left, c) until every pair that could join two was tried."""
    used, step = None, 32
    while True:
        at = long.join(links.labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        per = at.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m"), F.max("c").alias("c"))
        main = per.groupBy("key").agg(F.max(F.struct("m", "label")).alias("main"), F.count(F.lit(1)).alias("parts"), F.max("c").alias("c")).where("parts > 1")
        spread = _salted(main.select("key", F.col("main.label").alias("main"), "c")).drop("c")
        mixed = cut(at.select("key", _salt(), "c", "node", "n", "left", "label").join(spread, ["key", "salt"]), "mixed")
        minor = mixed.where("label != main")
        if used is not None:
            minor = minor.join(used, ["key", "node"], "left_anti")
        rank = F.row_number().over(Window.partitionBy("key", "salt").orderBy(F.xxhash64("node", "key"), "node"))
        most = F.greatest(F.lit(1), F.expr(f"{step} div (c div {CHUNK} + 1)"))
        chosen = cut(minor.withColumn("rank", rank).where(F.col("rank") <= most).select("key", "c", F.struct("node", "n", "left").alias("lead"), F.col("label").alias("own")), "leaders")
        if chosen.isEmpty():
            drop(mixed, chosen)
            return
        met = mixed.select("key", "salt", F.struct("node", "n", "left").alias("me"), "label").join(_salted(chosen).drop("c"), ["key", "salt"])
        met = met.where((F.col("label") != F.col("own")) & _close(F.col("me"), F.col("lead"), links.percent))
        pairs = met.select(F.least("me.node", "lead.node").alias("a"), F.greatest("me.node", "lead.node").alias("b")).distinct()
        pairs = cut(_estimated(pairs, links.sketches, links.percent), "settle")
        if not pairs.isEmpty():
            links.add(pairs)
        drop(mixed, pairs)
        took = chosen.select("key", F.col("lead.node").alias("node"))
        used = took if used is None else used.union(took)
        step *= 4


def _classes(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, _t1, _t2, node, n) of every row of docs, and (node, first, copies, label) of the classes that don't stand alone: first
    is the least doc_id of the class, label names its component."""
    with small_batches(docs.sparkSession):
        rows = cut(scanned(docs, SKETCH), "sketches")
    sketches = cut(rows.where("n > 0").select("node", "n", "hashes").dropDuplicates(["node"]), "classes")
    published = sketches.select(F.explode(F.slice("hashes", 1, PUBLISH)).alias("key"), "node", F.col("n").cast("int").alias("n"), F.least(F.size("hashes"), F.lit(PUBLISH)).alias("p"))
    lists = cut(_rarest(_sized(published), percent), "lists")
    hot = lists.where(F.col("c") > LIST)
    found = cut(_estimated(_all_pairs(lists.where(F.col("c") <= LIST), percent).union(_stars(hot, percent)).distinct(), sketches, percent), "pairs")
    crowded = cut(hot.where("crowded").select("node").distinct(), "crowded")
    drop(lists)
    first = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_t1", "_t2")).alias("own"))
    with small_batches(docs.sparkSession):
        sets = cut(_full_sets(docs, first, found.select("a").union(found.select("b")).union(crowded).distinct()), "sets")
    long = None
    if not crowded.isEmpty():
        prefixes = cut(_sized(_prefixes(sets.join(crowded, "node", "left_semi"), percent)), "prefixes")
        long = prefixes.where(F.col("c") > LIST)
        more = _all_pairs(prefixes.where(F.col("c") <= LIST), percent).union(_stars(long, percent)).distinct()
        fewer, found = found, cut(found.union(_estimated(more, sketches, percent)).distinct(), "pairs")
        drop(fewer)
    links = _Links(sketches, sets, percent)
    links.add(found.groupBy("b").agg(F.min("a").alias("a")))
    rest = cut(links.apart(found), "rest")
    if not rest.isEmpty():
        links.add(rest)
    if long is not None:
        _settle(links, long)
        drop(prefixes)
    drop(sets, found, rest, crowded, sketches)
    joined = first.join(links.labels, "node", "left").where("copies > 1 OR label IS NOT NULL").withColumn("label", F.coalesce("label", "node"))
    return rows.drop("hashes"), joined


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs: texts are linked where the Jaccard similarity of their shingle
    sets is at least percent / 100, and component_id is the least doc_id that links and equal texts reach. Classes that stand alone
    need no join; for the others the least doc_id of the component comes by class."""
    rows, joined = _classes(docs, percent)
    least = joined.groupBy("label").agg(F.min("first").alias("component"))
    named = joined.join(least, "label").select("node", "component")
    out = rows.select("doc_id", "node", F.col("n").alias("n_shingles")).join(named, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _full_sets(docs: DataFrame, first: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, hashes) of nodes, from the text of one row of each."""
    wanted = cut(first.join(nodes.toDF("node"), "node", "left_semi").select("node", F.col("own.doc_id").alias("x0"), F.col("own._t1").alias("x1"), F.col("own._t2").alias("x2")), "wanted")
    t1, t2 = text_key()
    same = F.col("doc_id").eqNullSafe(F.col("x0")) & (F.col("_t1") == F.col("x1")) & (F.col("_t2") == F.col("x2"))
    texts = docs.select("doc_id", "text", t1, t2).join(broadcast_if(wanted.drop("node"), wanted.count(), BROADCAST_IDS), same, "left_semi")
    return scanned(texts.select("doc_id", "text"), None).dropDuplicates(["node"]).select("node", "hashes")


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near-duplicates, with the columns of docs: that of the least doc_id (null last), and of
    rows that share this doc_id that of the least text key, once."""
    names = ["doc_id", "_t1", "_t2"]
    plain = packed(docs, "doc_id", "text")
    rows, joined = _classes(plain, percent)
    best = joined.groupBy("label").agg(F.min("own").alias("own"))
    named = joined.select("node", "label").join(best, "label").select("node", F.col("own.doc_id").alias("x0"), F.col("own._t1").alias("x1"), F.col("own._t2").alias("x2"))
    stays = F.col("doc_id").eqNullSafe(F.col("x0")) & (F.col("_t1") == F.col("x1")) & (F.col("_t2") == F.col("x2"))
    ids = rows.join(named, "node").withColumn("stays", stays).groupBy(*names, "stays").agg(F.count(F.lit(1)).alias("n"))
    ids = cut(ids.where("NOT stays OR n > 1").toDF("x0", "x1", "x2", "stays", "n"), "dropped")
    n = ids.count()
    t1, t2 = text_key()
    keyed = plain.select("row", "doc_id", t1, t2)
    same = F.col("doc_id").eqNullSafe(F.col("x0")) & (F.col("_t1") == F.col("x1")) & (F.col("_t2") == F.col("x2"))
    out = keyed.join(broadcast_if(ids.drop("stays", "n"), n, BROADCAST_IDS), same, "left_anti").select("row.*")
    again = ids.where("stays").drop("stays", "n")
    if again.isEmpty():
        return out
    repeated = keyed.join(broadcast_if(again, n, BROADCAST_IDS), same, "left_semi")
    return out.unionByName(repeated.groupBy(*names).agg(F.first("row").alias("row")).select("row.*"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir), percent=85)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
