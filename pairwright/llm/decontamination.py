"""Benchmark decontamination by templates.

Text becomes tokens: runs of letters, and numbers with their inner points and commas. A number becomes <number>, a unit behind
a number <unit>, a capitalised word inside a sentence <name>; all other words stay, in lower case. A capitalised word at the head
of a window or of a sentence is read both ways, as a name and as a word (all such words inside of one window alike).
Windows join by their exact tokens in lower case as well, so a copy is found whatever became of its capitals and stops. Windows of WINDOW template
tokens are hash-joined with those of the benchmark, so a question whose numbers and names were exchanged still meets its
template. Then, for each document, item and alignment, slot consistency is checked: one value of the item must stand for one
value in the document throughout (for names also the other way round), save for a CONFLICTS share. A window with fewer than
`literals` words of its own joins by its exact tokens, so tables of numbers don't match each other.

Values may differ in length: where names or numbers adjoin, a text's windows are taken once more with each such run as one
token ('Mary Ann', '1 000'; a capitalised word that begins a sentence belongs to the names behind it), and alignments are sought among
both readings of either side.

A document is contaminated by an item if one alignment is consistent and covers RUN windows (13 tokens in a row where they
adjoin) or all windows of a shorter item. An item under WINDOW tokens is one window; one under `shortest` tokens counts only
where it is a document's whole text (both are parameters).

Defined results: null and empty texts match nothing; rows are told apart by doc_id and text, so a null or repeated doc_id
never mixes two texts: `decontaminate` drops the rows whose own text holds an item, `contaminated` has one row for each
(doc_id, item_id), the best of its texts; ties don't arise; extra columns are ignored or pass through, whatever their names; with
an empty benchmark or no documents there are no rows. Case folding covers ASCII and Latin-1. A document is held whole in a
worker, at about 60 bytes for each byte of text while its slice is worked off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if, cut, documents, packed, small_batches, text_key
from .scan import U64, hash_segments, mix, random_table, slices

WINDOW = 8
LITERALS = 4
RUN = 6
SHORTEST = 5
CONFLICTS = 0.25
#: Windows of the benchmark that are sent to the workers to sift with, at most (8 bytes each); beyond it all windows are joined.
SIFT = 2_000_000
#: Windows of the benchmark broadcast at most for the join (about 120 bytes each).
BROADCAST_WINDOWS = 200_000
#: Contaminated rows broadcast at most (24 bytes each).
BROADCAST_HELD = 1_000_000
#: Unit words.
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g gram grams kg kilogram kilograms ton tons tonne tonnes lb lbs "
    "pound pounds ounce ounces oz ml cl l liter liters litre litres gallon gallons second seconds sec s minute minutes min hour hours "
    "h day days week weeks month months year years degree degrees celsius fahrenheit kelvin percent dollar dollars cent cents euro "
    "euros yen volt volts v watt watts w kw kwh amp amps hz khz mhz ghz byte bytes kb mb gb tb joule joules newton newtons pascal mph kmh"
)

_LETTER, _DIGIT = 1, 2
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_CLASS[48:58] = _DIGIT
_STOPS = np.zeros(256, dtype=bool)
_STOPS[[ord(c) for c in ".!?:;\n|"]] = True
_BYTES = random_table(256, 61)
_PLACES = random_table(WINDOW, 67)
_SLOT_HASHES = random_table(4, 71)
_EXACT, _LENGTHS = random_table(2, 73)
NUMBER, UNIT, NAME = 1, 2, 3


class Tokens:
    """The tokens of a slice: row, raw hash, slot (0: literal), and slot where words that begin a sentence may be names (wide)."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        n, rows = len(raw), len(offsets) - 1
        kind = _CLASS[raw]
        after = np.append(raw[1:], 0).astype(np.uint8)
        low = (raw == 0xC2) & (after >= 0xA0)  # no-break space to inverted question mark
        wide = ((raw == 0xE2) & ((after == 0x80) | (after == 0x81))) | ((raw == 0xE3) & (after == 0x80))  # general and CJK punctuation
        for lead, size in ((low, 2), (wide, 3)):
            at = np.flatnonzero(lead)
            for j in range(size):
                kind[np.minimum(at + j, n - 1)] = 0
        digit = kind == _DIGIT
        inner = np.zeros(n, dtype=bool)
        if n > 2:
            inner[1:-1] = ((raw[1:-1] == 0x2E) | (raw[1:-1] == 0x2C)) & digit[:-2] & digit[2:]
        kind[inner] = _DIGIT
        ink = kind > 0
        heads = offsets[:-1][offsets[:-1] < n]
        begins = ink.copy()
        begins[1:] &= kind[1:] != kind[:-1]
        begins[heads] = ink[heads]
        at = np.flatnonzero(begins)
        self.row = np.searchsorted(offsets, at, side="right") - 1
        self.counts = np.bincount(self.row, minlength=rows)
        latin = np.zeros(n, dtype=bool)  # second bytes of capital letters of Latin-1
        latin[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        capital = (raw >= 65) & (raw <= 90)
        folded = np.where(capital | latin, raw + 32, raw).astype(np.uint8)
        values = _BYTES[folded]
        values[~ink] = 0
        self.hash = hash_segments(values, at)
        if not len(at):
            self.slot = self.wide = self.initial = self.hash.astype(np.int64)
            return
        size = np.add.reduceat(ink.astype(np.int64), at)
        capitals = np.add.reduceat((capital | latin).astype(np.int64), at)
        first = capital[at].copy()
        first[at + 1 < n] |= latin[np.minimum(at + 1, n - 1)][at + 1 < n]
        stops = np.cumsum(_STOPS[raw] & ~inner)
        initial = np.ones(len(at), dtype=bool)
        initial[1:] = (self.row[1:] != self.row[:-1]) | (stops[at[1:]] > stops[at[:-1]])
        title = first & (capitals == 1) & (size > 1)
        letters = kind[at] == _LETTER
        shout = np.bincount(self.row, weights=title, minlength=rows) * 2 > np.bincount(self.row, weights=letters, minlength=rows)
        number = kind[at] == _DIGIT
        behind = np.zeros(len(at), dtype=bool)
        behind[1:] = number[:-1] & (self.row[1:] == self.row[:-1])
        self.slot = np.zeros(len(at), dtype=np.int64)
        self.slot[title & ~initial & ~shout[self.row]] = NAME
        self.slot[letters & behind & np.isin(self.hash, unit_hashes())] = UNIT
        self.slot[number] = NUMBER
        self.wide = np.where(title & ~shout[self.row] & (self.slot == 0), NAME, self.slot)
        self.initial = initial

    def merged(self) -> Tokens | None:
        """The rows in which names or numbers adjoin, with each run of them as one token; other tokens stay as they are."""
        name, number = self.wide == NAME, self.slot == NUMBER
        glued = np.zeros(len(name), dtype=bool)
        glued[1:] = (self.row[1:] == self.row[:-1]) & ~self.initial[1:] & ((name[1:] & name[:-1]) | (number[1:] & number[:-1]))
        if not glued.any():
            return None
        has = np.zeros(len(self.counts), dtype=bool)
        has[self.row[glued]] = True
        mine = np.flatnonzero(has[self.row])
        starts = np.flatnonzero(~glued[mine])
        run = np.diff(np.append(starts, len(mine))) > 1
        at = mine[starts]
        out = Tokens.__new__(Tokens)
        out.row, out.wide, out.initial = self.row[at], self.wide[at], self.initial[at]
        out.hash = np.where(run, hash_segments(self.hash[mine], starts), self.hash[at])
        out.slot = np.where(run & name[at], NAME, self.slot[at])
        out.counts = np.bincount(out.row, minlength=len(self.counts))
        return out

    def windows(self, size: int, literals: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """First tokens of the windows of a size, their keys and the slots of their heads and of their other tokens, by reading: a
        capitalised head is a literal or a name, and so are the capitalised words that begin a sentence behind it. A last reading takes
        all tokens as they are, in lower case, so that a copy is met whatever its capitals and stops are."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return
        at = np.flatnonzero(self.row[:n] == self.row[size - 1 :])
        bare = np.where(self.slot == NAME, 0, self.slot)
        named = self.wide[at] == NAME
        more = np.cumsum(self.wide != self.slot)
        begun = more[at + size - 1] > more[at]
        exact = np.zeros(len(self.hash), dtype=U64)
        exact[at] = self._exact(at, size)
        for mine, head, inner in ((at, bare, self.slot), (at[named], self.wide, self.slot), (at[begun], bare, self.wide), (at[named & begun], self.wide, self.wide)):
            keys = self._keys(mine, size, head, inner, literals)
            other = keys != exact[mine]
            yield mine[other], keys[other], np.maximum(self.slot, head), inner
        yield at, exact[at], self.slot, self.slot

    def _exact(self, at: np.ndarray, size: int) -> np.ndarray:
        keys = np.full(len(at), _EXACT, dtype=U64)
        for j in range(size):
            keys = keys + self.hash[at + j] * _PLACES[j]
        return mix(keys + np.full(1, size, dtype=U64) * _LENGTHS)

    def _keys(self, at: np.ndarray, size: int, head: np.ndarray, inner: np.ndarray, least: int) -> np.ndarray:
        """Keys by template; those of windows with too few literals are left to the exact reading (as exact keys)."""
        template = np.where(inner > 0, _SLOT_HASHES[inner], self.hash)
        keys = np.where(head > 0, _SLOT_HASHES[head], self.hash)[at] * _PLACES[0]
        literals = (head[at] == 0).astype(np.int64)
        for j in range(1, size):
            keys = keys + template[at + j] * _PLACES[j]
            literals += inner[at + j] == 0
        keys = mix(keys + np.full(1, size, dtype=U64) * _LENGTHS)
        return np.where(literals >= min(least, (size + 1) // 2), keys, self._exact(at, size))


_units: list[np.ndarray] = []


def unit_hashes() -> np.ndarray:
    if not _units:
        words = UNITS.split()
        raw = np.frombuffer("".join(words).encode(), dtype=np.uint8)
        starts = np.cumsum([0, *(len(w) for w in words[:-1])])
        _units.append(hash_segments(_BYTES[raw], starts))
    return _units[0]


_SCHEMA = "id {}, _t1 long, _t2 long, merged boolean, pos long, key long, size int, slots array<long>"


def _windows(short: list[int] | None, sift: np.ndarray | None, shortest: int, literals: int):
    """A mapper over (id, text, _t1, _t2). short: sizes under WINDOW to look for; None: an item's own size. sift: sorted keys to keep."""

    def found(t: Tokens, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """First tokens, keys and slots of the windows that count."""
        for at, keys, head, inner in t.windows(size, literals):
            if size < WINDOW and (short is None or size < shortest):
                own = t.counts[t.row[at]] == size
                at, keys = at[own], keys[own]
            if sift is not None and len(sift):
                hit = sift[np.minimum(np.searchsorted(sift, keys), len(sift) - 1)] == keys
                at, keys = at[hit], keys[hit]
            if len(at):
                member = at[:, None] + np.arange(size)
                kinds = np.column_stack([head[at], inner[member[:, 1:]]])
                yield at, keys, np.where(kinds > 0, (t.hash[member] & ~U64(3)).view(np.int64) | kinds, 0)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, raw, offsets in slices(batch.column(1)):
                if not len(raw):
                    continue
                plain = Tokens(raw, offsets)
                for t, merged in ((plain, False), (plain.merged(), True)):
                    if t is None:
                        continue
                    firsts = np.cumsum(t.counts) - t.counts
                    for size in range(1, WINDOW + 1):
                        if size < WINDOW and short is not None and size not in short:
                            continue
                        for at, keys, slots in found(t, size):
                            row = t.row[at]
                            mine = pa.array(first + row)
                            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) * size + 1, size, dtype=np.int32)), pa.array(slots.reshape(-1)))
                            rest = [np.full(len(at), merged), at - firsts[row], keys.view(np.int64), np.full(len(at), size, dtype=np.int32)]
                            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(mine) for c in (0, 2, 3)), *map(pa.array, rest), lists], ["id", "_t1", "_t2", "merged", "pos", "key", "size", "slots"])

    return scan


def windows(table: DataFrame, key: str, short: list[int] | None = None, sift: np.ndarray | None = None, shortest: int = SHORTEST, literals: int = LITERALS) -> DataFrame:
    kind = table.schema[key].dataType.simpleString()
    return table.select(F.col(key).alias("id"), "text", *text_key()).mapInArrow(_windows(short, sift, shortest, literals), _SCHEMA.format(kind))


def _holding(docs: DataFrame, benchmark: DataFrame, shortest: int, literals: int) -> DataFrame:
    """The best alignment of each text (doc_id, _t1, _t2) with each item it holds."""
    items = cut(windows(benchmark, "item_id", None, None, shortest, literals), "items")
    total = items.count()
    short = [r["size"] for r in items.where(F.col("size") < WINDOW).select("size").distinct().collect()]
    sift = np.sort(np.array([r["key"] for r in items.select("key").distinct().collect()], dtype=np.int64).view(U64)) if total <= SIFT else None
    item = F.struct("id", "_t1", "_t2", "merged").alias("item")
    sizes = items.groupBy(item).agg(F.countDistinct("pos").alias("item_windows"))
    mine = items.select(item, F.col("pos").alias("item_pos"), "key", F.col("slots").alias("item_slots")).join(sizes, "item")
    doc = F.struct("id", "_t1", "_t2", "merged").alias("doc")
    hits = windows(docs, "doc_id", short, sift, shortest, literals).select(doc, "pos", "key", "slots").join(broadcast_if(mine, total, BROADCAST_WINDOWS), "key")
    pairs = F.filter(F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d")), lambda p: (p["i"] != 0) & (p["d"] != 0))
    hits = hits.select("doc", "item", "item_pos", "item_windows", (F.col("pos") - F.col("item_pos")).alias("shift"), F.transform(pairs, lambda p: F.struct(p["i"].alias("i"), p["d"].alias("d"))).alias("pairs"))
    one = hits.groupBy("doc", "item", "shift", "item_pos").agg(F.max("item_windows").alias("item_windows"), F.flatten(F.collect_set("pairs")).alias("pairs"))
    lined = one.groupBy("doc", "item", "shift").agg(F.count(F.lit(1)).alias("matched"), F.max("item_windows").alias("item_windows"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    names = F.filter("pairs", lambda p: p["i"].bitwiseAND(F.lit(3)) == NAME)
    back = F.size(names) - F.size(F.array_distinct(F.transform(names, lambda p: p["d"])))
    forth = F.size("pairs") - F.size(F.array_distinct(F.transform("pairs", lambda p: p["i"])))
    good = lined.where((F.col("matched") >= F.least("item_windows", F.lit(RUN))) & (back + forth <= F.size("pairs") * CONFLICTS))
    same = F.forall("pairs", lambda p: p["i"] == p["d"])
    best = F.max(F.struct((F.col("matched") / F.col("item_windows")).alias("coverage"), "matched", "item_windows"))
    ends = [F.col("doc.id").alias("doc_id"), F.col("doc._t1").alias("_t1"), F.col("doc._t2").alias("_t2"), F.col("item.id").alias("item_id")]
    return good.groupBy(*ends).agg(best.alias("best"), F.max(F.size("pairs")).cast("long").alias("n_slots"), F.max(same).alias("verbatim"))


def contaminated(docs: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST, literals: int = LITERALS) -> DataFrame:
    """doc_id, item_id, matched_windows, item_windows, coverage, n_slots, verbatim for each document and item it holds."""
    found = _holding(docs, benchmark, shortest, literals).groupBy("doc_id", "item_id").agg(F.max("best").alias("best"), F.max("n_slots").alias("n_slots"), F.max("verbatim").alias("verbatim"))
    return found.select("doc_id", "item_id", F.col("best.matched").alias("matched_windows"), F.col("best.item_windows").alias("item_windows"), F.col("best.coverage").alias("coverage"), "n_slots", "verbatim")


def decontaminate(docs: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST, literals: int = LITERALS) -> DataFrame:
    """The rows of docs whose text holds no item, with the columns of docs."""
    rows = packed(docs, "doc_id", "text")
    with small_batches(docs.sparkSession):
        held = cut(_holding(rows, benchmark, shortest, literals).select("doc_id", "_t1", "_t2").distinct(), "held").toDF("x0", "x1", "x2")
    t1, t2 = text_key()
    same = F.col("doc_id").eqNullSafe(F.col("x0")) & (F.col("_t1") == F.col("x1")) & (F.col("_t2") == F.col("x2"))
    return rows.select("row", "doc_id", t1, t2).join(broadcast_if(held, held.count(), BROADCAST_HELD), same, "left_anti").select("row.*")


def op2_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
