"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1; a trigram is bound as the product of its three letters' vectors, permuted by
position (rotated twice, once, not at all); a text bundles its trigrams by adding them up; a language bundles the texts
labelled with it. A document goes to the language whose prototype has the greatest cosine with it. All sums are of integers, so
results don't depend on the order of partitions.

Learned from the documents whose crc32(doc_id as text) mod 3 is not 1 and whose lang isn't null; a null doc_id counts as
remainder 0. Defined results: `und` with score 0 for a null text or one without letters, and for all texts where nothing was
learned; a text with letters but no trigram that was learned has score 0 and the least language name, as ties do. Letters
outside the first two Unicode planes count as separators, save planes 2 and 3, all of whose code points count as ideographs;
combining marks are separators, and where a text
ends on a letter its last word has no closing trigram. Vectors are worked off in parts of PART distinct trigrams, so memory doesn't grow with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .scan import U64, mix, slices

DIMENSIONS = 1024
#: Most languages that prototypes are gathered for; DIMENSIONS doubles each on the driver and in each worker.
MOST_LANGUAGES = 1000
#: Rows whose trigram counts are multiplied at once, and distinct trigrams whose vectors are.
BLOCK = 128
PART = 4096
_PLANES = 0x20000
_folded: list[np.ndarray] = []
_letters: dict[int, np.ndarray] = {}


def fold_table() -> np.ndarray:
    """Code point to its lower-case letter, 0 for what isn't a letter; built once in a process."""
    if not _folded:
        table = np.zeros(_PLANES, dtype=np.uint32)
        for c in range(_PLANES):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _folded.append(table)
    return _folded[0]


def letter_vector(code: int) -> np.ndarray:
    """The fixed vector of +1 and -1 of a letter."""
    if code not in _letters:
        bits = mix(np.arange(DIMENSIONS // 64, dtype=U64) + mix(np.array([code], dtype=U64)))
        _letters[code] = np.unpackbits(bits.view(np.uint8)).astype(np.int8) * 2 - 1
    return _letters[code]


def trigrams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and trigram (as a place in the third array) of each trigram in a slice; the trigrams' letters; letters in each row.
    Runs of other characters count as one separator; every row begins with one."""
    rows = len(offsets) - 1
    heads = np.flatnonzero((raw & 0xC0) != 0x80)
    code = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    begins = np.searchsorted(heads, offsets)
    letter = np.where(code < _PLANES, fold_table()[np.minimum(code, _PLANES - 1)], np.where(code < 0x40000, code, 0)).astype(np.uint32)
    row = np.repeat(np.arange(rows), np.diff(begins))
    count = np.bincount(row, weights=letter > 0, minlength=rows).astype(np.int64)
    keep = letter > 0
    keep[1:] |= (letter[:-1] > 0) & (row[1:] == row[:-1])
    letter, row = letter[keep], row[keep]
    own = np.flatnonzero(count)  # a separator before each row that has letters
    at = np.searchsorted(row, own)
    letter, row = np.insert(letter, at, 0), np.insert(row, at, own)
    if len(letter) < 3:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty((0, 3), dtype=np.uint32), count
    alphabet, dense = np.unique(letter, return_inverse=True) if letter.max() >= _PLANES else _dense(letter)
    k = len(alphabet)
    dense = dense.astype(np.int64)
    packed = (dense[:-2] * k + dense[1:-1]) * k + dense[2:]
    inside = (row[2:] == row[:-2]) & (letter[1:-1] > 0)
    packed, row = packed[inside], row[2:][inside]
    if k**3 <= 1 << 23:
        seen = np.zeros(k**3, dtype=bool)
        seen[packed] = True
        distinct = np.flatnonzero(seen)
        place = np.zeros(k**3, dtype=np.int64)
        place[distinct] = np.arange(len(distinct))
        which = place[packed]
    else:
        distinct, which = np.unique(packed, return_inverse=True)
    names = np.stack([alphabet[distinct // (k * k)], alphabet[distinct // k % k], alphabet[distinct % k]], axis=1)
    return row, which, names, count


def _dense(letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    seen = np.zeros(_PLANES, dtype=bool)
    seen[letter] = True
    alphabet = np.flatnonzero(seen).astype(np.uint32)
    place = np.zeros(_PLANES, dtype=np.int64)
    place[alphabet] = np.arange(len(alphabet))
    return alphabet, place[letter]


def trigram_vectors(names: np.ndarray) -> np.ndarray:
    """Bound vectors, one row for each trigram."""
    alphabet, at = np.unique(names, return_inverse=True)
    at = at.reshape(names.shape)
    base = np.stack([letter_vector(int(c)) for c in alphabet]) if len(alphabet) else np.empty((0, DIMENSIONS), dtype=np.int8)
    return np.roll(base, 2, axis=1)[at[:, 0]] * np.roll(base, 1, axis=1)[at[:, 1]] * base[at[:, 2]]


def bundled(row: np.ndarray, which: np.ndarray, letters: np.ndarray, rows: int) -> np.ndarray:
    """The bundle of each row: its trigram counts times their vectors, over parts of the trigrams and blocks of rows. row is sorted;
    which is a place in letters. Sums are of integers under 2**24, or rounded alike in every run."""
    out = np.zeros((rows, DIMENSIONS), dtype=np.float32)
    parts = which // PART
    whole = len(letters) <= PART
    for part in range(-(-len(letters) // PART)):
        vectors = trigram_vectors(letters[part * PART : (part + 1) * PART]).astype(np.float32)
        n = len(vectors)
        mine = slice(None) if whole else np.flatnonzero(parts == part)
        r, w = row[mine], which[mine] - part * PART
        edge = np.searchsorted(r, np.arange(0, rows + BLOCK, BLOCK))
        for b, begin in enumerate(range(0, rows, BLOCK)):
            if edge[b] == edge[b + 1]:
                continue
            size, here = min(BLOCK, rows - begin), slice(edge[b], edge[b + 1])
            counts = np.bincount((r[here] - begin) * n + w[here], minlength=size * n).astype(np.float32).reshape(size, n)
            out[begin : begin + size] += counts @ vectors
    return out


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes. Each task adds up one integer vector for each language it meets."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(1).to_pandas().to_numpy()
            for first, last, raw, offsets in slices(batch.column(0)):
                if not len(raw):
                    continue
                langs, of = np.unique(names[first:last].astype(str), return_inverse=True)
                row, which, letters, _ = trigrams(raw, offsets)
                counts = np.bincount(of[row] * len(letters) + which, minlength=len(langs) * len(letters)).reshape(len(langs), len(letters))
                for part in range(0, len(letters), PART):
                    added = counts[:, part : part + PART].astype(np.float64) @ trigram_vectors(letters[part : part + PART]).astype(np.float64)
                    for i, lang in enumerate(langs):
                        sums.setdefault(lang, np.zeros(DIMENSIONS, dtype=np.int64))
                        sums[lang] += added[i].astype(np.int64)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([total.tolist()], pa.list_(pa.int64()))], ["lang", "sums"])

    chosen = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"))
    parts = chosen.mapInArrow(bundle, "lang string, sums array<long>")
    totals = parts.select("lang", F.posexplode("sums")).groupBy("lang", "pos").agg(F.sum("col").alias("v"))
    packed = totals.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("v"))
    found = packed.orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: raise MOST_LANGUAGES or clean the labels")
    return [r["lang"] for r in found], np.array([r["v"] for r in found], dtype=np.float64).reshape(len(found), DIMENSIONS)


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs."""
    unit = (prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12)).astype(np.float32).T

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            best, score = np.full(n, -1), np.zeros(n)
            for first, last, raw, offsets in slices(batch.column(1)) if langs else ():
                if not len(raw):
                    continue
                row, which, letters, count = trigrams(raw, offsets)
                texts = bundled(row, which, letters, last - first)
                cosine = texts @ unit / np.maximum(np.linalg.norm(texts, axis=1, keepdims=True), 1e-12)
                has = count > 0
                best[first:last] = np.where(has, cosine.argmax(axis=1), -1)
                score[first:last] = np.where(has, np.clip(cosine.max(axis=1), 0, 1), 0)
            names = np.array([*langs, "und"], dtype=object)[best]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(classify, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, *learn(docs))


def op10_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
