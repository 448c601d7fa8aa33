"""Token counts: pieces are counted once for each distinct pre-token, joined to the pre-token frequencies of each document and summed.

A pre-token is a run of spaces with the letters after it, or what follows a line feed. No piece of the vocabulary spans such a
boundary (`boundaries_hold` verifies it when a worker loads the vocabulary), so the merges of one pre-token never depend on
another and the sums are exactly the library's counts; no list of ids over a text is ever built. "Distinct" is within what one
Python worker has met: a global join would shuffle a row for each document and pre-token, several times the input, while the
worker's dictionary needs no exchange at all. It is bounded by KEEP entries and starts anew beyond them, which costs only time.

Defined results: null and empty texts have 0 bytes and 0 tokens; texts that hold the vocabulary's own space mark are encoded
whole by the library.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .scan import U64, hash_segments, random_table, slices

#: Entries that a worker's dictionary of pre-tokens holds at most (16 bytes each).
KEEP = 2_000_000
LIMIT = 4096
MARK = "▁"
_BYTES = random_table(256, 23)
_LENGTHS = random_table(2, 29)


def boundaries_hold(pieces: list[str]) -> bool:
    """No piece has a space mark after another character, and none but single characters has a line feed."""
    return not any(MARK in p.lstrip(MARK) or ("\n" in p and len(p) > 1) for p in pieces)


class PieceCounter:
    """Counts of pieces by the hash of a pre-token, sorted by hash."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        if not boundaries_hold([self.library.id_to_piece(i) for i in range(len(self.library))]):
            raise ValueError(f"{model_file}: pieces span the boundaries of pre-tokens")
        self.keys = np.empty(0, dtype=U64)
        self.counts = np.empty(0, dtype=np.int64)

    def whole(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.library.encode(texts, num_threads=1)]

    def _encode(self, segments: list[str]) -> np.ndarray:
        """The library puts a space before each input: a segment gives its own first space away for it; one without stands
        behind a line feed, whose two pieces (the space and the line feed) are taken off again."""
        spaced = np.array([s[:1] == " " for s in segments], dtype=bool)
        got = np.array(self.whole([s[1:] if s[:1] == " " else "\n" + s for s in segments]), dtype=np.int64)
        got[~spaced] -= 2
        got[np.array([s == " " for s in segments], dtype=bool)] = 1
        return got

    def lookup(self, hashes: np.ndarray, first: np.ndarray, ends: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """Pieces of each distinct pre-token, which lies at raw[first:end]."""
        at = np.minimum(np.searchsorted(self.keys, hashes), max(0, len(self.keys) - 1))
        known = self.keys[at] == hashes if len(self.keys) else np.zeros(len(hashes), dtype=bool)
        out = np.zeros(len(hashes), dtype=np.int64)
        out[known] = self.counts[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            data = raw.tobytes()
            out[new] = self._encode([data[a:b].decode("utf-8") for a, b in zip(first[new].tolist(), ends[new].tolist(), strict=True)])
            if len(self.keys) + len(new) > KEEP:
                self.keys, self.counts = hashes[new], out[new]
            else:
                place = np.searchsorted(self.keys, hashes[new])  # both are sorted, so this is a linear merge
                self.keys, self.counts = np.insert(self.keys, place, hashes[new]), np.insert(self.counts, place, out[new])
        return out


def count_slice(counter: PieceCounter, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Tokens of each row of a slice. Before each row a space is set, as the library does for any input that isn't empty."""
    rows, lengths = len(offsets) - 1, np.diff(offsets)
    own = np.flatnonzero(lengths)
    spaced = np.full(len(raw) + len(own), 0x20, dtype=np.uint8)
    starts = offsets[own] + np.arange(len(own))  # of the space before each row that isn't empty
    spaced[np.delete(np.arange(len(spaced)), starts)] = raw
    space, feed = spaced == 0x20, spaced == 0x0A
    begins = feed.copy()
    begins[1:] |= feed[:-1] | (space[1:] & ~space[:-1])
    begins[starts] = True
    at = np.flatnonzero(begins)
    row = own[np.searchsorted(starts, at, side="right") - 1] if len(at) else at
    total = np.bincount(row, weights=feed[at], minlength=rows).astype(np.int64)  # each line feed is a token
    ends = np.append(at[1:], len(spaced))
    hashes = hash_segments(_BYTES[spaced], at) + (ends - at).astype(U64) * _LENGTHS[0]
    words = ~feed[at]
    at, ends, row, hashes = at[words], ends[words], row[words], hashes[words]
    distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    if len(distinct):
        pieces = counter.lookup(distinct, at[first], ends[first], spaced)
        total += np.bincount(row, weights=pieces[back], minlength=rows).astype(np.int64)
    return total


def token_counts(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs. model: a file name for public_tokenizers.path, or a path."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        counter = PieceCounter(model if "/" in model else public_tokenizers.path(model))
        mark = MARK.encode()
        for batch in batches:
            texts = batch.column(1)
            tokens = np.zeros(len(texts), dtype=np.int64)
            sizes = np.zeros(len(texts), dtype=np.int64)
            for first, last, raw, offsets in slices(texts):
                sizes[first:last] = np.diff(offsets)
                tokens[first:last] = count_slice(counter, raw, offsets)
                if mark in raw.tobytes():
                    marked = [i for i in range(first, last) if MARK in (texts[i].as_py() or "")]
                    tokens[marked] = counter.whole([texts[i].as_py() for i in marked])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(tokens)], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
