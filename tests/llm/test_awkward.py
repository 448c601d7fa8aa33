"""Inputs that once gave wrong results: null and repeated ids, clashing names, lost records, long texts, skewed groups."""

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright.llm import decontamination, dedup, langid, mixing, quality, scan, warc

PROSE = [f"w{i % 97}x{i % 89}" for i in range(4000)]
ITEM = "Question: Anna has 12 apples and buys 7 more pears for 3 dollars each. How many fruits does Anna have at the end of the long day?"


def clashing(df, *names):
    """df with columns of these names, holding what must come back unchanged."""
    return df.select("*", *(F.concat(F.lit(f"{n}:"), F.coalesce(F.col("text"), F.lit("")).substr(1, 9)).alias(n) for n in names))


def unchanged(df, *names):
    return all(r[n] == f"{n}:{(r['text'] or '')[:9]}" for r in df.collect() for n in names)


# ---- decontamination


def test_rows_of_one_doc_id_are_judged_by_their_own_text(spark):
    items = spark.createDataFrame([(0, ITEM)], "item_id long, text string")
    half = len(ITEM.split()) // 2
    parts = [" ".join(ITEM.split()[:half]), " ".join(ITEM.split()[half:])]
    rows = [(None, ITEM), (None, "clean"), (5, ITEM), (5, "clean too"), (6, "clean"), (None, None), *((None, p) for p in parts), *((7, p) for p in parts)]
    names = ("_held", "_t1", "_t2", "row", "x0", "doc", "item")
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"), *names)
    kept = decontamination.decontaminate(df, items)
    assert kept.columns == df.columns and unchanged(kept, *names)
    short = lambda found: Counter((r["doc_id"], r["text"]) for r in found)
    whole = {i for i, p in enumerate(parts) if decontamination.contaminated(spark.createDataFrame([(1, p)], "doc_id long, text string"), items).count()}
    want = [r for r in rows if r[1] != ITEM and not (r[1] in parts and parts.index(r[1]) in whole)]
    assert short(kept.collect()) == Counter(want)


@pytest.mark.parametrize(("old", "new"), [("Anna", "Mary Ann"), ("12", "1 200"), ("Anna", "Ann Lou Mae")])
def test_values_of_another_length(spark, old, new):
    items = spark.createDataFrame([(0, "so " + ITEM), (1, "Then did Anna sell 12 of the red plums")], "item_id long, text string")
    texts = ["we say so " + ITEM.replace(old, new), "now this. Then did Anna sell 12 of the red plums. ".replace(old, new), "nothing of the kind is here"]
    got = decontamination.contaminated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), items)
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == [(0, 0), (1, 1)]


def test_limits_are_parameters(spark):
    items = spark.createDataFrame([(0, "one two"), (1, "1 2 3 apples and 4 5 6 pears")], "item_id long, text string")
    df = spark.createDataFrame([(0, "so one two three"), (1, "we have 7 apples, 9; 8 pears")], "doc_id long, text string")
    assert decontamination.contaminated(df, items).count() == 0
    assert [r["doc_id"] for r in decontamination.contaminated(df, items, shortest=1).collect()] == [0]


# ---- mixing


def taken_of(docs, **more):
    return sum(r["taken"] for r in mixing.balance(docs, **more).collect())


@pytest.mark.parametrize("bucket", [1, 4, 512])
def test_mix_is_exact_on_null_and_repeated_ids(spark, monkeypatch, bucket):
    """Source a has 600 rows of 10 words without an id, in four texts; source b has as many of one id."""
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    text = lambda i: " ".join([f"t{i}"] * 10)
    rows = [(None, text(i % 4), "a") for i in range(600)] + [(7, text(9), "b") for _ in range(300)] + [(None, None, "a"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.balance(docs).collect()
    for target in {r["target"] for r in got if r["target"]}:
        assert abs(sum(r["taken"] for r in got if r["target"] == target) - target) <= 10
    assert len(got) == len(rows) and max(r["copies"] for r in got) <= 3
    names = ("_k", "_copy", "key", "size", "h", "row", "copies", "part")
    wide = clashing(docs, *names)
    out = mixing.mix(wide)
    assert out.columns == wide.columns and unchanged(out, *names)
    want = Counter()
    for r in got:
        want[r["doc_id"], r["size"], r["target"]] += r["copies"]
    sizes = Counter((r["doc_id"], len((r["text"] or "").split()), r["source"]) for r in out.collect())
    assert sum(sizes.values()) == sum(want.values())
    assert {s: n for (_, s, _), n in sizes.items() if s == 0} and sizes[7, 10, "b"] == sum(n for (d, *_), n in want.items() if d == 7)


def test_copies_follow_the_least_hashes(spark, monkeypatch):
    """Brute force of the rounding: in each group the rows of least (hash, text key) have the extra copies."""
    monkeypatch.setattr(mixing, "BUCKET", 8)
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, "w " * rng.choice([3, 5, 40]), rng.choice("aab")) for i in range(700)], "doc_id long, text string, source string")
    named = mixing.balance(docs).join(docs.select("doc_id", "source", F.xxhash64("doc_id").alias("h")), "doc_id").collect()
    groups = {}
    for r in named:
        groups.setdefault((r["source"], r["size"]), []).append((r["h"], r["copies"]))
    assert any(len({c for _, c in g}) > 1 for g in groups.values())
    for g in groups.values():
        copies = [c for _, c in sorted(g)]
        assert copies == sorted(copies, reverse=True) and copies[0] - copies[-1] <= 1


def test_a_plan_that_is_not_broadcast_gives_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "ab"[i % 2]) for i in range(300)], "doc_id long, text string, source string")
    want = Counter(map(tuple, mixing.balance(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_GROUPS", 0)
    assert Counter(map(tuple, mixing.balance(docs).collect())) == want


def test_targets_out_of_reach_raise(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ITERATIONS", 1)
    docs = spark.createDataFrame([(i, "w " * (1 + i % 50), "ab"[i % 2]) for i in range(300)], "doc_id long, text string, source string")
    with pytest.raises(ArithmeticError, match="targets"):
        mixing.balance(docs)


# ---- near-duplicates


@pytest.mark.parametrize("bound", [0, 1_000_000])
def test_keep_one_goes_by_the_row_s_own_text(spark, monkeypatch, bound):
    monkeypatch.setattr(dedup, "BROADCAST_IDS", bound)
    text = lambda i, n=60: " ".join(PROSE[i * 70 : i * 70 + n])
    near = lambda i: text(i, 59) + " other"
    rows = [
        (None, text(0)), (None, near(0)),  # near copies without ids: one stays
        (1, text(1)), (5, near(1)), (5, text(2)),  # the copy goes, the other text of its id stays
        (6, text(3)), (6, text(3)), (6, text(3)),  # one row three times
        (9, text(4)), (None, text(4)), (None, None), (None, ""), (9, None),
    ]
    names = ("_id", "_t1", "row", "x0", "label", "node")
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"), *names)
    kept = dedup.keep_one(df)
    assert kept.columns == df.columns and unchanged(kept, *names)
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert sum(got[None, t] for t in (text(0), near(0))) == 1
    got = Counter({k: n for k, n in got.items() if k[1] not in (text(0), near(0))})
    assert got == Counter([(1, text(1)), (5, text(2)), (6, text(3)), (9, text(4)), (None, None), (None, ""), (9, None)])


def test_salted_lists_find_every_link(spark, monkeypatch):
    """Lists of all members, dealt by salts of three: against all pairs."""
    from .test_ops import component_oracle, rows_of

    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(2000)]
    base, other = ([rng.choice(vocabulary) for _ in range(80)] for _ in range(2))
    texts = []
    for origin in (base, other):
        for _ in range(50):
            copy = list(origin)
            for _ in range(rng.choice([1, 2, 3, 5])):
                copy[rng.randrange(80)] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    monkeypatch.setattr(dedup, "LIST", 4)
    monkeypatch.setattr(dedup, "CHUNK", 3)
    got = Counter(map(tuple, dedup.near_duplicates(df, 80).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == component_oracle(rows_of(df), 80)


# ---- quality


@pytest.mark.parametrize("bound", [0, 1_000_000])
def test_quality_returns_the_user_s_columns(spark, monkeypatch, bound):
    monkeypatch.setattr(quality, "BROADCAST_REJECTED", bound)
    rows = [(i, " ".join(PROSE[i : i + 60]), "en", "a") for i in range(80)] + [(None, "short", None, None), (None, " ".join(PROSE[:70]), None, "a"), (3, None, "en", None)]
    names = ("_l", "_m", "_n_words", "_kept", "_t1", "row", "x0", "low", "_lang")
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), *names)
    kept = quality.filter_quality(df)
    assert kept.columns == df.columns and unchanged(kept, *names)
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([*range(80), None])


# ---- WARC


def pages_of(spark, n=300):
    return spark.createDataFrame([(i, f"http://x/{i}", "<p>" + "y" * (i % 30)) for i in range(n)], "page_id long, url string, html string")


def test_a_lost_record_is_one_missing_record(spark):
    sound = warc.leaves(warc.records(pages_of(spark), files=1)).cache()
    fields = "file int, record_id long, uri string, length long, hash string, seq long, offset long"
    rows = [tuple(r[c] for c in ("file", "record_id", "uri", "length", "hash")) for r in sound.orderBy("seq").collect()]

    def laid(kept):
        out, at = [], 0
        for seq, r in enumerate(kept):
            out.append((*r, seq, at))
            at += r[3]
        return spark.createDataFrame(out, fields)

    def found(kept):
        return sorted((r["record_id"], r["seq"], r["status"], r["hash_a"], r["hash_b"]) for r in warc.audit(sound, laid(kept)).collect())

    assert found(rows) == []
    assert found(rows[:10] + rows[11:]) == [(10, 10, "missing", rows[10][4], None)]
    more = (0, 999, "http://new", 50, "f" * 64)
    assert found(rows[:10] + [more] + rows[10:]) == [(999, 10, "extra", None, "f" * 64)]
    changed = (*rows[20][:4], "e" * 64)
    assert found(rows[:10] + rows[11:20] + [changed] + rows[21:] + [more]) == [(10, 10, "missing", rows[10][4], None), (20, 20, "changed", rows[20][4], "e" * 64), (999, 299, "extra", None, "f" * 64)]
    assert found(rows + [rows[5]]) == [(5, 300, "extra", None, rows[5][4])], "a repeated record is one of its own"
    assert len(found([])) == 300


def test_hashes_and_tree_by_hand(spark):
    made = warc.records(pages_of(spark), files=2).withColumns({"seq": F.lit("clash"), "hash": F.lit("clash")})
    leaf = warc.leaves(made)
    levels = warc.tree(leaf)
    assert len(levels) == 3
    records = {r["record_id"]: bytes(r["record"]) for r in made.collect()}
    for file in (0, 1):
        rows = sorted((r["seq"], r["offset"], r["length"], r["record_id"], r["hash"]) for r in leaf.where(F.col("file") == file).collect())
        assert [r[4] for r in rows] == [hashlib.sha256(records[r[3]]).hexdigest() for r in rows]
        nodes, at = [], 0
        for _, offset, length, _, digest in rows:
            assert offset == at and length == len(records[rows[len(nodes)][3]])
            at += length
            nodes.append((offset, at, digest))
        for level in levels:
            have = sorted((r["idx"], r["start"], r["end"], r["hash"]) for r in level.where(F.col("file") == file).collect())
            assert have == [(i, *n) for i, n in enumerate(nodes)]
            groups = [nodes[i : i + warc.FAN] for i in range(0, len(nodes), warc.FAN)]
            nodes = [(g[0][0], g[-1][1], hashlib.sha256(";".join(f"{a}:{b}:{h}" for a, b, h in g).encode()).hexdigest()) for g in groups]


def test_damaged_files_raise(spark, tmp_path):
    made = warc.records(pages_of(spark, 4), files=1)
    warc.write_warc(made, str(tmp_path / "w"))
    data = next((tmp_path / "w").glob("part-*")).read_bytes()
    for name, bad in (("cut", data[:-9]), ("head", b"X" + data), ("size", data.replace(b"Content-Length", b"Content-Lngth", 1))):
        (tmp_path / name).write_bytes(bad)
        with pytest.raises(Exception, match="byte"):
            warc.read_warc(spark, str(tmp_path / name)).count()


# ---- language


def slice_of(*texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)])


def test_cosine_by_hand(spark):
    """Trigram by trigram in plain Python."""
    texts = ["The cat sat on the mat", "le chat est là", "日本語の文", "Ab1c ü"]
    row, which, letters, _ = langid.trigrams(*slice_of(*texts))
    got = langid.bundled(row, which, letters, len(texts))
    for i, text in enumerate(texts):
        runs, want = "", np.zeros(langid.DIMENSIONS, dtype=np.int64)
        for ch in text.lower():
            runs += ch if ch.isalpha() else ("" if runs.endswith("\0") else "\0")
        runs = "\0" + runs.lstrip("\0")
        for a, b, c in zip(runs, runs[1:], runs[2:], strict=False):
            if b != "\0":
                x, y, z = (langid.letter_vector(0 if q == "\0" else ord(q)).astype(np.int64) for q in (a, b, c))
                want += np.roll(x, 2) * np.roll(y, 1) * z
        assert (got[i] == want).all(), text


def test_vectors_of_many_trigrams_are_worked_off_in_parts(monkeypatch):
    rng = np.random.default_rng(1)
    text = "".join(map(chr, rng.integers(0x4E00, 0x9FA5, 1_000_000)))
    row, which, letters, _ = langid.trigrams(*slice_of(text, "short one"))
    assert len(letters) > 900_000
    tracemalloc.start()
    got = langid.bundled(row, which, letters, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6, "all vectors at once would be 4 GB"
    monkeypatch.setattr(langid, "PART", 1 << 16)
    assert np.allclose(langid.bundled(row, which, letters, 2), got)


def test_slices_hold_whole_documents():
    import pyarrow as pa

    texts = ["a" * 10, None, "b" * (3 << 20), "c"]
    assert [(a, b) for a, b, _, _ in scan.slices(pa.array(texts))] == [(0, 2), (2, 3), (3, 4)]


def test_texts_reach_workers_in_small_batches_and_slices(spark, monkeypatch):
    """What failed at size: an executor's memory ran over where whole texts went to Python workers."""
    import pyarrow as pa

    from pairwright.llm import common

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen, cut = spark.conf.get(name), {}, dedup.cut
    monkeypatch.setattr(dedup, "cut", lambda df, tag: (seen.setdefault(tag, spark.conf.get(name)), cut(df, tag))[1])
    rows = dedup.near_duplicates(spark.createDataFrame([(i, f"a b c d e f {i % 3}") for i in range(9)], "doc_id long, text string"))
    assert rows.count() == 9 and (seen["sketches"], seen["sets"], spark.conf.get(name)) == (str(common.TEXTS), str(common.TEXTS), before)
    with common.small_batches(spark):
        assert max(r["n"] for r in spark.range(0, 3500, 1, 1).mapInArrow(sizes, "n long").collect()) == common.TEXTS
    texts = [" ".join(f"w{i * k % 977}" for k in range(400)) for i in range(2500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2500)), pa.array(texts), pa.array([0] * 2500), pa.array([0] * 2500)], names=["doc_id", "text", "_t1", "_t2"])
    tracemalloc.start()
    assert sum(len(b) for b in dedup._scan(dedup.SKETCH)([batch])) == 2500
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6, "slices of 1 MB took twice that"
