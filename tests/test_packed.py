"""Pairs as packed numbers against the plain forms, over slices, parts and chunks of any size."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright.functions.text import postings, token_sets
from pairwright.operators import blocking, cleaning, edits, evaluate, matching, packed, pairs, ranking, truth, weighting

SCHEMA = "ds int, id long, seq long, text string"


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def source(spark):
    """Common and rare words, copies, texts without words; ids of any sign and size, and some arrivals at the same time."""
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(150)] + ["", "?!", None] + ["w1 w2 w3 same"] * 30
    ids = rng.sample([*range(-100, 400), *range(2**40, 2**40 + 100)], len(texts))
    return spark.createDataFrame([(0, i, k // 3, t) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], SCHEMA).repartition(5)


@pytest.mark.parametrize("size, chunk, bits", [(1_000_000, 32_000_000, 4096), (50, 300, 64)])
@pytest.mark.parametrize("mean", [False, True])
def test_same_pairs_and_common_tokens(source, monkeypatch, size, chunk, bits, mean):
    monkeypatch.setattr(packed, "SLICE", size)
    monkeypatch.setattr(packed, "CHUNK", chunk)
    monkeypatch.setattr(packed, "BITS", bits)
    kept = blocking.capped(postings(source), 12)
    cbs = pairs.common_blocks(pairs.dirty_pairs(kept))
    cbs = cleaning.above_mean(cbs) if mean else cbs
    found = packed.blocks(source, 12)
    assert rows(packed.common_blocks(found, mean).select("e1", "e2", "cbs")) == rows(cbs) != []
    got = packed.common_tokens(source, found, 12, mean).withColumns({"js": packed.jaccard(), "ov": packed.overlap(), "w": packed.weight()})
    both = weighting.jaccard_of_blocks(pairs.with_tokens(cbs, token_sets(source)), kept).select("e1", "e2", "w")
    want = matching.scored(pairs.with_tokens(cbs, token_sets(source)), "js").withColumns({"js": F.col("sim"), "ov": matching.overlap()}).join(both, ["e1", "e2"])
    columns = ["e1", "e2", "cbs", F.round("js", 9), F.round("ov", 9), F.round("w", 9)]
    assert rows(got.select(columns)) == rows(want.select(columns))


def test_numbers_of_any_width_come_back():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**62], np.int64)
    data, width = packed.encoded(values)
    back, starts = packed.decoded(data)
    assert back.tolist() == values.tolist() and starts.tolist() == (np.cumsum(width) - width).tolist()
    run = np.array([-(2**40), -3, -3, 9, 2**50, -7, 0, 2**60], np.int64)
    first = np.array([1, 0, 0, 0, 0, 1, 0, 0], bool)
    assert packed.summed(packed.differences(run, first), first).tolist() == run.tolist()


def test_pairs_travel_without_token_arrays(spark, tables):
    """What failed at size: the scored pairs' joins shuffled both token arrays of each pair."""
    from pairwright.plans.catalogue import QUERIES

    for name in ("jaccard_match", "overlap_match"):
        plan = QUERIES[name](spark, tables)._jdf.queryExecution().executedPlan().toString()
        assert "array_intersect" not in plan and "Join" not in plan, name


@pytest.mark.parametrize("size", [1_000_000, 7])
def test_true_pairs_among_blocks(spark, monkeypatch, size):
    """Classes beyond the cap, near classes, random sets: all pairs, and those that share a block, against plain Python."""
    monkeypatch.setattr(packed, "SLICE", size)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(20)]
    texts = [" ".join(rng.sample(base, 20)) for _ in range(30)] + [" ".join([*base[:19], f"x{i % 3}"]) for i in range(40)]
    texts += [" ".join(rng.sample("abcdefghijkl", rng.randint(1, 8))) for _ in range(80)] + ["", "", "?!", None]
    rng.shuffle(texts)
    sets = [set((t or "").replace("?!", "").split()) for t in texts]
    source = spark.createDataFrame([(0, i, i, t) for i, t in enumerate(texts)], SCHEMA).repartition(4)
    every = truth.Truth(source.select("id", "text"), 0.8)
    near = lambda i, j: (sets[i] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8) or (texts[i] is not None and texts[i] == texts[j])
    want = [(i, j) for j in range(len(texts)) for i in range(j) if near(i, j)]
    assert rows(every.pairs().select("e1", "e2")) == want or rows(every.pairs().select("e1", "e2")) == sorted(want)
    assert every.count() == len(want)
    cbs = pairs.common_blocks(pairs.dirty_pairs(blocking.capped(postings(source), 8)))
    both = {(r["e1"], r["e2"]) for r in cbs.collect()}
    got = rows(every.among(packed.blocks(source, 8), 8))
    assert got == sorted(p for p in want if p in both) != sorted(want)


def test_curve_without_sorting_all_pairs(spark, monkeypatch):
    """Few weights, so nearly all pairs tie; against the sorted form."""
    rng = random.Random(11)
    drawn = sorted({(rng.randrange(40), rng.randrange(40, 80)) for _ in range(600)})
    weighed = spark.createDataFrame([(*p, rng.choice([0.25, 0.5, 0.75, 1 / 3])) for p in drawn], "e1 long, e2 long, w double").repartition(3)
    true = spark.createDataFrame([*rng.sample(drawn, 90), (0, 999)], "e1 long, e2 long")
    mine = rows(evaluate.recall_curve_of(weighed, true, 91))
    order = ranking.ranked(weighed, F.desc("w"), F.col("e1"), F.col("e2"))[0]
    assert mine == rows(evaluate.recall_curve(order, true, 91)) and len(mine) == 90
    monkeypatch.setattr(evaluate, "BROADCAST_PAIRS", 10)
    assert rows(evaluate.recall_curve_of(weighed, true, 91)) == mine


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("size, chunk, linked", [(1_000_000, 32_000_000, 1_000_000), (50, 300, 20)])
@pytest.mark.parametrize("mean", [False, True])
def test_edits_of_the_same_pairs(source, monkeypatch, size, chunk, linked, mean):
    monkeypatch.setattr(packed, "SLICE", size)
    monkeypatch.setattr(packed, "CHUNK", chunk)
    monkeypatch.setattr(packed, "LINKED", linked)
    found, text = packed.blocks(source, 12), {r["id"]: r["tokens"] for r in token_sets(source).collect()}
    got = rows(packed.edit_distances(source, found, 12, mean))
    assert [r[:2] for r in got] == rows(packed.common_blocks(found, mean).select("e1", "e2")) != []
    assert got == [(a, b, _edits(text[a], text[b]), len(text[a]), len(text[b])) for a, b, *_ in got]


@pytest.mark.parametrize("tokens, abreast", [(1 << 16, 1 << 16), (40, 64)])
@pytest.mark.parametrize("words, least", [(30, 0), (1000, 0), (40_000, 33_000)])
def test_edits_of_sequences_of_any_length(monkeypatch, tokens, abreast, words, least):
    monkeypatch.setattr(edits, "TOKENS", tokens)
    monkeypatch.setattr(edits, "ABREAST", abreast)
    rng = np.random.default_rng(words)
    most = 30 if least == 0 else 3
    late = np.sort(rng.choice(words, int(rng.integers(least, words)), replace=False))
    early = [np.sort(rng.choice(words, int(rng.integers(0, min(words, 200))), replace=False)) for _ in range(most)] + [late[late % 9 > 0][:200], late[:1]]
    size = np.array([len(x) for x in early])
    ends = np.cumsum(size)
    links = edits.Finder(words).links(late + 1, np.concatenate(early).astype(np.int32) + 1, ends - size, ends)
    got = edits.distances(*links, size, np.full(len(size), len(late)))
    if least:  # too long for a plain table
        assert all(len(late) - np.isin(e, late).sum() <= g <= len(late) for g, e in zip(got, early, strict=True))
        assert got[-2:].tolist() == [len(late) - 200, len(late) - 1]
    else:
        assert got.tolist() == [_edits(e.tolist(), late.tolist()) for e in early]


def test_edit_distances_travel_without_token_arrays(spark, tables):
    from pairwright.plans.catalogue import QUERIES

    plan = QUERIES["edit_distance_match"](spark, tables)._jdf.queryExecution().toString()
    assert "Join" not in plan and "array_intersect" not in plan
