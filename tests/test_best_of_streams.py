"""Streams under a budget queue only what it can still let out; counted streams store no pairs. Against the plain forms."""

import random

import pytest
from pyspark.sql import functions as F

from pairwright.operators import evaluate
from pairwright.sources import profiles
from pairwright.streaming import incremental, progressive, sides
from pairwright.streaming.policy import Fixed

SCHEMA = "ds int, id long, seq long, text string"
COLUMNS = ("request", "rank", "e1", "e2", "w", "cbs", "node_ds", "node", "increment")


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def texts(rng, n, most=6):
    words = [f"t{int(rng.paretovariate(0.7))}" for _ in range(400)]
    return [" ".join(rng.choices(words, k=rng.randint(0, most))) if i % 17 else None for i in range(n)]


@pytest.fixture(scope="module")
def source(spark):
    rng = random.Random(14)
    return spark.createDataFrame([(0, i, i, t) for i, t in enumerate(texts(rng, 70, 12))], SCHEMA).repartition(3).cache()


def both_forms(monkeypatch, source, size, settings, k):
    mine = rows(progressive.run(source, size, settings, Fixed(k)), *COLUMNS)
    with monkeypatch.context() as plain:
        plain.setattr(progressive.Progressive, "few", property(lambda self: False))
        want = rows(progressive.run(source, size, settings, Fixed(k)), *COLUMNS)
    return mine, want


@pytest.mark.parametrize(("options", "k"), [({"weighting": "js"}, 15), ({"prioritizer": "ilsps", "cleaning": "hs"}, 15)])
def test_the_best_of_one_source(source, monkeypatch, options, k):
    """What failed at size: all pairs of a batch were made as rows with their tokens, and all that wait were written at each request."""
    settings = progressive.Settings(**({"cap": 6, "budget": 60} | options))
    state = progressive.Progressive(source.sparkSession, settings, Fixed(k))
    for number in range(2):
        state.step(source.where(F.floor(F.col("seq") / 35) == number), number)
    assert state.queue.of(1).count() <= 60 - 2 * k
    mine, want = both_forms(monkeypatch, source, 25, settings, k)
    assert mine == want and len(mine) > 20


@pytest.mark.parametrize(("n1", "n2", "rho", "clean"), [(60, 12, 0.5, "wnp2"), (12, 60, 0.15, "hs"), (30, 30, 0.1, "wnp2")])
def test_the_best_of_two_sources(spark, monkeypatch, n1, n2, rho, clean):
    """What failed at size: a token's block was joined with itself, so that its pairs within each source were tried too."""
    rng = random.Random(n1 + n2)
    one, two = (spark.createDataFrame([(0, i, i, t) for i, t in zip(sorted(rng.sample(range(70), n)), texts(rng, n, 9), strict=True)], SCHEMA) for n in (n1, n2))
    source = profiles.interleave(one, two).repartition(3).cache()
    monkeypatch.setattr(sides, "CELLS", 50)
    settings = progressive.Settings(cap=6, sizes=(n1, n2), rho=rho, cleaning=clean, budget=90)
    mine, want = both_forms(monkeypatch, source, 50, settings, 30)
    assert mine == want != []


def test_pairs_of_two_sources_are_met_side_by_side(spark):
    kept = spark.createDataFrame([("a", 0, i, 2 * i, 0) for i in range(5)] + [("a", 1, i, 2 * i + 1, 0) for i in range(2)], "token string, ds int, id long, seq long, c long")
    met = incremental.Blocks(spark, 0, (5, 2), 10).pairs(kept, 0)
    assert rows(met, "e1", "e2", "node_ds") == sorted((a, b, int(2 * b + 1 > 2 * a)) for a in range(5) for b in range(2))
    assert "NOT (ds" not in met._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("most", [500_000, 3])
def test_a_counted_stream_stores_no_pairs(source, monkeypatch, most):
    monkeypatch.setattr(evaluate, "BROADCAST_PAIRS", most)
    found = incremental.run(source, 20, 6)
    true = found.where("(e1 + e2) % 7 = 0").select("e1", "e2").union(source.sparkSession.createDataFrame([(900, 901), (0, 901)], "e1 long, e2 long")).cache()
    want = evaluate.flagged(found, true).groupBy("increment").agg(F.count(F.lit(1)).alias("comparisons"), F.sum("hit").alias("found"))
    monkeypatch.setattr(incremental, "Incremental", None)
    got = incremental.measured(source, 20, 6, true)
    assert rows(got, "increment", "comparisons", "found") == rows(want, "increment", "comparisons", "found") and got.count() == 4
    assert incremental.measured(source.limit(0), 20, 6, true.limit(0)).count() == 0
