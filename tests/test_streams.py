"""Progressive streams, their state, and the operators that are chosen by name."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairwright.functions.text import postings, rounded, token_sets
from pairwright.operators import blocking, cleaning, clustering, evaluate, matching, pairs, prioritize, weighting
from pairwright.plans import pipeline
from pairwright.sources import profiles, sinks
from pairwright.streaming import entity_queue, exact, incremental, progressive
from pairwright.streaming.policy import Adaptive, Fixed

SCHEMA = "ds int, id long, seq long, text string"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def source(spark):
    rng = random.Random(4)
    words = [f"t{i}" for i in range(25)]
    return spark.createDataFrame([(0, i, i, " ".join(rng.sample(words, rng.randint(1, 5)))) for i in range(24)], SCHEMA).cache()


@pytest.fixture(scope="module")
def two(spark):
    rng = random.Random(6)
    text = lambda: " ".join(["the", *rng.sample([f"t{i}" for i in range(12)], rng.randint(1, 4))])
    one = spark.createDataFrame([(0, i, i, text()) for i in range(24)], SCHEMA)
    other = spark.createDataFrame([(0, i, i, text()) for i in range(9)], SCHEMA)
    return profiles.interleave(one, other).cache()


def sequential_two(profiles_, rho, n1, n2):
    """The index of two sources, arrival by arrival: kept postings (token, ds, id)."""
    sides, banned, kept = {}, set(), []
    for ds, i, _, text in sorted(profiles_, key=lambda r: r[2]):
        for token in set(text.split()):
            if token in banned:
                continue
            held = sides.setdefault(token, [0, 0])
            c = held[1 - ds]
            if c >= 1 and c + 1 >= rho * (n1 if ds == 0 else n2):
                banned.add(token)
                continue
            held[ds] += 1
            kept.append((token, ds, i))
    return sorted(kept)


@pytest.mark.parametrize("rho", [0.05, 0.2, 0.4, 10])
def test_two_sided_limit_against_the_sequential_index(spark, two, rho):
    every = [tuple(r) for r in two.select("ds", "id", "seq", "text").collect()]
    want = sequential_two(every, rho, 24, 9)
    assert rows(blocking.capped_two(postings(two), rho, 24, 9), "token", "ds", "id") == want
    state = incremental.Blocks(spark, 0, (24, 9), rho)
    for number, (low, high) in enumerate(((0, 7), (7, 20), (20, 99))):
        state.add(two.where(F.col("seq").between(low, high - 1)), number)
    assert rows(state.postings.all(3), "token", "ds", "id") == want


@pytest.mark.parametrize(("size", "weighting_name"), [(9, "js"), (100, "bjs")])
def test_a_stream_without_limits_gives_the_batch_s_pairs(source, size, weighting_name):
    config = pipeline.Config(cap=6, weighting=weighting_name, increment=size, matcher="js")
    got = pipeline.progressive_streaming(source, config, Fixed(10_000))
    want = pipeline.progressive(source, config)
    take = lambda df: rows(df.select("e1", "e2", rounded("w").alias("w"), rounded("sim").alias("sim")), "e1", "e2", "w", "sim")
    assert take(got) == take(want)


@pytest.mark.parametrize("name", progressive.ORDERS)
def test_requests_take_the_best_of_what_waits(source, name):
    config = pipeline.Config(cap=6, increment=8, prioritizer=name, cleaning="hs", matcher="no")
    got = pipeline.progressive_streaming(source, config, Fixed(16)).collect()
    every = rows(pipeline.progressive(source, pipeline.Config(cap=6, cleaning="hs")), "e1", "e2")
    assert len({(r["e1"], r["e2"]) for r in got}) == len(got)
    counts = Counter(r["request"] for r in got)
    assert max(counts.values()) <= 16 and set(counts) == set(range(max(counts) + 1))
    assert all(r["increment"] <= r["request"] for r in got), "no pair goes out before its later end arrived"
    if name == "ilsps":
        assert all(r["increment"] == min(r["request"], 2) for r in got)
    else:
        assert sorted((r["e1"], r["e2"]) for r in got) == every
    if name in ("icps", "iacps"):
        open_ = {(r["e1"], r["e2"]): (-r["w"], r["e1"], r["e2"], r["increment"]) for r in got}
        for request in sorted(counts):
            best = sorted(v for v in open_.values() if v[3] <= request)[:16]
            mine = [(r["e1"], r["e2"]) for r in sorted(got, key=lambda r: r["rank"]) if r["request"] == request]
            assert mine == [(e1, e2) for _, e1, e2, _ in best]
            for pair in mine:
                del open_[pair]


def test_budget_bound_fallback_and_two_sources(source, two):
    config = pipeline.Config(cap=6, increment=12, cleaning="wnp", matcher="no")
    every = pipeline.progressive(source, pipeline.Config(cap=6, cleaning="hs")).count()
    clean = pipeline.progressive(source, pipeline.Config(cap=6, cleaning="wnp")).count()
    assert 0 < clean < every
    assert pipeline.progressive_streaming(source, pipeline.Config(cap=6, increment=12, budget=13, matcher="no"), Fixed(5)).count() == 13
    assert pipeline.progressive_streaming(source, config, Fixed(100), fallback=True).count() == every
    assert pipeline.progressive_streaming(source, config, Fixed(3), bound=2).count() <= 2 * 3 + 2
    assert pipeline.progressive_streaming(source, config, Fixed(100), seconds=0).count() == 0
    found = pipeline.progressive_streaming(two, pipeline.Config(mode="clean_clean", rho=10, cleaning="hs", increment=24), Fixed(500))
    batch = pipeline.progressive(two, pipeline.Config(mode="clean_clean", rho=10, cleaning="hs"))
    assert rows(found, "e1", "e2", "w", "sim") == rows(batch, "e1", "e2", "w", "sim")


def test_adaptive_policy_is_fed_by_the_stream(source):
    policy = Adaptive()
    found = pipeline.progressive_streaming(source, pipeline.Config(cap=6, increment=8, matcher="no", budget=12), policy)
    assert found.count() == 12 and len(policy.arrivals) == 2 and len(policy.services) == 3 and policy.ended


def test_a_throttled_stream_gives_the_same(source):
    config = pipeline.Config(cap=6, increment=15, matcher="no")
    columns = ("request", "rank", "e1", "e2")
    assert rows(pipeline.progressive_streaming(source, config, Fixed(50), every="100 milliseconds"), *columns) == rows(pipeline.progressive_streaming(source, config, Fixed(50)), *columns)


def test_a_batch_that_was_half_written_is_written_anew(spark, source):
    """A run that failed after part of its postings and pairs were written."""
    want = rows(incremental.run(source, 12, 6), "e1", "e2", "cbs", "increment")
    state = incremental.Incremental(spark, 6)
    first, second = source.where("seq < 12"), source.where("seq >= 12")
    state.step(first, 0)
    for table in (state.blocks.postings, state.blocks.counts, state.out):
        table.write(table.of(0).limit(1), 1)
    state.step(second, 1)
    state.step(second, 1)
    assert rows(state.pairs(), "e1", "e2", "cbs", "increment") == want
    again = progressive.Progressive(spark, progressive.Settings(cap=6, cleaning="hs"), Fixed(5))
    again.step(first, 0)
    again.step(second, 1)
    once = rows(again.pairs(), "request", "rank", "e1", "e2")
    again.step(second, 1)
    again.requests = 2
    assert rows(again.pairs(), "request", "rank", "e1", "e2") == once and sum(again.sent.values()) == 10


def test_an_empty_stream(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pipeline.progressive_streaming(empty, pipeline.Config(matcher="no")).count() == 0
    assert incremental.run(empty, 5, 6).count() == 0


# ---- the sequential queue


def test_entity_queue_by_hand():
    queue = entity_queue.EntityQueue()
    queue.update([(0, 1, 0.4), (0, 2, 0.9)])  # the mean is 0.65: (0, 1) goes
    assert queue.take(1) == [(0, 2)] and queue.empty()
    queue = entity_queue.EntityQueue(pruning=False)
    queue.update([(0, 1, 0.5)])  # beats 0
    queue.update([(0, 2, 0.3)])  # beats 2 only
    queue.update([(1, 2, 0.2)])  # beats 1, whose queue is empty
    queue.update([(0, 3, 0.8)])
    assert queue.take(10) == [(0, 3), (0, 1), (0, 2), (1, 2)] and queue.empty()


def test_every_pair_comes_out_once(spark, monkeypatch):
    rng = random.Random(1)
    every = [(a, b, rng.random()) for b in range(30) for a in range(b) if rng.random() < 0.4]
    df = spark.createDataFrame(every, "e1 long, e2 long, w double").repartition(3)
    queue = entity_queue.EntityQueue(pruning=False)
    for b in range(30):
        queue.update([p for p in every if p[1] == b])
    out = []
    while not queue.empty():
        out += queue.take(7)
    assert sorted(out) == sorted((a, b) for a, b, _ in every)
    got = entity_queue.fold(df, 10, 7)
    assert rows(got, "request", "rank", "e1", "e2") == rows(entity_queue.fold(df.repartition(2), 10, 7), "request", "rank", "e1", "e2")
    assert {(r["e1"], r["e2"]) for r in got.collect()} <= {(a, b) for a, b, _ in every}
    monkeypatch.setattr(entity_queue, "MOST", 10)
    with pytest.raises(ValueError, match="more than"):
        entity_queue.fold(df, 10, 7)


def test_the_ghosting_fold_is_bounded(source, monkeypatch):
    monkeypatch.setattr(exact, "MOST", 10)
    with pytest.raises(ValueError, match="more than"):
        exact.exact_pairs(token_sets(source), 6, 0.1)


# ---- choice by name


@pytest.mark.parametrize("field", [{"prioritizer": "best"}, {"weighting": "x"}, {"cleaning": "x"}, {"matcher": "x"}, {"blocker": "x"}, {"mode": "x"}, {"cleaning": "batch:x"}])
def test_unknown_names_raise(source, field):
    with pytest.raises(ValueError):
        pipeline.progressive(source, pipeline.Config(cap=6, **field)).count()


@pytest.mark.parametrize("field", [{"prioritizer": "x"}, {"weighting": "arcs"}, {"cleaning": "x"}, {"blocker": "tb"}])
def test_streams_refuse_what_they_lack(source, field):
    with pytest.raises(ValueError):
        pipeline.progressive_streaming(source, pipeline.Config(**field))


def test_every_name_orders_all_pairs(source):
    every = set(rows(pipeline.progressive(source, pipeline.Config(cap=6, cleaning="hs")), "e1", "e2"))
    for name in ["icps", "iacps", "no", "pltc", "pes", "pps", "tm", "etm", "ipbs4", "pbs", "ilsps", "rblk", "rcmp"]:
        got = rows(pipeline.progressive(source, pipeline.Config(cap=6, cleaning="hs", prioritizer=name, matcher="no")), "e1", "e2")
        assert len(set(got)) == len(got) and set(got) <= every, name
        if name not in ("pltc", "pes", "cepcnpent", "pps", "rblk"):
            assert set(got) == every, name


@pytest.mark.parametrize("name", ["js", "ncbs", "cbs_max", "arcs"])
def test_every_weighting_has_all_pairs(source, two, name):
    for src, mode in ((source, "dirty"), (two, "clean_clean")):
        config = pipeline.Config(cap=6, rho=10, mode=mode, cleaning="hs", weighting=name, matcher="no")
        plain = pipeline.Config(cap=6, rho=10, mode=mode, cleaning="hs", matcher="no")
        if mode == "clean_clean" and name in ("ncbs", "cbs_max"):
            continue
        assert rows(pipeline.progressive(src, config), "e1", "e2") == rows(pipeline.progressive(src, plain), "e1", "e2")


def test_blockers_by_name(source):
    base = pipeline.progressive(source, pipeline.Config(cap=6, cleaning="hs", matcher="no")).count()
    assert pipeline.progressive(source, pipeline.Config(blocker="tb", cleaning="hs", matcher="no")).count() >= base
    assert pipeline.progressive(source, pipeline.Config(cap=6, blocker="etbr", beta=0.6, cleaning="hs", matcher="no")).count() < base


def test_block_lookups(spark, source):
    kept = blocking.capped(postings(source), 6)
    tokens = spark.createDataFrame([("t1",), ("t1",), ("none",)], "token string")
    want = rows(kept.where("token = 't1'"), "id")
    assert rows(blocking.blocks_of(kept, tokens), "id") == want
    assert rows(blocking.models_of(token_sets(source), kept, tokens), "id") == want
    one = source.where("id = 3")
    near = blocking.associated(kept, one)
    mine = {r["token"] for r in kept.where("id = 3").collect()}
    assert rows(near, "token", "other") == rows(kept.where((F.col("id") != 3) & F.col("token").isin(*mine)).withColumnRenamed("id", "other"), "token", "other")
    assert near.count() >= blocking.associated(kept, one, F.col("token") == "t1").count()
    assert blocking.without(kept, tokens).where("token = 't1'").count() == 0


# ---- matching, clustering, evaluation, small helpers


def test_bloom_filters():
    assert matching.optimal_bloom(1000, 0.01) == (9586, 7)


def test_bloom_match_and_saturation(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "b", "c"]), ([], ["a"]), ([f"x{i}" for i in range(80)], ["a"])], "t1 array<string>, t2 array<string>")
    got = [r["sim"] for r in matching.scored(df, "bf").collect()]
    assert got[0] == pytest.approx(1.0) and got[1] == 0.0 and 0 <= got[2] <= 1
    full = df.select(matching.bloom_containment(matching.bloom("t1", 8, 4), matching.bloom("t2", 8, 4), F.size("t1"), F.size("t2"), 8).alias("s")).collect()
    assert full[2]["s"] == pytest.approx(1.0 - 1.0), "80 tokens in 8 bits: the malus is (80 - 8 + 0.1) / 1, 1 at most"
    some = df.select(matching.might_contain(matching.bloom("t1"), F.lit("a")).alias("m"), matching.bloom_elements(matching.bloom("t1")).alias("n")).collect()
    assert [r["m"] for r in some] == [True, False, False] and [r["n"] for r in some][:2] == [2, 0] and abs(some[2]["n"] - 80) <= 3


def test_no_matcher_returns_its_input(spark):
    df = spark.createDataFrame([(0, 1, 0.7)], "e1 long, e2 long, sim double")
    assert matching.scored(df, "no").collect() == df.collect()
    assert matching.scored(df.withColumnRenamed("sim", "w"), "no").first()["sim"] == 0.7


def test_components_of_two_sources(spark):
    edges = spark.createDataFrame([(0, 0, 0.9), (0, 1, 0.8), (3, 1, 0.7), (2, 2, 0.5), (5, 3, 0.6)], "e1 long, e2 long, sim double")
    assert rows(clustering.components_two(edges, 0.5), "ds", "id", "cluster") == [(0, 0, 0), (0, 3, 0), (0, 5, 5), (1, 0, 0), (1, 1, 0), (1, 3, 5)]
    assert rows(clustering.collected(edges, 0.5, two=True), "e1", "e2") == [(0, 0), (3, 1), (5, 3)]
    assert rows(clustering.collected(edges.where("e1 = 0"), 0.5), "id", "cluster") == [(0, 0), (1, 0)]
    loops = spark.createDataFrame([(1, 1), (2, 3)], "e1 long, e2 long")
    assert rows(clustering.truth_clusters(loops), "id", "cluster") == [(2, 2), (3, 2)]


def test_metrics_log_by_hand(spark):
    ranked = spark.createDataFrame([(1, 0, 1, 0.9), (2, 0, 2, 0.05), (3, 1, 2, 0.5), (4, 2, 3, 0.0), (5, 0, 3, 0.2)], "rank long, e1 long, e2 long, sim double")
    truth = spark.createDataFrame([(0, 1), (0, 2)], "e1 long, e2 long")
    got = evaluate.metrics_log(ranked, truth, 2, "m", "w").orderBy("ec").collect()
    assert [(r["ec"], r["em"], r["pc"], r["matches"], r["true_matches"], r["comps"]) for r in got] == [(1, 1, 0.5, 1, 1, 1), (2, 2, 1.0, 1, 1, 1), (4, 2, 1.0, 2, 1, 2), (5, 2, 1.0, 3, 1, 1)]
    assert got[-1]["precision"] == pytest.approx(1 / 3, abs=1e-6) and got[-1]["recall"] == 0.5
    assert evaluate.metrics_log(ranked, truth.limit(0), 0, "m", "w").count() == 1


def test_cep_ranks_where_k_is_large(spark, monkeypatch):
    df = spark.range(200).select((F.col("id") % 9).alias("w"), F.col("id").alias("e1"), (F.col("id") + 1).alias("e2"))
    want = rows(cleaning.edge_topped(df, 60), "e1", "e2", "w")
    monkeypatch.setattr(cleaning, "TOP", 10)
    assert rows(cleaning.edge_topped(df, 60), "e1", "e2", "w") == want


def test_halved_buckets_hold_no_more_than_asked(spark):
    df = spark.range(500).select((F.col("id") / 1000 + 0.2).alias("w"), F.col("id").alias("e1"), (F.col("id") + 1).alias("e2"))
    got = prioritize.sub_buckets(df, 10, 20).collect()
    assert max(Counter((r["depth"], r["bucket"]) for r in got).values()) <= 20 and len(got) == 500
    for r in got:
        assert r["bucket"] == int(r["w"] * 10 * 2 ** r["depth"] + 1e-9)


def test_paging_and_rounding(spark):
    order = spark.range(1, 11).select(F.col("id").alias("rank"))
    assert [rows(prioritize.page(order, i, 4), "rank") for i in range(3)] == [[(1,), (2,), (3,), (4,)], [(5,), (6,), (7,), (8,)], [(9,), (10,)]]
    assert spark.range(1).select(rounded(F.lit(1234.5), -2).alias("x")).first()["x"] == 1200.0


def test_sinks(spark, tmp_path):
    scored = spark.createDataFrame([(0, 1, 0.7), (0, 2, 0.2)], "e1 long, e2 long, sim double")
    assert rows(sinks.collected(scored, 0.5), "comparisons", "matches") == [(2, 1)]
    sinks.write_csv(sinks.matches(scored, 0.5), str(tmp_path / "m"))
    assert profiles.read(spark, str(tmp_path / "m"), "csv").count() == 1


def test_propagation_of_two_sources(spark):
    table = spark.createDataFrame([(3, 0), (0, 3), (1, 9), (1, 9)], "e1 long, e2 long")
    assert rows(profiles.ground_truth(table, limit1=2), "e1", "e2") == [(0, 3), (1, 9)]
    cbs = pairs.common_blocks(spark.createDataFrame([(0, 3, "a"), (5, 6, "a")], "e1 long, e2 long, token string"))
    assert rows(evaluate.flagged(cbs, table), "e1", "e2", "hit") == [(0, 3, 1), (5, 6, 0)]


def test_keys_of_any_type_and_an_order_column(spark):
    df = spark.createDataFrame([("b", "x y", 5), ("a", "y", 9), ("c", "x", 1)], "key string, body string, time long")
    byname = profiles.numbered(df, "key")
    assert rows(byname, "key", "id") == [("a", 0), ("b", 1), ("c", 2)]
    source = profiles.profiles(byname, "id", ["body"], order="time")
    assert rows(source, "id", "seq", "text") == [(0, 9, "y"), (1, 5, "x y"), (2, 1, "x")]
    raw = pairs.dirty_pairs(blocking.capped(postings(source), 50))
    assert rows(raw, "e1", "e2", "token") == [(1, 0, "y"), (2, 1, "x")], "e1 arrived first"


def test_the_counting_fold_takes_more_than_the_bound(spark, source, monkeypatch):
    """What failed at size: the fold refused more than MOST postings."""
    for cap, beta in ((6, 0.1), (6, 0.6), (3.5, 0.3), (1, 0.0), (float("inf"), 0.2)):
        want = exact.exact_pairs(token_sets(source), cap, beta).groupBy("e1", "e2").agg(F.count(F.lit(1)).alias("cbs"))
        want = rows(want, "e1", "e2", "cbs")
        with monkeypatch.context() as bound:
            bound.setattr(exact, "MOST", 10)
            assert rows(exact.counted(token_sets(source, hashed=True).repartition(3), cap, beta), "e1", "e2", "cbs") == want
    assert want
    two = token_sets(source, hashed=True)
    both = two.union(two.withColumns({"ds": F.lit(1), "id": F.col("id") + 1000}))
    assert sorted(r["e1"] // 1000 for r in exact.counted(both, 6, 0.1).collect()) == sorted(2 * len(exact.counted(two, 6, 0.1).collect()) // 2 * [0, 1])
    assert exact.counted(two.limit(0), 6, 0.1).count() == 0


def plainly(pairs, increment, k, two, limit=None):
    """The sequential rules of I-PES on plain lists: (request, rank, e1, e2)."""
    sides, near, ready, spare, total, count, out = (0, int(two)), {}, [], [], 0.0, 0, []

    def put(node, w, other):
        near[node] = sorted([*near[node], (-w, other)])[: entity_queue.NEIGHBOURS]

    def request():
        if not ready:
            ready.extend((held[0][0], *node) for node, held in near.items() if held)
        got = []
        while len(got) < k and ready:
            ready.sort()
            _, side, e = ready.pop(0)
            if near[side, e]:
                other = near[side, e].pop(0)[1]
                got.append((other, e) if (side == 1 if two else other < e) else (e, other))
        for p in spare[: k - len(got)]:
            got.append(p[1:])
            spare.remove(p)
        number = 1 + out[-1][0] if out else 0
        out.extend((number, i + 1, *p) for i, p in enumerate(got))

    parts = {}
    for e1, e2, w in sorted(pairs, key=lambda p: (p[1], p[0])):
        parts.setdefault(e2 // increment, {}).setdefault(e2, []).append((e1, e2, w))
    for part in parts.values():
        for mine in part.values():
            mean = sum(w for *_, w in mine) / len(mine)
            for e1, e2, w in mine:
                if w < mean:
                    continue
                total, count = total + w, count + 1
                ends = ((sides[0], e1), e2), ((sides[1], e2), e1)
                for node, _ in ends:
                    near.setdefault(node, [])
                beaten = next((x for x in ends if w > (-near[x[0]][0][0] if near[x[0]] else 0.0)), None)
                if beaten:
                    ready.append((-w, *beaten[0]))
                    put(beaten[0], w, beaten[1])
                elif w > total / count:
                    node, other = ends[0] if len(near[ends[0][0]]) < len(near[ends[1][0]]) else ends[1]
                    if len(near[node]) < entity_queue.NEIGHBOURS or -sum(x for x, _ in near[node]) / len(near[node]) > w:
                        put(node, w, other)
                else:
                    spare.append((-w, e1, e2))
                    spare.sort()
                    del spare[limit if limit is not None else len(spare) :]
        request()
    while spare or any(near.values()):
        request()
    return out


@pytest.mark.parametrize("two", [False, True])
def test_the_entity_queue_takes_more_than_the_bound(spark, monkeypatch, two):
    """What failed at size: the fold refused more than MOST pairs, and held them all."""
    rng = random.Random(8)
    every = [(a, b, rng.randint(1, 12) / 8) for b in range(90) for a in range(60 if two else b) if rng.random() < 0.5]
    monkeypatch.setattr(entity_queue, "NEIGHBOURS", 4)
    queue, out = entity_queue.EntityQueue(two, overflow=25), []
    for request in range(9):
        for b in range(10 * request, 10 * request + 10):
            queue.update([p for p in every if p[1] == b])
        out += [(request, i + 1, *p) for i, p in enumerate(queue.take(13))]
    while not queue.empty():
        request += 1
        out += [(request, i + 1, *p) for i, p in enumerate(queue.take(13))]
    assert out == plainly(every, 10, 13, two, 25)
    monkeypatch.setattr(entity_queue, "NEIGHBOURS", 60)
    monkeypatch.setattr(entity_queue, "MOST", 10)
    df = spark.createDataFrame(rng.sample(every, len(every)), "e1 long, e2 long, w double").repartition(3)
    assert rows(entity_queue.folded(df, 10, 13, two), "request", "rank", "e1", "e2") == plainly(every, 10, 13, two)
    assert entity_queue.folded(df.limit(0), 10, 13, two).count() == 0
