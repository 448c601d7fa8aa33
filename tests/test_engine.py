"""The hand-worked micro-fixture, edge cases and the stateful parts."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairwright.functions.text import pair_key, postings, token_sets, tokens
from pairwright.operators import blocking, cleaning, clustering, evaluate, matching, pairs, prioritize, ranking, weighting
from pairwright.operators import truth as true_pairs
from pairwright.plans import pipeline
from pairwright.sources import profiles, sinks
from pairwright.streaming import exact, incremental
from pairwright.streaming.policy import Adaptive, Fixed

TEXTS = {0: "john smith berlin", 1: "jon smith berlin", 2: "mary jones paris", 3: "john smith"}
SCHEMA = "ds int, id long, seq long, text string"


@pytest.fixture(scope="module")
def source(spark):
    return spark.createDataFrame([(0, i, i, t) for i, t in TEXTS.items()], SCHEMA)


@pytest.fixture(scope="module")
def truth(spark):
    return spark.createDataFrame([(0, 1), (0, 3)], "e1 long, e2 long")


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def raw_of(source, cap=50):
    return pairs.dirty_pairs(blocking.capped(postings(source), cap))


def test_blocks_and_raw_pairs(source):
    assert rows(blocking.block_sizes(postings(source)), "token", "n") == [("berlin", 2), ("john", 2), ("smith", 3)]
    assert rows(raw_of(source), "e1", "e2", "token") == [(0, 1, "berlin"), (0, 1, "smith"), (0, 3, "john"), (0, 3, "smith"), (1, 3, "smith")]


def test_weights_and_cleaning(source):
    cbs = pairs.common_blocks(raw_of(source))
    assert rows(cbs, "e1", "e2", "cbs") == [(0, 1, 2), (0, 3, 2), (1, 3, 1)]
    assert rows(cleaning.above_mean(cbs), "e1", "e2") == [(0, 1), (0, 3)]
    assert rows(cleaning.above_mean(cbs, strict=True), "e1", "e2") == [(0, 3)]
    assert rows(cleaning.cardinality(cbs), "e1", "e2") == [(0, 1), (0, 3)]


def test_cardinality_keeps_none_without_repeats(spark):
    assert cleaning.cardinality(spark.createDataFrame([(0, 2, 1), (1, 2, 1)], "e1 long, e2 long, cbs long")).count() == 0


def test_jaccard_and_metrics(source, truth):
    cbs = pairs.common_blocks(raw_of(source))
    scored = matching.scored(pairs.with_tokens(cbs, token_sets(source)))
    assert rows(scored.withColumn("s", F.round("sim", 6)), "e1", "e2", "s") == [(0, 1, 0.5), (0, 3, 0.666667), (1, 3, 0.25)]
    assert rows(evaluate.completeness(cleaning.above_mean(cbs), truth), "pc", "pq") == [(1.0, 1.0)]
    assert rows(evaluate.completeness(cbs, truth), "pc", "pq") == [(1.0, 0.666667)]


def test_arrival_order_cap(source):
    assert rows(raw_of(source, cap=3), "e1", "e2", "token") == [(0, 1, "berlin"), (0, 1, "smith"), (0, 3, "john")]


def test_progressive_run_with_budget(source, truth):
    for name in ("icps", "ieps", "ipbs3", "iacps"):
        out = pipeline.progressive(source, pipeline.Config(prioritizer=name, cleaning="hs", budget=2))
        assert out.count() == 2, name
    first = pipeline.progressive(source, pipeline.Config(weighting="js", budget=1))
    assert rows(first, "e1", "e2") == [(0, 3)]


def test_edge_texts(spark):
    df = spark.createDataFrame([(0, "",), (1, None,), (2, "été Smith_x",), (3, "a",)], "id long, text string")
    got = {r["id"]: r["t"] for r in df.select("id", tokens("text").alias("t")).collect()}
    assert got == {0: [], 1: [], 2: ["smith", "t", "x"], 3: ["a"]}
    empty = df.where("id < 2").select(F.lit(0).alias("ds"), "id", F.col("id").alias("seq"), "text")
    assert pipeline.baseline(empty).count() == 0
    assert pipeline.progressive(empty).count() == 0


def test_clean_clean_orientation(spark):
    one = spark.createDataFrame([(0, 0, 0, "red car"), (0, 1, 1, "blue car")], SCHEMA)
    two = spark.createDataFrame([(0, 0, 0, "a blue car"), (0, 1, 1, "green bus")], SCHEMA)
    both = profiles.interleave(one, two)
    assert rows(both, "ds", "id", "seq") == [(0, 0, 0), (0, 1, 2), (1, 0, 1), (1, 1, 3)]
    out = pipeline.baseline(both, pipeline.Config(mode="clean_clean", rho=10, cleaning="hs"))
    assert rows(out.withColumn("s", F.round("sim", 4)), "e1", "e2", "s") == [(0, 0, 0.25), (1, 0, 0.6667)]


def test_edit_distance_of_token_sequences(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["a", "c"]), ([], []), (["x"], [])], "t1 array<string>, t2 array<string>")
    assert [round(r["d"], 4) for r in df.select(matching.edit_distance().alias("d")).collect()] == [0.3333, 0.0, 1.0]


def test_edit_distance_query_against_brute_force(spark, tables):
    """DuckDB's levenshtein counts bytes, so SQL can't stand in here."""
    from pairwright.plans.catalogue import QUERIES

    text = {r["doc_id"]: r["t"] for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", tokens("text").alias("t")).collect()}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    got = QUERIES["edit_distance_match"](spark, tables).collect()
    assert got
    for r in got[:40]:
        a, b = text[r["e1"]], text[r["e2"]]
        assert r["ed_distance"] == pytest.approx(edits(a, b) / max(len(a), len(b)), abs=1e-6)
        assert r["ed_similarity"] == pytest.approx(1 - r["ed_distance"], abs=2e-6)


def test_edit_distance_reads_tokens_in_their_order(spark, tmp_path):
    """Texts that name the same tokens in other orders are the same sequence of sorted tokens."""
    from pairwright.plans.catalogue import QUERIES

    texts = ["delta alpha echo bravo", "bravo echo alpha delta", "echo delta charlie bravo alpha"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["e1"], r["e2"]): r["ed_distance"] for r in QUERIES["edit_distance_match"](spark, str(tmp_path)).collect()}
    assert got == {(0, 1): 0.0, (0, 2): 0.2, (1, 2): 0.2}


def test_edit_distance_scores_every_cleaned_pair(spark, tables):
    from pairwright.plans.catalogue import QUERIES

    got = QUERIES["edit_distance_match"](spark, tables)
    assert rows(got, "e1", "e2") == rows(QUERIES["wnp2"](spark, tables), "e1", "e2")


def test_edits_by_chains_match_the_table(spark):
    rng = random.Random(3)
    cases = [tuple(sorted(rng.sample("abcdefghijklmnopqrstuvwxyz", rng.randint(0, 26))) for _ in range(2)) for _ in range(300)]
    cases.append((["a", "b", "c", "i"], ["i", "j", "k", "l"]))

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    df = spark.createDataFrame(cases, "t1 array<string>, t2 array<string>")
    for r in df.withColumn("d", matching.token_edits()).collect():
        assert r["d"] == edits(r["t1"], r["t2"]), (r["t1"], r["t2"])


def test_truth_knows_no_cap(spark, tmp_path):
    """Sixty copies of a text, near copies, random sets, empty and null texts: against all pairs."""
    from pairwright.plans.catalogue import QUERIES

    rng = random.Random(9)
    base = [f"w{i}" for i in range(20)]
    texts = [" ".join(rng.sample(base, 20)) for _ in range(60)] + [" ".join([*base[:18], f"x{i}"]) for i in range(5)]
    texts += [" ".join(rng.sample("abcdefghijkl", rng.randint(1, 8))) for _ in range(60)] + ["", "", "?!", "?!", None, None]
    sets = [set((t or "").split()) if t != "?!" else set() for t in texts]
    want = []
    for j in range(len(texts)):
        for i in range(j):
            both = len(sets[i] & sets[j])
            if (sets[i] and both / len(sets[i] | sets[j]) >= 0.8) or (texts[i] is not None and texts[i] == texts[j]):
                want.append((i, j))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    every = true_pairs.Truth(df.withColumnRenamed("doc_id", "id"), 0.8)
    assert rows(every.pairs(), "e1", "e2") == sorted(want)
    assert every.count() == len(want)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["id"] for r in QUERIES["connected_components"](spark, str(tmp_path)).collect()} == {x for pair in want for x in pair}
    assert rows(QUERIES["pc_pq_metrics"](spark, str(tmp_path)), "truth") == [(len(want),)]


def test_ghosting_forms_agree_without_ghosting(spark, tables):
    source = profiles.profiles(profiles.read(spark, f"{tables}/documents.parquet"), "doc_id", ["text"]).where("id < 60")
    mine = pairs.common_blocks(pairs.dirty_pairs(blocking.capped(postings(source), 20)))
    fold = exact.exact_pairs(token_sets(source), 20, 0.0).groupBy("e1", "e2").agg(F.count(F.lit(1)).alias("cbs"))
    # a banned token keeps what it had emitted, so both forms give the same raw pairs
    assert rows(mine, "e1", "e2", "cbs") == rows(fold, "e1", "e2", "cbs")


def test_ghosting_fold_by_hand():
    frame = pd.DataFrame({"id": [0, 1, 2, 3], "seq": [0, 1, 2, 3], "tokens": [["a", "b"], ["a"], ["a"], ["a", "b"]]})
    assert len(exact.fold(frame, 50, 0.0)) == 1 + 2 + 3 + 1
    # arrival 3: block a has 3 earlier members, b has 1; (3 + 1) * 0.6 >= 1 + 1, so a is ghosted
    assert exact.fold(frame, 50, 0.6)[["e1", "e2", "token"]].values.tolist() == [[0, 1, "a"], [0, 2, "a"], [1, 2, "a"], [0, 3, "b"]]


def test_stream_equals_batch_and_larger_increment(source):
    batch = rows(pairs.common_blocks(raw_of(source)), "e1", "e2", "cbs")
    for size in (1, 2, 100):
        assert rows(incremental.run(source, size, 50), "e1", "e2", "cbs") == batch


@pytest.mark.parametrize("field", [{"mode": "clean_clean"}, {"rho": 0.1}, {"beta": 0.1}, {"cleaning": "cnp"}, {"weighting": "js"}, {"prioritizer": "ieps"}, {"matcher": "ed"}, {"threshold": 0.5}, {"budget": 5}])
def test_stream_refuses_what_it_would_ignore(source, field):
    with pytest.raises(ValueError, match=next(iter(field))):
        pipeline.streaming(source, pipeline.Config(**field))


def test_clean_clean_refuses_ghosting(source):
    with pytest.raises(ValueError, match="beta"):
        pipeline.baseline(source, pipeline.Config(mode="clean_clean", beta=0.1))


def test_stream_step_is_idempotent(spark, source):
    state = incremental.Incremental(spark, 50)
    state.step(source, 0)
    state.step(source, 0)
    assert state.pairs().count() == 3


def test_components_and_mapping(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51)], "e1 long, e2 long")
    got = dict(rows(clustering.components(chain), "id", "cluster"))
    assert got == {**{i: 0 for i in range(21)}, 50: 50, 51: 50}
    edges = spark.createDataFrame([(0, 0, 0.9), (0, 1, 0.95), (1, 1, 0.8), (1, 0, 0.1)], "e1 long, e2 long, sim double")
    assert rows(clustering.unique_mapping(edges, 0.05), "e1", "e2") == [(0, 1), (1, 0)]


def test_ranks_are_total_and_gapless(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("w"), F.col("id").alias("e1"), F.col("id").alias("e2"))
    out, n = ranking.ranked(df, *prioritize.best())
    got = rows(out, "rank", "w", "e1")
    assert n == 1000 and [r[0] for r in got] == list(range(1, 1001))
    assert [(-w, e) for _, w, e in got] == sorted((-w, e) for _, w, e in got)


def test_repeat_filter_sinks_and_truth(spark, source, tmp_path):
    cbs = pairs.common_blocks(raw_of(source))
    assert rows(pairs.unseen(cbs, cbs.where("e1 = 0")), "e1", "e2") == [(1, 3)]
    table = spark.createDataFrame([(3, 0), (0, 3), (1, 9)], "e1 long, e2 long")
    assert rows(profiles.ground_truth(table, limit2=4, dirty=True), "e1", "e2") == [(0, 3)]
    sinks.write_tsv(cbs, str(tmp_path / "out"), append=False)
    assert profiles.read(spark, str(tmp_path / "out"), "tsv").count() == 3
    assert rows(profiles.prefix(source, 2), "id") == [(0,), (1,)]
    assert cbs.select(pair_key("e1", "e2").alias("k")).distinct().count() == 3


def test_attributes_pool_into_one_text(spark):
    df = spark.createDataFrame([(7, [("name", "Ann"), ("town", "Rome")])], "id long, attrs array<struct<name string, value string>>")
    assert profiles.attribute_profiles(df, "id", "attrs").first()["text"] == "Ann Rome"


def test_batch_cleaning_names(spark):
    w = spark.createDataFrame([(0, 1, 3.0), (0, 2, 1.0), (1, 2, 2.0)], "e1 long, e2 long, w double")
    assert cleaning.batch_cleaned(w, "wep").count() == 2
    assert rows(cleaning.batch_cleaned(w, "cep", 1), "e1", "e2") == [(0, 1)]
    assert rows(cleaning.batch_cleaned(w, "rcnp", 1), "e1", "e2") == [(0, 1)]
    assert cleaning.batch_cleaned(w, "wnp").count() >= cleaning.batch_cleaned(w, "rwnp").count()
    with pytest.raises(ValueError):
        cleaning.batch_cleaned(w, "nope")


def test_weights_stay_in_range(spark, tables):
    source = profiles.profiles(profiles.read(spark, f"{tables}/documents.parquet"), "doc_id", ["text"])
    kept = blocking.capped(postings(source), 50)
    js = weighting.jaccard_of_blocks(pairs.common_blocks(pairs.dirty_pairs(kept)), kept)
    assert js.where("w > 1 OR w <= 0").count() == 0


def test_adaptive_k():
    assert Fixed(5).next() == 5
    k = Adaptive()
    k.arrived(10.0)
    k.served(1.0)
    assert [k.next() for _ in range(3)] == [2, 3, 4]
    k.served(30.0)
    assert k.next() == 3
    k.ended = True
    assert k.next() == 4


def test_entry_runs_without_the_corpus_part(spark):
    """A child process hides the corpus folders: the entry point must import and offer the other queries."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = (
        "import sys; sys.path.insert(0, r'%s')\n"
        "class Hide:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('pairwright.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Hide())\n"
        "import __spark_entry__ as e\n"
        "assert not any(n.startswith('op') for n in e.queries()) and 'jaccard_match' in e.queries() and e.oracle_sql()\n" % root
    )
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120).returncode == 0
