"""The pipeline stage by stage against brute force, each on its own input."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from pairwright.llm import queries, quality
from pairwright.llm.common import cut

from .test_ops import component_oracle, measures_of, words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tables):
    """Inputs and outputs of the stages at the smallest size."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = cut(stage(spark, docs, tables), name)
        seen.append((name, docs.collect(), out.collect(), out.columns))
        docs = out
    return seen


def quartiles(values):
    low = sorted(v - v % (1 << max(v.bit_length() - 6, 0)) for v in values)
    return low[-(-len(low) // 4) - 1], low[-(-len(low) // 2) - 1]


def quality_oracle(rows):
    """doc_ids that the rules keep."""
    found = []
    for r in rows:
        n, chars, symbols, dup, rep = measures_of(r["text"])
        lines = sum(1 for x in (r["text"] or "").split("\n") if words(x))
        failed = n < 20 or 100 * rep > 30 * n
        found.append((r, failed, {"symbols": symbols * 1000 // max(chars, 1), "length": chars * 100 // max(n, 1), "lines": dup * 1000 // max(lines, 1)}))
    groups = defaultdict(list)
    for r, failed, x in found:
        if not failed:
            for key in ((r["lang"], r["source"]), (r["lang"],), ()):
                groups[key].append(x)
    kept = []
    for r, failed, x in found:
        if failed:
            continue
        key = next((k for k in ((r["lang"], r["source"]), (r["lang"],)) if len(groups[k]) >= quality.SUPPORT), ())
        good = True
        for name, slack in quality.SLACK.items():
            q, m = quartiles([y[name] for y in groups[key]])
            spread = quality.FENCE * max(m - q, slack)
            good &= x[name] <= m + spread and (name not in quality.TWO_SIDED or x[name] >= m - spread)
        if good:
            kept.append(r["doc_id"])
    return kept


def test_quality_stage(stages):
    _, before, after, columns = stages[0]
    assert columns == COLUMNS
    assert sorted(r["doc_id"] for r in after) == sorted(quality_oracle(before))


def test_near_duplicate_stage(stages):
    _, before, after, columns = stages[1]
    assert columns == COLUMNS
    want = component_oracle([(r["doc_id"], r["text"], r["source"]) for r in before], 80)
    assert Counter(r["doc_id"] for r in after) == Counter(d for d, _, c in want if d == c)


def test_decontamination_stage(spark, tables, stages):
    _, before, after, columns = stages[2]
    assert columns == COLUMNS
    items = [r["text"] for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    plain = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    holds = {r["doc_id"] for r in before if any(plain(i) in plain(r["text"]) for i in items)}
    assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} == holds


def test_mixing_stage(stages):
    _, before, after, columns = stages[3]
    assert columns == COLUMNS
    copies = Counter(r["doc_id"] for r in after)
    assert set(copies) <= {r["doc_id"] for r in before} and max(copies.values()) <= 3
    text = {r["doc_id"]: r["text"] for r in before}
    assert all(text[r["doc_id"]] == r["text"] for r in after)
    size = {r["doc_id"]: len(words(r["text"])) for r in before}
    total, taken = Counter(), Counter()
    for r in before:
        total[r["source"]] += size[r["doc_id"]]
        taken[r["source"]] += size[r["doc_id"]] * copies[r["doc_id"]]
    order = sorted(total)
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    full = {}
    while True:
        rest, w = sum(total.values()) - sum(full.values()), sum(weight[s] for s in order if s not in full)
        over = [s for s in order if s not in full and rest * weight[s] > 3 * total[s] * w]
        if not over:
            break
        full |= {s: 3 * total[s] for s in over}
    for s in order:
        target = full.get(s, rest * weight[s] / w)
        largest = max(size[r["doc_id"]] for r in before if r["source"] == s)
        assert abs(taken[s] - target) <= max(0.02 * target, largest / 2)


def test_sharding_stage(stages):
    _, before, after, _ = stages[4]
    assert Counter(r["doc_id"] for r in before) == Counter(r["doc_id"] for r in after)
    by = defaultdict(list)
    for r in after:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_run_gives_the_same(spark, tables, stages):
    assert Counter(map(tuple, corpus_pipeline.run(spark, tables).collect())) == Counter(map(tuple, stages[-1][2]))


def test_each_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
