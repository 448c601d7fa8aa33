"""Decontamination against plain Python: tokens, windows and alignments of lower-case prose, and slots of names and numbers."""

import random
import re

import numpy as np
import pytest

from pairwright.llm import decontamination as d


def tokens_of(*texts):
    raw = [t.encode() for t in texts]
    return d.Tokens(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]))


def plain_tokens(text):
    return re.findall(r"\d+(?:[.,]\d+)*|[a-zA-ZÀ-ɏ]+", text)


def test_prose_against_all_alignments(spark):
    rng = random.Random(12)
    vocabulary = [f"{a}{b}" for a in ("ba", "co", "du", "fe", "gi") for b in ("lan", "mer", "nos", "pit", "ral", "sun")]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [prose(rng.choice([3, 5, 7, 8, 10, 13, 20, 40])) for _ in range(24)]
    docs = []
    for _ in range(500):
        item = rng.choice(items)
        start = rng.randrange(len(item))
        part = item[start : start + rng.choice([4, 7, 8, 12, 13, 14, 20, 40])]
        if rng.random() < 0.3 and part:
            part = [*part]
            part[rng.randrange(len(part))] = rng.choice(vocabulary)
        docs.append(prose(rng.choice([0, 3, 30])) + part + prose(rng.choice([0, 3, 30])))
    docs += [[*items[0]], [*items[1]], items[0] + ["one", "more"]]

    def holds(doc, item):
        size = min(d.WINDOW, len(item))
        if len(item) < d.SHORTEST:
            return doc == item
        total = len(item) - size + 1
        at = {}
        for p in range(total):
            for q in range(len(doc) - size + 1):
                if doc[q : q + size] == item[p : p + size]:
                    at.setdefault(q - p, set()).add(p)
        return any(len(x) >= min(d.RUN, total) for x in at.values())

    want = sorted((i, j) for i, doc in enumerate(docs) for j, item in enumerate(items) if holds(doc, item))
    got = d.contaminated(
        spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id long, text string"),
        spark.createDataFrame([(j, " ".join(x)) for j, x in enumerate(items)], "item_id long, text string"),
    )
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == want and 20 < len(want) < 450


@pytest.mark.parametrize("text", ["Then Ann met Bo in Rome for 3 km and 1,200.5 kg of tea", "so 12 apples. The end is near", "", "x", "été Ünder 7 days\nNext line Here"])
def test_tokens_and_slots_by_hand(text):
    t = tokens_of(text)
    words = plain_tokens(text)
    assert len(t.hash) == len(words)
    assert len(set(t.hash.tolist())) == len({w.lower() for w in words})
    units = set(d.UNITS.split())
    stops = [bool(re.search(r"[.!?:;\n|]", gap)) for gap in re.split(r"(?:\d+(?:[.,]\d+)*|[a-zA-ZÀ-ɏ]+)", text)[:-1]]
    title = [w[0].isupper() and len(w) > 1 and sum(c.isupper() for c in w) == 1 for w in words]
    shout = sum(title) * 2 > sum(not w[0].isdigit() for w in words)
    for i, w in enumerate(words):
        initial = i == 0 or stops[i]
        if w[0].isdigit():
            want = d.NUMBER
        elif i and words[i - 1][0].isdigit() and w.lower() in units and not title[i]:
            want = d.UNIT
        else:
            want = d.NAME if title[i] and not initial and not shout else 0
        assert t.slot[i] == want, (w, t.slot[i])


def test_runs_become_one_token_and_the_rest_stays():
    t = tokens_of("we saw Mary Ann Lee buy 1 200 plums. Then Bo left", "nothing here at all")
    m = t.merged()  # we saw <Mary Ann Lee> buy <1 200> plums <Then Bo> left
    assert m.slot.tolist() == [0, 0, d.NAME, 0, d.NUMBER, 0, d.NAME, 0] and set(m.row.tolist()) == {0} and m.counts.tolist() == [8, 0]
    assert [m.hash[i] for i in (0, 1, 3, 5, 7)] == [t.hash[i] for i in (0, 1, 5, 8, 11)]
    assert tokens_of("no runs Here at 5 all").merged() is None
