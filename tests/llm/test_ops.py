"""The corpus operators against brute force, round trips and held-out accuracy, and on the awkward inputs."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright.llm import chat, decontamination, dedup, graph, langid, mixing, quality, secrets, sharding, tokens, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, key string, size string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, empty, short and very long texts, ties, repeated rows, extra columns with clashing names."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéöñ") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = [prose(60).split() for _ in range(6)]
    texts = [None, "", " \n\t ", "one", "two words", "a b c d e", "A B C D E", "#" * 50, "　wide space", prose(20000)]
    for b in base:
        for _ in range(6):
            copy = list(b)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    passage = prose(40)
    texts += [prose(rng.randint(5, 30)) + " " + passage + " " + prose(30) for _ in range(50)]
    texts += [base[0][0] + " " + " ".join(base[0][1:])] * 3
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s3", None]), len(t or ""), "x", "y", "z") for i, t in enumerate(texts)]
    rows += [rows[12], rows[12], (None, texts[12], None, None, 0, None, None, None), (None, "x y z", "en", "s1", 5, None, None, None)]
    return spark.createDataFrame(rows, DOCS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(docs):
    return [(r["doc_id"], r["text"], r["source"]) for r in docs.select("doc_id", "text", "source").collect()]


def shingles(text):
    w = words((text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def component_oracle(rows, percent):
    """(doc_id, n_shingles, component) as a multiset, by comparing all pairs."""
    sets = [shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(sets[i]), least.get(find(i))) for i, (d, _, _) in enumerate(rows))


# ---- sharding


@pytest.mark.parametrize("n", [1, 2, 3, 8, 9, 1000, 4097])
def test_permutation_is_a_bijection(n):
    p = sharding.Permutation(n)
    out = p.forward(np.arange(n))
    assert sorted(out.tolist()) == list(range(n))
    assert (p.backward(out) == np.arange(n)).all()


def test_shards_are_even_and_slots_gapless(docs):
    got = sharding.shard(docs).collect()
    by = {s: sorted(r["slot"] for r in got if r["shard"] == s) for s in range(8)}
    assert all(v == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    import zlib

    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in rows_of(docs))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    again = Counter(map(tuple, sharding.shard(docs.repartition(7)).collect()))
    assert Counter(map(tuple, got)) == again, "the order of partitions must not matter"
    order = sorted(got, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"]))
    at = {(r["shard"], r["slot"]): r for r in got}
    for row in (0, 5, len(got) - 1):
        place = int(sharding.Permutation(len(got)).forward(np.array([row]))[0])
        assert at[place % 8, place // 8]["doc_id"] == order[row]["doc_id"]
        assert sharding.locate(place % 8, place // 8, len(got)) == row


def test_empty_tables(spark, empty):
    assert sharding.shard(empty).count() == 0
    assert dedup.near_duplicates(empty).count() == 0
    assert dedup.keep_one(empty).count() == 0
    assert mixing.balance(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert quality.filter_quality(empty).count() == 0
    assert tokens.token_counts(empty).count() == 0
    assert langid.identify(empty).count() == 0
    assert secrets.scan(empty).count() == 0
    items = spark.createDataFrame([(0, "some words of a benchmark item that go on")], "item_id long, text string")
    assert decontamination.contaminated(empty, items).count() == 0
    assert decontamination.decontaminate(empty, items).count() == 0
    assert warc.leaves(warc.records(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0
    assert chat.digests(chat.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


# ---- near-duplicates


@pytest.mark.parametrize("percent", [80, 85])
def test_components_match_all_pairs(docs, percent):
    got = Counter(map(tuple, dedup.near_duplicates(docs, percent).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == component_oracle(rows_of(docs), percent)


def test_crowded_lists_are_settled(spark, monkeypatch):
    """Many variants of one text and passages that many share: every path of the operator, with short lists."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(90)]
    texts = []
    for _ in range(160):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4, 6])):
            copy[rng.randrange(90)] = rng.choice(vocabulary)
        texts.append(copy)
    texts += [[rng.choice(vocabulary) for _ in range(rng.randint(4, 40))] + base[:50] for _ in range(60)]
    df = spark.createDataFrame([(i, " ".join(t), "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    monkeypatch.setattr(dedup, "LIST", 8)
    got = Counter(map(tuple, dedup.near_duplicates(df, 85).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == component_oracle(rows_of(df), 85)


def test_keep_one_keeps_one_row_of_each_group(docs):
    kept = dedup.keep_one(docs, 80)
    assert kept.columns == docs.columns
    want = component_oracle(rows_of(docs), 80)
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert Counter(i for i in ids if i is not None) == Counter({d: 1 for d, _, c in want if d is not None and d == c})


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(40, 41), (41, 40), (50, 50)], "a long, b long")
    got = {r["node"]: r["label"] for r in graph.components(edges).collect()}
    assert got == {**{i: 0 for i in range(31)}, 40: 40, 41: 40}


# ---- decontamination

ITEM = "Question: Anna has 12 apples and buys 7 more pears for 3 dollars each. How many fruits does Anna have at the end of the long day?"


def test_templates_catch_other_numbers_and_names(spark):
    items = spark.createDataFrame([(0, ITEM), (1, "one two three four five six"), (2, "tiny"), (3, None)], "item_id long, text string")
    other = ITEM.replace("Anna", "Peter").replace("12", "31").replace("7", "9,5").replace(" 3 ", " 4 ")
    cases = [
        (1, "Before. " + ITEM + " After."), (2, "before " + other), (3, ITEM.upper().replace(" ", "!! ")), (4, None), (5, ""), (6, "tiny"), (7, "tiny and more"),
        (8, "so one two three four five six so"), (9, "The market is open and it was good for a long day, 12 apples and 7 more"), (10, "12 7 3 " * 30), (1, "Before. " + ITEM + " After."),
    ]
    df = spark.createDataFrame(cases, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["verbatim"] for r in decontamination.contaminated(df, items).collect()}
    assert got == {(1, 0): True, (2, 0): False, (3, 0): True, (6, 2): True, (8, 1): True}
    kept = [r["doc_id"] for r in decontamination.decontaminate(df, items).collect()]
    assert sorted(kept) == [4, 5, 7, 9, 10]


def test_inconsistent_slots_do_not_count(spark):
    item = " ".join(f"then Mia met Leo near the old red bridge in town {i}" for i in ("again", "twice", "later", "soon"))
    swapped = item.replace("Mia", "Ada", 1).replace("Mia", "Eva", 1).replace("Mia", "Ida", 1).replace("Leo", "Bob", 2)
    items = spark.createDataFrame([(0, item)], "item_id long, text string")
    df = spark.createDataFrame([(1, "so " + item.replace("Mia", "Ada").replace("Leo", "Bob")), (2, "so " + swapped)], "doc_id long, text string")
    assert [r["doc_id"] for r in decontamination.contaminated(df, items).collect()] == [1]


def test_short_items_with_a_name_at_any_place(spark):
    """Items of 8 to 13 tokens need all their windows, so a swapped name must not cost one, wherever it stands."""
    words_ = "if the old baker sells bread and pays tax how much remains".split()
    items, cases = [(0, "If Tom has 5 apples and eats 2, how many are left?")], [(0, "If Anna has 7 apples and eats 3, how many are left?")]
    for n in range(8, 14):
        for at in range(n):
            other = [f"{w}x{chr(97 + n)}{chr(97 + at)}" for w in words_[: n - 1]]
            texts = [" ".join([*other[:at], name, *other[at:]]) for name in ("Tom", "Anna")]
            items.append((len(items), texts[0]))
            cases.append((len(cases), "so it goes. " + texts[1] + " and so on"))
    items.append((len(items), "So we ask this now. Tom likes red plums more"))
    cases.append((len(cases), "So we ask this now. Anna likes red plums more"))
    got = decontamination.contaminated(spark.createDataFrame(cases, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r["doc_id"], r["item_id"], r["verbatim"]) for r in got.collect()) == [(i, i, False) for i in range(len(items))]


def test_copies_are_found_whatever_their_case_and_stops(spark):
    item = "What did Tom buy at the store in 1999 for his mom"
    items = spark.createDataFrame([(0, item)], "item_id long, text string")
    cases = [item.lower(), item.upper(), item.title(), item.replace("Tom", "TOM"), item.replace(" Tom", ". Tom"), "we ask " + item.lower() + " now"]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    assert sorted((r["doc_id"], r["verbatim"]) for r in decontamination.contaminated(df, items).collect()) == [(i, True) for i in range(len(cases))]


def test_all_windows_without_a_sift(spark, docs, monkeypatch):
    long = rows_of(docs)[9][1].split()
    items = spark.createDataFrame([(0, " ".join(long[100:130])), (1, " ".join(long[500:520]))], "item_id long, text string")
    sifted = sorted(map(tuple, decontamination.contaminated(docs, items).collect()))
    monkeypatch.setattr(decontamination, "SIFT", 0)
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
    assert sorted(map(tuple, decontamination.contaminated(docs, items).collect())) == sifted and len(sifted) == 2


# ---- mixing


def test_mix_meets_targets(docs):
    got = mixing.balance(docs).collect()
    rows = rows_of(docs)
    sizes = Counter((d, len(words(t))) for d, t, _ in rows)
    assert Counter((r["doc_id"], r["size"]) for r in got) == sizes
    total = Counter()
    for _, t, s in rows:
        total[s] += len(words(t))
    order = sorted((s for s in total if s is not None)) + ([None] if None in total else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    full = {}
    while True:
        rest, w = sum(total.values()) - sum(full.values()), sum(weight[s] for s in order if s not in full)
        over = [s for s in order if s not in full and rest * weight[s] > 3 * total[s] * w]
        if not over:
            break
        full |= {s: 3 * total[s] for s in over}
    want = {s: full.get(s, rest * weight[s] / w) for s in order}
    source = {d: s for d, _, s in rows if d is not None}
    largest = {want[s]: max(len(words(t)) for _, t, s_ in rows if s_ == s) for s in order}
    taken = Counter()
    for r in got:
        if r["doc_id"] is not None:
            assert r["target"] == pytest.approx(want[source[r["doc_id"]]])
            assert r["source_size"] == total[source[r["doc_id"]]]
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["target"]] += r["taken"]
    for target, got_words in taken.items():
        # whole copies only: where one text is larger than its source's target, half of it is as near as one can come
        bound = next(n for w, n in largest.items() if abs(w - target) < 1e-6 * max(1, w))
        assert abs(got_words - target) <= (bound / 2 if bound > target else max(0.02 * target, 60))
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.balance(docs.repartition(5)).collect()))


def test_mix_repeats_rows(docs):
    copies = {r["doc_id"]: r["copies"] for r in mixing.balance(docs).where("doc_id is not null and doc_id != 12").collect()}
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    got = Counter(r["doc_id"] for r in out.select("doc_id").collect())
    assert all(got[d] == c for d, c in copies.items())


def test_rates_are_tilted_exponentially(spark):
    df = spark.createDataFrame([(i, "w " * (1 + i % 50), "ab"[i % 2]) for i in range(2000)], "doc_id long, text string, source string")
    by = {}
    for r in mixing.balance(df).where("size > 0").collect():
        by.setdefault(r["target"], []).append((r["size"], r["rate"]))
    for points in by.values():
        slopes = {round(np.log(rate) / size, 9) for size, rate in points if rate < 3}
        assert len(slopes) == 1


# ---- quality


def measures_of(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_quality_measures(spark, docs):
    rng = random.Random(3)
    extra = [(1000 + i, "\n".join(" ".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 30)))) for i in range(80)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    names = ["_n_words", "_word_chars", "_n_symbols", "_n_dup_lines", "_n_repeat_words"]
    for r in quality.measured(df).collect():
        assert tuple(r[n] for n in names) == measures_of(r["text"]), r["text"]


def test_quality_keeps_prose_and_drops_junk(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(i, prose(80), "en", "a", "z") for i in range(200)] + [(1000 + i, prose(80).replace(" ", "*** "), "en", "a", "z") for i in range(20)]
    rows += [(2000, prose(80), None, None, None), (2001, None, "en", "a", None), (2002, "", None, "a", None)]
    kept = quality.filter_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, low string"))
    assert kept.columns == ["doc_id", "text", "lang", "source", "low"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(200), 2000]


def test_sketches_merge(spark):
    df = spark.range(3000).select(F.lit("en").alias("lang"), F.lit("s").alias("source"), (F.col("id") % 700).alias("_n_symbols"), F.lit(1000).alias("_word_chars"), F.lit(200).alias("_n_words"), F.lit(0).alias("_n_dup_lines"), F.lit(9).alias("_n_lines"))
    whole = quality.sketch(df)
    parts = quality.sketch(df.where("_n_symbols < 300")).union(quality.sketch(df.where("_n_symbols >= 300")))
    merged = parts.groupBy("lang", "source", "ratio", "low").agg(F.sum("c").alias("c"))
    assert Counter(map(tuple, whole.collect())) == Counter(map(tuple, merged.collect()))
    low = [r["low"] for r in df.select("_n_symbols", quality.bucket(F.col("_n_symbols")).alias("low")).collect()]
    assert all(v - v / 32 - 1e-9 <= b <= v for v, b in zip((i % 700 for i in range(3000)), low, strict=True))


# ---- secrets


def test_secrets_are_told_from_look_alikes(spark):
    key = hashlib.sha1(b"k").hexdigest()
    rows = [
        (1, f'so the token = "{key}" was lost'), (2, f"see commit {key} for the change"), (3, "look at /usr/lib/python/site-packages/index.html now"),
        (4, None), (5, ""), (6, "short"), (7, f"password: {key[:32]}"), (1, f'so the token = "{key}" was lost'), (8, "a" * 5000),
    ]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    verdict = {(r["doc_id"], r["is_secret"]) for r in got}
    assert {(1, True), (7, True), (2, False), (3, False)} <= verdict and {d for d, _ in verdict} <= {1, 2, 3, 7, 8}
    assert sum(r["doc_id"] == 1 for r in got) == 2, "repeated rows have rows of their own"
    assert all(r["value_sha256"] in (hashlib.sha256(key.encode()).hexdigest(), hashlib.sha256(key[:32].encode()).hexdigest()) for r in got if r["is_secret"])


def test_training_sample_has_findings_of_all_lengths(spark, monkeypatch):
    monkeypatch.setattr(secrets, "LABELLED", 100)
    columns = [F.col("id").cast("double").alias(name) if name == "length" else F.lit(0.5).alias(name) for name in secrets.FEATURES]
    table = spark.range(1000).select(*columns, (F.col("id") % 4 == 0).cast("double").alias("label"))
    got = secrets.sampled(table).collect()
    assert Counter(r["label"] for r in got) == {1.0: 25, 0.0: 75}
    assert min(r["length"] for r in got) < 100 and max(r["length"] for r in got) > 900
    assert sorted(got) == sorted(secrets.sampled(table.repartition(5)).collect())
    monkeypatch.setattr(secrets, "LABELLED", 1000)
    assert secrets.sampled(table).count() == 1000


# ---- token counts


def test_token_counts_are_the_library_s(spark, docs):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(2)
    bits = ["a", "b", " ", "  ", "\n", "\r", "\t", "</s>", "<s>", "é", "日", "😀", "the ", "word", "▁", "0", "9", ".", ";\r", "　"]
    extra = [(5000 + i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 15)))) for i in range(1500)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = Counter(map(tuple, tokens.token_counts(df).collect()))
    want = Counter()
    for r in df.collect():
        n = len(library.encode(r["text"] or ""))
        want[r["doc_id"], len((r["text"] or "").encode()), n, n > 4096] += 1
    assert got == want


def test_a_full_dictionary_starts_anew(monkeypatch):
    import public_tokenizers
    import pyarrow as pa

    monkeypatch.setattr(tokens, "KEEP", 10)
    counter = tokens.PieceCounter(public_tokenizers.path("piece_bpe_32k.model"))
    texts = [f"word{i} other{i % 7}" for i in range(300)]
    got = np.concatenate([tokens.count_slice(counter, raw, at) for t in (texts[:150], texts[150:]) for _, _, raw, at in tokens.slices(pa.array(t))])
    assert got.tolist() == counter.whole(texts)


# ---- chat


def test_chat_round_trip(spark):
    rng = random.Random(4)
    bits = ["a", "<", "[", "\\", "|", "<|start|>", "<|end|>\n", "<|sep|>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<\\|sep|>", "\n", "é", "<s>"]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", text()]), rng.choice([text(), None])) for c in range(60) for t in range(rng.randint(1, 7))]
    rows += [(None, 0, "user", "x"), (7, None, None, None), (8, 0, "user", "same"), (8, 0, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    chats = chat.format_chat(df)
    read = {r["conv_id"]: [tuple(t) for t in r["t"]] for r in chats.select("conv_id", chat.read_chat(F.col("formatted")).alias("t")).collect()}
    want = {}
    for c, t, role, body in rows:
        want.setdefault(c, []).append(((-1 if t is None else t), role, body))
    for c, turns in want.items():
        # ties are broken by what is shown, escapes included, so only groups of equal turns may differ in order
        assert sorted((r or "", b or "") for _, r, b in turns) == sorted(read[c])
        by_turn = [t for t, _, _ in sorted(turns, key=lambda x: x[0])]
        if len(set(by_turn)) == len(by_turn):
            assert [(r or "", b or "") for _, r, b in sorted(turns, key=lambda x: x[0])] == read[c]
    for r in chat.digests(chats).collect():
        turns = read[r["conv_id"]]
        loss = "".join(b for role, b in turns if role == "assistant")
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_adjacent_turns_of_a_role_merge(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
    assert chat.format_chat(df).first()["formatted"] == "<|start|>user<|text|>a<|sep|>b<|end|>\n<|start|>assistant<|text|>c<|end|>\n"


# ---- WARC


def test_audit_finds_exactly_the_damage(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i % 50}", "<p>" + "y" * (i % 300)) for i in range(600)] + [(None, None, None), (3, "http://x/3", "<p>yyy")], "page_id long, url string, html string")
    made = warc.records(pages, files=3)
    sound = warc.leaves(made)
    assert warc.audit(sound, sound).count() == 0
    hurt = made.withColumn("record", F.when(F.col("record_id").isin(7, 500), F.concat(F.lit("Z").cast("binary"), F.expr("substring(record, 2)"))).otherwise(F.col("record")))
    found = warc.audit(sound, warc.leaves(hurt)).join(sound, ["file", "seq"]).collect()
    assert sorted(r["record_id"] for r in found) == [7, 500] and {r["status"] for r in found} == {"changed"}
    ends = sound.groupBy("file").agg(F.sum("length").alias("all"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r["all"] == r["end"] for r in ends)
    lost = warc.audit(sound, sound.where(~((F.col("file") == 1) & (F.col("seq") == 0))))
    assert {r["status"] for r in lost.collect()} <= {"missing", "changed"} and lost.count() >= 1
    whole = warc.audit(sound, sound.where("file != 2"))
    assert {r["status"] for r in whole.collect()} == {"missing"} and whole.count() == sound.where("file = 2").count()


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc_files_round_trip(spark, tmp_path, compression):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>\r\n\r\nblank {i} é") for i in range(40)], "page_id long, url string, html string")
    made = warc.records(pages, files=2)
    warc.write_warc(made, str(tmp_path / "w"), compression)
    back = warc.read_warc(spark, str(tmp_path / "w" / "part-*"))
    assert {bytes(r["record"]) for r in back.collect()} == {bytes(r["record"]) for r in made.collect()}
    assert {r["payload"].decode() for r in back.collect()} == {f"<p>\r\n\r\nblank {i} é" for i in range(40)}


# ---- language


def test_languages_held_out(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edge_cases(spark, docs):
    got = langid.identify(docs).collect()
    assert len(got) == docs.count()
    text = {d: t for d, t, _ in rows_of(docs)}
    for r in got:
        if r["doc_id"] is not None and not any(c.isalpha() for c in text[r["doc_id"]] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in ("en", "fr")
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)


def test_trigrams_by_hand():
    raw = "Ab1c".encode()
    row, which, names, count = langid.trigrams(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))
    shown = Counter("".join(chr(c) if c else "_" for c in names[w]) for w in which)
    assert shown == Counter(["_ab", "ab_"]) or shown == Counter(["_ab", "ab_", "b_c"]) - Counter(["b_c"])
    assert count.tolist() == [3] and row.tolist() == [0] * len(which)
