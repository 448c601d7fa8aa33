"""Secret scan: candidate strings from every word of every text, and a random forest that tells secrets from false findings.

Candidates are runs of LONG key characters or more with digits, symbols or mixed case, and shorter values (from SHORTEST characters,
symbols included) that a word like `password` or `token` announces: any behind an assignment, others where they aren't plain words.

Features of a candidate: length, shares of digits, capitals and symbols, transitions between character classes, distinct characters,
dictionary coverage (the share of its characters in letter runs that are words of the corpus, seen in DICTIONARY places or more),
path and address marks, quotes and assignments around it, and what its neighbouring words say: the two before, those inside of its
own word and the one after are hashed into BUCKETS, and each bucket weighs as much as the labelled findings make it likely.
Findings and training rows take their features from the same code and the same dictionary.

Everything is a DataFrame expression; the forest is the JVM's, trained from labelled findings: a table (value, word, before, after,
label), of which LABELLED rows at most are used. `labelled_findings` builds the default one from expressions, with secrets and
look-alikes (digests of commits, ids, paths, addresses, identifiers, plain words) in usual surroundings, its plain words being
the commonest of the corpus; pass your own reviewed findings instead where you have them.

The dictionary counts every word of the corpus: partial counts are made before the shuffle, so it moves each task's distinct words.

Defined results: null and empty texts have no candidates; a word with several candidates has a row for each (`part`); repeated
rows have rows of their own; with no candidate at all the result is empty; extra columns are ignored. Values are never
returned: only their digest.
"""

from __future__ import annotations

from math import log

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if, cut, documents, drop, let, words

LONG = 16
SHORTEST = 6
CANDIDATE = rf"[A-Za-z0-9+/_.\-]{{{LONG},}}={{0,2}}"
DICTIONARY = 5
BUCKETS = 1024
LABELLED = 20_000
TREES, DEPTH, SEED = 32, 9, 17
#: Distinct candidates broadcast at most when their coverage is joined back (about 60 bytes each).
BROADCAST_VALUES = 500_000
#: Commonest words of the corpus that the default findings are made with, at most.
COMMON = 200
#: Words that announce a value.
ASKING = r"(?i)passw|passphrase|pwd|secret|token|key|auth|credential|bearer|private|login"
FEATURES = ("length", "digits", "capitals", "symbols", "switches", "variety", "coverage", "slashes", "dots", "address", "neighbours", "assigned", "quoted")
_PLAIN = r"^[A-Za-z][a-z]*$|^[A-Z]+$"


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, pos (of the word), part, value and its surroundings, for every candidate of every text."""

    def around(w: Column) -> Column:
        numbered = F.transform(w, lambda x, i: F.struct(x.alias("word"), i.alias("i")))

        def asked(x: Column) -> Column:
            return F.concat_ws(" ", F.get(w, x["i"] - 2), F.get(w, x["i"] - 1), x["word"]).rlike(ASKING)

        long = F.filter(numbered, lambda x: (F.length(x["word"]) >= LONG) | (F.col("asks") & (F.length(x["word"]) >= SHORTEST) & asked(x)))
        return F.transform(long, lambda x: F.struct(x["i"].alias("pos"), x["word"].alias("word"), F.concat_ws(" ", F.get(w, x["i"] - 2), F.get(w, x["i"] - 1)).alias("before"), F.coalesce(F.get(w, x["i"] + 1), F.lit("")).alias("after")))

    marked = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(ASKING), F.lit(False)).alias("asks"))
    found = marked.select("doc_id", F.explode(let(words(F.col("text")), around)).alias("x")).select("doc_id", "x.*")
    return found.select("*", F.posexplode(values()).alias("part", "value"))


def values() -> Column:
    """The candidates inside `word`, from it and `before`."""
    shaped = F.filter(F.regexp_extract_all("word", F.lit(f"({CANDIDATE})"), 1), lambda x: x.rlike("[0-9]") | x.rlike("[a-z][A-Z]") | x.rlike("[+/_]"))
    lead = F.regexp_extract("word", r"^(.*[=:])[^=:]{6,}=*$", 1)
    said = F.concat_ws(" ", "before", lead)
    own = F.regexp_extract("word", r"^(?:.*[=:])?[\"'`(\[{<]*(.{6,}?)[\"'`)\]}>,;.]*$", 1)
    wanted = said.rlike(ASKING) & (F.length(own) >= SHORTEST) & (said.rlike(r"[=:]\s*[\"']?$") | ~own.rlike(_PLAIN))
    short = F.when(wanted, F.array(own)).otherwise(F.array().cast("array<string>"))
    return F.concat(short, F.filter(shaped, lambda x: ~F.coalesce(wanted & own.contains(x), F.lit(False))))


def buckets() -> Column:
    """Hashes of the words around a value: before it (and inside of its word), and behind it."""
    lead = F.expr("substring(word, 1, instr(word, value) - 1)")

    def hashed(text: Column, side: str) -> Column:
        return F.transform(F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), 1), lambda x: F.pmod(F.xxhash64(F.lit(side), x), F.lit(BUCKETS)))

    return F.array_distinct(F.concat(hashed(F.concat_ws(" ", "before", lead), "before"), hashed(F.col("after"), "after")))


def features(found: DataFrame, weights: list[float]) -> DataFrame:
    """Adds FEATURES to (word, value, before, after, coverage)."""
    n = F.length("value")

    def share(pattern: str) -> Column:
        return F.regexp_count("value", F.lit(pattern)) / n

    said = F.concat_ws(" ", "before", F.expr("substring(word, 1, instr(word, value) - 1)"))
    table = F.array(*map(F.lit, weights))
    neighbours = let(table, lambda t: F.aggregate(buckets(), F.lit(0.0), lambda a, b: a + F.get(t, b.cast("int"))))
    return found.withColumns({
        "length": n.cast("double"), "digits": share("[0-9]"), "capitals": share("[A-Z]"), "symbols": share("[^A-Za-z0-9]"),
        "switches": (F.regexp_count("value", F.lit(r"[A-Z]+|[a-z]+|[0-9]+|[^A-Za-z0-9]+")) - 1) / n,
        "variety": F.size(F.array_distinct(F.split(F.lower("value"), ""))) / n,
        "slashes": share("/"), "dots": share(r"[.]"), "address": F.col("word").rlike("@|://|^www|^/|^[.]").cast("double"),
        "neighbours": neighbours, "assigned": said.rlike("[=:]\\s*[\"']?$").cast("double"), "quoted": F.col("word").rlike("[\"'`]").cast("double"),
    })


def dictionary(docs: DataFrame) -> DataFrame:
    """(run, n): the words of letters alone, of 3 to LONG - 1, that occur DICTIONARY times or more."""
    split = F.split(F.lower("text"), r"[\x20\x09-\x0D\p{Punct}]+")
    spoken = docs.select(F.explode(split).alias("run")).where(F.length("run").between(3, LONG - 1))
    return spoken.groupBy("run").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= DICTIONARY) & F.col("run").rlike(r"^\p{L}+$"))


def covered(found: DataFrame, known: DataFrame) -> DataFrame:
    """Adds coverage, looked up once for each distinct value."""
    runs = F.regexp_extract_all("value", F.lit("([A-Za-z]{3,})"), 1)
    distinct = found.select("value").distinct()
    lengths = distinct.select("value", F.explode(runs).alias("run")).join(known.select(F.col("run").alias("spoken")), F.lower("run") == F.col("spoken"))
    shares = cut(lengths.groupBy("value").agg((F.sum(F.length("run")) / F.length("value")).alias("coverage")), "coverage")
    joined = found.join(broadcast_if(shares, shares.count(), BROADCAST_VALUES), "value", "left")
    return joined.withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))


def labelled_findings(spark: SparkSession, common: list[str] | None = None, rows: int = 6000, seed: int = 0) -> DataFrame:
    """Findings (value, word, before, after, label) made from expressions: row i is of kind i mod the number of kinds."""
    i = F.col("id")
    common = [w for w in common or [] if w.isascii()] or "reader market window garden number simple public winter service account handler builder".split()
    hexa, other = F.sha2(F.concat_ws("/", i, F.lit(seed)).cast("binary"), 256), F.md5(F.concat_ws("/", i, F.lit(seed)).cast("binary"))
    b64 = F.regexp_replace(F.base64(F.unhex(hexa)), "=", "")
    alnum = F.regexp_replace(b64, "[^A-Za-z0-9]", "")

    def pick(salt: int, options: list[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.xxhash64(i, F.lit(salt), F.lit(seed)), F.lit(len(options))) + 1).cast("int"))

    word, word2, word3 = (pick(k, common) for k in (1, 2, 3))
    number = F.pmod(F.xxhash64(i, F.lit(4)), F.lit(9000)).cast("string")
    mark = pick(5, [" =", ":", " :", ":="])
    asker = pick(6, "token api_key secret password passwd pwd auth_token client_secret private_key access_key bearer credential passphrase login secret_key apikey".split())
    ask = F.concat(asker, mark)
    word_ask = F.concat(pick(7, ["password", "passwd", "pwd", "passphrase"]), mark)
    deny = F.concat(pick(8, "commit sha256 md5 checksum revision uuid etag digest sha1 hash build request_id trace_id version object blob fingerprint".split()), pick(9, ["", ":", " ="]))
    prose = F.concat_ws(" ", word2, word3)
    symbol, symbol2 = pick(10, list("!@#$%&*?")), pick(11, list("-_.!+"))
    uuid = F.concat_ws("-", *(F.substring(other, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    kinds = [
        (F.substring(hexa, 1, 40), ask, 1), (F.substring(other, 1, 32), ask, 1), (b64, ask, 1), (hexa, ask, 1),
        (F.concat(pick(12, ["ghp_", "sk-", "xoxb-", "glpat-"]), F.substring(alnum, 1, 36)), F.when(i % 2 == 0, prose).otherwise(ask), 1),
        (F.concat(F.lit("AKIA"), F.upper(F.substring(alnum, 1, 16))), ask, 1),
        (F.concat(word, number), ask, 1), (F.concat(F.initcap(word), symbol2, number, symbol), ask, 1), (F.substring(alnum, 1, 10), ask, 1),
        (F.concat(word, word2), word_ask, 1),
        (F.substring(hexa, 1, 40), deny, 0), (uuid, F.when(i % 2 == 0, prose).otherwise(deny), 0), (hexa, deny, 0), (F.substring(other, 1, 32), deny, 0),
        (F.concat(F.lit("/usr/"), word, F.lit("/"), word2, F.lit("-2.10/index.html")), prose, 0),
        (F.concat(word, F.initcap(word2), F.initcap(word3)), F.when(i % 3 == 0, ask).otherwise(prose), 0),
        (F.concat(F.lit("www."), word, F.lit("."), word2, F.lit(".com/"), F.substring(other, 1, 6)), prose, 0),
        (F.concat(word, F.lit("."), word2, number, F.lit("@"), word3, F.lit(".com")), F.when(i % 3 == 0, F.lit("login:")).otherwise(prose), 0),
        (F.concat(F.lit("9"), F.substring(F.conv(F.substring(hexa, 1, 15), 16, 10), 1, 15)), F.when(i % 2 == 0, prose).otherwise(F.lit("order number")), 0),
        (F.concat_ws("_", word, word2, word3), F.when(i % 3 == 0, ask).otherwise(prose), 0),
        (word, F.when(i % 2 == 0, F.concat(pick(13, ["key", "token", "login", "auth"]), F.lit(":"))).otherwise(F.concat_ws(" ", F.lit("the"), asker)), 0),
        (F.concat_ws("-", word, word2), F.concat_ws(" ", F.lit("the"), asker), 0),
    ]

    def of(k: int) -> Column:
        out = F.lit(None)
        for j, kind in enumerate(kinds):
            out = F.when(i % len(kinds) == j, F.lit(float(kind[k])) if isinstance(kind[k], int) else kind[k]).otherwise(out)
        return out

    quote = pick(14, ["", '"', "'", ""])
    made = spark.range(0, rows, 1, 1).select(of(0).cast("string").alias("value"), of(1).cast("string").alias("before"), word3.alias("after"), of(2).cast("double").alias("label"), quote.alias("q"))
    return made.select("value", F.concat("q", "value", "q").alias("word"), "before", "after", "label")


def weights_of(labelled: DataFrame) -> list[float]:
    """The log odds of each bucket of neighbouring words, smoothed by one finding of either label."""
    seen = labelled.select("label", F.explode(buckets()).alias("b")).groupBy("b").agg(F.sum("label").alias("y"), F.sum(1 - F.col("label")).alias("n"))
    out = [0.0] * BUCKETS
    for r in seen.collect():
        out[r["b"]] = round(log((r["y"] + 1) / (r["n"] + 1)), 6)
    return out


def sampled(labelled: DataFrame) -> DataFrame:
    """LABELLED rows at most: of each label its share of them, by a hash of the features, which no feature decides."""
    rows = labelled.select(*FEATURES, "label")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    total = sum(counts.values())
    if total <= LABELLED:
        return rows
    out = rows.limit(0)
    for label, n in sorted(counts.items()):
        mine = rows.where(F.col("label") == label).orderBy(F.xxhash64(*FEATURES), *FEATURES)
        out = out.union(mine.limit(max(1, n * LABELLED // total)))
    return out


class Forest:
    """The forest and the neighbours' weights, from labelled findings; rows are taken in one fixed order, so that reruns agree."""

    def __init__(self, labelled: DataFrame, known: DataFrame):
        labelled = cut(labelled.select("value", "word", "before", "after", F.col("label").cast("double").alias("label")), "labelled")
        self.weights, self.known = weights_of(labelled), known
        rows = sampled(features(covered(labelled, known), self.weights)).orderBy(*FEATURES, "label").coalesce(1)
        forest = RandomForestClassifier(featuresCol="_v", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, probabilityCol="_p", predictionCol="_y", rawPredictionCol="_r")
        self.assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="_v")
        self.model = forest.fit(self.assembler.transform(rows))
        drop(labelled)

    def score(self, found: DataFrame) -> DataFrame:
        """found (value, word, before, after) with FEATURES and score."""
        scored = self.model.transform(self.assembler.transform(features(covered(found, self.known), self.weights)))
        return scored.withColumn("score", vector_to_array("_p")[1]).drop("_v", "_p", "_y", "_r")


def scan(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """doc_id, pos, part, length, coverage, value_sha256, score, is_secret for every candidate."""
    docs = docs.select("doc_id", "text")
    found = cut(candidates(docs), "candidates")
    known = cut(dictionary(docs), "dictionary")
    if labelled is None:
        common = known.where(F.length("run").between(4, 9)).orderBy(F.desc("n"), "run").limit(COMMON)
        labelled = labelled_findings(docs.sparkSession, [r["run"] for r in common.collect()])
    scored = Forest(labelled, known).score(found)
    return scored.select("doc_id", F.col("pos").cast("long").alias("pos"), "part", F.length("value").alias("length"), "coverage", F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), "score", (F.col("score") >= 0.5).alias("is_secret"))


def op6_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
