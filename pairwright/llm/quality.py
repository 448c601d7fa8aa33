"""Quality rules with adaptive thresholds, in DataFrame functions only.

Base measures are taken over every whole text. On the texts that pass the base rules three ratios are sketched by language and
source: symbols per word character (in thousandths), word characters per word (hundredths) and repeated lines per line
(thousandths). A sketch is a log-linear histogram: a value's bucket is its leading six bits, so quantiles are right to 1/32 and
two sketches merge by adding counts, in any order, with one result. A document is kept if each ratio lies within FENCE
spreads of the median of its language and source; the spread is that from the lower quartile to the median, and SLACK at
least. Sketches of fewer than SUPPORT documents merge into that of the language, and those into that of the corpus.

Defined results: a null or empty text has zeros throughout and fails the base rules; null lang or source is a group of its own;
repeated rows count each; extra columns pass through `filter_quality`, whatever their names; an empty table gives no rows.

`filter_quality` writes the narrow measures only. What they reject is named by (doc_id, text, lang, source), on which the verdict
depends, and taken out of docs by an anti-join: the texts are read twice and never written but as the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_CHARS, broadcast_if, cut, documents, drop, let, packed, text_key, words

WINDOW = 8
FENCE = 6
SUPPORT = 50
#: Least spread of each ratio, in its unit.
SLACK = {"symbols": 5, "length": 40, "lines": 80}
#: Ratios that are too low as well as too high count against a text.
TWO_SIDED = {"length"}
#: Threshold rows broadcast at most, about 100 bytes each.
BROADCAST_GROUPS = 100_000
#: Rejected rows broadcast at most, about 60 bytes each; beyond it the anti-join shuffles.
BROADCAST_REJECTED = 1_000_000
_ORDER = ("n_words", "word_chars", "n_repeat_words")


def _repeats(w: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more in the array w."""

    def spread(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            same = F.filter(s, lambda e, j: (F.get(s, j - 1)["h"].eqNullSafe(e["h"])) | (F.get(s, j + 1)["h"].eqNullSafe(e["h"])))
            return F.array_sort(F.transform(same, lambda e: e["i"]))

        def covered(p: Column) -> Column:
            own = F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))))
            return F.aggregate(own, F.lit(0), lambda a, x: a + x)

        return let(let(placed, positions), covered)

    def windows(one: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(one) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(one, i, WINDOW)))

    hashes = let(F.transform(w, lambda x: F.xxhash64(x)), windows)
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(spread(h)))
    return F.when(F.size(w) <= WINDOW, 0).otherwise(found)


def measures(text: Column) -> dict[str, Column]:
    """Columns _m (a struct of the word measures), n_symbols, _lines."""
    full = F.coalesce(text, F.lit(""))
    by_word = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeats(w).cast("long").alias("n_repeat_words")))
    lines = F.filter(F.split(full, "\n"), lambda x: F.trim(x, F.lit(SPACE_CHARS)) != "")
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    return {"_m": by_word, "_l": by_line, "_symbols": F.length(F.regexp_replace(full, r"[^#*$%&|<>]+", "")).cast("long")}


def measured(docs: DataFrame) -> DataFrame:
    """docs with the base measures and base_failed, each prefixed by _."""
    out = docs.withColumns(measures(F.col("text")))
    named = {f"_{k}": F.col("_m")[k] for k in _ORDER} | {"_n_symbols": F.col("_symbols"), "_n_dup_lines": F.col("_l")["dup"], "_n_lines": F.col("_l")["n"]}
    out = out.withColumns(named).drop("_m", "_l", "_symbols")
    return out.withColumn("_base_failed", (F.col("_n_words") < 20) | (F.col("_n_repeat_words") * 100 > F.col("_n_words") * 30))


def ratios() -> dict[str, Column]:
    return {
        "symbols": F.expr("_n_symbols * 1000 div greatest(_word_chars, 1)"),
        "length": F.expr("_word_chars * 100 div greatest(_n_words, 1)"),
        "lines": F.expr("_n_dup_lines * 1000 div greatest(_n_lines, 1)"),
    }


def bucket(value: Column) -> Column:
    """The least value of the bucket: the leading six bits."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return value - value % F.pow(F.lit(2.0), shift).cast("long")


def sketch(passing: DataFrame) -> DataFrame:
    """Counts (lang, source, ratio, low, c); adding the counts of two such tables merges them."""
    each = F.array(*(F.struct(F.lit(k).alias("ratio"), bucket(v).alias("low")) for k, v in ratios().items()))
    return passing.select("lang", "source", F.explode(each).alias("x")).groupBy("lang", "source", "x.ratio", "x.low").agg(F.count(F.lit(1)).alias("c"))


def _quartiles(counts: DataFrame, keys: list[str], name: str) -> DataFrame:
    by = Window.partitionBy(*keys, "ratio")
    run = counts.groupBy(*keys, "ratio", "low").agg(F.sum("c").alias("c"))
    run = run.withColumns({"n": F.sum("c").over(by), "upto": F.sum("c").over(by.orderBy("low"))})
    q = run.groupBy(*keys, "ratio").agg(F.max("n").alias(f"n{name}"), F.min(F.when(F.col("upto") * 4 >= F.col("n"), F.col("low"))).alias(f"q{name}"), F.min(F.when(F.col("upto") * 2 >= F.col("n"), F.col("low"))).alias(f"m{name}"))
    return q


def thresholds(counts: DataFrame) -> DataFrame:
    """(lang, source) with a low and a high fence for each ratio."""
    fine = _quartiles(counts, ["lang", "source"], "0")
    lang = _quartiles(counts, ["lang"], "1").withColumnsRenamed({"lang": "_lang", "ratio": "_ratio"})
    whole = _quartiles(counts, [], "2").withColumnRenamed("ratio", "_r")
    joined = fine.join(lang, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("ratio") == F.col("_ratio"))).join(F.broadcast(whole), F.col("ratio") == F.col("_r"))

    def level(x: str) -> Column:
        return F.when(F.col("n0") >= SUPPORT, F.col(f"{x}0")).when(F.col("n1") >= SUPPORT, F.col(f"{x}1")).otherwise(F.col(f"{x}2"))

    slack = F.create_map(*(F.lit(x) for pair in SLACK.items() for x in pair))[F.col("ratio")]
    spread = FENCE * F.greatest(level("m") - level("q"), slack)
    low = F.when(F.col("ratio").isin(*TWO_SIDED), level("m") - spread).otherwise(F.lit(-1))
    fences = joined.select("lang", "source", "ratio", low.alias("low"), (level("m") + spread).alias("high"))
    one = [F.max(F.when(F.col("ratio") == k, F.col(x))).alias(f"_{x}_{k}") for k in SLACK for x in ("low", "high")]
    return fences.groupBy(F.col("lang").alias("_lang"), F.col("source").alias("_source")).agg(*one)


def judged(found: DataFrame) -> DataFrame:
    """found (measures that were written once) with _kept: sketches, thresholds and the filter all read it."""
    fences = cut(thresholds(sketch(found.where("NOT _base_failed"))), "fences")
    on = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    within = F.lit(True)
    for k, v in ratios().items():
        within = within & v.between(F.col(f"_low_{k}"), F.col(f"_high_{k}"))
    joined = found.join(broadcast_if(fences, fences.count(), BROADCAST_GROUPS), on, "left")
    return joined.withColumn("_kept", ~F.col("_base_failed") & F.coalesce(within, F.lit(True)))


def filter_quality(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with the columns of docs."""
    names = ["doc_id", "text", "lang", "source"]
    rows = packed(docs, *names)
    found = cut(measured(rows.select(*names, *text_key())).drop("text"), "measures")
    on = ["doc_id", "lang", "source", "_t1", "_t2"]
    gone = cut(judged(found).where("NOT _kept").select(on).distinct(), "rejected")
    drop(found)
    gone = gone.toDF(*(f"x{i}" for i in range(len(on))))
    same = F.lit(True)
    for i, c in enumerate(on):
        same = same & F.col(c).eqNullSafe(F.col(f"x{i}"))
    return rows.withColumns(dict(zip(("_t1", "_t2"), text_key(), strict=True))).join(broadcast_if(gone, gone.count(), BROADCAST_REJECTED), same, "left_anti").select("row.*")


def op5_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    found = judged(cut(measured(docs).drop("text"), "measures"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return found.select("doc_id", *(F.col(f"_{c}").alias(c) for c in names))


#: The same for DuckDB.
QUALITY_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS t,
         regexp_replace(regexp_replace(coalesce(text, ''), '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS b
  FROM documents),
w AS (
  SELECT *, CASE WHEN b = '' THEN CAST([] AS VARCHAR[]) ELSE regexp_split_to_array(b, '[\x20\x09-\x0D]+') END AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d),
g AS (
  SELECT k, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) > 8),
h AS (
  SELECT k, i, count(*) OVER (PARTITION BY k, array_to_string(ws[i:i + 7], ' ')) AS c FROM g),
p AS (
  SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS nx FROM h WHERE c > 1),
r AS (
  SELECT k, sum(least(8, coalesce(nx - i, 8))) AS rep FROM p GROUP BY k),
m AS (
  SELECT w.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(coalesce(rep, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN r ON w.k = r.k),
f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         n_symbols * 1000 // greatest(word_chars, 1) AS symbols, word_chars * 100 // greatest(n_words, 1) AS length_,
         n_dup_lines * 1000 // greatest(n_lines, 1) AS lines
  FROM m),
x AS (
  SELECT lang, source, 'symbols' AS ratio, symbols AS v FROM f WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'length', length_ FROM f WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'lines', lines FROM f WHERE NOT base_failed),
s AS (
  SELECT lang, source, ratio, v - v % CAST(pow(2, greatest(length(bin(v)) - 6, 0)) AS BIGINT) AS low FROM x),
c0 AS (
  SELECT lang, source, ratio, low, sum(count(*)) OVER (PARTITION BY lang, source, ratio) AS n,
         sum(count(*)) OVER (PARTITION BY lang, source, ratio ORDER BY low) AS u FROM s GROUP BY lang, source, ratio, low),
c1 AS (
  SELECT lang, ratio, low, sum(count(*)) OVER (PARTITION BY lang, ratio) AS n,
         sum(count(*)) OVER (PARTITION BY lang, ratio ORDER BY low) AS u FROM s GROUP BY lang, ratio, low),
c2 AS (
  SELECT ratio, low, sum(count(*)) OVER (PARTITION BY ratio) AS n,
         sum(count(*)) OVER (PARTITION BY ratio ORDER BY low) AS u FROM s GROUP BY ratio, low),
q0 AS (SELECT lang, source, ratio, max(n) AS n, min(CASE WHEN u * 4 >= n THEN low END) AS q, min(CASE WHEN u * 2 >= n THEN low END) AS m FROM c0 GROUP BY lang, source, ratio),
q1 AS (SELECT lang, ratio, max(n) AS n, min(CASE WHEN u * 4 >= n THEN low END) AS q, min(CASE WHEN u * 2 >= n THEN low END) AS m FROM c1 GROUP BY lang, ratio),
q2 AS (SELECT ratio, max(n) AS n, min(CASE WHEN u * 4 >= n THEN low END) AS q, min(CASE WHEN u * 2 >= n THEN low END) AS m FROM c2 GROUP BY ratio),
l AS (
  SELECT q0.lang, q0.source, q0.ratio,
         CASE WHEN q0.n >= 50 THEN q0.q WHEN q1.n >= 50 THEN q1.q ELSE q2.q END AS q,
         CASE WHEN q0.n >= 50 THEN q0.m WHEN q1.n >= 50 THEN q1.m ELSE q2.m END AS m,
         CASE q0.ratio WHEN 'symbols' THEN 5 WHEN 'length' THEN 40 ELSE 80 END AS slack
  FROM q0 JOIN q1 ON q0.lang IS NOT DISTINCT FROM q1.lang AND q0.ratio = q1.ratio JOIN q2 ON q0.ratio = q2.ratio),
t AS (
  SELECT lang, source,
         max(CASE WHEN ratio = 'symbols' THEN m + 6 * greatest(m - q, slack) END) AS hs,
         max(CASE WHEN ratio = 'length' THEN m + 6 * greatest(m - q, slack) END) AS hw,
         max(CASE WHEN ratio = 'length' THEN m - 6 * greatest(m - q, slack) END) AS lw,
         max(CASE WHEN ratio = 'lines' THEN m + 6 * greatest(m - q, slack) END) AS hl
  FROM l GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(symbols <= hs AND length_ BETWEEN lw AND hw AND lines <= hl, TRUE) AS kept
FROM f LEFT JOIN t ON f.lang IS NOT DISTINCT FROM t.lang AND f.source IS NOT DISTINCT FROM t.source
"""
