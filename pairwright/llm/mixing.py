"""Mixing sources to target weights by entropy balancing.

Targets: sources in code point order (null last) weigh 1, 2, 3, repeating; a target stops at CAP times its source and the excess
is shared by weight among the others (water filling, solved in closed form over the sources).

Rates: among all document rates r with sum(r * size) equal to the target of each source and r <= CAP, those nearest to 1 in
relative entropy are r = min(CAP, exp(lambda * size)). The lambdas solve the convex dual; each Newton iteration is one
distributed aggregation of gradient and curvature by source, guarded by a bracket. As r depends on source and size alone, the
iterations run over counts by (source, size), never over documents.

Copies: rates are rounded systematically along each source in order of size, and what the rounding left over is closed with
the smallest documents. Inside a group of equal source and size the extra copies go to the rows of least (hash of doc_id, text).
Which these are is found without ordering the group: rows are counted by the leading bits of the hash, about BUCKET rows in
each, and only the one bucket that holds the last extra copy is ranked. Rows that are equal in doc_id and text are told apart by
their place in the input, counted by partition. So copies are exact by row, no task holds a group, and reruns agree.

Defined results: a null text has size 0; documents of size 0 have one copy and take 0 words; repeated rows, null and repeated
doc_ids are documents of their own; extra columns pass through `mix`, whatever their names; an empty table gives no rows; targets
that the iterations don't reach raise an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, broadcast_if, cut, documents, drop, packed, text_key

CAP = 3
#: Rows of a group that are ranked together, on average.
BUCKET = 512
ITERATIONS = 80
#: Sums that steer the iterations are decimals, so their result doesn't depend on the order of partitions.
EXACT = "decimal(30,6)"
#: Groups of (source, size) broadcast at most, about 40 bytes each.
BROADCAST_GROUPS = 500_000


def source_key() -> Column:
    """The source as a key that is never null; null sorts last."""
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))


def sizes(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(counts: DataFrame, cap: int = CAP) -> DataFrame:
    """(key, total, scale, target) from counts (key, size, c)."""
    by = counts.groupBy("key").agg(F.sum(F.col("size") * F.col("c")).alias("total"), F.sum((F.col("size") * F.col("size")).cast("decimal(30,0)") * F.col("c")).cast("double").alias("square"))
    rank = F.row_number().over(Window.orderBy(F.col("key") == "", "key"))
    by = by.withColumn("weight", (rank - 1) % 3 + 1).withColumn("ratio", F.col("total") * cap / F.col("weight"))
    every, before = Window.partitionBy(), Window.orderBy("ratio", "key").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("total").over(every) - F.coalesce(F.sum(F.col("total") * cap).over(before), F.lit(0))
    weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    by = by.withColumn("level", rest / weight).withColumn("full", F.col("ratio") < F.col("level"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(every)
    target = F.when(F.col("full"), (F.col("total") * cap).cast("double")).otherwise(level * F.col("weight"))
    return by.select("key", "total", (F.col("square") / F.greatest("total", F.lit(1))).alias("scale"), target.alias("target"))


def _rate(cap: int) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.col("lam") * F.col("size") / F.col("scale")))


def solve(counts: DataFrame, sources: DataFrame, cap: int = CAP) -> DataFrame:
    """sources with lam: Newton on the dual of each source until the words it would take are right to half a word or 1e-9."""
    none = F.lit(None).cast("double")
    at_cap = F.col("target") >= F.col("total") * cap * (1 - 1e-12)
    state = cut(sources.withColumns({"lam": F.when(at_cap, 1e12).otherwise(0.0), "lo": none, "hi": none, "off": none, "done": at_cap | (F.col("total") == 0)}), "dual")
    used = counts.where("size > 0").groupBy("key", "size").agg(F.sum("c").alias("c"))
    for _ in range(ITERATIONS):
        if state.where("NOT done").isEmpty():
            break
        rate, slope = _rate(cap), F.col("size") / F.col("scale")
        words = F.col("c") * F.col("size") * rate
        taken = F.sum(words.cast(EXACT)).cast("double").alias("taken")
        curve = F.sum(F.when(rate < cap, words * slope).otherwise(0.0).cast(EXACT)).cast("double").alias("curve")
        step = used.join(state.where("NOT done").select("key", "scale", "lam"), "key").groupBy("key").agg(taken, curve)
        s = state.join(step, "key", "left").withColumn("off", F.coalesce(F.col("taken") - F.col("target"), "off"))
        s = s.withColumns({"lo": F.when(F.col("off") < 0, F.col("lam")).otherwise(F.col("lo")), "hi": F.when(F.col("off") > 0, F.col("lam")).otherwise(F.col("hi"))})
        far = F.greatest(F.lit(2.0), F.abs("lam"))
        newton = F.when(F.col("curve") > 0, F.col("lam") - F.col("off") / F.col("curve"))
        newton = F.least(F.greatest(F.coalesce(newton, F.when(F.col("off") < 0, F.col("lam") + far).otherwise(F.col("lam") - far)), F.col("lam") - far), F.col("lam") + far)
        inside = (F.col("lo").isNull() | (newton > F.col("lo"))) & (F.col("hi").isNull() | (newton < F.col("hi")))
        moved = F.when(inside, newton).otherwise((F.col("lo") + F.col("hi")) / 2)
        close = F.abs("off") <= F.greatest(F.lit(0.5), F.col("target") * 1e-9)
        s = s.withColumn("done", F.col("done") | F.coalesce(close, F.lit(False)))
        after = cut(s.withColumn("lam", F.when(F.col("done"), F.col("lam")).otherwise(moved)).select(state.columns), "dual")
        drop(state)
        state = after
    else:
        open_ = state.where("NOT done").count()
        if open_:
            raise ArithmeticError(f"{open_} sources didn't reach their targets in {ITERATIONS} iterations")
    return state


def allotted(counts: DataFrame, cap: int = CAP) -> DataFrame:
    """(key, size, c, total, target, rate, base, extra): each document of a group has base copies, and extra of them one more.
    Windows run over the sizes of a source, of which there are no more than words in its longest text."""
    solved = solve(counts, targets(counts, cap), cap)
    groups = counts.join(solved.select("key", "total", "scale", "target", "lam"), "key").withColumn("rate", F.when(F.col("size") == 0, 1.0).otherwise(_rate(cap)))
    down = Window.partitionBy("key").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy("key").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("key")
    mass = F.when(F.col("size") > 0, F.col("c") * F.col("rate")).otherwise(0.0)
    groups = groups.withColumn("mass", mass).withColumn("run", F.sum("mass").over(down))
    copies = F.floor(F.col("run") + 0.5) - F.floor(F.col("run") - F.col("mass") + 0.5)
    groups = groups.withColumn("m", F.when(F.col("size") == 0, F.col("c")).otherwise(F.least(F.greatest(copies, F.lit(0)), F.col("c") * cap)))
    groups = groups.withColumn("gap", F.col("target") - F.sum(F.col("m") * F.col("size")).over(every))
    room = F.when(F.col("gap") >= 0, (F.col("c") * cap - F.col("m")) * F.col("size")).otherwise(F.col("m") * F.col("size"))
    groups = groups.withColumn("room", room).withColumn("passed", F.coalesce(F.sum("room").over(up), F.lit(0)))
    close = F.floor(F.greatest(F.lit(0.0), F.least(F.col("room"), F.abs("gap") - F.col("passed"))) / F.greatest("size", F.lit(1)))
    groups = groups.withColumn("m", F.col("m") + F.when(F.col("gap") >= 0, close).otherwise(-close))
    return groups.select("key", "size", "c", "total", "target", "rate", F.expr("m div c").alias("base"), F.expr("m % c").alias("extra"))


def _bucket() -> Column:
    """The leading bits of the hash h, as many as leave about BUCKET of c rows to a bucket; in the order of h."""
    bits = F.expr(f"length(bin(c div {BUCKET})) - cast(c < {BUCKET} as int)")
    return F.when(bits == 0, 0).otherwise(F.call_function("shiftright", F.col("h"), 64 - bits))


def edges(sized: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    """(key, size, eh, e1, e2, need, ties): the last row to get an extra copy in each group that has some; of the `ties` rows that
    are equal to it, `need` get one."""
    open_ = broadcast_if(groups.where("extra > 0").select("key", "size", "c", "extra"), n, BROADCAST_GROUPS)
    rows = sized.join(open_, ["key", "size"]).withColumn("bucket", _bucket())
    of = Window.partitionBy("key", "size").orderBy("bucket")
    held = rows.groupBy("key", "size", "bucket").agg(F.count(F.lit(1)).alias("b"), F.first("extra").alias("extra")).withColumn("upto", F.sum("b").over(of))
    last = held.where((F.col("upto") >= F.col("extra")) & (F.col("upto") - F.col("b") < F.col("extra"))).select("key", "size", "bucket", (F.col("extra") - F.col("upto") + F.col("b")).alias("left"))
    near = rows.join(broadcast_if(last, n, BROADCAST_GROUPS), ["key", "size", "bucket"]).groupBy("key", "size", "h", "_t1", "_t2").agg(F.count(F.lit(1)).alias("ties"), F.first("left").alias("left"))
    seen = near.withColumn("upto", F.sum("ties").over(Window.partitionBy("key", "size").orderBy("h", "_t1", "_t2")))
    at = seen.where((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("ties") < F.col("left")))
    return at.select("key", "size", F.col("h").alias("eh"), F.col("_t1").alias("e1"), F.col("_t2").alias("e2"), (F.col("left") - F.col("upto") + F.col("ties")).alias("need"), "ties")


def plan(sized: DataFrame, cap: int = CAP) -> tuple[DataFrame, int, bool]:
    """(key, size, total, target, rate, base, eh, e1, e2, need, ties) for rows (key, size, h, _t1, _t2), how many groups there are,
    and whether an edge lies among rows that are equal."""
    counts = cut(sized.groupBy("key", "size").agg(F.count(F.lit(1)).alias("c")), "counts")
    groups = cut(allotted(counts, cap), "copies")
    n = groups.count()
    out = cut(groups.drop("c", "extra").join(edges(sized, groups, n), ["key", "size"], "left"), "plan")
    drop(counts, groups)
    return out, n, not out.where("need < ties").isEmpty()


def copied(rows: DataFrame, groups: DataFrame, n: int, tied: bool) -> DataFrame:
    """rows (with key, size, h, _t1, _t2) with total, target, rate and copies; the plan is broadcast only while its counted groups are few."""
    joined = rows.join(broadcast_if(groups, n, BROADCAST_GROUPS), ["key", "size"])
    place, edge = F.struct("h", "_t1", "_t2"), F.struct(F.col("eh").alias("h"), F.col("e1").alias("_t1"), F.col("e2").alias("_t2"))
    sure = F.coalesce((place < edge) | ((place == edge) & (F.col("need") >= F.col("ties"))), F.lit(False))
    out = joined.withColumns({"copies": F.col("base") + sure.cast("long"), "open": F.coalesce((place == edge) & (F.col("need") < F.col("ties")), F.lit(False))})
    keep = [*rows.columns, "total", "target", "rate", "copies"]
    if not tied:
        return out.select(keep)
    here = cut(out.where("open").withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "ties")
    key = ["key", "size"]  # one edge in each group, so its equal rows are named by the group
    parts = here.groupBy(*key, "part").agg(F.count(F.lit(1)).alias("p"))
    before = parts.select(*key, "part", (F.sum("p").over(Window.partitionBy(*key).orderBy("part")) - F.col("p")).alias("before"))
    numbered = here.withColumn("nth", F.row_number().over(Window.partitionBy(*key, "part").orderBy("at"))).join(before, [*key, "part"])
    more = (F.col("before") + F.col("nth") <= F.col("need")).cast("long")
    return out.where("NOT open").select(keep).unionByName(numbered.withColumn("copies", F.col("base") + more).select(keep))


def _measured(docs: DataFrame, *more: Column) -> DataFrame:
    """Rows of packed docs (doc_id, text, source) with key, size, h, _t1, _t2."""
    return docs.select(*more, source_key().alias("key"), sizes(F.col("text")).alias("size"), F.xxhash64("doc_id").alias("h"), *text_key())


def balance(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """doc_id, size, source_size, target, taken, rate, copies for every row of docs."""
    sized = cut(_measured(docs.select("doc_id", "text", "source"), F.col("doc_id")), "sizes")
    out = copied(sized, *plan(sized, cap))
    return out.select("doc_id", "size", F.col("total").alias("source_size"), "target", (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies")


def mix(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """docs with each row repeated as often as the mix takes it, with the columns of docs."""
    rows = packed(docs, "doc_id", "text", "source")
    sized = cut(_measured(rows), "sizes")
    planned = plan(sized, cap)
    drop(sized)
    taken = copied(_measured(rows, F.col("row")), *planned).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def op4_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance(documents(spark, sf_dir))
