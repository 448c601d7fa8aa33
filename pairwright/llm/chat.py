"""Chat formatting in Spark expressions: collected turn structs are sorted, adjacent turns of one role merged, all concatenated.

    <|start|>role<|text|>text<|sep|>text of the next turn of that role<|end|>
    <|start|>...

Inside roles and texts a control string (<|name|> in lower-case letters and underscores, which all markers of this template are,
and </s>, [INST] and the like of other templates; other strings, such as names with digits, pass as they are) gets a backslash after
its first bracket, behind those that stand there already; taking one backslash off again is the exact inverse, so neither the
format nor a tokenizer meets a control string that a user wrote. The loss mask has the character spans of the assistant texts,
without markers.

Defined results: null text or role is empty; turns are ordered by (turn, role, text), null turns first; repeated rows are turns
of their own; a null conv_id is a conversation. One conversation is one output value, so one task holds it; that is the only
group this operator gathers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let

START, BODY, SEP, END = "<|start|>", "<|text|>", "<|sep|>", "<|end|>\n"
#: What may follow the first bracket of a control string.
_REST = r"\|[a-z_]+\|>|/?s>|/?INST\]|</?SYS>>"
PROBE = "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)(?={_REST})", r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)\\(?={_REST})", "$1$2")


def _blocks(turns: Column) -> Column:
    """Runs of adjacent turns of one role, from sorted structs (turn, role, text): (role, texts)."""

    def runs(heads: Column) -> Column:
        def run(at: Column, j: Column) -> Column:
            members = F.slice(turns, at + 1, F.coalesce(F.get(heads, j + 1), F.size(turns)) - at)
            return F.struct(F.get(turns, at)["role"].alias("role"), F.transform(members, lambda x: x["text"]).alias("texts"))

        return F.transform(heads, run)

    first = F.filter(F.transform(turns, lambda x, i: F.when(F.get(turns, i - 1)["role"].eqNullSafe(x["role"]), -1).otherwise(i)), lambda i: i >= 0)
    return let(first, runs)


def _spans(blocks: Column) -> Column:
    """(start, length) in characters of each assistant text, by adding lengths up along the blocks."""
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def block(acc: Column, b: Column) -> Column:
        head = F.struct((acc["at"] + len(START) + F.length(b["role"]) + len(BODY)).cast("long").alias("at"), acc["spans"].alias("spans"))

        def text(a: Column, t: Column) -> Column:
            size = F.length(t).cast("long")
            span = F.array(F.struct(a["at"].alias("start"), size.alias("length")))
            return F.struct((a["at"] + size + len(SEP)).alias("at"), F.when(b["role"] == "assistant", F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

        return let(F.aggregate(b["texts"], head, text), lambda a: F.struct((a["at"] - len(SEP) + len(END)).alias("at"), a["spans"].alias("spans")))

    return F.aggregate(blocks, begin, block)["spans"]


def format_chat(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_mask (start, length) for each conversation of turns (conv_id, turn, role, text)."""
    clean = turns.select("conv_id", "turn", escape(F.coalesce("role", F.lit(""))).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text"))
    gathered = clean.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    merged = gathered.select("conv_id", let(F.col("turns"), _blocks).alias("blocks"))
    shown = F.transform("blocks", lambda b: F.concat(F.lit(START), b["role"], F.lit(BODY), F.array_join(b["texts"], SEP), F.lit(END)))
    return merged.select("conv_id", F.array_join(shown, "").alias("formatted"), let(F.col("blocks"), _spans).alias("loss_mask"))


def read_chat(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    parts = F.filter(F.split(formatted, rf"\Q{START}\E"), lambda p: p != "")

    def turns(p: Column) -> Column:
        role = unescape(F.substring_index(p, BODY, 1))
        body = F.substring_index(F.substring_index(p, BODY, -1), END, 1)
        return F.transform(F.split(body, rf"\Q{SEP}\E"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(parts, turns))


def digests(chats: DataFrame) -> DataFrame:
    """What op8 returns, all of it read back from formatted and loss_mask."""
    turns = F.transform(F.col("_turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join(F.transform("loss_mask", lambda s: unescape(F.substring("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    read = chats.withColumn("_turns", read_chat(F.col("formatted"))).withColumn("_loss", loss)
    return read.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(F.array_join(turns, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(PROBE).alias("text"))
    return digests(format_chat(turns.unionByName(probe)))


#: The same for DuckDB, from the turns themselves.
CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(regexp_replace(text, '([<\[]\\*)(\|[a-z_]+\|>|/?s>|/?INST\]|</?SYS>>)', '\1\\\2', 'g')) AS lt,
         length(regexp_replace(role, '([<\[]\\*)(\|[a-z_]+\|>|/?s>|/?INST\]|</?SYS>>)', '\1\\\2', 'g')) AS lr,
         row_number() OVER w AS k, lag(role) OVER w AS before
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '')) AS loss_sha256,
       CAST(sum(lt + CASE WHEN before IS NOT DISTINCT FROM role THEN 7 ELSE 25 + lr END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
