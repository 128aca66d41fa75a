"""Operator 7: chat formatting by prefix-target expansion (DataFrame functions only).

Every assistant turn becomes an example of its own: all turns before it are
context, and its text alone is under the loss mask. Turns after the last
assistant turn would appear in no example, so a conversation that ends with
another role gets one more example without a trainable part.

Template: ``<s>``, then for each turn ``<|im_start|>role\\ntext<|im_end|>\\n``.
Inside role and text the characters ``& < [`` (and in a role the newline) are
written as entities, so no control string can occur there; the escape is
undone exactly by ``read_turns``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

BOS, OPEN, CLOSE = "<s>", "<|im_start|>", "<|im_end|>\n"
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lb;"))


def escape(text: Column, role: bool = False) -> Column:
    for plain, entity in ENTITIES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return F.replace(text, F.lit("\n"), F.lit("&nl;")) if role else text


def unescape(text: Column, role: bool = False) -> Column:
    if role:
        text = F.replace(text, F.lit("&nl;"), F.lit("\n"))
    for plain, entity in reversed(ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def expand(conversations: DataFrame) -> DataFrame:
    """One row per example: conv_id, position (of its last turn, from 1), is_last, text, loss_start, loss_length.

    Turns are taken in the order (turn, role, text), nulls first; a null role
    or text counts as empty, repeated rows are turns of their own, and rows
    with a null conv_id form one conversation. Other columns are ignored.
    ``loss_start`` (from 0) and ``loss_length`` count code points of ``text``;
    the length is 0 where nothing is trainable. The text of an example grows
    with its conversation; nothing else is gathered.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    pieces = F.transform("turns", lambda t: F.concat(F.lit(OPEN), escape(t["role"], role=True), F.lit("\n"), escape(t["text"]), F.lit(CLOSE)))
    one = turns.withColumn("pieces", pieces).select("conv_id", "pieces", F.size("turns").alias("n"), F.posexplode("turns").alias("at", "turn"))
    target = F.col("turn.role") == "assistant"
    one = one.where(target | (F.col("at") == F.col("n") - 1))
    context = F.concat(F.lit(BOS), F.array_join(F.slice("pieces", F.lit(1), F.col("at")), ""))
    head = F.length(escape(F.col("turn.role"), role=True)) + len(OPEN) + 1
    return one.select(
        "conv_id",
        (F.col("at") + 1).alias("position"),
        (F.col("at") == F.col("n") - 1).alias("is_last"),
        context.alias("context"),
        F.element_at("pieces", F.col("at") + 1).alias("piece"),
        head.alias("head"),
        F.when(target, F.length(escape(F.col("turn.text")))).otherwise(0).alias("loss_length"),
    ).select(
        "conv_id", "position", "is_last",
        F.concat("context", "piece").alias("text"),
        (F.length("context") + F.col("head")).alias("loss_start"),
        "loss_length",
    )


def read_turns(text: Column) -> Column:
    """The turns of a formatted text, unescaped: array<struct<role, text>>."""
    body = F.split(F.substring(text, len(BOS) + 1, 2147483647), r"\Q" + CLOSE.rstrip("\n") + r"\E\n")
    body = F.slice(body, F.lit(1), F.size(body) - 1)

    return F.transform(body, _turn_of)


def _turn_of(x: Column) -> Column:
    role = F.substring_index(x, "\n", 1)
    text = F.substr(x, F.length(role) + 2, F.lit(2147483647))
    return F.struct(
        unescape(F.substr(role, F.lit(len(OPEN) + 1), F.lit(2147483647)), role=True).alias("role"), unescape(text).alias("text")
    )


def read_loss(examples: DataFrame) -> Column:
    """The text under an example's loss mask, unescaped."""
    return unescape(F.substr(examples["text"], examples["loss_start"] + 1, examples["loss_length"]))


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation, what its examples hold: n_turns, digests of turns and loss text, sizes."""
    turns = F.when(F.col("is_last"), read_turns(F.col("text")))
    parts = examples.select(
        "conv_id", "position",
        turns.alias("turns"),
        F.when(F.col("loss_length") > 0, read_loss(examples)).otherwise("").alias("loss"),
        F.length("text").cast("long").alias("chars"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = parts.select(
        "conv_id", "position", "loss", "chars", F.size("turns").cast("long").alias("n"), F.sha2(said, 256).alias("sha")
    )
    loss = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "loss"))), lambda x: x["loss"]), "")
    return (
        parts.groupBy("conv_id")
        .agg(F.max("n").alias("n_turns"), F.max("sha").alias("turns_sha256"), loss.alias("loss"), F.sum("chars").alias("formatted_chars"))
        .select(
            "conv_id", "n_turns", "turns_sha256",
            F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
        )
    )


PROBE = "</s>[INST] ok [/INST]"


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"),
    )
    examples = Scratch(spark, "chat").table(expand(table.unionByName(probe)), "examples")
    return digests(examples)


def _sql_escape(x: str) -> str:
    for plain, entity in ENTITIES:
        x = f"replace({x}, '{plain}', '{entity}')"
    return x


OP7_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
r AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM c),
f AS (
  SELECT *, {len(OPEN)} + length(replace({_sql_escape('role')}, chr(10), '&nl;')) + 1 + length({_sql_escape('text')}) + {len(CLOSE)} AS piece FROM r),
s AS (SELECT *, {len(BOS)} + sum(piece) OVER (PARTITION BY conv_id ORDER BY p) AS upto FROM f)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY p)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY p) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (WHERE role = 'assistant' OR p = n))::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""
