"""Rows that may have one of many keys, found before any shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 1 << 16  # 64-bit words of the bitmap: at most 65,536 rows are broadcast, whatever the input


def _place(key: Column) -> tuple[Column, Column]:
    return F.pmod(key, F.lit(WORDS)), F.pmod(F.shiftright(key, 20), F.lit(64)).cast("int")


def marked(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, name: str) -> DataFrame:
    """``rows`` (of an operator's own columns, none of them ``bitmap_*``) with a boolean column: false only where the (64-bit, hashed) key is certainly not wanted.

    The wanted keys are folded into a bitmap of fixed size; with very many of
    them it fills up and no longer tells rows apart, which costs time, not
    correctness.
    """
    word, bit = _place(wanted_key)
    bitmap = wanted.select(word.alias("bitmap_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bitmap_one")).groupBy("bitmap_word").agg(F.bit_or("bitmap_one").alias("bitmap_bits"))
    word, bit = _place(key)
    tagged = rows.withColumns({"bitmap_word": word, "bitmap_bit": bit}).join(F.broadcast(bitmap), "bitmap_word", "left")
    hit = F.coalesce(F.call_function("shiftrightunsigned", F.col("bitmap_bits"), F.col("bitmap_bit")).bitwiseAND(F.lit(1).cast("long")) == 1, F.lit(False))
    return tagged.withColumn(name, hit).drop("bitmap_word", "bitmap_bit", "bitmap_bits")
