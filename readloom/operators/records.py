"""Projections, duplicate marks, totals and block statistics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.cigar import span


class Template:
    """A set of columns to read; Parquet then reads no others."""

    def __init__(self, columns: Iterable[str], chosen: Iterable[str] = ()):
        self.columns = tuple(columns)
        self.chosen = set()
        self.set(*chosen)

    def set(self, *names: str, on: bool = True) -> Template:
        unknown = set(names) - set(self.columns)
        if unknown:
            raise ValueError(f"no such columns: {sorted(unknown)}")
        self.chosen = self.chosen | set(names) if on else self.chosen - set(names)
        return self

    def everything(self, but: Iterable[str] = ()) -> Template:
        self.chosen = set(self.columns) - set(but)
        return self

    def clear(self) -> Template:
        self.chosen = set()
        return self

    def is_active(self, *names: str) -> bool:
        return set(names) <= self.chosen

    def apply(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[c for c in self.columns if c in self.chosen])


def markdup_view(alignments: DataFrame) -> DataFrame:
    """All but bases and qualities."""
    return alignments.drop("seq", "qual")


def patch_dups(alignments: DataFrame, marks: DataFrame) -> DataFrame:
    """Set the duplicate bit where the mark of a row's ordinal is ``1``; never clear it. ``marks`` (ordinal, mark) must have one row for each alignment."""
    one = marks.select("ordinal", F.col("mark").alias("_mark"), F.lit(True).alias("_marked"))
    both = alignments.withColumn("_there", F.lit(True)).join(one, "ordinal", "full_outer")
    whole = both.withColumn("_ok", F.when(F.col("_there") & F.col("_marked"), True).otherwise(F.raise_error(F.lit("marks and alignments differ in number")).cast("boolean")))
    bit = F.when(F.col("_mark") == "1", S.DUPLICATE).otherwise(0)
    return whole.where("_ok").withColumn("flag", F.col("flag").bitwiseOR(bit)).select(*alignments.columns)


def coverage_total(alignments: DataFrame) -> DataFrame:
    """covered_bases over all records."""
    covered = F.col("span") if "span" in alignments.columns else span(F.col("cigar"))
    return alignments.agg(F.coalesce(F.sum(covered.cast("long")), F.lit(0)).alias("covered_bases"))


def record_count(alignments: DataFrame) -> DataFrame:
    return alignments.agg(F.count("*").alias("records"))


def block_stats(alignments: DataFrame, column: str, rows_per_block: int) -> DataFrame:
    """block_id, min_value, max_value, items of each run of ``rows_per_block`` ordinals."""
    block = F.floor(F.col("ordinal") / rows_per_block).alias("block_id")
    return alignments.groupBy(block).agg(F.min(column).alias("min_value"), F.max(column).alias("max_value"), F.count("*").alias("items"))


def block_lookup(stats: DataFrame, value: int) -> DataFrame:
    """leftmost and rightmost block whose range holds a value (null if none)."""
    hit = (F.col("min_value") <= value) & (F.col("max_value") >= value)
    return stats.where(hit).agg(F.min("block_id").alias("leftmost"), F.max("block_id").alias("rightmost"))


def block_first_row(stats: DataFrame) -> DataFrame:
    """block_id, first_row: items of all blocks before (one row a block)."""
    before = F.sum("items").over(Window.orderBy("block_id").rowsBetween(Window.unboundedPreceding, -1))
    return stats.select("block_id", F.coalesce(before, F.lit(0)).alias("first_row"))


def item_sizes(end_offsets: DataFrame) -> DataFrame:
    """ordinal, size of variable-size items from their cumulative ends (within each block)."""
    last = F.lag("end_offset", 1, 0).over(Window.partitionBy("block_id").orderBy("ordinal"))
    return end_offsets.select("ordinal", (F.col("end_offset") - last).alias("size"))
