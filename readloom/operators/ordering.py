"""Sort orders, ranks without a single-task window, and permutations."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.flags import has
from ..functions.tags import hit_count
from ..sources.shared import new_folder

LAST = 2147483647
PLACES = 33  # bits of a row's number within its partition, in the ids that Spark gives


def coordinate_key() -> list[Column]:
    """Reference (unplaced last), position, forward before reverse."""
    return [F.when(F.col("ref_id") == -1, LAST).otherwise(F.col("ref_id")), F.col("pos"), has(S.REVERSE)]


def name_key() -> list[Column]:
    return [F.col("read_name")]


def mates_key() -> list[Column]:
    """Name, hit count (absent first), flag."""
    return [F.col("read_name"), hit_count(F.col("tags")), F.col("flag")]


KEYS = {"coordinate": coordinate_key, "name": name_key, "name_mates": mates_key}

# Spill media that a caller may name; Spark always spills to local disk, so they choose compression only. They hold for a session from its start.
SPILL_MEDIA = {"file": "false", "lz4_file": "true", "ram": "false", "lz4_ram": "true"}


def spill_options(media: str) -> dict[str, str]:
    """Session options for a named spill medium."""
    if media not in SPILL_MEDIA:
        raise ValueError(f"unknown medium {media!r}: {', '.join(SPILL_MEDIA)}")
    return {"spark.shuffle.spill.compress": SPILL_MEDIA[media], "spark.io.compression.codec": "lz4"}


def sort(alignments: DataFrame, by: str = "coordinate") -> DataFrame:
    """Stable: rows level in the key stay in physical order."""
    return alignments.orderBy(*KEYS[by](), "ordinal")


def ranked(alignments: DataFrame, by: str = "coordinate", columns: Iterable[str] = ()) -> DataFrame:
    """``columns`` (or all) of ``alignments``, with rank (from 0) in the order of ``sort``. Runs one job.

    Rows are dealt out by ranges of the whole key and ordinal, so that neither
    equal keys nor keys with one beginning meet in one task, and sorted and
    numbered there. Ranks are those numbers shifted by the sizes of the ranges
    before, one row a task. The numbered rows are a table, since another run
    of the same plan may cut its ranges elsewhere.
    """
    spark, wanted, keys = alignments.sparkSession, list(columns) or alignments.columns, KEYS[by]()
    names = [f"key{k}" for k in range(len(keys))] + ["ordinal"]
    keyed = alignments.select(F.struct(*wanted).alias("given"), *[k.alias(n) for k, n in zip(keys, names)], F.col("ordinal"))
    numbered = keyed.repartitionByRange(*names).sortWithinPartitions(*names).select("given", F.monotonically_increasing_id().alias("id"))
    folder = new_folder(spark, "ranked") + "/rows"
    numbered.write.parquet(folder)
    rows = spark.read.schema(numbered.schema).parquet(folder).withColumn("range", F.shiftright("id", PLACES))
    before = F.coalesce(F.sum("count").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = rows.groupBy("range").count().select("range", before.alias("before"))  # one row a task
    place = F.col("id").bitwiseAND(F.lit((1 << PLACES) - 1))
    return rows.join(F.broadcast(offsets), "range").select("given.*", (place + F.col("before")).alias("rank"))


def permutation(alignments: DataFrame, by: str = "coordinate") -> DataFrame:
    """rank, ordinal: the index of a sort that moves keys only."""
    return ranked(alignments, by, ["ordinal"]).select("rank", "ordinal")


def gather(alignments: DataFrame, index: DataFrame) -> DataFrame:
    """Rows with the rank that a permutation gives them.

    A permutation has as many rows as the alignments, but one that was read
    from its file has no statistics and seems tiny. It must not be broadcast,
    so both sides are sorted and merged, which spills.
    """
    return alignments.join(index.select("rank", "ordinal").hint("merge"), "ordinal")
