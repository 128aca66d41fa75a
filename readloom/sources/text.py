"""Text inputs: intervals, region strings, duplicate marks, and permutation files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import concatenate, resolve

REGION = r"^([^:]+):(\d+)-(\d+)$"
CHUNK = 4 << 20  # bytes of a permutation file read at once


def parse_bed(lines: DataFrame, strict: bool = True) -> DataFrame:
    """``lines`` (region_id, value) -> region_id, chr, start, end (and, unless strict, error).

    Columns beyond the third are ignored. Lines with fewer columns, other than
    whole numbers, or an end before the start are errors: strict raises, else
    they are rows with an error and null numbers.
    """
    parts = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    cells = lines.withColumn("p", parts).select("region_id", "value", F.get("p", F.lit(0)).alias("chr"), F.get("p", F.lit(1)).try_cast("long").alias("start"), F.get("p", F.lit(2)).try_cast("long").alias("end"))
    wrong = F.col("start").isNull() | F.col("end").isNull() | (F.col("start") < 0) | (F.col("end") < F.col("start"))
    error = F.when(F.coalesce(wrong, F.lit(True)), F.concat(F.lit("bad interval: "), F.col("value")))
    return _settled(cells.withColumn("error", error), strict)


def parse_regions(lines: DataFrame, strict: bool = True) -> DataFrame:
    """``lines`` (region_id, value) of ``chr:start-end`` -> the same columns as ``parse_bed``."""
    part = lambda k: F.regexp_extract("value", REGION, k)
    cells = lines.select("region_id", "value", F.nullif(part(1), F.lit("")).alias("chr"), part(2).try_cast("long").alias("start"), part(3).try_cast("long").alias("end"))
    wrong = F.col("start").isNull() | F.col("end").isNull() | (F.col("end") < F.col("start"))
    return _settled(cells.withColumn("error", F.when(F.coalesce(wrong, F.lit(True)), F.concat(F.lit("bad region: "), F.col("value")))), strict)


def _settled(cells: DataFrame, strict: bool) -> DataFrame:
    if not strict:
        good = F.col("error").isNull()
        return cells.select("region_id", *[F.when(good, F.col(c)).alias(c) for c in ("chr", "start", "end")], "error")
    checked = F.when(F.col("error").isNull(), F.col("chr")).otherwise(F.raise_error(F.col("error")).cast("string"))
    return cells.select("region_id", checked.alias("chr"), "start", "end")


def numbered_lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Lines of one text file with their number from 0.

    The file is read in blocks. Spark numbers rows in ascending order within a
    block; the lines of the blocks before (one row a block) are added.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = lines.groupBy("block").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    shift = blocks.select("block", (before - F.col("least")).alias("shift"))
    return lines.join(F.broadcast(shift), "block").select((F.col("id") + F.col("shift")).alias(name), "value")


def read_bed(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    lines = numbered_lines(spark, path, "region_id")
    return parse_bed(lines.select(F.col("region_id").cast("int").alias("region_id"), "value"), strict)


def read_marks(spark: SparkSession, path: str) -> DataFrame:
    """ordinal, mark: one line a record."""
    return numbered_lines(spark, path, "ordinal").select(F.col("ordinal").cast("long"), F.col("value").alias("mark"))


def write_marks(marks: DataFrame, path: str) -> None:
    """Marks by ordinal, one line each, in one file."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            yield "".join(f"{m}\n" for m in batch.column("mark").to_pylist()).encode()

    concatenate(_in_order(marks, "ordinal"), joined, path)


def write_permutation(index: DataFrame, path: str) -> None:
    """Ordinals by rank, as a file of little-endian unsigned 32-bit integers (the exchange format; Parquet is the usual store)."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            yield batch.column("ordinal").to_numpy().astype("<u4").tobytes()

    concatenate(_in_order(index, "rank"), packed, path)


def _in_order(rows: DataFrame, order: str) -> DataFrame:
    return rows.repartitionByRange(order).sortWithinPartitions(order)


def read_permutation(spark: SparkSession, path: str) -> DataFrame:
    """rank, ordinal of such a file, read by ranges of bytes."""
    system, at = resolve(path)
    size = system.get_file_info(at).size
    if size % 4:
        raise ValueError(f"{path}: not a whole number of 32-bit integers")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = resolve(path)
        for batch in batches:
            for start in batch.column("id").to_pylist():
                with system.open_input_file(at) as file:
                    file.seek(start)
                    ordinals = np.frombuffer(file.read(min(CHUNK, size - start)), "<u4").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(ordinals)) + start // 4), pa.array(ordinals)], names=["rank", "ordinal"])

    starts = spark.range(0, size, CHUNK, numPartitions=max(1, min(-(-size // CHUNK), 10_000)))
    return starts.mapInArrow(read, "rank long, ordinal long")
