"""The Parquet store of alignments, and codecs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names that callers may use -> Parquet's. Brotli is not available to Spark's writer; zstd takes its place.
CODECS = {"brotli": "zstd", "zstd": "zstd", "lz4": "lz4_raw", "gzip": "gzip", "xz": "zstd", "nocompression": "none", "none": "none", "snappy": "snappy"}


def codec(name: str) -> str:
    try:
        return CODECS[name.lower()]
    except KeyError:
        raise ValueError(f"unknown codec {name!r}") from None


def write(alignments: DataFrame, refs: DataFrame, header: str, path: str, compression: str = "brotli", sort_by: list | None = None) -> None:
    """alignments, ref_seqs and header under one folder. ``sort_by``: columns to range-partition and sort on, so that row groups can be skipped."""
    rows = alignments
    if sort_by:
        rows = rows.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by)
    rows.write.mode("overwrite").option("compression", codec(compression)).parquet(f"{path}/alignments")
    refs.write.mode("overwrite").parquet(f"{path}/ref_seqs")
    refs.sparkSession.createDataFrame([(header,)], "header_text string").write.mode("overwrite").parquet(f"{path}/header")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """alignments, ref_seqs, header."""
    return tuple(spark.read.parquet(f"{path}/{part}") for part in ("alignments", "ref_seqs", "header"))


def ref_range(alignments: DataFrame, low: int, high: int) -> DataFrame:
    """Records of references ``low`` to ``high`` (both in); on a store sorted by reference Parquet skips the other row groups."""
    return alignments.where(F.col("ref_id").between(low, high))


def codec_sizes(table: DataFrame, columns: list[str], codecs: list[str], folder: str) -> DataFrame:
    """field, codec, bytes, saved_percent: each column written alone with each codec, against no compression for the whole."""
    spark = table.sparkSession
    size = lambda path: int(spark.read.format("binaryFile").load(f"{path}/*.parquet").agg(F.sum("length")).first()[0] or 0)
    plain, rows = {}, []
    for c in columns:
        table.select(c).write.mode("overwrite").option("compression", "none").parquet(f"{folder}/{c}-none")
        plain[c] = size(f"{folder}/{c}-none")
    base = sum(plain.values())
    for c in columns:
        for name in codecs:
            table.select(c).write.mode("overwrite").option("compression", codec(name)).parquet(f"{folder}/{c}-{name}")
            n = size(f"{folder}/{c}-{name}")
            rows.append((c, name, n, round((plain[c] - n) / base * 100, 2)))
    return spark.createDataFrame(rows, "field string, codec string, bytes long, saved_percent double")
