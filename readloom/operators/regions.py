"""Interval sets and how they are combined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def override(bed: DataFrame, given: DataFrame) -> DataFrame:
    """Both sets; where a chr is in both, only what was given for it."""
    kept = bed.join(given.select("chr").distinct(), "chr", "left_anti")
    return kept.select("region_id", "chr", "start", "end").unionByName(given.select("region_id", "chr", "start", "end"))


def default_all(ref_seqs: DataFrame) -> DataFrame:
    """Whole references, for when no region is named."""
    return ref_seqs.select(F.col("ref_id").alias("region_id"), F.col("name").alias("chr"), F.lit(0).cast("long").alias("start"), F.col("length").alias("end"))


def clip(regions: DataFrame, ref_seqs: DataFrame) -> DataFrame:
    """Regions cut at the end of their reference; unknown and empty ones go."""
    refs = F.broadcast(ref_seqs.select(F.col("name").alias("chr"), "length"))
    return regions.join(refs, "chr").select("region_id", "chr", "start", F.least("end", "length").alias("end")).where("start < end")
