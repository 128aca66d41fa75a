"""Depth of coverage from start and end events.

Each read adds +1 where it starts and -1 behind its end. Net changes per place,
summed along the reference, are the depth; a place without net change starts no
segment, so the segments are already run-length encoded. The running sum is
taken within bins of a reference and shifted by the totals of the bins before
(one row a bin), so a long or hot reference spreads over many tasks.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.cigar import span
from ..functions.flags import has
from ..sources.shared import concatenate
from .regions import clip

BIN = 1 << 14


def spans(alignments: DataFrame, filtered: str = "exclude", min_mapq: int = 0) -> DataFrame:
    """ref_id, start, end (half open) that reads cover.

    ``exclude`` leaves out reads that fail the flag mask; ``anchor`` lets them
    count at their first base. Reads without a place and reads that cover
    nothing never count.
    """
    covered = F.col("span") if "span" in alignments.columns else span(F.col("cigar"))
    placed = alignments.where((F.col("ref_id") >= 0) & (F.col("pos") >= 0) & (F.col("mapq") >= min_mapq) & (covered > 0))
    if filtered == "exclude":
        rows = placed.where(~has(S.DEPTH_MASK)).select("ref_id", F.col("pos").cast("long").alias("start"), covered.cast("long").alias("n"))
    elif filtered == "anchor":
        n = F.when(has(S.DEPTH_MASK), 1).otherwise(covered)
        rows = placed.select("ref_id", F.col("pos").cast("long").alias("start"), n.cast("long").alias("n"))
    else:
        raise ValueError(f"filtered: exclude or anchor, not {filtered!r}")
    return rows.select("ref_id", "start", (F.col("start") + F.col("n")).alias("end"))


def segments(covered: DataFrame, ref_seqs: DataFrame, bin_size: int = BIN) -> DataFrame:
    """ref_id, chr, start, end, depth: maximal runs of equal depth over whole references, zeros included; reads are clipped to their reference."""
    refs = F.broadcast(ref_seqs.select("ref_id", F.col("name").alias("chr"), "length"))
    inside = covered.join(refs.select("ref_id", "length"), "ref_id").where("start < length")
    event = F.explode(F.array(F.struct(F.col("start").alias("p"), F.lit(1).alias("d")), F.struct(F.col("end").alias("p"), F.lit(-1).alias("d"))))
    events = inside.select("ref_id", "length", event.alias("e")).where("e.p < length").select("ref_id", "e.p", "e.d")
    events = events.unionByName(ref_seqs.where("length > 0").select("ref_id", F.lit(0).cast("long").alias("p"), F.lit(0).alias("d")))
    net = events.groupBy("ref_id", "p").agg(F.sum("d").alias("d")).where("d <> 0 or p = 0").withColumn("bin", F.floor(F.col("p") / bin_size))
    within = Window.partitionBy("ref_id", "bin").orderBy("p")
    local = net.select("ref_id", "bin", "p", F.sum("d").over(within.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.lead("p").over(within).alias("then"))
    along = Window.partitionBy("ref_id").orderBy("bin")
    bins = net.groupBy("ref_id", "bin").agg(F.sum("d").alias("total"), F.min("p").alias("first"))
    bins = bins.select("ref_id", "bin", F.coalesce(F.sum("total").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.lead("first").over(along).alias("next_first"))
    joined = local.join(bins, ["ref_id", "bin"]).join(refs, "ref_id")
    return joined.select("ref_id", "chr", F.col("p").alias("start"), F.coalesce("then", "next_first", "length").alias("end"), (F.col("upto") + F.col("before")).cast("long").alias("depth"))


def per_base(runs: DataFrame) -> DataFrame:
    """chr, coord (from 0), depth, for covered places."""
    return runs.where("depth > 0").select("chr", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("coord"), "depth")


def clip_to_regions(runs: DataFrame, given: DataFrame, ref_seqs: DataFrame, bin_size: int = BIN) -> DataFrame:
    """region_id, chr, start, end, depth: the runs within each region. Overlapping regions repeat rows; unknown and empty regions have none.

    Both sides are joined on the bins that they touch, and a pair counts in the
    first bin that both touch. Runs don't overlap, so they touch hardly more
    bins than there are.
    """

    def bins(low: str, high: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(low) / bin_size), F.floor((F.col(high) - 1) / bin_size)))

    r = clip(given, ref_seqs).select("region_id", "chr", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    r = r.withColumn("bin", bins("r_start", "r_end"))
    met = runs.select("chr", "start", "end", "depth").withColumn("bin", bins("start", "end")).join(r, ["chr", "bin"])
    inside = met.select("region_id", "chr", F.greatest("start", "r_start").alias("start"), F.least("end", "r_end").alias("end"), "depth", "bin")
    return inside.where((F.col("start") < F.col("end")) & (F.col("bin") == F.floor(F.col("start") / bin_size))).drop("bin")


def text_lines(bases: DataFrame) -> DataFrame:
    """``chr<TAB>coord<TAB>depth``."""
    return bases.select(F.concat_ws("\t", "chr", F.col("coord").cast("string"), F.col("depth").cast("string")).alias("value"))


def in_header_order(rows: DataFrame, ref_seqs: DataFrame, then: str) -> DataFrame:
    """``rows`` sorted by their chr's place in the header, then by a column."""
    order = F.broadcast(ref_seqs.select(F.col("name").alias("chr"), F.col("ref_id").alias("at")))
    return rows.join(order, "chr").orderBy("at", then).drop("at")


def write_bed_gz(runs: DataFrame, path: str) -> None:
    """chr, start, end, depth as tab-separated lines, in the order of ``runs``: one gzip file. Tasks compress, the writer joins their members."""

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            yield gzip.compress("".join(line + "\n" for line in batch.column("value").to_pylist()).encode())

    concatenate(runs.select(F.concat_ws("\t", "chr", *[F.col(c).cast("string") for c in ("start", "end", "depth")]).alias("value")), compress, path)
