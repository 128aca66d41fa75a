"""Command line: convert, sort, flagstat, depth, header, view, markdup-view, patch, sizes, test.

    python -m readloom.cli convert in.bam store [--sort coordinate] [--codec zstd]
    python -m readloom.cli depth store [--bed x.bed] [--query chr:start-end] [--mapq 30] [--out depth.bed.gz]
"""

from __future__ import annotations

import argparse
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import depth, flagstat, ordering, records, regions
from .sources import bam, store, text


def _session(options: dict[str, str]) -> SparkSession:
    """A session with these options; core ones (of spills) hold only if it starts here."""
    return SparkSession.builder.appName("readloom").config("spark.sql.session.timeZone", "UTC").config(map=options).getOrCreate()


def _regions(spark: SparkSession, bed: str | None, query: list[str]) -> DataFrame | None:
    """Both kinds of intervals, numbered apart (those of ``query`` first); for a chr in both, those of ``query``, which are ``chr:start-end`` or as lines of a BED file."""
    numbered = list(enumerate(query))
    kinds = [(text.parse_bed, [(i, q) for i, q in numbered if len(q.split()) >= 3]), (text.parse_regions, [(i, q) for i, q in numbered if len(q.split()) < 3])]
    parsed = [parse(spark.createDataFrame(rows, "region_id int, value string")) for parse, rows in kinds if rows]
    given = reduce(DataFrame.unionByName, parsed) if parsed else None
    listed = text.read_bed(spark, bed).withColumn("region_id", F.col("region_id") + len(query)) if bed else None
    if given is not None and listed is not None:
        return regions.override(listed, given)
    return given if given is not None else listed


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="readloom")
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, *places: str) -> argparse.ArgumentParser:
        v = verbs.add_parser(name)
        for place in places:
            v.add_argument(place)
        return v

    v = verb("convert", "source", "target")
    v.add_argument("--sort", choices=sorted(ordering.KEYS))
    v.add_argument("--sort-temp-mode", default="file", choices=sorted(ordering.SPILL_MEDIA))
    v.add_argument("--index-sort", action="store_true", help="keep the order and write a permutation beside the data")
    v.add_argument("--codec", default="brotli")
    verb("to-bam", "source", "target")
    verb("flagstat", "source")
    v = verb("depth", "source")
    v.add_argument("--bed")
    v.add_argument("--query", action="append", default=[])
    v.add_argument("--mapq", type=int, default=0)
    v.add_argument("--filtered", default="exclude", choices=["exclude", "anchor"])
    v.add_argument("--out")
    verb("header", "source")
    for name in ("view", "markdup-view"):
        verb(name, "source").add_argument("--index-file")
    v = verb("patch", "source", "target")
    v.add_argument("marks")
    verb("uncompressed-size", "source")
    verb("test", "source")
    return p


def main(argv: list[str] | None = None) -> None:
    o = parser().parse_args(argv)
    spark = _session(ordering.spill_options(o.sort_temp_mode) if o.verb == "convert" else {})
    if o.verb == "convert":
        rows = bam.read_bam(spark, o.source)
        by = ordering.KEYS[o.sort]() if o.sort and not o.index_sort else None
        store.write(rows, bam.ref_seqs(spark, o.source), bam.read_header(o.source)[0], o.target, o.codec, [*by, F.col("ordinal")] if by else None)
        if o.index_sort:
            ordering.permutation(store.read(spark, o.target)[0], o.sort or "coordinate").write.mode("overwrite").parquet(f"{o.target}/permutation")
        return
    if o.verb == "uncompressed-size":
        print(bam.uncompressed_size(spark, o.source).agg(F.sum("uncompressed_bytes")).first()[0])
        return
    rows, refs, header = store.read(spark, o.source)
    if o.verb == "flagstat":
        print("\n".join(r["line"] for r in flagstat.report(rows).orderBy("line_no").collect()))
    elif o.verb == "depth":
        runs = depth.segments(depth.spans(rows, o.filtered, o.mapq), refs)
        chosen = _regions(spark, o.bed, o.query)
        if chosen is not None:
            runs = depth.clip_to_regions(runs, chosen, refs)
        if o.out:
            depth.write_bed_gz(depth.in_header_order(runs, refs, "start"), o.out)
        else:
            for r in depth.text_lines(depth.in_header_order(depth.per_base(runs), refs, "coord")).toLocalIterator():
                print(r["value"])
    elif o.verb == "header":
        print(header.first()[0], end="")
    elif o.verb in ("view", "markdup-view", "to-bam"):
        names = [(r["name"], r["length"]) for r in refs.orderBy("ref_id").collect()]
        if o.verb == "to-bam":
            bam.write_bam(rows, o.target, header.first()[0], names)
            return
        if o.verb == "markdup-view":
            rows = records.markdup_view(rows)
        order = "ordinal"
        if o.index_file:
            rows, order = ordering.gather(rows, text.read_permutation(spark, o.index_file)), "rank"
        for part in bam.view_bytes(rows, header.first()[0], names, order):
            sys.stdout.buffer.write(part)
    elif o.verb == "patch":
        store.write(records.patch_dups(rows, text.read_marks(spark, o.marks)), refs, header.first()[0], o.target)
    elif o.verb == "test":
        print("Covered bases:", records.coverage_total(rows).first()[0])


if __name__ == "__main__":
    main()
