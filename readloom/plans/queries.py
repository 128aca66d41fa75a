"""Named queries over the star-schema tables, one or more an operator."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import cigar, flags, positions, seq, tags
from ..operators import depth, flagstat, ordering, records, regions
from ..sources import bam, store, text
from ..sources.shared import new_folder
from ..streaming import flagstat as stream
from .synth import from_lineitem, from_orders, ref_seqs

Spark = SparkSession


def flagstat_counts(spark: Spark, d: str) -> DataFrame:
    return flagstat.counts(from_lineitem(spark, d))


def flagstat_wide(spark: Spark, d: str) -> DataFrame:
    return flagstat.wide(from_lineitem(spark, d))


def flagstat_percent(spark: Spark, d: str) -> DataFrame:
    return flagstat.percents(from_lineitem(spark, d))


def flagstat_report(spark: Spark, d: str) -> DataFrame:
    return flagstat.report(from_lineitem(spark, d))


def flagstat_merge(spark: Spark, d: str) -> DataFrame:
    """Statistics of two parts, merged."""
    a = from_lineitem(spark, d)
    return flagstat.merge(flagstat.wide(a.where("pos % 2 = 0")).unionByName(flagstat.wide(a.where("pos % 2 <> 0"))))


def flag_predicates(spark: Spark, d: str) -> DataFrame:
    return from_orders(spark, d).select("ordinal", *[flags.predicate(p).alias(p) for p in flags.PREDICATES])


def project_template(spark: Spark, d: str) -> DataFrame:
    rows = from_orders(spark, d)
    return records.Template(rows.columns, ["ordinal", "ref_id", "pos"]).set("flag").set("pos", on=False).apply(rows)


def markdup_view(spark: Spark, d: str) -> DataFrame:
    rows = from_orders(spark, d).withColumns({"seq": F.lit("ACGT"), "qual": F.unhex(F.lit("1E1E1E1E"))})
    return records.markdup_view(rows).select("ordinal", "ref_id", "pos", "flag", "mapq", "read_name", "cigar_text", "tlen")


def coverage_total(spark: Spark, d: str) -> DataFrame:
    return records.coverage_total(_with_cigar(from_lineitem(spark, d)).drop("span"))


def record_count(spark: Spark, d: str) -> DataFrame:
    return records.record_count(from_lineitem(spark, d))


def _with_cigar(rows: DataFrame) -> DataFrame:
    return rows.withColumn("cigar", cigar.parse(F.col("cigar_text")))


def cigar_string(spark: Spark, d: str) -> DataFrame:
    rows = _with_cigar(from_orders(spark, d))
    return rows.select("ordinal", cigar.render(cigar.from_codes(cigar.to_codes(F.col("cigar")))).alias("cigar_text"))


def cigar_ops_exploded(spark: Spark, d: str) -> DataFrame:
    rows = _with_cigar(from_orders(spark, d)).select("ordinal", F.posexplode("cigar").alias("at", "x"))
    return rows.select("ordinal", "at", F.col("x.op").alias("op"), F.col("x.len").alias("len"))


def cigar_span_readlen(spark: Spark, d: str) -> DataFrame:
    rows = _with_cigar(from_orders(spark, d))
    return rows.select("ordinal", cigar.span(F.col("cigar")).alias("span"), cigar.read_length(F.col("cigar")).alias("read_length"))


def cigar_suppressed(spark: Spark, d: str) -> DataFrame:
    rows = _with_cigar(from_orders(spark, d))
    return rows.select("ordinal", cigar.render(cigar.suppress_unplaced(F.col("ref_id"), F.col("pos"), F.col("cigar"))).alias("cigar_text"))


def cigar_long_form(spark: Spark, d: str) -> DataFrame:
    """Every third read keeps its CIGAR in the CG tag behind a stand-in."""
    rows = from_orders(spark, d)
    stand_in = F.concat(F.col("read_length").cast("string"), F.lit("S"), F.col("span").cast("string"), F.lit("N"))
    kept = F.col("ordinal") % 3 == 0
    rows = rows.withColumns({"stored": cigar.parse(F.when(kept, stand_in).otherwise(F.col("cigar_text"))), "real": F.when(kept, cigar.parse(F.col("cigar_text")))})
    return rows.select("ordinal", cigar.render(cigar.long_cigar(F.col("stored"), F.col("read_length"), F.col("real"))).alias("cigar_text"))


def alignment_end(spark: Spark, d: str) -> DataFrame:
    rows = _with_cigar(from_orders(spark, d))
    return rows.select("ordinal", F.col("pos").alias("start"), cigar.alignment_end(F.col("pos"), F.col("cigar")).alias("end"))


def _runs(spark: Spark, d: str, filtered: str = "exclude", min_mapq: int = 0, bin_size: int = depth.BIN) -> DataFrame:
    return depth.segments(depth.spans(from_lineitem(spark, d), filtered, min_mapq), ref_seqs(spark, d), bin_size)


def depth_rle(spark: Spark, d: str) -> DataFrame:
    return _runs(spark, d).select("chr", "start", "end", "depth")


def depth_binned(spark: Spark, d: str) -> DataFrame:
    """The same in bins of 512 bases."""
    return _runs(spark, d, bin_size=512).select("chr", "start", "end", "depth")


def depth_anchor(spark: Spark, d: str) -> DataFrame:
    return _runs(spark, d, "anchor").select("chr", "start", "end", "depth")


def depth_mapq(spark: Spark, d: str) -> DataFrame:
    return _runs(spark, d, min_mapq=30).select("chr", "start", "end", "depth")


def depth_per_base(spark: Spark, d: str) -> DataFrame:
    return depth.per_base(_runs(spark, d))


def depth_text(spark: Spark, d: str) -> DataFrame:
    return depth.text_lines(depth.per_base(_runs(spark, d, min_mapq=45)))


BED = ["NATION_4 100 900", "NATION_4\t800\t1200\textra", "NATION_6 4000 9999999", "NATION_8 50 50", "NOWHERE 1 5", "NATION_17 0 300"]
GIVEN = ["NATION_4:2000-2100", "NATION_2:10-60"]


def _bed(spark: Spark) -> DataFrame:
    return text.parse_bed(spark.createDataFrame(list(enumerate(BED)), "region_id int, value string"))


def _given(spark: Spark) -> DataFrame:
    return text.parse_regions(spark.createDataFrame([(100 + i, x) for i, x in enumerate(GIVEN)], "region_id int, value string"))


def depth_regions(spark: Spark, d: str) -> DataFrame:
    return depth.clip_to_regions(_runs(spark, d), _bed(spark), ref_seqs(spark, d))


def depth_region_string(spark: Spark, d: str) -> DataFrame:
    return depth.clip_to_regions(_runs(spark, d), _given(spark), ref_seqs(spark, d))


def region_override(spark: Spark, d: str) -> DataFrame:
    return regions.clip(regions.override(_bed(spark), _given(spark)), ref_seqs(spark, d))


def region_default_all(spark: Spark, d: str) -> DataFrame:
    return regions.default_all(ref_seqs(spark, d))


def sort_coordinate(spark: Spark, d: str) -> DataFrame:
    return ordering.ranked(from_orders(spark, d), "coordinate", ["ordinal", "ref_id", "pos", "flag"])


def sort_name(spark: Spark, d: str) -> DataFrame:
    return ordering.ranked(from_orders(spark, d), "name", ["ordinal", "read_name"])


def sort_name_mates(spark: Spark, d: str) -> DataFrame:
    return ordering.ranked(from_orders(spark, d), "name_mates", ["ordinal", "read_name", "flag"])


def index_permutation(spark: Spark, d: str) -> DataFrame:
    return ordering.permutation(from_orders(spark, d))


def view_by_index(spark: Spark, d: str) -> DataFrame:
    rows = from_orders(spark, d)
    return ordering.gather(rows, ordering.permutation(rows, "name")).select("rank", "read_name", "ref_id", "pos", "mapq", "cigar_text")


def patch_dups(spark: Spark, d: str) -> DataFrame:
    rows = from_orders(spark, d)
    marks = rows.select("ordinal", F.when(F.col("ordinal") % 10 == 0, "1").otherwise("0").alias("mark"))
    return records.patch_dups(rows, marks).select("ordinal", "flag")


def _blocks(spark: Spark, d: str) -> DataFrame:
    return records.block_stats(from_orders(spark, d), "ref_id", 1000)


def block_stats(spark: Spark, d: str) -> DataFrame:
    return _blocks(spark, d)


def block_lookup(spark: Spark, d: str) -> DataFrame:
    return records.block_lookup(_blocks(spark, d), 7)


def block_first_row(spark: Spark, d: str) -> DataFrame:
    return records.block_first_row(_blocks(spark, d))


def item_sizes(spark: Spark, d: str) -> DataFrame:
    rows = from_orders(spark, d).select("ordinal", F.floor(F.col("ordinal") / 1000).alias("block_id"), F.length("read_name").alias("n"))
    from pyspark.sql import Window

    upto = F.sum("n").over(Window.partitionBy("block_id").orderBy("ordinal"))
    return records.item_sizes(rows.select("ordinal", "block_id", upto.alias("end_offset")))


def tag_hit_count(spark: Spark, d: str) -> DataFrame:
    return from_orders(spark, d).select("ordinal", tags.hit_count(F.col("tags")).alias("hit_count"), tags.value(F.col("tags"), "RG").alias("read_group"))


def tag_scan(spark: Spark, d: str) -> DataFrame:
    raw = F.concat(F.lit("RGZ"), "read_name", F.lit("\u0000XYZ"), "cigar_text", F.lit("\u0000"))
    rows = from_orders(spark, d).withColumn("raw", raw)
    return rows.select("ordinal", tags.scan(F.col("raw"), "RG").alias("rg"), tags.scan(F.col("raw"), "XY").alias("xy"), tags.scan(F.col("raw"), "QQ").alias("qq"))


def _bases():
    digits = F.lpad(F.hex(F.col("ordinal") * 2654435761), 16, "7")
    return F.substr(F.translate(digits, seq.HEX, S.BASES), F.lit(1), (1 + F.col("ordinal") % 16).cast("int"))


def seq_encode(spark: Spark, d: str) -> DataFrame:
    return from_orders(spark, d).select("ordinal", F.hex(seq.encode(_bases())).alias("packed"))


def seq_decode(spark: Spark, d: str) -> DataFrame:
    rows = from_orders(spark, d).select("ordinal", _bases().alias("bases"))
    return rows.select("ordinal", seq.decode(seq.encode(F.col("bases")), F.length("bases")).alias("bases"))


def bed_parse(spark: Spark, d: str) -> DataFrame:
    return _bed(spark)


BAD = ["chr1 5 9", "chr1 9 5", "", "# note", "track name=x", "chr2 x 9", "chr3\t7"]


def bed_errors(spark: Spark, d: str) -> DataFrame:
    rows = text.parse_bed(spark.createDataFrame(list(enumerate(BAD)), "region_id int, value string"), strict=False)
    return rows.select("region_id", F.col("error").isNotNull().alias("bad"), "chr", "start", "end")


def virtual_position(spark: Spark, d: str) -> DataFrame:
    packed = positions.pack(F.col("ordinal") * 1000003, F.col("ordinal") % 65536)
    rows = from_orders(spark, d).select("ordinal", packed.alias("vpos"))
    return rows.select("ordinal", "vpos", positions.compressed(F.col("vpos")).alias("block_start"), positions.within(F.col("vpos")).cast("long").alias("within"))


def ref_dictionary(spark: Spark, d: str) -> DataFrame:
    names = from_lineitem(spark, d).join(F.broadcast(ref_seqs(spark, d)), "ref_id")
    return names.groupBy("ref_id", "name", "length").agg(F.count("*").alias("reads"))


def _bam_rows(spark: Spark, d: str) -> DataFrame:
    rows = _with_cigar(from_orders(spark, d))
    cig = cigar.suppress_unplaced(F.col("ref_id"), F.col("pos"), F.col("cigar"))
    return rows.select("ordinal", "ref_id", "pos", "mapq", F.lit(4680).alias("bin"), "flag", "next_ref_id", "next_pos", "tlen", "read_name", cig.alias("cigar"), _bases().alias("seq"), F.lit(None).cast("binary").alias("qual"), "tags", F.lit(None).cast("binary").alias("tags_raw"))


HEADER = "@HD\tVN:1.6\n@PG\tID:x\n"


def _bam_file(spark: Spark, d: str) -> str:
    """A written file, in a shared folder."""
    path = new_folder(spark, "bam") + "/x.bam"
    refs = [(r["name"], r["length"]) for r in ref_seqs(spark, d).orderBy("ref_id").collect()]
    bam.write_bam(_bam_rows(spark, d), path, HEADER, refs)
    return path


def bam_roundtrip(spark: Spark, d: str) -> DataFrame:
    """Written, read back in several runs: rank of the record in the file, and fields."""
    back = bam.read_bam(spark, _bam_file(spark, d), split_bytes="65536")
    return back.select("ordinal", "ref_id", "pos", "mapq", "flag", "next_ref_id", "next_pos", "tlen", "read_name", cigar.render(F.col("cigar")).alias("cigar_text"), "seq", tags.hit_count(F.col("tags")).alias("hit_count"))


def bgzf_uncompressed_size(spark: Spark, d: str) -> DataFrame:
    return bam.uncompressed_size(spark, _bam_file(spark, d)).select("uncompressed_bytes")


def header_text(spark: Spark, d: str) -> DataFrame:
    return bam.header_text(spark, _bam_file(spark, d))


def codec_benchmark(spark: Spark, d: str) -> DataFrame:
    """Of each field and codec: whether bytes were written and whether the codec saved some; sizes themselves depend on library versions."""
    rows = from_orders(spark, d).select("ref_id", "pos", "flag", "read_name")
    sizes = store.codec_sizes(rows, rows.columns, ["zstd", "gzip", "lz4"], new_folder(spark, "codecs"))
    return sizes.select("field", "codec", (F.col("bytes") > 0).alias("written"), F.col("saved_percent").between(-100, 100).alias("in_range"))


def reference_list(spark: Spark, d: str) -> DataFrame:
    return bam.ref_seqs(spark, _bam_file(spark, d))


def view_records(spark: Spark, d: str) -> DataFrame:
    """Records as bytes in the order of a permutation that went through its file: each one's size, and the name within it."""
    rows, path = _bam_rows(spark, d), new_folder(spark, "view") + "/x.idx"
    text.write_permutation(ordering.permutation(rows, "name"), path)
    seen = bam.encoded(ordering.gather(rows, text.read_permutation(spark, path)), "rank")
    size = F.conv(F.hex(F.substring("record", 13, 1)), 16, 10).cast("int")
    name = F.substr("record", F.lit(37), size - 1).cast("string")
    return seen.select("rank", F.length("record").cast("long").alias("n_bytes"), name.alias("read_name"))


def bam_fields(spark: Spark, d: str) -> DataFrame:
    """Only the named fields are decoded."""
    rows = bam.read_bam(spark, _bam_file(spark, d), fields="flag,pos,read_name")
    return rows.select("ordinal", "flag", "pos", "read_name", F.col("seq").isNull().alias("no_seq"))


def depth_bed_gz(spark: Spark, d: str) -> DataFrame:
    """Written as one gzip file, read back."""
    path, refs = new_folder(spark, "bed") + "/x.bed.gz", ref_seqs(spark, d)
    depth.write_bed_gz(depth.in_header_order(_runs(spark, d), refs, "start"), path)
    return spark.read.option("sep", "\t").schema("chr string, start long, end long, depth long").csv(path)


def store_roundtrip(spark: Spark, d: str) -> DataFrame:
    path, refs = new_folder(spark, "store"), ref_seqs(spark, d)
    store.write(from_orders(spark, d), refs, HEADER, path, "zstd", ["ref_id", "pos", "ordinal"])
    rows, names, header = store.read(spark, path)
    joined = rows.join(F.broadcast(names), "ref_id", "left").join(F.broadcast(header))  # one header
    return joined.select("ordinal", "name", "pos", "flag", "read_name", F.length("header_text").alias("header_chars"))


def store_ref_range(spark: Spark, d: str) -> DataFrame:
    """Records of a range of references, which the sorted store prunes."""
    path = new_folder(spark, "store")
    store.write(from_orders(spark, d), ref_seqs(spark, d), HEADER, path, "zstd", ["ref_id", "pos", "ordinal"])
    return store.ref_range(store.read(spark, path)[0], 3, 5).select("ordinal", "ref_id", "pos")


def marks_file(spark: Spark, d: str) -> DataFrame:
    """Marks through their file; its lines are numbered from 0, as the records in order of their ordinals."""
    rows = ordering.permutation(from_orders(spark, d).withColumn("ref_id", F.lit(0)).withColumn("pos", F.lit(0)).withColumn("flag", F.lit(0)))
    path = new_folder(spark, "marks") + "/x.txt"
    text.write_marks(rows.select(F.col("rank").alias("ordinal"), F.when(F.col("ordinal") % 10 == 0, "1").otherwise("0").alias("mark")), path)
    numbered = from_orders(spark, d).join(rows, "ordinal").withColumns({"key": F.col("ordinal"), "ordinal": F.col("rank")}).drop("rank")
    return records.patch_dups(numbered, text.read_marks(spark, path)).select(F.col("key").alias("ordinal"), "flag")


def permutation_file(spark: Spark, d: str) -> DataFrame:
    path = new_folder(spark, "index") + "/x.idx"
    text.write_permutation(ordering.permutation(from_orders(spark, d)), path)
    return text.read_permutation(spark, path)


def sort_rows(spark: Spark, d: str) -> DataFrame:
    return ordering.sort(from_orders(spark, d), "name_mates").select("ordinal", "read_name", "flag")


def flagstat_stream(spark: Spark, d: str) -> DataFrame:
    """Running totals once all files of a stream are in."""
    folder, name = new_folder(spark, "stream"), f"totals_{uuid.uuid4().hex}"
    from_lineitem(spark, d).select("flag", "ref_id", "next_ref_id", "mapq").write.parquet(f"{folder}/in")
    query = stream.start(stream.read_stream(spark, f"{folder}/in", 1), name, f"{folder}/state")
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


QUERIES = {f.__name__: f for f in (
    flagstat_counts, flagstat_wide, flagstat_percent, flagstat_report, flagstat_merge, flag_predicates, project_template, markdup_view,
    coverage_total, record_count, cigar_string, cigar_ops_exploded, cigar_span_readlen, cigar_suppressed, cigar_long_form, alignment_end,
    depth_rle, depth_binned, depth_anchor, depth_mapq, depth_per_base, depth_text, depth_regions, depth_region_string, region_override,
    region_default_all, sort_coordinate, sort_name, sort_name_mates, index_permutation, view_by_index, patch_dups, block_stats, block_lookup,
    block_first_row, item_sizes, tag_hit_count, tag_scan, seq_encode, seq_decode, bed_parse, bed_errors, virtual_position, ref_dictionary,
    bam_roundtrip, bgzf_uncompressed_size, header_text, codec_benchmark, reference_list, view_records, bam_fields, depth_bed_gz,
    store_roundtrip, store_ref_range, marks_file, permutation_file, sort_rows, flagstat_stream,
)}
