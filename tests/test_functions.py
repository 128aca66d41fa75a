"""Column functions on literals."""

import pytest
from pyspark.sql import functions as F

from readloom import schema as S
from readloom.functions import cigar, flags, positions, seq, tags
from readloom.sources import text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_each_flag_predicate_sees_its_bit_only(spark):
    for name, bit in flags.PREDICATES.items():
        rows = spark.createDataFrame([(b,) for b in flags.PREDICATES.values()], "flag int")
        assert [r[0] for r in rows.where(flags.predicate(name)).collect()] == [bit]
    assert S.DEPTH_MASK == 1796


def test_cigar_parse_render_and_totals(spark):
    c = cigar.parse(F.lit("5S10M2I3D4N1=2X6H7P"))
    assert one(spark, cigar.render(c)) == "5S10M2I3D4N1=2X6H7P"
    assert one(spark, cigar.span(c)) == 20
    assert one(spark, cigar.read_length(c)) == 20
    assert one(spark, cigar.alignment_end(F.lit(0), cigar.parse(F.lit("10S")))) is None
    assert one(spark, cigar.render(cigar.from_codes(F.array(F.lit(160), F.lit(18), F.lit(33))))) == "10M1D2I"
    assert one(spark, F.size(cigar.parse(F.lit("*")))) == 0
    with pytest.raises(Exception, match="malformed"):
        one(spark, cigar.parse(F.lit("5Q")))


def test_codes_round_trip(spark):
    c = cigar.parse(F.lit("5S268435455M2N"))
    assert one(spark, cigar.render(cigar.from_codes(cigar.to_codes(c)))) == "5S268435455M2N"


def test_sequences_keep_equals_signs_and_odd_lengths(spark):
    for text_ in ("", "A", "=A=", "ACGTN", "=ACMGRSVTWYHKDBN"):
        packed = seq.encode(F.lit(text_))
        assert one(spark, seq.decode(packed, F.lit(len(text_)))) == text_
    assert one(spark, seq.encode(F.lit("A"))) == b"\x10"
    assert one(spark, seq.decode(seq.encode(F.lit("az")), F.lit(2))) == "AN"


@pytest.mark.parametrize("raw, tag, value", [
    ("TAGZvalue1\0LONGERTAGZvalue2\0", "TAG", "value1"),
    ("TAGZvalue1\0LONGERTAGZvalue2\0", "LONGERTAG", "value2"),
    ("TAGZvalue1\0LONGERTAGZvalue2\0", "NONEXISTENT", None),
    ("TAGZvalue1\0LONGERTAGZvalue2\0", "", None),
    ("TAGZvalue1", "TAG", "value1"),
    ("TAZvalue1\0", "TAG", None),
    ("", "TAG", None),
])
def test_tag_scan(spark, raw, tag, value):
    assert one(spark, tags.scan(F.lit(raw), tag)) == value


def test_hit_count_by_type(spark):
    kind = "array<struct<tag:string,type:string,value:string>>"
    for type_, value, expected in (("i", "7", 7), ("I", "4294967295", -1), ("A", "B", 66), ("Z", "7", None), ("f", "1.5", None)):
        assert one(spark, tags.hit_count(F.from_json(F.lit(f'[{{"tag":"HI","type":"{type_}","value":"{value}"}}]'), kind))) == expected
    assert one(spark, tags.hit_count(F.array().cast(kind))) is None


@pytest.mark.parametrize("position, parts", [(88384945211, (1348647, 15419)), (26155658182977, (399103671, 321))])
def test_virtual_positions(spark, position, parts):
    p = F.lit(position)
    assert (one(spark, positions.compressed(p)), one(spark, positions.within(p))) == parts
    assert one(spark, positions.pack(*map(F.lit, parts))) == position


def test_virtual_position_overflow(spark):
    with pytest.raises(Exception, match="overflow"):
        one(spark, positions.pack(F.lit(1 << 48), F.lit(0)))


def lines(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "region_id int, value string")


def test_region_strings(spark):
    assert tuple(text.parse_regions(lines(spark, "chr3:51289-19238568")).first())[1:] == ("chr3", 51289, 19238568)
    for bad in ("chrX:346798-23689090-", "chrX:346798-1", "chrX", "chrX:1-"):
        with pytest.raises(Exception, match="bad region"):
            text.parse_regions(lines(spark, bad)).collect()


def test_bed_lines(spark):
    assert tuple(text.parse_bed(lines(spark, "chr1\t5 9 name")).first())[1:] == ("chr1", 5, 9)
    with pytest.raises(Exception, match="bad interval"):
        text.parse_bed(lines(spark, "")).collect()
