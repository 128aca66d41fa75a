"""The canonical relations and fixed values of the alignment format."""

from __future__ import annotations

ALIGNMENTS = (
    "ordinal long, ref_id int, pos int, mapq smallint, bin int, flag int, next_ref_id int, next_pos int, tlen int, "
    "read_name string, cigar array<struct<op:string,len:int>>, seq string, qual binary, "
    "tags array<struct<tag:string,type:string,value:string>>, tags_raw binary"
)
REF_SEQS = "ref_id int, name string, length long"
REGIONS = "region_id int, chr string, start long, end long"

# Flag bits.
PAIRED, PROPER_PAIR, UNMAPPED, MATE_UNMAPPED = 0x1, 0x2, 0x4, 0x8
REVERSE, MATE_REVERSE, READ1, READ2 = 0x10, 0x20, 0x40, 0x80
SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 0x100, 0x200, 0x400, 0x800

# Reads that have any of these bits don't count for depth.
DEPTH_MASK = UNMAPPED | SECONDARY | QC_FAIL | DUPLICATE

# CIGAR operations by code, and what they consume; bases by 4-bit code.
CIGAR_OPS = "MIDNSHP=X"
CONSUMES_REFERENCE = ("M", "D", "N", "=", "X")
CONSUMES_READ = ("M", "I", "S", "=", "X")
BASES = "=ACMGRSVTWYHKDBN"
