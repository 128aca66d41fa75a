"""CIGAR columns: array<struct<op, len>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S

OP = r"(\d+)([MIDNSHP=X])"


def parse(text: Column) -> Column:
    """``5S20M`` to operations; ``*`` and empty text have none. Malformed text raises."""
    whole = F.when(text.isin("*", ""), F.lit("")).otherwise(text)
    sizes, ops = F.regexp_extract_all(whole, F.lit(OP), F.lit(1)), F.regexp_extract_all(whole, F.lit(OP), F.lit(2))
    pairs = F.zip_with(sizes, ops, lambda n, o: F.struct(o.alias("op"), n.cast("int").alias("len")))
    return F.when(whole.rlike(rf"^({OP})*$"), pairs).otherwise(F.raise_error(F.concat(F.lit("malformed CIGAR: "), text)))


def from_codes(codes: Column) -> Column:
    """Packed operations: the low 4 bits are the kind, the rest the length."""
    kinds = F.array(*[F.lit(c) for c in S.CIGAR_OPS])

    def one(v: Column) -> Column:
        length = F.call_function("shiftrightunsigned", v.cast("long"), F.lit(4)).cast("int")
        return F.struct(F.element_at(kinds, (v.bitwiseAND(F.lit(15)) + 1).cast("int")).alias("op"), length.alias("len"))

    return F.transform(codes, one)


def to_codes(cigar: Column) -> Column:
    """The inverse of ``from_codes``, as longs."""

    def one(x: Column) -> Column:
        kind = F.call_function("instr", F.lit(S.CIGAR_OPS), x["op"]) - 1
        return F.call_function("shiftleft", x["len"].cast("long"), F.lit(4)).bitwiseOR(kind.cast("long"))

    return F.transform(cigar, one)


def render(cigar: Column) -> Column:
    return F.array_join(F.transform(cigar, lambda x: F.concat(x["len"].cast("string"), x["op"])), "")


def _total(cigar: Column, ops: tuple[str, ...]) -> Column:
    return F.aggregate(F.filter(cigar, lambda x: x["op"].isin(*ops)), F.lit(0).cast("long"), lambda n, x: n + x["len"])


def span(cigar: Column) -> Column:
    """Reference bases covered; deletions and skips count."""
    return _total(cigar, S.CONSUMES_REFERENCE)


def read_length(cigar: Column) -> Column:
    return _total(cigar, S.CONSUMES_READ)


def alignment_end(pos: Column, cigar: Column) -> Column:
    """Last covered position (inclusive); null where nothing is covered."""
    n = span(cigar)
    return F.when(n > 0, pos + n - 1)


def suppress_unplaced(ref_id: Column, pos: Column, cigar: Column) -> Column:
    """No operations for reads without a place."""
    return F.when((ref_id < 0) | (pos < 0), F.slice(cigar, 1, 0)).otherwise(cigar)


def long_cigar(cigar: Column, l_seq: Column, real: Column) -> Column:
    """Where the stored CIGAR is the two-operation stand-in ``<l_seq>S<n>N``, the one of the CG tag."""
    stand_in = (F.size(cigar) == 2) & (F.get(cigar, F.lit(0))["op"] == "S") & (F.get(cigar, F.lit(0))["len"] == l_seq) & real.isNotNull()
    return F.when(stand_in, real).otherwise(cigar)
