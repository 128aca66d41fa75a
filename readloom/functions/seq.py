"""4-bit packed base sequences, as binary and as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S

HEX = "0123456789ABCDEF"
UNKNOWN = 15


def decode(packed: Column, length: Column) -> Column:
    """The bases of ``length`` nibbles, high nibble first."""
    return F.substr(F.translate(F.hex(packed), HEX, S.BASES), F.lit(1), length.cast("int"))


def encode(bases: Column) -> Column:
    """Packed bases; lower case is taken as upper, other characters as N, an odd end is filled with 0."""
    known = F.regexp_replace(F.upper(bases), f"[^{S.BASES}]", S.BASES[UNKNOWN])
    digits = F.translate(known, S.BASES, HEX)
    return F.unhex(F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits))
