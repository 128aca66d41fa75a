"""Virtual positions: 48 bits of block start, 16 bits within the block."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack(compressed: Column, within: Column) -> Column:
    """Raises where a part doesn't fit."""
    fits = compressed.between(0, (1 << 48) - 1) & within.between(0, (1 << 16) - 1)
    return F.when(fits, F.shiftleft(compressed.cast("long"), 16).bitwiseOR(within.cast("long"))).otherwise(F.raise_error(F.lit("virtual position overflow")).cast("long"))


def compressed(position: Column) -> Column:
    return F.shiftrightunsigned(position, 16)


def within(position: Column) -> Column:
    return position.bitwiseAND(F.lit(0xFFFF).cast("long"))
