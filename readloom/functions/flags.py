"""Predicates on the flag bit mask."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S

PREDICATES = {
    "is_paired": S.PAIRED,
    "is_proper_pair": S.PROPER_PAIR,
    "is_unmapped": S.UNMAPPED,
    "is_mate_unmapped": S.MATE_UNMAPPED,
    "is_reverse_complemented": S.REVERSE,
    "is_mate_reverse_complemented": S.MATE_REVERSE,
    "is_read_1": S.READ1,
    "is_read_2": S.READ2,
    "is_secondary": S.SECONDARY,
    "is_qc_fail": S.QC_FAIL,
    "is_duplicate": S.DUPLICATE,
    "is_supplementary": S.SUPPLEMENTARY,
}


def has(mask: int, flag: Column | str = "flag") -> Column:
    """Whether any bit of ``mask`` is set."""
    column = F.col(flag) if isinstance(flag, str) else flag
    return column.bitwiseAND(F.lit(mask)) != 0


def predicate(name: str, flag: Column | str = "flag") -> Column:
    return has(PREDICATES[name], flag)


def is_primary(flag: Column | str = "flag") -> Column:
    """Neither secondary nor supplementary."""
    return ~has(S.SECONDARY | S.SUPPLEMENTARY, flag)
