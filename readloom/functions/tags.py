"""Tag columns: array<struct<tag, type, value>>, and tags as raw text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def value(tags: Column, tag: str) -> Column:
    """The first value of a tag as text; null if absent."""
    return F.get(F.filter(tags, lambda t: t["tag"] == tag), F.lit(0))["value"]


def hit_count(tags: Column) -> Column:
    """HI as an int (of a whole-number or character type; unsigned values beyond int wrap); null if absent or of another type."""
    found = F.get(F.filter(tags, lambda t: t["tag"] == "HI"), F.lit(0))
    number = found["value"].try_cast("long")
    wrapped = F.when(number > 2147483647, number - 4294967296).otherwise(number).cast("int")
    return F.when(found["type"].isin("c", "C", "s", "S", "i", "I"), wrapped).when(found["type"] == "A", F.ascii(found["value"]))


def scan(text: Column, tag: str) -> Column:
    """What follows the first occurrence of ``tag`` and one type character, up to a NUL or the end; null if there is nothing."""
    if not tag:
        return F.lit(None).cast("string")
    at = F.instr(text, tag)
    rest = F.substr(text, at + len(tag) + 1, F.lit(2147483647))
    return F.when(at > 0, F.nullif(F.substring_index(rest, "\u0000", 1), F.lit("")))
