"""Flag statistics: sixteen counters for reads that pass and fail quality control, in one partial aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.flags import has, is_primary


def conditions() -> dict[str, Column]:
    """Counter -> condition, in report order."""
    primary = is_primary()
    paired = primary & has(S.PAIRED)
    mapped = ~has(S.UNMAPPED)
    both = paired & mapped & ~has(S.MATE_UNMAPPED)
    elsewhere = both & (F.col("next_ref_id") != F.col("ref_id"))
    return {
        "total": F.lit(True),
        "primary": primary,
        "secondary": has(S.SECONDARY),
        "supplementary": ~has(S.SECONDARY) & has(S.SUPPLEMENTARY),
        "duplicates": has(S.DUPLICATE),
        "primary_duplicates": primary & has(S.DUPLICATE),
        "mapped": mapped,
        "primary_mapped": primary & mapped,
        "paired": paired,
        "read1": paired & has(S.READ1),
        "read2": paired & has(S.READ2),
        "properly_paired": paired & has(S.PROPER_PAIR) & mapped,
        "both_mapped": both,
        "singletons": paired & has(S.MATE_UNMAPPED) & mapped,
        "mate_elsewhere": elsewhere,
        "mate_elsewhere_mapq5": elsewhere & (F.col("mapq") >= 5),
    }


PERCENT_OF = {"mapped": "total", "primary_mapped": "primary", "properly_paired": "paired", "singletons": "paired"}

# Wording of the report, after ``<passed> + <failed> ``.
LABELS = {
    "total": "in total (QC-passed reads + QC-failed reads)",
    "primary": "primary",
    "secondary": "secondary",
    "supplementary": "supplementary",
    "duplicates": "duplicates",
    "primary_duplicates": "primary duplicates",
    "mapped": "mapped",
    "primary_mapped": "primary mapped",
    "paired": "paired in sequencing",
    "read1": "read1",
    "read2": "read2",
    "properly_paired": "properly paired",
    "both_mapped": "with itself and mate mapped",
    "singletons": "singletons",
    "mate_elsewhere": "with mate mapped to a different chr",
    "mate_elsewhere_mapq5": "with mate mapped to a different chr (mapQ>=5)",
}
COUNTERS = tuple(LABELS)


def wide(alignments: DataFrame) -> DataFrame:
    """One row: <counter>_passed and <counter>_failed."""
    failed = has(S.QC_FAIL)
    cells = []
    for name, condition in conditions().items():
        cells += [F.count_if(condition & ~failed).alias(f"{name}_passed"), F.count_if(condition & failed).alias(f"{name}_failed")]
    return alignments.select("flag", "ref_id", "next_ref_id", "mapq").agg(*cells)


def counts(alignments: DataFrame) -> DataFrame:
    """counter, passed, failed."""
    rows = ", ".join(f"'{c}', {c}_passed, {c}_failed" for c in COUNTERS)
    return wide(alignments).selectExpr(f"stack({len(COUNTERS)}, {rows}) as (counter, passed, failed)")


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, F.format_string("%.2f%%", 100.0 * part / whole)).otherwise("N/A")


def percents(alignments: DataFrame) -> DataFrame:
    """counter, passed, failed and their shares as text, for the counters that are reported with shares."""
    w = wide(alignments)
    rows = []
    for c, of in PERCENT_OF.items():
        one = [F.lit(c).alias("counter"), F.col(f"{c}_passed").alias("passed"), F.col(f"{c}_failed").alias("failed")]
        rows.append(F.struct(*one, percent(F.col(f"{c}_passed"), F.col(f"{of}_passed")).alias("passed_percent"), percent(F.col(f"{c}_failed"), F.col(f"{of}_failed")).alias("failed_percent")))
    return w.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def report(alignments: DataFrame) -> DataFrame:
    """line_no (from 1), line."""
    lines = []
    for c in COUNTERS:
        p, f = F.col(f"{c}_passed"), F.col(f"{c}_failed")
        parts = [p.cast("string"), F.lit(" + "), f.cast("string"), F.lit(f" {LABELS[c]}")]
        if of := PERCENT_OF.get(c):
            parts += [F.lit(" ("), percent(p, F.col(f"{of}_passed")), F.lit(" : "), percent(f, F.col(f"{of}_failed")), F.lit(")")]
        lines.append(F.concat(*parts))
    return wide(alignments).select(F.posexplode(F.array(*lines)).alias("at", "line")).select((F.col("at") + 1).alias("line_no"), "line")


def merge(partials: DataFrame) -> DataFrame:
    """Sum of several ``wide`` rows."""
    return partials.agg(*[F.sum(c).alias(c) for c in partials.columns])
