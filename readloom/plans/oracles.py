"""The same queries as plain SQL."""

from __future__ import annotations

from ..functions.flags import PREDICATES
from ..functions.seq import HEX
from ..operators.flagstat import COUNTERS, LABELS, PERCENT_OF
from ..schema import BASES
from .queries import BED, GIVEN
from .synth import SQL as WITH

_ON = lambda bit: f"(flag & {bit}) <> 0"
_PRIMARY = "(flag & 2304) = 0"
_PAIRED = f"{_PRIMARY} AND {_ON(1)}"
_BOTH = f"{_PAIRED} AND (flag & 12) = 0"
_AWAY = f"{_BOTH} AND next_ref_id <> ref_id"
_CONDITIONS = dict(zip(COUNTERS, (
    "true", _PRIMARY, _ON(256), f"NOT {_ON(256)} AND {_ON(2048)}", _ON(1024), f"{_PRIMARY} AND {_ON(1024)}", "(flag & 4) = 0",
    f"{_PRIMARY} AND (flag & 4) = 0", _PAIRED, f"{_PAIRED} AND {_ON(64)}", f"{_PAIRED} AND {_ON(128)}", f"{_PAIRED} AND {_ON(2)} AND (flag & 4) = 0",
    _BOTH, f"{_PAIRED} AND {_ON(8)} AND (flag & 4) = 0", _AWAY, f"{_AWAY} AND mapq >= 5",
)))


def _wide() -> str:
    cells = [f"count(*) FILTER (WHERE {c} AND (flag & 512) {op} 0) AS {n}_{w}" for n, c in _CONDITIONS.items() for w, op in (("passed", "="), ("failed", "<>"))]
    return f"SELECT {', '.join(cells)} FROM a"


def _percent(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} <> 0 THEN printf('%.2f%%', 100.0 * {part} / {whole}) ELSE 'N/A' END"


def _each(row) -> str:
    return " UNION ALL ".join(row(c) for c in COUNTERS)


def _report_line(n: int, c: str) -> str:
    line = f"{c}_passed || ' + ' || {c}_failed || ' {LABELS[c]}'"
    if of := PERCENT_OF.get(c):
        line += f" || ' (' || {_percent(c + '_passed', of + '_passed')} || ' : ' || {_percent(c + '_failed', of + '_failed')} || ')'"
    return f"SELECT {n} AS line_no, {line} AS line FROM w"


def _runs(where: str = "(flag & 1796) = 0 AND span > 0", n: str = "span", mapq: int = 0) -> str:
    """Run-length depth by brute force over every base (no event sums)."""
    return f"""
s AS (SELECT ref_id, pos AS st, pos + {n} AS en FROM a WHERE ref_id >= 0 AND pos >= 0 AND mapq >= {mapq} AND {where}),
b AS (SELECT refs.ref_id, name, length, unnest(range(0, length)) AS p FROM refs),
c AS (SELECT ref_id, p, count(*) AS k FROM (SELECT ref_id, unnest(range(st, en)) AS p FROM s) GROUP BY 1, 2),
g AS (SELECT b.ref_id, name AS chr, b.p, coalesce(k, 0) AS depth FROM b LEFT JOIN c ON b.ref_id = c.ref_id AND b.p = c.p),
k AS (SELECT *, p - row_number() OVER (PARTITION BY ref_id, depth ORDER BY p) AS island FROM g),
runs AS (SELECT chr, min(p)::BIGINT AS start, (max(p) + 1)::BIGINT AS "end", depth FROM k GROUP BY ref_id, chr, depth, island)"""


_RUNS_OUT = 'SELECT chr, start, "end", depth FROM runs'


def _values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join(f"({i}, '{c}', {s}::BIGINT, {e}::BIGINT)" for i, c, s, e in rows) + ') AS r(region_id, chr, start, "end")'


_BED = _values([(i, *x.split()[:3]) for i, x in enumerate(BED)])
_GIVEN = _values([(100 + i, x.split(":")[0], *x.split(":")[1].split("-")) for i, x in enumerate(GIVEN)])
_CLIPPED = 'SELECT r.region_id, runs.chr, greatest(runs.start, r.start) AS start, least(runs."end", r."end") AS "end", depth FROM runs JOIN {} ON runs.chr = r.chr AND runs.start < r."end" AND runs."end" > r.start'
_CLIPPED_ROWS = "SELECT * FROM ({}) WHERE start < \"end\""
_COORD = "CASE WHEN ref_id = -1 THEN 2147483647 ELSE ref_id END, pos, (flag & 16) <> 0, ordinal"
_DIGITS = "lpad(printf('%X', ordinal * 2654435761), 16, '7')"
_BASE_TEXT = f"left(translate({_DIGITS}, '{HEX}', '{BASES}'), (1 + ordinal % 16)::INT)"


def _q(body: str, more: str = "") -> str:
    return f"WITH {WITH}{',' + more if more else ''} {body}"


# Bytes of a record: its length, the fixed part, name, operations, bases, qualities, and the tags RG (text) and HI (a whole number).
_RECORD = """4 + 32 + length(read_name) + 1
  + 4 * CASE WHEN ref_id < 0 OR pos < 0 THEN 0 ELSE len(regexp_extract_all(cigar_text, '[MIDNSHP=X]')) END
  + (1 + ordinal % 16 + 1) // 2 + 1 + ordinal % 16 + 3 + length(read_name) + 1 + CASE WHEN hi IS NULL THEN 0 ELSE 7 END"""

ORACLES = {
    "flagstat_counts": _q(_each(lambda c: f"SELECT '{c}' AS counter, {c}_passed AS passed, {c}_failed AS failed FROM w"), f" w AS ({_wide()})"),
    "flagstat_wide": _q(_wide()),
    "flagstat_merge": _q(_wide()),
    "flagstat_percent": _q(" UNION ALL ".join(f"SELECT '{c}' AS counter, {c}_passed AS passed, {c}_failed AS failed, {_percent(c + '_passed', of + '_passed')} AS passed_percent, {_percent(c + '_failed', of + '_failed')} AS failed_percent FROM w" for c, of in PERCENT_OF.items()), f" w AS ({_wide()})"),
    "flagstat_report": _q(" UNION ALL ".join(_report_line(i + 1, c) for i, c in enumerate(COUNTERS)), f" w AS ({_wide()})"),
    "flag_predicates": _q("SELECT ordinal, " + ", ".join(f"{_ON(bit)} AS {n}" for n, bit in PREDICATES.items()) + " FROM o"),
    "project_template": _q("SELECT ordinal, ref_id, flag FROM o"),
    "markdup_view": _q("SELECT ordinal, ref_id, pos, flag, mapq, read_name, cigar_text, tlen FROM o"),
    "coverage_total": _q("SELECT sum(span)::BIGINT AS covered_bases FROM a"),
    "record_count": "SELECT count(*) AS records FROM lineitem",
    "cigar_string": _q("SELECT ordinal, cigar_text FROM o"),
    "cigar_ops_exploded": _q("SELECT ordinal, (unnest(range(len(n))))::INT AS at, unnest(k) AS op, unnest(n)::INT AS len FROM (SELECT ordinal, regexp_extract_all(cigar_text, '(\\d+)([MIDNSHP=X])', 1) AS n, regexp_extract_all(cigar_text, '(\\d+)([MIDNSHP=X])', 2) AS k FROM o)"),
    "cigar_span_readlen": _q("SELECT ordinal, span, read_length FROM o"),
    "cigar_suppressed": _q("SELECT ordinal, CASE WHEN ref_id < 0 OR pos < 0 THEN '' ELSE cigar_text END AS cigar_text FROM o"),
    "cigar_long_form": _q("SELECT ordinal, cigar_text FROM o"),
    "alignment_end": _q('SELECT ordinal, pos AS start, CASE WHEN span > 0 THEN pos + span - 1 END AS "end" FROM o'),
    "depth_rle": _q(_RUNS_OUT, _runs()),
    "depth_binned": _q(_RUNS_OUT, _runs()),
    "depth_anchor": _q(_RUNS_OUT, _runs("span > 0", "CASE WHEN (flag & 1796) <> 0 THEN 1 ELSE span END")),
    "depth_mapq": _q(_RUNS_OUT, _runs(mapq=30)),
    "depth_per_base": _q("SELECT chr, p::BIGINT AS coord, depth FROM g WHERE depth > 0", _runs()),
    "depth_text": _q("SELECT chr || chr(9) || p || chr(9) || depth AS value FROM g WHERE depth > 0", _runs(mapq=45)),
    "depth_regions": _q(_CLIPPED_ROWS.format(_CLIPPED.format(_BED)), _runs()),
    "depth_region_string": _q(_CLIPPED_ROWS.format(_CLIPPED.format(_GIVEN)), _runs()),
    "region_override": _q(f'SELECT region_id, x.chr, start, least("end", length) AS "end" FROM (SELECT * FROM {_BED} WHERE chr NOT IN (SELECT chr FROM {_GIVEN}) UNION ALL SELECT * FROM {_GIVEN}) x JOIN refs ON name = x.chr WHERE start < least("end", length)'),
    "region_default_all": _q('SELECT ref_id AS region_id, name AS chr, 0::BIGINT AS start, length AS "end" FROM refs'),
    "sort_coordinate": _q(f"SELECT row_number() OVER (ORDER BY {_COORD}) - 1 AS rank, ordinal, ref_id, pos, flag FROM o"),
    "sort_name": _q("SELECT row_number() OVER (ORDER BY read_name, ordinal) - 1 AS rank, ordinal, read_name FROM o"),
    "sort_name_mates": _q("SELECT row_number() OVER (ORDER BY read_name, hi NULLS FIRST, flag, ordinal) - 1 AS rank, ordinal, read_name, flag FROM o"),
    "index_permutation": _q(f"SELECT row_number() OVER (ORDER BY {_COORD}) - 1 AS rank, ordinal FROM o"),
    "view_by_index": _q("SELECT row_number() OVER (ORDER BY read_name, ordinal) - 1 AS rank, read_name, ref_id, pos, mapq, cigar_text FROM o"),
    "patch_dups": _q("SELECT ordinal, CASE WHEN ordinal % 10 = 0 THEN flag | 1024 ELSE flag END AS flag FROM o"),
    "block_stats": _q("SELECT ordinal // 1000 AS block_id, min(ref_id) AS min_value, max(ref_id) AS max_value, count(*) AS items FROM o GROUP BY 1"),
    "block_lookup": _q("SELECT min(b) AS leftmost, max(b) AS rightmost FROM (SELECT ordinal // 1000 AS b FROM o GROUP BY 1 HAVING min(ref_id) <= 7 AND max(ref_id) >= 7)"),
    "block_first_row": _q("SELECT b AS block_id, (sum(n) OVER (ORDER BY b) - n)::BIGINT AS first_row FROM (SELECT ordinal // 1000 AS b, count(*) AS n FROM o GROUP BY 1)"),
    "item_sizes": _q("SELECT ordinal, length(read_name)::BIGINT AS size FROM o"),
    "tag_hit_count": _q("SELECT ordinal, hi AS hit_count, read_name AS read_group FROM o"),
    "tag_scan": _q("SELECT ordinal, read_name AS rg, cigar_text AS xy, NULL::VARCHAR AS qq FROM o"),
    "seq_encode": _q(f"SELECT ordinal, h || CASE WHEN length(h) % 2 = 1 THEN '0' ELSE '' END AS packed FROM (SELECT ordinal, left({_DIGITS}, (1 + ordinal % 16)::INT) AS h FROM o)"),
    "seq_decode": _q(f"SELECT ordinal, {_BASE_TEXT} AS bases FROM o"),
    "bed_parse": f"SELECT * FROM {_BED}",
    "bed_errors": "SELECT * FROM (VALUES (0, false, 'chr1', 5::BIGINT, 9::BIGINT), (1, true, NULL, NULL, NULL), (2, true, NULL, NULL, NULL), (3, true, NULL, NULL, NULL), (4, true, NULL, NULL, NULL), (5, true, NULL, NULL, NULL), (6, true, NULL, NULL, NULL)) AS t(region_id, bad, chr, start, \"end\")",
    "virtual_position": _q("SELECT ordinal, ordinal * 1000003 * 65536 + ordinal % 65536 AS vpos, ordinal * 1000003 AS block_start, ordinal % 65536 AS within FROM o"),
    "ref_dictionary": _q("SELECT a.ref_id, name, length, count(*) AS reads FROM a JOIN refs ON a.ref_id = refs.ref_id GROUP BY ALL"),
    "bam_roundtrip": _q(f"SELECT row_number() OVER (ORDER BY ordinal) - 1 AS ordinal, ref_id, pos, mapq, flag, next_ref_id, next_pos, tlen, read_name, CASE WHEN ref_id < 0 OR pos < 0 THEN '' ELSE cigar_text END AS cigar_text, {_BASE_TEXT} AS seq, hi AS hit_count FROM o"),
    "header_text": "SELECT '@HD' || chr(9) || 'VN:1.6' || chr(10) || '@PG' || chr(9) || 'ID:x' || chr(10) AS header_text",
    "reference_list": _q("SELECT ref_id, name, length FROM refs"),
    "view_records": _q(f"SELECT row_number() OVER (ORDER BY read_name, ordinal) - 1 AS rank, ({_RECORD})::BIGINT AS n_bytes, read_name FROM o"),
    "bam_fields": _q("SELECT row_number() OVER (ORDER BY ordinal) - 1 AS ordinal, flag, pos, read_name, true AS no_seq FROM o"),
    "bgzf_uncompressed_size": _q(f"SELECT (4 + 4 + 20 + 4 + (SELECT sum(length(name) + 9) FROM refs) + (SELECT sum({_RECORD}) FROM o))::BIGINT AS uncompressed_bytes"),
    "codec_benchmark": "SELECT field, codec, true AS written, true AS in_range FROM (VALUES ('ref_id'), ('pos'), ('flag'), ('read_name')) f(field), (VALUES ('zstd'), ('gzip'), ('lz4')) c(codec)",
    "depth_bed_gz": _q(_RUNS_OUT, _runs()),
    "store_roundtrip": _q("SELECT ordinal, name, pos, flag, read_name, 20 AS header_chars FROM o LEFT JOIN refs ON o.ref_id = refs.ref_id"),
    "store_ref_range": _q("SELECT ordinal, ref_id, pos FROM o WHERE ref_id >= 3 AND ref_id <= 5"),
    "marks_file": _q("SELECT ordinal, CASE WHEN ordinal % 10 = 0 THEN flag | 1024 ELSE flag END AS flag FROM o"),
    "permutation_file": _q(f"SELECT row_number() OVER (ORDER BY {_COORD}) - 1 AS rank, ordinal FROM o"),
    "sort_rows": _q("SELECT ordinal, read_name, flag FROM o"),
    "flagstat_stream": _q(_wide()),
}
