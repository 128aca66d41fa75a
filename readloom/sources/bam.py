"""Alignment files in BAM: a Spark data source that reads and writes them.

A read is planned over runs of blocks. A run's reader finds the first record
that begins in it by itself: it looks for a place from which a chain of records
is well-formed. Ordinals need the number of records before each run, so the
source numbers records within runs (``split``, ``place``); ``read_bam`` turns
these into ordinals with one small aggregate.
"""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schema as S
from . import bgzf
from .shared import concatenate, pieces, resolve

MAGIC = b"BAM\x01"
CHECKED = 8  # records that must be well-formed for a place to count as a record's beginning
SPLIT = 32 << 20
TASKS = 200  # a file of short runs is read by about so many tasks, unless each then had more than SPLIT bytes
SOURCE_SCHEMA = "path string, split int, place long, " + S.ALIGNMENTS.removeprefix("ordinal long, ")

SCALARS = {"A": "c", "c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


# --- records -----------------------------------------------------------------


def decode_tags(raw: bytes) -> list[dict]:
    """Tags in file order; values as text, arrays as ``subtype,v,v,...``."""
    out, at = [], 0
    while at < len(raw):
        tag, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind in SCALARS:
            (v,) = struct.unpack_from("<" + SCALARS[kind], raw, at)
            at += struct.calcsize(SCALARS[kind])
            value = v.decode("latin-1") if kind == "A" else repr(v)
        elif kind in "ZH":
            end = raw.index(b"\0", at)
            value, at = raw[at:end].decode("latin-1"), end + 1
        elif kind == "B":
            sub, n = chr(raw[at]), struct.unpack_from("<I", raw, at + 1)[0]
            values = struct.unpack_from(f"<{n}{SCALARS[sub]}", raw, at + 5)
            at += 5 + struct.calcsize(f"<{n}{SCALARS[sub]}")
            value = ",".join([sub, *map(repr, values)])
        else:
            raise ValueError(f"unknown tag type {kind!r}")
        out.append({"tag": tag, "type": kind, "value": value})
    return out


def encode_tags(tags: list[dict]) -> bytes:
    out = []
    for t in tags or []:
        kind, value = t["type"], t["value"]
        body = t["tag"].encode() + kind.encode()
        if kind == "A":
            body += value.encode("latin-1")
        elif kind in SCALARS:
            body += struct.pack("<" + SCALARS[kind], float(value) if kind == "f" else int(value))
        elif kind in "ZH":
            body += value.encode("latin-1") + b"\0"
        else:
            sub, *values = value.split(",")
            body += sub.encode() + struct.pack("<I", len(values)) + struct.pack(f"<{len(values)}{SCALARS[sub]}", *[float(v) if sub == "f" else int(v) for v in values])
        out.append(body)
    return b"".join(out)


def _operations(codes: tuple[int, ...]) -> list[dict]:
    return [{"op": S.CIGAR_OPS[c & 15], "len": c >> 4} for c in codes]


def decode_record(body: bytes) -> dict:
    """A record's columns. Unplaced reads have no CIGAR; a CIGAR kept in the CG tag takes the place of its stand-in, and the tag goes."""
    ref_id, pos, l_name, mapq, bin_, n_cigar, flag, l_seq, next_ref, next_pos, tlen = struct.unpack_from("<iiBBHHHIiii", body)
    at = 32
    name = body[at : at + l_name].rstrip(b"\0").decode("latin-1")
    at += l_name
    cigar = _operations(struct.unpack_from(f"<{n_cigar}I", body, at))
    at += 4 * n_cigar
    half = (l_seq + 1) // 2
    digits = body[at : at + half].hex().upper()[:l_seq]
    seq = digits.translate(str.maketrans("0123456789ABCDEF", S.BASES))
    at += half
    qual = body[at : at + l_seq]
    raw = body[at + l_seq :]
    tags = decode_tags(raw)
    if len(cigar) == 2 and cigar[0] == {"op": "S", "len": l_seq}:
        real = next((t for t in tags if t["tag"] == "CG" and t["value"].startswith("I,")), None)
        if real is not None:
            cigar = _operations(tuple(map(int, real["value"].split(",")[1:])))
            tags = [t for t in tags if t is not real]
            raw = encode_tags(tags)
    if ref_id < 0 or pos < 0:
        cigar = []
    return {
        "ref_id": ref_id, "pos": pos, "mapq": mapq, "bin": bin_, "flag": flag, "next_ref_id": next_ref, "next_pos": next_pos, "tlen": tlen,
        "read_name": name, "cigar": cigar, "seq": seq, "qual": None if qual.count(255) == len(qual) else qual, "tags": tags, "tags_raw": raw,
    }


def encode_record(row: dict) -> bytes:
    """A record with its length. A row without bases or qualities has none; a CIGAR of over 65,535 operations goes to the CG tag."""
    name = (row.get("read_name") or "*").encode("latin-1") + b"\0"
    if len(name) > 255:
        raise ValueError(f"a read name has {len(name) - 1} bytes; the format holds 254")
    seq = row.get("seq") or ""
    codes = [(x["len"] << 4) | S.CIGAR_OPS.index(x["op"]) for x in row.get("cigar") or []]
    raw = row.get("tags_raw")
    raw = bytes(raw) if raw is not None else encode_tags(row.get("tags") or [])
    if len(codes) > 0xFFFF:
        covered = sum(x["len"] for x in row["cigar"] if x["op"] in S.CONSUMES_REFERENCE)
        raw += b"CGBI" + struct.pack(f"<I{len(codes)}I", len(codes), *codes)
        codes = [(len(seq) << 4) | 4, (covered << 4) | 3]
    digits = seq.upper().translate(str.maketrans(S.BASES, "0123456789ABCDEF"))
    digits = re.sub("[^0-9A-F]", "F", digits)
    packed = bytes.fromhex(digits + "0" * (len(digits) % 2))
    qual = row.get("qual")
    qual = bytes(qual) if qual is not None else b"\xff" * len(seq)
    head = struct.pack("<iiBBHHHIiii", row["ref_id"], row["pos"], len(name), row["mapq"], row["bin"], len(codes), row["flag"], len(seq), row["next_ref_id"], row["next_pos"], row["tlen"])
    body = head + name + struct.pack(f"<{len(codes)}I", *codes) + packed + qual + raw
    return struct.pack("<I", len(body)) + body


def encode_header(text: str, refs: list[tuple[str, int]]) -> bytes:
    raw = text.encode()
    out = MAGIC + struct.pack("<I", len(raw)) + raw + struct.pack("<I", len(refs))
    for name, length in refs:
        one = name.encode() + b"\0"
        out += struct.pack("<I", len(one)) + one + struct.pack("<I", length)
    return out


HEAD = np.dtype([("ref_id", "<i4"), ("pos", "<i4"), ("l_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_cigar", "<u2"), ("flag", "<u2"), ("l_seq", "<u4"), ("next_ref_id", "<i4"), ("next_pos", "<i4"), ("tlen", "<i4")])
OPERATION, TAG = pa.struct([("op", pa.string()), ("len", pa.int32())]), pa.struct([("tag", pa.string()), ("type", pa.string()), ("value", pa.string())])
KINDS = {
    "ref_id": pa.int32(), "pos": pa.int32(), "mapq": pa.int16(), "bin": pa.int32(), "flag": pa.int32(), "next_ref_id": pa.int32(), "next_pos": pa.int32(), "tlen": pa.int32(),
    "read_name": pa.string(), "cigar": pa.list_(OPERATION), "seq": pa.string(), "qual": pa.binary(), "tags": pa.list_(TAG), "tags_raw": pa.binary(),
}
_PAIRS = np.array([[ord(S.BASES[k >> 4]), ord(S.BASES[k & 15])] for k in range(256)], np.uint8)
_NAMES = np.array(list(S.CIGAR_OPS) + ["?"] * 7)


def _spans(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all items of spans, one span after the other, and where each span begins among them (and the end)."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1]), ends


def decode_records(bodies: list[bytes], fields: set[str]) -> dict[str, pa.Array]:
    """The named columns of many records, decoded column by column; what isn't named isn't touched. The same values as ``decode_record``."""
    buf = np.frombuffer(b"".join(bodies), np.uint8)
    sizes = np.array([len(b) for b in bodies], np.int64)
    at = np.cumsum(sizes) - sizes
    head = buf[at[:, None] + np.arange(32)].view(HEAD)[:, 0]
    l_name, n_cigar, l_seq = (head[c].astype(np.int64) for c in ("l_name", "n_cigar", "l_seq"))
    cigar_at = at + 32 + l_name
    seq_at = cigar_at + 4 * n_cigar
    qual_at = seq_at + (l_seq + 1) // 2
    tags_at = qual_at + l_seq
    out: dict[str, pa.Array] = {c: pa.array(head[c].astype(KINDS[c].to_pandas_dtype())) for c in fields & set(HEAD.names)}
    slow: dict[int, dict] = {}  # records whose CIGAR may be in a tag
    if fields & {"cigar", "tags", "tags_raw"}:
        places, ends = _spans(cigar_at, 4 * n_cigar)
        codes = buf[places].view("<u4")
        first = np.zeros(len(bodies), np.int64)
        first[n_cigar > 0] = codes[ends[:-1][n_cigar > 0] // 4]
        slow = {i: decode_record(bodies[i]) for i in np.flatnonzero((n_cigar == 2) & (first == (l_seq << 4 | 4))).tolist()}
    if "cigar" in fields:
        counts = np.where((head["ref_id"] < 0) | (head["pos"] < 0), 0, n_cigar)
        if slow:
            rows = [(slow[i]["cigar"] if i in slow else [{"op": S.CIGAR_OPS[c & 15], "len": c >> 4} for c in codes[ends[i] // 4 : ends[i] // 4 + counts[i]].tolist()]) for i in range(len(bodies))]
            out["cigar"] = pa.array(rows, KINDS["cigar"])
        else:
            kept, starts = _spans(ends[:-1] // 4, counts)
            values = pa.StructArray.from_arrays([pa.array(_NAMES[codes[kept] & 15], pa.string()), pa.array((codes[kept] >> 4).astype(np.int32))], fields=list(OPERATION))
            out["cigar"] = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), values)
    if "read_name" in fields:
        out["read_name"] = pa.array([b[32 : 32 + n].rstrip(b"\0").decode("latin-1") for b, n in zip(bodies, l_name.tolist())], pa.string())
    if "seq" in fields:
        half = (l_seq + 1) // 2
        letters = _PAIRS[buf[_spans(seq_at, half)[0]]].reshape(-1)
        kept, starts = _spans(2 * (np.cumsum(half) - half), l_seq)
        out["seq"] = pa.StringArray.from_buffers(len(bodies), pa.py_buffer(starts.astype(np.int32).tobytes()), pa.py_buffer(letters[kept].tobytes()))
    if "qual" in fields:
        parts = [b[a : a + n] for b, a, n in zip(bodies, (qual_at - at).tolist(), l_seq.tolist())]
        out["qual"] = pa.array([None if q.count(255) == len(q) else q for q in parts], pa.binary())
    if fields & {"tags", "tags_raw"}:
        raw = [slow[i]["tags_raw"] if i in slow else b[a:] for i, (b, a) in enumerate(zip(bodies, (tags_at - at).tolist()))]
        if "tags" in fields:
            out["tags"] = pa.array([decode_tags(r) for r in raw], KINDS["tags"])
        if "tags_raw" in fields:
            out["tags_raw"] = pa.array(raw, pa.binary())
    return out


ENCODED = 8 << 20  # bytes of columns encoded at once


class _Odd(Exception):
    """Values that are left to ``encode_record``."""


def encode_records(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Parts of a batch, of about ``ENCODED`` bytes, and the records of their rows; encoded column by column, the same bytes as ``encode_record``."""
    step = max(1, batch.num_rows * ENCODED // max(batch.nbytes, 1))
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        try:
            yield part, _encode_columns(part)
        except _Odd:
            records = [encode_record(r) for r in part.to_pylist()]
            ends = np.cumsum([0, *map(len, records)])
            yield part, _binary(np.frombuffer(b"".join(records), np.uint8), ends)


def _binary(buf: np.ndarray, ends: np.ndarray) -> pa.Array:
    if ends[-1] > 0x7FFFFFFF:
        raise ValueError(f"records of {ends[-1]} bytes in one part of a batch")
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(buf.tobytes())])


def _flat(column: pa.Array, ascii_only: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text or binary column, one value after the other, and the sizes of the values (null: 0)."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    if ascii_only and len(data) and data.max() > 127:
        raise _Odd
    return data, np.diff(ends)


def _numbers(column: pa.Array, low: int, high: int) -> np.ndarray:
    if column.null_count:
        raise _Odd
    values = column.cast(pa.int64()).to_numpy(zero_copy_only=False)
    if len(values) and (values.min() < low or values.max() > high):
        raise _Odd
    return values


def _items(column: pa.Array, names: tuple[str, ...]) -> tuple[np.ndarray, list[pa.Array]]:
    """Number of items of each list (null: 0), and the fields of all items."""
    counts = pc.list_value_length(column).fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
    values = column.flatten()
    kept = [values.flatten()[values.type.get_field_index(n)] for n in names]
    if any(c.null_count for c in kept):
        raise _Odd
    return counts, kept


def _place(buf: np.ndarray, starts: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> None:
    buf[_spans(starts, sizes)[0]] = data


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of so many values each."""
    ends = np.concatenate([[0], np.cumsum(values)])
    at = np.concatenate([[0], np.cumsum(counts)])
    return ends[at[1:]] - ends[at[:-1]]


def _encode_tags(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows' tags, and the size of each row's; texts and whole numbers only."""
    counts, (tag, kind, value) = _items(column, ("tag", "type", "value"))
    if not len(tag):
        return np.zeros(0, np.uint8), np.zeros(len(column), np.int64)
    (tags, tag_sizes), (kinds, kind_sizes), (texts, text_sizes) = map(_flat, (tag, kind, value))
    if (tag_sizes != 2).any() or (kind_sizes != 1).any():
        raise _Odd
    sizes = 3 + text_sizes + 1
    text = np.isin(kinds, np.frombuffer(b"ZH", np.uint8))
    numbers = []
    for code in set(kinds[~text].tolist()):
        kind_ = np.dtype("<i4" if chr(code) == "i" else "<" + SCALARS.get(chr(code), "c"))
        if kind_.kind not in "iu":
            raise _Odd
        which = np.flatnonzero(kinds == code)
        given = value.take(pa.array(which))
        if not pc.all(pc.match_substring_regex(given, "^-?[0-9]{1,18}$")).as_py():
            raise _Odd
        limits = np.iinfo(kind_)
        numbers.append((which, _numbers(given, limits.min, limits.max).astype(kind_)))
        sizes[which] = 3 + kind_.itemsize
    ends = np.cumsum(sizes)
    at = ends - sizes
    out = np.zeros(ends[-1], np.uint8)
    out[at], out[at + 1], out[at + 2] = tags[0::2], tags[1::2], kinds
    _place(out, at[text] + 3, texts[np.repeat(text, text_sizes)], text_sizes[text])
    for which, values in numbers:
        out[(at[which] + 3)[:, None] + np.arange(values.itemsize)] = values.view(np.uint8).reshape(-1, values.itemsize)
    return out, _sums(sizes, counts)


def _digit(letter: int) -> int:
    """Four bits of a base, as ``encode_record`` translates it."""
    digit = chr(letter).upper().translate(str.maketrans(S.BASES, "0123456789ABCDEF"))
    return int(re.sub("[^0-9A-F]", "F", digit), 16)


_DIGIT = np.array([_digit(c) for c in range(128)], np.uint8)
_CODE = np.full(128, 255, np.uint8)
_CODE[np.frombuffer(S.CIGAR_OPS.encode(), np.uint8)] = np.arange(len(S.CIGAR_OPS))


def _encode_columns(rows: pa.RecordBatch) -> pa.Array:
    n, there = rows.num_rows, set(rows.schema.names)
    get = lambda c, kind: rows.column(c) if c in there else pa.nulls(n, kind)
    name = get("read_name", pa.string())
    names, name_sizes = _flat(pc.if_else(pc.equal(pc.binary_length(name), 0), "*", name).fill_null("*"))
    if (name_sizes > 254).any():
        raise _Odd
    bases, l_seq = _flat(get("seq", pa.string()))
    n_cigar, (op, length) = _items(get("cigar", KINDS["cigar"]), ("op", "len"))
    ops, op_sizes = _flat(op)
    if (op_sizes != 1).any() or (_CODE[ops] == 255).any() or (n_cigar > 0xFFFF).any():
        raise _Odd
    codes = (_numbers(length, 0, 0x0FFFFFFF) << 4 | _CODE[ops]).astype("<u4")
    given = get("tags_raw", pa.binary())
    if given.null_count == n:
        tags, tag_sizes = _encode_tags(get("tags", KINDS["tags"]))
    elif given.null_count:
        raise _Odd
    else:
        tags, tag_sizes = _flat(given, ascii_only=False)
    qual = get("qual", pa.binary())
    quals, qual_sizes = _flat(qual, ascii_only=False)
    some = qual.is_valid().to_numpy(zero_copy_only=False)
    l_qual = np.where(some, qual_sizes, l_seq)

    half = (l_seq + 1) // 2
    cigar_at = 36 + name_sizes + 1
    seq_at = cigar_at + 4 * n_cigar
    qual_at = seq_at + half
    tags_at = qual_at + l_qual
    sizes = tags_at + tag_sizes
    if len(sizes) and sizes.max() > 0xFFFFFFFF:
        raise _Odd
    ends = np.concatenate([[0], np.cumsum(sizes)])
    at = ends[:-1]
    head = np.zeros(n, np.dtype([("size", "<u4"), *HEAD.descr]))
    head["size"], head["l_name"], head["n_cigar"], head["l_seq"] = sizes - 4, name_sizes + 1, n_cigar, l_seq
    for c, low, high in (("mapq", 0, 0xFF), ("bin", 0, 0xFFFF), ("flag", 0, 0xFFFF), *((c, -(1 << 31), (1 << 31) - 1) for c in ("ref_id", "pos", "next_ref_id", "next_pos", "tlen"))):
        head[c] = _numbers(rows.column(c), low, high)
    buf = np.full(ends[-1], 255, np.uint8)  # what no quality is put over stays 255
    buf[at[:, None] + np.arange(36)] = head.view(np.uint8).reshape(n, 36)
    _place(buf, at + 36, names, name_sizes)
    buf[at + cigar_at - 1] = 0
    _place(buf, at + cigar_at, codes.view(np.uint8), 4 * n_cigar)
    digits = np.zeros(2 * half.sum(), np.uint8)
    _place(digits, 2 * (np.cumsum(half) - half), _DIGIT[bases], l_seq)
    _place(buf, at + seq_at, digits[0::2] << 4 | digits[1::2], half)
    _place(buf, (at + qual_at)[some], quals, qual_sizes[some])
    _place(buf, at + tags_at, tags, tag_sizes)
    return _binary(buf, ends)


class _Inflated(io.RawIOBase):
    """The inflated bytes from a block on; ``block_of`` tells where the block of the last byte read begins."""

    def __init__(self, file, start: int = 0):
        self.file, self.next, self.held, self.at, self.block = file, start, b"", 0, start

    def readable(self) -> bool:
        return True

    def fill(self) -> bool:
        while self.at >= len(self.held):
            self.file.seek(self.next)
            head = self.file.read(18)
            if not head:
                return False
            size = bgzf.block_size(head)
            block = head + self.file.read(size - 18)
            if len(block) < size:
                raise ValueError(f"truncated block at {self.next}")
            self.block, self.next, self.held, self.at = self.next, self.next + size, bgzf.inflate(block), 0
        return True

    def take(self, n: int) -> bytes:
        parts = []
        while n and self.fill():
            part = self.held[self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            parts.append(part)
        return b"".join(parts)


def read_header(uri: str) -> tuple[str, list[tuple[str, int]], tuple[int, int]]:
    """Header text, references, and block offset and place of the first record."""
    system, path = resolve(uri)
    with system.open_input_file(path) as file:
        data = _Inflated(file)
        if data.take(4) != MAGIC:
            raise ValueError(f"{uri}: not a BAM file")
        number = lambda: struct.unpack("<I", data.take(4))[0]
        text = data.take(number()).rstrip(b"\0").decode()
        refs = []
        for _ in range(number()):
            name = data.take(number())[:-1].decode()
            refs.append((name, number()))
        if data.at >= len(data.held):
            data.fill()
        return text, refs, (data.block, data.at)


# --- data source -------------------------------------------------------------


@dataclass
class Run:
    path: str
    split: int
    low: int
    high: int
    first: int  # place of the first record in block ``low``; -1: to be found
    n_refs: int


@dataclass
class Runs(InputPartition):
    """The runs of one task."""

    runs: list[Run]

    def __post_init__(self) -> None:
        super().__init__((self.runs[0].path, self.runs[0].split))


class BamSource(DataSource):
    """Options: path (a file), split_bytes, fields (comma-separated columns to decode; the others are null and their bytes aren't looked at)."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SOURCE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BamReader(dict(self.options))


def _plausible(data: bytes, at: int, n_refs: int) -> bool | None:
    """Whether a record may begin here; none if the bytes at hand don't tell."""
    for _ in range(CHECKED):
        if at + 36 > len(data):
            return None
        size, ref_id, pos, l_name, _, _, n_cigar, _, l_seq, next_ref, next_pos, _ = struct.unpack_from("<IiiBBHHHIiii", data, at)
        least = 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq
        if not (-1 <= ref_id < n_refs and -1 <= next_ref < n_refs and pos >= -1 and next_pos >= -1 and l_name and least <= size < 1 << 28):
            return False
        end = at + 36 + l_name
        if end > len(data):
            return None
        if data[end - 1] != 0 or 0 in data[at + 36 : end - 1]:
            return False
        at += 4 + size
        if at == len(data):
            return None
    return True


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split_bytes", SPLIT))
        self.fields = set(filter(None, options.get("fields", "").split(","))) or set(KINDS)
        if unknown := self.fields - set(KINDS):
            raise ValueError(f"no such fields: {sorted(unknown)}")

    def partitions(self) -> list[Runs]:
        """Runs of about ``split_bytes``; only the header and one block border a run are read.

        A task has several short runs of a long file, one after the other, so
        that there are about ``TASKS`` tasks, or more of ``SPLIT`` bytes each.
        """
        _, refs, (block, first) = read_header(self.path)
        system, path = resolve(self.path)
        size = system.get_file_info(path).size
        edges = [block]
        with system.open_input_file(path) as file:
            for wish in range(block + self.split, size, self.split):
                if wish > edges[-1] and (edge := self._edge(file, wish, size)) is not None and edge > edges[-1]:
                    edges.append(edge)
        edges.append(size)
        runs = [Run(path, k, a, b, first if k == 0 else -1, len(refs)) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
        a_task, tasks = max(self.split, min(SPLIT, size // TASKS)), []
        for run in runs:
            if not tasks or run.high - tasks[-1][0].low > a_task:
                tasks.append([])
            tasks[-1].append(run)
        return [Runs(x) for x in tasks]

    @staticmethod
    def _edge(file, wish: int, size: int) -> int | None:
        """The first block border at or behind ``wish``: a block's beginning that another block follows."""
        file.seek(wish)
        window = file.read(min(size - wish, 1 << 17))
        at = window.find(b"\x1f\x8b\x08\x04")
        while at >= 0:
            try:
                after = at + bgzf.block_size(window[at : at + 18])
                if wish + after == size or window[after : after + 4] == b"\x1f\x8b\x08\x04":
                    return wish + at
            except ValueError:
                pass
            at = window.find(b"\x1f\x8b\x08\x04", at + 1)
        return None

    def read(self, partition: Runs) -> Iterator[pa.RecordBatch]:
        for run in partition.runs:
            yield from self._read(run)

    def _read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        system, _ = resolve(self.path)
        bodies: list[bytes] = []
        place = 0
        with system.open_input_file(partition.path) as file:
            data = _Inflated(file, partition.low)
            if data.fill():
                data.take(partition.first if partition.first >= 0 else self._first(file, partition))
                while data.fill() and data.block < partition.high:
                    held, at = data.held, data.at
                    while at + 4 <= len(held) and (end := at + 4 + int.from_bytes(held[at : at + 4], "little")) <= len(held):
                        bodies.append(held[at + 4 : end])
                        at = end
                    data.at = at
                    if at < len(held):  # a record that goes on in the next block
                        head = data.take(4)
                        body = data.take(struct.unpack("<I", head)[0]) if len(head) == 4 else b""
                        if len(head) < 4 or len(body) < struct.unpack("<I", head)[0]:
                            raise ValueError(f"truncated record in {partition.path}")
                        bodies.append(body)
                    if len(bodies) >= 4096:
                        yield self._batch(bodies, partition, place)
                        place += len(bodies)
                        bodies = []
        if bodies:
            yield self._batch(bodies, partition, place)

    @staticmethod
    def _first(file, partition: Run) -> int:
        """Place in the run's first block where a record begins (or the end of the inflated bytes, if none does before the run ends)."""
        probe, data, block_ends = _Inflated(file, partition.low), b"", 0
        while True:
            more = probe.fill()
            if more:
                data += probe.held
                probe.at = len(probe.held)
            for at in range(block_ends, len(data)):
                ok = _plausible(data, at, partition.n_refs)
                if ok or (ok is None and not more):
                    return at
                if ok is None:
                    break
                block_ends = at + 1
            if not more:
                return len(data)

    def _batch(self, bodies: list[bytes], partition: Run, place: int) -> pa.RecordBatch:
        n, found = len(bodies), decode_records(bodies, self.fields)
        columns = {"path": pa.array([partition.path] * n), "split": pa.array([partition.split] * n, pa.int32()), "place": pa.array(np.arange(place, place + n))}
        columns |= {c: found[c] if c in found else pa.nulls(n, kind) for c, kind in KINDS.items()}
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def read_bam(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The canonical relation of a file. Ordinals are file order: records before a run (one count a run) plus the place within it."""
    spark.dataSource.register(BamSource)
    rows = spark.read.format("bam").options(**options).load(path)
    counts = spark.read.format("bam").options(**options | {"fields": "flag"}).load(path).groupBy("split").count()  # a scan that decodes next to nothing
    before = F.sum("count").over(Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("split", F.coalesce(before, F.lit(0)).alias("before"))
    names = [f.strip().split(" ")[0] for f in re.split(r",(?![^<]*>)", S.ALIGNMENTS)]
    return rows.join(F.broadcast(offsets), "split").withColumn("ordinal", F.col("place") + F.col("before")).select(*names)


def ref_seqs(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame([(i, n, length) for i, (n, length) in enumerate(read_header(path)[1])], S.REF_SEQS)


def header_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame([(read_header(path)[0],)], "header_text string")


def write_bam(rows: DataFrame, path: str, header: str, refs: list[tuple[str, int]], order: str = "ordinal", level: int = 6) -> None:
    """One file with the full header, records in the given order. All tasks encode and deflate at once, each into a file; the writer only joins these."""
    head = bgzf.compress(encode_header(header, refs), level)[: -len(bgzf.END_BLOCK)]
    concatenate(rows.repartitionByRange(order).sortWithinPartitions(order), _deflate(level), path, head, bgzf.END_BLOCK)


def _deflate(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for _, records in encode_records(batch):
                yield bgzf.compress(records.buffers()[2].to_pybytes(), level)[: -len(bgzf.END_BLOCK)]

    return run


def encoded(rows: DataFrame, order: str = "ordinal") -> DataFrame:
    """The order's column and each row's record as bytes, its length first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, records in encode_records(batch):
                yield pa.RecordBatch.from_arrays([part.column(order), records], names=[order, "record"])

    return rows.mapInArrow(run, f"{order} long, record binary")


def view_bytes(rows: DataFrame, header: str, refs: list[tuple[str, int]], order: str = "ordinal") -> Iterator[bytes]:
    """The uncompressed file, piece by piece: header, then records in the given order. Tasks encode."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for _, records in encode_records(batch):
                yield records.buffers()[2].to_pybytes()

    yield encode_header(header, refs)
    with pieces(rows.repartitionByRange(order).sortWithinPartitions(order), run) as parts:
        yield from parts


def uncompressed_size(spark: SparkSession, path: str) -> DataFrame:
    """path, uncompressed_bytes: the blocks' own sizes summed, nothing inflated."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("path").to_pylist()
            totals = []
            for name in names:
                system, at = resolve(name)
                with system.open_input_file(at) as file:
                    totals.append(bgzf.uncompressed_size(file))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(totals, pa.int64())], names=["path", "uncompressed_bytes"])

    files = spark.read.format("binaryFile").load(path).select("path")
    return files.mapInArrow(sizes, "path string, uncompressed_bytes long")
