"""Operator 4: media columns in archives, behind a Spark data source.

``format("media_archive")`` writes one lossless 8-bit grey PNG per row into ZIP
archives (members stored, not deflated twice) and reads them back. The reader
plans byte ranges over the archives of a folder; a range holds the members
whose local header begins in it, found through the archive's directory. Each
member is read, checked and, on failure, retried on its own by its offset, and
payload batches travel as Arrow.
"""

from __future__ import annotations

import binascii
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .files import resolve
from .scratch import Scratch

WIDTH = 576
PAD = b"\xff"  # never part of UTF-8
PNG = b"\x89PNG\r\n\x1a\n"
MANIFEST = "_archives"
SCHEMA = "archive string, offset long, name string, stored binary, error string"
BATCH = 4 << 20


def pad(text: bytes) -> bytes:
    """``text`` and bytes 255 up to a positive multiple of 576."""
    return text + PAD * ((-len(text)) % WIDTH or (0 if text else WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, level: int = 4) -> bytes:
    """A grey 8-bit PNG of 576 columns whose samples are ``payload``, row by row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """The samples of ``encode_png``; every chunk's checksum is verified."""
    if media[:8] != PNG:
        raise ValueError("not a PNG")
    at, data, shape = 8, [], None
    while at < len(media):
        (size,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + size]
        if struct.pack(">I", zlib.crc32(kind + body)) != media[at + 8 + size : at + 12 + size]:
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    if shape is None or shape[0] != WIDTH or shape[2:4] != (8, 0):
        raise ValueError("not a grey 8-bit image of this width")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:].tobytes()


@dataclass
class Archives(WriterCommitMessage):
    found: list


@dataclass
class ByteRange(InputPartition):
    path: str
    low: int
    high: int

    def __post_init__(self) -> None:
        super().__init__((self.path, self.low, self.high))


class ArchiveSource(DataSource):
    """Options: path; archive_bytes (of an archive, about), split_bytes (of a partition), attempts (for a member), strict (false: a member that stays unreadable becomes a row with ``error``)."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ArchiveWriter(dict(self.options), overwrite)


class ArchiveWriter(DataSourceArrowWriter):
    """Rows (doc_id long, text string) to archives. Each job lists its archives in a manifest of its own once all its tasks' messages are in, so lost or repeated tasks leave nothing visible; jobs that append add up."""

    def __init__(self, options: dict, overwrite: bool = False):
        self.overwrite = overwrite
        self.path, self.most = options["path"].rstrip("/"), int(options.get("archive_bytes", 128 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Archives:
        found, out, archive, name, members = [], None, None, "", 0
        system, root = resolve(self.path)
        system.create_dir(root, recursive=True)

        def close() -> None:
            archive.close()
            found.append([name, out.tell(), members])
            out.close()

        for batch in iterator:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                if archive is None:
                    name, members = f"part-{uuid.uuid4().hex}.zip", 0
                    out = system.open_output_stream(f"{root}/{name}")
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
                raw = text.as_py() or ""
                archive.writestr(f"{members:08d}/{doc_id.as_py()}.png", encode_png(pad(raw.encode())))
                members += 1
                if out.tell() >= self.most:
                    close()
                    archive = None
        if archive is not None:
            close()
        return Archives(found)

    def commit(self, messages: list) -> None:
        found = sorted(x for m in messages if m is not None for x in m.found)
        system, root = resolve(self.path)
        system.create_dir(root, recursive=True)
        if self.overwrite:  # only now, so that a failed job loses nothing
            kept = {x[0] for x in found}
            for info in system.get_file_info(fs.FileSelector(root)):
                if info.base_name not in kept and info.base_name.startswith((MANIFEST, "part-")):
                    system.delete_file(info.path)
        with system.open_output_stream(f"{root}/{MANIFEST}-{uuid.uuid4().hex}") as out:
            out.write(json.dumps(found).encode())

    def abort(self, messages: list) -> None:
        system, root = resolve(self.path)
        for m in messages:
            for name, *_ in m.found if m is not None else []:
                system.delete_file(f"{root}/{name}")


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.split, self.attempts = int(options.get("split_bytes", 8 << 20)), int(options.get("attempts", 3))
        self.strict = options.get("strict", "true").lower() != "false"

    def partitions(self) -> list[ByteRange]:
        system, root = resolve(self.path)
        manifests = sorted(x.path for x in system.get_file_info(fs.FileSelector(root)) if x.base_name.startswith(MANIFEST))
        if not manifests:
            raise FileNotFoundError(f"no manifest in {self.path}")
        found = []
        for path in manifests:
            with system.open_input_stream(path) as f:
                found += json.loads(f.read())
        ranges = [ByteRange(f"{root}/{name}", low, min(low + self.split, size)) for name, size, _ in found for low in range(0, size, self.split)]
        return ranges or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = resolve(self.path)
        schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("name", pa.string()), ("stored", pa.binary()), ("error", pa.string())])
        rows, held = [], 0
        with system.open_input_file(partition.path) as file:
            with zipfile.ZipFile(file) as archive:
                members = [m for m in archive.infolist() if partition.low <= m.header_offset < partition.high]
            for member in members:
                stored, error = self._member(system, partition.path, file, member)
                rows.append((partition.path, member.header_offset, member.filename, stored, error))
                held += len(stored or b"")
                if held >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    def _member(self, system, path: str, file, member: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
        """One member by its offset; each further attempt opens the archive anew."""
        for attempt in range(self.attempts):
            again = None
            try:
                source = file if attempt == 0 else (again := system.open_input_file(path))
                source.seek(member.header_offset)
                head = source.read(30)
                if head[:4] != b"PK\x03\x04":
                    raise ValueError(f"no member at {member.header_offset}")
                source.seek(member.header_offset + 30 + sum(struct.unpack("<HH", head[26:30])))
                stored = source.read(member.compress_size)
                if binascii.crc32(stored) != member.CRC:
                    raise ValueError(f"member at {member.header_offset} is damaged")
                return stored, None
            except (OSError, ValueError) as error:
                failure = error
            finally:
                if again is not None:
                    again.close()
        if self.strict:
            raise failure
        return None, str(failure)


def feature_of(payload: bytes) -> str:
    """Whole-number statistics of the samples: lines, sum, kinds, entropy in thousandths of a bit, digest of the histogram."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share = counts[counts > 0] / len(payload)
    entropy = int(round(float(-(share * np.log2(share)).sum()) * 1000))
    total = int((counts * np.arange(256)).sum())
    return f"lines={len(payload) // WIDTH};sum={total};kinds={len(share)};entropy={entropy};histogram={zlib.crc32(counts.astype('<i8').tobytes()):08x}"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    for batch in batches:
        rows = []
        for name, stored in zip(batch.column("name"), batch.column("stored")):
            media, of = stored.as_py(), name.as_py().split("/")[1].removesuffix(".png")
            payload = decode_png(media)
            rows.append((None if of == "None" else int(of), len(payload.rstrip(PAD)), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds])


def write_media(documents: DataFrame, path: str, mode: str = "append", **options: str) -> None:
    """Archive the texts of ``documents`` (doc_id, text; null text: empty; null doc_id stays null; repeated rows are members of their own; other columns are ignored). Runs at once."""
    documents.sparkSession.dataSource.register(ArchiveSource)
    documents.select(documents["doc_id"].cast("long").alias("doc_id"), "text").write.format("media_archive").mode(mode).options(**options).save(path)


def read_media(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """All members of the archives in a folder; an empty table's folder reads as no rows."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").options(**options).load(path)


def describe_media(media: DataFrame) -> DataFrame:
    """Digests and features of decoded members, one row each; repeated members give repeated rows, a null doc_id stays null, an empty text is one line of padding. A damaged member that was read without ``strict`` raises here; filter on ``error`` first."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("name", "stored").mapInArrow(_describe, schema)


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "media").path("archives")
    write_media(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return describe_media(read_media(spark, path))
