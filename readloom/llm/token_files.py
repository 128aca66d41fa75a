"""Operator 3: token ids in Arrow stream files of fixed-size lists.

A shard is two Arrow stream files. ``*.tokens.arrows`` has the shard's ids in
equal-length sequences, one after another over document borders: ``ids`` is a
fixed-size list of unsigned integers, ``mask`` one of bytes whose bits (least
significant first) say which places are filled. All its record batches but the
last have the same number of sequences and therefore the same size in bytes,
so the place of any sequence is known without reading the others.
``*.documents.arrows`` has each document's id, its start within the shard and
its number of ids. Shards follow one another in ascending document order; the
ids before a shard are those of the shards before it.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytescan import row_groups, text_buffer
from .files import resolve
from .scratch import Scratch
from .tokens import tokenizer

SEQUENCE = 2048
BATCH_SEQUENCES = 256
SHARDS = "shard int, tokens string, documents string, n_docs long, n_tokens long"


def token_schema(dtype: pa.DataType, length: int = SEQUENCE) -> pa.Schema:
    return pa.schema([("ids", pa.list_(dtype, length)), ("mask", pa.list_(pa.uint8(), length // 8))])


DOC_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class SequenceWriter:
    """Takes ids in any portions and writes whole batches of sequences."""

    def __init__(self, sink, dtype: np.dtype, length: int = SEQUENCE, per_batch: int = BATCH_SEQUENCES):
        self.dtype, self.length, self.size = dtype, length, length * per_batch
        self.schema = token_schema(pa.from_numpy_dtype(dtype), length)
        self.out, self.held, self.n = pa.ipc.new_stream(sink, self.schema), [], 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.dtype))
        self.n += len(ids)
        if self.n >= self.size:
            flat = np.concatenate(self.held)
            cut = len(flat) // self.size * self.size
            for i in range(0, cut, self.size):
                self._put(flat[i : i + self.size])
            self.held, self.n = [flat[cut:]], len(flat) - cut

    def _put(self, flat: np.ndarray) -> None:
        rows = -(-len(flat) // self.length)
        ids, mask = np.zeros(rows * self.length, self.dtype), np.zeros(rows * self.length, bool)
        ids[: len(flat)], mask[: len(flat)] = flat, True
        bits = np.packbits(mask, bitorder="little")
        self.out.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip((ids, bits), self.schema)], schema=self.schema))

    def close(self) -> None:
        if self.n:
            self._put(np.concatenate(self.held))
        self.out.close()


class SequenceFile:
    """Random access to a token file by sequence number; arrays are views of the mapped file."""

    def __init__(self, path: str, length: int = SEQUENCE):
        self.map, self.length = pa.memory_map(path), length
        schema = pa.ipc.read_message(self.map)
        self.schema, self.first = pa.ipc.read_schema(schema), self.map.tell()
        self.rows = 0
        if (batch := self._at(self.first)) is not None:
            self.rows, self.step = batch.num_rows, self.map.tell() - self.first

    def _at(self, place: int) -> pa.RecordBatch | None:
        if place >= self.map.size():
            return None
        self.map.seek(place)
        try:
            return pa.ipc.read_record_batch(pa.ipc.read_message(self.map), self.schema)
        except EOFError:
            return None

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask bytes of sequence ``i``."""
        batch = self._at(self.first + i // self.rows * self.step) if self.rows and i >= 0 else None
        if batch is None or i % self.rows >= batch.num_rows:
            raise IndexError(i)
        j, take = i % self.rows, []
        for column in batch.columns:
            width = column.type.list_size
            take.append(column.values.slice((column.offset + j) * width, width).to_numpy())
        return take[0], take[1]


def _write_shard(root: str, path: str, keep_space: bool, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path, keep_space)
        dtype = np.dtype(np.uint16 if max(end_id, coder.tokenizer.get_vocab_size() - 1) < 1 << 16 else np.uint32)
        shard, upto, docs = TaskContext.get().partitionId(), 0, 0
        system, at = resolve(root)
        name = f"{at}/shard-{shard:06d}-{uuid.uuid4().hex[:8]}"
        tokens = out = index = None
        for batch in batches:
            for rows in row_groups(batch, "text"):
                if tokens is None:
                    system.create_dir(at, recursive=True)
                    tokens, documents = (system.open_output_stream(f"{name}.{x}.arrows") for x in ("tokens", "documents"))
                    out, index = SequenceWriter(tokens, dtype), pa.ipc.new_stream(documents, DOC_SCHEMA)
                ids, ends = coder.encode(*text_buffer(rows.column("text")))
                n = np.diff(ends) + 1
                flat = np.insert(ids, ends[1:], end_id)
                starts = upto + np.cumsum(n) - n
                index.write_batch(pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(starts), pa.array(n)], schema=DOC_SCHEMA))
                out.add(flat)
                upto, docs = upto + len(flat), docs + len(n)
        if tokens is not None:
            for x in (out, index, tokens, documents):
                x.close()
            cells = [shard, f"{name}.tokens.arrows", f"{name}.documents.arrows", docs, upto]
            kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], names=["shard", "tokens", "documents", "n_docs", "n_tokens"])

    return run


def write_tokens(documents: DataFrame, root: str, path: str, end_id: int, keep_space: bool = True) -> DataFrame:
    """Write shards under ``root`` in ascending doc_id; return them, each with the ids before it. Runs at once.

    ``documents`` has doc_id and text; other columns are ignored. A null text
    is empty and has only its end id. Null doc_ids come first; rows with equal
    doc_id are documents of their own, in the order they are read. An empty
    table gives no shards. Only shards of tasks that succeeded are listed, so
    files of lost tasks are never read. The driver sees one row per shard.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("place"))
    rows = rows.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place").select("doc_id", "text")
    made = sorted(rows.mapInArrow(_write_shard(root, path, keep_space, end_id), SHARDS).collect())
    listed, before = [], 0
    for x in made:
        listed.append((*x, before))
        before += x["n_tokens"]
    return spark.createDataFrame(listed, SHARDS + ", before long")


def _read_shards(root: str, digest_only: bool):
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())] + [("ids_crc32", pa.int64()) if digest_only else ("ids", pa.list_(pa.int64()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = resolve(root)
        for batch in batches:
            for shard in batch.to_pylist():
                with system.open_input_file(shard["tokens"]) as a, system.open_input_file(shard["documents"]) as b:
                    portions = _portions(pa.ipc.open_stream(a))
                    held, low = np.zeros(0, np.uint32), 0
                    for docs in pa.ipc.open_stream(b):
                        last = []
                        for start, n in zip(docs.column("start").to_pylist(), docs.column("n_tokens").to_pylist()):
                            more = [held[start - low :]]
                            have = len(more[0])
                            while have < n:
                                more.append(next(portions))
                                have += len(more[-1])
                            held, low = np.concatenate(more) if len(more) > 1 else more[0], start
                            ids = held[:n]
                            last.append(zlib.crc32(ids.astype("<u4").tobytes()) if digest_only else ids.tolist())
                        columns = [docs.column("doc_id"), pa.array(docs.column("start").to_numpy() + shard["before"]), docs.column("n_tokens"), pa.array(last, kinds[3][1])]
                        yield pa.RecordBatch.from_arrays(columns, names=[k for k, _ in kinds])

    return run


def _portions(stream: pa.RecordBatchReader) -> Iterator[np.ndarray]:
    """The filled places of each batch."""
    for batch in stream:
        ids = batch.column("ids").flatten().to_numpy(zero_copy_only=False)
        filled = np.unpackbits(batch.column("mask").flatten().to_numpy(), bitorder="little").view(bool)
        yield ids[filled]


def read_documents(shards: DataFrame, root: str, digest_only: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids (or their crc32, as little-endian unsigned 32-bit integers) read from the files."""
    spread = shards.repartition(max(1, min(shards.count(), 4 * shards.sparkSession.sparkContext.defaultParallelism)))
    last = "ids_crc32 long" if digest_only else "ids array<long>"
    return spread.mapInArrow(_read_shards(root, digest_only), f"doc_id long, start long, n_tokens long, {last}")


def op3_token_stream_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    root = Scratch(spark, "tokens").path("shards")
    shards = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), root, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_documents(shards, root, digest_only=True)
