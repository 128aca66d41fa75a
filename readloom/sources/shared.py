"""Files and folders that the driver and all executors see."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

CHUNK = 4 << 20  # bytes of a piece held at once


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's filesystem and the path of a URI, or of a bare path."""
    uri = re.sub(r"^file:/+", "file:///", uri)
    return fs.FileSystem.from_uri(uri) if re.match(r"^\w[\w+.-]*://", uri) else (fs.LocalFileSystem(), uri)


def new_folder(spark: SparkSession, tag: str) -> str:
    """A folder of its own under spark.checkpoint.dir; where that is unset and all runs in one process, a temporary one."""
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="readloom-")
    folder = f"{root.rstrip('/')}/readloom-{tag}-{uuid.uuid4().hex[:12]}"
    system, path = resolve(folder)
    system.create_dir(path, recursive=True)
    return folder


@contextmanager
def pieces(rows: DataFrame, encode: Callable[[Iterator[pa.RecordBatch]], Iterator[bytes]]) -> Iterator[Iterator[bytes]]:
    """The bytes that ``encode`` makes of each partition, in the order of the partitions and of the rows within.

    One job: all tasks encode at once and write a file each in the shared
    folder. The driver gets one row a task and then reads ``CHUNK`` bytes at a
    time; a file goes as soon as it is read, the rest at the end.
    """
    folder = new_folder(rows.sparkSession, "pieces")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{folder}/{task.partitionId():08d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"  # attempts don't meet
        system, at = resolve(name)
        with system.open_output_stream(at, compression=None) as out:
            for piece in encode(batches):
                out.write(piece)
        yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([name])], names=["part", "name"])

    def read(names: list[str]) -> Iterator[bytes]:
        for name in names:
            system, at = resolve(name)
            with system.open_input_stream(at, compression=None) as file:
                while chunk := file.read(CHUNK):
                    yield chunk
            system.delete_file(at)

    try:
        done = rows.mapInArrow(write, "part int, name string").collect()
        yield read([r["name"] for r in sorted(done, key=lambda r: r["part"])])
    finally:
        system, at = resolve(folder)
        system.delete_dir(at)


def concatenate(rows: DataFrame, encode: Callable[[Iterator[pa.RecordBatch]], Iterator[bytes]], path: str, head: bytes = b"", tail: bytes = b"") -> None:
    """One file of the ``pieces`` of ``rows``, between ``head`` and ``tail``."""
    system, target = resolve(path)
    with pieces(rows, encode) as parts, system.open_output_stream(target, compression=None) as out:
        out.write(head)
        for part in parts:
            out.write(part)
        out.write(tail)
