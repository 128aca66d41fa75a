"""Blocked gzip: locating, inflating and writing blocks."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

# Fixed values of the format: the empty block that ends a file, and a block's greatest payload.
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
MAX_PAYLOAD = 0xFF00


def block_size(head: bytes) -> int:
    """Whole size of the block whose first bytes these are (18 at least)."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        raise ValueError("not a BGZF block")
    (extra,) = struct.unpack_from("<H", head, 10)
    at = 12
    while at + 4 <= min(len(head), 12 + extra):
        kind, size = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if kind == b"BC" and size == 2:
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    raise ValueError("a gzip member without a block size")


def blocks(file: BinaryIO, start: int = 0) -> Iterator[tuple[int, int, int]]:
    """(offset, size, inflated size) of each block from ``start``; a cut-off block raises."""
    at = start
    while True:
        file.seek(at)
        head = file.read(18)
        if not head:
            return
        size = block_size(head)
        file.seek(at + size - 4)
        tail = file.read(4)
        if len(tail) < 4:
            raise ValueError(f"truncated block at {at}")
        yield at, size, struct.unpack("<I", tail)[0]
        at += size


def inflate(block: bytes) -> bytes:
    """Payload of one block; its checksum is verified."""
    (extra,) = struct.unpack_from("<H", block, 10)
    data = zlib.decompress(block[12 + extra : -8], wbits=-15)
    crc, size = struct.unpack("<II", block[-8:])
    if len(data) != size or zlib.crc32(data) != crc:
        raise ValueError("damaged block")
    return data


def deflate(payload: bytes, level: int = 6) -> bytes:
    """One block."""
    coder = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = coder.compress(payload) + coder.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(payload), len(payload))


def compress(data: bytes, level: int = 6) -> bytes:
    """A whole file, ended by the empty block."""
    return b"".join(deflate(data[i : i + MAX_PAYLOAD], level) for i in range(0, len(data), MAX_PAYLOAD)) + END_BLOCK


def uncompressed_size(file: BinaryIO) -> int:
    return sum(n for _, _, n in blocks(file))
