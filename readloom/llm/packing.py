"""Operator 5: best-fit packing by bin completion.

Only how many pieces there are of each length matters for a packing, and there
are at most ``capacity`` lengths, so the plan is made from a histogram whose
size does not depend on the data. The planner starts from best-fit decreasing
as incumbent, then completes bins around the largest open piece: it enumerates
fillings of the room left that no other filling dominates, and drops branches
whose waste already rules out fewer sequences than the incumbent has. The plan
is a list of patterns with multiplicities; every piece then finds its sequence
by its rank among the pieces of its length, without a sort over all pieces.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytescan import row_groups, text_buffer
from .scratch import Scratch
from .tokens import tokenizer

CAPACITY = 4096
NODES = 2000  # completions looked at by one search after its first descent, or as many as there are lengths
FILLINGS = 24  # alternatives kept at one node
Pattern = tuple[tuple[int, ...], int]  # lengths in a sequence, number of such sequences


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences: total length, and pieces over half with what can't join them."""
    best = -(-sum(k * n for k, n in counts.items()) // capacity)
    large = sum(n for k, n in counts.items() if 2 * k > capacity)
    best = max(best, large)
    sizes = sorted(counts)
    for a in [k for k in sizes if 2 * k <= capacity][:512]:
        over = [(k, n) for k, n in counts.items() if k > capacity - a]
        half = [(k, n) for k, n in counts.items() if capacity - a >= k > capacity / 2]
        rest = sum(k * n for k, n in counts.items() if a <= k <= capacity / 2)
        room = sum(n for _, n in half) * capacity - sum(k * n for k, n in half)
        best = max(best, sum(n for _, n in over) + sum(n for _, n in half) + max(0, -(-(rest - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over a histogram; equal open sequences are handled together."""
    open_at: dict[int, list[list]] = {}
    rooms = np.zeros(capacity + 1, bool)
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            fits = np.flatnonzero(rooms[size:])
            if len(fits):
                room = size + int(fits[0])
                group = open_at[room].pop()
                if not open_at[room]:
                    rooms[room] = False
                items, n = group
            else:
                room, items, n = capacity, (), -(-left // (capacity // size))
            each = room // size
            whole = min(n, left // each)
            split = [(each, whole)]
            if whole < n:
                split += [(left - whole * each, 1), (0, n - whole - 1)]
            for took, times in split:
                if times and (took or items):
                    now = room - took * size
                    open_at.setdefault(now, []).append([items + (size,) * took, times])
                    rooms[now] = now > 0
            left -= min(left, n * each)
    return [(items, n) for groups in open_at.values() for items, n in groups]


def dominated(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the pieces of ``a`` can be put inside pieces of ``b`` (then ``b`` is never the worse choice)."""
    room = list(b)

    def put(i: int) -> bool:
        if i == len(a):
            return True
        tried = set()
        for j, r in enumerate(room):
            if r >= a[i] and r not in tried:
                tried.add(r)
                room[j] -= a[i]
                if put(i + 1):
                    return True
                room[j] += a[i]
        return False

    return len(a) <= 12 and len(b) <= 12 and put(0)


def fillings(counts: dict[int, int], sizes: np.ndarray, room: int, most: int = FILLINGS) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room`` with pieces on hand, least waste first; at most ``most``."""
    if counts.get(room, 0):
        return [(room,)]
    found: list[tuple[int, ...]] = []
    usable = sizes[: np.searchsorted(sizes, room, "right")]
    usable = usable[::-1]
    have = np.zeros(room + 1, bool)
    have[usable] = True
    exact = usable[have[room - usable]]
    for a in exact[exact >= room - exact][:most].tolist():
        if a * 2 != room or counts[a] > 1:
            found.append((a, room - a))
    steps = 0

    def extend(chosen: tuple[int, ...], left: int, at: int) -> None:
        nonlocal steps
        steps += 1
        grown = False
        for i in range(at + int(np.searchsorted(-usable[at:], -left, "left")), len(usable)):
            size = int(usable[i])
            if size <= left and counts[size] > chosen.count(size):
                grown = True
                extend((*chosen, size), left - size, i)
                if len(found) >= 4 * most or steps > 40 * most:
                    return
        if not grown and chosen:
            found.append(chosen)

    if len(found) < most:
        extend((), room, 0)
    found = list(dict.fromkeys(found)) or [()]
    kept = []
    for x in sorted(found, key=lambda f: (room - sum(f), len(f))):
        if not any(dominated(x, y) for y in kept):
            kept.append(x)
        if len(kept) >= most:
            break
    return kept


@dataclass
class Search:
    """Depth-first search over completions, on one array of counts that steps take from and give back to."""

    capacity: int
    bound: int
    best: list[Pattern]
    used: int
    nodes: int = NODES

    def run(self, counts: dict[int, int]) -> None:
        left = np.zeros(self.capacity + 1, np.int64)
        left[list(counts)] = list(counts.values())
        total, used, plan = sum(k * n for k, n in counts.items()), 0, []
        descended = False
        open_choices = [self._choices(left)]
        while open_choices and self.used > self.bound and self.nodes > 0:
            step = next(open_choices[-1], None)
            if step is None:
                open_choices.pop()
                if plan:
                    items, times = plan.pop()
                    np.add.at(left, list(items), times)
                    total, used = total + sum(items) * times, used - times
                continue
            items, times = step
            self.nodes -= descended  # the first descent is not counted
            np.subtract.at(left, list(items), times)
            total, used = total - sum(items) * times, used + times
            plan.append(step)
            if not total and used < self.used:
                self.best, self.used = list(plan), used
            gain = total and used + -(-total // self.capacity) < self.used  # else waste so far leaves nothing to gain
            descended |= not gain
            open_choices.append(self._choices(left) if gain else iter(()))

    def _choices(self, left: np.ndarray) -> Iterator[Pattern]:
        """Ways to close a sequence around the longest open piece: as often as they go, then once."""
        top = int(np.flatnonzero(left)[-1])
        left[top] -= 1
        counts = {int(k): int(left[k]) for k in np.flatnonzero(left)}
        left[top] += 1
        for filling in fillings(counts, np.array(sorted(counts), np.int64), self.capacity - top):
            items = (top, *filling)
            whole = min(int(left[k]) // n for k, n in Counter(items).items())
            for times in dict.fromkeys((whole, 1)):
                yield items, times


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[Pattern]:
    """Patterns that use up ``counts`` (length -> number, 1 <= length <= capacity)."""
    counts = {int(k): int(n) for k, n in counts.items() if n}
    if not counts:
        return []
    start = best_fit(counts, capacity)
    search = Search(capacity, lower_bound(counts, capacity), start, sum(n for _, n in start), max(nodes, len(counts)))
    search.run(counts)
    return search.best


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def _pieces(path: str, keep_space: bool, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = tokenizer(path, keep_space), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for rows in row_groups(batch, "text"):
                ids, ends = coder.encode(*text_buffer(rows.column("text")))
                n = np.diff(ends) + 1
                flat = np.insert(ids, ends[1:], end_id).astype("<u4")
                first = np.cumsum(n) - n
                parts = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), parts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = piece * capacity
                length = np.minimum(n[row] - start, capacity)
                data, at = flat.tobytes(), (first[row] + start) * 4
                crc = [zlib.crc32(data[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist())]
                order = np.argsort(length, kind="stable")
                kinds, begins, sizes = np.unique(length[order], return_index=True, return_counts=True)
                rank = np.empty(len(row), np.int64)
                rank[order] = np.arange(len(row)) - np.repeat(begins, sizes) + np.repeat(seen[kinds], sizes)
                seen[kinds] += sizes
                columns = [rows.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(row), part, np.int32)), pa.array(rank)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return run


def slots_of(plan: list[Pattern], capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Length -> first rank, first sequence and offset of each slot, by rank. At most ``capacity`` lengths."""
    slots: dict[int, list] = {}
    base = 0
    for items, times in plan:
        offset = 0
        for size in items:
            slots.setdefault(size, []).append((times, base, offset))
            offset += size
        base += times
    out = {}
    for size, rows in slots.items():
        times, bases, offsets = (np.array(x, np.int64) for x in zip(*rows))
        out[size] = (np.cumsum(times) - times, bases, offsets)
    return out


def _place(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length).tolist():
                rows = np.flatnonzero(length == size)
                first, bases, offsets = slots[size]
                at = np.searchsorted(first, rank[rows], "right") - 1
                sequence[rows], offset[rows] = bases[at] + rank[rows] - first[at], offsets[at]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def pack(documents: DataFrame, path: str, end_id: int, keep_space: bool = False, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``documents`` has doc_id and text; other columns are ignored. A null or
    empty text is its end id alone. A document of more than ``capacity`` tokens
    is cut into pieces of that many and a rest. Rows with equal or null doc_id
    are documents of their own; an empty table gives no rows. The driver sees
    one count per length, never a document.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "packing")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = scratch.table(rows.mapInArrow(_pieces(path, keep_space, end_id, capacity), PIECES), "pieces")
    per_part = pieces.groupBy("part", "length").count()
    counts = {x["length"]: x["n"] for x in per_part.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(slots_of(plan_bins(counts, capacity, nodes), capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_part.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInArrow(_place(shared), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
