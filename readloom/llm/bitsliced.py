"""Operator 1: exact top-k search over a bit-sliced index.

Components are quantised to whole numbers. A block of rows is stored as
bitmaps: slice b of attribute d has the rows whose value has bit b set. A query
scores a whole block at once: the slices its own bits select are summed with
carry-save adders made of AND, OR and XOR over bitmaps, which leaves the score
itself bit-sliced. The best rows are then taken from the most significant slice
downward, and rows level with the last place are settled by id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

SCALE = 256.0
WIDEST = 2.0**61  # of a quantised component; a block's values and their differences then fit 64 bits
LONG = (-(1 << 63), (1 << 63) - 1)
BLOCK_ROWS = 8192
QUERY_ROWS = 256
INDEX_SCHEMA = "block long, dim int, bits int, low long, n int, ids binary, slices binary"
QUERY_SCHEMA = "dim int, n int, keys binary, ids binary, rows binary"


def quantise(ids: pa.Array, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Length of vector -> numbers of the rows in the batch, ids and floor(256 * x) of the rows that take part."""
    vectors = vectors.cast(pa.large_list(pa.float64()))
    ends = np.frombuffer(vectors.buffers()[1], np.int64, len(vectors) + 1, vectors.offset * 8)
    flat = vectors.flatten() if vectors.null_count == 0 else None
    parts: dict[int, tuple[list, list, list]] = {}
    known = ids.is_valid().to_numpy(zero_copy_only=False) & vectors.is_valid().to_numpy(zero_copy_only=False)
    keys = ids.fill_null(0).to_numpy(zero_copy_only=False)
    if flat is None:
        flat, ends = vectors.values, ends.copy()
    else:
        ends = ends - ends[0]
    present = flat.is_valid().to_numpy(zero_copy_only=False)
    plain = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        values = np.floor(SCALE * plain)
    fine, wide = present & np.isfinite(plain), np.abs(values) > WIDEST
    for i in np.flatnonzero(known).tolist():
        a, b = int(ends[i]), int(ends[i + 1])
        if b > a and fine[a:b].all():
            if wide[a:b].any():
                raise ValueError(f"vector {keys[i]} has a component beyond 2**53: its scores don't fit 64 bits")
            for part, x in zip(parts.setdefault(b - a, ([], [], [])), (i, keys[i], values[a:b])):
                part.append(x)
    return {d: (np.array(n), np.array(k, np.int64), np.array(v).astype(np.int64)) for d, (n, k, v) in parts.items()}


def slice_block(values: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Bits, least value and slices (attribute, bit, words of 64 rows) of rows x attributes."""
    low = int(values.min())
    shifted = (values - low).T
    bits = max(1, int(shifted.max()).bit_length())
    planes = np.zeros((shifted.shape[0], bits, -(-len(values) // 64) * 64), np.uint8)
    for b in range(bits):
        planes[:, b, : len(values)] = (shifted >> b) & 1
    return bits, low, np.packbits(planes, axis=2, bitorder="little").view(np.uint64)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}
    base, made = TaskContext.get().partitionId() << 32, 0

    def out(d: int, ids: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        nonlocal made
        order = np.argsort(ids, kind="stable")
        bits, low, slices = slice_block(values[order])
        made += 1
        cells = [base + made - 1, d, bits, low, len(ids), ids[order].tobytes(), slices.tobytes()]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], names=["block", "dim", "bits", "low", "n", "ids", "slices"])

    for batch in batches:
        for d, (_, ids, values) in quantise(batch.column("vec_id"), batch.column("embedding")).items():
            got = held.setdefault(d, [])
            got.append((ids, values))
            if sum(len(x[0]) for x in got) >= BLOCK_ROWS:
                ids, values = (np.concatenate(x) for x in zip(*got))
                cut = len(ids) // BLOCK_ROWS * BLOCK_ROWS
                for i in range(0, cut, BLOCK_ROWS):
                    yield out(d, ids[i : i + BLOCK_ROWS], values[i : i + BLOCK_ROWS])
                held[d] = [(ids[cut:], values[cut:])] if cut < len(ids) else []
    for d, got in held.items():
        if got:
            yield out(d, *(np.concatenate(x) for x in zip(*got)))


def _query_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column("key").to_numpy()
        for d, (rows, ids, values) in quantise(batch.column("vec_id"), batch.column("embedding")).items():
            for i in range(0, len(ids), QUERY_ROWS):
                part = slice(i, i + QUERY_ROWS)
                cells = [d, len(ids[part]), keys[rows[part]].tobytes(), ids[part].tobytes(), values[part].tobytes()]
                kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], names=["dim", "n", "keys", "ids", "rows"])


def add_slices(slices: np.ndarray, flipped: np.ndarray, query: np.ndarray) -> list[np.ndarray]:
    """Bitmaps of the sum of |q_d| * a_d, least significant first; a_d is complemented where q_d < 0."""
    size = np.abs(query)
    bits = slices.shape[1]
    todo: dict[int, list[np.ndarray]] = {}
    signs = query < 0
    for c in range(int(size.max()).bit_length()):
        chosen = (size >> c) & 1 == 1
        plain, turned = np.flatnonzero(chosen & ~signs), np.flatnonzero(chosen & signs)
        for b in range(bits):
            if len(plain):
                todo.setdefault(b + c, []).append(slices[plain, b])
            if len(turned):
                todo.setdefault(b + c, []).append(flipped[turned, b])
    out: list[np.ndarray] = []
    zero = np.zeros(slices.shape[2], np.uint64)
    w = 0
    while todo:
        rows = todo.pop(w, None)
        x = np.concatenate(rows) if rows else zero[None]
        while len(x) > 2:
            t = len(x) // 3
            a, b, c = x[:t], x[t : 2 * t], x[2 * t : 3 * t]
            either = a ^ b
            todo.setdefault(w + 1, []).append((a & b) | (c & either))
            x = np.concatenate([either ^ c, x[3 * t :]])
        if len(x) == 2:
            todo.setdefault(w + 1, []).append((x[0] & x[1])[None])
            out.append(x[0] ^ x[1])
        else:
            out.append(x[0])
        w += 1
    return out or [zero]


def select_top(score: list[np.ndarray], rows: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores among ``rows`` (a bitmap), equal scores by position."""
    need = min(k, int(np.bitwise_count(rows).sum()))
    sure, open_rows, have = np.zeros_like(rows), rows, 0
    for plane in reversed(score):
        high = open_rows & plane
        count = int(np.bitwise_count(high).sum())
        if have + count > need:
            open_rows = high
        else:
            sure, have, open_rows = sure | high, have + count, open_rows & ~plane
        if have == need:
            break
    first = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
    if have < need:
        level = np.flatnonzero(np.unpackbits(open_rows.view(np.uint8), bitorder="little"))[: need - have]
        first = np.concatenate([first, level])
    return first


def search_block(ids: np.ndarray, low: int, slices: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the query, row id, score) of each query's k best rows of a block; a row with the query's id is none. Scores are exact and end at the limits of 64 bits."""
    flipped, top = ~slices, (1 << slices.shape[1]) - 1
    there = np.zeros(slices.shape[2] * 64, np.uint8)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for number, (qid, q) in enumerate(zip(query_ids.tolist(), queries)):
        there[: len(ids)] = ids != qid
        rows = np.packbits(there, bitorder="little").view(np.uint64)
        score = add_slices(slices, flipped, q)
        best = select_top(score, rows, k)
        word, bit = best // 64, (best % 64).astype(np.uint64)
        parts = q.tolist()
        value = [low * sum(parts) + top * sum(x for x in parts if x < 0)] * len(best)
        for w, plane in enumerate(score):
            value = [v + (int(x) << w) for v, x in zip(value, (plane[word] >> bit) & np.uint64(1))]
        value = [min(max(v, LONG[0]), LONG[1]) for v in value]
        found.append((np.full(len(best), number), ids[best], np.array(value, np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found))


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                x = {name: batch.column(name)[r] for name in batch.schema.names}
                d, n, m = x["dim"].as_py(), x["n"].as_py(), x["query_n"].as_py()
                ids = np.frombuffer(x["ids"].as_buffer(), np.int64, n)
                slices = np.frombuffer(x["slices"].as_buffer(), np.uint64).reshape(d, x["bits"].as_py(), -1)
                keys, qids = (np.frombuffer(x[c].as_buffer(), np.int64, m) for c in ("query_keys", "query_ids"))
                queries = np.frombuffer(x["query_rows"].as_buffer(), np.int64).reshape(m, d)
                number, row, score = search_block(ids, x["low"].as_py(), slices, qids, queries, k)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (keys[number], qids[number], row, score)], names=["key", "query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Each query's k highest inner products: query_id, rank, vec_id, score.

    ``vectors`` and ``queries`` have vec_id and embedding (other columns are
    ignored). Rows whose id or vector is null, whose vector is empty or has
    null or non-finite components, take no part; finite components beyond 2**53
    raise, and scores end at the limits of a long. Vectors of different lengths
    are not compared. Each row is a candidate of its own, repeated ids too,
    except for queries of the same id; each row of ``queries`` is a query of its
    own, so an id that repeats has its ranks once a row. Blocks of the index
    meet blocks of queries; only k rows per query and block leave a task.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "bitsliced")
    plain = lambda df: df.select(df["vec_id"].cast("long").alias("vec_id"), df["embedding"].cast("array<double>").alias("embedding"))
    index = scratch.table(plain(vectors).mapInArrow(_index, INDEX_SCHEMA), "index")
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    asking = plain(queries).where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & whole)
    asking = scratch.table(asking.withColumn("key", F.monotonically_increasing_id()), "asking")
    blocks = max(1, math.ceil(asking.count() / QUERY_ROWS))
    asked = scratch.table(asking.coalesce(blocks).mapInArrow(_query_rows, QUERY_SCHEMA), "asked")
    asked = asked.select("dim", F.col("n").alias("query_n"), F.col("keys").alias("query_keys"), F.col("ids").alias("query_ids"), F.col("rows").alias("query_rows"))
    # Cells deal the index out. They grow with it, so that one holds few of its blocks however many queries there are.
    cells = max(math.ceil(4 * int(spark.conf.get("spark.sql.shuffle.partitions")) / blocks), math.ceil(index.count() / 4), 1)
    asked = asked.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    met = index.withColumn("cell", F.pmod(F.xxhash64("block"), F.lit(cells)).cast("int")).join(asked, ["dim", "cell"])
    met = met.select("dim", "bits", "low", "n", "ids", "slices", "query_n", "query_keys", "query_ids", "query_rows")
    found = met.mapInArrow(_search(k), "key long, query_id long, vec_id long, score long")
    order = Window.partitionBy("key", "query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


OP1_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.row, q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
