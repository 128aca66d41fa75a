"""Operator 10: document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``WORDS`` words (all of its text). Each
passage is encoded as shares of pairs of neighbouring character classes and a
few word statistics. A gated attention network, learned from document labels
alone, weighs the encoded passages; the weighted representation gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytescan import row_groups, shingles, text_buffer, words
from .language import remainder, with_columns
from .scratch import Scratch

WORDS = 64
SAMPLE = 4000  # labelled documents learned from, at most
PASSAGES = 120_000  # and passages of them
OF_ONE = 1000  # passages of a document that teach, at most, evenly spread over it; scores take all
HIDDEN, ATTENTION, STEPS, BAGS = 16, 8, 600, 256
THRESHOLD = 0.3
GROUP = 1 << 20

# Classes of bytes: lower, upper, beyond ASCII, digit, space, line feed, stop or comma, !, other sentence marks, symbols, bar, rest.
_CLASS = np.full(256, 11, np.int64)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", bytes(range(128, 256)), b"0123456789", b" \t", b"\n\r", b".,", b"!", b"?:;", b"#$%&*", b"|")):
    _CLASS[list(_chars)] = _k
CLASSES = 12
FEATURES = CLASSES * CLASSES + 6


def encode(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Passage features of all rows and each row's number of passages (1 at least; an empty text is one empty passage)."""
    buf, offsets = text_buffer(rows.column("text"))
    hashes, starts, ends, first = words(buf, offsets)
    n = np.diff(first)
    parts = np.maximum(1, -(-n // WORDS))
    owner = np.repeat(np.arange(len(n)), parts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    low = first[:-1][owner] + number * WORDS
    high = np.minimum(low + WORDS, first[1:][owner])
    padded = np.append(starts, len(buf))
    begin = np.where(number == 0, offsets[:-1][owner], padded[np.minimum(low, len(starts))])
    count = len(owner)
    passage_of_byte = np.repeat(np.arange(count), np.diff(np.append(begin, len(buf))))
    kinds = _CLASS[buf]
    out = np.zeros((count, FEATURES), np.float32)
    if len(buf) > 1:
        same = passage_of_byte[1:] == passage_of_byte[:-1]
        code = (passage_of_byte[:-1] * CLASSES + kinds[:-1]) * CLASSES + kinds[1:]
        pairs = np.bincount(code[same], minlength=count * CLASSES * CLASSES).reshape(count, -1)
        out[:, : CLASSES * CLASSES] = pairs / np.maximum(1, pairs.sum(axis=1, keepdims=True))
    passage = np.repeat(np.arange(count), high - low)
    if len(passage):
        size = np.maximum(1, high - low)
        length = (ends - starts).astype(np.float64)
        mean = np.bincount(passage, weights=length, minlength=count) / size
        spread = np.sqrt(np.maximum(0, np.bincount(passage, weights=length**2, minlength=count) / size - mean**2))
        doc = np.repeat(np.arange(len(n)), n)
        out[:, -6], out[:, -5] = mean / 10, np.minimum(spread / 10, 5)
        out[:, -4] = np.bincount(passage, weights=_repeats(hashes, passage), minlength=count) / size
        out[:, -3] = np.bincount(passage, weights=_repeats(hashes, doc), minlength=count) / size
        if len(hashes) >= 3:
            runs = np.concatenate([shingles(hashes, 3), hashes[-2:]])
            out[:, -2] = np.bincount(passage, weights=_repeats(runs, doc), minlength=count) / size
    out[:, -1] = np.log1p(n[owner]) / 10
    return out, parts


def _repeats(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """1 where a value occurred before in its group."""
    key = values + group.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(values))
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    return again


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Network:
    """Encoder, gated attention and output layer, with gradients by hand."""

    def __init__(self, features: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda a, b: rng.normal(0, a**-0.5, (a, b))
        self.p = {"A": draw(features, HIDDEN), "a": np.zeros(HIDDEN), "V": draw(HIDDEN, ATTENTION), "U": draw(HIDDEN, ATTENTION), "w": draw(ATTENTION, 1)[:, 0], "c": draw(HIDDEN, 1)[:, 0], "b": np.zeros(1)}
        self.mean, self.spread = np.zeros(features), np.ones(features)

    def forward(self, x: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Logits of bags (rows of ``x``, ``parts`` to a bag) and what the gradient needs."""
        p = self.p
        x = np.clip((x - self.mean) / self.spread, -8, 8)
        e = np.tanh(x @ p["A"] + p["a"])
        t, g = np.tanh(e @ p["V"]), _sigmoid(e @ p["U"])
        s = (t * g) @ p["w"]
        at = np.cumsum(parts) - parts
        bag = np.repeat(np.arange(len(parts)), parts)
        q = np.exp(s - np.maximum.reduceat(s, at)[bag])
        alpha = q / np.add.reduceat(q, at)[bag]
        z = np.add.reduceat(alpha[:, None] * e, at)
        return z @ p["c"] + p["b"][0], (x, e, t, g, alpha, z, at, bag)

    def gradient(self, d: np.ndarray, kept: tuple) -> dict[str, np.ndarray]:
        """Of the sum of d * logit."""
        p, (x, e, t, g, alpha, z, at, bag) = self.p, kept
        dz = d[:, None] * p["c"]
        de = alpha[:, None] * dz[bag]
        da = (e * dz[bag]).sum(1)
        ds = alpha * (da - np.add.reduceat(alpha * da, at)[bag])
        dt, dg = ds[:, None] * p["w"] * g * (1 - t**2), ds[:, None] * p["w"] * t * g * (1 - g)
        de += dt @ p["V"].T + dg @ p["U"].T
        dx = de * (1 - e**2)
        return {"A": x.T @ dx, "a": dx.sum(0), "V": e.T @ dt, "U": e.T @ dg, "w": ((t * g) * ds[:, None]).sum(0), "c": z.T @ d, "b": d.sum(keepdims=True)}

    def scores(self, x: np.ndarray, parts: np.ndarray) -> np.ndarray:
        return _sigmoid(self.forward(x, parts)[0])


def fit(bags: list[np.ndarray], labels: np.ndarray, steps: int = STEPS, seed: int = 5) -> Network:
    """A network learned by Adam on log loss with a small weight decay."""
    net = Network(bags[0].shape[1], seed)
    rows = np.concatenate(bags)
    net.mean, net.spread = rows.mean(0), rows.std(0) + 1e-3
    share = float(np.clip(labels.mean(), 0.01, 0.99))
    net.p["b"][0] = np.log(share / (1 - share))
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    rng = np.random.default_rng(seed)
    for step in range(1, steps + 1):
        take = rng.integers(0, len(bags), BAGS)
        parts = np.array([len(bags[i]) for i in take])
        logit, kept = net.forward(np.concatenate([bags[i] for i in take]), parts)
        grads = net.gradient((_sigmoid(logit) - labels[take]) / len(take), kept)
        for k, g in grads.items():
            g = g + 1e-4 * net.p[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            net.p[k] -= 0.02 * min(1.0, 2 * (1 - step / steps) + 0.02) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return net


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in row_groups(batch, "text", GROUP):
            x, parts = encode(rows)
            ends = np.cumsum(parts)
            bags = [x[a:b] if b - a <= OF_ONE else x[np.linspace(a, b - 1, OF_ONE).astype(np.int64)] for a, b in zip((ends - parts).tolist(), ends.tolist())]
            columns = [rows.column("place"), rows.column("doc_id"), rows.column("quality"), pa.array([len(b) for b in bags], pa.int32()), pa.array([b.astype("<f4").tobytes() for b in bags], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["place", "doc_id", "quality", "parts", "bag"])


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | None:
    """A network from ``labels`` (doc_id, quality 0 or 1) and the texts of ``documents``; none if no label is usable. Runs at once.

    Of repeated labels the least counts, and of rows with one id the one whose
    text has the least hash; other labels and nulls teach nothing. At most
    ``sample`` labelled documents, chosen by a hash of their id, and
    ``PASSAGES`` passages reach the driver, which counts them before it fetches
    any; the documents that come last in the order of that hash go without.
    """
    usable = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = usable.withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(sample)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").groupBy("place", "doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    scratch = Scratch(documents.sparkSession, "quality")
    bags = scratch.table(texts.mapInArrow(_bags, "place long, doc_id long, quality int, parts int, bag binary"), "bags")
    sizes = bags.select("place", "doc_id", "parts").orderBy("place", "doc_id").collect()
    upto = np.cumsum([x["parts"] for x in sizes])
    fit_in = int(np.searchsorted(upto, PASSAGES, "right"))
    rows = bags.where(F.col("place") <= sizes[fit_in - 1]["place"]).orderBy("place", "doc_id").collect()[:fit_in] if fit_in else []
    scratch.drop("bags")
    got = [np.frombuffer(bytes(x["bag"]), "<f4").reshape(-1, FEATURES).astype(np.float64) for x in rows]
    return fit(got, np.array([x["quality"] for x in rows], float)) if got else None


def score(documents: DataFrame, net: Network | None) -> DataFrame:
    """``documents`` with score (0 to 1) and predicted (score >= 0.3), which replace columns of these names; null text counts as empty, equal texts have equal scores; without a network all score 0.5."""
    shared = documents.sparkSession.sparkContext.broadcast(net)
    given, schema = with_columns(documents, ("score", "predicted"), "score double, predicted int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in row_groups(batch, "text", GROUP):
                s = shared.value.scores(*encode(rows)) if shared.value is not None else np.full(rows.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=[*rows.schema.names, "score", "predicted"])

    return given.mapInArrow(run, schema)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(True))
    net = train(documents, labels.where(~held).select("doc_id", "quality"))
    return score(documents.select("doc_id", held.alias("held_out"), "text"), net).select("doc_id", "held_out", "score", "predicted")
