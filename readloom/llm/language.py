"""Operator 8: language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of character 1- to 3-grams in 2**16 hashed places:
letters lower-cased, every run of other characters one space. Document
frequencies cover all documents that may be learned from. The weights are
learned by follow-the-regularised-leader (per-coordinate rates, L1 and L2
penalties) on about ``SAMPLE`` documents a language, chosen by a hash; a
temperature fitted on a part of the sample that the weights never saw
calibrates the probabilities.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytescan import mix, row_groups

PLACES = 1 << 16
SAMPLE = 800  # documents a language, about: each is taken with a chance of SAMPLE to all rows of its language
LANGUAGES = 1000  # learned, the most frequent ones
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5
GROUP = 2 << 20
UNKNOWN = "und"

_FOLD: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """Code point -> lower-cased letter, or a space for all that is no letter."""
    if not _FOLD:
        table = np.full(sys.maxunicode + 1, 32, np.uint32)
        for c in range(sys.maxunicode + 1):
            if unicodedata.category(chr(c))[0] == "L":
                low = chr(c).lower()
                table[c] = ord(low) if len(low) == 1 else c
        _FOLD.append(table)
    return _FOLD[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of all grams of all texts, the number of each text's grams, and whether it has a letter. A text's grams stand together."""
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = _fold()[points]
    owner = np.repeat(np.arange(len(texts)), sizes)
    letter = folded != 32
    keep = letter.copy()
    keep[1:] |= letter[:-1] & (owner[1:] == owner[:-1])
    folded, owner, letter = folded[keep].astype(np.uint64), owner[keep], letter[keep]
    has = np.zeros(len(texts), bool)
    has[owner[letter]] = True
    n = len(folded)
    places = np.zeros((n, 3), np.uint32)
    good = np.ones((n, 3), bool)
    code = np.zeros(n, np.uint64)
    for k in range(3):
        code[: n - k] += folded[k:] * np.uint64(pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64))
        places[:, k] = mix(code + np.uint64(k)) >> np.uint64(48)
        good[:, k] = False
        good[: n - k, k] = owner[k:] == owner[: n - k]
    counts = np.bincount(owner, weights=good.sum(1), minlength=len(texts)).astype(np.int64)
    return places[good], counts, has


def _texts(rows: pa.RecordBatch) -> list[str]:
    return [t or "" for t in rows.column("text").to_pylist()]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, docs, there = np.zeros(PLACES, np.int64), 0, np.zeros(PLACES, bool)
    for batch in batches:
        for rows in row_groups(batch, "text", GROUP):
            places, counts, _ = grams(_texts(rows))
            ends = np.cumsum(counts)
            for a, b in zip((ends - counts).tolist(), ends.tolist()):
                there[:] = False
                there[places[a:b]] = True
                total += there
            docs += len(counts)
    full = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(full, -1).astype(np.int32)), pa.array(np.append(total[full], docs))], names=["place", "n"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse counts of sampled rows, at most ``PLACES`` numbers each."""
    for batch in batches:
        for rows in row_groups(batch, "text", GROUP):
            places, counts, has = grams(_texts(rows))
            ends = np.cumsum(counts)
            at, tf = [], []
            for a, b in zip((ends - counts).tolist(), ends.tolist()):
                c = np.bincount(places[a:b], minlength=PLACES) if b > a else np.zeros(PLACES, np.int64)
                full = np.flatnonzero(c)
                at.append(full.astype("<i4").tobytes())
                tf.append((c[full] / max(1, b - a)).astype("<f4").tobytes())
            columns = [rows.column("lang"), pa.array(at, pa.binary()), pa.array(tf, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "at", "tf"]).filter(pa.array(has))


class Model:
    """Languages, weights (with inverse document frequencies in them), biases and temperature."""

    def __init__(self, langs: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.langs, self.weights, self.bias, self.temperature = langs, weights, bias, temperature

    def probabilities(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        places, counts, has = grams(texts)
        sums = np.zeros((len(texts), len(self.langs)))
        full = np.flatnonzero(counts)
        if len(full):
            starts = (np.cumsum(counts) - counts)[full]
            for k in range(len(self.langs)):
                sums[full, k] = np.add.reduceat(self.weights[k][places], starts) / counts[full]
        return softmax((sums + self.bias) / self.temperature), has


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, places: int, epochs: int = EPOCHS, seed: int = 7) -> np.ndarray:
    """Weights (classes x places) of a multinomial logistic regression, by FTRL-proximal with elastic-net penalties."""
    z, n = np.zeros((classes, places)), np.zeros((classes, places))

    def weights(at: np.ndarray) -> np.ndarray:
        zs, ns = z[:, at], n[:, at]
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            w = weights(at)
            p = softmax(w @ x)
            p[labels[i]] -= 1
            g = np.outer(p, x)
            s = (np.sqrt(n[:, at] + g * g) - np.sqrt(n[:, at])) / ALPHA
            z[:, at] += g - s * w
            n[:, at] += g * g
    return weights(np.arange(places))


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, between 0.05 and 20, by golden section over its logarithm."""

    def loss(t: float) -> float:
        return -float(np.log(softmax(logits / np.exp(t))[np.arange(len(labels)), labels] + 1e-12).mean())

    a, b, r = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of ``labelled`` (doc_id, text, lang); rows without text or lang teach nothing. Runs jobs at once.

    The driver gets about ``sample`` sparse vectors a language and one
    frequency per place. Documents are chosen by a hash of id and text against a
    threshold, without any ranking, and rows equal in both teach once. Without
    any usable row the model knows no language.
    """
    usable = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    seen = usable.select("text").mapInArrow(_frequencies, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    most = float(1 << 40)
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    chosen = usable.withColumns({"draw": draw}).join(F.broadcast(sizes), "lang").where(F.col("draw") * F.col("n") < sample * most)
    chosen = chosen.dropDuplicates(["lang", "doc_id", "draw"])
    rows = chosen.select("lang", "text").mapInArrow(_vectors, "lang string, at binary, tf binary").collect()
    rows = sorted((x["lang"], bytes(x["at"]), bytes(x["tf"])) for x in rows)
    langs = sorted({x[0] for x in rows})
    df, docs = np.zeros(PLACES), 1
    for x in seen:
        if x["place"] < 0:
            docs = x["n"]
        else:
            df[x["place"]] = x["n"]
    idf = np.log((1 + docs) / (1 + df)) + 1
    if not langs:
        return Model([], np.zeros((0, PLACES), np.float32), np.zeros(0), 1.0)
    vectors, labels = [], np.array([langs.index(x[0]) for x in rows])
    for _, at, tf in rows:
        at = np.frombuffer(at, "<i4")
        v = np.frombuffer(tf, "<f4") * idf[at]
        vectors.append((np.append(at, PLACES), np.append(v * SCALE, 1.0)))
    rng = np.random.default_rng(11)
    held = rng.random(len(rows)) < 0.2
    learn = np.flatnonzero(~held) if (~held).any() else np.arange(len(rows))
    w = ftrl([vectors[i] for i in learn], labels[learn], len(langs), PLACES + 1)
    test = np.flatnonzero(held) if held.any() else learn
    logits = np.array([w[:, vectors[i][0]] @ vectors[i][1] for i in test])
    return Model(langs, (w[:, :-1] * idf * SCALE).astype(np.float32), w[:, -1], fit_temperature(logits, labels[test]))


SCALE = 10.0  # of all features, so that weights stay near one


def with_columns(given: DataFrame, names: tuple[str, ...], added: str) -> tuple[DataFrame, T.StructType]:
    """``given`` without columns of these names, and its schema with those of ``added``."""
    rows = given.select(*[F.col(f"`{n}`") for n in given.columns if n not in names])
    return rows, T.StructType([*rows.schema.fields, *T.StructType.fromDDL(added).fields])


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` with lang_pred and score, which replace columns of these names; ``und`` and 0 where text is null or has no letter, or the model knows no language. Equal rows have equal values."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    given, schema = with_columns(documents, ("lang_pred", "score"), "lang_pred string, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for rows in row_groups(batch, "text", GROUP):
                lang, score = [UNKNOWN] * rows.num_rows, np.zeros(rows.num_rows)
                if m.langs:
                    p, has = m.probabilities(_texts(rows))
                    best = p.argmax(axis=1)
                    lang = [m.langs[k] if h else UNKNOWN for k, h in zip(best, has)]
                    score = np.where(has, p.max(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(lang, pa.string()), pa.array(score)], names=[*rows.schema.names, "lang_pred", "score"])

    return given.mapInArrow(run, schema)


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of an id as text, modulo ``of``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(True)).alias("held_out")
    model = train(documents.where(~held))
    found = identify(documents.select("doc_id", held, "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")
