"""Documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import mixing, near_dup, packing, passages, quality
from readloom.llm.language import remainder
from readloom.llm.scratch import Scratch


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, with all their columns; it learns from labels outside the held-out fold.

    Null texts are scored as empty ones; equal texts have one fate; without a usable label all documents stay.
    """
    learn = _labels(spark, sf_dir).where(remainder(F.col("doc_id"), 5) != 0).select("doc_id", "quality")
    names = {n: "text" if n == "text" else f"given{k}" for k, n in enumerate(docs.columns)}  # none that the scores take
    rows = docs.select(*[F.col(f"`{n}`").alias(k) for n, k in names.items()])
    return quality.score(rows, quality.train(docs, learn)).where("predicted = 1").select(*[F.col(k).alias(n) for n, k in names.items()])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are alike to 0.8 or more, the one with the least doc_id.

    Texts without words (null, empty, blank) all stay; rows equal in id and text are one document; a null id is the greatest.
    """
    return near_dup.without_near_duplicates(docs, width=5, percent=80)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that an earlier document (by doc_id) has; a text may become empty, null texts stay null."""
    return passages.without_passages(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say; no domain is cut below what there is.

    Texts without words have no tokens and are mixed by the labels' shares; without usable labels every document stays once.
    """
    labelled = mixing.labelled_documents(docs, _labels(spark, sf_dir))
    return mixing.resample(docs, mixing.mix(docs, labelled, mixing.TARGETS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences of at most 4096 tokens; a null or empty text is its end token alone, repeated rows are packed each."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("quality_classifier", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_passages),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Learned models and chained alignments have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
