"""A training corpus in five stages: toxicity, near-duplicates, personal data, mix, packing.

Every stage takes (spark, docs, sf_dir) and returns a frame; all but the last
return the columns of ``documents``.  Between the stages the rows are written
and read again, which also cuts the lineage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import minhash_dedup, mixing, packing, pii, toxicity
from marketloom.llm.common import unused, written
from marketloom.llm.registry import TARGET_WEIGHTS, training_labels


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scoring below 0.3; the model learns from the labels of the kept three quarters.

    Null and empty texts, and texts of any length, are scored like others;
    equal texts have equal scores, so repeated rows go or stay together.  Null
    ids carry no label and are scored.  An empty table stays empty.  All
    columns, whatever their names, are returned unchanged.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, training_labels(labels))
    score = unused("_toxicity", docs.columns)
    return toxicity.with_score(docs, model, name=score).where(F.col(score) < 0.3).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8): the one with the smallest id.

    Texts without words (null, empty, white space) and rows with a null id
    stay; of rows repeating an id and a text one stays.  Texts are compared
    whole.  An empty table stays empty.  All columns, whatever their names, are
    returned unchanged.
    """
    return minhash_dedup.without_near_duplicates(docs, words=5, percent=80)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in brackets; n_chars follows the new text.

    Null texts stay null (n_chars too), empty ones empty; every row stays,
    repeated ones with equal texts.  Overlapping spans become one bracket.
    Without a n_chars column none is made.  An empty table stays empty; other
    columns, whatever their names, are unchanged.
    """
    clean = pii.redacted(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix, which the files keep for the packing.

    Null and unknown sources are one pool; null ids, texts of any kind and
    repeated rows are placed like any row, ties in hash order of the id.  An
    empty table stays empty.  All columns, whatever their names, are returned.
    """
    ordered = mixing.in_order(mixing.mix(docs, TARGET_WEIGHTS))
    return ordered.drop(*ordered.columns[len(docs.columns) :])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents (as read from files) and their places in sequences of 2048 tokens, which follow the mix.

    Null and empty texts are one piece, the end id; long ones are cut into
    pieces; repeated rows and null ids are packed like any row.  An empty table
    gives no pieces; columns beside id and text are not read.
    """
    placed = mixing.laid_out(docs)
    return packing.pack(placed, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, place_col=placed.columns[-1])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("minhash_dedup", drop_near_copies),
    ("pii", redact),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: the learned stages cannot be written in SQL
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs
