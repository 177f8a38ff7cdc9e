"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Training takes a bounded, documented sample of labelled rows (the
``max_train`` labels with the smallest hash of their id, and of their texts, in
hash order, as many as have ``max_coordinates`` coordinates together), dealt
over ``shards`` tasks that each run FTRL over their share; the shards' weights
are averaged by how strongly each coordinate was updated.  L1 keeps few weights,
which travel to the scoring tasks as two arrays of at most ``2**bits`` entries.
Scoring is one pass over the whole texts, without a shuffle; a text of any
length is read in slices of a few MB with its neighbours, a longer one alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.blocks import give_back
from marketloom.llm.text_arrays import GOLD, PUNCTUATION, U64, distinct, mix, text_slices, word_hashes


UNTRAINED = float(np.log(0.1 / 0.9))


@dataclass(frozen=True)
class Settings:
    """Learning rates, penalties, and the bound of the training sample."""

    bits: int = 20
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 1.0
    epochs: int = 3
    max_train: int = 16_000
    max_coordinates: int = 24_000_000
    shards: int = 1


@dataclass(frozen=True)
class Model:
    """Non-zero weights by coordinate (sorted), and the bias."""

    bits: int
    index: np.ndarray
    weight: np.ndarray
    bias: float


def features(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Distinct coordinates of a text's words, word pairs and pairs that skip a word."""
    with np.errstate(over="ignore"):
        parts = [mix(hashes + GOLD)]
        if len(hashes) > 1:
            parts.append(mix(hashes[:-1] * U64(3) + hashes[1:]))
        if len(hashes) > 2:
            parts.append(mix(hashes[:-2] * U64(5) + hashes[2:] + U64(1)))
    return distinct((np.concatenate(parts) >> U64(64 - bits)).astype(np.int32))


def fit_rows(rows: list[tuple[np.ndarray, int]], cfg: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(weights, squared-gradient sums) after FTRL-proximal passes over (coordinates, label) rows.

    The last coordinate is the bias; it carries no L1 penalty.
    """
    size = (1 << cfg.bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    last = size - 1

    def weights(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        shrunk = np.sign(zz) * np.maximum(np.abs(zz) - np.where(at == last, 0.0, cfg.l1), 0.0)
        return -shrunk / ((cfg.beta + np.sqrt(n[at])) / cfg.alpha + cfg.l2)

    for _ in range(cfg.epochs):
        for coordinates, label in rows:
            at = np.append(coordinates, last)
            w = weights(at)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35.0, 35.0)))
            g = p - label
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / cfg.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(size)), n


def _featured(texts: pa.Array, bits: int) -> list[np.ndarray]:
    hashes, at = word_hashes(texts, PUNCTUATION)
    return [features(hashes[at[i] : at[i + 1]], bits) for i in range(len(at) - 1)]


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", cfg: Settings = Settings()
) -> Model:
    """Learn from the documents that ``labels`` gives a 0/1 label; null texts count as empty.

    The sample is drawn among the labels, so only its texts are moved.  Labels
    that are null or neither 0 nor 1 are left out.  No rows, or rows of one
    label only, still give a model (bias, few weights).  Of rows repeating an
    id the smallest text counts, once for each of its labels.  Empty tables
    give a model without weights, by which every text scores 0.1; other columns,
    whatever their names, are not read.
    """
    sample = labels.select(F.col(id_col).alias("i"), F.col(label_col).alias("label")).where("label in (0, 1) and i is not null")
    sample = sample.select("i", F.col("label").cast("int").alias("label")).orderBy(F.xxhash64("i"), "label").limit(cfg.max_train)
    rows = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(sample), "i")
    rows = rows.groupBy("i", "label").agg(F.min("text").alias("text"))  # as many as labels at most
    rows = rows.select("text", "label", F.xxhash64("text", "label").alias("h"))
    room = cfg.max_coordinates // cfg.shards

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, int]] = []
        total = 0
        for part in (part for batch in batches for part in text_slices(batch, "text")):
            made = _featured(part.column("text"), cfg.bits)
            for x, label in zip(made, part.column("label").to_pylist(), strict=True):
                total += len(x)
                if total > room:
                    break
                found.append((x, label))
            if total > room:
                break
        weights, seen = fit_rows(found, cfg)
        del found
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(weights[at]), pa.array(seen[at])], ["at", "w", "n"])
        del weights, seen
        give_back()

    dealt = rows.repartition(cfg.shards, F.pmod("h", F.lit(cfg.shards))).sortWithinPartitions("h")
    parts = dealt.mapInArrow(run, "at long, w double, n double")
    mean = parts.groupBy("at").agg((F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("w")).where("w <> 0")
    got = mean.toArrow()  # at most 2**bits + 1 rows
    at, w = got.column("at").to_numpy(), got.column("w").to_numpy()
    order = np.argsort(at)
    at, w = at[order], w[order]
    last = 1 << cfg.bits
    bias = float(w[-1]) if len(at) and at[-1] == last else 0.0
    if got.num_rows == 0:  # nothing was learned
        bias = UNTRAINED
    return Model(cfg.bits, at[at < last], w[at < last], bias)


def with_score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a double column ``name`` in [0, 1]: the higher, the likelier label 1.

    Every whole text is scored, however long; null and empty texts get the bias
    alone; equal texts have equal scores, and repeated rows stay.  Other columns
    pass through unchanged, whatever their names; an older column called
    ``name`` is replaced.  An empty table stays empty.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model.bits, model.index, model.weight, model.bias))

    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bits, index, weight, bias = sent.value
        dense = np.zeros(1 << bits, dtype=np.float64)
        dense[index] = weight
        for texts in columns:
            out = [np.empty(0)]
            for part in text_slices(pa.table({"text": texts}), "text"):
                out.append(np.array([bias + dense[x].sum() for x in _featured(part.column("text"), bits)]))
            yield pa.array(1.0 / (1.0 + np.exp(-np.clip(np.concatenate(out), -35.0, 35.0))), pa.float64())
            del out
        del dense
        give_back()

    return docs.withColumn(name, F.arrow_udf(score, "double")(F.col(text_col)))


def is_held_out(id_col: str, modulus: int = 4, remainder: int = 2) -> Column:
    """crc32 of the id as text, modulo ``modulus``, is ``remainder``; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))
