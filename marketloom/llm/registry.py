"""Queries over the driver's tables, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import (
    byte_bpe,
    centroids,
    hash_index,
    lm_score,
    minhash_dedup,
    mixing,
    packing,
    pii,
    repeats,
    toxicity,
    url_filter,
    vector_dedup,
    whitening,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model learned from the labels that are not held out."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, training_labels(labels))
    docs = docs.select("doc_id", "text").withColumn("held_out", toxicity.is_held_out("doc_id"))
    scored = toxicity.with_score(docs, model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels outside the held-out quarter."""
    return labels.where(~toxicity.is_held_out("doc_id"))


def op3_superminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word shingles at similarity 0.8 over every document."""
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"), words=2, percent=80).drop("text_hash")


def op5_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 2048 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


def op2_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest other vectors of every hundredth vector."""
    return hash_index.search(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


def op4_subspace_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at cosine 0.95 among all vectors."""
    return vector_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.95)


#: fixed values of op6: verdict, host, path
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op6_link_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's url."""
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op7_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a bigram model of the documents that are not held out; token_score is the score of a token."""
    out = lm_score.score(_table(spark, sf_dir, "documents"))
    return out.withColumn("token_score", F.col("score") / F.col("n_tokens"))


def op8_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document; n_spans counts all its spans."""
    out = pii.detect(_table(spark, sf_dir, "documents"))
    return out.withColumn("n_spans", F.size(F.filter(F.split("spans", ","), lambda s: s != "")).cast("long"))


#: target weights of op9 and the pipeline: the first sources count more, the others once; unknown ones are one pool
TARGET_WEIGHTS = {f"src{i}": 1 for i in range(6, 20)} | {"src0": 4, "src1": 3, "src2": 3, "src3": 2, "src4": 2, "src5": 2}


def op9_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the mix."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    out = mixing.mix(docs, TARGET_WEIGHTS)
    names = {"_phase": "phase", "_block": "block", "_slot": "slot", "_position": "position"}
    return out.withColumnsRenamed(names).drop("_share")


def op10_maximal_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without the 200-byte strings that occur elsewhere."""
    return repeats.without_repeats(_table(spark, sf_dir, "documents"), length=200, real=False)


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen centroids of all vectors after three rounds, and what each vector is assigned to."""
    return centroids.cluster(_table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64)[0]


def op12_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and what they decode to, as hashes."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, spaced=True)


def op13_refined_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's eight whitened components."""
    out = whitening.whiten(_table(spark, sf_dir, "embeddings"), components=8, scale=1024, shift=100_000)
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ftrl_toxicity": op1_ftrl_toxicity,
    "op3_superminhash_dedup": op3_superminhash_dedup,
    "op5_minimum_bin_slack": op5_minimum_bin_slack,
    "op2_multi_index_hashing": op2_multi_index_hashing,
    "op4_subspace_pigeonhole": op4_subspace_pigeonhole,
    "op6_link_propagation": op6_link_propagation,
    "op7_deleted_interpolation": op7_deleted_interpolation,
    "op8_weak_supervision_pii": op8_weak_supervision_pii,
    "op9_pfair_mixing": op9_pfair_mixing,
    "op10_maximal_repeats": op10_maximal_repeats,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_prefix_bpe": op12_prefix_bpe,
    "op13_refined_whitening": op13_refined_whitening,
}


def _assignment(name: str, before: str) -> str:
    """SQL of each vector's nearest centroid in ``before``, ties to the smaller number."""
    return f"""{name} AS MATERIALIZED (
    SELECT vec_id, cluster, distance FROM (
        SELECT e.vec_id, c.cluster, sum((e.x - c.x) * (e.x - c.x))::BIGINT AS distance,
               row_number() OVER (PARTITION BY e.vec_id ORDER BY sum((e.x - c.x) * (e.x - c.x)), c.cluster) AS place
        FROM parts e JOIN {before} c ON e.pos = c.pos GROUP BY e.vec_id, c.cluster) WHERE place = 1)"""


def _moves(name: str, before: str, found: str) -> str:
    """SQL of the centroids moved to their vectors' floored means."""
    floored = "(m.s - ((m.s % m.n) + m.n) % m.n) // m.n"
    return f"""{name} AS MATERIALIZED (
    SELECT c.cluster, c.pos, coalesce({floored}, c.x)::BIGINT AS x FROM {before} c LEFT JOIN (
        SELECT f.cluster, p.pos, sum(p.x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM {found} f JOIN parts p USING (vec_id) GROUP BY f.cluster, p.pos) m
    ON c.cluster = m.cluster AND c.pos = m.pos)"""


#: for tables whose ids are distinct
_CENTROIDS_SQL = f"""WITH kept AS (
    SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c::DOUBLE))) = 64),
parts AS MATERIALIZED (
    SELECT vec_id, pos, floor(64 * (embedding[pos])::DOUBLE)::BIGINT AS x FROM kept, (SELECT unnest(range(1, 65)) AS pos)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster FROM kept QUALIFY cluster < 16),
c0 AS MATERIALIZED (SELECT f.cluster, p.pos, p.x FROM first f JOIN parts p USING (vec_id)),
{_assignment("a0", "c0")}, {_moves("c1", "c0", "a0")},
{_assignment("a1", "c1")}, {_moves("c2", "c1", "a1")},
{_assignment("a2", "c2")}, {_moves("c3", "c2", "a2")},
{_assignment("a3", "c3")},
digests AS (SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY pos)) AS centroid_sha256 FROM c3 GROUP BY cluster)
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a3 JOIN digests USING (cluster)"""

ORACLE_SQL: dict[str, str] = {"op11_centroid_clustering": _CENTROIDS_SQL}
