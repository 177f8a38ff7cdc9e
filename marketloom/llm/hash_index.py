"""Nearest neighbours by multi-index hashing.

Vectors become 64-bit codes: centred, rotated by a learned rotation (iterative
quantisation on a bounded sample) and reduced to signs.  The index is cut into
shards; a shard splits its codes into eight 8-bit substrings and keeps one
table per substring.  A query within Hamming radius r of a code agrees with it
on some substring up to r // 8 bits, so probing those few values per table
retrieves every code within r.  Retrieved codes are checked on the full
distance, and what is left is ranked by exact distances of the original
vectors.  The radius comes from the sample: it covers ``cover`` of the true
neighbours there, which lie farther away than in the whole table.  A shard that
finds fewer than k codes widens its radius, so no query goes short.

The index rows go to the shards, once for every QUERIES queries; a shard's rows
come first in its partition and its queries stream past them, so a task holds
one shard of bounded size.  Every shard returns at most k rows per query.
Vectors of each length are a table of their own, with codes of its own.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import written
from marketloom.llm.vectors import matrix, sample, usable

BITS, PARTS = 64, 8
SHARD_BYTES, LEAST_SHARD, QUERIES = 32 << 20, 8_192, 262_144
POPCOUNT = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


@dataclass(frozen=True)
class Coder:
    """Centre and rotation of the codes, and the radius to search."""

    centre: np.ndarray
    rotation: np.ndarray
    radius: int

    def codes(self, x: np.ndarray) -> np.ndarray:
        """One row of PARTS bytes per vector."""
        return np.packbits((x - self.centre) @ self.rotation > 0, axis=1)


def fit(x: np.ndarray, k: int, cover: float, rounds: int = 30) -> Coder:
    """Iterative quantisation on sample rows ``x``, and the radius that finds their neighbours."""
    rng = np.random.default_rng(7)
    centre = x.mean(axis=0)
    y = x - centre
    if y.shape[1] >= BITS:
        _, vectors = np.linalg.eigh(y.T @ y)
        project = vectors[:, ::-1][:, :BITS]
    else:
        project = rng.standard_normal((y.shape[1], BITS))
    v = y @ project
    turn = np.linalg.qr(rng.standard_normal((BITS, BITS)))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ turn > 0, 1.0, -1.0).T @ v)
        turn = (u @ w).T
    coder = Coder(centre, project @ turn, BITS)
    codes = coder.codes(x)
    picked = np.linspace(0, len(x) - 1, min(len(x), 200)).astype(int)
    needed = []
    for i in picked:
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        near = np.argsort(d, kind="stable")[: min(k, len(x) - 1)]
        needed += POPCOUNT[codes[near] ^ codes[i]].sum(axis=1).tolist()
    radius = int(np.quantile(needed, cover, method="higher")) if needed else BITS
    return Coder(centre, coder.rotation, radius)


class Shard:
    """Substring tables over the codes of some rows."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.order = [np.argsort(codes[:, j], kind="stable") for j in range(PARTS)]
        self.first = [np.searchsorted(codes[o, j], np.arange(257)) for j, o in enumerate(self.order)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within ``radius`` of ``code``."""
        reach, extra = divmod(radius, PARTS)
        hit = np.zeros(len(self.codes), dtype=bool)
        for j in range(PARTS):
            near = reach if j <= extra else reach - 1
            for value in np.flatnonzero(POPCOUNT[np.arange(256) ^ int(code[j])] <= near) if near >= 0 else ():
                hit[self.order[j][self.first[j][value] : self.first[j][value + 1]]] = True
        rows = np.flatnonzero(hit)
        return rows[POPCOUNT[self.codes[rows] ^ code].sum(axis=1) <= radius]


def shard_rows(n: int, d: int) -> int:
    """Rows of a shard of a table of n vectors of length d: a sixty-fourth of the table, within bounds."""
    return max(1, min(max(LEAST_SHARD, n // 64), SHARD_BYTES // (8 * d)))


def _best(coder: Coder, shard: Shard, x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the k rows of a shard nearest to one query, of those whose codes are near."""
    code, radius = coder.codes(q[None, :])[0], coder.radius
    while True:
        rows = shard.within(code, radius)
        rows = rows[ids[rows] != own]
        if len(rows) >= k or radius >= BITS:
            break
        radius = min(BITS, radius + PARTS)
    d = np.sqrt(((x[rows] - q) ** 2).sum(axis=1))
    best = np.lexsort((ids[rows], d))[:k]
    return ids[rows][best], d[best]


def _streamed(coders: list[tuple[int, Coder]], k: int):  # noqa: ANN202
    """Rows (g, kind, id, v), sorted by group and kind: a group's index rows (0), then its queries (1)."""
    firsts = [g for g, _ in coders]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, shard, x, ids = None, None, [], []
        for batch in batches:
            g, kind = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("g", "kind"))
            edges = np.flatnonzero((np.diff(g) != 0) | (np.diff(kind) != 0)) + 1
            for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(g)], strict=True):
                if high == low:
                    continue
                if g[low] != group:
                    group, shard, x, ids = g[low], None, [], []
                    coder = coders[bisect(firsts, int(group)) - 1][1]
                part = batch.slice(low, high - low)
                v, own = matrix(part.column("v")), part.column("id").to_numpy()
                if kind[low] == 0:
                    x.append(v)
                    ids.append(own)
                    continue
                if not x:
                    continue
                if shard is None:
                    x, ids = [np.concatenate(x)], [np.concatenate(ids)]
                    shard = Shard(coder.codes(x[0]))
                found = [_best(coder, shard, x[0], ids[0], q, i, k) for q, i in zip(v, own.tolist(), strict=True)]
                query = np.repeat(own, [len(f[0]) for f in found])
                columns = [query, np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    return run


def search(
    vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", fit_rows: int = 8_000, cover: float = 0.98
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k nearest other rows found.

    score is the Euclidean distance of the original vectors in double
    precision; ties go to the smaller id.  Vectors that are null, empty, zero,
    or hold null or non-finite components, and null ids, take no part: as
    queries they have no result.  Vectors meet those of their own length only.
    Of rows repeating an id one vector counts (the smallest), so an id is
    returned once.  With k or fewer candidates all are returned; an empty table
    gives no rows; other columns are ignored.  The rotation and radius of each
    length are learned from at most ``fit_rows`` rows; every row is indexed.
    """
    rows = written(usable(vectors, id_col, vec_col).withColumn("d", F.size("v")))
    sizes = rows.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("nq")).orderBy("d").collect()
    parts: list[DataFrame] = []
    coders: list[tuple[int, Coder]] = []
    used = 0
    for d, n, nq in sizes:
        if n < 2 or nq == 0:
            continue
        mine = rows.where(F.col("d") == d)
        coders.append((used, fit(sample(mine, fit_rows), k, cover)))
        shards, blocks = -(-n // shard_rows(n, d)), -(-nq // QUERIES)
        part = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")  # noqa: B023, E731
        every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        index = mine.select("id", "v", part(shards).alias("s"), every(blocks).alias("b"), F.lit(0).alias("kind"))
        asked = mine.where(is_query).select("id", "v", every(shards).alias("s"), part(blocks).alias("b"), F.lit(1).alias("kind"))
        group = F.lit(used) + F.col("b") * shards + F.col("s")
        parts.append(index.union(asked).select(group.alias("g"), "kind", "id", "v"))
        used += shards * blocks
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    together = reduce(DataFrame.union, parts).repartition("g").sortWithinPartitions("g", "kind")
    found = together.mapInArrow(_streamed(coders, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
