"""Centroid clustering of integer vectors by equal-average equal-variance search.

For vectors of d components with sums S and T = sqrt(d * sum of squares - S * S),
the squared distance D of x and c obeys

    d * D >= (S(x) - S(c)) ** 2 + (T(x) - T(c)) ** 2,

the first term being the inequality of means, the second that of deviations.
Centroids are sorted by their sums.  A vector starts between the two whose sums
are next to its own and scans outward, the nearer side first: once the first
term alone exceeds the best distance so far, no centroid farther out can win
and the scan ends; a centroid whose both terms exceed it is passed over; the
rest get their exact integer distance.  The bounds are taken in doubles with
room for rounding, so they never reject a winner; ties go to the smaller number.

A round is one pass over the vectors: every task keeps one sum vector and count
per centroid, and the centroids' new components come from exact sums of those.
Only the centroids, a parameter's number of them, pass through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import written
from marketloom.llm.vectors import finite, matrix

AT_ONCE = 8_192
SMALL = 1 << 24  # components below it have distances, and d times their squares, within 64 bits up to d = 256
FAR = np.iinfo(np.int64).max
EXACT = "decimal(38,0)"


@dataclass(frozen=True)
class Centroids:
    """Integer centroids, one row each, in the order of their numbers."""

    rows: list[list[int]]

    @cached_property
    def _sorted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number, components, sum, deviation) by ascending sum."""
        x = np.array(self.rows, dtype=np.int64)
        total = x.sum(axis=1)
        order = np.argsort(total, kind="stable")
        return order, x[order], total[order], _deviation(x)[order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) for each row of integers ``x``."""
        if x.dtype == object or any(abs(c) >= SMALL for row in self.rows for c in row) or x.shape[1] > 256:
            return self._exhaustive(x)
        number, centre, sums, devs = self._sorted
        k, d = centre.shape
        total, dev = x.sum(axis=1), _deviation(x)
        best, which = np.full(len(x), FAR), np.full(len(x), k)
        up = np.searchsorted(sums, total)
        down = up - 1
        live = np.arange(len(x))
        while len(live):
            above = np.where(up[live] < k, sums[np.minimum(up[live], k - 1)] - total[live], FAR)
            below = np.where(down[live] >= 0, total[live] - sums[np.maximum(down[live], 0)], FAR)
            rising = above <= below
            gap = np.where(rising, above, below)
            far = gap.astype(float) ** 2
            limit = best[live].astype(float) * d * (1 + 1e-9)
            going = (gap < FAR) & (far <= limit)
            live, rising, far, limit = live[going], rising[going], far[going], limit[going]
            c = np.where(rising, up[live], down[live])
            up[live] += rising
            down[live] -= ~rising
            apart = np.maximum(np.abs(dev[live] - devs[c]) - 1e-12 * (dev[live] + devs[c]), 0)
            near = far + apart**2 <= limit
            i, c = live[near], c[near]
            distance = ((x[i] - centre[c]) ** 2).sum(axis=1)
            wins = (distance < best[i]) | ((distance == best[i]) & (number[c] < which[i]))
            best[i[wins]], which[i[wins]] = distance[wins], number[c[wins]]
        return which, best

    def _exhaustive(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for components too large for 64-bit squares, in Python's integers."""
        x = x.astype(object)
        all_of = np.stack([((x - np.array(c, dtype=object)) ** 2).sum(axis=1) for c in self.rows], axis=1)
        which = np.array([min(range(len(self.rows)), key=row.__getitem__) for row in all_of], dtype=np.int64)
        return which, all_of[np.arange(len(x)), which]

    def digests(self) -> list[str]:
        """Hex sha256 of each centroid's components, joined by commas."""
        return [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in self.rows]


def _deviation(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.shape[1] * (x * x).sum(axis=1) - x.sum(axis=1) ** 2).astype(float))


def scaled(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): 64-bit integers, or Python's where one is too large for the fast search."""
    made = np.floor(scale * x)
    if not made.size or np.abs(made).max() < SMALL:
        return made.astype(np.int64)
    return np.array([[int(c) for c in row] for row in made.tolist()], dtype=object).reshape(made.shape)


def _sums(centroids: Centroids, scale: int):  # noqa: ANN202
    schema = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.decimal128(38, 0)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids.rows)
        n, total = [0] * k, [0] * k
        for batch in batches:
            for low in range(0, batch.num_rows, AT_ONCE):
                x = scaled(matrix(batch.column("v").slice(low, AT_ONCE)), scale)
                which, _ = centroids.nearest(x)
                for c in np.unique(which).tolist():
                    mine = x[which == c]
                    n[c] += len(mine)
                    total[c] = total[c] + mine.sum(axis=0).astype(object)
        seen = [c for c in range(k) if n[c]]
        sums = [[Decimal(int(s)) for s in total[c]] for c in seen]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((seen, [n[c] for c in seen], sums), schema, strict=True)], schema=schema)

    return run


def moved(rows: DataFrame, centroids: Centroids, scale: int) -> Centroids:
    """Every non-empty centroid replaced by its vectors' floored component means."""
    made = rows.select("v").mapInArrow(_sums(centroids, scale), f"cluster int, n long, total array<{EXACT}>")
    counts = F.sum("n").alias("n")
    sums = made.select("cluster", "n", F.posexplode("total").alias("at", "x")).groupBy("cluster", "at").agg(counts, F.sum("x").cast(EXACT).alias("x"))
    new = [list(row) for row in centroids.rows]
    for r in sums.collect():  # centroids times components, whatever the number of vectors
        new[r["cluster"]][r["at"]] = int(r["x"]) // r["n"]
    return Centroids(new)


def assigned(rows: DataFrame, centroids: Centroids, scale: int) -> DataFrame:
    """(id, cluster, distance) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(low, AT_ONCE)
                which, distance = centroids.nearest(scaled(matrix(part.column("v")), scale))
                columns = [part.column("id"), pa.array(which, pa.int32()), pa.array(distance.tolist(), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "cluster", "distance"])

    return rows.mapInArrow(run, "id long, cluster int, distance long")


def first_centroids(rows: DataFrame, k: int, scale: int) -> Centroids:
    """The k vectors with the smallest hex sha256 of ``1:<id>``, in that order."""
    order = [F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256).asc_nulls_last(), F.col("v")]
    first = rows.orderBy(*order).limit(k).collect()
    return Centroids([[int(c) for c in scaled(np.array([r["v"]]), scale)[0]] for r in first])


def cluster(
    vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding"
) -> tuple[DataFrame, Centroids]:
    """(one row per vector: id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256; the final centroids).

    Vectors count when they have ``dims`` components, none null or non-finite;
    each component x becomes floor(scale * x).  Zero vectors count.  Other rows
    (null, empty and shorter or longer vectors) are left out.  Centroids start
    as ``first_centroids``; fewer vectors than ``k`` make as many centroids.
    Equal vectors may start several centroids: the smaller number wins ties, and
    a centroid without vectors stays where it is.  Repeated rows are vectors
    of their own; null ids are clustered, and start a centroid only after all
    others.  An empty table gives no rows; other columns, whatever their names,
    are ignored.  A distance or sum beyond 64 bits is an error.
    """
    rows = vectors.where(finite(vec_col) & (F.size(vec_col) == dims))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    centroids = first_centroids(rows, k, scale)
    if not centroids.rows:
        empty = f"`{id_col}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return vectors.sparkSession.createDataFrame([], empty), centroids
    for _ in range(rounds):
        centroids = moved(rows, centroids, scale)
    found = written(assigned(rows, centroids, scale))
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast(EXACT)).alias("s")).collect()}
    facts = [(c, sums[c], sum(sums.values()), digest) for c, digest in enumerate(centroids.digests()) if c in sums]
    known = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = found.join(F.broadcast(known), "cluster")  # k rows
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids
