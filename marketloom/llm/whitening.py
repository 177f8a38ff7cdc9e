"""Embedding whitening by mixed-precision refinement of eigenvectors.

Components become integers, x = floor(scale * c) + shift.  Spark sums, exactly
and in any order: first the components, then the products of the components
centred on the integer next to their mean.  What the integer leaves of the mean,
less than one half, is taken off in rational arithmetic, so the covariance is
exact until it is rounded.

Its eigenvectors are found in float32 and refined in extended precision by the
matrix-multiplication iterations of Ogita and Aishima: with R = I - X'X and
S = X'VX, every entry of the correction E follows from R, S and the eigenvalue
estimates, and X becomes X + XE.  Eigenvalues closer than the iteration can tell
apart form clusters; within each a small problem X_k'(V - mu)X_k, shifted to the
cluster's middle so that its differences keep their digits, is solved and X_k
turned by its eigenvectors, and the iterations go on.

A task's state is one matrix of products; only sums of the size of the
covariance reach the driver, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.vectors import by_length, finite

AT_ONCE = 2_048
WIDE = 1 << 53  # whole numbers below it are exact in a double
EXACT = "decimal(38,0)"
LONG = np.longdouble


def _integers(x: np.ndarray, scale: int, shift: int) -> np.ndarray:
    """floor(scale * x) + shift as 64-bit integers, or as Python's where they may not fit."""
    made = np.floor(scale * x)
    if not made.size or np.abs(made).max() < WIDE:
        return made.astype(np.int64) + shift
    return np.array([[int(c) + shift for c in row] for row in made.tolist()], dtype=object)


def _products(y: np.ndarray) -> np.ndarray:
    """y'y, exact: in doubles where all sums are whole numbers below 2 ** 53, else in Python's integers."""
    most = int(np.abs(y).max()) if y.size else 0
    if most * most * len(y) < WIDE:
        z = y.astype(float)
        return (z.T @ z).astype(np.int64).astype(object)
    z = y.astype(object)
    return z.T @ z


def _collected(rows: DataFrame, part) -> dict[int, tuple[int, list]]:  # noqa: ANN001
    """For each vector length: the number of vectors, and the sums of what ``part`` makes of them.

    ``part(length, vectors)`` gives a flat array for some vectors; tasks add theirs up and Spark adds the tasks'.
    """
    schema = pa.schema([("d", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.decimal128(38, 0)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, int] = {}
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in by_length(batch):
                d = x.shape[1]
                for low in range(0, len(x), AT_ONCE):
                    some = x[low : low + AT_ONCE]
                    n[d] = n.get(d, 0) + len(some)
                    total[d] = total.get(d, 0) + part(d, some)
        sums = [[Decimal(int(s)) for s in total[d]] for d in n]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((list(n), list(n.values()), sums), schema, strict=True)], schema=schema)

    made = rows.select("v").mapInArrow(run, f"d int, n long, total array<{EXACT}>")
    sums = made.select("d", "n", F.posexplode("total").alias("at", "x")).groupBy("d", "at").agg(F.sum("n").alias("n"), F.sum("x").cast(EXACT).alias("x"))
    out: dict[int, tuple[int, list]] = {}
    for r in sums.orderBy("d", "at").collect():  # as many rows as the covariance has entries
        out.setdefault(r["d"], (r["n"], []))[1].append(int(r["x"]))
    return out


def _extended(top: int, bottom: int) -> np.longdouble:
    """A quotient of integers in extended precision."""
    high = top / bottom
    return LONG(high) + LONG(float(Fraction(top, bottom) - Fraction(high)))


def _clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Places of ascending ``values``, cut where neighbours are more than ``gap`` apart."""
    return np.split(np.arange(len(values)), np.flatnonzero(np.diff(values) > gap) + 1)


def refined(v: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of a symmetric matrix, by falling eigenvalue, in extended precision."""
    a = np.asarray(v, dtype=LONG)
    size = LONG(np.abs(a).max(initial=0))
    if size == 0:
        return np.zeros(len(a), dtype=LONG), np.eye(len(a), dtype=LONG)
    a = a / size  # float32 holds any scale then
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(LONG)
    one, eps = np.eye(len(a), dtype=LONG), float(np.finfo(LONG).eps)
    for _ in range(rounds):
        r, s = _even(one - x.T @ x), _even(x.T @ a @ x)
        values = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(values, kind="stable")
        x, values, r, s = x[:, order], values[order], r[np.ix_(order, order)], s[np.ix_(order, order)]
        off = float(np.sqrt(((s - np.diag(values)) ** 2).sum()) + np.sqrt((r**2).sum()) * np.sqrt((a**2).sum()))
        gap = max(2 * off, 8 * eps)
        apart = values[None, :] - values[:, None]
        told = np.abs(apart) > gap
        e = np.where(told, (s + values[None, :] * r) / np.where(told, apart, 1), r / 2)
        e = np.triu(e, 1) + np.tril(r - e.T, -1) + np.diag(np.diag(r) / 2)  # e + e' = r keeps the axes orthogonal, whatever the rounding
        x = x + x @ e
        for k in _clusters(values, gap):
            if len(k) > 1:
                x[:, k] = x[:, k] @ _turned(a, x[:, k], values[k].mean())
        if float(np.abs(e).max()) < 4 * eps:
            break
    x = x + x @ (one - x.T @ x) / 2
    values = np.diag(x.T @ a @ x) / np.diag(x.T @ x)
    order = np.argsort(-values, kind="stable")
    return values[order] * size, x[:, order] / np.sqrt((x[:, order] ** 2).sum(axis=0))


def _even(m: np.ndarray) -> np.ndarray:
    return (m + m.T) / 2


def _turned(a: np.ndarray, basis: np.ndarray, middle: np.longdouble) -> np.ndarray:
    """Eigenvectors, made orthonormal in extended precision, of the matrix on a cluster's basis, shifted to the cluster's middle."""
    inner = _even(basis.T @ (a @ basis) - middle * (basis.T @ basis))
    most = np.abs(inner).max()
    w = np.linalg.eigh((inner / (most if most > 0 else 1)).astype(float))[1].astype(LONG)
    return w @ (LONG(1.5) * np.eye(len(w), dtype=LONG) - w.T @ w / 2)


@dataclass(frozen=True)
class Whitening:
    """What is needed to whiten vectors of one length: exact sums, eigenvalues and unit eigenvectors of the largest."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    axes: np.ndarray

    @property
    def centre(self) -> list[int]:
        """The integers next to the means."""
        return [(2 * s + self.n) // (2 * self.n) for s in self.sums]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Whitened integers ``x``, one column per component; NaN where the component has no variance."""
        centre = self.centre
        rest = np.array([float(Fraction(s, self.n) - c) for s, c in zip(self.sums, centre, strict=True)])
        y = (x - np.array(centre, dtype=object if x.dtype == object else np.int64)).astype(float) - rest
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, y @ self.axes / np.sqrt(self.values), np.nan)

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum over the components of (n * x - sum) ** 2, exact."""
        off = [self.n * c - s for s, c in zip(self.sums, self.centre, strict=True)]
        y = x - np.array(self.centre, dtype=object if x.dtype == object else np.int64)
        most = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, off), default=0)
        if most * most * len(off) < 1 << 62:
            return ((self.n * y + np.array(off, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        return ((self.n * y.astype(object) + np.array(off, dtype=object)) ** 2).sum(axis=1).tolist()


def fit(rows: DataFrame, components: int, scale: int, shift: int) -> dict[int, Whitening]:
    """A whitening for each length of the vectors ``v``, learned from all of them."""
    sums = _collected(rows, lambda _, x: _integers(x, scale, shift).astype(object).sum(axis=0))
    centres = {d: np.array([(2 * s + n) // (2 * n) for s in total], dtype=object) for d, (n, total) in sums.items()}

    def products(d: int, x: np.ndarray) -> np.ndarray:
        made, centre = _integers(x, scale, shift), centres[d]
        if made.dtype != object and all(abs(c) < WIDE for c in centre):
            centre = centre.astype(np.int64)
        return _products(made - centre)[np.triu_indices(d)]

    out = {}
    for d, (n, total) in _collected(rows, products).items():
        rest = [s - n * int(c) for s, c in zip(sums[d][1], centres[d], strict=True)]
        v = np.zeros((d, d), dtype=LONG)
        for i, j, p in zip(*np.triu_indices(d), total, strict=True):
            v[i, j] = v[j, i] = _extended(n * p - rest[i] * rest[j], n * n)
        values, axes = refined(v)
        values = np.where(values > 1e-13 * max(values[0], 0), values, 0)[:components].astype(float)
        out[d] = Whitening(n, sums[d][1], float(np.trace(v)), values, axes[:, :components].astype(float))
    return out


def _errors(rows: DataFrame, fits: dict[int, Whitening], scale: int, shift: int) -> dict[int, float]:
    """For each length the largest absolute entry of the whitened vectors' covariance minus the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in by_length(batch):
                d = x.shape[1]
                for low in range(0, len(x), AT_ONCE):
                    w = fits[d].scores(_integers(x[low : low + AT_ONCE], scale, shift))
                    w = np.hstack((w[:, fits[d].values > 0], np.ones((len(w), 1))))  # the last column sums the others
                    total[d] = total.get(d, 0) + (w.T @ w).ravel()
        sums = [x.tolist() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(sums, pa.list_(pa.float64()))], ["d", "total"])

    made = rows.select("v").mapInArrow(run, "d int, total array<double>").select("d", F.posexplode("total").alias("at", "x"))
    sums: dict[int, list[float]] = {}
    for r in made.groupBy("d", "at").agg(F.sum("x").alias("x")).orderBy("d", "at").collect():
        sums.setdefault(r["d"], []).append(r["x"])
    out = {}
    for d, flat in sums.items():
        m = np.array(flat).reshape(int(len(flat) ** 0.5), -1) / fits[d].n
        mean = m[-1, :-1]
        out[d] = float(np.abs(m[:-1, :-1] - np.outer(mean, mean) - np.eye(len(mean))).max(initial=0))
    return out


def whiten(
    vectors: DataFrame, components: int = 8, scale: int = 1024, shift: int = 100_000, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """One row per vector and component: id_col, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or empty, or hold null or non-finite components, are
    left out; all others, zero vectors too, are fitted and whitened.  Components
    are numbered from 1 by falling eigenvalue, at most ``components``, or as
    many as a vector has; axes of equal eigenvalue are some orthonormal basis.
    A component without variance (all of them where there is one vector, or
    copies of one) has a null ``whitened`` and does not count in
    ``identity_error``.  Vectors of different lengths are whitened apart, each
    length with an n and axes of its own.  Repeated rows count, and are
    returned, as often as they occur; null ids too.  An empty table gives no
    rows; other columns, whatever their names, are ignored.  ``deviation`` is a
    decimal; one over 38 digits is an error.  The driver holds one covariance
    per length: memory grows with the square of the length alone.
    """
    rows = vectors.where(finite(vec_col) & (F.size(vec_col) > 0))
    rows = rows.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    fits = fit(rows, components, scale, shift)
    errors = _errors(rows, fits, scale, shift)
    facts = {d: (w.n, errors[d], w.values / w.trace if w.trace > 0 else np.zeros(len(w.values))) for d, w in fits.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, vs in by_length(batch):
                d = vs.shape[1]
                n, error, explained = facts[d]
                k = len(explained)
                for low in range(0, len(vs), AT_ONCE):
                    x = _integers(vs[low : low + AT_ONCE], scale, shift)
                    m = len(x)
                    w = fits[d].scores(x).ravel()
                    deviation = pa.array([Decimal(s) for s in fits[d].deviations(x)], pa.decimal128(38, 0))
                    each = pa.array(np.repeat(np.arange(m), k))
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("id").slice(low, AT_ONCE).take(each),
                            pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                            pa.array(np.full(m * k, n)),
                            deviation.take(each),
                            pa.array(w, mask=np.isnan(w)),
                            pa.array(np.tile(explained, m)),
                            pa.array(np.full(m * k, error)),
                        ],
                        ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                    )

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, component int, n long, deviation {EXACT}, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("id", id_col)
