"""Embedding columns: which vectors take part, their lengths, and bounded samples of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vec_col: str) -> Column:
    """Whether a vector is there and none of its components is null or non-finite."""
    v = F.col(vec_col)
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) with v the components as doubles, one row per id.

    Vectors that are null, empty, zero, or hold null or non-finite components
    are left out, and so are null ids.  Vectors of any length stay; operators
    treat each length as a table of its own.  Of rows repeating an id the one
    with the smallest vector counts.
    """
    rows = df.where(F.col(id_col).isNotNull() & finite(vec_col) & F.exists(vec_col, lambda x: x != 0))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def lengths(rows: DataFrame) -> list[int]:
    """The lengths of the vectors ``v``, ascending: one number per length that occurs."""
    return sorted(r["d"] for r in rows.select(F.size("v").alias("d")).distinct().collect())


def by_length(batch: pa.RecordBatch, column: str = "v") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows of each vector length in turn, and their vectors as a matrix."""
    sizes = pc.list_value_length(batch.column(column))
    for d in pc.unique(sizes).to_pylist():
        part = batch if pc.all(pc.equal(sizes, d)).as_py() else batch.filter(pc.equal(sizes, d))
        yield part, matrix(part.column(column))


def matrix(column) -> np.ndarray:  # noqa: ANN001
    """Rows of an Arrow list column of equal lengths as a double matrix."""
    array = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    if hasattr(array, "num_chunks"):
        array = array.chunk(0)
    return array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), -1) if len(array) else np.empty((0, 0))


def sample(rows: DataFrame, bound: int) -> np.ndarray:
    """At most ``bound`` vectors, those with the smallest hash of their id."""
    got = rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(bound).select("v").toArrow()
    return matrix(got.column("v")) if got.num_rows else np.empty((0, 0))
