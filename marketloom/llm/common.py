"""Shared Spark plumbing: written intermediate tables, ranks, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketloom.sources.work import clear_written, shared_dir, written

__all__ = ["clear_written", "components", "numbered", "ranked", "shared_dir", "unused", "written"]


def unused(name: str, columns: list[str]) -> str:
    """``name`` behind as many underscores as it takes to differ from all ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def numbered(df: DataFrame) -> DataFrame:
    """The columns renamed c0, c1, ... so that no name of theirs can clash or needs quoting."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def ranked(df: DataFrame, group: list[str], order: list[Column], name: str, slices: int = 64, part: Column | None = None) -> DataFrame:
    """Add each row's 0-based rank within its group, without one task per group.

    Rows of a group are dealt over ``slices`` by a hash of the ordering columns;
    slices are numbered one after the other.  The order is the slice, then
    ``order``: fixed for given rows, and ties differ only among equal rows.  A
    ``part`` that never falls along ``order`` is taken as the slice; ranks then
    follow ``order``.
    """
    rows = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices)) if part is None else part)
    sizes = rows.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*group, "_slice").orderBy(*order)
    rows = rows.withColumn("_row", F.row_number().over(inside) - 1)
    # plain equality keeps the window's partitioning for the join
    same = [rows[c].eqNullSafe(starts[c]) if rows.schema[c].nullable else rows[c] == starts[c] for c in group] + [rows["_slice"] == starts["_slice"]]
    on = same[0]
    for c in same[1:]:
        on = on & c
    kept = [rows[c] for c in rows.columns if c not in ("_slice", "_row")]
    return rows.join(starts, on).select(*kept, (F.col("_before") + F.col("_row")).alias(name))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; a component is its smallest node.

    Alternates the large-star and small-star steps until the edges are stars.
    Each step is one aggregation and one join on written tables, which the
    adaptive planner can split where a node has very many edges.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a <> b").distinct())
        least = written(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == now:
            break
        state = now
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
