"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine c are at squared distance 2 (1 - c).  After a learned
rotation the vectors are cut into blocks; the squared-distance budget is shared
out in proportion to the blocks' energy, so a close pair keeps within the
budget in at least one block.  Each block is a range join: a grid over the
block's two widest dimensions, cells as wide as the budget's root, so partners
lie in the same or an adjacent cell.  A cell's rows stay at home once and visit
the cells on one side.  Cells are cut into bounded chunks, and a chunk is one
packed row of ids and of the block's coordinates in bytes: those are what is
sent, not the vectors, since a chunk meets all others of its cells.  A chunk at
home and the visiting chunks of one number are one group: small matrix products
tell which rows have a partner within budget, the rounding allowed for.  Those
rows alone are joined with their vectors and meet again in the same group, which
confirms the links.  A confirmed pair counts
in the first block in which it keeps within budget, so nothing counts twice.
Groups return link counts per vector and a spanning forest of their links, not
the pairs.  Equal vectors, told by 128 bits of hash, are one class with a weight.
Vectors of each length are a table of their own, with a rotation of its own.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.blocks import apart, packed_sorted, several, unpacked_sorted
from marketloom.llm.common import components, written
from marketloom.llm.vectors import finite, lengths, matrix, sample
from marketloom.sources.work import spread

BLOCKS, CHUNK, STRIP = 4, 4_096, 512  # a chunk of vectors
PACKED, AT_ONCE = 1 << 16, 1 << 21  # rows of a packed chunk, pairs of packed rows looked at together
STEPS = 16  # steps of a packed coordinate in the root of its block's budget
PAIRS_AT_ONCE = 1 << 16


@dataclass(frozen=True)
class Subspaces:
    """Rotation, the dimensions of each block (widest first), and its squared budget."""

    rotation: np.ndarray
    dims: list[np.ndarray]
    budget: np.ndarray

    def turned(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors in rotated coordinates."""
        return x / np.linalg.norm(x, axis=1, keepdims=True) @ self.rotation

    def keeps(self, difference: np.ndarray, block: int) -> np.ndarray:
        """Which rows of coordinate differences keep within a block's budget."""
        return (difference[:, self.dims[block]] ** 2).sum(axis=1) <= self.budget[block]

    def step(self, block: int) -> float:
        """What one step of a block's packed coordinates is; those of unit vectors fit a signed byte."""
        return max(float(np.sqrt(self.budget[block])) / STEPS, 1 / 127)

    def codes(self, turned: np.ndarray, block: int) -> np.ndarray:
        """A block's coordinates in steps."""
        return np.clip(np.rint(turned[:, self.dims[block]] / self.step(block)), -127, 127).astype(np.int8)

    def reach(self, block: int) -> float:
        """The squared distance in steps that no pair within a block's budget exceeds: rounding moves a difference by a step at most in each dimension."""
        return float((np.sqrt(self.budget[block] + 1e-9) / self.step(block) + np.sqrt(len(self.dims[block])) * (1 + 1e-9)) ** 2)


def fit(x: np.ndarray, cosine: float, blocks: int = BLOCKS) -> Subspaces:
    """Principal axes of sample rows dealt over blocks, and budgets by energy."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    y = u - u.mean(axis=0)
    values, rotation = np.linalg.eigh(y.T @ y)
    values, rotation = np.maximum(values[::-1], 0), rotation[:, ::-1]
    dims = [np.arange(b, x.shape[1], blocks) for b in range(min(blocks, x.shape[1]))]
    energy = np.array([values[d].sum() for d in dims]) + 1e-12
    return Subspaces(rotation, dims, (2 * (1 - cosine) + 1e-9) * energy / energy.sum())


def _cells(model: Subspaces):  # noqa: ANN202
    wide = np.sqrt(model.budget) * (1 + 1e-9)

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            if batch.num_rows == 0:
                continue
            t = model.turned(matrix(batch.column("v")).astype(float))
            for b, d in enumerate(model.dims):
                cell = np.floor(t[:, [d[0], d[min(1, len(d) - 1)]]] / wide[b]).astype(np.int32)
                code = pa.array([row.tobytes() for row in model.codes(t, b)], pa.binary())
                columns = [batch.column("id"), pa.array(np.full(len(t), b, dtype=np.int32)), pa.array(cell[:, 0]), pa.array(cell[:, 1]), code]
                yield pa.RecordBatch.from_arrays(columns, ["id", "b", "cx", "cy", "code"])

    return run


def _chunk(table: pa.Table) -> pa.Table:
    """The rows of a chunk as one: ids in order, and their codes dimension by dimension."""
    ids = table.column("id").to_numpy().view(np.uint64)
    order = np.argsort(ids)
    codes = np.frombuffer(b"".join(table.column("code").to_pylist()), dtype=np.int8).reshape(len(ids), -1)[order]
    blob = several(packed_sorted(ids[order]), zstandard.compress(np.ascontiguousarray(codes.T).tobytes(), 1))
    return table.select(["b", "cx", "cy", "c"]).slice(0, 1).append_column("blob", pa.array([blob], pa.binary()))


def _opened(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids and codes of a packed chunk; products of codes in single precision are exact."""
    ids, codes = apart(blob)
    ids = unpacked_sorted(ids).view(np.int64)
    return ids, np.frombuffer(zstandard.decompress(codes), dtype=np.int8).reshape(-1, len(ids)).T.astype(np.float32)


def _near(model: Subspaces):  # noqa: ANN202
    schema = pa.schema([("b", pa.int32()), ("ox", pa.int32()), ("oy", pa.int32()), ("l", pa.int32()), ("r", pa.int32()), ("id", pa.int64()), ("visits", pa.bool_()), ("same", pa.bool_())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        least = np.float32(-model.reach(left.column("b")[0].as_py()) / 2)
        (iy, y), one = _opened(right.column("blob")[0].as_py()), np.float32(1)
        y = np.column_stack([y, np.full(len(y), one), -(y**2).sum(axis=1) / 2])
        home, rows = np.zeros(len(y), dtype=bool), []
        for blob, same in zip(left.column("blob").to_pylist(), left.column("same").to_pylist(), strict=True):
            ix, x = _opened(blob)
            x = np.column_stack([x, -(x**2).sum(axis=1) / 2, np.full(len(x), one)])
            own, low = np.zeros(len(x), dtype=bool), 0
            while low < len(x):
                first = low if same else 0  # of a chunk that meets itself each pair once
                strip = x[low : low + max(1, AT_ONCE // (len(y) - first))]
                hit = strip @ y[first:].T >= least  # minus half the squared distance
                if same:
                    np.fill_diagonal(hit, False)
                if hit.any():
                    own[low : low + len(strip)] |= hit.any(axis=1)
                    home[first:] |= hit.any(axis=0)
                    if same:
                        own[first:] |= hit.any(axis=0)
                        home[low : low + len(strip)] |= hit.any(axis=1)
                low += len(strip)
            rows.append((ix[own], True, same))
        rows.append((iy[home], False, False))
        sizes = [len(ids) for ids, _, _ in rows]
        key = [pa.array(np.full(sum(sizes), left.column(c)[0].as_py(), dtype=np.int32)) for c in ("b", "ox", "oy", "l", "r")]
        flags = [pa.array(np.repeat([row[k] for row in rows], sizes), pa.bool_()) for k in (1, 2)]
        return pa.table([*key, pa.array(np.concatenate([ids for ids, _, _ in rows]), pa.int64()), *flags], schema=schema)

    return run


def _linked(model: Subspaces, cosine: float):  # noqa: ANN202
    schema = pa.schema([("a", pa.int64()), ("n", pa.int64()), ("b", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        block = left.column("b")[0].as_py()
        (x, ix, wx), (y, iy, wy) = ((matrix(t.column("v")).astype(float), t.column("id").to_numpy(), t.column("weight").to_numpy()) for t in (left, right))
        nx, ny, tx, ty = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1), model.turned(x), model.turned(y)
        px, py = tx[:, model.dims[block]], ty[:, model.dims[block]]
        same = np.asarray(left.column("same").to_numpy(), dtype=bool)  # visitors that are home rows too: each pair once
        own, other, squares = [], [], (py**2).sum(axis=1)
        for low in range(0, len(x), STRIP):
            strip = px[low : low + STRIP]
            far = (strip**2).sum(axis=1)[:, None] + squares[None, :] - 2 * strip @ py.T
            i, j = np.nonzero(far <= model.budget[block] + 1e-9)
            i += low
            once = ~same[i] | (ix[i] < iy[j])
            i, j = i[once], j[once]
            for at in range(0, len(i), PAIRS_AT_ONCE):
                p, q = i[at : at + PAIRS_AT_ONCE], j[at : at + PAIRS_AT_ONCE]
                ok = (x[p] * y[q]).sum(axis=1) / (nx[p] * ny[q]) >= cosine
                p, q = p[ok], q[ok]
                difference = tx[p] - ty[q]
                ok = model.keeps(difference, block)
                for earlier in range(block):
                    ok &= ~model.keeps(difference, earlier)
                own.append(p[ok])
                other.append(q[ok])
        i, j = (np.concatenate([np.empty(0, dtype=np.int64), *z]) for z in (own, other))
        counts: dict[int, int] = {}
        for ids, own, other, weights in ((ix, i, j, wy), (iy, j, i, wx)):
            n = np.bincount(own, weights[other], len(ids)).astype(np.int64)
            for k in np.flatnonzero(n):
                counts[int(ids[k])] = counts.get(int(ids[k]), 0) + int(n[k])
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while parent.get(c, c) != c:
                parent[c] = parent.get(parent[c], parent[c])
                c = parent[c]
            return c

        edges = []
        for a, b in zip(ix[i].tolist(), iy[j].tolist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                edges.append((a, b))
        columns = [[*counts, *(a for a, _ in edges)], [*counts.values(), *[None] * len(edges)], [*[None] * len(counts), *(b for _, b in edges)]]
        return pa.table([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return run


def _found(reps: DataFrame, weights: DataFrame, model: Subspaces, cosine: float) -> DataFrame:
    """(a, n, b) of vectors of one length: the number n of links of a, or a link from a to b of a spanning forest; weights: id and weight, where it is not 1."""
    placed = written(reps.mapInArrow(_cells(model), "id long, b int, cx int, cy int, code binary"))
    cells = written(placed.groupBy("b", "cx", "cy").agg(F.ceil(F.count(F.lit(1)) / PACKED).cast("int").alias("n")))
    # cells on one side of a cell, and itself, visit it
    steps = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))))
    near = cells.select("b", "cx", "cy", F.col("n").alias("nl"), F.inline(steps)).alias("p")
    other = cells.select("b", F.col("cx").alias("ox"), F.col("cy").alias("oy"), F.col("n").alias("nr")).alias("o")
    on = (F.col("p.b") == F.col("o.b")) & (F.col("cx") + F.col("dx") == F.col("ox")) & (F.col("cy") + F.col("dy") == F.col("oy"))
    pairs = written(near.join(other, on).select("p.b", "cx", "cy", "ox", "oy", "nl", "nr", ((F.col("dx") == 0) & (F.col("dy") == 0)).alias("own")))
    homes = pairs.groupBy("b", "ox", "oy", "nr").agg(F.max("nl").alias("nl"))
    key = ["b", "ox", "oy", "l", "r"]
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    number = F.pmod(F.xxhash64("id"), F.col("n")).cast("int")
    chunks = placed.join(cells, ["b", "cx", "cy"]).select("b", "cx", "cy", number.alias("c"), "id", "code")
    chunks = written(chunks.groupBy("b", "cx", "cy", "c").applyInArrow(_chunk, "b int, cx int, cy int, c int, blob binary"))
    left = chunks.join(pairs, ["b", "cx", "cy"]).select("b", "ox", "oy", F.col("c").alias("l"), all_of("nr").alias("r"), "blob", "own")
    left = left.where(~F.col("own") | (F.col("l") <= F.col("r"))).withColumn("same", F.col("own") & (F.col("l") == F.col("r"))).drop("own")
    there = chunks.select("b", F.col("cx").alias("ox"), F.col("cy").alias("oy"), F.col("c").alias("r"), "blob")
    right = there.join(homes, ["b", "ox", "oy"]).select("b", "ox", "oy", all_of("nl").alias("l"), "r", "blob")
    right = right.toDF(*right.columns)
    # packed rows are few and small, but much work: dealt over all partitions
    met = spread(left, *key).groupBy(*key).cogroup(spread(right, *key).groupBy(*key))
    met = written(met.applyInArrow(_near(model), "b int, ox int, oy int, l int, r int, id long, visits boolean, same boolean"))
    vectors = reps.join(written(met.select("id").distinct()), "id", "left_semi").join(weights, "id", "left")
    vectors = written(vectors.select("id", "v", F.coalesce("weight", F.lit(1)).cast("long").alias("weight")))
    # a group of more than CHUNK rows on a side is cut once more
    sizes = met.groupBy(*key).agg(F.ceil(F.greatest(F.count_if("visits"), F.count_if(~F.col("visits"))) / CHUNK).cast("int").alias("k"))
    met = met.join(sizes, key).withColumn("own", F.pmod(F.xxhash64("id", F.lit(1)), F.col("k")).cast("int")).withColumn("their", all_of("k"))
    met = met.withColumn("u", F.when(F.col("visits"), F.col("own")).otherwise(F.col("their"))).withColumn("w", F.when(F.col("visits"), F.col("their")).otherwise(F.col("own")))
    key += ["u", "w"]
    met = met.select(*key, "id", "visits", "same").join(vectors, "id")
    left, right = met.where("visits").drop("visits"), met.where("not visits").drop("visits", "same")
    right = right.toDF(*right.columns)
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_linked(model, cosine), "a long, n long, b long")


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) as ``vectors.usable`` gives them, components as stored, by one pass that shuffles the rows of repeated ids alone."""
    rows = vectors.where(F.col(id_col).isNotNull() & finite(vec_col) & F.exists(vec_col, lambda x: x != 0))
    kind = vectors.select(vec_col).schema[0].dataType.simpleString()
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind if kind == "array<float>" else "array<double>").alias("v"))
    several_ = written(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"))
    if several_.isEmpty():
        return rows
    least = rows.join(several_, "id", "left_semi").groupBy("id").agg(F.min("v").alias("v"))
    return rows.join(several_, "id", "left_anti").union(least)


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", fit_rows: int = 8_000) -> DataFrame:
    """One row per vector: id_col, n_links, component_id, kept.

    n_links counts the other vectors with cosine >= ``cosine`` in double
    precision; component_id is the smallest id reachable over links, the own id
    included; kept tells whether it is the own id.  Vectors that are null,
    empty, zero, or hold null or non-finite components have no links and are
    their own component; a null id has a null component and is kept.  Vectors
    of different lengths have no cosine and no link.  Repeated ids are one
    vector, the smallest, reported once per row.  A pair at exactly ``cosine``
    is linked.  Other columns are ignored; an empty table gives no rows.  The
    table is read several times rather than copied.
    """
    rows = _usable(vectors, id_col, vec_col)
    hashes = written(rows.select("id", F.xxhash64("v").alias("h"), F.xxhash64("v", F.lit(1)).alias("g")))
    classes = written(hashes.groupBy("h", "g").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight")).where("weight > 1"))
    copies = written(hashes.join(classes, ["h", "g"]).where("id <> rep").select("id", "rep"))
    weights = classes.select(F.col("rep").alias("id"), "weight")
    reps = rows.join(copies.select("id"), "id", "left_anti")
    every = vectors.select(F.col(id_col).cast("long").alias("id"))
    parts = []
    for d in lengths(reps):
        mine = reps.where(F.size("v") == d)
        parts.append(_found(mine, weights, fit(sample(mine, fit_rows).astype(float), cosine), cosine))
    if not parts:
        out = every.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
        return out.withColumn("kept", F.lit(True)).withColumnRenamed("id", id_col)
    found = written(reduce(DataFrame.union, parts))
    links = found.where("n is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    label = components(found.where("b is not null").select("a", "b")).select(F.col("node").alias("rep"), F.col("component").alias("root"))
    facts = links.join(label, "rep", "full").join(weights.withColumnRenamed("id", "rep"), "rep", "full")
    facts = written(facts.select("rep", (F.coalesce("weight", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("root", "rep").alias("root")))
    # an id has facts of its own or those of the class it copies
    known = facts.select(F.col("rep").alias("id"), "links", "root").union(copies.join(facts, "rep").select("id", "links", "root"))
    out = every.join(known, "id", "left").select("id", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))).withColumnRenamed("id", id_col)
