"""Near-duplicate texts: SuperMinHash signatures, banding, verification, components.

A document is the set of its distinct word shingles; two are linked when
100 * |A & B| >= percent * |A | B|.  The plan never lists the pairs of a group:

1. One pass over the texts makes signatures.  Documents with equal shingle
   sets are one class from here on, whatever their number.
2. Classes sharing a band meet in a bucket.  Each bucket only offers the edges
   from its smallest member (its centre) to the others; an edge counts when
   the full shingle sets confirm it.
3. The centre sharing the most bands is tried first for each member, then all
   other centres that would join two components.
4. What is left are buckets holding several components.  Members outside the
   centre's component are compared with all members of the buckets around that
   component: block against block, so a task holds two bounded blocks.  Byte
   signatures rule pairs out, the full sets decide, and only links that join
   two components leave the task.  So no pair that shares a bucket is left out
   unless its ends already share a component.

With 40 bands of 5 values a pair at similarity 0.8 misses every bucket with
probability 1e-7; the byte signatures rule out pairs five deviations away.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.blocks import give_back
from marketloom.llm.common import components, numbered, written
from marketloom.llm.sketch import band_keys, bit_sketch, super_minhash
from marketloom.llm.text_arrays import distinct, shingle_hashes, text_slices, word_hashes

SKETCH_WORDS = 4
AT_ONCE = 32_768
BLOCK = 512


def _chunks(sets: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    chunk, size = [], 0
    for s in sets:
        if chunk and size + len(s) > AT_ONCE:
            yield chunk
            chunk, size = [], 0
        chunk.append(s)
        size += len(s)
    if chunk:
        yield chunk


def _shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    hashes, at = word_hashes(texts)
    return [distinct(shingle_hashes(hashes[at[i] : at[i + 1]], words)) for i in range(len(at) - 1)]


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int) -> DataFrame:
    """(id, h, n, s1, s2, keys, sketch, low) per document.

    s1 and s2 identify the shingle set, h the text; low has the signature's lowest bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                sets = _shingle_sets(part.column("text"), words)
                size = np.array([len(s) for s in sets], dtype=np.int64)
                full = [s for s in sets if len(s)]
                made = [super_minhash(c, bands * rows) for c in _chunks(full)]
                sig = np.concatenate(made) if made else np.empty((0, bands * rows), dtype=np.uint32)
                keys = np.zeros((len(sets), bands), dtype=np.int64)
                bits = np.zeros((len(sets), SKETCH_WORDS), dtype=np.int64)
                keys[size > 0] = band_keys(sig, bands)
                bits[size > 0] = bit_sketch(sig, SKETCH_WORDS)
                low = np.full(len(sets), b"", dtype=object)
                low[size > 0] = [row.tobytes() for row in (sig & np.uint32(255)).astype(np.uint8)]
                with np.errstate(over="ignore"):
                    s1 = np.array([int(s.sum(dtype=np.uint64)) for s in sets], dtype=np.uint64).view(np.int64)
                    s2 = np.array([int(np.bitwise_xor.reduce(s * (s | np.uint64(1)))) for s in sets], dtype=np.uint64).view(np.int64)
                lists = [
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                    for x in (keys, bits)
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("h"), pa.array(size), pa.array(s1), pa.array(s2), *lists, pa.array(low, pa.binary())],
                    ["id", "h", "n", "s1", "s2", "keys", "sketch", "low"],
                )
        give_back()

    rows_in = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    return rows_in.mapInArrow(run, "id long, h long, n long, s1 long, s2 long, keys array<long>, sketch array<long>, low binary")


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ``pairs`` (a, ha, b, hb) whose full shingle sets are similar enough; h tells an id's texts apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "ta"):
                good = []
                for x, y in zip(_shingle_sets(part.column("ta"), words), _shingle_sets(part.column("tb"), words), strict=True):
                    both = len(x) + len(y) - len(distinct(np.concatenate((x, y))))
                    good.append(100 * both >= percent * (len(x) + len(y) - both))
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
        give_back()

    left = texts.select(F.col("id").alias("a"), F.col("h").alias("ha"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("h").alias("hb"), F.col("text").alias("tb"))
    return pairs.join(left, ["a", "ha"]).join(right, ["b", "hb"]).select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _joining(around: DataFrame, reps: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between components among the rows (main, id, h, comp) of each ``main``.

    Rows outside the component ``main`` are compared with all rows of their
    ``main``, in blocks of about BLOCK rows a side.
    """
    sizes = around.groupBy("main").agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("comp") != F.col("main")).alias("out"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    sizes = written(sizes.select("main", blocks("all").alias("nr"), blocks("out").alias("nl")))
    rows = around.join(reps.select("id", "h", "low"), ["id", "h"]).join(texts, ["id", "h"]).join(sizes, "main")
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["main", "id", "comp", "low", "text"]
    left = rows.where("comp <> main").select(*cols, place("nl").alias("l"), every("nr").alias("r"))
    right = rows.select(*cols, place("nr").alias("r"), every("nl").alias("l"))
    right = right.toDF(*right.columns)  # fresh columns, so the two sides are told apart

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        found = _links_between(x, y, words, percent) if x.num_rows and y.num_rows else []
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return left.groupBy("main", "l", "r").cogroup(right.groupBy("main", "l", "r")).applyInArrow(run, "a long, b long")


def _links_between(x: pa.Table, y: pa.Table, words: int, percent: int) -> list[tuple[int, int]]:
    """Confirmed links from rows of x to rows of y that join components, most similar first."""
    facts = []
    for t in (x, y):
        low = np.frombuffer(b"".join(t.column("low").to_pylist()), dtype=np.uint8).reshape(t.num_rows, -1)
        facts.append((low, t.column("id").to_pylist(), t.column("comp").to_pylist()))
    (lx, ix, cx), (ly, iy, cy) = facts
    m, j = lx.shape[1], percent / 100
    least = m * (j - 5.5 * (j * (1 - j) / m) ** 0.5)
    sets: dict[tuple[int, int], np.ndarray] = {}
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.get(c, c) != c:
            c = parent[c]
        return c

    def shingled(side: int, table: pa.Table, i: int) -> np.ndarray:
        if (side, i) not in sets:
            sets[side, i] = _shingle_sets(table.column("text").slice(i, 1), words)[0]
        return sets[side, i]

    pairs = []
    for i in range(len(lx)):
        same = (ly == lx[i]).sum(axis=1)
        pairs += [(-int(same[k]), i, int(k)) for k in np.flatnonzero(same >= least)]
    out = []
    for _, i, k in sorted(pairs):
        if root(cx[i]) == root(cy[k]):
            continue
        p, q = shingled(0, x, i), shingled(1, y, k)
        both = len(p) + len(q) - len(distinct(np.concatenate((p, q))))
        if 100 * both >= percent * (len(p) + len(q) - both):
            out.append((ix[i], iy[k]))
            parent[root(cx[i])] = root(cy[k])
    return out


def _similar(percent: int) -> F.Column:
    """Join condition over x and y: sizes allow the link and the bit sketches do not rule it out."""
    total = SKETCH_WORDS * 64
    j = percent / 100
    differ = (1 - j) / 2  # share of sketch bits that differ at the threshold
    used = 200
    most = used * differ + 6.5 * (used * differ * (1 - differ)) ** 0.5
    gap = sum((F.bit_count(F.col("x.sketch")[i].bitwiseXOR(F.col("y.sketch")[i])) for i in range(SKETCH_WORDS)), F.lit(0))
    sizes = 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")
    return sizes & (gap <= F.lit(min(total, int(most) + 1)))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 80,
    bands: int = 40,
    rows: int = 5,
) -> DataFrame:
    """One row per document: id_col, n_shingles, component_id, kept, text_hash.

    component_id is the smallest id reachable over links, the own id included;
    kept tells whether it is the own id.  Texts without words (null, empty,
    white space) have no shingles and no links.  Rows with a null id are not
    linked: component_id is null, kept true.  Repeated rows are reported once
    each, with the same values.  An id with several texts is one document: it is
    linked with what any of its texts is linked with, and its rows have one
    component but an n_shingles each.  Texts of any length are compared whole;
    sets at exactly ``percent`` are linked.  An empty table gives an empty
    result; columns beside the two named ones are ignored.
    """
    sig = written(signatures(docs, id_col, text_col, words, bands, rows))
    valid = sig.where("n > 0 and id is not null")
    # a class, of equal shingle sets, is led by its smallest id, with that id's text of the smallest hash
    classes = written(valid.groupBy("s1", "s2", "n").agg(F.min(F.struct("id", "h")).alias("lead")).select("s1", "s2", "n", "lead.*"))
    reps = valid.join(classes.select("id", "h", "s1", "s2"), ["id", "h", "s1", "s2"], "left_semi")
    reps = written(reps.dropDuplicates(["id", "h"]).select("id", "h", "n", "keys", "sketch", "low"))
    # an id of several classes joins their leaders
    several = valid.groupBy("id").agg(F.min("s1").alias("low"), F.max("s1").alias("high")).where("low <> high").select("id")
    leads = classes.select("s1", "s2", "n", F.col("id").alias("b"))
    same_id = valid.select("id", "s1", "s2", "n").join(several, "id").join(leads, ["s1", "s2", "n"]).select(F.col("id").alias("a"), "b")

    in_band = reps.select("id", "h", F.explode("keys").alias("key"))
    shared = in_band.groupBy("key").agg(F.min(F.struct("id", "h")).alias("c"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(shared.select("key", F.col("c.id").alias("centre"), F.col("c.h").alias("hc")))
    members = written(in_band.join(shared, "key"))
    ids = members.select("id", "h").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    texts = written(texts.join(ids, ["id", "h"], "left_semi").groupBy("id", "h").agg(F.min("text").alias("text")))

    star = members.where("id <> centre or h <> hc").groupBy("id", "h", "centre", "hc").agg(F.count(F.lit(1)).alias("c"))
    star = written(star)
    pair = lambda df: df.select(F.col("centre").alias("a"), F.col("hc").alias("ha"), F.col("id").alias("b"), F.col("h").alias("hb"))
    first = star.groupBy("id", "h").agg(F.max_by(F.struct("centre", "hc"), "c").alias("x")).select("id", "h", "x.*")
    links = written(_confirmed(pair(first), texts, words, percent).union(same_id))

    label = written(components(links))
    own = label.select(F.col("node").alias("id"), F.col("component").alias("ci"))
    hub = label.select(F.col("node").alias("centre"), F.col("component").alias("cc"))
    rest = star.join(own, "id", "left").join(hub, "centre", "left")
    rest = written(rest.where(F.coalesce("ci", "id") != F.coalesce("cc", "centre")).select("id", "h", "centre", "hc"))
    if not rest.isEmpty():
        x, y = reps.select("id", "h", "n", "sketch"), reps.select(F.col("id").alias("centre"), F.col("h").alias("hc"), "n", "sketch")
        close = rest.join(x.alias("x"), ["id", "h"]).join(y.alias("y"), ["centre", "hc"]).where(_similar(percent))
        more = written(_confirmed(pair(close), texts, words, percent))
        if not more.isEmpty():
            links = written(links.union(more))
            label = written(components(links))

    own = label.select(F.col("node").alias("id"), F.col("component").alias("ci"))
    placed = members.join(own, "id", "left").select("key", "id", "h", "centre", F.coalesce("ci", "id").alias("comp"))
    hub = label.select(F.col("node").alias("centre"), F.col("component").alias("cc"))
    placed = written(placed.join(hub, "centre", "left").withColumn("main", F.coalesce("cc", "centre")).drop("cc"))
    open_keys = written(placed.where("comp <> main").select("key").distinct())
    if not open_keys.isEmpty():
        around = placed.join(open_keys, "key", "left_semi").groupBy("main", "id", "h").agg(F.min("comp").alias("comp"))
        more = written(_joining(written(around), reps, texts, words, percent))
        if not more.isEmpty():
            label = components(links.union(more))

    label = label.select(F.col("node").alias("id"), F.col("component").alias("root"))
    classes = written(classes.join(label, "id", "left").select("s1", "s2", "n", F.coalesce("root", "id").alias("component_id")))
    out = sig.select("id", "h", "n", "s1", "s2").join(classes, ["s1", "s2", "n"], "left")
    component = F.when(F.col("n") == 0, F.col("id")).when(F.col("id").isNull(), None).otherwise(F.col("component_id"))
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("h").alias("text_hash"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id.

    Of rows repeating an id and a text one stays.  Documents without words, and
    rows with a null id, stay.  Other columns, whatever their names, come along.
    """
    names, rows = docs.columns, numbered(docs)
    key, text = (f"c{names.index(c)}" for c in (id_col, text_col))
    judged = near_duplicates(rows, key, text, words, percent)
    fate = judged.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id"), F.col("text_hash").alias("h"))
    fate = written(fate.agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("copies")).where("not kept or copies > 1"))
    marked = rows.withColumn("hash", F.xxhash64(text))
    marked = marked.join(fate, (F.col(key) == F.col("id")) & (F.col("hash") == F.col("h")), "left")
    once = marked.where("kept is null").select(*rows.columns)
    if fate.where("kept").isEmpty():
        return once.toDF(*names)
    return once.union(marked.where("kept").dropDuplicates(["id", "h"]).select(*rows.columns)).toDF(*names)
