"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

A source of weight w (its share of the target) is cut into blocks; its k-th
block (from 1) may not run before slot floor((k-1)/w) and must have run by slot
ceil(k/w).  Serving the released block with the earliest deadline in each slot
meets every deadline, so at any slot each source is less than one block away
from its share.  With whole-number weights the schedule repeats after their
sum, so one cycle is simulated and blocks look up their slot in it.  When a
source has no blocks left, a new phase goes on with the others at their weights.
Sources without a weight of their own share one pool, which is scheduled like a
source; within it documents follow each other in hash order, so it serves its
sources in proportion to their sizes.  So the plan is bounded by the weights
given (phases times cycle, and never more slots than there are blocks), however
many sources the documents have.  No row is dropped or repeated.
"""

from __future__ import annotations

import heapq
import json
import re
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.common import numbered, ranked, unused

_PLAN = "array<struct<source:string,first:bigint,last:bigint,per_cycle:bigint,cycle:bigint,start:bigint,phase:int,slots:array<bigint>>>"


def cycle_of(weights: list[int], left: list[int] | None = None) -> list[int]:
    """For one cycle of sum(weights) slots, the index of the source served in each.

    With ``left`` (blocks per source) it ends before the first slot whose source has none.
    """
    total = sum(weights)
    ready: list[tuple[int, int, int]] = []  # deadline, source, k
    waiting = [(0, i, 1) for i, w in enumerate(weights) if w]  # release, source, k
    heapq.heapify(waiting)
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-k * total // weights[i]), i, k))
        _, i, k = heapq.heappop(ready)
        if left is not None and k > left[i]:
            break
        out.append(i)
        heapq.heappush(waiting, (k * total // weights[i], i, k + 1))
    return out


def schedule(blocks: dict[str, int], weights: dict[str, int]) -> list[dict]:
    """Plan rows: blocks first..last-1 of a source lie in a phase's cycles at ``slots``."""
    left = {s: n for s, n in blocks.items() if n}
    done = dict.fromkeys(left, 0)
    out, start, phase = [], 0, 0
    while left:
        names = sorted(left)
        own = [weights[s] for s in names]
        full = min(left[s] // weights[s] for s in names)
        # whole cycles, then one that ends when a source has no block left
        served = cycle_of(own, None if full else [left[s] for s in names])
        slots: list[list[int]] = [[] for _ in names]
        for t, i in enumerate(served):
            slots[i].append(t)
        rest = [left[s] - full * w for s, w in zip(names, own, strict=True)]
        part = min((x[r] for x, r in zip(slots, rest, strict=True) if r < len(x)), default=len(served))
        for s, w, x in zip(names, own, slots, strict=True):
            n = full * w + bisect_left(x, part)
            if n:
                out.append({"source": s, "first": done[s], "last": done[s] + n, "per_cycle": w, "cycle": sum(own)}
                           | {"start": start, "phase": phase, "slots": x})
            done[s] += n
            left[s] -= n
        start += full * sum(own) + part
        phase += 1
        left = {s: n for s, n in left.items() if n}
    return out


def _plan_frame(spark: SparkSession, plan: list[dict]) -> DataFrame:
    """The plan as a frame made of one literal (its size is bounded by the sources and the cycle)."""
    rows = F.from_json(F.lit(json.dumps(plan)), _PLAN)
    return spark.range(1).select(F.inline(rows))


def mix(
    docs: DataFrame,
    weights: dict[str, int],
    default_weight: int = 1,
    block: int = 8,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """``docs`` with five more columns at the end; ordering by the last, _position, is the mix.

    They are _phase, _block (of the row's source), _slot, _share (the part of
    the mix before the slot) and _position; where ``docs`` has such a column
    already it stays, and the new one gets a further underscore in front.
    ``weights`` are whole numbers in proportion to the target; all sources not
    named (null is one of them) are one pool of weight ``default_weight``.
    Documents of a source follow each other in hash order of their ids, so
    repeated rows and null ids are placed like any row, and texts are not read.
    _position rises along the mix; the last block of a source may leave a gap.
    An empty table stays empty.  Weights below 1 are an error.
    """
    if any(w < 1 for w in (*weights.values(), default_weight)):
        raise ValueError("weights must be 1 or more")
    spark, names = docs.sparkSession, docs.columns
    rows = numbered(docs)
    id_, source = (f"c{names.index(c)}" for c in (id_col, source_col))
    text = F.col(source).cast("string")
    pool = "others"
    while pool in weights:
        pool += "*"
    own = weights | {pool: default_weight}
    rows = rows.withColumn("_source", F.coalesce(F.when(text.isin(list(weights)), text), F.lit(pool)) if weights else F.lit(pool))
    sizes = rows.groupBy("_source").agg(F.count(F.lit(1)).alias("_n"))
    counts = {r[0]: r[1] for r in sizes.collect()}  # one row more than weights at most
    plan = _plan_frame(spark, schedule({s: -(-n // block) for s, n in counts.items()}, own))
    slices = max(64, sum(counts.values()) // 100_000)
    rows = ranked(rows, ["_source"], [F.xxhash64(id_), F.col(id_)], "_rank", slices)
    rows = rows.withColumn("_block", F.floor(F.col("_rank") / block))
    here = (rows["_source"] == plan["source"]) & (rows["_block"] >= plan["first"]) & (rows["_block"] < plan["last"])
    step = F.col("_block") - plan["first"]
    slot = plan["start"] + F.floor(step / plan["per_cycle"]) * plan["cycle"] + F.get(plan["slots"], (step % plan["per_cycle"]).cast("int"))
    out = rows.join(F.broadcast(plan), here).withColumn("_slot", slot.cast("long"))
    slots = sum(-(-n // block) for n in counts.values())
    share, position = F.col("_slot") / F.lit(float(max(slots, 1))), F.col("_slot") * block + F.col("_rank") % block
    kept = [F.col(f"c{i}") for i in range(len(names))]
    out = out.select(*kept, "phase", F.col("_block").cast("long"), "_slot", share, position)
    added = []
    for name in ("_phase", "_block", "_slot", "_share", "_position"):
        added.append(unused(name, [*names, *added]))
    return out.toDF(*names, *added)


def in_order(mixed: DataFrame) -> DataFrame:
    """The rows of ``mix`` laid out by their last column: partition after partition, sorted within.

    Positions are dense but for small gaps, so equal ranges of them hold about
    equally many rows and no sampling pass is needed.
    """
    spark, names = mixed.sparkSession, mixed.columns
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = numbered(mixed)
    share, position = (f"c{len(names) - i}" for i in (2, 1))
    return rows.repartitionById(parts, F.floor(F.col(share) * parts).cast("int")).sortWithinPartitions(position).toDF(*names)


def laid_out(docs: DataFrame) -> DataFrame:
    """Rows read from Parquet files that ``in_order`` was written to, and at the end _place, their 0-based place in that order.

    Files are numbered by partition and keep their rows in order, so the counts
    per file (as many as partitions were written) place every row.  A column
    that is called _place already stays, and the new one gets a further
    underscore in front.
    """
    file = docs.metadataColumn("_metadata")
    place, mine, row = (unused(c, docs.columns) for c in ("_place", "_file_of", "_row_of"))
    rows = docs.select("*", file.getField("file_path").alias(mine), file.getField("row_index").alias(row))
    rows = numbered(rows)
    mine, row = (f"c{len(docs.columns) + i}" for i in (0, 1))
    sizes = [(r[0], r[1]) for r in rows.groupBy(mine).agg(F.count(F.lit(1)).alias("n")).collect()]
    starts, before = [], 0
    for path, n in sorted(sizes, key=lambda x: (int(re.search(r"part-(\d+)[^/]*$", x[0])[1]), x[0])):
        starts.append({"_file": path, "_before": before})
        before += n
    found = F.from_json(F.lit(json.dumps(starts)), "array<struct<_file:string,_before:bigint>>")
    starts = docs.sparkSession.range(1).select(F.inline(found))
    kept = [F.col(f"c{i}") for i in range(len(docs.columns))]
    out = rows.join(F.broadcast(starts), F.col(mine) == F.col("_file")).select(*kept, F.col("_before") + F.col(row))
    return out.toDF(*docs.columns, place)
