"""Text blocks, and exchanging sets of hashes between blocks and hash ranges.

Some operators need, for every n-gram or byte string of every document, a fact
about the whole corpus.  Shuffling a row per n-gram would move many times the
input.  Instead the corpus is written once as blocks (a few MB of texts each,
compressed).  A block asks about its distinct hashes only: they are sorted, cut
into hash ranges and sent as one packed row per block and range.  The task of a
range sees all that blocks have asked about its hashes, which bounds its load
by the range and not by how common a hash is, and answers each block with one
packed row.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import written
from marketloom.llm.text_arrays import U64, text_slices

BLOCK_BYTES = RANGE_BYTES = 8 << 20


def packed(array: np.ndarray) -> bytes:
    """Unsigned integers in the smallest type that holds them, byte planes compressed."""
    top = int(array.max()) if len(array) else 0
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if top < 1 << (8 * int(k[2])))
    planes = np.ascontiguousarray(array.astype(kind)).view(np.uint8).reshape(-1, int(kind[2])).T
    return kind[2].encode() + len(array).to_bytes(6, "little") + zstandard.compress(planes.tobytes(), 1)


def unpacked(blob: bytes) -> np.ndarray:
    """What ``packed`` was given, as 64-bit unsigned integers."""
    width, count = int(blob[:1]), int.from_bytes(blob[1:7], "little")
    planes = np.frombuffer(zstandard.decompress(blob[7:]), dtype=np.uint8).reshape(width, count)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(U64)


def packed_sorted(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys, as differences."""
    return packed(np.diff(keys, prepend=U64(0)))


def unpacked_sorted(blob: bytes) -> np.ndarray:
    """The keys that ``packed_sorted`` was given."""
    return np.cumsum(unpacked(blob), dtype=U64)


def several(*blobs: bytes) -> bytes:
    """Blobs in one, each after its length."""
    return b"".join(len(b).to_bytes(6, "little") + b for b in blobs)


def apart(blob: bytes) -> list[bytes]:
    """The blobs given to ``several``."""
    out, at = [], 0
    while at < len(blob):
        size = int.from_bytes(blob[at : at + 6], "little")
        out.append(blob[at + 6 : at + 6 + size])
        at += 6 + size
    return out


def ranges(keys: np.ndarray, count: int) -> list[tuple[int, int, int]]:
    """(range, first, end) of sorted keys for those of ``count`` equal hash ranges that hold some.

    A block never asks an empty range, so its messages are bounded by its own
    keys however many ranges a large corpus has.
    """
    if len(keys) == 0:
        return []
    number = ((keys >> U64(32)) * U64(count)) >> U64(32)
    first = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
    return list(zip(number[first].astype(np.int64).tolist(), first.tolist(), [*first[1:].tolist(), len(keys)], strict=True))


def between(answers: dict[int, bytes], low: int, high: int) -> list[bytes]:
    """The replies of ranges low..high-1 in order."""
    return [answers[r] for r in sorted(answers) if low <= r < high]


def joined(arrays: list[np.ndarray]) -> np.ndarray:
    """Concatenated 64-bit unsigned integers; of no arrays, none."""
    return np.concatenate([np.empty(0, dtype=U64), *arrays])


def give_back() -> None:
    """Return freed memory to the system, which workers that are reused would keep."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def range_count(docs: DataFrame, text_col: str, bytes_each: int = RANGE_BYTES) -> int:
    """Hash ranges to use: one per ``bytes_each`` bytes of text, 8 at least."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
    return max(8, -(-total // bytes_each))


def text_blocks(docs: DataFrame, id_col: str, text_col: str, apart_by: Callable[[int | None], bool] | None = None) -> DataFrame:
    """Written table (block, marked, blob): the documents in blocks of about BLOCK_BYTES of text.

    ``apart_by`` (of an id) puts documents into marked blocks of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made = 0
        base = TaskContext.get().partitionId() << 32
        held: dict[bool, list[pa.RecordBatch]] = {False: [], True: []}

        def block(mark: bool) -> pa.RecordBatch:
            nonlocal made
            sink = pa.BufferOutputStream()
            table = pa.Table.from_batches(held[mark])
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table.combine_chunks())
            held[mark] = []
            made += 1
            row = [pa.array([base + made]), pa.array([mark]), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(row, ["block", "marked", "blob"])

        for part in (part for batch in batches for part in text_slices(batch, "text", BLOCK_BYTES // 8)):
            marks = np.array([bool(apart_by and apart_by(i)) for i in part.column("id").to_pylist()], dtype=bool)
            for mark in (False, True):
                own = part.filter(pa.array(marks == mark))
                if own.num_rows:
                    held[mark].append(own)
                if sum(b.nbytes for b in held[mark]) >= BLOCK_BYTES:
                    yield block(mark)
        for mark in (False, True):
            if held[mark]:
                yield block(mark)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return written(rows.mapInArrow(run, "block long, marked boolean, blob binary"))


def block_rows(blob: bytes) -> pa.Table:
    """The (id, text) rows of a block."""
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all().combine_chunks()


def asked(blocks: DataFrame, ask: Callable[[bytes, bool], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """(range, block, ask): what ``ask`` yields for every block, as (range, packed question)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block, marked, blob = (batch.column(c)[row].as_py() for c in ("block", "marked", "blob"))
                made = list(ask(blob, marked))
                arrays = [pa.array([r for r, _ in made], pa.int32()), pa.array([block] * len(made), pa.int64())]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([b for _, b in made], pa.binary())], ["range", "block", "ask"])
                del made, arrays, blob
                give_back()

    return blocks.select("block", "marked", "blob").mapInArrow(run, "range int, block long, ask binary")


def answered(questions: DataFrame, answer: Callable[[int, list[bytes]], list[bytes]]) -> DataFrame:
    """Written table (block, range, reply); ``answer`` gets a range's questions in block order.

    It returns one reply per question, and may add one more: a fact about the
    range, kept with block -1.
    """

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("block").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        number = table.column("range")[0].as_py()
        replies = answer(number, table.column("ask").to_pylist())
        give_back()
        blocks = table.column("block").to_pylist() + [-1] * (len(replies) - table.num_rows)
        return pa.table({"block": pa.array(blocks, pa.int64()), "range": pa.array([number] * len(blocks), pa.int32()), "reply": pa.array(replies, pa.binary())})

    return written(questions.groupBy("range").applyInArrow(run, "block long, range int, reply binary"))


def resolved(blocks: DataFrame, replies: DataFrame, use: Callable[[int, bytes, dict[int, bytes]], pa.Table], schema: str) -> DataFrame:
    """``use(block, blob, replies by range)`` for every block with its replies.

    ``use`` is also called once with an empty blob, for an empty table.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = dict(zip(right.column("range").to_pylist(), right.column("reply").to_pylist(), strict=True))
        made = [use(left.column("block")[i].as_py(), left.column("blob")[i].as_py(), answers) for i in range(left.num_rows)]
        give_back()
        return pa.concat_tables(made) if made else empty

    empty = use(0, b"", {})
    return blocks.groupBy("block").cogroup(replies.where("block >= 0").groupBy("block")).applyInArrow(run, schema)
