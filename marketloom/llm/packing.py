"""Packing token sequences by minimum bin slack.

Each bin starts with the longest piece left; a bitset subset-sum over the
lengths still available finds the fullest combination for the rest, and the
combination leaves the stock.  Only the counts per length matter for that, and
there are at most ``capacity`` lengths, so the plan is made from one small
histogram of all pieces.  Pieces then look up their place by their rank among
the pieces of their length, a distributed rank without a task per length.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.blocks import give_back
from marketloom.llm.common import ranked, written
from marketloom.llm.text_arrays import text_slices, utf8, word_table
from marketloom.llm.word_cache import WordCache

STRETCHES = 64  # most stretches of documents packed one after the other
STRETCH_BINS = 32  # sequences of a stretch at least, about

_LETTER = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
_MARK = np.array([chr(b) in ",.;:!?" for b in range(256)])


def _between_word_and_mark(part: np.ndarray) -> np.ndarray:
    """Places where an ASCII letter or digit meets one of , . ; : ! ? (never one token)."""
    out = np.zeros(len(part), dtype=bool)
    letter, mark = _LETTER[part], _MARK[part]
    out[1:] = (letter[1:] & mark[:-1]) | (mark[1:] & letter[:-1])
    return out


def _lower(texts: pa.Array) -> pa.Array:
    """A-Z lower-cased but for those before a non-ASCII byte, which may be a mark that joins the letter."""
    data, offsets = utf8(texts)
    alone = np.append(data[1:] < 128, True) if len(data) else np.empty(0, dtype=bool)
    upper = (data >= 65) & (data <= 90) & alone
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data + upper.astype(np.uint8) * np.uint8(32)))


class WordTokens(WordCache):
    """Token ids of whole texts, with the ids of words remembered.

    For tokenizers that never make a token across white space.  ``bound`` limits
    the memory for words; beyond it they are looked up anew.
    """

    def __init__(self, path: str, bound: int = 400_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        apart = ((x.content, i) for i, x in self.tokenizer.get_added_tokens_decoder().items() if x.special and not x.normalized)
        self.mark = next(apart, (None, -1))
        self.folds = self.tokenizer.encode("A", add_special_tokens=False).ids == self.tokenizer.encode("a", add_special_tokens=False).ids
        super().__init__(bound)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, ids per text); many texts a call, kept apart by a special token."""
        mark, number = self.mark
        if mark is not None and not any(mark in x for x in texts):
            joined = [mark.join(texts[i : i + 64]) + mark for i in range(0, len(texts), 64)]
            made = [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
            flat = np.concatenate(made)
            ends = np.flatnonzero(flat == number)
            if len(ends) == len(texts):
                return flat[flat != number], np.diff(ends, prepend=-1) - 1
        made = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for x in made for i in x], dtype="<u4"), np.array([len(x) for x in made], dtype=np.int64)

    def _folded(self, texts: pa.Array) -> pa.Array:
        """Lower-cased if the tokenizer does so too and no special token comes about by it."""
        if not self.folds or len(texts) == 0:
            return texts
        lower = _lower(texts)
        before, after = (utf8(x)[0].tobytes() for x in (texts, lower))
        return lower if all(before.count(x) == after.count(x) for x in self.special) else texts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, for each text the ids before it, and the total)."""
        return self.ids_of(word_table(self._folded(texts), fold_case=False, split=_between_word_and_mark))


@cache
def coder_of(path: str) -> WordTokens:
    """One coder a worker process, whose tasks follow each other."""
    return WordTokens(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int, id_col: str, text_col: str, end_id: int, keep_ids: bool, place_col: str | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids][, _place]) of every document's tokens and end id."""
    names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids + ["_place"] * bool(place_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(tokenizer)
        for batch in batches:
            for part in text_slices(batch, "text"):
                ids, at = coder.encode(part.column("text"))
                doc, piece, start, length, crc, blobs = [], [], [], [], [], []
                for i in range(part.num_rows):
                    own = np.append(ids[at[i] : at[i + 1]], np.array([end_id], dtype="<u4"))
                    for k, low in enumerate(range(0, len(own), capacity)):
                        raw = own[low : low + capacity].tobytes()
                        doc.append(i)
                        piece.append(k)
                        start.append(low)
                        length.append(len(raw) // 4)
                        crc.append(zlib.crc32(raw))
                        blobs.append(raw if keep_ids else None)
                out = [part.column("id").take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64())]
                out += [pa.array(length, pa.int64()), pa.array(crc, pa.int64())] + [pa.array(blobs, pa.binary())] * keep_ids
                if place_col:
                    out.append(part.column("_place").take(pa.array(doc, pa.int64())))
                yield pa.RecordBatch.from_arrays(out, names)
                del out, blobs, ids
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *([F.col(place_col).cast("long").alias("_place")] if place_col else []))
    return rows.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids + ", _place long" * bool(place_col))


@dataclass(frozen=True)
class Pattern:
    """A bin content (length -> copies) used for ``times`` bins."""

    copies: dict[int, int]
    times: int


def fullest(stock: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum up to ``room``."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x, c in stock.items() if c and x <= room), reverse=True):
        left, take = min(stock[length], room // length), 1
        while left:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            take *= 2
        if reach >> room:
            break
    goal, out = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> goal & 1:
            out[length] = out.get(length, 0) + take
            goal -= length * take
    return out


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that use up ``counts`` (length -> pieces, lengths up to ``capacity``)."""
    stock, out = {x: c for x, c in counts.items() if c > 0}, []
    while stock:
        top = max(stock)
        stock[top] -= 1
        copies = fullest(stock, capacity - top)
        stock[top] += 1
        copies[top] = copies.get(top, 0) + 1
        times = min(stock[x] // c for x, c in copies.items())
        for x, c in copies.items():
            stock[x] -= c * times
            if not stock[x]:
                del stock[x]
        out.append(Pattern(copies, times))
    return out


def _places(plan: list[Pattern]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, copies per bin, first bin, offset of the first copy)."""
    used: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    bins = 0
    for p in plan:
        offset = 0
        for length in sorted(p.copies, reverse=True):
            c = p.copies[length]
            rows.setdefault(length, []).append((used.get(length, 0), c, bins, offset))
            used[length] = used.get(length, 0) + c * p.times
            offset += c * length
        bins += p.times
    return {x: np.array(r, dtype=np.int64) for x, r in rows.items()}


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    keep_ids: bool = False,
    place_col: str | None = None,
) -> DataFrame:
    """Every piece of every document with its sequence_id and offset in it.

    A document is its token ids and one end id, cut into pieces of ``capacity``
    only where longer, so a text of any length is packed whole.  Null and empty
    texts are the end id alone.  Repeated rows and null ids are packed like any
    row, pieces of one length in hash order.  ``keep_ids`` adds the ids as
    little-endian 32-bit integers.  An empty table gives no rows; other columns
    are ignored.

    With ``place_col`` (0-based places of the documents) the sequences follow
    that order: up to STRETCHES stretches of documents are packed one after the
    other, pieces of a length take their places in order, and the sequences of
    a stretch are ordered by the mean place of their tokens.
    """
    cut = written(pieces(docs, tokenizer, capacity, id_col, text_col, end_id, keep_ids, place_col))
    if place_col:
        tokens, last = cut.agg(F.sum("length"), F.max("_place") + 1).first()
        stretches = max(1, min(STRETCHES, (tokens or 0) // (capacity * STRETCH_BINS)))
        cut = cut.withColumn("_stretch", F.floor(F.col("_place") * stretches / F.lit(last or 1)).cast("int"))
    else:
        cut = cut.withColumn("_stretch", F.lit(0))
    counts: dict[int, dict[int, int]] = {}
    for r in cut.groupBy("_stretch", "length").agg(F.count(F.lit(1)).alias("n")).collect():  # <= capacity rows a stretch
        counts.setdefault(r["_stretch"], {})[r["length"]] = r["n"]
    total = sum(sum(x.values()) for x in counts.values())
    places, bins = {}, 0
    for k in sorted(counts):
        plan = minimum_bin_slack(counts[k], capacity)
        for x, rows in _places(plan).items():
            rows[:, 2] += bins
            places[k * (capacity + 1) + x] = rows
        bins += sum(p.times for p in plan)
    sent = docs.sparkSession.sparkContext.broadcast(places)

    @F.pandas_udf("sequence_id long, offset long")
    def place(key, length, rank):  # noqa: ANN001, ANN202
        import pandas as pd

        sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
        keys, lengths, ranks = key.to_numpy(), length.to_numpy(), rank.to_numpy()
        by_key = np.argsort(keys, kind="stable")
        for own in np.split(by_key, np.flatnonzero(np.diff(keys[by_key])) + 1) if len(keys) else []:
            rows = sent.value[int(keys[own[0]])]
            row = rows[np.searchsorted(rows[:, 0], ranks[own], "right") - 1]
            done = ranks[own] - row[:, 0]
            sequence[own] = row[:, 2] + done // row[:, 1]
            offset[own] = row[:, 3] + done % row[:, 1] * lengths[own]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    slices = max(64, total // 100_000)
    if place_col:
        part = F.floor(F.col("_place") * slices / F.lit(last or 1))
        rows = ranked(cut, ["_stretch", "length"], [F.col("_place"), F.col("piece")], "_rank", slices, part)
    else:
        rows = ranked(cut, ["length"], [F.col("id"), F.col("piece"), F.col("ids_crc32")], "_rank", slices)
    rows = rows.withColumn("_at", place(F.col("_stretch") * (capacity + 1) + F.col("length"), "length", "_rank"))
    kept = [F.col(c) for c in cut.columns if c not in ("id", "_place", "_stretch")]
    if not place_col:
        return rows.select(F.col("id").alias(id_col), *kept, "_at.sequence_id", "_at.offset")
    rows = written(rows.select("id", *kept, "_place", "_stretch", "_at.sequence_id", "_at.offset"))
    mean = (F.sum(F.col("_place").cast("decimal(38,0)") * F.col("length")) / F.sum("length")).alias("_mean")
    found = rows.groupBy("_stretch", "sequence_id").agg(mean)
    own = Window.partitionBy("_stretch")
    order = own.orderBy("_mean", "sequence_id")
    found = found.select("sequence_id", (F.min("sequence_id").over(own) + F.row_number().over(order) - 1).alias("_new"))
    return rows.join(found, "sequence_id").select(F.col("id").alias(id_col), *kept, F.col("_new").alias("sequence_id"), "offset")
