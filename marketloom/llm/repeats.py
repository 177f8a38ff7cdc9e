"""Removing byte strings that occur more than once, by maximal repeats.

A byte goes when a string of ``length`` bytes over it also starts elsewhere, in
the same or another document.  Equal strings have the same anchor: the 64-byte
gram with the least hash among all grams of the string.  So the starts of a
document fall into spans sharing an anchor, and only spans with equal anchors
need comparing:

1. Every text block tells the hash ranges its distinct (anchor, span) hashes.
   A span seen twice is repeated as a whole.  Anchors seen once are done.
2. For the other spans, and one example of each repeated span beside them, the
   bytes around the anchor go to the anchor's hash range.  There each anchor's
   group gets an enhanced suffix array: suffixes from the anchor sorted, common
   prefixes of neighbours, and a stack scan over them yielding the interval
   tree.  Within an interval the reversed left contexts are scanned the same
   way; their intervals are the left-diverse ones.  Each (left, right) pair is
   a maximal repeat with all its occurrences; those of ``length`` bytes or more
   mark their occurrences.
3. Groups of more than ``GROUP`` different spans are not gathered: their blocks
   send the hashes of the single strings instead, and a hash seen twice marks
   its string.  The result is the same; the load follows hash ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame

from marketloom.llm import blocks as bl
from marketloom.llm.text_arrays import U64, range_hashes, rolling_hashes, text_slices, utf8

GRAM = 64
GROUP = 2_000
SLICE = 1 << 19
LOW32 = U64(0xFFFFFFFF)


@dataclass(frozen=True)
class Spans:
    """Runs of string starts sharing an anchor: starts lo..hi (places in ``data``)."""

    data: np.ndarray
    offsets: np.ndarray
    doc: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    anchor: np.ndarray
    gram: np.ndarray
    span: np.ndarray


def spans_of(texts: pa.Array, length: int) -> Spans:
    """All spans of the texts, in order; texts under ``length`` bytes have none."""
    data, offsets = utf8(texts)
    none = np.empty(0, dtype=np.int64)
    n = len(data) - length + 1
    ends = np.repeat(offsets[1:], np.diff(offsets))[: max(n, 0)]
    valid = np.flatnonzero(np.arange(max(n, 0)) + length <= ends)
    if len(valid) == 0:
        return Spans(data, offsets, none, none, none, none, none.astype(U64), none.astype(U64))
    at = np.arange(len(data) - GRAM + 1)
    with np.errstate(over="ignore"):
        gram = rolling_hashes(data, GRAM)
        least = (gram & ~LOW32) | at.astype(U64)
        width, size = length - GRAM + 1, 1
        while size * 2 <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < width:
            least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
        anchor = (least[valid] & LOW32).astype(np.int64)
        fresh = np.ones(len(valid), dtype=bool)
        fresh[1:] = (anchor[1:] != anchor[:-1]) | (np.diff(valid) != 1)
        first = np.flatnonzero(fresh)
        lo, hi = valid[first], valid[np.append(first[1:], len(valid)) - 1]
        doc = np.searchsorted(offsets, lo, "right") - 1
        return Spans(data, offsets, doc, lo, hi, anchor[first], gram[anchor[first]], range_hashes(data, lo, hi + length))


@dataclass(frozen=True)
class Entries:
    """Distinct (gram, span) pairs of a block in order, and which pair each span is."""

    parts: list[Spans]
    gram: np.ndarray
    span: np.ndarray
    count: np.ndarray
    of: np.ndarray
    example: np.ndarray
    table: pa.Table


def entries(blob: bytes, length: int) -> Entries:
    """The spans of a block's documents (equal pairs once)."""
    table = bl.block_rows(blob)
    parts = [spans_of(p.column("text"), length) for p in text_slices(table, "text", SLICE)]
    gram = np.concatenate([p.gram for p in parts])
    span = np.concatenate([p.span for p in parts])
    order = np.lexsort((span, gram))
    g, s = gram[order], span[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1])
    first = np.flatnonzero(new)
    of = np.empty(len(g), dtype=np.int64)
    of[order] = np.cumsum(new) - 1
    return Entries(parts, g[first], s[first], np.diff(np.append(first, len(g))), of, order[first], table)


def _ask_spans(count: int, length: int):  # noqa: ANN202
    def ask(blob: bytes, marked: bool) -> Iterator[tuple[int, bytes]]:
        e = entries(blob, length)
        for r, a, b in bl.ranges(e.gram, count):
            own = slice(a, b)
            yield r, bl.several(bl.packed_sorted(e.gram[own]), bl.packed(e.span[own]), bl.packed(e.count[own]))

    return ask


UNIQUE, REPEATED, EXAMPLE, OPEN, EXAMPLE_LARGE, OPEN_LARGE = range(6)


def _answer_spans(number: int, questions: list[bytes]) -> list[bytes]:
    parts = [bl.apart(q) for q in questions]
    grams = [bl.unpacked_sorted(p[0]) for p in parts]
    gram = np.concatenate(grams)
    if len(gram) == 0:
        return [bl.packed(g) for g in grams]
    span = np.concatenate([bl.unpacked(p[1]) for p in parts])
    count = np.concatenate([bl.unpacked(p[2]) for p in parts]).astype(np.int64)
    order = np.lexsort((span, gram))
    g, s = gram[order], span[order]
    new_gram = np.ones(len(g), dtype=bool)
    new_gram[1:] = g[1:] != g[:-1]
    new = new_gram.copy()
    new[1:] |= s[1:] != s[:-1]
    first = np.flatnonzero(new)
    pair = np.cumsum(new) - 1
    total = np.add.reduceat(count[order], first)
    group = (np.cumsum(new_gram) - 1)[first]
    different = np.bincount(group)[group]
    open_ = np.bincount(group, total == 1)[group]
    large = different > GROUP
    code = np.where(total == 1, np.where(different > 1, np.where(large, OPEN_LARGE, OPEN), UNIQUE), REPEATED)
    each = code[pair]
    shown = (total > 1) & (open_ > 0)
    each[first[shown]] = np.where(large[shown], EXAMPLE_LARGE, EXAMPLE)
    out = np.empty(len(g), dtype=np.int64)
    out[order] = each
    edges = np.cumsum([0, *(len(x) for x in grams)])
    return [bl.packed(out[edges[i] : edges[i + 1]]) for i in range(len(grams))]


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each distinct pair first stands, in order; which of them every row is)."""
    order = np.lexsort((b, a))
    new = np.ones(len(a), dtype=bool)
    new[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)
    of = np.empty(len(a), dtype=np.int64)
    of[order] = np.cumsum(new) - 1
    return order[new], of


def _strings(e: Entries, codes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(128-bit hash in two halves, span number, start) of every string of the large groups' spans."""
    wanted = np.isin(codes, (EXAMPLE_LARGE, OPEN_LARGE))
    is_example = np.zeros(len(e.of), dtype=bool)
    is_example[e.example] = True
    use = wanted[e.of] & is_example
    hashes, number, starts, base = [b""], [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)], 0
    for p in e.parts:
        own = np.flatnonzero(use[base : base + len(p.lo)])
        if len(own):
            size = p.hi[own] - p.lo[own] + 1
            at = np.repeat(p.lo[own] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            raw = memoryview(np.ascontiguousarray(p.data))
            hashes += [xxhash.xxh3_128_digest(raw[i : i + length]) for i in at.tolist()]
            number.append(np.repeat(own + base, size))
            starts.append(at)
        base += len(p.lo)
    halves = np.frombuffer(b"".join(hashes), dtype=U64).reshape(-1, 2)
    return halves[:, 0], halves[:, 1], np.concatenate(number), np.concatenate(starts)


def _context(e: Entries, index: int, length: int) -> tuple[int, bytes]:
    """(bytes left of the anchor, all bytes) of the span with this number."""
    base = 0
    for p in e.parts:
        if index < base + len(p.lo):
            i = index - base
            return int(p.anchor[i] - p.lo[i]), p.data[p.lo[i] : p.hi[i] + length].tobytes()
        base += len(p.lo)
    raise IndexError(index)


_ASKS = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("ask", pa.binary())])


def _ask_contexts(count: int, length: int):  # noqa: ANN202
    def use(block: int, blob: bytes, answers: dict[int, bytes]) -> pa.Table:
        if not blob:
            return _ASKS.empty_table()
        e = entries(blob, length)
        codes = bl.joined([bl.unpacked(x) for x in bl.between(answers, 0, count)]).astype(np.int64)
        entry = np.flatnonzero(np.isin(codes, (EXAMPLE, OPEN)))
        out = []
        for r, low, high in bl.ranges(e.gram[entry], count):
            own = entry[low:high]
            made = [_context(e, int(e.example[i]), length) for i in own]
            lefts, sizes = np.array([a for a, _ in made]), np.array([len(b) for _, b in made])
            blobs = zstandard.compress(b"".join(b for _, b in made), 1)
            out.append((r, bl.several(bl.packed_sorted(e.gram[own]), bl.packed(codes[own] == OPEN), bl.packed(lefts), bl.packed(sizes), blobs)))
        key, half, number, _ = _strings(e, codes, length)
        first, of = distinct_pairs(key, half)
        n = np.bincount(of, np.where(codes[e.of[number]] == EXAMPLE_LARGE, 2, 1), len(first)).astype(np.int64)
        for r, low, high in bl.ranges(key[first], count):
            own = first[low:high]
            out.append((count + r, bl.several(bl.packed_sorted(key[own]), bl.packed(half[own]), bl.packed(n[low:high]))))
        return pa.Table.from_arrays([pa.array([r for r, _ in out], pa.int32()), pa.array([block] * len(out), pa.int64()), pa.array([b for _, b in out], pa.binary())], schema=_ASKS)

    return use


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def intervals(prefix: list[int]) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last) of the interval tree of a sorted list.

    ``prefix[i]`` is what entries i-1 and i have in common (prefix[0] unused).
    """
    stack = [(0, 0)]
    for i in range(1, len(prefix) + 1):
        now = prefix[i] if i < len(prefix) else -1
        first = i - 1
        while stack and stack[-1][0] > now:
            value, first = stack.pop()
            if i - 1 > first:
                yield value, first, i - 1
        if not stack or stack[-1][0] < now:
            stack.append((now, first))


def maximal_repeats(contexts: list[tuple[int, bytes]], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """(left, right, occurrences) of the maximal repeats around an anchor, ``length`` bytes or more.

    A context is (place of the anchor, bytes).  The repeat reaches from
    ``left`` bytes before the anchor to ``right`` bytes after its start; it is
    right-maximal as an interval of the suffixes, left-maximal as an interval
    of the reversed left contexts.
    """
    right = [c[a:] for a, c in contexts]
    left = [c[:a][::-1] for a, c in contexts]
    order = sorted(range(len(contexts)), key=right.__getitem__)
    prefix = [0] + [common(right[order[i - 1]], right[order[i]]) for i in range(1, len(order))]
    for value, first, last in intervals(prefix):
        own = sorted(order[first : last + 1], key=left.__getitem__)
        inner = [0] + [common(left[own[i - 1]], left[own[i]]) for i in range(1, len(own))]
        for back, a, b in intervals(inner):
            if back + value >= length:
                yield back, value, own[a : b + 1]


def _answer_contexts(count: int, length: int):  # noqa: ANN202
    def answer(number: int, questions: list[bytes]) -> list[bytes]:
        parts = [bl.apart(q) for q in questions]
        keys = [bl.unpacked_sorted(p[0]) for p in parts]
        if number >= count:
            first, place = distinct_pairs(np.concatenate(keys), np.concatenate([bl.unpacked(p[1]) for p in parts]))
            n = np.bincount(place, np.concatenate([bl.unpacked(p[2]) for p in parts]), len(first))
            edges = np.cumsum([0, *(len(k) for k in keys)])
            return [bl.packed((n[place[edges[i] : edges[i + 1]]] > 1).astype(np.int64)) for i in range(len(keys))]
        gram = np.concatenate(keys)
        open_ = np.concatenate([bl.unpacked(p[1]) for p in parts]).astype(bool)
        left = np.concatenate([bl.unpacked(p[2]) for p in parts]).astype(np.int64)
        size = np.concatenate([bl.unpacked(p[3]) for p in parts]).astype(np.int64)
        data = b"".join(zstandard.decompress(p[4]) for p in parts)
        start = np.concatenate(([0], np.cumsum(size)))
        order = np.argsort(gram, kind="stable")
        cut = np.flatnonzero(np.diff(gram[order])) + 1
        found: list[list[tuple[int, int]]] = [[] for _ in gram]
        for group in np.split(order, cut):
            if len(group) < 2:
                continue
            contexts = [(int(left[i]), data[start[i] : start[i + 1]]) for i in group]
            for back, value, members in maximal_repeats(contexts, length):
                for k in members:
                    i = group[k]
                    if open_[i]:
                        found[i].append((int(left[i]) - back, int(left[i]) + value))
        out, at = [], 0
        for k in keys:
            own = [_merged(found[i]) for i in range(at, at + len(k))]
            at += len(k)
            flat = np.array([x for r in own for ab in r for x in ab], dtype=np.int64)
            out.append(bl.several(bl.packed(np.array([len(r) for r in own], dtype=np.int64)), bl.packed(flat)))
        return out

    return answer


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_COLUMNS = [("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
_REAL = [("spans", _SPANS), ("kept", pa.binary())]
_DDL = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_DDL_REAL = ", spans array<struct<start:long,end:long>>, kept binary"


def _marks(e: Entries, answers: dict[int, bytes], count: int, length: int) -> list[np.ndarray]:
    """For each slice of the block, which bytes go."""
    codes = bl.joined([bl.unpacked(x) for x in bl.between(answers, 0, count)]).astype(np.int64)
    whole = np.isin(codes, (REPEATED, EXAMPLE, EXAMPLE_LARGE))[e.of]
    bases = np.cumsum([0, *(len(p.lo) for p in e.parts)])
    deltas = [np.zeros(len(p.data) + 1, dtype=np.int32) for p in e.parts]
    for p, delta, base in zip(e.parts, deltas, bases[:-1], strict=True):
        own = whole[base : base + len(p.lo)]
        np.add.at(delta, p.lo[own], 1)
        np.add.at(delta, p.hi[own] + length, -1)

    entry = np.flatnonzero(np.isin(codes, (EXAMPLE, OPEN)))
    for r, low, high in bl.ranges(e.gram[entry], count):
        own = entry[low:high]
        sizes, flat = (bl.unpacked(x).astype(np.int64) for x in bl.apart(answers[count + r]))
        at = 0
        for i, n in zip(own, sizes, strict=True):
            if n:
                number = int(e.example[i])
                k = int(np.searchsorted(bases, number, "right")) - 1
                lo = e.parts[k].lo[number - bases[k]]
                for a, b in flat[at : at + 2 * n].reshape(-1, 2):
                    deltas[k][lo + a] += 1
                    deltas[k][lo + b] -= 1
                at += 2 * n

    key, half, number, starts = _strings(e, codes, length)
    if len(key):
        seen = bl.joined([bl.unpacked(x) for x in bl.between(answers, 2 * count, 3 * count)])
        hit = seen[distinct_pairs(key, half)[1]] > 0
        part = np.searchsorted(bases, number[hit], "right") - 1
        for k in np.unique(part):
            np.add.at(deltas[k], starts[hit][part == k], 1)
            np.add.at(deltas[k], starts[hit][part == k] + length, -1)
    return [np.cumsum(d[:-1]) > 0 for d in deltas]


def _removed(count: int, length: int, real: bool):  # noqa: ANN202
    schema = pa.schema(_COLUMNS + _REAL * real)

    def use(block: int, blob: bytes, answers: dict[int, bytes]) -> pa.Table:
        if not blob:
            return schema.empty_table()
        e = entries(blob, length)
        rows, ids, at = [], e.table.column("id").to_pylist(), 0
        for p, gone in zip(e.parts, _marks(e, answers, count, length), strict=True):
            for a, b in zip(p.offsets[:-1].tolist(), p.offsets[1:].tolist(), strict=True):
                own = gone[a:b]
                edge = np.flatnonzero(np.diff(own, prepend=False, append=False)) if b > a else np.empty(0, dtype=np.int64)
                kept = p.data[a:b][~own].tobytes()
                row = {"id": ids[at], "n_bytes": b - a, "n_removed": int(own.sum()), "n_spans": len(edge) // 2}
                row["kept_sha256"] = hashlib.sha256(kept).hexdigest()
                if real:
                    row["spans"] = [{"start": int(x), "end": int(y)} for x, y in edge.reshape(-1, 2)]
                    row["kept"] = kept
                rows.append(row)
                at += 1
        return pa.Table.from_pylist(rows, schema=schema)

    return use


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, real: bool = True) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans, kept_sha256 (and with ``real`` the spans and the kept bytes).

    Texts are UTF-8 bytes; null texts are empty.  Strings are judged on the
    input, matches never cross documents, and every occurrence goes, so equal
    texts of ``length`` bytes or more are emptied.  Shorter texts are never
    touched; long ones are read whole.  Null ids and repeated rows are documents like any; other columns
    are ignored; an empty table gives no rows.  ``length`` is 128 at least.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} or more")
    count = bl.range_count(docs, text_col)
    texts = bl.text_blocks(docs, id_col, text_col)
    codes = bl.answered(bl.asked(texts, _ask_spans(count, length)), _answer_spans)
    contexts = bl.resolved(texts, codes, _ask_contexts(count, length), "range int, block long, ask binary")
    found = bl.answered(contexts, _answer_contexts(count, length))
    replies = codes.union(found.selectExpr("block", f"range + {count} as range", "reply"))
    out = bl.resolved(texts, replies, _removed(count, length, real), _DDL + _DDL_REAL * real)
    return out.withColumnRenamed("id", id_col)
