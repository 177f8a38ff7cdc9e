"""Byte-level BPE by prefix dynamic programming.

A sequence of tokens is the encoding of its bytes exactly when each two
neighbours are the encoding of theirs.  So every prefix of a string has one
valid last token: among the vocabulary's tokens that end the prefix, the one
that fits the last token of what it leaves.  Storing it per prefix gives the
encoding by walking back from the end, and keeps three things cheap:

* appending bytes only adds entries;
* a change leaves the entries before it as they are;
* behind a change, entries are recomputed until as many as the longest token
  has bytes agree with the old ones in a row; all later ones then agree too.

Tokens that end a prefix come from an Aho-Corasick automaton over the
vocabulary.  Whether two tokens fit is read off the merges that made them: going
back in time, the parts that lie on either side of the border must never have
merged with each other first.

A text is first cut by a pattern; each piece is encoded by itself, and one that
is a token of the vocabulary is that token.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.blocks import give_back
from marketloom.llm.common import unused
from marketloom.llm.text_arrays import SEGMENT, SPACE, Words, range_hashes, text_slices, utf8
from marketloom.llm.word_cache import WordCache

LATE = 1 << 62  # later than any merge
PAIRS_KEPT = 400_000
LONG_PIECE = 64  # bytes from which a text under change keeps the prefixes of a piece
#: fixed values: white space of three bytes in UTF-8
WIDE_SPACES = {chr(c).encode() for c in (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)}


class Vocabulary:
    """Tokens with their ranks (which are their ids), and which of them fit together."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._ends = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self._ends.add_word(token.decode("latin-1"), (len(token), rank))
        self._ends.make_automaton()

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """The tokens of a file with a base64 token and its rank a line."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())})

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes a token last; None for a single byte, and for one that no merges make."""
        if token not in self._parts:
            made = self._merged(self.bytes_of[token], token)
            self._parts[token] = (made[0], made[1]) if len(made) == 2 else None
        return self._parts[token]

    def _merged(self, data: bytes, below: int) -> list[int]:
        """All merges of a token's bytes with a rank under ``below``, lowest first, then leftmost."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, LATE), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def made(self, token: int) -> bool:
        """Whether merges make the token, or it is a single byte."""
        return len(self.bytes_of[token]) == 1 or self.parts(token) is not None

    def fits(self, left: int, right: int) -> bool:
        """Whether merges make the right token and the two are the encoding of their bytes."""
        known = self._fits.get(left << 32 | right)
        if known is None:
            if len(self._fits) >= PAIRS_KEPT:
                self._fits.clear()
            known = self._fits[left << 32 | right] = self.made(right) and self._never_merges(left, right)
        return known

    def extend(self, last: list[int], data: bytes, start: int) -> None:
        """Append to ``last`` the last tokens of the prefixes ending in ``data``, which begins at the prefix of ``start`` bytes.

        As many entries as the longest token has bytes, less one, must be in
        ``data`` already, or all of them.
        """
        fits, done = self._fits, len(last)
        for end, (length, token) in self._ends.iter(data.decode("latin-1")):
            end += start
            if end < done:
                continue
            if end > done:
                raise ValueError(f"no token of the vocabulary fits at byte {done}")
            if end < length:
                if not self.made(token):
                    continue
            else:
                left = last[end - length]
                known = fits.get(left << 32 | token)
                if not (self.fits(left, token) if known is None else known):
                    continue
            last.append(token)
            done += 1
        if done < start + len(data):
            raise ValueError(f"no token of the vocabulary fits at byte {done}")

    def walked(self, last: list[int]) -> list[int]:
        """The tokens of all bytes, from the last token of every prefix."""
        out, at, bytes_of = [], len(last), self.bytes_of
        while at:
            token = last[at - 1]
            out.append(token)
            at -= len(bytes_of[token])
        out.reverse()
        return out

    def _never_merges(self, x: int, y: int) -> bool:
        """Goes back through the merges on both sides of the border, the latest first."""
        x_until = y_until = LATE
        while True:
            crossing = self.ranks.get(self.bytes_of[x] + self.bytes_of[y], LATE)
            # of equal ranks the left merge comes first
            if crossing < x_until and crossing <= y_until and crossing < LATE:
                return False
            before_x = self.parts(x) if len(self.bytes_of[x]) > 1 else None
            before_y = self.parts(y) if len(self.bytes_of[y]) > 1 else None
            if before_x and (not before_y or x > y):
                x_until, x = x, before_x[1]
            elif before_y:
                y_until, y = y, before_y[0]
            else:
                return True


class Prefixes:
    """The last token of every prefix of some bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Add bytes at the end: no earlier entry changes."""
        start = len(self.data)
        self.data += more
        self._fill(start, len(self.data))

    def _fill(self, start: int, end: int) -> None:
        """Set the entries of the prefixes that end in [start, end)."""
        del self.last[start:]
        low = max(0, start - self.vocabulary.longest + 1)
        self.vocabulary.extend(self.last, self.data[low:end], low)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put ``new`` in place of the bytes [start, end); tell how many entries were computed anew."""
        v, old = self.vocabulary, self.last
        moved = len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old[:start]
        at, same = start, 0
        while at < len(self.data):
            stop = min(len(self.data), max(start + len(new), at) + v.longest)
            self._fill(at, stop)
            for i in range(at, stop):
                same = same + 1 if i >= start + len(new) and self.last[i] == old[i - moved] else 0
                if same >= v.longest:
                    del self.last[i + 1 :]
                    self.last += old[i + 1 - moved :]
                    return i + 1 - start
            at = stop
        return len(self.data) - start

    def ids(self) -> list[int]:
        """The tokens of all bytes."""
        return self.vocabulary.walked(self.last)


class Coder(WordCache):
    """Ids of whole texts and back.

    ``pattern`` cuts a text into pieces.  ``spaced`` tells that it takes one
    space with the characters that follow and else keeps white space apart, as
    public_tokenizers.PATTERN does: texts are then cut, in arrays, into spans of
    such pieces, which are remembered, and only new spans go through the pattern.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str, spaced: bool = False, bound: int = 800_000) -> None:
        self.vocabulary, self.cut, self.spaced = vocabulary, regex.compile(pattern), spaced
        super().__init__(bound)

    def piece(self, piece: str) -> list[int]:
        """The ids of one piece."""
        data, v = piece.encode(), self.vocabulary
        token = v.ranks.get(data)
        if token is not None:
            return [token]
        last: list[int] = []
        v.extend(last, data, 0)
        return v.walked(last)

    def encode(self, text: str) -> list[int]:
        """The ids of a text."""
        known: dict[str, list[int]] = {}
        out: list[int] = []
        for m in self.cut.finditer(text):
            piece = m.group()
            if piece not in known:
                known[piece] = self.piece(piece)
            out += known[piece]
        return out

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        known: dict[str, list[int]] = {}
        flat: list[int] = []
        ends = []
        for text in texts:
            for piece in self.cut.findall(text):
                if piece not in known:
                    known[piece] = self.piece(piece)
                flat += known[piece]
            ends.append(len(flat))
        return np.array(flat, dtype="<u4"), np.diff(ends, prepend=0)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, for each text the ids before it, and the total); null texts are empty."""
        data, offsets = utf8(texts)
        odd = range(len(texts)) if not self.spaced else np.unique(np.searchsorted(offsets, _wide_spaces(data), "right") - 1).tolist()
        if not odd:
            return self.ids_of(_spans(data, offsets))
        plain = np.ones(len(texts), dtype=bool)
        plain[list(odd)] = False
        ids, at = self.ids_of(_spans(*utf8(texts.filter(pa.array(plain)))))
        parts, place = [], 0
        for i in range(len(texts)):
            if plain[i]:
                parts.append(ids[at[place] : at[place + 1]])
                place += 1
            else:
                parts.append(np.array(self.encode(texts[i].as_py() or ""), dtype="<u4"))
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes of ids."""
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))


class Edited:
    """A text under change: pieces, with their prefixes while they are worked on, and ids."""

    def __init__(self, coder: Coder, text: str = "") -> None:
        self.coder, self.text = coder, text
        self.ends = [m.end() for m in coder.cut.finditer(text)]
        self.pieces = [coder.piece(m.group()) for m in coder.cut.finditer(text)]
        self._open: tuple[str, Prefixes] | None = None

    def append(self, more: str) -> None:
        """Add text at the end."""
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in place of the characters [start, end).

        Pieces are cut anew from two before the change until a cut meets an old
        one behind it: the pattern looks back no further, and ahead of a cut
        only.  A piece that goes on from the one last worked on keeps its prefixes.
        """
        moved = len(new) - (end - start)
        text = self.text[:start] + new + self.text[end:]
        first = next((i for i, e in enumerate(self.ends) if e >= start), len(self.ends))
        first = max(0, first - 2)
        begin = self.ends[first - 1] if first else 0
        old = {e + moved: i for i, e in enumerate(self.ends) if e >= end}
        ends, pieces, behind = [], [], len(self.ends)
        for m in self.coder.cut.finditer(text, begin):
            ends.append(m.end())
            pieces.append(self._piece(m.group()))
            if m.end() in old and m.end() >= start + len(new):
                behind = old[m.end()] + 1
                break
        self.ends = self.ends[:first] + ends + [e + moved for e in self.ends[behind:]]
        self.pieces = self.pieces[:first] + pieces + self.pieces[behind:]
        self.text = text

    def _piece(self, piece: str) -> list[int]:
        data = piece.encode()
        if len(data) <= LONG_PIECE or data in self.coder.vocabulary.ranks:
            return self.coder.piece(piece)
        if self._open is not None and self._open[0][:16] == piece[:16]:
            before, prefixes = self._open
            kept = len(_shared(before.encode(), data))
            tail = len(_shared(before.encode()[kept:][::-1], data[kept:][::-1]))
            prefixes.replace(kept, len(prefixes.data) - tail, data[kept : len(data) - tail])
        else:
            prefixes = Prefixes(self.coder.vocabulary, data)
        self._open = (piece, prefixes)
        return prefixes.ids()

    def ids(self) -> list[int]:
        """The ids of the text as it is now."""
        return [i for p in self.pieces for i in p]


def _shared(a: bytes, b: bytes) -> bytes:
    """The longest common prefix, found by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return a[:low]


def _wide_spaces(data: np.ndarray) -> np.ndarray:
    """Where white space that is not ASCII begins in UTF-8 bytes."""
    if not len(data) or data.max() < 128:
        return np.empty(0, dtype=np.int64)
    after = np.append(data[1:], 0)
    two = np.flatnonzero((data == 0xC2) & ((after == 0x85) | (after == 0xA0)))
    lead = np.flatnonzero(((data == 0xE1) & (after == 0x9A)) | ((data == 0xE2) & ((after == 0x80) | (after == 0x81))) | ((data == 0xE3) & (after == 0x80)))
    raw = data.tobytes()
    return np.append(two, [i for i in lead.tolist() if raw[i : i + 3] in WIDE_SPACES]).astype(np.int64)


def _spans(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Runs of characters with the one space before them, and white space by itself.

    Of a run of white space before other characters the last stands apart, and
    goes with them if it is a space.
    """
    n = len(data)
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    white = SPACE[data]
    before = np.append(False, white[:-1])
    leads = np.append(~white[1:], False) & ~first[1:]  # other characters of the same text follow
    cut = first[:-1] | (white & (~before | leads)) | (~white & before & (np.append(0, data[:-1]) != 0x20))
    start = np.flatnonzero(cut)
    end = np.append(start[1:], n) if len(start) else start
    hashes, low = [np.empty(0, dtype=np.uint64)], 0
    while low < len(start):  # about a million bytes at a time
        high = max(low + 1, int(np.searchsorted(end, start[low] + SEGMENT, "right")))
        at = int(start[low])
        hashes.append(range_hashes(data[at : end[high - 1]], start[low:high] - at, end[low:high] - at))
        low = high
    return Words(data, np.concatenate(hashes), start, end, np.searchsorted(start, offsets))


@cache
def coder(path: str, pattern: str, spaced: bool = False) -> Coder:
    """One coder a worker process; its memory is bounded by the vocabulary and what is remembered."""
    return Coder(Vocabulary.load(path), pattern, spaced)


def encoded(docs: DataFrame, path: str, pattern: str, spaced: bool = False, text_col: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids (array<int>) of each whole text in a new last column named ``ids``, behind underscores if there is one.

    A null or empty text has no ids.  Texts of any length are encoded whole, each
    by itself, so equal texts have equal ids and repeated rows stay repeated.  An
    empty table stays empty; all columns, whatever their names, come along.  The
    vocabulary file must be at ``path`` on every executor.
    """
    name, at = unused(ids, docs.columns), docs.columns.index(text_col)
    rows = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern, spaced)
        for batch in batches:
            for part in text_slices(batch, f"c{at}"):
                ids, ends = own.encode_all(part.column(at))
                made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, "ids"])
        give_back()

    schema = rows.withColumn("ids", F.array().cast("array<int>")).schema
    return rows.mapInArrow(run, schema).toDF(*docs.columns, name)


def decoded(rows: DataFrame, path: str, ids_col: str = "ids", data: str = "bytes") -> DataFrame:
    """``rows`` with the bytes (binary) of each row's ids in a new last column; null ids have no bytes.

    An id outside the vocabulary, or a null among the ids, is an error.
    """
    name, at = unused(data, rows.columns), rows.columns.index(ids_col)
    plain = rows.toDF(*(f"c{i}" for i in range(len(rows.columns))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, "")
        for batch in batches:
            made = pa.array([own.decode(x or []) for x in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, "data"])
        give_back()

    schema = plain.withColumn("data", F.lit(None).cast("binary")).schema
    return plain.mapInArrow(run, schema).toDF(*rows.columns, name)


def digests(docs: DataFrame, path: str, pattern: str, spaced: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): each text encoded, and its ids decoded, in one pass.

    The hashes are of the decimal ids joined by commas, and of the decoded
    bytes.  A null or empty text has no tokens and the hashes of nothing.  Rows
    are returned as often as they occur, null ids too; an empty table gives no
    rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern, spaced)
        names = {i: str(i) for i in own.vocabulary.bytes_of}
        for batch in batches:
            for part in text_slices(batch, "text"):
                ids, at = own.encode_all(part.column("text"))
                n, ids_hash, data_hash = np.diff(at), [], []
                for low, high in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    some = ids[low:high].tolist()
                    ids_hash.append(hashlib.sha256(",".join(map(names.__getitem__, some)).encode()).hexdigest())
                    data_hash.append(hashlib.sha256(own.decode(some)).hexdigest())
                made = [pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(data_hash, pa.string())]
                yield pa.RecordBatch.from_arrays([part.column("id"), *made], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
        give_back()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
