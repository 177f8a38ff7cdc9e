"""Language-model scores by deleted interpolation.

The model mixes a bigram maximum-likelihood estimate with smoothed unigrams;
the mixture weight depends on how often the context word was seen (buckets of
powers of two).  Training documents are split: from a tenth, held out, the
weights are learned by expectation-maximisation, with the counts of the rest;
the final counts are those of all training documents.

Counts cover the whole corpus.  They are exchanged as packed sets of distinct
n-grams between text blocks and hash ranges (see ``blocks``).  For
expectation-maximisation only the ratio of the two estimates matters, so all
held-out tokens are summed into a histogram (bucket, log ratio) of bounded
size, and the iterations run on that.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm import blocks as bl
from marketloom.llm.text_arrays import U64, mix, text_slices, word_hashes

END = U64(0x2545F4914F6CDD1D)
BEGIN = U64(0x9E6C63D0876A9A47)
BUCKETS = 32
STEP, LIMIT = 0.02, 1500  # log-ratio bins


@dataclass(frozen=True)
class Tokens:
    """Tokens of a block: unigram and bigram hashes, and tokens before each document."""

    one: np.ndarray
    two: np.ndarray
    at: np.ndarray


def tokens(table: pa.Table) -> Tokens:
    """Words of every document, each followed by END; bigrams start from BEGIN."""
    ones, sizes = [], []
    for part in text_slices(table, "text"):
        hashes, at = word_hashes(part.column("text"))
        size = np.diff(at) + 1
        out = np.empty(len(hashes) + len(size), dtype=U64)
        ends = np.cumsum(size) - 1
        keep = np.ones(len(out), dtype=bool)
        keep[ends] = False
        out[keep], out[ends] = hashes, END
        ones.append(out)
        sizes.append(size)
    one = np.concatenate(ones) if ones else np.empty(0, dtype=U64)
    at = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))) if sizes else np.zeros(1, dtype=np.int64)
    before = np.empty_like(one)
    before[1:] = one[:-1]
    before[at[:-1]] = BEGIN
    with np.errstate(over="ignore"):
        return Tokens(one, mix(before * U64(3) + one), at)


def held_back(doc_id: int | None) -> bool:
    """Training documents whose tokens only teach the mixture weights (one in ten)."""
    return is_training(doc_id) and zlib.crc32(b"held back %d" % (doc_id or 0)) % 10 == 0


def is_training(doc_id: int | None, modulus: int = 7, remainder: int = 2) -> bool:
    """crc32 of the id as text, modulo ``modulus``, is not ``remainder``; null ids train."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % modulus != remainder


@dataclass(frozen=True)
class Totals:
    """Training tokens and distinct training tokens: all, and without the held-back tenth."""

    n: int
    v: int
    fit_n: int
    fit_v: int


def _ask(count: int):  # noqa: ANN202
    def ask(blob: bytes, marked: bool) -> Iterator[tuple[int, bytes]]:
        table = bl.block_rows(blob)
        t = tokens(table)
        train = np.repeat([is_training(i) for i in table.column("id").to_pylist()], np.diff(t.at))
        for order, hashes in enumerate((t.one, t.two)):
            keys, place = np.unique(hashes, return_inverse=True)
            n = np.bincount(place, train, len(keys)).astype(U64)
            for r, a, b in bl.ranges(keys, count):
                held = n[a:b] if marked else n[:0]
                yield order * count + r, bl.several(bl.packed_sorted(keys[a:b]), bl.packed(n[a:b]), bl.packed(held))

    return ask


def _answer(count: int):  # noqa: ANN202
    def answer(number: int, questions: list[bytes]) -> list[bytes]:
        parts = [bl.apart(q) for q in questions]
        keys = [bl.unpacked_sorted(p[0]) for p in parts]
        sizes = [len(k) for k in keys]
        values, place = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(place, np.concatenate([bl.unpacked(p[1]) for p in parts]), len(values)).astype(U64)
        late = [x if len(x := bl.unpacked(p[2])) else np.zeros(s, dtype=U64) for p, s in zip(parts, sizes, strict=True)]
        held = np.bincount(place, np.concatenate(late), len(values)).astype(U64)
        out, at = [], 0
        for s in sizes:
            own = place[at : at + s]
            out.append(bl.several(bl.packed(n[own]), bl.packed(held[own])))
            at += s
        if number < count:
            fit = n - held
            facts = [int(n.sum()), int((n > 0).sum()), int(fit.sum()), int((fit > 0).sum())]
            out.append(bl.packed(np.array(facts, dtype=U64)))
        return out

    return answer


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the ranges' facts."""
    found = np.array([bl.unpacked(x) for b in batches for x in b.column("reply").to_pylist()], dtype=np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in found.reshape(-1, 4).sum(axis=0)], ["n", "v", "fit_n", "fit_v"])


@dataclass(frozen=True)
class Counts:
    """Corpus counts for the tokens of a block: word, context, bigram; held-back parts of each."""

    word: np.ndarray
    context: np.ndarray
    pair: np.ndarray


def _counts(t: Tokens, answers: dict[int, bytes], count: int, fit: bool) -> Counts:
    found = []
    for order, hashes in enumerate((t.one, t.two)):
        own = [bl.apart(x) for x in bl.between(answers, order * count, (order + 1) * count)]
        n = bl.joined([bl.unpacked(a[0]) for a in own])
        if fit:
            n = n - bl.joined([bl.unpacked(a[1]) for a in own])
        found.append(n.astype(np.float64)[np.unique(hashes, return_inverse=True)[1]])
    word, pair = found
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[t.at[:-1]] = word[t.at[1:] - 1]  # as many beginnings as ends
    return Counts(word, context, pair)


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(context)[1], BUCKETS - 1)  # 0 for contexts never seen


def _histogram(count: int, totals: Totals):  # noqa: ANN202
    def use(block: int, blob: bytes, answers: dict[int, bytes]) -> pa.Table:
        if not blob:
            return pa.table({"bucket": pa.array([], pa.int32()), "ratio": pa.array([], pa.int32()), "n": pa.array([], pa.int64())})
        c = _counts(tokens(bl.block_rows(blob)), answers, count, fit=True)
        seen = c.context > 0
        base = (c.word[seen] + 1) / (totals.fit_n + totals.fit_v + 1)
        with np.errstate(divide="ignore"):
            ratio = np.log(c.pair[seen] / c.context[seen] / base)
        bins = np.where(c.pair[seen] > 0, np.clip(np.rint(ratio / STEP), -LIMIT, LIMIT), -LIMIT - 1).astype(np.int64)
        code, n = np.unique(_bucket(c.context[seen]) * (2 * LIMIT + 2) + bins + LIMIT + 1, return_counts=True)
        bucket, ratio = code // (2 * LIMIT + 2), code % (2 * LIMIT + 2) - LIMIT - 1
        return pa.table({"bucket": pa.array(bucket, pa.int32()), "ratio": pa.array(ratio, pa.int32()), "n": pa.array(n, pa.int64())})

    return use


def mixture_weights(bucket: np.ndarray, ratio: np.ndarray, n: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weight of the bigram estimate per bucket, by expectation-maximisation.

    ``ratio`` is the log of bigram over unigram estimate in bins of STEP;
    -LIMIT - 1 stands for a bigram never seen.  Buckets without held-out tokens
    take the weight of the next lower one that has some.
    """
    out = np.zeros(BUCKETS)
    gain = np.where(ratio < -LIMIT, 0.0, np.exp(ratio * STEP))
    for b in range(1, BUCKETS):
        own = bucket == b
        if not n[own].sum():
            out[b] = out[b - 1]
            continue
        w = 0.5
        for _ in range(rounds):
            w = float((n[own] * (w * gain[own] / (w * gain[own] + 1 - w))).sum() / n[own].sum())
            w = min(w, 0.999)
        out[b] = w
    return out


_SCORES = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(count: int, totals: Totals, weights: np.ndarray):  # noqa: ANN202
    names = [x.split()[0] for x in _SCORES.split(", ")]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def use(block: int, blob: bytes, answers: dict[int, bytes]) -> pa.Table:
        if not blob:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        table = bl.block_rows(blob)
        t = tokens(table)
        c = _counts(t, answers, count, fit=False)
        base = (c.word + 1) / (totals.n + totals.v + 1)
        w = weights[_bucket(c.context)]
        mixed = w * c.pair / np.maximum(c.context, 1) + (1 - w) * base
        ids = table.column("id").to_pylist()
        each = lambda x: np.add.reduceat(x, t.at[:-1])
        columns = [ids, [not is_training(i) for i in ids], np.diff(t.at), each((c.word > 0).astype(np.int64)), [totals.n] * len(ids)]
        columns += [each(np.log10(base)), each(np.log10(mixed))]
        return pa.table([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names)

    return use


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score, score.

    base_score is the log10 probability under add-one unigrams, score under the
    interpolated model; both over the words and one end token, so null and
    empty texts score the end token alone and long ones are scored whole.
    Without training documents every estimate is the add-one unigram.  Null ids train; repeated rows count as
    often as they occur; other columns are ignored; an empty table gives no rows.
    """
    count = bl.range_count(docs, text_col)
    texts = bl.text_blocks(docs, id_col, text_col, apart_by=held_back)
    replies = bl.answered(bl.asked(texts, _ask(count)), _answer(count))
    facts = replies.where("block < 0").select("reply").mapInArrow(_facts, "n long, v long, fit_n long, fit_v long")
    totals = Totals(*(int(x or 0) for x in facts.groupBy().sum().first()))
    marked = texts.where("marked")
    own = replies.join(marked.select("block"), "block", "left_semi")
    hist = bl.resolved(marked, own, _histogram(count, totals), "bucket int, ratio int, n long")
    rows = hist.groupBy("bucket", "ratio").agg(F.sum("n").alias("n")).collect()  # <= BUCKETS * 2 * LIMIT rows
    weights = mixture_weights(*(np.array([r[c] for r in rows], dtype=float) for c in ("bucket", "ratio", "n")))
    return bl.resolved(texts, replies, _scores(count, totals, weights), _SCORES).withColumnRenamed("id", id_col)
