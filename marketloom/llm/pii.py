"""Personal data in texts: exact base patterns, and spans added by weak supervision.

Base spans (email, ip, card, phone) are fixed patterns.  Beyond them, loose
candidate patterns propose spans of the kinds secret, account and phone_local;
labelers vote on each candidate: a strict shape, a gazetteer of cue words near
it, its context (quotes, separators), and a randomness or digit test.
Expectation-maximisation over the vote patterns of all candidates estimates how
far each labeler can be trusted, which gives every pattern a probability.  With
these soft labels a logistic span classifier is fitted on hashed features and
decides which candidates are reported.

One pass over the texts leaves a thin table (spans and votes, no text); vote
patterns are counted over all of it, and the classifier is fitted on at most
``max_train`` spans.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.blocks import give_back
from marketloom.llm.common import written
from marketloom.llm.text_arrays import text_slices

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "account", "phone_local")
ORDER = {k: i for i, k in enumerate(BASE + ADDED)}
N_VOTES = 4
BITS = 12

# fixed values of the base kinds
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# The same, so that every character is read a fixed number of times.  A match of
# IP ends with a run of digits and no other start in that run could match, so it
# starts at the beginning of a run; nothing after CARD asks digits back.
NAME_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN_ONCE = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP_ONCE = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD_ONCE = re.compile(r"[0-9](?:[\x20-]?[0-9])++")

NUMBER_RUN = re.compile(r"[0-9+][\x20().0-9+-]*")
LONG_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}")
DIGITS_RUN = re.compile(r"(?<![0-9A-Za-z])[0-9](?:[\x20-]?[0-9]){7,23}(?![0-9A-Za-z])")
LOCAL_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])")

CUES = {
    "secret": {"token", "key", "secret", "password", "passwd", "apikey", "api_key", "auth", "bearer", "credential"},
    "account": {"account", "card", "iban", "konto", "cuenta", "compte", "carte", "tarjeta", "karte", "number", "no"},
    "phone_local": {"call", "phone", "tel", "telefon", "mobile", "fax", "whatsapp", "handy"},
}


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _is_ip(text: str) -> bool:
    parts = [p.lstrip("0") or "0" for p in text.split(".")]
    return all(len(p) <= 3 and int(p) <= 255 for p in parts)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of EMAIL, found from their ``@``: a name must end and a domain must start there."""
    done, at = 0, text.find("@")
    while at >= 0:
        if at > done and text[at - 1] in NAME_CHARS:
            domain = DOMAIN_ONCE.match(text, at + 1)
            if domain:
                low = at - 1
                while low > done and text[low - 1] in NAME_CHARS:
                    low -= 1
                yield low, domain.end()
                done = domain.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base kinds, by start, then kind as listed."""
    out = [(a, "email", b) for a, b in _emails(text)]
    for run in NUMBER_RUN.finditer(text):
        low, high = run.span()
        if high - low < 7:
            continue
        out += [(m.start(), "ip", m.end()) for m in IP_ONCE.finditer(text, low, high) if _is_ip(m.group())]
        for m in CARD_ONCE.finditer(text, low, high):
            if not 12 <= m.end() - m.start() <= 37:  # 19 digits and a separator between any two
                continue
            digits = re.sub("[^0-9]", "", m.group())
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), "card", m.end()))
        for m in PHONE.finditer(text, low, high):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), "phone", m.end()))
    return sorted(out, key=lambda s: (s[0], ORDER[s[1]], s[2]))


def _votes(kind: str, text: str, low: int, high: int) -> list[int]:
    """One vote per labeler: 1 for, 0 against, 2 abstains."""
    span, before, after = text[low:high], text[max(0, low - 32) : low], text[high : high + 2]
    words = re.findall(r"\w+", before.lower())
    digits = sum(c.isdigit() for c in span)
    cue = 1 if CUES[kind] & set(words[-3:]) else 2
    quoted = 1 if before[-1:] in "\"'=:" and before else (2 if after[:1] in " .,;\n" or not after else 0)
    if kind == "secret":
        shape = 1 if re.fullmatch(r"[0-9a-f]{32,}|[A-Z0-9]{20,}|(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z]).+", span) else 0
        test = 1 if digits >= 4 and digits / len(span) < 0.9 else 0
    elif kind == "account":
        shape = 1 if 12 <= digits <= 19 else 0
        test = 1 if len(set(span)) >= 6 else 0
    else:
        shape = 1 if 9 <= digits <= 11 else 0
        test = 1 if "(" in span or span.count("-") == 2 else 2
    return [shape, cue, quoted, test]


def _span_features(kind: str, text: str, low: int, high: int) -> list[int]:
    span = text[low:high]
    shape = re.sub("[0-9]+", "9", re.sub("[A-Z]+", "A", re.sub("[a-z]+", "a", span)))[:24]
    words = re.findall(r"\w+", text[max(0, low - 32) : low].lower())[-2:]
    found = [f"s:{kind}:{shape}", f"l:{kind}:{min(len(span), 64) // 4}", f"p:{kind}:{text[max(0, low - 1) : low]}"]
    found += [f"n:{kind}:{text[high : high + 1]}", *(f"w:{kind}:{w}" for w in words)]
    return sorted({int.from_bytes(hashlib.blake2b(f.encode(), digest_size=4).digest(), "little") >> (32 - BITS) for f in found})


def candidates(text: str, taken: list[tuple[int, str, int]]) -> list[tuple[str, int, int]]:
    """Loose spans of the added kinds that overlap no base span (nor each other within a kind)."""
    out, starts, ends = [], [], []
    for low, _, high in taken:  # in order of their starts
        if ends and low <= ends[-1]:
            ends[-1] = max(ends[-1], high)
        else:
            starts.append(low)
            ends.append(high)
    for kind, pattern in (("secret", LONG_RUN), ("account", DIGITS_RUN), ("phone_local", LOCAL_PHONE)):
        for m in pattern.finditer(text):
            a, b = m.span()
            if kind == "secret" and not any(c.isdigit() for c in m.group()):
                continue
            before = bisect_left(starts, b) - 1  # the last base span starting before b
            if before < 0 or ends[before] <= a:
                out.append((kind, a, b))
    return out


@dataclass(frozen=True)
class Reliability:
    """Share of positives of a kind, and per labeler P(vote | class) for votes 0, 1, 2."""

    prior: float
    table: np.ndarray  # (labeler, class, vote)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(positive) for rows of votes."""
        log = np.log(np.array([1 - self.prior, self.prior]))[None, :].repeat(len(votes), 0)
        for j in range(votes.shape[1]):
            log = log + np.log(self.table[j][:, votes[:, j]]).T
        log -= log.max(axis=1, keepdims=True)
        p = np.exp(log)
        return p[:, 1] / p.sum(axis=1)


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> Reliability:
    """Expectation-maximisation over vote patterns and how often each occurs.

    Starts from the belief that labelers are better than chance, which also
    settles which class is the positive one.
    """
    table = np.tile(np.array([[0.6, 0.15, 0.25], [0.15, 0.6, 0.25]]), (votes.shape[1], 1, 1))
    model = Reliability(0.5, table)
    for _ in range(rounds):
        p = model.posterior(votes)
        prior = float((p * counts).sum() / counts.sum())
        fresh = np.empty_like(table)
        for j in range(votes.shape[1]):
            for v in range(3):
                own = votes[:, j] == v
                fresh[j, 1, v] = (p * counts * own).sum() + table[j, 1, v] * 2
                fresh[j, 0, v] = ((1 - p) * counts * own).sum() + table[j, 0, v] * 2
        fresh /= fresh.sum(axis=2, keepdims=True)
        model = Reliability(min(max(prior, 1e-4), 1 - 1e-4), fresh)
    return model


def fit_spans(rows: list[list[int]], target: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Logistic regression weights (last one is the bias) on soft labels."""
    w = np.zeros((1 << BITS) + 1)
    if not rows:
        return w
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    at = np.array([i for r in rows for i in r], dtype=np.int64)
    gain = np.zeros_like(w)
    for _ in range(rounds):
        score = np.bincount(owner, w[at], len(rows)) + w[-1]
        g = 1 / (1 + np.exp(-np.clip(score, -35, 35))) - target
        grad = np.append(np.bincount(at, g[owner], 1 << BITS), g.sum()) / len(rows) + 1e-4 * w
        gain += grad * grad
        w -= 0.5 * grad / (np.sqrt(gain) + 1e-8)
    return w


_THIN = (
    "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, "
    "spans array<struct<kind:string,start:int,end:int,votes:int,features:array<int>>>"
)


def found_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One thin row per document: base counts and spans, and the candidates with their votes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in (part for whole in batches for part in text_slices(whole, "text")):
            rows = []
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = text or ""
                base = base_spans(text)
                joined = ",".join(f"{k}:{a}:{b}" for a, k, b in base)
                spans = [
                    {"kind": k, "start": a, "end": b, "votes": sum(v * 3**i for i, v in enumerate(_votes(k, text, a, b)))}
                    | {"features": _span_features(k, text, a, b)}
                    for k, a, b in candidates(text, base)
                ]
                kinds = [k for _, k, _ in base]
                rows.append(
                    {"id": key, **{f"n_{k}": kinds.count(k) for k in BASE}, "base": joined, "spans": spans}
                    | {"base_sha256": hashlib.sha256(joined.encode()).hexdigest()}
                )
            schema = schema or pa.schema(
                [("id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("base", pa.string())]
                + [("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("votes", pa.int32()), ("features", pa.list_(pa.int32()))])))]
            )
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
            del rows
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, _THIN)


@dataclass(frozen=True)
class SpanModel:
    """Labeler reliabilities by kind, and the span classifier's weights."""

    kinds: dict[str, Reliability]
    weights: np.ndarray


def _unpacked(votes: np.ndarray) -> np.ndarray:
    return np.stack([votes // 3**i % 3 for i in range(N_VOTES)], axis=1)


def fit(found: DataFrame, max_train: int = 20_000) -> SpanModel:
    """Reliabilities from all candidates; the classifier from at most ``max_train`` of them."""
    spans = found.select("id", F.explode("spans").alias("s")).select("id", "s.*")
    tally = spans.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).collect()  # <= kinds * 3**labelers rows
    kinds = {}
    for kind in sorted({r["kind"] for r in tally}):
        own = [r for r in tally if r["kind"] == kind]
        own.sort(key=lambda r: r["votes"])
        kinds[kind] = reliabilities(_unpacked(np.array([r["votes"] for r in own])), np.array([r["n"] for r in own], dtype=float))
    order = [F.xxhash64("id", "start", "kind"), F.col("start"), F.col("votes")]
    rows = spans.orderBy(*order).select("kind", "votes", "features").limit(max_train).collect() if kinds else []
    target = np.array([kinds[r["kind"]].posterior(_unpacked(np.array([r["votes"]])))[0] for r in rows])
    return SpanModel(kinds, fit_spans([r["features"] for r in rows], target))


def with_spans(found: DataFrame, model: SpanModel, threshold: float = 0.5) -> DataFrame:
    """The thin rows with ``all_spans``: base spans and the candidates the classifier accepts."""
    sent = found.sparkSession.sparkContext.broadcast(model.weights)

    def joined(base: pa.Array, spans: pa.Array) -> pa.Array:
        w, out = sent.value, []
        for b, s in zip(base.to_pylist(), spans.to_pylist(), strict=True):
            all_spans = [(int(x.split(":")[1]), ORDER[x.split(":")[0]], x) for x in b.split(",") if x]
            for c in s or []:
                p = 1 / (1 + np.exp(-(w[np.asarray(c["features"], dtype=np.int64)].sum() + w[-1])))
                if p >= threshold:
                    all_spans.append((c["start"], ORDER[c["kind"]], f"{c['kind']}:{c['start']}:{c['end']}"))
            out.append(",".join(x for _, _, x in sorted(all_spans)))
        return pa.array(out, pa.string())

    return found.withColumn("all_spans", F.arrow_udf(joined, "string")("base", "spans"))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: counts of the base kinds, the hash of its base spans, and all spans.

    Spans are kind:start:end in code points, end exclusive, by start, then kind.
    Null and empty texts have none.  Long texts are read whole, every character
    a fixed number of times.  Null ids and repeated rows are reported like any
    row; other columns are ignored; an empty table gives no rows.
    """
    found = written(found_spans(docs, id_col, text_col))
    out = with_spans(found, fit(found))
    return out.select(F.col("id").alias(id_col), *(f"n_{k}" for k in BASE), "base_sha256", F.col("all_spans").alias("spans"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every found span of the text replaced by its kind in brackets.

    The model is learned in a first pass over the texts; a second pass finds the
    spans again and replaces them, so no text is shuffled.  Null texts stay
    null, and all other columns stay as they are.
    """
    model = fit(written(found_spans(docs, id_col, text_col).select("id", "spans")))
    sent = docs.sparkSession.sparkContext.broadcast(model.weights)

    def clean(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = sent.value
        for column in columns:
            out = []
            for part in text_slices(pa.table({"text": column}), "text"):
                out += [_redacted(text, w) for text in part.column("text").to_pylist()]
            yield pa.array(out, pa.string())
            del out
        give_back()

    return docs.withColumn(text_col, F.arrow_udf(clean, "string")(F.col(text_col)))


def _redacted(text: str | None, weights: np.ndarray) -> str | None:
    """The text with its base spans and the accepted candidates replaced; overlapping ones are one place."""
    if not text:
        return text
    base = base_spans(text)
    spans = [(a, b, k) for a, k, b in base]
    for k, a, b in candidates(text, base):
        if weights[np.array(_span_features(k, text, a, b))].sum() + weights[-1] >= 0:
            spans.append((a, b, k))
    done, parts = 0, []
    for a, b, k in sorted(spans):
        if b <= done:
            continue
        if a >= done:
            parts += [text[done:a], f"[{k}]"]
        done = b
    return "".join([*parts, text[done:]])
