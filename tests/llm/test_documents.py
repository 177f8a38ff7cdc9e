"""Operators on texts: edge cases, and brute force on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from marketloom.llm import lm_score, minhash_dedup, mixing, packing, pii, repeats, toxicity
from marketloom.llm.sketch import super_minhash
from marketloom.llm.text_arrays import word_hashes

DOCS = "doc_id long, text string, source string, score double, kept string, h long"
rng = random.Random(5)
VOCAB = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def edited(text, every, seed):
    words, r = text.split(), random.Random(seed)
    return " ".join(w if r.random() > every else r.choice(VOCAB) for w in words)


@pytest.fixture(scope="module")
def rows():
    base = prose(200, 1)
    texts = [None, "", "  \n\t", "One", "one two", "ONE  TWO", base, base, edited(base, 0.02, 2), edited(base, 0.05, 3), edited(base, 0.1, 4)]
    texts += [prose(60, s) for s in range(10, 20)] + [prose(30, 21) + " " + base[:400] + " " + prose(30, 22)] + [prose(4000, 23)]
    texts += ["mail a.b@mail.example.com, +1 (555) 123-4567 card 4111 1111 1111 1111 ip 10.0.0.255 and 300.1.1.1", 'token = "' + "ab12" * 10 + '" é☃ x@y.z']
    texts += [edited(base, 0.03, 100 + s) for s in range(30)]
    out = [(i, t, f"s{i % 3}" if i % 7 else None, 0.5, "x", 3) for i, t in enumerate(texts)]
    return [*out, out[6], (None, base, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words_of(text):
    return (text or "").encode().lower().split()


def test_words_match_bytes_split(rows):
    texts = [r[1] for r in rows] + ["a" * 3_000_000, "é  A\x0bb\x1cc"]
    _, at = word_hashes(pa.array(texts))
    assert np.diff(at).tolist() == [len(words_of(t)) for t in texts]


def test_super_minhash_estimates_similarity():
    g = np.random.default_rng(1)
    for n, shared in ((300, 240), (20, 10), (5, 5), (1, 1)):
        a = g.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate((a[:shared], g.integers(0, 2**63, n - shared).astype(np.uint64)))
        s = super_minhash([a, b], 256)
        assert abs((s[0] == s[1]).mean() - shared / (2 * n - shared)) < 0.12


def components(sets, ids, percent):
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                parent[x] = y
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(least.get(root(i), d), d)
    return [least[root(i)] for i in range(len(ids))]


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_brute_force(docs, rows, size):
    got = minhash_dedup.near_duplicates(docs, words=size, percent=80).collect()
    known = [r for r in rows if r[0] is not None]
    sets = []
    for r in known:
        w = words_of(r[1])
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    want = components(sets, [r[0] for r in known], 80)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None) == sorted(
        (r[0], len(s), c, c == r[0]) for r, s, c in zip(known, sets, want, strict=True)
    )
    lost = [r for r in got if r.doc_id is None]
    assert len(lost) == 1 and lost[0].component_id is None and lost[0].kept


def test_leftover_groups_are_searched(spark):
    """A chain: neighbours are similar, ends are not; every member must still be found."""
    words = prose(100, 77).split()
    chain = []
    for i in range(12):
        words = words[:]
        for k in range(4):
            words[(i * 4 + k) * 2 % 100] = f"new{i}x{k}"
        chain.append((i, " ".join(words)))
    got = minhash_dedup.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string"), words=2, percent=80).collect()
    sets = [set(zip(t.split(), t.split()[1:], strict=False)) for _, t in chain]
    assert sorted((r.doc_id, r.component_id) for r in got) == list(enumerate(components(sets, range(12), 80)))


def test_without_near_duplicates_keeps_columns(docs, empty):
    out = minhash_dedup.without_near_duplicates(docs, words=5, percent=80)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None}) and 7 not in ids and {0, 1, 2, 6} <= set(ids)
    assert minhash_dedup.without_near_duplicates(empty).count() == 0


def test_toxicity_learns_planted_words(spark):
    r = random.Random(3)
    data = [(i, prose(40, i) + (" " + r.choice(["vile", "rotten"]) if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    frame = spark.createDataFrame(data, "doc_id long, text string, label int")
    model = toxicity.fit(frame, frame.where("doc_id < 300"), label_col="label")
    got = {x.doc_id: x.score for x in toxicity.with_score(frame, model).collect()}
    bad = [got[i] for i in range(300, 400) if i % 4 == 0]
    good = [got[i] for i in range(300, 400) if i % 4]
    assert min(bad) > max(good)


def test_toxicity_edges(spark, docs, empty):
    model = toxicity.fit(docs, docs.selectExpr("doc_id", "cast(null as int) as toxic"))
    out = toxicity.with_score(docs, model)
    assert out.columns == docs.columns and all(0 <= r.score <= 1 for r in out.collect())
    assert toxicity.with_score(empty, model).count() == 0
    only = toxicity.fit(docs, docs.selectExpr("doc_id", "1 as toxic"))
    assert only.bias > 0


def test_held_out_is_crc32(spark):
    frame = spark.range(50).withColumn("held", toxicity.is_held_out("id"))
    assert all(r.held == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in frame.collect())


def test_mixing_stays_within_a_block(spark):
    data = [(i, "abcd"[0 if i % 3 else i % 4]) for i in range(4000)]
    weights = {"a": 5, "b": 3, "c": 1}
    out = mixing.mix(spark.createDataFrame(data, "doc_id long, source string"), weights, default_weight=2, block=4).collect()
    assert sorted(r.doc_id for r in out) == list(range(4000)) and len({r._position for r in out}) == 4000
    for phase in {r._phase for r in out}:
        own = [r for r in out if r._phase == phase]
        served = sorted({(r._slot, r.source) for r in own})
        assert len({s for s, _ in served}) == len(served)
        names = {s for _, s in served}
        total = sum(weights.get(s, 2) for s in names)
        seen = Counter()
        for t, (_, s) in enumerate(served, 1):
            seen[s] += 1
            assert all(abs(seen[x] - t * weights.get(x, 2) / total) < 1 for x in names)


def test_mixing_edges(docs, empty, rows):
    out = mixing.mix(docs, {"s1": 3})
    assert out.count() == len(rows) and set(docs.columns) <= set(out.columns)
    assert mixing.mix(empty, {}).count() == 0
    ordered = mixing.in_order(out).select("_position").collect()
    assert [r[0] for r in ordered] == sorted(r[0] for r in ordered)
    with pytest.raises(ValueError):
        mixing.mix(docs, {"s1": 0})


def test_packing_round_trip(docs, empty, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    coder = Tokenizer.from_file(path)
    out = packing.pack(docs, path, capacity=128, keep_ids=True).collect()
    want = Counter()
    for r in rows:
        ids = np.array([*coder.encode(r[1] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for k in range(0, len(ids), 128):
            raw = ids[k : k + 128].tobytes()
            want[(r[0], k // 128, k, len(raw) // 4, zlib.crc32(raw), raw)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in out) == want
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 128
    assert len(bins) <= math.ceil(sum(r.length for r in out) / 128) + 1
    assert packing.pack(empty, path).count() == 0


def test_tokens_of_odd_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    coder, own = Tokenizer.from_file(path), packing.WordTokens(path, bound=20)
    texts = ["a<|endoftext|>b c", "don't I'LL, we.re", "é ́x\u00a0y", "x,.y;z 1.2,3 ﬁ İ Σς", "", "A,B.", "\x1cq\x00r", "名前,です."]
    texts += ["T\u0308x t\u0308 É", "<|startoftext|> B<|startoftext|>,C"]
    ids, at = own.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == coder.encode(t, add_special_tokens=False).ids
    for t in ("A <|ENDOFTEXT|> b", "Only Words HERE"):
        assert own.encode(pa.array([t]))[0].tolist() == coder.encode(t, add_special_tokens=False).ids


def test_fullest_is_optimal():
    r = random.Random(9)
    for _ in range(200):
        stock = {r.randint(1, 30): r.randint(1, 3) for _ in range(r.randint(1, 6))}
        room = r.randint(0, 60)
        got = packing.fullest(stock, room)
        assert all(c <= stock[x] for x, c in got.items())
        sums = {0}
        for x, c in stock.items():
            sums = {s + k * x for s in sums for k in range(c + 1)}
        assert sum(x * c for x, c in got.items()) == max(s for s in sums if s <= room)


def test_pii_base_spans_equal_patterns(docs, rows, empty):
    kinds = ["email", "ip", "card", "phone"]
    got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.detect(docs).collect())
    want = Counter()
    for r in rows:
        text, spans = r[1] or "", []
        spans += [(m.start(), 0, m.end()) for m in pii.EMAIL.finditer(text)]
        spans += [(m.start(), 1, m.end()) for m in pii.IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
        for m in pii.CARD.finditer(text):
            d = re.sub("[^0-9]", "", m.group())
            total = sum(int(c) for c in d[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in d[-2::-2])
            if 12 <= len(d) <= 19 and total % 10 == 0:
                spans.append((m.start(), 2, m.end()))
        spans += [(m.start(), 3, m.end()) for m in pii.PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
        spans.sort()
        joined = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)
        want[(r[0], *(sum(s[1] == k for s in spans) for k in range(4)), hashlib.sha256(joined.encode()).hexdigest())] += 1
    assert got == want
    assert pii.detect(empty).count() == 0


def test_pii_redacts(docs):
    out = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    found = [t for t in out.values() if t and "[email]" in t]
    assert found and not any("example.com" in (t or "") or "4111" in (t or "") for t in out.values())
    assert out[0] is None and out[3] == "One"


def test_reliabilities_trust_the_better_labeler():
    g = np.random.default_rng(2)
    truth = g.random(4000) < 0.4
    votes = np.stack([np.where(g.random(4000) < acc, truth, ~truth).astype(int) for acc in (0.95, 0.9, 0.6, 0.85)], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = pii.reliabilities(patterns, counts.astype(float))
    assert model.table[0, 1, 1] > model.table[2, 1, 1]
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.93


def test_lm_scores_equal_direct_counts(docs, rows, empty):
    got = lm_score.score(docs).collect()
    counts, texts = Counter(), []
    for r in rows:
        w = [*words_of(r[1]), None]
        texts.append((r[0], w))
        if lm_score.is_training(r[0]):
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    want = Counter((i, len(w), sum(counts[x] > 0 for x in w), round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)) for i, w in texts)
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {n} and all(r.score < 0 for r in got)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert lm_score.score(empty).count() == 0


def test_mixture_weights_find_the_better_estimate():
    bucket, ratio, n = np.array([1, 1, 2, 2]), np.array([100, -lm_score.LIMIT - 1, 100, -lm_score.LIMIT - 1]), np.array([90, 10, 5, 95])
    w = lm_score.mixture_weights(bucket, ratio, n)
    assert w[1] > 0.8 > 0.1 > w[2] and w[5] == w[2]


@pytest.mark.parametrize("group", [2_000, 1])
def test_repeats_equal_brute_force(spark, docs, rows, empty, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)  # workers are forked per session, so the answers run in this process too
    got = repeats.without_repeats(docs, length=200).collect()
    data, seen = [(r[1] or "").encode() for r in rows], Counter()
    for b in data:
        seen.update(b[i : i + 200] for i in range(len(b) - 199))
    want = Counter()
    for r, b in zip(rows, data, strict=True):
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate(([False], gone)).astype(int)) == 1).sum())
        want[(r[0], len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert all(len(r.kept) == r.n_bytes - r.n_removed for r in got)
    assert repeats.without_repeats(empty).count() == 0


@pytest.mark.parametrize("large", [False, True])
def test_repeat_answers_agree(monkeypatch, large):
    """Gathered groups and single strings mark the same bytes."""
    from marketloom.llm import blocks as bl

    monkeypatch.setattr(repeats, "GROUP", 1 if large else 10_000)
    shared = prose(150, 5)
    texts = [prose(20, s) + shared[s * 7 : 600 + s * 11] + prose(20, 50 + s) for s in range(12)]
    sink = pa.BufferOutputStream()
    table = pa.table({"id": list(range(len(texts))), "text": texts})
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    blob, count = sink.getvalue().to_pybytes(), 3
    asks = dict(repeats._ask_spans(count, 200)(blob, False))
    answers = {r: repeats._answer_spans(r, [a])[0] for r, a in asks.items()}
    second = repeats._ask_contexts(count, 200)(7, blob, answers)
    answer = repeats._answer_contexts(count, 200)
    for r, a in zip(second.column("range").to_pylist(), second.column("ask").to_pylist(), strict=True):
        answers[count + r] = answer(r, [a])[0]
    out = repeats._removed(count, 200, real=False)(7, blob, answers).to_pylist()
    seen = Counter(t.encode()[i : i + 200] for t in texts for i in range(len(t.encode()) - 199))
    for r, t in zip(out, texts, strict=True):
        b, gone = t.encode(), np.zeros(len(t.encode()), dtype=bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        assert r["n_removed"] == int(gone.sum())
    assert bl.block_rows(blob).num_rows == len(texts)
