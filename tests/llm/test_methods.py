"""The training-data operators against plain models, texts made to fool hashes, odd columns, and their registered forms."""

import hashlib
import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketloom.llm import lm_score, minhash_dedup, mixing, packing, pii, registry, repeats, text_arrays, toxicity, url_filter
from marketloom.llm.common import written

SMALL = "/root/testdata/sf0.001"


def thue_morse(n, flip):
    """A word whose polynomial hash modulo 2**64 equals that of its complement from 1,024 letters on."""
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join("ab"[b ^ flip] for b in bits[:n])


def odd_words():
    return [thue_morse(n, f) for n in (512, 1024, 2048, 4096) for f in (0, 1)]


def test_words_are_told_apart():
    hashes, at = text_arrays.word_hashes(pa.array(odd_words()))
    assert len(set(hashes.tolist())) == 8 and at.tolist() == list(range(9))
    data = np.frombuffer(" ".join(["abcdefgh" * k for k in range(1, 30)]).encode(), dtype=np.uint8)
    ends = np.cumsum([8 * k + 1 for k in range(1, 30)]) - 1
    starts = ends - np.array([8 * k for k in range(1, 30)])
    other = np.concatenate((starts[1:], starts[:1]))
    assert text_arrays.same_ranges(data, starts, ends, data, starts, ends).all()
    assert not text_arrays.same_ranges(data, starts, ends, data, other, np.concatenate((ends[1:], ends[:1]))).any()


def test_tokens_of_words_with_one_hash(monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    r = random.Random(2)
    texts = [" ".join("".join(r.choice("abcd") for _ in range(r.randint(1, 7))) for _ in range(r.randint(0, 12))) for _ in range(60)]
    monkeypatch.setattr(text_arrays, "range_hashes", lambda data, start, end: ((end - start) % 3).astype(np.uint64))
    coder = packing.WordTokens(path, bound=50)
    for low in range(0, 60, 6):
        own = [*texts[low : low + 6], *odd_words()]
        ids, at = coder.encode(pa.array(own))
        for i, t in enumerate(own):
            assert ids[at[i] : at[i + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids


def test_operators_tell_odd_words_apart(spark):
    rows = [(i, f"{w} same words") for i, w in enumerate(odd_words())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash_dedup.near_duplicates(docs, words=2, percent=80).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, 2, i) for i in range(8)}
    trained = Counter(w for i, t in rows if lm_score.is_training(i) for w in [*t.split(), None])
    want = {i: sum(trained[w] > 0 for w in [*t.split(), None]) for i, t in rows}
    assert {r.doc_id: r.n_known for r in lm_score.score(docs).collect()} == want
    data = [t.encode() for _, t in rows]
    seen = Counter(b[i : i + 200] for b in data for i in range(len(b) - 199))
    for r in repeats.without_repeats(docs, length=200).collect():
        b = data[r.doc_id]
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        assert (r.n_removed, r.kept_sha256) == (int(gone.sum()), hashlib.sha256(np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()).hexdigest())


def test_long_runs_take_linear_time():
    for text in ("1" * 1_000_000, "a" * 1_000_000 + "@", "a@" * 500_000, "1." * 500_000, "+1" + "-" * 1_000_000):
        began = time.process_time()
        pii.candidates(text, pii.base_spans(text))
        assert time.process_time() - began < 2


@pytest.mark.parametrize("letters", ["a1@.-", "1. -+(", "1.", "a@.", "01 ", "aé@_.%1"])
def test_base_spans_are_those_of_the_plain_patterns(letters):
    r = random.Random(1)
    for _ in range(3000):
        text = "".join(r.choice(letters) for _ in range(r.randint(1, 30)))
        want = [(m.start(), "email", m.end()) for m in pii.EMAIL.finditer(text)]
        want += [(m.start(), "ip", m.end()) for m in pii.IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
        for m in pii.CARD.finditer(text):
            digits = [int(c) for c in m.group() if c.isdigit()]
            total = sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])
            if 12 <= len(digits) <= 19 and total % 10 == 0:
                want.append((m.start(), "card", m.end()))
        want += [(m.start(), "phone", m.end()) for m in pii.PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
        assert pii.base_spans(text) == sorted(want, key=lambda s: (s[0], pii.ORDER[s[1]], s[2]))


def test_spans_are_base_ones_and_what_the_classifier_takes(spark):
    r = random.Random(4)
    secret = lambda: "".join(r.choice("abcdefXYZ0123456789") for _ in range(32))
    texts = [f"key = \"{secret()}\" mail a{i}@b.example.com" if i % 2 else f"call 021-555-{i:04d} now" for i in range(40)] + [None, "", "plain words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = written(pii.found_spans(docs, "doc_id", "text"))
    model = pii.fit(found)
    got = {x.doc_id: x.spans for x in pii.detect(docs).collect()}
    for i, text in enumerate(texts):
        base = pii.base_spans(text or "")
        spans = [(a, pii.ORDER[k], f"{k}:{a}:{b}") for a, k, b in base]
        for k, a, b in pii.candidates(text or "", base):
            score = sum(model.weights[f] for f in pii._span_features(k, text, a, b)) + model.weights[-1]
            if 1 / (1 + math.exp(-score)) >= 0.5:
                spans.append((a, pii.ORDER[k], f"{k}:{a}:{b}"))
        assert got[i] == ",".join(s for _, _, s in sorted(spans))
    assert sum("secret" in s for s in got.values()) >= 15 and got[40] == got[41] == got[42] == ""


def test_mixing_keeps_columns_of_any_name(spark):
    names = ["doc_id", "source", "_slot", "_rank", "_before", "_slice", "_row", "_BLOCK", "_phase", "_share", "_position", "c0", "a.b", "_source", "phase", "first"]
    rows = [(i, "ab"[i % 2], *(f"{n}{i}" for n in names[2:])) for i in range(50)] + [(None,) * len(names)]
    docs = spark.createDataFrame(rows, ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    out = mixing.mix(docs, {"a": 3}, block=4)
    assert out.columns[: len(names)] == names and len(out.columns) == len(set(c.lower() for c in out.columns)) == len(names) + 5
    kept = mixing.in_order(out)
    assert sorted(map(repr, (tuple(r)[: len(names)] for r in kept.collect()))) == sorted(map(repr, rows))
    placed = mixing.laid_out(written(docs.withColumn("_place", F.lit("x")).withColumn("_file", F.lit("y"))))
    assert sorted(r[-1] for r in placed.collect()) == list(range(51)) and placed.columns[-1] == "__place"
    assert mixing.mix(docs.limit(0), {"a": 3}).count() == 0


def test_mixing_many_sources_and_a_long_cycle(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "concat('s', id % 5000) as source")
    weights = {f"s{i}": 200 for i in range(5000)}
    out = mixing.mix(docs, weights, block=2).select("doc_id", "source", "_phase", "_slot").collect()
    assert sorted(r.doc_id for r in out) == list(range(20_000))
    served = sorted({(r._slot, r.source) for r in out})
    seen, phase = Counter(), {r._slot: r._phase for r in out}
    for t, (slot, s) in enumerate(served, 1):
        seen[s] += 1
        if phase[slot] == 0:
            assert seen[s] - t / 5000 < 1
    rest = mixing.mix(docs, {"s1": 7, "s2": 999_993}, block=2)
    assert rest.count() == 20_000 and rest.agg(F.countDistinct("_position")).first()[0] == 20_000


def test_ftrl_equals_a_plain_loop():
    r = np.random.default_rng(5)
    cfg = toxicity.Settings(bits=6, l1=0.3, epochs=2)
    rows = [(np.unique(r.integers(0, 64, r.integers(1, 12))).astype(np.int32), int(r.random() < 0.4)) for _ in range(80)]
    got, seen = toxicity.fit_rows(rows, cfg)
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        l1 = 0.0 if i == 64 else cfg.l1
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((cfg.beta + math.sqrt(n[i])) / cfg.alpha + cfg.l2)

    for _ in range(cfg.epochs):
        for x, y in rows:
            own = [*x.tolist(), 64]
            w = {i: weight(i) for i in own}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in own:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / cfg.alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    assert np.allclose(got, [weight(i) for i in range(65)]) and np.allclose(seen, [n[i] for i in range(65)])


def test_training_sample_is_bounded(spark):
    data = [(i, "good words here " * 50 + ("vile" if i % 2 else "fine"), i % 2) for i in range(200)]
    frame = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    small = toxicity.fit(frame, frame, cfg=toxicity.Settings(max_coordinates=60))
    none = toxicity.fit(frame, frame, cfg=toxicity.Settings(max_coordinates=1))
    assert len(small.index) <= 60 and len(none.index) == 0 and none.bias == toxicity.UNTRAINED


def test_propagation_equals_dense_iteration(spark):
    r = np.random.default_rng(6)
    n, rounds, damping = 7, 9, 0.85
    links = (r.random((n, n)) < 0.4) * r.integers(1, 4, (n, n))
    np.fill_diagonal(links, 0)
    share = links / np.maximum(links.sum(axis=1, keepdims=True), 1)
    seed = r.random(n)
    want = seed * (1 - damping)
    for _ in range(rounds):
        want = seed * (1 - damping) + damping * want @ share
    edges = [(f"h{i}", f"h{j}", float(share[i, j])) for i in range(n) for j in range(n) if links[i, j]]
    got = url_filter.propagated(
        spark.createDataFrame(edges, "src string, dst string, share double"), spark.createDataFrame([(f"h{i}", float(s)) for i, s in enumerate(seed)], "host string, seed double"), damping, rounds
    ).collect()
    assert np.allclose([x.score for x in sorted(got, key=lambda x: x.host)], want)


def test_links_without_a_scheme_count(spark):
    html = "<a href='//B.example.org/x'>1</a><a href=/own>2</a><A HREF=\"https://c.example.org\">3</A><a href='//a.example.org'>4</a>"
    pages = spark.createDataFrame([("http://a.example.org/", html), ("http://a.example.org/2", None)], "url string, html string")
    got = url_filter.host_edges(pages, url_filter.host_of(F.col("url")), F.col("html")).collect()
    assert {(x.src, x.dst, x.n) for x in got} == {("a.example.org", "b.example.org", 1), ("a.example.org", "c.example.org", 1)}


def test_interpolated_scores_equal_a_plain_model(spark):
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(30)]
    texts = []
    for _ in range(160):
        words, at = [], r.randrange(30)
        for _ in range(r.randint(0, 40)):
            words.append(vocab[at])
            at = (at + 1) % 30 if r.random() < 0.7 else r.randrange(30)
        texts.append(" ".join(words))
    tokens = [["<", *t.split(), ">"] for t in texts]
    train = [i for i in range(160) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = {i for i in train if zlib.crc32(b"held back %d" % i) % 10 == 0}
    assert len(held) > 3

    def counts(ids):
        one, two = Counter(), Counter()
        for i in ids:
            one.update(tokens[i][1:])
            two.update(zip(tokens[i], tokens[i][1:], strict=False))
        return one, two

    def parts(model, i):
        one, two = model
        n, v = sum(one.values()), len(one)
        for a, b in zip(tokens[i], tokens[i][1:], strict=False):
            context = one[">"] if a == "<" else one[a]
            yield context, (two[a, b] / context if context else 0.0), (one[b] + 1) / (n + v + 1)

    fitted, bucket = counts([i for i in train if i not in held]), lambda c: min(c.bit_length(), lm_score.BUCKETS - 1)
    gains = defaultdict(list)
    for i in held:
        for context, high, low in parts(fitted, i):
            if context:
                ratio = np.rint(np.clip(math.log(high / low) / lm_score.STEP, -lm_score.LIMIT, lm_score.LIMIT)) if high else None
                gains[bucket(context)].append(math.exp(ratio * lm_score.STEP) if high else 0.0)
    weights = [0.0] * lm_score.BUCKETS
    for b in range(1, lm_score.BUCKETS):
        weights[b] = weights[b - 1]
        if gains[b]:
            w = 0.5
            for _ in range(60):
                w = min(sum(w * g / (w * g + 1 - w) for g in gains[b]) / len(gains[b]), 0.999)
            weights[b] = w
    full = counts(train)
    got = {x.doc_id: x.score for x in lm_score.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i in range(160):
        want = sum(math.log10(weights[bucket(c)] * high + (1 - weights[bucket(c)]) * low) for c, high, low in parts(full, i))
        assert abs(got[i] - want) < 1e-6


COLUMNS = {
    "op1": "doc_id:bigint held_out:boolean score:double predicted:int",
    "op2": "query_id:bigint rank:int vec_id:bigint score:double",
    "op3": "doc_id:bigint n_shingles:bigint component_id:bigint kept:boolean",
    "op4": "vec_id:bigint n_links:bigint component_id:bigint kept:boolean",
    "op5": "doc_id:bigint piece:int start:bigint length:bigint ids_crc32:bigint sequence_id:bigint offset:bigint",
    "op6": "page_id:bigint host:string path:string rule:string verdict:string",
    "op7": "doc_id:bigint held_out:boolean n_tokens:bigint n_known:bigint train_tokens:bigint base_score:double score:double",
    "op8": "doc_id:bigint n_email:bigint n_ip:bigint n_card:bigint n_phone:bigint base_sha256:string spans:string",
    "op9": "doc_id:bigint source:string phase:int block:bigint slot:bigint position:bigint",
    "op10": "doc_id:bigint n_bytes:bigint n_removed:bigint n_spans:bigint kept_sha256:string",
    "op11": "vec_id:bigint cluster:int distance:bigint cluster_inertia:bigint inertia:bigint centroid_sha256:string",
    "op12": "doc_id:bigint n_tokens:bigint ids_sha256:string decoded_sha256:string",
    "op13": "vec_id:bigint component:int n:bigint deviation:bigint whitened:double explained:double identity_error:double",
}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_registered_queries_return_their_columns(spark, name):
    frame = registry.QUERIES[name](spark, SMALL)
    kinds = dict(frame.dtypes)
    assert {c: kinds[c] for c in kinds} | dict(x.split(":") for x in COLUMNS[name.split("_")[0]].split()) == kinds
    rows = frame.collect()
    table = {"op2": None, "op4": "embeddings", "op6": "pages", "op11": "embeddings", "op13": "embeddings"}.get(name.split("_")[0], "documents")
    if table and not name.startswith("op5"):
        assert len(rows) == spark.read.parquet(f"{SMALL}/{table}.parquet").count() * (8 if name.startswith("op13") else 1)
    if name.startswith("op1_"):
        assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    if name.startswith("op5"):
        assert sum(r.length for r in rows) == sum(max(r.start + r.length for r in rows if r.doc_id == i) for i in {r.doc_id for r in rows})


CLASHING = "doc_id long, text string, lang string, source string, n_chars int, _toxicity string, _h2 string, _id string, _kept string, c0 string, _place string, _copies string"


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_odd_rows_and_columns(spark, stage, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(900, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    texts = [None, "", " \n", "One", "mail a.b@c.example.com now", "long " * 30_000, *("same text of some words in a row " + str(i) for i in range(3))]
    rows = [(i, t, "en", f"src{i % 3}" if i % 4 else None, len(t or ""), *(f"{k}{i}" for k in range(7))) for i, t in enumerate(texts)]
    rows += [rows[4], (None, "no id", None, None, None, *[None] * 7)]
    docs = written(spark.createDataFrame(rows, CLASHING))
    run = corpus_pipeline.STAGES[stage][1]
    out = run(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = out.collect()
    name = corpus_pipeline.STAGES[stage][0]
    same = lambda x: sorted(map(repr, map(tuple, x)))
    if name in ("toxicity", "mixing"):
        assert same(got) == same(rows)
    elif name == "minhash_dedup":
        assert {r.doc_id for r in got} == {*range(9), None} and len(got) == 10
    else:
        assert len(got) == len(rows) and [r.text for r in got if r.doc_id == 4] == ["mail [email] now"] * 2
        assert same((r.doc_id, *r[5:]) for r in got) == same((r[0], *r[5:]) for r in rows) and {r.text for r in got if r.doc_id in (0, 1)} == {None, ""}
        assert all(r.n_chars == len(r.text) for r in got if r.text is not None)
    assert run(spark, written(docs.limit(0)), str(tmp_path)).count() == 0


def test_packing_stage_takes_any_rows(spark):
    import corpus_pipeline

    rows = [(i, t, "p") for i, t in enumerate([None, "", "a b", "word " * 5000])] + [(2, "a b", "p"), (None, "x", None)]
    docs = written(spark.createDataFrame(rows, "doc_id long, text string, _place string"))
    out = corpus_pipeline.pack_sequences(spark, docs, "").collect()
    assert Counter(r.doc_id for r in out if r.piece == 0) == {0: 1, 1: 1, 2: 2, 3: 1, None: 1} and max(r.offset + r.length for r in out) <= 2048
    assert corpus_pipeline.pack_sequences(spark, written(docs.limit(0)), "").count() == 0
