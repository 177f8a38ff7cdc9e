"""Centroids, byte-level BPE and whitening against plain versions; ids of two texts, vectors of several lengths."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import pyarrow as pa
from pyspark.sql import functions as F

from marketloom.llm import byte_bpe, centroids, hash_index, minhash_dedup, vector_dedup, whitening

VECTORS = "vec_id long, embedding array<float>, cluster int, component string"
ODD = [(900, None), (901, []), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (904, [1.0, None] * 4), (905, [1.0] * 7)]


@pytest.fixture(scope="module")
def vectors():
    g = np.random.default_rng(11)
    x = (g.standard_normal((300, 8)) + 3 * g.integers(0, 3, (300, 1))).astype(np.float32)
    x[10:20] = x[0]  # equal vectors start several centroids
    x[20] = 0
    return x


@pytest.fixture(scope="module")
def frame(spark, vectors):
    rows = [(i, v.tolist(), 0, "x") for i, v in enumerate(vectors)]
    return spark.createDataFrame([*rows, rows[3], (None, [0.5] * 8, 0, "x"), *((i, v, 0, "x") for i, v in ODD)], VECTORS)


def plain_clusters(ids, x, k, rounds, scale):
    """The same rounds in Python's integers, every centroid tried."""
    x = [[int(np.floor(scale * float(c))) for c in row] for row in x]
    key = lambda i: (ids[i] is None, hashlib.sha256(f"1:{ids[i]}".encode()).hexdigest())
    centres = [x[i] for i in sorted(range(len(x)), key=key)[:k]]

    def assign():
        every = [[sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centres] for v in x]
        return [(row.index(min(row)), min(row)) for row in every]

    for _ in range(rounds):
        found = assign()
        for c in range(len(centres)):
            mine = [x[i] for i, (n, _) in enumerate(found) if n == c]
            if mine:
                centres[c] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return assign(), centres


@pytest.mark.parametrize("k,scale", [(6, 64), (16, 1), (400, 8)])
def test_clusters_equal_brute_force(frame, vectors, k, scale):
    out, made = centroids.cluster(frame, k=k, rounds=3, dims=8, scale=scale)
    got = sorted(((r.vec_id, r.cluster, r.distance) for r in out.collect()), key=str)
    ids = [*range(300), 3, None]
    found, centres = plain_clusters(ids, [*vectors.tolist(), vectors[3].tolist(), [0.5] * 8], k, 3, scale)
    assert made.rows == centres
    assert got == sorted(((i, c, d) for i, (c, d) in zip(ids, found, strict=True)), key=str)
    r = out.where("vec_id = 7").first()
    assert r.inertia == sum(d for _, d in found) and r.cluster_inertia == sum(d for c, d in found if c == r.cluster)
    assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[r.cluster])).encode()).hexdigest()


def test_cluster_edges(spark, frame):
    assert centroids.cluster(frame.limit(0), dims=8)[0].count() == 0
    assert centroids.cluster(frame, dims=5)[0].count() == 0
    one = spark.createDataFrame([(5, [-0.3, 0.2], 0, "x")], VECTORS)
    assert [tuple(r) for r in centroids.cluster(one, dims=2)[0].select("vec_id", "cluster", "distance").collect()] == [(5, 0, 0)]


def test_search_rejects_no_winner():
    g = np.random.default_rng(2)
    for size in (3, 1000, 1 << 23, 1 << 40):
        x = g.integers(-size, size, (500, 6))
        x[:40] = x[40:80]
        own = centroids.Centroids(np.vstack([x[:20], x[40:50]]).tolist())
        for a, b in zip(own.nearest(x), own._exhaustive(x), strict=True):
            assert a.tolist() == b.tolist()


def test_components_beyond_64_bits(spark):
    far = spark.createDataFrame([(i, [1e9 * i, -1e9]) for i in range(4)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.cluster, r.distance) for r in centroids.cluster(far, k=4, dims=2, scale=1)[0].collect()}
    assert len({c for c, _ in got.values()}) == 4 and {d for _, d in got.values()} == {0}


def path():
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = byte_bpe.Vocabulary.load(path()).ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.Coder(byte_bpe.Vocabulary.load(path()), public_tokenizers.PATTERN, spaced=True, bound=500)


BITS = [" ", "  ", "\n", "\t", "\r", "\x1c", " ", "　", " ", "\x85", "'s", "'ll", "'", "a", "Foo", "bar9", "é", "漢字", "😀", ".", "!!", "12", "٣", "_", "́", "​"]


def texts(r, n):
    pools = (BITS, BITS[:6] + BITS[10:])  # with and without white space that is not ASCII
    return ["".join(r.choice(pools[i % 2]) for _ in range(r.randint(0, 14))) for i in range(n)]


def test_texts_as_the_library_encodes_them(coder, library):
    some = [*texts(random.Random(1), 3000), None, "", "a" * 5000, " " * 5000 + "b", "x " * 3000, "\n".join(["w"] * 50)]
    ids, at = coder.encode_all(pa.array(some))
    for i, text in enumerate(some):
        own = ids[at[i] : at[i + 1]].tolist()
        assert own == library.encode_ordinary(text or "") == coder.encode(text or "")
        assert coder.decode(own) == (text or "").encode()


def test_every_prefix_and_any_bytes(coder, library):
    r, v = random.Random(3), coder.vocabulary
    tokens = list(v.ranks)
    for _ in range(1500):
        data = b"".join(r.choice(tokens) for _ in range(r.randint(1, 4)))[: r.randint(1, 40)]
        table = byte_bpe.Prefixes(v, data)
        assert table.ids() == library._core_bpe.encode_single_piece(data)
        cut = r.randint(0, len(data))
        assert table.last[:cut] == byte_bpe.Prefixes(v, data[:cut]).last


def test_prefixes_under_appends_and_changes(coder):
    r, v = random.Random(4), coder.vocabulary
    table = byte_bpe.Prefixes(v, b"the quick brown fox " * 40)
    for _ in range(300):
        low = r.randint(0, len(table.data))
        table.replace(low, min(len(table.data), low + r.randint(0, 4)), r.choice([b"", b"a", b" the", b"\xc3"]))
        table.append(r.choice([b"", b" fox"]))
        assert table.last == byte_bpe.Prefixes(v, table.data).last
    assert table.replace(100, 101, b"y") < 4 * v.longest < len(table.data)  # most entries stay


def test_texts_under_change(coder, library):
    r = random.Random(5)
    own = byte_bpe.Edited(coder, "".join(texts(r, 30)) + "x" * 300 + " " * 150)
    for _ in range(400):
        low = r.randint(0, len(own.text))
        own.replace(low, min(len(own.text), low + r.randint(0, 4)), "".join(r.choice([*BITS, "xxx"]) for _ in range(r.randint(0, 3))))
        own.append(r.choice(["", "", "x", " y"]))
        assert own.ids() == library.encode_ordinary(own.text)


def test_a_vocabulary_whose_merges_do_not_make_a_token():
    v = byte_bpe.Vocabulary({bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abcd": 258})
    assert not v.made(258) and byte_bpe.Prefixes(v, b"abcd").ids() == [256, 99, 100]
    assert byte_bpe.Coder(v, r"\w+").encode("abcd") == [258]  # a whole piece is its token
    with pytest.raises(ValueError):
        byte_bpe.Prefixes(byte_bpe.Vocabulary({b"a": 0}), b"ab")


def test_frames_of_texts(spark, library):
    some = [(1, "Hello  world", "x"), (1, "Hello  world", "x"), (2, None, "y"), (None, "", "z"), (3, "a  b", "w")]
    docs = spark.createDataFrame(some, "doc_id long, text string, ids string")
    out = byte_bpe.encoded(docs, path(), public_tokenizers.PATTERN, spaced=True)
    assert out.columns == ["doc_id", "text", "ids", "_ids"]
    back = byte_bpe.decoded(out, path(), ids_col="_ids")
    for r in back.collect():
        assert r["_ids"] == library.encode_ordinary(r.text or "") and r.bytes == (r.text or "").encode()
    hashes = byte_bpe.digests(docs, path(), public_tokenizers.PATTERN).collect()
    nothing = hashlib.sha256(b"").hexdigest()
    assert len(hashes) == 5 and all(h.ids_sha256 == h.decoded_sha256 == nothing for h in hashes if h.doc_id in (2, None))
    assert byte_bpe.digests(docs.limit(0), path(), public_tokenizers.PATTERN).count() == 0
    assert byte_bpe.encoded(docs.limit(0), path(), public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("values", [[1, 1, 1, 2, 2, 5], [1, 1 + 1e-9, 1 + 2e-9, 2, 2 + 1e-12, 4], np.linspace(1, 1.0001, 9), [0, 0, 0, 1, 1e5, 1e5 + 1e-4]])
def test_eigenvectors_refined(values):
    g = np.random.default_rng(6)
    d = len(values)
    q = np.linalg.qr(g.standard_normal((d, d)))[0].astype(np.longdouble)
    for _ in range(4):
        q = q @ (1.5 * np.eye(d, dtype=np.longdouble) - q.T @ q / 2)
    a = q @ np.diag(np.array(values, dtype=np.longdouble)) @ q.T
    a = (a + a.T) / 2
    found, axes = whitening.refined(a)
    size = max(values)
    assert np.abs(a @ axes - axes * found).max() < 1e-17 * size and np.abs(axes.T @ axes - np.eye(d)).max() < 1e-17
    assert np.abs(found - np.sort(np.array(values, dtype=np.longdouble))[::-1]).max() < 1e-17 * size
    for i, value in enumerate(sorted(values, reverse=True)):
        if min(abs(value - other) for other in [*values, value + 9] if other != value) > 1e-4 and list(values).count(value) == 1:
            assert abs(abs(float(axes[:, i] @ q[:, list(values).index(value)])) - 1) < 1e-15


def test_whitening_equals_plain_numbers(frame, vectors):
    got = whitening.whiten(frame.where("vec_id < 900 and size(embedding) = 8"), components=5).collect()
    every = np.vstack([vectors, vectors[3]]).astype(float)
    x = np.floor(1024 * every).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    v = np.cov((x - s / n).T, bias=True)
    e, axes = np.linalg.eigh(v)
    want = ((x - s / n) @ axes[:, ::-1][:, :5]) / np.sqrt(e[::-1][:5])
    assert len(got) == 5 * n
    for r in got:
        c = r.component - 1
        assert abs(abs(r.whitened) - abs(want[r.vec_id, c])) < 1e-9 and abs(r.explained - e[::-1][c] / np.trace(v)) < 1e-12
        assert r.n == n and int(r.deviation) == int(((n * x[r.vec_id] - s) ** 2).sum()) and r.identity_error < 1e-10
    signs = {(r.component, np.sign(r.whitened) * np.sign(want[r.vec_id, r.component - 1])) for r in got if abs(r.whitened) > 1e-6}
    assert len(signs) == 5


def test_whitening_edges(spark, frame):
    got = whitening.whiten(frame).collect()
    assert {r.n for r in got} == {302, 1} and {r.vec_id for r in got} == {*range(300), None, 905}
    lone = [r for r in got if r.vec_id == 905]  # another length: a table of its own
    assert len(lone) == 7 and all(r.whitened is None and r.deviation == 0 and r.identity_error == 0 for r in lone)
    assert whitening.whiten(frame.limit(0)).count() == 0
    big = spark.createDataFrame([(i, [1e14 * i, float(i % 2)]) for i in range(6)], "vec_id long, embedding array<double>")
    rows = whitening.whiten(big, scale=1, shift=0).where("component = 1").orderBy("vec_id").collect()
    assert int(rows[0].deviation) == (15 * 10**14) ** 2 + 9 and abs(abs(rows[5].whitened) - 1.4638501094228) < 1e-9


def plain_components(rows, words=2, percent=80):
    """Smallest id reachable, ids being the nodes, by comparing all rows."""
    sets = [(i, {tuple(t.split()[k : k + words]) for k in range(max(1, len(t.split()) - words + 1))}) for i, t in rows]
    root = {i: i for i, _ in rows}
    for a, x in sets:
        for b, y in sets:
            if 100 * len(x & y) >= percent * len(x | y) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    return root


def test_an_id_with_two_texts_keeps_the_links_of_both(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    a, b, c = (" ".join(word() for _ in range(40)) for _ in range(3))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (5, c), (4, c + " z"), (5, b + " y q"), (9, word())]
    for some in (rows, rows[:4], rows[::-1], [(7, a), (7, b), (8, b + " y"), (6, a + " x")]):
        got = minhash_dedup.near_duplicates(spark.createDataFrame(some, "doc_id long, text string"), words=2).collect()
        assert {x.doc_id: x.component_id for x in got} == plain_components(some) and len(got) == len(some)
        assert all(x.kept == (x.doc_id == x.component_id) for x in got)


def test_vectors_of_a_rare_length_are_compared(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (5, [0.5, 1.0]), (6, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.near_duplicates(df, 0.95).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4), 5: (0, 5), 6: (0, 6)}
    found = hash_index.search(df, F.lit(True), k=10).collect()
    assert {(r.query_id, r.vec_id) for r in found} == {(1, 2), (2, 1), (3, 4), (3, 5), (4, 3), (4, 5), (5, 3), (5, 4)}


def test_search_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(hash_index, "shard_rows", lambda n, d: 100)
    monkeypatch.setattr(hash_index, "QUERIES", 7)
    g = np.random.default_rng(9)
    x = (g.standard_normal((60, 1, 16)) * 4 + g.standard_normal((60, 20, 16))).reshape(-1, 16)  # clusters of twenty
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = hash_index.search(df, F.col("id") % 50 == 0, k=10).collect()
    hits = 0
    for q in range(0, 1200, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10].tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert len(got) == 240 and hits >= 216
