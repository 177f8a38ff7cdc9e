"""Operators on vectors and urls, shared plumbing, the registry and the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm import hash_index, registry, url_filter, vector_dedup
from marketloom.llm.common import components, ranked

VECTORS = "vec_id long, embedding array<float>, label int, n long"


@pytest.fixture(scope="module")
def vectors():
    g = np.random.default_rng(4)
    x = g.standard_normal((600, 16)).astype(np.float32)
    for i in range(100, 160):
        x[i] = x[100] + 0.05 * g.standard_normal(16)
    x[161] = x[160]
    x[162] = 3 * x[160]
    return x


@pytest.fixture(scope="module")
def frame(spark, vectors):
    rows = [(i, v.tolist(), 0, 1) for i, v in enumerate(vectors)]
    odd = [(1000, None, 0, 1), (1100, [0.0] * 16, 0, 1), (1200, [float("nan")] * 16, 0, 1), (1300, [1.0, None] * 8, 0, 1), (1400, [1.0], 0, 1), (1500, [], 0, 1), (None, [1.0] * 16, 0, 1)]
    return spark.createDataFrame([*rows, rows[5], *odd], VECTORS)


def test_search_recall_and_scores(frame, vectors):
    got = hash_index.search(frame, F.col("id") % 100 == 0, k=10).collect()
    x, hits = vectors.astype(float), 0
    assert len(got) == 60 and {r.query_id for r in got} == {0, 100, 200, 300, 400, 500}
    for q in range(0, 600, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        near = set(np.lexsort((np.arange(600), d))[:10].tolist())
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11)) and [r.score for r in own] == sorted(r.score for r in own)
        assert all(abs(r.score - d[r.vec_id]) < 1e-9 for r in own)
        hits += len(near & {r.vec_id for r in own})
    assert hits >= 54


def test_search_edges(spark, frame):
    assert hash_index.search(frame.limit(0), F.col("id") % 100 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0], 0, 1), (1, [0.0, 1.0], 0, 1), (2, [1.0, 1.0], 0, 1)], VECTORS)
    assert [(r["rank"], r.vec_id) for r in hash_index.search(few, F.col("id") == 0).orderBy("rank").collect()] == [(1, 2), (2, 1)]


def test_shard_finds_all_within_radius():
    g = np.random.default_rng(8)
    codes = g.integers(0, 256, (500, 8)).astype(np.uint8)
    shard = hash_index.Shard(codes)
    for radius in (0, 7, 20, 26, 40, 64):
        want = np.flatnonzero(np.unpackbits(codes ^ codes[3], axis=1).sum(axis=1) <= radius)
        assert shard.within(codes[3], radius).tolist() == want.tolist()


def test_vector_links_equal_brute_force(frame, vectors):
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(frame, 0.95).collect()}
    u = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1)[:, None]
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    parent = list(range(600))
    for i, j in zip(*np.nonzero(linked), strict=True):
        a, b = parent[i], parent[j]
        if a != b:
            parent = [min(a, b) if p in (a, b) else p for p in parent]
    for i in range(600):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (int(linked[i].sum()), parent[i], parent[i] == i)
    for i in (1000, 1100, 1200, 1300, 1400, 1500):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[None].kept and got[None].component_id is None


def test_vector_dedup_empty(frame):
    assert vector_dedup.near_duplicates(frame.limit(0)).count() == 0


PAGES = "page_id long, url string, html string, trust string"


def test_url_rules(spark):
    urls = {
        "http://WWW.Example.com/en/1?x": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "https://a.example.com/en/2#f": ("a.example.com", "/en/2", "example.com/en/", "block"),
        "https://other.com/de/": ("other.com", "/de/", "com/", "allow"),
        "https://x.net/es/1": ("x.net", "/es/1", "net/es/", "block"),
        "https://net/fr/": ("net", "/fr/", "net/fr/", "block"),
        "https://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "https://plain.com?q=1": ("plain.com", "", None, "allow"),
        "nothing": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "a://b.org/c://d.net/es/": ("b.org", "/c://d.net/es/", None, "allow"),
    }
    frame = spark.createDataFrame([(i, u, None, "t") for i, u in enumerate(urls)], PAGES)
    got = url_filter.judge(frame, registry.URL_RULES).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == list(urls.values())
    assert url_filter.judge(frame.limit(0), registry.URL_RULES).count() == 0


def test_distrust_flows_back_along_links(spark):
    bad = '<a href="http://bad.net/es/1">x</a>' * 3
    pages = [(1, "http://bad.net/es/1", ""), (2, "http://bad.net/es/2", ""), (3, "http://farm.org/x", bad), (4, "http://good.com/x", '<a href="http://liked.org/">y</a>'), (5, "http://liked.org/x", None), (6, "http://alone.org/", "")]
    frame = spark.createDataFrame([(*p, "t") for p in pages], PAGES)
    got = {r.page_id: r for r in url_filter.judge(frame, registry.URL_RULES).collect()}
    assert got[3].verdict == "block" and got[5].verdict == "allow" and got[6].verdict == "allow"
    assert got[5].trust > 0 and got[3].distrust > 0 and got[6].distrust == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 105), (105, 101), (200, 200)] + [(300, 300 + i) for i in range(1, 50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(31)} == {0} and {got[i] for i in (100, 101, 105)} == {100} and {got[300 + i] for i in range(50)} == {300} and 200 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ranked_numbers_every_group(spark):
    frame = spark.range(1000).selectExpr("id", "if(id % 3 = 0, null, id % 2) as g")
    out = ranked(frame, ["g"], [F.col("id")], "r", slices=7).collect()
    for g in (None, 0, 1):
        own = sorted(r.r for r in out if r.g == g)
        assert own == list(range(len(own)))


def test_registry_names():
    assert {q.split("_")[0] for q in registry.QUERIES} == {f"op{i}" for i in range(1, 14)}


def test_pipeline_runs_on_the_smallest_table(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert 0 < len({r.doc_id for r in out}) <= docs.count()
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 2048


def test_sequences_follow_the_mix(spark, tmp_path):
    """Written as the mix, read again and packed: a brute-force count of every prefix stays near the weights."""
    import corpus_pipeline
    from marketloom.llm import mixing
    from marketloom.llm.common import written

    data = [(i, "word " * 200, "en", "ab"[i % 4 > 1], 1000) for i in range(4000)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars int")
    mixed = written(mixing.in_order(mixing.mix(docs, {"a": 3, "b": 1})).select(*docs.columns))
    places = {r.doc_id: r._place for r in mixing.laid_out(mixed).collect()}
    order = [r.doc_id for r in mixing.mix(docs, {"a": 3, "b": 1}).orderBy("_position").collect()]
    assert [places[i] for i in order] == list(range(4000))
    got = sorted((r.sequence_id, r.offset, r.doc_id) for r in corpus_pipeline.pack_sequences(spark, mixed, "").collect())
    assert sorted(i for _, _, i in got) == list(range(4000))
    assert {s for s, _, _ in got} == set(range(max(got)[0] + 1))
    seen = 0
    for n, (_, _, i) in enumerate(got, 1):
        seen += i % 4 <= 1
        if n <= 2600:  # until source a is used up
            assert abs(seen - 0.75 * n) <= 16
    plain = written(docs.coalesce(1))
    other = {(r.doc_id, r.sequence_id) for r in corpus_pipeline.pack_sequences(spark, plain, "").collect()}
    assert other != {(i, s) for s, _, i in got}
