"""Paged sources, repeatable upserts, exports, counters, and streams whose state ends."""

import json

import pytest
from pyspark.sql import functions as F

from marketloom.sources import buckets, exports, paged, tally
from marketloom.streaming import expiring, twins


def page(route, n):
    """Pages of ten products that overlap by two; route 1 has three pages and then repeats its last, route 2 ends."""
    if route == "b" and n > 2:
        return None
    first = 8 * (min(n, 3) - 1)
    return json.dumps({"data": {"items": [{"title": f"{route} {i}", "link": f"/{route}/{i}", "price": i} for i in range(first, first + 10)] + [{"title": " ", "link": "x"}]}})


@pytest.fixture
def landed(tmp_path):
    """Pages in a folder; ``put`` lands some more."""

    def put(route, upto):
        for n in range(1, upto + 1):
            text = page(route, n)
            if text is not None:
                (tmp_path / f"{route}-{n}.json").write_text(text)

    folder = str(tmp_path)

    def fetch(url):
        try:
            with open(f"{folder}/{url}") as f:
                return f.read()
        except FileNotFoundError:
            return None

    fields = {"name": "title", "url": "link", "price": "price"}
    shop = paged.Shop([paged.Route("a-{page}.json", "first"), paged.Route("b-{page}.json", "second"), paged.Route("c.json")], fields, fetch, items="data.items", max_pages=9, page_size=10)
    return put, shop, tmp_path


def test_batch_and_stream_of_pages_agree(spark, landed):
    put, shop, tmp = landed
    put("a", 2)
    put("b", 1)
    spark.dataSource.register(paged.paged_source("pages_of_test", shop))
    place, out = str(tmp / "checkpoint"), str(tmp / "out")

    def drain():
        rows = spark.readStream.format("pages_of_test").load()
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.page, r.url) for r in spark.read.parquet(out).collect())

    def batch():
        return sorted((r.page, r.url) for r in spark.read.format("pages_of_test").load().collect())

    assert spark.read.format("pages_of_test").load().rdd.getNumPartitions() == 3
    assert drain() == batch() and len(batch()) == 28
    put("a", 6)  # the fourth page adds nothing, so the fifth is not read
    put("b", 4)
    assert drain() == batch() == drain() and len(batch()) == 44 and max(p for p, _ in batch()) == 3
    assert paged.products(spark.read.format("pages_of_test").load()).count() == 44


def test_pages_that_are_no_products(spark, landed):
    put, shop, tmp = landed
    spark.dataSource.register(paged.paged_source("no_pages", shop))
    assert spark.read.format("no_pages").load().count() == 0
    (tmp / "c.json").write_text("{broken")
    assert spark.read.format("no_pages").load().count() == 0
    assert paged.Route("x?from={from}&to={to}").page(3, 20) == "x?from=40&to=59" and paged.Route("x").page(2, 20) is None


def test_a_batch_applies_once(spark, tmp_path, monkeypatch):
    table = buckets.BucketTable(str(tmp_path / "t"), "k long, v string, at int", ["k"], buckets=4, order="at")
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string, at int")
    assert table.read(spark).collect() == []
    first = frame([(1, "a", 1), (2, "b", 1), (1, "c", 2), (None, "n", 1)])
    assert table.upsert(first, 0)
    before = {tuple(r) for r in table.read(spark).collect()}
    assert before == {(1, "c", 2), (2, "b", 1), (None, "n", 1)}
    assert not table.upsert(first, 0) and {tuple(r) for r in table.read(spark).collect()} == before
    second = frame([(2, "B", 3), (3, "d", 3)])
    with monkeypatch.context() as m:
        m.setattr(buckets.BucketTable, "_wrote", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            table.upsert(second, 1)  # written, but not in the ledger
    assert {tuple(r) for r in table.read(spark).collect()} == before
    assert table.upsert(second, 1) and not table.upsert(second, 1)
    after = {tuple(r) for r in table.read(spark).collect()}
    assert after == {(1, "c", 2), (2, "B", 3), (3, "d", 3), (None, "n", 1)}
    assert table.upsert(frame([]), 2) and table.applied(spark, 2)
    touched = {v for v in table.versions(spark).values()}
    assert touched <= {0, 1} and table.clear_old(spark) >= 1 and {tuple(r) for r in table.read(spark).collect()} == after


def test_upserts_of_a_stream(spark, tmp_path):
    table = buckets.BucketTable(str(tmp_path / "t"), "k long, v long", ["k"], buckets=4)
    for i in range(3):
        spark.range(i * 5, i * 5 + 10).select(F.col("id").alias("k"), F.lit(i).cast("long").alias("v")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("k long, v long").parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(table.sink()).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert {r.k: r.v for r in table.read(spark).collect()} == {k: min(k // 5, 2) for k in range(20)}


def history(spark, n=500):
    rows = spark.range(n).select((F.col("id") * 7 % n).alias("k"), (F.col("id") % 90 + 0.25).alias("price"), F.concat(F.lit('a "q", b\n'), F.col("id").cast("string")).alias("note"))
    return rows.union(spark.createDataFrame([(None, 1.5, None), (None, 2.5, ""), (3, None, "x,y")], "k long, price double, note string"))


def test_a_broken_export_goes_on(spark, tmp_path):
    df, path, calls = history(spark), str(tmp_path / "e"), []

    def failing(n):
        calls.append(n)
        if n == 2 and calls.count(2) == 1:
            raise RuntimeError("broken")

    with pytest.raises(RuntimeError):
        exports.export(df, "k", "price", path, ranges=5, failing=failing)
    assert sorted(r.range for r in exports.read_manifest(spark, path).collect()) == [-1, 0, 1]
    whole = exports.export(df, "k", "price", path, ranges=5, failing=failing)
    assert calls == [-1, 0, 1, 2, 2, 3, 4]
    assert {tuple(r) for r in exports.read_manifest(spark, path).collect()} == {tuple(r) for r in whole.collect()}
    assert sum(r.rows for r in whole.collect()) == 503
    exports.export(df, "k", "price", path, ranges=5, failing=failing)
    assert len(calls) == 7  # nothing was open
    changed = df.withColumn("price", F.when(F.col("k") == 499, 1000.0).otherwise(F.col("price")))
    exports.export(changed, "k", "price", path, ranges=5, failing=failing)
    assert calls[7:] == [4]  # only the range that changed
    back = [exports.read_range(spark, path, n, "k:bigint,price:double,note:string") for n in (-1, 0, 1, 2, 3, 4)]
    assert sorted(str(tuple(r)) for b in back for r in b.collect()) == sorted(str(tuple(r)) for r in changed.collect())


def test_exports_of_little(spark, tmp_path):
    df = history(spark)
    assert exports.export(df.limit(0), "k", "price", str(tmp_path / "none")).count() == 0
    assert [r.rows for r in exports.export(df.where("k is null"), "k", "price", str(tmp_path / "nulls")).collect()] == [2]
    assert [(r.low, r.high, r.rows) for r in exports.export(df.where("k = 3"), "k", "price", str(tmp_path / "one")).collect()] == [(3, 3, 2)]


def test_copy_between_stores(spark):
    source, target = "jdbc:derby:memory:from_;create=true", "jdbc:derby:memory:to_;create=true"
    options = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    df = spark.range(1, 401).select(F.col("id").alias("k"), (F.col("id") % 7 + 0.5).alias("price"), F.concat(F.lit("n"), "id").alias("name"))
    df.write.format("jdbc").option("url", source).option("dbtable", "offers").options(**options).mode("overwrite").save()
    read = exports.read_store(spark, source, "offers", "k", 4, **options)
    assert read.rdd.getNumPartitions() == 4
    got = exports.copy_store(spark, source, target, "offers", "k", "price", 4, **options)
    assert got["rows"] == 400 and float(got["money"]) == sum(i % 7 + 0.5 for i in range(1, 401))
    again = exports.copy_store(spark, source, target, "offers", "k", "price", 4, **options)
    assert again == got and exports.read_store(spark, target, "offers", "k", 4, **options).count() == 400


def counted(spark, rows):
    df = spark.createDataFrame(rows, "raw string, bani long, gone boolean")
    counting = tally.Counting(df, "shop", F.col("raw"), F.col("bani"), F.col("gone"))
    counting.frame.write.format("noop").mode("overwrite").save()
    return counting.tally()


def test_counters_come_with_the_write(spark):
    fine = counted(spark, [(f"{i} lei", i, False) for i in range(95)] + [("  la   cerere ", None, False), (None, None, False), ("y" * 300, None, None), ("gone", None, True)])
    assert (fine.attempted, fine.parsed, fine.nulls, fine.unavailable) == (98, 95, 3, 1)
    assert 2 <= len(fine.samples) <= 3 and set(fine.samples) <= {"(empty)", "la cerere", "y" * 120 + "…"} and fine.checked() is fine
    bad = counted(spark, [(f"bad {i}", None, False) for i in range(500)])
    assert bad.too_many_nulls and 0 < len(bad.samples) <= 20
    with pytest.raises(tally.Untrusted, match="500 of 500"):
        bad.checked()
    assert counted(spark, [("a", None, False)] * 19).checked().nulls == 19  # too few to judge
    with pytest.raises(tally.Untrusted, match="unavailable"):
        counted(spark, [("a", 1, False)] * 7 + [("b", None, True)] * 13).checked()
    empty = counted(spark, [])
    assert (empty.attempted, empty.null_rate, empty.unavailable_rate) == (0, 0.0, 0.0) and empty.checked() is empty


@pytest.fixture
def rocks(spark):
    for k, v in expiring.STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k in expiring.STATE_STORE:
        spark.conf.unset(k)


class Feed:
    """Files of rows that land one after the other, drained by a stream with one checkpoint."""

    def __init__(self, spark, tmp, schema, build):
        self.spark, self.tmp, self.schema, self.build, self.rows = spark, tmp, schema, build, []

    def __call__(self, rows):
        self.rows += rows
        self.spark.createDataFrame(rows, self.schema).selectExpr(*self.casts()).coalesce(1).write.mode("append").parquet(str(self.tmp / "in"))
        stream = self.build(self.spark.readStream.schema(self.typed().schema).parquet(str(self.tmp / "in")))
        stream.writeStream.format("parquet").option("path", str(self.tmp / "out")).option("checkpointLocation", str(self.tmp / "c")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return sorted(str(tuple(r)) for r in self.spark.read.schema(stream.schema).parquet(str(self.tmp / "out")).collect())

    def casts(self):
        return [f"cast({c} as timestamp) as {c}" if c in ("ts", "recorded_at") else c for c in (f.split()[0] for f in self.schema.split(", "))]

    def typed(self):
        return self.spark.createDataFrame(self.rows, self.schema).selectExpr(*self.casts())

    def batch(self, twin):
        return sorted(str(tuple(r)) for r in twin(self.typed()).collect())

    def state(self, name):
        return self.spark.read.format("statestore").option("stateVarName", name).load(str(self.tmp / "c")).count()


def test_cool_down_forgets(spark, rocks, tmp_path):
    feed = Feed(spark, tmp_path, "user_id long, product_id long, ts string", expiring.cooled_down)
    feed([(1, 1, "2024-01-01 00:00:00"), (1, 1, "2024-01-01 10:00:00"), (1, 1, "2024-01-01 21:00:00"), (2, 1, "2024-01-01 05:00:00"), (3, 9, "2024-01-01 06:00:00")])
    assert feed.state("last") == 3
    out = feed([(1, 1, "2024-01-02 16:00:00"), (2, 1, "2024-01-02 16:30:00")])
    assert out == feed.batch(lambda d: twins.cooled_down_batch(d)) and len(out) == 5
    out = feed([(4, 4, "2024-01-09 00:00:00")])
    assert out == feed.batch(lambda d: twins.cooled_down_batch(d))
    feed([(4, 4, "2024-01-09 01:00:00")])
    assert feed.state("last") == 1  # all watches but the last have cooled down and gone


def test_last_prices_forget(spark, rocks, tmp_path):
    feed = Feed(spark, tmp_path, "product_id long, merchant_id long, recorded_at string, ord long, line int, price_bani long", expiring.price_changes)
    at = lambda d: f"2024-01-{d:02d} 00:00:00"
    feed([(1, 1, at(1), 1, 1, 100), (1, 1, at(2), 1, 1, 100), (1, 1, at(3), 1, 1, 90), (2, 1, at(1), 1, 1, 5), (2, 1, at(1), 1, 2, 6)])
    assert feed.state("last") == 2
    out = feed([(1, 1, at(16), 1, 1, 90), (2, 1, at(20), 1, 1, 6)])
    assert out == feed.batch(expiring.price_changes_batch) and len(out) == 5
    feed([(3, 1, "2024-03-01 00:00:00", 1, 1, 1)])
    feed([(3, 1, "2024-03-01 10:00:00", 1, 1, 1)])
    assert feed.state("last") == 1


def test_ticks_forget(spark, rocks, tmp_path):
    feed = Feed(spark, tmp_path, "user_id long, product_id long, ts string", expiring.ticked_items)
    feed([(1, 1, "2024-01-01 00:00:00"), (1, 2, "2024-01-01 01:00:00"), (1, 1, "2024-01-01 02:00:00"), (1, 1, "2024-01-01 03:00:00"), (2, 1, "2024-01-01 03:00:00")])
    assert feed.state("ticked") == 3
    out = feed([(1, 2, "2024-01-01 14:00:00"), (1, 1, "2024-01-01 14:30:00")])
    assert out == feed.batch(expiring.ticked_items_batch) and len(out) == 7
    feed([(9, 9, "2024-01-03 00:00:00")])
    feed([(9, 8, "2024-01-03 00:30:00")])
    assert feed.state("ticked") == 2


def test_last_prices_of_a_bucket_are_kept_apart(spark, rocks, tmp_path):
    feed = Feed(spark, tmp_path, "product_id long, merchant_id long, recorded_at string, ord long, line int, price_bani long", lambda d: expiring.price_changes(d, buckets=1))
    at = lambda d: f"2024-01-{d:02d} 00:00:00"
    feed([(p, m, at(1 + p % 3), 1, 1, p + m) for p in range(9) for m in range(9)])
    assert feed.state("last") == 81
    out = feed([(p, m, at(5 + m), 1, k, p + m + (p % 2) * k) for p in range(9) for m in range(9) for k in range(2)])
    assert out == feed.batch(expiring.price_changes_batch) and len(out) == 81 + 36 and feed.state("last") == 81
