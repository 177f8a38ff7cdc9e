"""Parsers, sources, taxonomy, matching decisions and streaming twins on literal rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketloom.functions import prices, scalars as S
from marketloom.operators import listings, matching, quality, series, stats, taxonomy, users
from marketloom.sources import readers
from marketloom.streaming import twins


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("text", "want"),
    [("1.234,56", 1234.56), ("1,234.56", 1234.56), ("12,99", 12.99), ("1,234", 1234.0), ("12.5", 12.5), ("1.234", 1234.0), ("1.234.567", 1234567.0), ("abc", None), (None, None), ("7", 7.0)],
)
def test_decimals(spark, text, want):
    assert one(spark, S.parse_decimal, text) == want
    assert text is None or prices.decimal(text) == want


@pytest.mark.parametrize(
    ("text", "want", "reference"),
    [("12,99 lei", 1299, None), ("12 99 lei", 1299, None), ("Pret 9,50 RON 12,00 RON", 950, 1200), ("5 lei/kg 3,20 lei", 320, None), ("17,5", 1750, None), ("1 2 3", None, None), ("8,00 lei pret anterior 10,00 lei", 800, 1000), ("valabil 01.02.2024 4,99 lei", 499, None), (None, None, None), ("", None, None)],
)
def test_prices(spark, text, want, reference):
    row = one(spark, prices.parse_price, text)
    assert (row.bani, row.reference_bani) == (want, reference)


@pytest.mark.parametrize(
    ("name", "value", "unit", "count"),
    [("Lapte 1,5 l", 1500.0, "ML", 1), ("Bere 6 x 0,33 l", 1980.0, "ML", 6), ("Cafea 250g x 2", 500.0, "G", 2), ("Iaurt 2% 400 g", 400.0, "G", 1), ("Servetele", None, None, 1), ("(5+1)x 330 ml Cola", 1980.0, "ML", 6)],
)
def test_quantities(spark, name, value, unit, count):
    row = one(spark, prices.parse_quantity, name)
    assert (row.value, row.unit, row.pack_count) == (value, unit, count)


def test_ean_and_url_and_text(spark):
    assert one(spark, S.ean_ok, "5941234567899") == (sum(int(d) * (3 if i % 2 else 1) for i, d in enumerate(reversed("5941234567899"))) % 10 == 0)
    assert one(spark, S.ean_ok, "4006381333931") and not one(spark, S.ean_ok, "4006381333932") and not one(spark, S.ean_ok, None)
    assert one(spark, S.normalize_url, "https://www.a.ro/x/?utm_source=b&id=2&gclid=1#t") == "https://a.ro/x/?id=2"
    assert one(spark, S.normalize_url, "ftp://a") is None
    assert one(spark, S.normalize, "Țuică  DE Prună 64 GB!") == "tuica de pruna 64gb" and one(spark, S.normalize, None) == ""
    assert one(spark, S.slug, "Brânză & Cașcaval") == "branza-cascaval" and one(spark, S.name_bag, "b a B") == "a b"
    assert prices.osa("abcd", "abdc") == 1 and prices.osa("", "ab") == 2


def test_receipt(spark):
    text = "MAGAZIN SRL\nLapte 1l   2 x 5,00  10,00 A\nPaine 3,50 B\nTOTAL LEI 13,50\nCARD 13,50\n"
    row = spark.createDataFrame([(text,)], "t string").select(prices.receipt_lines(F.col("t")).alias("l"), prices.receipt_total(F.col("t")).alias("s"))
    row = row.withColumn("ok", prices.receipt_balances(F.col("l"), F.col("s"))).first()
    assert [(x.name, x.qty, x.bani) for x in row.l] == [("Lapte 1l", 2.0, 1000), ("Paine", 1.0, 350)] and row.s == 1350 and row.ok


def test_sources(spark, tmp_path):
    raw = spark.createDataFrame([(1, '{"d":{"items":[{"n":"a","p":{"v":3}},{"n":"b"}]}}'), (2, '{"d":{"items":{"k":{"n":"c"}}}}'), (3, "oops")], "id long, payload string")
    got = readers.json_products(raw, "d.items", {"name": "n", "price": "p.v"}).orderBy("name").collect()
    assert [(r.id, r.name, r.price) for r in got] == [(1, "a", "3"), (1, "b", None), (2, "c", None)]
    html = '<div class="card"><b class="t">One</b><br><span class="p">9,99</span></div><p class="t">no</p><div class="card x"><i class="t">Two</i></div>'
    cards = readers.html_cards(spark.createDataFrame([(1, html), (2, None)], "id long, html string"), "card", {"name": "t", "price": "p"}).collect()
    assert [(r.id, r.name, r.price) for r in cards] == [(1, "One", "9,99"), (1, "Two", None)]
    old = spark.createDataFrame([(1, 10), (2, 20)], "k long, v long")
    new = spark.createDataFrame([(2, 25), (3, 30)], "k long, v long")
    assert sorted(map(tuple, readers.upsert(old, new, ["k"]).collect())) == [(1, 10), (2, 25), (3, 30)]
    assert sorted(map(tuple, readers.append_on_change(old, new.union(old.where("k = 1")), ["k"], "v").collect())) == [(2, 25), (3, 30)]
    assert readers.write_csv(spark.createDataFrame([('a "q"\nb',), ("c,d",)], "t string"), str(tmp_path / "c")) == 2
    assert readers.snapshot(old, str(tmp_path / "s"), "v")
    assert [r.url for r in readers.page_urls(spark, "u?p={page}&f={from}&t={to}", 2, 10).orderBy("page").collect()] == ["u?p=1&f=0&t=9", "u?p=2&f=10&t=19"]
    assert {r.field: r.filled_bp for r in readers.field_coverage(got and spark.createDataFrame([("a", None), ("", "x")], "f string, g string"), ["f", "g"]).collect()} == {"f": 5000, "g": 5000}


def test_decide_rules(spark):
    columns = "section string, c_name string, c_brand string, c_unit string, c_size double, c_ean string, s_name string, s_brand string, s_unit string, s_size double, s_ean string"
    ean = "4006381333931"
    rows = [
        ("grocery", "Lapte Zuzu", "Zuzu", "l", 1.0, ean, "anything", "x", "kg", 2.0, ean),
        ("grocery", "Lapte Zuzu", "Zuzu", "l", 1.0, None, "Lapte Zuzu", "Zuzu", "kg", 1.0, None),
        ("grocery", "Lapte Zuzu", "Zuzu", "l", 1.0, None, "Lapte Zuzu", "Zuzu", "l", 1.2, None),
        ("grocery", "Lapte Zuzu", "Zuzu", "l", 1.0, None, "Iaurt Zuzu", "Zuzu", "l", 1.0, None),
        ("grocery", "Lapte Zuzu", "Zuzu", "l", 1.0, None, "Lapte Napolact", "Napolact", "l", 1.0, None),
        ("grocery", "Lapte Zuzu", "Zuzu", "l", 1.0, None, "Lapte Zuzu", "Zuzu", "l", 1.0, None),
    ]
    got = matching.decide(spark.createDataFrame(rows, columns)).collect()
    assert [(r.band, r.reason) for r in got] == [("AUTO", "ean"), ("REJECT", "size-unit"), ("REJECT", "size"), ("REJECT", "head-noun"), ("REJECT", "brand"), ("AUTO", "brand+size")]


def test_shrinkflation(spark):
    day = lambda i: dt.datetime(2024, 1, 1 + i)
    rows = [(1, day(i), s, p) for i, (s, p) in enumerate([(500, 1000), (500, 1000), (450, 1000), (450, 1000)])]
    rows += [(2, day(i), 500, 1000) for i in range(4)] + [(3, day(0), 500, 1000), (3, day(1), 500, 1000), (3, day(2), 400, 1000)]
    got = series.shrinkflation(spark.createDataFrame(rows, "product_id long, recorded_at timestamp_ntz, size int, price_bani long")).collect()
    assert [(r.product_id, r.shrink_bp) for r in got] == [(1, 1000)]


def test_taxonomy(spark):
    products = spark.createDataFrame([(1, "Lapte de vaca 1l"), (2, "Ciocolata cu lapte"), (3, "Ceva")], "id long, name string")
    rules = spark.createDataFrame([("milk", "dairy", "lapte", "lapte de vaca", "ciocolata"), ("sweets", "snacks", "ciocolata", None, None)], "category string, department string, word string, phrase string, avoid string")
    got = {r.id: (r.category, r.score, r.band) for r in taxonomy.assign_by_name(products, rules).collect()}
    assert got == {1: ("milk", 100, "AUTO"), 2: ("sweets", 95, "AUTO")}
    brands = spark.createDataFrame([("Lapte",), ("Lapte de",)], "brand string")
    assert {r.id: r.brand for r in taxonomy.infer_brand(products, brands).collect()} == {1: "Lapte de"}
    classes = spark.createDataFrame([(7, ["lapte"], ["ciocolata"])], "class_id int, require array<string>, exclude array<string>")
    assert [(r.class_id, r.id) for r in taxonomy.class_members(products, classes).collect()] == [(7, 1)]


def test_tiers(spark):
    frame = spark.createDataFrame([([(3, 95), (6, 90)], 100), ([(3, 95), (6, 96)], 100), ([(1, 95)], 100)], "t array<struct<qty:int,bani:long>>, b long")
    assert [r[0] for r in frame.select(S.valid_tiers(F.col("t"), F.col("b"))).collect()] == [True, False, False]
    assert [r[0] for r in frame.limit(1).select(S.tiered_total(F.col("t"), F.col("b"), F.lit(7))).collect()] == [630]


def test_streams_equal_their_batch_twins(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, 1, t + dt.timedelta(hours=9 * i), i, 1, 100 + (i // 3) * 5) for i in range(12)]
    frame = spark.createDataFrame(rows, "product_id long, merchant_id long, recorded_at timestamp, ord long, line long, price_bani long")
    frame.write.parquet(str(tmp_path / "in"))
    for name, make, batch, mode in (
        ("low", twins.daily_low_stream, listings.daily_low(frame), "complete"),
        ("change", twins.changes_stream, series.appended_on_change(frame).select("product_id", "merchant_id", "recorded_at", "price_bani"), "append"),
    ):
        stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
        query = make(stream).writeStream.format("memory").queryName(f"t_{name}").outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert sorted(map(tuple, spark.table(f"t_{name}").collect())) == sorted(map(tuple, batch.collect()))


def test_small_rules(spark):
    pending = spark.createDataFrame([(1, 7000, 1, 100), (2, 9000, 3, 0)], "id long, score_bp long, merchants int, spread_bani long")
    assert [r.id for r in users.pending_rank(pending, 1).collect()] == [1]
    columns = "decision string, reason string, score_bp long, section string, merchant_id long, rank long"
    rows = [("confirm" if i < 20 else "reject", "brand", 4500, "s", 1, i) for i in range(40)] + [("confirm", "size", 6000, "s", 2, None), ("reject", "pack", 5000, "s", 1, 300)] + [(None, "pack", 5000, "s", 1, 3)]
    rows += [("reject", "dose", 5500, "s", 1, 80)] * 30
    got = {(r.by, r.key): r for r in stats.match_stats(spark.createDataFrame(rows, columns)).collect()}
    assert {k: got["rule", k].verdict for k in ("brand", "size", "pack", "dose")} == {"brand": "too aggressive", "size": "not enough signal", "pack": "not enough signal", "dose": "working"}
    assert (got["all", "all"].confirmed, got["all", "all"].total) == (21, 72) and got["rank", "251+"].total == 1 and got["score", "0.58+"].total == 1 and got["rank", "bulk"].confirmed == 1
    parsed = spark.createDataFrame([("x", None)] * 3 + [("y", 1)] * 20, "raw string, v int")
    assert quality.parse_tally(parsed, "raw", "v").first().alarm


def test_decide_rejects_other_variants_codes_and_packs(spark):
    rows = [
        (1, "Cafea boabe", "Cafea boabe", 1.0, 1, 1), (2, "Cafea boabe", "Cafea macinata boabe", 1.0, 1, 1),
        (3, "Vopsea par 110", "Vopsea par 210", 0.05, 1, 1), (4, "Apa plata", "Apa plata", 0.5, 1, 6), (5, "Vin alb", "Vin", 0.7, 1, 1),
    ]
    pairs = spark.createDataFrame(rows, "id int, c_name string, s_name string, c_size double, c_pack int, s_pack int")
    pairs = pairs.selectExpr("*", "'alcohol' as section", "'' as c_brand", "'' as s_brand", "'l' as c_unit", "'l' as s_unit", "c_size as s_size", "'' as c_ean", "'' as s_ean")
    got = {r.id: r.reason for r in matching.decide(pairs).collect()}
    assert got == {1: "name+size", 2: "variant-mismatch", 3: "variant-code-mismatch", 4: "pack-shape", 5: "variant-mismatch"}


def test_resolve_equals_brute_force_decisions(spark):
    ean = "4006381333931"
    catalog = [
        (1, "Lapte Zuzu", "Zuzu", "grocery", "l", 1.0, None),
        (2, "Zuzu Lapte", "Zuzu", "grocery", "l", 1.0, None),
        (3, "BUCEGI Carne Porc", "Bucegi", "grocery", "kg", 0.3, None),
        (4, "Cablu negru", "", "tools", "buc", 2.0, ean),
        (5, "Eco turmeric", "", "grocery", "kg", 0.94, None),
        (6, "Eco turmeric", None, "grocery", "kg", 1.0, "123"),
        (7, "Milka", "Milka", "grocery", "kg", None, None),
        (8, "12 x", "", "grocery", "kg", 1.0, None),
    ]
    pool = [
        (11, "Zuzu proaspat Lapte", "", "grocery", "l", 1.06, None),
        (12, "Carne Porc Bucegi", "Bucegi", "grocery", "kg", 0.3, None),
        (13, "alt nume", "x", "tools", "kg", None, ean),
        (14, "Turmeric macinat eco", "", "grocery", "kg", 0.94, "123"),
        (15, "turmeric eco", "", "grocery", "kg", 1.0, None),
        (16, "Milka", "Milka", "grocery", "kg", 1.0, None),
        (17, "Zuzu Lapte", "Zuzu", "grocery", "l", 1.0, None),
        (18, "turmeric eco", "", "grocery", "kg", 0.94, None),
    ]
    schema = "name string, brand string, section string, unit string, unit_size double, ean string"
    c, p = spark.createDataFrame(catalog, "id long, " + schema), spark.createDataFrame(pool, "item_id long, " + schema)
    left = c.select("id", "section", *(F.col(x).alias("c_" + x) for x in ("name", "brand", "unit", "ean")), F.col("unit_size").alias("c_size"))
    right = p.select("item_id", *(F.col(x).alias("s_" + x) for x in ("name", "brand", "unit", "ean")), F.col("unit_size").alias("s_size"))
    want = {(r.item_id, r.id): (r.band, r.reason, r.score_bp) for r in matching.decide(left.crossJoin(right)).collect() if r.band != "REJECT"}
    del want[16, 8]  # a product whose name has no head word is found by EAN only
    for item in {i for i, _ in want}:
        autos = [k for k, v in want.items() if k[0] == item and v[0] == "AUTO"]
        for k in autos:
            if len(autos) > 1 and want[k][1] != "ean":
                want[k] = ("REVIEW", "fan-out", want[k][2])
    out = matching.resolve(c, p).collect()
    assert {(r.item_id, r.id): (r.band, r.reason, r.score_bp) for r in out} == want and len(out) == len(want)
    assert want[13, 4] == ("AUTO", "ean", 10000) and want[12, 3][0] == "AUTO" and {(11, 1), (15, 6), (18, 5), (18, 6)} <= set(want)
