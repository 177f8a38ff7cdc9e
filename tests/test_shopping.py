"""Search, decisions, substitution, rules on listings, sources and streams: literal cases."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from marketloom.functions import listing_rules as R
from marketloom.functions import prices
from marketloom.operators import gates, ingest, matching, predicates, search, substitution
from marketloom.sources import readers
from marketloom.streaming import twins



def moment():
    return F.lit("2026-01-10 00:00:00").cast("timestamp_ntz")



@pytest.fixture(scope="module")
def shop(spark):
    rows = [(i, f"Lapte {b} {i % 3 + 1} l", b, "dairy", i % 4) for i, b in enumerate(["Zuzu", "Napolact", "Olympus"] * 10)]
    rows += [(100, "Pate de porc", "Sadu", "meat", 1), (101, "Ciocolata cu lapte", "Milka", "sweets", 3), (102, "Ulei floarea soarelui", None, "oil", 2), (103, "Faina alba", "Baneasa", "flour", 2)]
    return spark.createDataFrame(rows, "id long, name string, brand string, category string, merchants long")


def test_search_corrects_swaps_and_reports_what_is_missing(spark, shop):
    asked = spark.createDataFrame([("swap", "lpate"), ("brand", "ulei baneasa"), ("none", "illy capsule"), ("two", "lapte zuzu"), ("choc", "ciocolata")], "qid string, query string")
    said = {r.qid: r for r in search.outcomes(shop, asked, ["illy"]).collect()}
    found = {}
    for r in search.search(shop, asked, 50, ["illy"]).orderBy("qid", "place").collect():
        found.setdefault(r.qid, []).append(r.id)
    assert said["swap"].kind == "results" and said["swap"].corrections == 1 and len(found["swap"]) == 31
    assert found["swap"][-1] == 101  # what a product is comes before what it holds
    assert said["brand"].kind == "brand-miss" and said["brand"].missing == "ulei" and found["brand"] == [103]
    assert (said["none"].kind, said["none"].missing, said["none"].results) == ("brand-miss", "illy capsule", 0)
    assert set(found["two"]) == set(range(0, 30, 3)) and found["choc"] == [101]


def test_similar_counts_a_swap_as_one_edit(spark):
    a = spark.createDataFrame([("imlk",), ("rde",), ("ab",)], "w string")
    b = spark.createDataFrame([("milk",), ("red",), ("ac",)], "v string")
    assert {(r.w, r.v, r.sim) for r in search.similar(a, search._keyed(b, "v"), "w", "v").collect()} == {("imlk", "milk", 0.75), ("rde", "red", 1 - 1 / 3)}


def test_structural_candidates_follow_the_tolerance(spark):
    rows = [(1, "Bolt a", "x", "l", 1.0), (2, "Bolt b", "x", "l", 1.2), (3, "Bolt c", "x", "l", 1.5)]
    frame = spark.createDataFrame(rows, "id long, name string, section string, unit string, unit_size double")
    assert {(r.id, r.other_id) for r in matching.structural_candidates(frame, 0.25).collect()} == {(1, 2), (2, 1), (2, 3), (3, 2)}
    assert matching.structural_candidates(frame, 0.06).count() == 0


@pytest.mark.parametrize(
    ("a", "b", "reason"),
    [
        ("Suc portocale Zuzu 1l", "Suc de portocala Zuzu 1l", "brand+size"),
        ("Suc mere Zuzu 1l", "Suc de mure Zuzu 1l", "variant-flavour"),
        ("Suc Zuzu 1l doza", "Suc Zuzu 1l sticla", "variant-format"),
        ("Lapte Zuzu 1,5% 1l", "Lapte Zuzu 1.5% 1 l", "brand+size"),
        ("Lapte Zuzu 1,5% 1l", "Lapte Zuzu 3.5% 1 l", "variant-fat"),
        ("Suc Zuzu fara zahar", "Suc Zuzu fara alcool", "variant-qualifier"),
        ("Lapte Zuzu uht 1l", "Lapte Zuzu proaspat 1l", "descriptor-conflict"),
        ("Drajeuri Zuzu paprica comprimate", "Drajeuri Zuzu paprika compr.", "brand+size"),
    ],
)
def test_decisions_tell_variants_apart(spark, a, b, reason):
    row = [(1, "grocery", a, "Zuzu", "l", 1.0, None, b, "Zuzu", "l", 1.0, None)]
    columns = "id long, section string, c_name string, c_brand string, c_unit string, c_size double, c_ean string, s_name string, s_brand string, s_unit string, s_size double, s_ean string"
    assert matching.decide(spark.createDataFrame(row, columns)).first().reason == reason


def offer(product, merchant, price, size=1.0, **more):
    base = {"product_id": product, "merchant_id": merchant, "price_bani": price, "unit": "l", "unit_size": size, "availability": "in stock", "is_stale": False, "flagged": False}
    base |= {"promo_valid_to": None, "brand": "B", "class_id": 1, "name": f"p{product}", "needs_card": False, "tiers": None}
    return base | more


OFFERS = (
    "product_id long, merchant_id long, price_bani long, unit string, unit_size double, availability string, is_stale boolean, flagged boolean, promo_valid_to timestamp_ntz, "
    "brand string, class_id long, name string, needs_card boolean, tiers array<struct<qty:int,bani:bigint>>"
)


def resolved(spark, offers, lines, shopper=substitution.Shopper()):
    goods = spark.createDataFrame(offers, OFFERS)
    products = spark.createDataFrame([(1, "B", 1, "l", 1.0), (2, "B", 1, "l", 0.5), (3, "C", None, "l", 1.0)], "id long, brand string, class_id long, unit string, unit_size double")
    asked = spark.createDataFrame(lines, "basket_id long, product_id long, qty long, mode string")
    shops = spark.createDataFrame([(1, 7)], "basket_id long, merchant_id long")
    return {(r.product_id, r["mode"]): r for r in substitution.resolve_lines(asked, shops, products, goods, shopper, moment()).collect()}


def test_lines_are_resolved_by_mode(spark):
    offers = [offer(1, 7, 500), offer(2, 7, 200, 0.5), offer(3, 7, 900, brand="C", class_id=None)]
    got = resolved(spark, offers, [(1, 1, 1, "EXACT"), (1, 2, 4, "EXACT"), (1, 1, 1, "CHEAPEST"), (1, 3, 1, "EQUIVALENT")])
    assert got[1, "EXACT"].code == "EXACT_MATCH" and got[1, "EXACT"].total_bani == 500
    assert (got[2, "EXACT"].code, got[2, "EXACT"].packs, got[2, "EXACT"].total_bani) == ("SPLIT_PACKS", 4, 800)
    cheap = got[1, "CHEAPEST"]
    assert (cheap.code, cheap.chosen_id, cheap.packs, cheap.total_bani, cheap.saving_per_unit) == ("SUBSTITUTED_CHEAPEST", 2, 2, 400, 100)
    assert got[3, "EQUIVALENT"].code == "EXACT_MATCH" and cheap.alternatives == 1


def test_lines_tell_why_nothing_can_be_bought(spark):
    offers = [offer(1, 7, 500, flagged=True), offer(2, 7, 200, 0.5, needs_card=True), offer(3, 9, 100)]
    got = resolved(spark, offers, [(1, 1, 1, "CHEAPEST"), (1, 1, 1, "EXACT"), (1, 3, 1, "EQUIVALENT")])
    assert (got[1, "CHEAPEST"].code, got[1, "CHEAPEST"].anomaly, got[1, "CHEAPEST"].loyalty) == ("ALL_CANDIDATES_EXCLUDED", 1, 1)
    assert got[1, "EXACT"].code == "EXACT_ONLY_NOT_STOCKED" and got[3, "EQUIVALENT"].code == "NOT_STOCKED"
    tiers = [offer(1, 7, 500, tiers=[(3, 450)]), offer(2, 7, 249, 0.5)]
    got = resolved(spark, tiers, [(1, 1, 3, "CHEAPEST")], substitution.Shopper(blocked_products=(2,)))
    assert (got[1, "CHEAPEST"].total_bani, got[1, "CHEAPEST"].blocked) == (1350, 1)


def test_flyer_rows_without_a_date_are_displayed(spark):
    schema = "availability string, is_stale boolean, flagged boolean, promo_valid_to timestamp_ntz, recorded_at timestamp_ntz, price_source string"
    rows = [("in stock", False, False, None, None, s) for s in ("FLYER", "API", None)] + [("in stock", None, None, None, dt.datetime(2026, 1, 1), "DELIVERY_PLATFORM")]
    frame = spark.createDataFrame(rows, schema)
    assert [bool(r[0]) for r in frame.select(predicates.is_displayed(moment(), 14)).collect()] == [True, False, False, False]
    assert [bool(r[0]) for r in frame.select(predicates.is_displayed(moment(), 14, True)).collect()] == [True, False, False, True]


def values(spark, column, *rows, schema):
    return [r[0] for r in spark.createDataFrame(list(rows), schema).select(column).collect()]


def test_exclusions(spark):
    names = [("Tigari Kent", None), ("Guma Nicorette menta", None), ("Rezerve tutun heets", "x"), ("Velo bicicleta", None), ("Velo pliculete nicotina", None), ("Plasturi cu nicotina", None)]
    assert values(spark, R.exclusion_reason(F.col("n"), F.col("b")), *names, schema="n string, b string") == ["tobacco", None, "tobacco", None, "tobacco", None]


def test_images(spark):
    rows = [("https://a.ro/i.jpg",), (" /i.jpg",), ("data:image/png;x",), ("https://a.ro/",), ("https://a.ro/spinner.gif",), (None,), ("ftp://a.ro/i.jpg",)]
    assert values(spark, R.image_to_store(F.col("u"), ["spinner"]), *rows, schema="u string") == ["https://a.ro/i.jpg", "/i.jpg", None, None, None, None, None]
    rows = [("a.jpg 320w, b.jpg 640w",), ("a.jpg, b.jpg 2x",), ("a.jpg",), ("",), (None,)]
    assert values(spark, R.from_srcset(F.col("u")), *rows, schema="u string") == ["b.jpg", "b.jpg", "a.jpg", None, None]
    rows = [("x.jpg",), ("/x.jpg",), ("//c.ro/x.jpg",), ("https://d.ro/x.jpg",), ("data:x",)]
    assert values(spark, R.absolute(F.col("u"), F.lit("https://a.ro/p/q?x")), *rows, schema="u string") == ["https://a.ro/p/x.jpg", "https://a.ro/x.jpg", "https://c.ro/x.jpg", "https://d.ro/x.jpg", None]
    picked = R.picked_image([(F.col("a"), False), (F.col("b"), True)], F.lit("https://a.ro/p/"), ["spinner"])
    assert values(spark, picked, ("spinner.gif", "s.jpg 1x, l.jpg 2x"), schema="a string, b string") == ["https://a.ro/p/l.jpg"]


def test_weights_paths_and_prices(spark):
    rows = [("Pui +/- 0.700 Kg",), ("cca. 250 g sau cca. 300 g",), ("1 kg",)]
    assert values(spark, R.approx_size(F.col("t")), *rows, schema="t string") == [0.7, 0.3, None]
    assert values(spark, R.variable_weight(F.col("p"), F.col("k"), F.col("w")), (1400, 2000, 0.7), (1400, 2000, 0.5), schema="p long, k long, w double") == [0.7, None]
    assert values(spark, R.path_key(F.col("t")), ("Lactate > Lapte / UHT",), schema="t string") == ["lactate>lapte>uht"]
    assert values(spark, R.format_bani(F.col("p")), (1234567,), (5,), schema="p long") == ["12.345,67 lei", "0,05 lei"]
    assert values(spark, R.not_a_brand(F.col("v"), F.lit("Shop.ro"), ["generic"]), ("Shop",), ("Generic",), ("12",), ("Zuzu",), (None,), schema="v string") == [True, True, True, False, True]
    shapes = [(200.0, 100.0), (100.0, 101.0), (50.0, 100.0), (100000.0, 100.0), (130.0, 100.0), (80.0, 100.0), (1.0, None)]
    assert values(spark, R.per_unit_mismatch(F.col("a"), F.col("b")), *shapes, schema="a double, b double") == ["2-times-large", "ok", "2-times-small", "thousand", "larger", "smaller", None]
    texts = [("1.234,50 lei",), ("12,50 lei 10,00 lei/kg",), ("0,00 lei",), (None,)]
    assert values(spark, prices.parse_price(F.col("t"))["bani"], *texts, schema="t string") == [123450, 1250, None, None]


def test_ingest_keeps_people_above_rules(spark):
    decided = spark.createDataFrame([(1, 10, "AUTO", "ean", 10000), (1, 11, "REVIEW", "fan-out", 9000), (2, 10, "AUTO", "brand+size", 9000), (3, 12, "AUTO", "name+size", 7000)], "item_id long, id long, band string, reason string, score_bp long")
    pool = spark.createDataFrame([(1, 7, 300, True), (2, 7, 200, False), (3, 7, 100, True)], "item_id long, merchant_id long, price_bani long, available boolean")
    said = spark.createDataFrame([(3, 10, "confirm"), (1, 10, "reject"), (9, 12, "confirm")], "item_id long, id long, verdict string")
    out = ingest.standing(decided, pool, said)
    assert {(r.item_id, r.id, r.reason) for r in out.collect()} == {(1, 11, "fan-out"), (2, 10, "brand+size"), (3, 10, "override")}
    assert [(r.id, r.item_id) for r in ingest.best_items(out, pool).collect()] == [(10, 3)]


def test_register_and_regressions(spark):
    nights = spark.createDataFrame([("a", dt.date(2026, 1, d), d < 3) for d in (1, 2, 3)] + [("b", dt.date(2026, 1, 1), True)], "name string, day date, ok boolean")
    assert [(r.name, r.day.day) for r in gates.regressions(nights).collect()] == [("a", 3)]
    assert [(r.name, r.change) for r in gates.invariant_transitions(nights).collect()] == [("a", "broken")]


def test_adapter_reads_json_and_cards(spark, tmp_path):
    payload = json.dumps({"data": {"items": [{"n": "Lapte", "u": "/a", "p": {"v": 5}}, {"n": "Lapte", "u": "/a"}, {"n": " ", "u": "/b"}]}})
    one = readers.Adapter("json", {"name": "n", "url": "u", "price": "p.v"}, items="data.items", template="https://a.ro/p{page}", max_pages=2)
    rows = one.products(spark.createDataFrame([(payload,), ("{",)], "payload string"))
    assert rows.count() == 1 and [r.url for r in one.routes(spark).collect()] == ["https://a.ro/p1", "https://a.ro/p2"]
    html = '<div class="card"><b class="n">Ulei</b><i class="p">9,99</i></div>'
    dom = readers.Adapter("dom", {"name": "n", "price": "p"}, card="card").products(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string"))
    assert [(r.page_id, r.name, r.price) for r in dom.collect()] == [(1, "Ulei", "9,99")]
    readers.register(spark)
    got = spark.sql(f"select * from explode_cards('{html}', 'card', 'n', 'p')").collect()
    assert [(r.name, r.price) for r in got] == [("Ulei", "9,99")] and spark.sql("select osa_distance('imlk', 'milk')").first()[0] == 1
    assert readers.write_audit(dom, str(tmp_path / "audit")) == 1 and spark.read.json(str(tmp_path / "audit")).first().findings == 1


def test_streams_equal_their_batch_twins(spark, tmp_path):
    base = dt.datetime(2026, 1, 1)
    rows = [(u, 1, base + dt.timedelta(hours=h)) for u, hs in ((1, (0, 5, 19, 20, 45)), (2, (0, 30))) for h in hs]
    frame = spark.createDataFrame(rows, "user_id long, product_id long, ts timestamp")
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    for name, plan, batch in (("cool", twins.cooled_down(stream), twins.cooled_down_batch(frame)), ("seen", twins.first_seen(stream, ["user_id"], "ts"), frame.dropDuplicates(["user_id"]))):
        query = plan.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        got = spark.table(name)
        if name == "cool":
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect())) and got.count() == 5
        else:
            assert {r.user_id for r in got.collect()} == {1, 2} and got.count() == batch.count()
    assert {(r.user_id, r.events) for r in twins.shopping_trips(frame, 12).collect()} == {(1, 2), (1, 2), (1, 1), (2, 1)}
