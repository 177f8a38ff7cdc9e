"""Lookup, paths, payloads, receipts, groups that disagree and rule changes against plain versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from marketloom import catalog
from marketloom.operators import deltas, disagree, lookup, paths, payloads, receipts

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_rule_decides_some_pair(spark):
    got = {r.reason for r in catalog.QUERIES["match_rules"](spark, FOLDER).select("reason").distinct().collect()}
    assert got >= {
        "ean", "size-unit", "size", "head-noun", "brand", "variant-flavour", "variant-qualifier", "variant-fat", "variant-format", "pack-shape", "descriptor-conflict",
        "mutually-distinct", "variant-mismatch", "dose-mismatch", "variant-code-mismatch", "low-overlap", "brand+size", "name+size",
    }


@pytest.fixture(scope="module")
def names():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(1, 6)))
    return [(i, " ".join(word() for _ in range(r.randint(0, 4)))) for i in range(200)] + [(900, None), (901, "Țuică de PRUNE 0,5 l")]


def test_substrings_equal_brute_force(spark, names):
    index = lookup.name_index(spark.createDataFrame(names, "id long, name string"))
    r = random.Random(4)
    asked = [(q, "".join(r.choice("abcde ") for _ in range(r.randint(1, 5)))) for q in range(60) for _ in range(r.randint(1, 2))] + [(70, "tuica"), (71, ""), (72, None), (73, "uica de pru"), (73, "uica de pru")]
    found = lookup.containing(index, spark.createDataFrame(asked, "request_id long, needle string"))
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    norm = {i: " ".join((n or "").lower().replace("ț", "t").replace("ă", "a").replace(",", " ").split()) for i, n in names}
    needles = {}
    for q, n in asked:
        if n:
            needles.setdefault(q, set()).add(n)
    want = {(q, i) for q, ns in needles.items() for i, text in norm.items() if all(n in text for n in ns)}
    assert {tuple(x) for x in found.collect()} == want and len(want) > 60


def test_lookup_statuses(spark):
    schema = "id long, name string, brand string, section string, unit string, unit_size double"
    catalog_rows = [(1, "Lapte Zuzu integral", "Zuzu", "grocery", "l", 1.0), (2, "Lapte Zuzu integral", "Zuzu", "grocery", "l", 2.0), (3, "Lapte proaspat", None, "grocery", None, None), (4, "Suc Cola", "Cola", "grocery", "l", 1.0)]
    index = lookup.name_index(spark.createDataFrame(catalog_rows, schema))
    asked = [(1, "Lapte integral Zuzu", "1 l", "l", 1.0), (2, "de la 12", None, "l", 1.0), (3, "Branza", "1 l", "l", 1.0), (4, "Suc cola", "1 l", "l", 1.0), (5, "Lapte Zuzu integral fara lactoza bun ieftin", "1 l", "l", 1.0), (6, None, None, None, None)]
    got = lookup.name_lookup(index, spark.createDataFrame(asked, "request_id long, name string, size_text string, unit string, unit_size double"), spark.createDataFrame([(1,), (2,), (3,)], "id long"))
    rows = {r.request_id: (r.status, r.product_id, r.reason) for r in got.collect()}
    assert rows[1] == ("confident", 1, "brand+size")
    assert rows[2] == rows[6] == ("none", None, "no-usable-tokens") and rows[3] == ("none", None, "no-candidate")
    assert rows[4] == ("none", None, "no-candidate")  # only there without an offer
    assert rows[5][1] is None or rows[5][0] == "confident"


OFFERS = "merchant_id long, payload string, url string, category_path string"


def test_paths_of_each_kind(spark):
    listed = '{"id":1,"categories":["/Lactate si oua/Oua/Oua de gaina/","/Lactate si oua/Oua/","/A/B/C/"],"desc":"cut of'
    rows = [
        (1, listed, None, None), (1, '{"id":1}', None, None), (1, None, None, "x/y"), (2, None, "https://www.shop.ro/Lactate-si-oua/Lapte/Lapte-1-5/lapte-zuzu/p/39620?q=1", None),
        (2, None, "/Fructe/Mere/p/1", None), (2, None, "https://shop.ro/p/1", None), (3, '{"breadcrumbs":[{"name":" Bauturi "},{"code":1},{"name":""},{"name":"Sucuri"}]}', None, None), (3, '{"breadcrumbs":[{"na', None, None),
        (4, None, None, "lactate-si_oua / Oua  mari/"), (4, None, None, ""), (None, None, None, "a/b"),
    ]
    kinds = spark.createDataFrame([(1, "listed-paths"), (2, "url-folders"), (3, "breadcrumbs"), (3, "breadcrumbs")], "merchant_id long, kind string")
    got = [(r.levels, r.path_source) for r in paths.recovered(spark.createDataFrame(rows, OFFERS).coalesce(1), kinds).collect()]
    want = [
        (["Lactate si oua", "Oua", "Oua de gaina"], "listed-paths"), (None, None), (None, None), (["Lactate si oua", "Lapte", "Lapte 1 5"], "url-folders"), (["Fructe"], "url-folders"), (["p"], "url-folders"),
        (["Bauturi", "Sucuri"], "breadcrumbs"), (None, None), (["lactate si oua", "Oua mari"], "stored-path"), (None, None), (["a", "b"], "stored-path"),
    ]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_longest_prefix_and_review(spark):
    mapped = [(["A", "B"], "leaf1", "a"), (["A", "B"], "leaf1", "a"), (["a", "b", "C"], "leaf2", "a"), (["D", "E"], "leaf3", "d"), (["D", "F"], "leaf4", "d"), (["G"], "leaf5", "g"), (["G", "H"], "leaf5", "x")]
    trie = paths.path_trie(spark.createDataFrame(mapped, "levels array<string>, leaf string, department string"))
    asked = [(["A", "B", "C", "Z"],), (["A", "B", "X"],), (["D", "Q"],), (["D", "E", "Q"],), (["G", "Y"],), (["Nowhere"],), (["A", "B", "X"],), ([],), (None,)]
    got = {tuple(r.levels): (r.leaf, r.department, r.depth, r.band) for r in paths.by_longest_prefix(spark.createDataFrame(asked, "levels array<string>"), trie).collect()}
    assert got == {
        ("A", "B", "C", "Z"): ("leaf2", "a", 3, "AUTO"), ("A", "B", "X"): (None, "a", 2, "REVIEW"), ("D", "Q"): (None, "d", 1, "REVIEW"), ("D", "E", "Q"): ("leaf3", "d", 2, "AUTO"),
        ("G", "Y"): ("leaf5", None, 1, "AUTO"), ("Nowhere",): (None, None, 0, "NONE"), (): (None, None, 0, "NONE"),
    }


def test_levels_decide_from_the_deepest(spark):
    none = None
    rules = spark.createDataFrame([("oua", "lactate-oua", "oua", none, none), ("lapte", "lactate-oua", "lapte", none, none), ("mere", "fructe-legume", "mere", none, none)], "category string, department string, word string, phrase string, avoid string")
    departments = spark.createDataFrame([("lactate-oua", "Lactate și ouă", 0), ("congelate", "Congelate", 1), ("curatenie-igiena", "Curățenie și igienă", 2)], "department string, label string, place int")
    asked = [(["Lactate si oua", "Oua", "Oua de gaina"],), (["Lactate si oua"],), (["Produse congelate"],), (["Curatenie si intretinere"],), (["Fructe", "Mere"],), (["Mere", "Lactate si oua"],), (["x"],), (None,)]
    got = {" / ".join(r.levels): (r.leaf, r.department, r.score, r.band) for r in paths.assign_by_path(spark.createDataFrame(asked, "levels array<string>"), rules, departments).collect()}
    assert got == {
        "Lactate si oua / Oua / Oua de gaina": ("oua", "lactate-oua", 95, "AUTO"), "Lactate si oua": ("lactate-oua-altele", "lactate-oua", 62, "AUTO"), "Produse congelate": ("congelate-altele", "congelate", 62, "AUTO"),
        "Curatenie si intretinere": (None, None, 0, "NONE"), "Fructe / Mere": ("mere", "fructe-legume", 95, "AUTO"), "Mere / Lactate si oua": ("mere", "fructe-legume", 95, "AUTO"), "x": (None, None, 0, "NONE"),
    }


def plain_brand(value, depth=0):
    """Depth first in the order of the text."""
    if not isinstance(value, dict | list) or depth > payloads.DEEPEST:
        return None
    fine = lambda t: isinstance(t, str) and not (t.strip().lower() in payloads.NO_BRANDS or t.strip().startswith("(") and t.strip().endswith(")") or len(t.strip()) < 2)
    if isinstance(value, dict):
        for key in payloads.BRAND_KEYS:
            if fine(value.get(key)):
                return value[key].strip(), key, depth
            if isinstance(value.get(key), dict) and fine(value[key].get("name")):
                return value[key]["name"].strip(), f"{key}.name", depth
    for inner in value.values() if isinstance(value, dict) else value:
        hit = plain_brand(inner, depth + 1)
        if hit:
            return hit
    return None


def test_payload_brands_equal_a_plain_walk(spark):
    r = random.Random(5)

    def made(depth):
        kind = r.random()
        if depth > 5 or kind < 0.35:
            return r.choice([1, None, True, "Acme", " Beta ", "(bucata)", "n/a", "x", "", {"name": "Gamma"}, {"name": 7}])
        if kind < 0.5:
            return [made(depth + 1) for _ in range(r.randint(0, 3))]
        return {k: made(depth + 1) for k in r.sample(["z", "a", "brand", "items", "marca", "m n", "manufacturer"], r.randint(0, 4))}

    docs = [json.dumps(made(0), ensure_ascii=False) for _ in range(300)]
    rows = [*enumerate(docs), (1000, None), (1001, ""), (1002, '{"brand":"Cut'), (1003, "[]")]
    got = {x.id: (x.value, x.key, x.depth) for x in payloads.payload_brands(spark.createDataFrame(rows, "id long, payload string")).collect()}
    want = {i: plain_brand(json.loads(d)) for i, d in enumerate(docs)}
    assert got == {i: v for i, v in want.items() if v} and len(got) > 60


RECEIPT = """S.C. KAUFLAND ROMANIA SCS
CIF RO123   Data: 15.03.2024
LAPTE ZUZU 1.5% 1L      1 x 6,49       6,49 B
PAINE FELIATA 500G                     4,99 A
PUNGA                   2 x 0,50
ROSII  0,45 x 10,13   4,56 B
TVA B 9%   1,02
??
TOTAL  LEI                               17,04
VA MULTUMIM"""


def test_receipts(spark):
    rows = [(1, RECEIPT), (2, RECEIPT.replace("17,04", "40,00").replace("KAUFLAND", "MEGA  IMAGE").replace("15.03.2024", "2024-03-16")), (3, None), (4, ""), (5, "total 5"), (6, "A 1 x 2,00\n12 12,00\nab 3,00\nPAINE 10.000,00\nOua 1.234,50 D")]
    got = {r.receipt_id: r for r in receipts.read(spark.createDataFrame(rows, "receipt_id int, text string")).collect()}
    one = got[1]
    assert (one.shop, str(one.day), one.total_bani, one.balances, one.skipped) == ("kaufland", "2024-03-15", 1704, True, ["??"])
    assert [tuple(i) for i in one["items"]] == [("LAPTE ZUZU 1.5% 1L", 1.0, 649, 649), ("PAINE FELIATA 500G", 1.0, 499, 499), ("PUNGA", 2.0, 50, 100), ("ROSII", 0.45, 1013, 456)]
    assert (got[2].shop, str(got[2].day), got[2].balances) == ("mega-image", "2024-03-16", False)
    assert all(got[i]["items"] == [] and got[i].balances is None for i in (3, 4, 5)) and got[5].total_bani == 500
    assert [i.name for i in got[6]["items"]] == ["A", "Oua"] and got[6].skipped == ["12 12,00", "ab 3,00", "PAINE 10.000,00"]
    assert receipts.purchases(receipts.read(spark.createDataFrame(rows, "receipt_id int, text string"))).count() == 10


def test_groups_that_disagree(spark):
    rows = [(1, m, p, n, True) for m, p, n in ((1, 100, "Agar praf 100 g"), (2, 104, "Praf de agar"), (3, 500, "Agar foi"), (4, 510, "Foi agar"), (5, 98, None))]
    rows += [(2, m, 100, "x", True) for m in range(4)] + [(3, 1, 100, "x", True), (3, 2, 900, "y", True)] + [(1, 6, 9, "z", False)]
    got = disagree.disagreeing_groups(spark.createDataFrame(rows, "product_id long, merchant_id long, price_bani long, store_name string, visible boolean")).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.product_id, r.median_bani, r.offers, r.disagreeing, r.gap_bp, r.low, r.high) == (1, 104.0, 5, 2, 48077, 3, 2)
    assert (r.low_words, r.high_words, r.some_words, r.unnamed) == ("praf", "foi", "foi praf", True)


def test_contradictions(spark):
    texts = [("Lapte Zuzu 3,5% grasime", "Lapte Zuzu 1.5% grasime", "fat: 35 vs 15"), ("Kefir capsuni", "Kefir vanilie", "flavour: capsuni vs vanilie"), ("Kefir", "Kefir vanilie", None), ("Lapte 1 5", "Lapte 3 5 bio", "fat: 15 vs 35"), ("Lapte bio", "Lapte ecologic fara lactoza", None)]
    df = spark.createDataFrame(texts, "a string, b string, want string")
    for r in df.select("want", disagree.contradiction(disagree.discriminators(F.col("a")), disagree.discriminators(F.col("b"))).alias("got")).collect():
        assert r.got == r.want
    rows = [(1, "Kefir Zuzu vanilie", "Zuzu"), (2, "Kefir Zuzu capsuni", None), (3, "Kefir simplu", "Zuzu"), (4, "Kefir", "zuzu "), (5, "Kefir", "(bucata)"), (6, None, "Zuzu")]
    products = spark.createDataFrame([(i, n, b, "grocery", "kg", 0.4) for i, n, b in rows], "id long, name string, brand string, section string, unit string, unit_size double")
    got = disagree.duplicate_contradictions(products).collect()
    assert [(r.brand_key, r.products, r.statements, r.contradictions, r.could_merge) for r in got] == [("zuzu", 5, 4, "flavour:capsuni|simplu|vanilie", 2)]


def test_rule_changes_equal_two_full_runs(spark):
    r = random.Random(6)
    entries = lambda n, name: [(f"k{r.randint(0, 25)}", i) for i in range(n) for _ in range(r.randint(0, 3))]
    frames, plainly = [], []
    for n, name in ((40, "id"), (40, "id"), (60, "item_id"), (60, "item_id")):
        rows = entries(n, name)
        if len(plainly) % 2:  # most entries stay
            rows = [e for e in plainly[-1] if r.random() < 0.8] + rows[: len(rows) // 5]
        plainly.append(sorted(set(rows)))
        frames.append(spark.createDataFrame(plainly[-1], f"key string, {name} long"))
    got = {tuple(x) for x in deltas.changed_candidates(*frames).collect()}
    pairs = lambda c, p: {(i, j) for k, i in c for m, j in p if k == m}
    old, new = pairs(plainly[0], plainly[2]), pairs(plainly[1], plainly[3])
    assert got == {(*p, "reached") for p in new - old} | {(*p, "lost") for p in old - new} and len(got) > 40
    empty = [f.limit(0) for f in frames]
    assert deltas.changed_candidates(*empty).count() == 0
    assert {tuple(x)[:2] for x in deltas.changed_candidates(empty[0], frames[1], empty[2], frames[3]).collect()} == new
