"""Prices and pack sizes as shops write them."""

import pytest
from pyspark.sql import functions as F

from marketloom.functions import grammar

PRICES = [
    ("2,033.39", 203339), ("1,498.80", 149880), ("10,350.00", 1035000), ("12,99", 1299), ("12,99 lei", 1299), ("12,99 RON", 1299), ("0,59", 59), ("1,50", 150), ("2.033,39", 203339), ("2.033", 203300),
    ("2,033", 203300), ("1.234.567", None), ("12.499,00 lei", 1249900), ("2 033,39 lei", 203339), ("12.99", 1299), ("2 033,39 lei", 203339), ("12,99 lei", 1299), ("2 033,39 lei", 203339),
    ("2 033,39 lei", 203339), ("12\u2060,99 lei", 1299), ("94 49 Lei", 9449), ("94 49 Lei 92 45 Lei", 9245), ("262 90 Lei", 26290), ("12 99 lei 25 98 lei/kg", 1299), ("7,49 lei 4,99 lei/l", 749),
    ("de mi 26.08.2026 până ma 01.09.2026", None), ("de mi 26.08.2026 până ma 01.09.2026 preț fără PENNY card 11,99 LEI", 1199), ("2026-08-26", None), ("valabil 26/08/2026", None),
    ("preț minim ultimele 30 de zile: 7,99 LEI", None), ("preţ minim ultimele 30 de zile: 7,99 LEI", None), ("preț minim ultimele 30 de zile: 7,99 LEIpreț fără PENNY card11,99 LEI1 KG 11,99 LEI", 1199),
    ("preț fără PENNY card11,99 LEI1", 1199), ("15,49 LEI2", 1549), ("preț la raft", None), ("", None), (None, None), ("0", None), ("0,00 lei", None), ("340 250 128", None), ("6.49", 649), ("6,49 6,49", 649),
    ("999999999,99 lei", None), ("abc", None), ("—", None), ("<del>15,00</del> 12,00 lei", 1200), ("8,00 lei în loc de 10,00 lei", 800), ("<s>5,00 lei</s> 9,00 lei", 900),
]
FORMER = [
    ("<del>15,00</del> 12,00 lei", 1500, "STRIKETHROUGH"), ("8,00 lei în loc de 10,00 lei", 1000, "STRIKETHROUGH"), ("<s>5,00 lei</s> 9,00 lei", None, None), ("12,99 lei", None, None),
    ("preț minim ultimele 30 de zile: 7,99 LEI 9,99 lei", 799, "OMNIBUS_30D"), ("pret anterior 10,00 lei 8,00 lei", 1000, "OMNIBUS_30D"), (None, None, None),
]


def read(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", column(F.col("t")).alias("x"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    return [r.x for r in df.orderBy("i").collect()]


def test_prices(spark):
    got = read(spark, [t for t, _ in PRICES], grammar.price)
    assert [(t, r.bani) for (t, _), r in zip(PRICES, got, strict=True)] == PRICES


def test_first_price_and_former_ones(spark):
    assert read(spark, ["94 49 Lei 92 45 Lei"], lambda t: grammar.price(t, "first"))[0].bani == 9449
    got = read(spark, [t for t, _, _ in FORMER], grammar.price)
    assert [(r.reference_bani, r.reference_kind) for r in got] == [(b, k) for _, b, k in FORMER]


# name, value, unit, pieces, size of one, paid, free, promotional
PACKS = [
    ("Făină albă 500 g", 500, "G", 1, 500, 1, 0, False), ("Zahăr 0,5 kg", 500, "G", 1, 500, 1, 0, False), ("Apă plată 1,5 L", 1500, "ML", 1, 1500, 1, 0, False), ("Smântână 250ml", 250, "ML", 1, 250, 1, 0, False),
    ("Ouă mărimea M 10 bucăți", 10, "BUC", 1, 10, 1, 0, False), ("Ouă 10 bucăţi", 10, "BUC", 1, 10, 1, 0, False), ("Apă minerală 6x1.5L", 9000, "ML", 6, 1500, 6, 0, False), ("Cașcaval feliat 3 buc x 100g", 300, "G", 3, 100, 3, 0, False),
    ("Bere 4 x 330 ml", 1320, "ML", 4, 330, 4, 0, False), ("Suc 2×1,5l", 3000, "ML", 2, 1500, 2, 0, False), ("Apă 1.5L x 6", 9000, "ML", 6, 1500, 6, 0, False), ("Drojdie 42 gr", 42, "G", 1, 42, 1, 0, False),
    ("Vin 75 cl", 750, "ML", 1, 750, 1, 0, False), ("Vitamina C 500 mg", 0.5, "G", 1, 0.5, 1, 0, False), ("Omega 3, 60 capsule", 60, "BUC", 1, 60, 1, 0, False), ("Paracetamol 20 comprimate", 20, "BUC", 1, 20, 1, 0, False),
    ("Hârtie igienică 10 role", 10, "BUC", 1, 10, 1, 0, False), ("Lapte Zuzu 1,5% grăsime 1L", 1000, "ML", 1, 1000, 1, 0, False), ("Whisky Glenfiddich 12YO, 40% alc., 0,7 l", 700, "ML", 1, 700, 1, 0, False),
    ("Set 2 pahare 250 ml", 250, "ML", 1, 250, 1, 0, False), ("Iaurt natur Activia, (7+1) x 125 g", 1000, "G", 8, 125, 7, 1, True), ("Iaurt 4+2 x 125 g", 750, "G", 6, 125, 4, 2, True), ("Bere 5+1 x 0.5L", 3000, "ML", 6, 500, 5, 1, True),
    ("Cafea Jacobs 250 g 2+1 gratis", 750, "G", 3, 250, 2, 1, True), ("Sampon Head&Shoulders 400 ml 1+1 GRATIS", 800, "ML", 2, 400, 1, 1, True), ("Gel de dus 250 ml 1+1 gratuit", 500, "ML", 2, 250, 1, 1, True),
    ("Crema 50 ml 2+1 cadou", 150, "ML", 3, 50, 2, 1, True), ("Ciocolata Milka 100 g, 3 la prețul de 2", 300, "G", 3, 100, 2, 1, True), ("Ciocolata 100 g 3 la pretul de 2", 300, "G", 3, 100, 2, 1, True),
    ("Detergent 2 x 500 g + 1 gratis", 1500, "G", 3, 500, 2, 1, True), ("Periuta de dinti Oral-B 1+1 gratis", 2, "BUC", 2, 1, 1, 1, True), ("Hartie igienica 8 role 2+1 gratis", 24, "BUC", 3, 8, 2, 1, True),
    ("Servetele pachet 2 buc", 2, "BUC", 2, 1, 2, 0, False), ("Set 3 buc prosoape", 3, "BUC", 3, 1, 3, 0, False), ("Bere Ciuc bax 24", 24, "BUC", 24, 1, 24, 0, False), ("Apa Dorna bax 24 x 0,5 l", 12000, "ML", 24, 500, 24, 0, False),
    ("Omega 3+6+9 Doppelherz, 60 capsule", 60, "BUC", 1, 60, 1, 0, False), ("ECO Avocado 90 Gr+ 1 buc", 1, "BUC", 1, 1, 1, 0, False), ("Puzzle 3+ ani, 250 g", 250, "G", 1, 250, 1, 0, False),
    ("Nurofen Immedia Ultra, 400 mg, 24 drajeuri, Reckitt", 24, "BUC", 1, 24, 1, 0, False), ("Strepsils Intensiv, 8,75 mg, 24 pastile", 24, "BUC", 1, 24, 1, 0, False), ("Canesten 6 ovule", 6, "BUC", 1, 6, 1, 0, False),
    ("Magnerot, 500 mg, 100 comprimate", 100, "BUC", 1, 100, 1, 0, False), ("LIBRESSE ABSORBANTE ZILNICE 32BUC+20BUC REGULAR", 52, "BUC", 1, 52, 1, 0, False), ("ALWAYS 12BUC PLATINUM SUPER EXTRA+DISCREET", 12, "BUC", 1, 12, 1, 0, False),
    ("Crema rectala Procto-Glyvenol, 50 mg + 20 mg/g, 30 g", 30, "G", 1, 30, 1, 0, False), ("Edenia Amestec Mexican 1kg+330g", 1330, "G", 1, 1330, 1, 0, True), ("500 g + 150 g gratis", 650, "G", 1, 650, 1, 0, True),
    ("2 l+0,5 l", 2500, "ML", 1, 2500, 1, 0, True), ("1 kg + 500 ml", 500, "ML", 1, 500, 1, 0, False), ("90 Gr+", 90, "G", 1, 90, 1, 0, False), ("24 plicuri x 15 g", 360, "G", 24, 15, 24, 0, False), ("Albrau,0.5 l", 500, "ML", 1, 500, 1, 0, False),
]
NO_SIZE = ["Pâine feliată", "", None, "Omega 3+6+9", "3+ ani", "0 g"]


def test_packs(spark):
    got = read(spark, [p[0] for p in PACKS], grammar.quantity)
    assert [(p[0], r.value, r.unit, r.pack_count, r.pack_size, r.paid, r.free, r.is_promo) for p, r in zip(PACKS, got, strict=True)] == PACKS
    assert all(r.pack_count == r.paid + r.free for r in got)
    assert read(spark, NO_SIZE, grammar.quantity) == [None] * len(NO_SIZE)


@pytest.mark.parametrize(
    ("name", "shown", "promo", "divisor", "label"),
    [("Apă 6x1.5L", "6 x 1,5 l", "", 9.0, "l"), ("Făină 500 g", "500 g", "", 0.5, "kg"), ("Orez 1 kg", "1 kg", "", 1.0, "kg"), ("Ouă 10 buc", "10 buc", "", 10.0, "buc"), ("Iaurt (7+1) x 125 g", "8 x 125 g", "7+1 gratis", 1.0, "kg"), ("bax 24", "24 buc", "", 24.0, "buc")],
)
def test_how_packs_are_shown(spark, name, shown, promo, divisor, label):
    column = lambda t: F.struct(grammar.format_quantity(grammar.quantity(t)).alias("a"), grammar.format_promo(grammar.quantity(t)).alias("b"), grammar.per_unit_divisor(grammar.quantity(t)).alias("c"))
    r = read(spark, [name], column)[0]
    assert (r.a, r.b, r.c.divisor, r.c.label) == (shown, promo, divisor, label)
