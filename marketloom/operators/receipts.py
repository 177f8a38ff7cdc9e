"""Receipts: purchases, totals, shops and dates read from their text, line by line."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions import scalars as S
from marketloom.functions.grammar import let

# fixed values: what a receipt's text says of its shop, first hit counts
SHOPS = [
    ("kaufland", "kaufland"), ("lidl", "lidl"), ("carrefour", "carrefour"), ("auchan", "auchan"), (r"mega\s*image", "mega-image"),
    ("profi", "profi"), ("penny", "penny"), ("selgros", "selgros"), ("metro", "metro"),
]
# fixed values: how lines begin that are no purchase
NOISE = [
    "total", "subtotal", "tva", "rest", "numerar", "card", "bon", "cif", r"c\.i\.f", "cui", r"nr\.", "casa", "casier", "data", "ora", r"s\.?c\.?", r"str\.", "adresa",
    "magazin", "client", "puncte", "discount", "reducere", "vanzare", "cod fiscal", "multumim", "va multumim", "serie", r"www\.", "tel",
]
AMOUNT = r"([\d.,]+)"
COUNT = r"(\d+(?:[.,]\d+)?)\s*[xX*]\s*"
LINE = "struct<name:string,qty:double,unit_bani:long,bani:long>"


def _bani(amount: Column) -> Column:
    return S.half_up(S.parse_decimal(amount) * 100)


def shop(text: Column) -> Column:
    """The first of SHOPS that the text names, else null."""
    return F.coalesce(*(F.when(text.rlike(f"(?i){pattern}"), slug) for pattern, slug in SHOPS))


def day(text: Column) -> Column:
    """The first date in the text, day first or year first; null where that is no date."""
    found = [(r"\b(\d{2})[.\-/](\d{2})[.\-/](\d{4})\b", (3, 2, 1)), (r"\b(\d{4})-(\d{2})-(\d{2})\b", (1, 2, 3))]
    dates = [F.concat_ws("-", *(F.regexp_extract(text, pattern, i) for i in order)).try_cast("date") for pattern, order in found]
    return F.coalesce(*dates)


def lines(text: Column) -> Column:
    """The lines of a text that are not empty, white space made single spaces; null text has none."""
    each = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.filter(each, lambda x: x != "")


def _matched(line: Column, pattern: str, count: int, body: Callable[[list[Column]], Column]) -> Column:
    """``body`` of a pattern's groups, found in one go; null where a line (which has no line feed) does not match."""
    found = F.split(F.regexp_replace(line, pattern + "(?s:.*)", "\n".join(f"${i}" for i in range(1, count + 1))), "\n")
    return let(found, lambda g: F.when(F.size(g) == count, body([F.get(g, F.lit(i)) for i in range(count)])))


def read_line(line: Column) -> Column:
    """struct<kind, item> of one line: total, noise, item or skipped.

    Items are, in this order, "name 2 x 6,49 12,98 B", "name 2 x 6,49", and "name
    4,99 A", whose name needs three letters in a row and whose price is below
    10,000.  A total's amount is its item's bani.
    """
    item = lambda name, qty, unit, bani: F.struct(F.trim(name).alias("name"), qty.alias("qty"), unit.alias("unit_bani"), bani.alias("bani")).cast(LINE)
    fact = lambda **parts: F.struct(*(x.alias(name) for name, x in parts.items()))
    nothing = F.lit(None).cast(LINE)
    total = r"(?i)^total\b[^0-9]*" + AMOUNT
    stated = item(F.lit("total"), F.lit(None).cast("double"), F.lit(None).cast("long"), _bani(F.regexp_extract(line, total, 1)))
    noise = "(?i)^(" + "|".join(NOISE) + ")"
    full = _matched(line, rf"^(.+?)\s+{COUNT}{AMOUNT}\s+{AMOUNT}\s*[A-D]?$", 4, lambda g: fact(name=g[0], qty=S.parse_decimal(g[1]), unit=_bani(g[2]), bani=_bani(g[3])))
    full = let(full, lambda f: F.when((f["qty"] > 0) & (f["unit"] > 0) & f["bani"].isNotNull(), item(f["name"], f["qty"], f["unit"], f["bani"])))
    short = _matched(line, rf"^(.+?)\s+{COUNT}{AMOUNT}\s*[A-D]?$", 3, lambda g: fact(name=g[0], qty=S.parse_decimal(g[1]), unit=_bani(g[2])))
    short = let(short, lambda f: F.when((f["qty"] > 0) & (f["unit"] > 0), item(f["name"], f["qty"], f["unit"], S.half_up(f["qty"] * f["unit"]))))
    simple = _matched(line, rf"^(.+?)\s+{AMOUNT}\s*[A-D]?$", 2, lambda g: F.when(g[0].rlike("(?i)[a-zăâîșț]{3,}"), fact(name=g[0], bani=_bani(g[1]))))
    simple = let(simple, lambda f: F.when((f["bani"] > 0) & (f["bani"] < 1_000_000), item(f["name"], F.lit(1.0), f["bani"], f["bani"])))
    made = lambda kind, found: fact(kind=F.lit(kind), item=found)
    other = let(F.coalesce(full, short, simple), lambda x: F.when(x.isNotNull(), made("item", x)).otherwise(made("skipped", nothing)))
    return F.when(line.rlike(total), made("total", stated)).when(line.rlike(noise), made("noise", nothing)).otherwise(other)


def read(receipts: DataFrame, id_col: str = "receipt_id", text_col: str = "text") -> DataFrame:
    """One row per receipt: id, shop, day, items (array), total_bani, skipped (lines), balances.

    The last total that can be read counts.  ``balances`` tells whether the items
    add up to it within 5 bani or 1 %; null without a total or items.  Null and
    empty texts have no items; all work is on Column expressions.
    """
    rows = receipts.select(F.col(id_col), F.col(text_col).alias("_t"), F.transform(lines(F.col(text_col)), lambda x: F.struct(x.alias("line"), read_line(x).alias("r"))).alias("_l"))
    of = lambda kind: F.filter("_l", lambda x: x["r"]["kind"] == kind)
    items = F.transform(of("item"), lambda x: x["r"]["item"])
    totals = F.filter(F.transform(of("total"), lambda x: x["r"]["item"]["bani"]), lambda x: x.isNotNull())
    rows = rows.select(id_col, shop(F.col("_t")).alias("shop"), day(F.col("_t")).alias("day"), items.alias("items"), F.try_element_at(totals, F.lit(-1)).alias("total_bani"), F.transform(of("skipped"), lambda x: x["line"]).alias("skipped"))
    added = F.aggregate("items", F.lit(0).cast("long"), lambda s, x: s + x["bani"])
    return rows.withColumn("balances", F.when(F.size("items") > 0, F.abs(added - F.col("total_bani")) <= F.greatest(F.lit(5.0), F.col("total_bani") / 100)))


def purchases(read_receipts: DataFrame, id_col: str = "receipt_id") -> DataFrame:
    """One row per item of ``read``'s receipts: id, line, shop, day, name, qty, unit_bani, bani."""
    return read_receipts.select(id_col, "shop", "day", F.posexplode("items").alias("line", "item")).select(id_col, "line", "shop", "day", "item.*")
