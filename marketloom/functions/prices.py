"""Prices and quantities read from raw shop texts.

Column expressions do the work where one pattern decides; where many rules
follow each other, small functions run over Arrow batches (``parse_price``,
``parse_quantity``).
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: currencies, per-unit marks, units
CURRENCY = r"(?:lei|ron|leu)"
NUMBER = r"[0-9][0-9.,]*[0-9]|[0-9]"
PRICED = re.compile(rf"({NUMBER})\s*{CURRENCY}\b(?!\s*/\s*(?:kg|l|buc|100))", re.I)
SPLIT = re.compile(rf"\b([0-9]{{1,5}})\s+([0-9]{{2}})\s*{CURRENCY}\b", re.I)
DATE = re.compile(r"\b[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}\b")
REFERENCE = re.compile(rf"(?:cel mai mic preț|cel mai mic pret|pret anterior|preț anterior|prp|in loc de|în loc de)[^0-9]{{0,40}}({NUMBER})(?:\s*{CURRENCY})?", re.I)
BARE = re.compile(NUMBER)
UNITS = {"g": ("G", 1.0), "gr": ("G", 1.0), "kg": ("G", 1000.0), "mg": ("G", 0.001), "ml": ("ML", 1.0), "cl": ("ML", 10.0), "l": ("ML", 1000.0), "litri": ("ML", 1000.0), "litru": ("ML", 1000.0), "buc": ("BUC", 1.0), "bucati": ("BUC", 1.0), "role": ("BUC", 1.0), "capsule": ("BUC", 1.0), "plicuri": ("BUC", 1.0)}
UNIT = "|".join(sorted(UNITS, key=len, reverse=True))
MULTI = re.compile(rf"([0-9]+)\s*x\s*([0-9]+(?:[.,][0-9]+)?)\s*({UNIT})\b", re.I)
REVERSE = re.compile(rf"([0-9]+(?:[.,][0-9]+)?)\s*({UNIT})\s*x\s*([0-9]+)\b", re.I)
SINGLE = re.compile(rf"([0-9]+(?:[.,][0-9]+)?)\s*({UNIT})\b(?!\s*%)", re.I)
ATTACHED = re.compile(r"\(?\b([0-9]+)\s*\+\s*([0-9]+)\)?\s*(?:x|gratis)", re.I)
SUFFIX = re.compile(r"\+\s*([0-9]+)\s*(?:buc\w*\s*)?gratis", re.I)


def decimal(token: str) -> float | None:
    """A number with either decimal mark (the rules of ``scalars.parse_decimal``)."""
    token = token.strip()
    dots, commas = token.count("."), token.count(",")
    if dots and commas:
        token = token.replace(".", "").replace(",", ".") if token.rfind(",") > token.rfind(".") else token.replace(",", "")
    elif commas or dots:
        mark = "," if commas else "."
        whole = token.count(mark) > 1 or re.search(r"[.,][0-9]{3}$", token)
        token = token.replace(mark, "") if whole else token.replace(mark, ".")
    return float(token) if re.fullmatch(r"[0-9]+(\.[0-9]+)?", token) else None


def bani(value: float) -> int:
    """Lei to bani, halves upwards."""
    return int(value * 100 + 0.5)


def read_price(raw: str | None) -> dict:
    """The price of a text in bani, its reference price if stated, and the reference's kind.

    Dates and reference statements are set aside first; of several priced
    figures the lowest counts; bare numbers count only if there is just one.
    """
    out = {"bani": None, "reference_bani": None, "reference_kind": None}
    if not raw:
        return out
    text = DATE.sub(" ", raw)
    ref = REFERENCE.search(text)
    if ref:
        value = decimal(ref.group(1))
        if value:
            out |= {"reference_bani": bani(value), "reference_kind": "OMNIBUS" if "mic" in ref.group(0).lower() else "STRIKETHROUGH"}
        text = text[: ref.start()] + " " + text[ref.end() :]
    found = [int(a) * 100 + int(b) for a, b in SPLIT.findall(text)]
    if not found:
        found = [bani(v) for v in map(decimal, PRICED.findall(text)) if v is not None]
    if not found:
        bare = {v for v in map(decimal, BARE.findall(text)) if v is not None}
        found = [bani(v) for v in bare] if len(bare) == 1 else []
    out["bani"] = min((v for v in found if v > 0), default=None)
    if out["bani"] and len(set(found)) > 1 and out["reference_bani"] is None:
        out |= {"reference_bani": max(found), "reference_kind": "STRIKETHROUGH"}
    if out["reference_bani"] is not None and (out["bani"] is None or out["reference_bani"] <= out["bani"]):
        out |= {"reference_bani": None, "reference_kind": None}
    return out


def read_quantity(name: str | None) -> dict:
    """Total content of a product name, its unit, pack shape and promotional pieces."""
    out = {"value": None, "unit": None, "pack_count": 1, "pack_size": None, "paid": None, "free": None, "is_promo": False}
    if not name:
        return out
    text = name.replace("×", "x")
    promo = ATTACHED.search(text)
    if promo and int(promo.group(1)) and ("gratis" in promo.group(0).lower() or promo.group(0).startswith("(")):
        out |= {"paid": int(promo.group(1)), "free": int(promo.group(2)), "is_promo": True}
    elif promo := SUFFIX.search(text):
        out |= {"paid": 1, "free": int(promo.group(1)), "is_promo": True}
    if m := MULTI.search(text):
        count, size, unit = int(m.group(1)), m.group(2), m.group(3)
    elif m := REVERSE.search(text):
        count, size, unit = int(m.group(3)), m.group(1), m.group(2)
    elif all_ := list(SINGLE.finditer(text)):
        count, size, unit = 1, all_[-1].group(1), all_[-1].group(2)
        if out["is_promo"] and promo and promo.group(0).rstrip().endswith("x"):
            count = out["paid"] + out["free"]
    else:
        return out
    kind, factor = UNITS[unit.lower()]
    each = float(size.replace(",", ".")) * factor
    return out | {"value": round(each * count, 6), "unit": kind, "pack_count": count, "pack_size": round(each, 6)}


SIMPLE = r"(?i)^\s*([0-9]{1,3}(?:[.][0-9]{3})*|[0-9]+)[,]([0-9]{2})\s*(?:lei|ron)\s*$"


def parse_price(raw: Column) -> Column:
    """struct<bani,reference_bani,reference_kind>: ``read_price`` of each text; null texts give nulls.

    The usual shape ("1.234,50 lei") is read by a Column expression; other texts
    go to Python in Arrow batches.
    """

    @F.pandas_udf("bani long, reference_bani long, reference_kind string")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([read_price(x) for x in texts], columns=["bani", "reference_bani", "reference_kind"])
        return out.astype({"bani": "Int64", "reference_bani": "Int64"})

    simple = F.coalesce(raw.rlike(SIMPLE), F.lit(False))
    whole = F.replace(F.regexp_extract(raw, SIMPLE, 1), F.lit("."), F.lit("")).try_cast("long")
    bani_ = whole * 100 + F.regexp_extract(raw, SIMPLE, 2).try_cast("long")
    rest = run(F.when(~simple, raw))
    return F.struct(
        F.when(simple, F.when(bani_ > 0, bani_)).otherwise(rest["bani"]).alias("bani"), rest["reference_bani"].alias("reference_bani"), rest["reference_kind"].alias("reference_kind")
    )


def parse_quantity(name: Column) -> Column:
    """struct of ``read_quantity`` over Arrow batches."""

    @F.pandas_udf("value double, unit string, pack_count int, pack_size double, paid int, free int, is_promo boolean")
    def run(names: pd.Series) -> pd.DataFrame:
        columns = ["value", "unit", "pack_count", "pack_size", "paid", "free", "is_promo"]
        return pd.DataFrame([read_quantity(x) for x in names], columns=columns).astype({"pack_count": "Int64", "paid": "Int64", "free": "Int64"})

    return run(name)


def osa(a: str, b: str) -> int:
    """Edits between two words: insert, delete, replace, swap of neighbours."""
    older, old = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
            if older is not None and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            row.append(best)
        older, old = old, row
    return old[-1]


def osa_distance(a: Column, b: Column) -> Column:
    """``osa`` over Arrow batches, for distinct word pairs."""

    @F.pandas_udf("int")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([osa(p, q) if p is not None and q is not None else None for p, q in zip(x, y, strict=True)], dtype="Int64")

    return run(a, b)


def receipt_lines(text: Column) -> Column:
    """array<struct<name,qty,bani>> of the purchase lines of a receipt text.

    A line is a name followed by a price, or quantity x price before the total;
    totals, cards and tax lines are noise.
    """
    line = r"(?m)^[ \t]*([^\n]*?[A-Za-z][^\n]*?)[ \t]+(?:([0-9]+(?:[.,][0-9]+)?)[ \t]*[xX][ \t]*[0-9]+[.,][0-9]{2}[ \t]+)?([0-9]+[.,][0-9]{2})[ \t]*(?:[A-Z])?[ \t]*$"
    names, counts, prices = (F.regexp_extract_all(text, F.lit(line), F.lit(i)) for i in (1, 2, 3))
    rows = F.arrays_zip(names.alias("n"), counts.alias("c"), prices.alias("p"))
    kept = F.filter(rows, lambda r: ~r["n"].rlike(r"(?i)^\s*(total|subtotal|tva|card|rest|numerar|bon|cif|data)\b"))
    number = lambda x: F.replace(x, F.lit(","), F.lit(".")).try_cast("double")
    return F.transform(
        kept,
        lambda r: F.struct(F.trim(r["n"]).alias("name"), F.coalesce(number(r["c"]), F.lit(1.0)).alias("qty"), F.floor(number(r["p"]) * 100 + 0.5).cast("long").alias("bani")),
    )


def receipt_total(text: Column) -> Column:
    """The stated total in bani, else null."""
    t = F.regexp_extract(text, r"(?im)^\s*total\b[^0-9\n]*([0-9]+[.,][0-9]{2})", 1)
    return F.floor(F.replace(t, F.lit(","), F.lit(".")).try_cast("double") * 100 + 0.5).cast("long")


def receipt_balances(lines: Column, total: Column) -> Column:
    """Whether the lines add up to the total within 5 bani or 1 %."""
    added = F.aggregate(lines, F.lit(0).cast("long"), lambda s, r: s + r["bani"])
    return F.abs(added - total) <= F.greatest(F.lit(5), total / 100)
