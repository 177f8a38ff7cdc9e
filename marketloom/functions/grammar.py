"""Prices and pack sizes in shop texts, read by Column expressions alone.

A text is read by the first shape that fits; the shapes of a price are an amount
printed in two parts, amounts with a currency, and a lone number; those of a pack
are listed at ``quantity``.  No row leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketloom.functions import scalars as S

# fixed values: spaces that shops print, and what a single price may be in bani
SPACES = "\u00a0\u2007\u2009\u202f\u2060"
LEAST_BANI, MOST_BANI = 1, 100_000_000
# fixed values: what looks like a price and is none, or is a former one
DATES = r"\b\d{1,2}[.\-/]\d{1,2}[.\-/]\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b"
FIGURE = r"([\d., ]+)"
FORMER = [
    (rf"(?iu)pre[tțţ]\s*minim.{{0,60}}?{FIGURE}\s*(?:lei|ron)", "OMNIBUS_30D"),
    (rf"(?iu)(?:cel\s*mai\s*mic\s*pre[tțţ]|pre[tțţ]\s*anterior|ultimele\s*30\s*(?:de\s*)?zile)[^0-9]{{0,40}}{FIGURE}\s*(?:lei|ron)", "OMNIBUS_30D"),
    (rf"(?iu)(?:<\s*(?:del|s|strike)\b[^>]*>\s*|pre[tțţ]\s*vechi[^0-9]{{0,12}}|[iî]n\s*loc\s*de\s*){FIGURE}\s*(?:lei|ron)?", "STRIKETHROUGH"),
]
PER_UNIT = r"/\s*(?:l|kg|g|ml|cl|buc|100\s*(?:g|ml))"
NOT_PER_UNIT = r"(?![a-z])(?!.{0,4}/\s*[lg])(?!.{0,3}/\s*(?:kg|ml|cl))(?!.{0,2}/\s*(?:buc|100))"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _bani(token: Column) -> Column:
    """A figure with any grouping as bani; null outside of what a price may be."""
    value = S.half_up(S.parse_decimal(F.regexp_replace(token, r"^[., ]+|[., ]+$", "")) * 100)
    return let(value, lambda v: F.when(v.between(LEAST_BANI, MOST_BANI), v))


def _amounts(tokens: Column) -> Column:
    return F.filter(F.transform(tokens, lambda t: _bani(t)), lambda b: b.isNotNull())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def price(raw: Column, prefer: str = "lowest") -> Column:
    """struct<bani, reference_bani, reference_kind> of a text.

    ``bani`` is what is paid today, the lowest or the first of several amounts;
    null where the text does not say, never 0.  Dates, former prices and prices
    per unit are no such amounts.  A struck price counts as reference only above
    the price; the lowest price of thirty days counts either way.
    """
    return let(F.translate(raw, SPACES, " " * len(SPACES)), lambda text: _price(text, prefer))


def _price(text: Column, prefer: str) -> Column:
    plain = F.regexp_replace(text, DATES, " ")
    for pattern, _ in FORMER:
        plain = F.regexp_replace(plain, pattern, " ")
    former = F.array(*(F.struct(F.get(_amounts(_found(text, pattern)), F.lit(0)).alias("bani"), F.lit(kind).alias("kind")) for pattern, kind in FORMER))
    stated = F.get(F.filter(former, lambda f: f["bani"].isNotNull()), F.lit(0))
    facts = F.struct(let(plain, lambda p: _current(p, prefer)).alias("bani"), stated.alias("r"))

    def made(f: Column) -> Column:
        counts = ~((f["r"]["kind"] == "STRIKETHROUGH") & F.coalesce(f["r"]["bani"] <= f["bani"], F.lit(False)))
        return F.struct(f["bani"].alias("bani"), F.when(counts, f["r"]["bani"]).alias("reference_bani"), F.when(counts, f["r"]["kind"]).alias("reference_kind"))

    return let(facts, made)


def _current(plain: Column, prefer: str) -> Column:
    """The price of a text without dates and former prices."""
    pick = lambda values: F.array_min(values) if prefer == "lowest" else F.get(values, F.lit(0))
    split = rf"(?i)(\d{{1,5}})\s+(\d{{2}})(?![\d.,])\s*(?:lei|ron){NOT_PER_UNIT}"
    parted = F.zip_with(_found(plain, split, 1), _found(plain, split, 2), lambda a, b: F.concat(a, F.lit("."), b))
    marked = F.filter(_found(plain, rf"(?i)(\d[\d., ]*\d|\d)\s*(?:lei|ron){NOT_PER_UNIT}"), lambda t: S.parse_decimal(t) > 0)
    bare = _found(F.regexp_replace(plain, rf"(?i){PER_UNIT}[^0-9]*[\d.,]+", " "), r"(\d{1,3}(?: \d{3})+(?:[.,]\d+)?|\d[\d.,]*\d|\d)")
    lone = let(F.array_distinct(_amounts(bare)), lambda b: F.when((F.size(b) == 1) | plain.rlike("(?i)lei|ron"), pick(b)))
    sure = let(parted, lambda x: F.when(F.size(x) > 0, F.struct(pick(_amounts(x)).alias("bani"))))
    likely = let(marked, lambda x: F.when(F.size(x) > 0, F.struct(pick(_amounts(x)).alias("bani"))))
    return F.coalesce(sure, likely, F.struct(lone.alias("bani")))["bani"]


# fixed values: words for units, and what one is in grams, millilitres or pieces
UNITS = {
    ("G", 1000.0): ["kg", "kilograme", "kilogram", "kilo"], ("G", 1.0): ["grame", "gram", "gr", "g"], ("G", 0.001): ["miligrame", "mg"], ("ML", 1.0): ["mililitri", "ml"],
    ("ML", 10.0): ["centilitri", "cl"], ("ML", 1000.0): ["litri", "litru", "l"],
    ("BUC", 1.0): [
        "bucata", "bucati", "bucăți", "bucăţi", "bucată", "buc", "role", "rola", "plicuri", "pliculete", "pliculețe", "pliculeţe", "plic", "capsule", "capsula", "capsulă", "caps",
        "comprimate", "comprimat", "compr", "tablete", "tableta", "tabletă", "doze", "doza", "doză", "felii", "felie", "ouă", "oua", "drajeuri", "drajeu", "draje", "pastile", "pastila",
        "pastilă", "supozitoare", "supozitor", "ovule", "ovul", "fiole", "fiola", "fiolă", "perle",
    ],
}
PIECES = ["bucata", "bucati", "bucăți", "bucăţi", "bucată", "buc"]
COUNTED = [*PIECES, "plicuri", "pliculete", "plic", "role", "rola", "capsule", "caps", "comprimate", "compr", "tablete", "doze", "felii", "pungi", "cutii", "cutie"]
FREE = ["gratis", "gratuit[ăaeiț]?", "gratuite", "cadou", "free"]
PACKS = ["pachete", "pachet", "set", "baxuri", "bax", "pack", "cutie", "cutii"]

_N = r"(\d+(?:[.,]\d+)?)"
_ANY, _MEASURE = ("|".join(w for (kind, _), words in UNITS.items() for w in words if some or kind != "BUC") for some in (True, False))
_WEIGHED = _MEASURE.replace("miligrame|mg|", "")
_PIECE, _COUNT, _FREE, _PACK = ("|".join(words) for words in (PIECES, COUNTED, FREE, PACKS))
_END = r"(?![a-z0-9_])"  # a word ends here; letters with marks do not count
BONUS = rf"(?iu){_N}\s*({_WEIGHED})\s*\+\s*{_N}\s*({_WEIGHED})(?![a-zăâîșț/])"
ATTACHED = rf"(?iu)\(?\s*(\d+)\s*\+\s*(\d+)\s*\)?\s*(?:{_PIECE})?\s*[x×*]\s*{_N}\s*({_ANY}){_END}"
PAIR = rf"(?iu)(\d+)\s*\+\s*(\d+)\s*(?:{_PIECE})?\s*(?:{_FREE}){_END}"
PRICE_OF = r"(?iu)(\d+)\s*la\s*pre[țţt]ul\s*(?:de|a)\s*(\d+)"
EXTRA = rf"(?iu)\+\s*(\d+)\s*(?:{_PIECE})?\s*(?:{_FREE}){_END}"
MULTI = rf"(?iu)(\d+)\s*(?:{_COUNT})?\s*[x×*]\s*{_N}\s*({_ANY}){_END}"
TURNED = rf"(?iu){_N}\s*({_ANY})\s*[x×*]\s*(\d+){_END}(?!\s*(?:{_MEASURE}){_END})"
SUMMED = rf"(?iu){_N}\s*({_COUNT})\s*\+\s*{_N}\s*({_COUNT}){_END}"
PACKED = rf"(?iu)(?<![a-z0-9_])(?:{_PACK})\s*(?:de\s*)?(\d+)\s*(?:{_PIECE}){_END}"
BAX = rf"(?iu)(?<![a-z0-9_])bax(?:uri)?\s*(?:de\s*)?(\d+){_END}"
SIZE = rf"(?iu){_N}\s*({_ANY}){_END}(?!\s*%)(?!\s*/\s*[a-zăâîșşțţ])"
SHAPE = "struct<value:double,unit:string,pack_count:int,pack_size:double,paid:int,free:int,is_promo:boolean>"


def _rounded(x: Column) -> Column:
    return F.floor(x * 1000 + 0.5) / 1000


def _one(amount: Column, word: Column) -> Column:
    """struct<value, unit> of an amount and a unit's word; null for nothing."""
    units = F.create_map(*(x for (kind, factor), words in UNITS.items() for w in words for x in (F.lit(w), F.struct(F.lit(kind).alias("unit"), F.lit(factor).alias("factor")))))
    number = F.replace(amount, F.lit(","), F.lit(".")).try_cast("double")
    made = let(F.try_element_at(units, F.lower(word)), lambda u: F.struct(_rounded(number * u["factor"]).alias("value"), u["unit"].alias("unit")))
    return let(made, lambda q: F.when(q["value"] > 0, q))


def _shape(value: Column, unit: Column, count: Column, size: Column, paid: Column, free: Column, promo: Column) -> Column:
    return F.struct(
        _rounded(value).alias("value"), unit.alias("unit"), count.alias("pack_count"), _rounded(size).alias("pack_size"), paid.alias("paid"), free.alias("free"), promo.alias("is_promo")
    ).cast(SHAPE)


def _plain(value: Column, unit: Column, count: Column, size: Column) -> Column:
    return _shape(value, unit, count, size, count, F.lit(0), F.lit(False))


def _parts(text: Column, pattern: str, count: int) -> Column:
    """The groups g1, g2, ... of a pattern's first match; empty where there is none."""
    return F.struct(*(F.regexp_extract(text, pattern, i).alias(f"g{i}") for i in range(1, count + 1)))


def _whole(text: Column) -> Column:
    return text.try_cast("int")


def _packed(size: Column, count: Column) -> Column:
    """A plain pack of ``count`` pieces of a size; null where either is missing."""
    facts = F.struct(size.alias("q"), _whole(count).alias("n"))
    return let(facts, lambda f: F.when((f["n"] > 0) & f["q"].isNotNull(), _plain(f["q"]["value"] * f["n"], f["q"]["unit"], f["n"], f["q"]["value"])))


def _base(text: Column) -> Column:
    """The size a name states, promotions aside."""
    times = text.rlike("[xX×*]")  # without its sign no shape is looked for
    multi = F.when(times, let(_parts(text, MULTI, 3), lambda m: _packed(_one(m["g2"], m["g3"]), m["g1"])))
    turned = F.when(times, let(_parts(text, TURNED, 3), lambda m: _packed(_one(m["g1"], m["g2"]), m["g3"])))

    def counts(f: Column) -> Column:
        total = f["a"]["value"] + f["b"]["value"]
        return F.when((f["a"]["unit"] == "BUC") & (f["b"]["unit"] == "BUC"), _plain(total, F.lit("BUC"), F.lit(1), total))

    summed = let(let(_parts(text, SUMMED, 4), lambda m: F.struct(_one(m["g1"], m["g2"]).alias("a"), _one(m["g3"], m["g4"]).alias("b"))), counts)
    summed = F.when(F.contains(text, F.lit("+")), summed)
    piece = F.struct(F.lit(1.0).alias("value"), F.lit("BUC").alias("unit"))
    packs = [_packed(piece, F.regexp_extract(text, p, 1)) for p in (PACKED, BAX)]
    sizes = F.filter(F.zip_with(_found(text, SIZE, 1), _found(text, SIZE, 2), lambda a, b: _one(a, b)), lambda q: q.isNotNull())
    single = let(F.try_element_at(sizes, F.lit(-1)), lambda q: F.when(q.isNotNull(), _plain(q["value"], q["unit"], F.lit(1), q["value"])))
    return F.coalesce(multi, turned, summed, *packs, single)


def quantity(name: Column) -> Column:
    """struct<value, unit, pack_count, pack_size, paid, free, is_promo> of a product name; null where it states no size.

    ``value`` is all that is taken home, free pieces too, in G, ML or BUC.  The
    shapes, in this order: a bonus ("1kg+330g"), a promotion with its size
    ("(7+1) x 125 g"), whole packs free ("2+1 gratis", "3 la pretul de 2"), pieces
    free on top ("2 x 500 g + 1 gratis"); else packs ("6 x 1,5 l", "1,5 l x 6"),
    summed counts ("32 buc + 20 buc"), pack words ("set 3 buc", "bax 24"), and the
    last size that is no percentage and no concentration.  A plus sign alone is
    no promotion.
    """
    return let(F.trim(F.translate(name, SPACES, " " * len(SPACES))), _quantity)


def _quantity(text: Column) -> Column:
    plus = F.contains(text, F.lit("+"))  # without its sign no shape is looked for

    def added(f: Column) -> Column:
        total = f["a"]["value"] + f["b"]["value"]
        return F.when(f["a"]["unit"] == f["b"]["unit"], _shape(total, f["a"]["unit"], F.lit(1), total, F.lit(1), F.lit(0), F.lit(True)))

    bonus = let(let(_parts(text, BONUS, 4), lambda m: F.struct(_one(m["g1"], m["g2"]).alias("a"), _one(m["g3"], m["g4"]).alias("b"))), added)

    def sized(f: Column) -> Column:
        pieces = f["paid"] + f["free"]
        return F.when((f["paid"] > 0) & (f["free"] > 0) & f["q"].isNotNull(), _shape(f["q"]["value"] * pieces, f["q"]["unit"], pieces, f["q"]["value"], f["paid"], f["free"], F.lit(True)))

    attached = let(let(_parts(text, ATTACHED, 4), lambda m: F.struct(_one(m["g3"], m["g4"]).alias("q"), _whole(m["g1"]).alias("paid"), _whole(m["g2"]).alias("free"))), sized)
    without = lambda pattern: F.regexp_replace(text, pattern.replace("(?iu)", "(?ius)^(.*?)(?:", 1) + ")", "$1 ")
    deal = lambda paid, free, on_top, pattern: F.struct(paid.alias("paid"), free.alias("free"), F.lit(on_top).alias("on_top"), without(pattern).alias("rest"))
    two = lambda pattern: F.struct(_whole(F.regexp_extract(text, pattern, 1)).alias("x"), _whole(F.regexp_extract(text, pattern, 2)).alias("y"))
    pair = let(two(PAIR), lambda n: F.when((n["x"] > 0) & (n["y"] > 0), deal(n["x"], n["y"], False, PAIR)))
    price_of = let(two(PRICE_OF), lambda n: F.when((n["x"] > n["y"]) & (n["y"] > 0), deal(n["y"], n["x"] - n["y"], False, PRICE_OF)))
    more = let(_whole(F.regexp_extract(text, EXTRA, 1)), lambda n: F.when(n > 0, deal(F.lit(1), n, True, EXTRA)))
    plain = F.struct(F.lit(0).alias("paid"), F.lit(0).alias("free"), F.lit(False).alias("on_top"), text.alias("rest"))
    facts = let(F.coalesce(F.when(plus, pair), price_of, F.when(plus, more), plain), lambda d: F.struct(d.alias("d"), let(d["rest"], _base).alias("own")))

    def dealt(f: Column) -> Column:
        d, own = f["d"], f["own"]
        count = F.when(d["on_top"] & own.isNotNull(), own["pack_count"]).otherwise(d["paid"]) + d["free"]
        each = F.when(own.isNull(), 1.0).when(d["on_top"], own["pack_size"]).otherwise(own["value"])
        made = F.struct(count.alias("n"), each.alias("each"), F.coalesce(own["unit"], F.lit("BUC")).alias("unit"))
        shaped = let(made, lambda m: _shape(m["each"] * m["n"], m["unit"], m["n"], m["each"], m["n"] - d["free"], d["free"], F.lit(True)))
        return F.when(d["free"] > 0, shaped).otherwise(own)

    return F.coalesce(F.when(plus, bonus), F.when(plus, attached), let(facts, dealt))


def _number(x: Column) -> Column:
    """Up to three decimals, a decimal comma, no trailing zeros."""
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.3f", x.cast("double")), "0+$", ""), r"\.$", "")
    return F.replace(text, F.lit("."), F.lit(","))


def format_quantity(q: Column) -> Column:
    """A quantity for people: "6 x 1,5 l", "500 g", "10 buc"."""
    return let(q, _format_quantity)


def _format_quantity(q: Column) -> Column:
    big, small = F.when(q["unit"] == "G", "kg").otherwise("l"), F.when(q["unit"] == "G", "g").otherwise("ml")
    size = q["pack_size"]
    one = F.when(q["unit"] == "BUC", F.concat(_number(size), F.lit(" buc"))).when(size >= 1000, F.concat_ws(" ", _number(size / 1000), big)).otherwise(F.concat_ws(" ", _number(size), small))
    pieces = (q["unit"] == "BUC") & (size == 1)
    return F.when(pieces, F.concat(_number(q["value"]), F.lit(" buc"))).when(q["pack_count"] > 1, F.concat(q["pack_count"].cast("string"), F.lit(" x "), one)).otherwise(one)


def format_promo(q: Column) -> Column:
    """"7+1 gratis" for a promotional pack, else empty."""
    return let(q, lambda p: F.when(p["is_promo"], F.concat(p["paid"].cast("string"), F.lit("+"), p["free"].cast("string"), F.lit(" gratis"))).otherwise(""))


def per_unit_divisor(q: Column) -> Column:
    """struct<divisor, label>: what a price is divided by for its price per kg, l or buc."""

    def made(p: Column) -> Column:
        label = F.when(p["unit"] == "BUC", "buc").when(p["unit"] == "G", "kg").otherwise("l")
        return F.struct(F.when(p["unit"] == "BUC", p["value"]).otherwise(p["value"] / 1000).alias("divisor"), label.alias("label"))

    return let(q, made)
