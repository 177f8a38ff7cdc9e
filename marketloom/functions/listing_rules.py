"""Rules on what a shop lists: excluded goods, usable images, brand values, category paths, sizes by hint."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketloom.functions import scalars as S

# fixed values: words of tobacco goods, and pairs of words that only together mean them
TOBACCO = [
    "tigara", "tigari", "tigarete", "tigareta", "tutun", "tutungerie", "trabuc", "trabucuri", "narghilea", "narghilele", "shisha",
    "snus", "nicotina", "nicotine", "vape", "vaping", "vapat", "iqos", "heets", "heat", "glo", "ploom", "veev", "lyft", "velo", "zyn", "puffmi", "elfbar", "elf",
]
TOBACCO_PAIRS = [
    ("tigari", "foi"), ("rezerve", "tutun"), ("rezerva", "tutun"), ("pliculete", "nicotina"), ("plicuri", "nicotina"),
    ("cartus", "nicotina"), ("cartuse", "nicotina"), ("tigara", "electronica"), ("dispozitiv", "incalzit"),
]
# fixed values: short names that need one of the second words beside them
AMBIGUOUS = ["heat", "glo", "elf", "veev", "velo", "lyft"]
SECOND = ["tutun", "nicotina", "tigara", "tigari", "vape", "pod", "pods", "kit", "sticks", "stick"]
# fixed values: medicines against smoking, by name or by two words
CESSATION = ["nicorette", "niquitin", "nicotinell"]
CESSATION_PAIRS = [
    ("spray", "oral"), ("plasturi", "nicotina"), ("plasture", "nicotina"), ("guma", "nicotina"), ("gume", "nicotina"), ("comprimate", "nicotina"),
    ("pastile", "nicotina"), ("terapie", "substitutie"), ("substitutie", "nicotinica"), ("renuntarea", "fumat"), ("renuntare", "fumat"),
]


def _words(*texts: Column) -> Column:
    return S.tokens(S.normalize(F.concat_ws(" ", *texts)))


def _any_pair(words: Column, pairs: list[tuple[str, str]]) -> Column:
    out = F.lit(False)
    for a, b in pairs:
        out = out | (F.array_contains(words, a) & F.array_contains(words, b))
    return out


def _any_word(words: Column, values: list[str]) -> Column:
    return F.arrays_overlap(words, F.array(*(F.lit(v) for v in values)))


def exclusion_reason(name: Column, brand: Column) -> Column:
    """"tobacco" or null; medicines against smoking stay, and ambiguous names need a second word."""
    words = _words(name, F.coalesce(brand, F.lit("")))
    medicine = _any_word(words, CESSATION) | _any_pair(words, CESSATION_PAIRS)
    sure = _any_word(words, [w for w in TOBACCO if w not in AMBIGUOUS])
    unsure = _any_word(words, AMBIGUOUS) & _any_word(words, SECOND)
    return F.when(~medicine & (sure | unsure | _any_pair(words, TOBACCO_PAIRS)), "tobacco")


def is_placeholder_image(url: Column, markers: list[str]) -> Column:
    """No address, or one holding a marker of waiting pictures (spinner, placeholder, ...)."""
    low = F.lower(F.trim(url))
    out = url.isNull() | (F.trim(url) == "")
    for m in markers:
        out = out | F.contains(low, F.lit(m))
    return F.coalesce(out, F.lit(True))


def image_to_store(url: Column, markers: list[str]) -> Column:
    """The address if it can be shown: a path, or http(s) with one; no data, no bare host, no placeholder."""
    u, low = F.trim(url), F.lower(F.trim(url))
    data = low.startswith("data:") | F.contains(low, F.lit("/data:image")) | F.contains(low, F.lit("/data%3aimage"))
    good = u.startswith("/") | low.rlike("^https?://[^/?#]+/[^?#]")
    return F.when(~is_placeholder_image(url, markers) & ~data & good, u)


def from_srcset(srcset: Column) -> Column:
    """The largest picture of a srcset (2x counts as 2000 wide, none as 1); the first of equals."""
    parts = F.filter(F.transform(F.split(srcset, ","), lambda p: F.trim(p)), lambda p: p != "")
    weight = lambda p: F.coalesce(
        F.regexp_extract(p, r"\s([0-9]+(?:\.[0-9]+)?)w$", 1).try_cast("double"), F.regexp_extract(p, r"\s([0-9]+(?:\.[0-9]+)?)x$", 1).try_cast("double") * 1000, F.lit(1.0)
    )
    ranked = F.transform(parts, lambda p, i: F.struct((-weight(p)).alias("w"), i.alias("i"), F.split(p, r"\s+")[0].alias("u")))
    return F.array_min(ranked)["u"]


def absolute(url: Column, base: Column) -> Column:
    """An address resolved against its page's; data addresses have none."""
    u = F.trim(url)
    origin = F.regexp_extract(base, "^(https?://[^/?#]+)", 1)
    folder = F.regexp_extract(base, "^(https?://[^/?#]+(?:/[^?#]*/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(u.isNull() | (u == "") | F.lower(u).startswith("data:"), None).when(u.rlike("(?i)^https?://"), u)
        .when(u.startswith("//"), F.concat(F.regexp_extract(base, "^(https?:)", 1), u)).when(u.startswith("/"), F.concat(origin, u)).otherwise(F.concat(folder, u))
    )


def picked_image(candidates: list[tuple[Column, bool]], base: Column, markers: list[str]) -> Column:
    """The first of the attributes (value, is a srcset) that gives a picture to store."""
    return F.coalesce(*(image_to_store(absolute(from_srcset(v) if many else v, base), markers) for v, many in candidates))


def not_a_brand(value: Column, domain: Column, placeholders: list[str]) -> Column:
    """A placeholder, a number, or the shop's own domain with or without its ending."""
    v, d = S.normalize(value, glue_storage=False), F.lower(domain)
    own = (v == S.normalize(d, glue_storage=False)) | (v == S.normalize(F.regexp_replace(d, r"\.[a-z]+$", ""), glue_storage=False))
    return F.coalesce((v == "") | v.isin(placeholders) | v.rlike("^[0-9 ]+$") | own, F.lit(True))


def approx_size(text: Column) -> Column:
    """Kilograms of an approximate weight ("+/- 0.700 Kg", "cca. 700 g"); the last one counts."""
    t = F.lower(text)
    found = F.regexp_extract_all(t, F.lit(r"(?:\+/-|±|cca\.?|aprox\.?)\s*([0-9]+(?:[.,][0-9]+)?\s*(?:kg|g))"), F.lit(1))
    last = F.get(found, F.size(found) - 1)
    number = F.replace(F.regexp_extract(last, r"^([0-9]+(?:[.,][0-9]+)?)", 1), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(last.endswith("kg"), number).otherwise(number / 1000)


def variable_weight(price_bani: Column, per_kg_bani: Column, stated_kg: Column) -> Column:
    """Kilograms that a price and a price per kilogram imply, if a stated weight is within 0.02 kg or 3 % of it."""
    implied = price_bani / per_kg_bani
    slack = F.greatest(F.lit(0.02), implied * 0.03)
    return F.when((per_kg_bani > 0) & (F.abs(implied - stated_kg) <= slack + 1e-9), implied)


def path_key(path: Column) -> Column:
    """Levels of a category path ("a > b / c"), folded, joined with >."""
    levels = F.transform(F.split(path, r"\s*[>/|]\s*"), lambda x: S.normalize(x, glue_storage=False))
    return F.array_join(F.filter(levels, lambda x: x != ""), ">")


def path_of_url(url: Column, skip: list[str]) -> Column:
    """The category levels of a product url: its folders without the last part and ``skip``."""
    parts = F.split(F.regexp_replace(F.regexp_replace(url, "^https?://[^/]+", ""), "[?#].*$", ""), "/")
    kept = F.filter(parts, lambda p: (p != "") & ~p.isin(skip))
    folders = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
    return F.array_join(F.transform(folders, lambda p: F.replace(F.lower(p), F.lit("-"), F.lit(" "))), ">")


def format_bani(bani: Column) -> Column:
    """Lei with two decimals and a decimal comma, thousands with dots."""
    whole, cents = F.floor(bani / 100).cast("long"), (bani % 100).cast("long")
    return F.concat(F.replace(F.format_number(whole, 0), F.lit(","), F.lit(".")), F.lit(","), F.lpad(cents.cast("string"), 2, "0"), F.lit(" lei"))


def price_display(bani: Column, reference: Column, kind: Column) -> Column:
    """strike or omnibus where a reference of that kind is above the price, else plain."""
    above = F.coalesce(reference > bani, F.lit(False))
    return F.when(above & (kind == "STRIKETHROUGH"), "strike").when(above & (kind == "OMNIBUS"), "omnibus").otherwise("plain")


def card_saving(bani: Column, card_bani: Column) -> Column:
    """What the card saves; null where its price is no lower."""
    return F.when((card_bani > 0) & (card_bani < bani), bani - card_bani)


def per_unit_mismatch(own: Column, stated: Column) -> Column:
    """How a unit price differs from a stated one: ok (2 %), thousand, n-times-small, n-times-large, smaller or larger."""
    ratio = own / stated
    out = F.when(ratio < 1, "smaller").otherwise("larger")
    for n in (24, 12, 10, 8, 6, 4, 3, 2):
        out = F.when(F.abs(ratio - n) <= 0.06 * n, f"{n}-times-large").when(F.abs(ratio * n - 1) <= 0.06, f"{n}-times-small").otherwise(out)
    thousand = (F.abs(ratio - 1000) <= 60) | (F.abs(ratio * 1000 - 1) <= 0.06)
    return F.when(own.isNull() | stated.isNull() | (stated <= 0), None).when(F.abs(ratio - 1) <= 0.02, "ok").when(thousand, "thousand").otherwise(out)
