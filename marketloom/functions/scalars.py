"""Scalar functions as Column expressions, visible to the optimizer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketloom import constants as C

# fixed values: letters and what they fold to
FOLD_FROM = "ȘșȚțŞşŢţĂăÂâÎîÁáÀàÄäÉéÈèÊêËëÍíÓóÖöÔôÚúÜüÛûÑñÇç"
FOLD_TO = "SsTtSsTtAaAaIiAaAaAaEeEeEeEeIiOoOoOoUuUuUuNnCc"


def fold(s: Column) -> Column:
    """Diacritics replaced by their base letters."""
    return F.translate(s, FOLD_FROM, FOLD_TO)


def normalize(s: Column, glue_storage: bool = True) -> Column:
    """Folded, lower case, everything but letters and digits to single spaces; null is empty."""
    s = F.lower(fold(F.coalesce(s, F.lit(""))))
    if glue_storage:
        s = F.regexp_replace(s, r"([0-9]+)\s*(gb|tb|mb)", "$1$2")
    return F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))


def tokens(s: Column) -> Column:
    """Words of a normalised text."""
    return F.filter(F.split(s, " "), lambda t: t != "")


def name_bag(s: Column) -> Column:
    """Distinct words in order, joined: equal for names that differ in word order."""
    return F.array_join(F.array_sort(F.array_distinct(tokens(normalize(s)))), " ")


def slug(s: Column) -> Column:
    return F.regexp_replace(normalize(s, glue_storage=False), " ", "-")


def half_up(x: Column) -> Column:
    """Rounded to whole, halves upwards."""
    return F.floor(x + 0.5).cast("long")


def parse_decimal(s: Column) -> Column:
    """A number with either separator: of two kinds the last is the decimal mark;
    alone, a separator before exactly three last digits (or repeated) marks thousands."""
    # one chain in which each step names the one before once, since an expression is computed as often as it is named;
    # at the end of a text b marks separators of two kinds, t those of thousands alone
    steps = [
        (r"\s", ""), (r"(?s)^.*[^0-9.,].*$", ""), (r"^(?=.*,)(?=.*\.)(.*)$", "$1b"), (r"^([^b]*[.,][^b]*[.,][^b]*|[^b]*[.,][0-9]{3})$", "$1t"),
        (r"\.(?=.*,[^.]*b$)|,(?=.*\.[^,]*b$)|[.,](?=.*t$)|[bt]$", ""), (r",", "."), (r"^\..*|.*\.$", ""),
    ]
    for pattern, by in steps:
        s = F.regexp_replace(s, pattern, by)
    return s.try_cast("double")


def ean_ok(s: Column) -> Column:
    """8, 12, 13 or 14 digits whose last one is the mod-10 check digit."""
    digits = F.transform(F.split(F.reverse(s), ""), lambda d: d.try_cast("int"))
    total = F.aggregate(F.transform(digits, lambda d, i: d * F.when(i % 2 == 1, 3).otherwise(1)), F.lit(0), lambda a, d: a + d)
    return F.coalesce(s.rlike("^([0-9]{8}|[0-9]{12,14})$") & (total % 10 == 0), F.lit(False))


def vat_rate_bp(with_vat: Column, without_vat: Column) -> Column:
    """The legal rate that two prices imply, in basis points, else null."""
    bp = (with_vat - without_vat) * 10000 / without_vat
    near = lambda r: F.abs(bp - r) <= C.VAT_SLACK_BP
    return F.when(near(C.VAT_STANDARD_BP), C.VAT_STANDARD_BP).when(near(C.VAT_REDUCED_BP), C.VAT_REDUCED_BP)


def add_vat(bani: Column, rate_bp: Column) -> Column:
    return half_up(bani * (10000 + rate_bp) / 10000)


def deposit_bani(unit: Column, size: Column, packs: Column) -> Column:
    """Container deposit: liquids of 0.1 to 3 l per container."""
    return F.when((unit == "l") & size.between(C.DEPOSIT_MIN_L, C.DEPOSIT_MAX_L), C.DEPOSIT_BANI * packs).otherwise(0).cast("long")


def per_unit_bani(bani: Column, size: Column) -> Column:
    """Price per unit, null for an unusable size."""
    return F.when(size > 0, half_up(bani / size))


def unit_price_refusal(unit: Column, bani: Column, size: Column) -> Column:
    """Why a unit price is not believable, or null."""
    ceiling = reduce(lambda out, kv: F.when(unit == kv[0], kv[1]).otherwise(out), C.PRICE_CEILING_BANI.items(), F.lit(None).cast("long"))
    return (
        F.when(bani.isNull() | (bani <= 0), "no-price").when(unit.isin("kg", "l") & (size < C.UNIT_FLOOR), "size-too-small")
        .when(per_unit_bani(bani, size) > ceiling, "too-dear")
    )


def normalize_url(url: Column) -> Column:
    """http(s) without www., tracking parameters, fragment and last slash; else null."""
    u = F.regexp_replace(url, "#.*$", "")
    u = F.regexp_replace(u, r"([?&])(utm_[a-z]+|gclid|fbclid|msclkid|from|ref)=[^&]*", "$1")
    u = F.regexp_replace(u, "&+", "&")
    u = F.regexp_replace(F.regexp_replace(u, r"\?&", "?"), "[?&]+$", "")
    u = F.regexp_replace(F.regexp_replace(u, r"^(https?://)www\.", "$1"), "/$", "")
    return F.when(url.rlike("^https?://"), u)


def dose_tokens(s: Column) -> Column:
    """Doses, percentages, factors and clothing-style sizes named in a product name, sorted and joined with |."""
    t = F.lower(fold(F.coalesce(s, F.lit(""))))
    found = F.regexp_extract_all(t, F.lit(r"([0-9]+(?:[.,][0-9]+)?\s*(?:mg|mcg|ui|iu|%)|spf\s*[0-9]+)"), F.lit(1))
    sizes = F.regexp_extract_all(t, F.lit(r"\bmarim[a-z]*\s+(xxl|xl|xs|s|m|l)\b"), F.lit(1))
    plain = F.transform(found, lambda x: F.replace(F.regexp_replace(x, r"\s", ""), F.lit(","), F.lit(".")))
    return F.array_join(F.array_sort(F.array_distinct(F.concat(plain, F.transform(sizes, lambda x: F.concat(F.lit("size-"), x))))), "|")


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two token arrays (sets); 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def head_noun(name_tokens: Column, brand_tokens: Column, variant_markers: Column) -> Column:
    """First word that is neither brand nor variant marker, else not brand, else the first."""
    sig = F.filter(name_tokens, lambda t: (F.length(t) >= 3) & ~t.rlike("[0-9]"))
    plain = F.array_except(F.array_except(sig, brand_tokens), variant_markers)
    return F.coalesce(F.get(plain, F.lit(0)), F.get(F.array_except(sig, brand_tokens), F.lit(0)), F.get(sig, F.lit(0)), F.lit(""))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of pre-normalised vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def tiered_total(tiers: Column, base: Column, qty: Column) -> Column:
    """Total for ``qty`` pieces at the best rung reached, from array<struct<qty,bani>>."""
    reached = F.filter(tiers, lambda t: t["qty"] <= qty)
    return qty * F.least(base, F.coalesce(F.array_min(F.transform(reached, lambda t: t["bani"])), base))


def valid_tiers(tiers: Column, base: Column) -> Column:
    """Rungs of 2 to 500 pieces, below the base by at most 60 %, in falling order of price."""
    sorted_ = F.array_sort(tiers)
    fine = F.forall(sorted_, lambda t: t["qty"].between(C.TIER_MIN_QTY, C.TIER_MAX_QTY) & (t["bani"] < base) & (t["bani"] >= base * (1 - C.TIER_MAX_DISCOUNT)))
    bani = F.transform(sorted_, lambda t: t["bani"])
    falling = F.forall(F.arrays_zip(F.slice(bani, 1, F.greatest(F.size(bani) - 1, F.lit(0))).alias("p"), F.slice(bani, 2, F.size(bani)).alias("q")), lambda z: z["p"] > z["q"])
    return fine & falling
