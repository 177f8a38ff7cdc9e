"""Groups of offers whose prices disagree, and products that contradict each other, described rather than judged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom import constants as C
from marketloom.functions import scalars as S
from marketloom.functions.grammar import let
from marketloom.sources.work import spread, written

# fixed values: words of a name that tell nothing apart
NAME_NOISE = ["de", "cu", "la", "si", "din", "fara", "pentru", "sau", "un", "o"]
# fixed values: flavours that make another product of a brand and size
FLAVOURS = [
    "ciocolata", "vanilie", "capsuni", "capsune", "zmeura", "visine", "caise", "piersici",
    "ceapa", "verdeata", "smantana", "hribi", "iaurt", "usturoi", "marar", "rosii", "busuioc",
    "masline", "sunca", "somon", "cascaval", "branza", "miere", "cacao", "alune", "cocos",
    "portocale", "lamaie", "menta", "afine", "mango", "banana", "para", "mar", "nuca", "fistic",
    "natur", "simplu", "clasic", "light", "picant", "iute", "dulce", "sarat",
]
NAMELESS_BRANDS = ["", "non-brand", "(bucata)"]
SAME_SIZE = 0.02


def telling_words(name: Column) -> Column:
    """The distinct words of a name without noise and sizes; null and empty names have none."""
    words = F.filter(S.tokens(S.normalize(name, glue_storage=False)), lambda w: ~w.isin(NAME_NOISE))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: ~w.rlike("^([0-9]+(g|kg|ml|l|cl|buc|gr)?|g|kg|ml|l|cl|buc|gr)$"))))


def median_bani(prices: Column) -> Column:
    """The median of an array of whole numbers, the mean of the middle two."""
    sorted_, n = F.array_sort(prices), F.size(prices)
    at = lambda i: F.get(sorted_, i.cast("int"))
    return (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2


def disagreeing_groups(offers: DataFrame) -> DataFrame:
    """Products with an offer far from the others' middle: the whole group, split at its widest relative gap.

    offers: product_id, merchant_id, price_bani, store_name (may be null), visible.
    A product's visible offers, three or more, disagree when one is off the median
    by more than OUTLIER_SHARE of it.  Returns product_id, median_bani, offers,
    disagreeing (how many are off), gap_bp (the upper price over the lower at the
    gap), low and high (offers on the two sides), low_words and high_words (words
    that all offers of one side have and some of the other lack), some_words (words
    that not all named offers have), unnamed.  Words of a product's offers are
    counted before they meet, so a product with very many offers is no large array.
    """
    rows = offers.where("visible and price_bani > 0").select("product_id", "merchant_id", "price_bani", "store_name")
    counts = written(rows.groupBy("product_id", "price_bani").agg(F.count(F.lit(1)).alias("n")))
    order = Window.partitionBy("product_id").orderBy("price_bani")
    rank = counts.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy("product_id")))
    rank = rank.withColumn("next", F.lead("price_bani").over(order))
    middle = lambda place: F.min(F.when(F.col("upto") > place, F.col("price_bani")))
    facts = rank.groupBy("product_id").agg(
        F.first("all").alias("offers"), ((middle(F.floor((F.col("all") - 1) / 2)) + middle(F.floor(F.col("all") / 2))) / 2).alias("median_bani"),
        F.max(F.struct((F.col("next") / F.col("price_bani")).alias("ratio"), (-F.col("price_bani")).alias("back"))).alias("gap"),
    )
    off = F.abs(F.col("price_bani") - F.col("median_bani")) > C.OUTLIER_SHARE * F.col("median_bani")
    far = counts.join(facts.where(F.col("offers") >= C.OUTLIER_MIN_PEERS), "product_id").where(off).groupBy("product_id").agg(F.sum("n").alias("disagreeing"))
    groups = facts.join(far, "product_id").withColumn("cut", -F.col("gap.back"))
    sides = rows.join(groups.select("product_id", "cut"), "product_id").withColumn("side", F.when(F.col("price_bani") <= F.col("cut"), "low").otherwise("high"))
    sides = written(sides.select("product_id", "side", "store_name", telling_words(F.col("store_name")).alias("words")))  # a name is read once
    on = lambda side: F.count_if(F.col("side") == side)
    named = F.size("words") > 0
    sizes = sides.groupBy("product_id").agg(
        on("low").alias("low"), on("high").alias("high"), F.count_if((F.col("side") == "low") & named).alias("low_named"), F.count_if((F.col("side") == "high") & named).alias("high_named"),
        F.max(F.coalesce(F.trim("store_name"), F.lit("")) == "").alias("unnamed"),
    )
    words = sides.select("product_id", "side", F.explode("words").alias("word")).groupBy("product_id", "word").agg(on("low").alias("l"), on("high").alias("h")).join(sizes, "product_id")
    every_low, every_high = (F.col("l") == F.col("low_named")) & (F.col("low_named") > 0), (F.col("h") == F.col("high_named")) & (F.col("high_named") > 0)
    only = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("word"))))
    told = words.groupBy("product_id").agg(
        only(every_low & (F.col("h") < F.col("high_named"))).alias("low_words"), only(every_high & (F.col("l") < F.col("low_named"))).alias("high_words"),
        only(F.col("l") + F.col("h") < F.col("low_named") + F.col("high_named")).alias("some_words"),
    )
    none = F.array().cast("array<string>")
    out = groups.join(sizes, "product_id").join(told, "product_id", "left")
    words_of = lambda c: F.array_join(F.coalesce(c, none), " ").alias(c)
    return out.select("product_id", "median_bani", "offers", "disagreeing", S.half_up(F.col("gap.ratio") * 10_000).alias("gap_bp"), "low", "high", words_of("low_words"), words_of("high_words"), words_of("some_words"), "unnamed")


def discriminators(text: Column) -> Column:
    """map<dimension, value> of what a name and brand state of fat, lactose, organic farming, skimming and flavour."""
    return let(F.concat(F.lit(" "), S.normalize(text, glue_storage=False), F.lit(" ")), _discriminators)


def _discriminators(n: Column) -> Column:
    stated = r"\b([0-9]{1,2})[ ,.]?([0-9])?\s*(?:%|la suta)?\s*grasime|\bgrasime\s*([0-9]{1,2})[ ,.]?([0-9])?"
    group = lambda i: F.regexp_extract(n, stated, i)
    digits = F.when(group(1) != "", F.concat(group(1), group(2))).when(group(3) != "", F.concat(group(3), group(4)))
    bare = r"\b([013])\s([5789])\b"
    fat = F.when(n.rlike(stated), digits).when(n.rlike(bare), F.concat(F.regexp_extract(n, bare, 1), F.regexp_extract(n, bare, 2)))
    flavours = F.array_sort(F.array_compact(F.array(*(F.when(n.rlike(rf"\b{f}"), f) for f in FLAVOURS))))
    flavours = F.when(n.rlike(rf"\b({'|'.join(FLAVOURS)})"), flavours)
    values = {
        "fat": fat, "lactose": F.when(n.rlike(r"\bfara lactoza\b|\bdelactozat"), "free"), "organic": F.when(n.rlike(r"\b(bio|eco|ecologic|organic)\b"), "yes"),
        "skim": F.when(n.rlike(r"\bdegresat\b"), "yes"), "flavour": F.array_join(flavours, "+"),
    }
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()))
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def contradiction(a: Column, b: Column) -> Column:
    """The first dimension in which two ``discriminators`` both state a value and differ, as "dimension: a vs b"; else null."""
    both = F.filter(F.map_keys(a), lambda k: F.try_element_at(b, k).isNotNull() & (F.try_element_at(b, k) != F.try_element_at(a, k)))
    first = F.get(both, F.lit(0))
    return F.when(first.isNotNull(), F.concat(first, F.lit(": "), F.try_element_at(a, first), F.lit(" vs "), F.try_element_at(b, first)))


def brand_of(products: DataFrame) -> DataFrame:
    """(id, brand_key): the folded brand, or where there is none the first word of the name that is a word of some brand; products: id, name, brand."""
    stated = F.lower(F.trim(F.coalesce("brand", F.lit(""))))
    rows = products.select("id", "name", F.when(~stated.isin(NAMELESS_BRANDS), S.normalize(F.col("brand"), glue_storage=False)).alias("own"))
    vocabulary = rows.where("own is not null").select(F.explode(S.tokens(F.col("own"))).alias("word")).where(F.length("word") >= 4).distinct()
    words = rows.where("own is null").select("id", F.posexplode(S.tokens(S.normalize(F.col("name"), glue_storage=False))).alias("at", "word"))
    found = words.join(vocabulary, "word").groupBy("id").agg(F.min_by("word", "at").alias("brand_key"))
    return rows.where("own is not null").select("id", F.col("own").alias("brand_key")).union(found)


def duplicate_contradictions(products: DataFrame) -> DataFrame:
    """Per brand, section, unit and size: distinct statements of its products, and which dimensions contradict.

    products: id, name, brand, section, unit, unit_size.  Products of one key
    that state the same are one statement with a count, and statements are counted
    per dimension and value, so no two products are compared.  A dimension
    contradicts when two values of it occur.  Returns section, brand_key, unit,
    unit_size, products, statements, contradictions (dimensions, sorted, with
    their values), could_merge (products that state nothing another contradicts).
    """
    keyed = spread(products, "id").join(brand_of(products), "id").where("brand_key <> ''")  # few bytes, much to read in them
    size = F.format_string("%.2e", "unit_size")  # three significant digits
    rows = keyed.select("id", "section", "brand_key", "unit", size.alias("unit_size"), discriminators(F.concat_ws(" ", F.coalesce("brand", F.lit("")), "name")).alias("d"))
    key = ["section", "brand_key", "unit", "unit_size"]
    said = rows.select(*key, "id", F.array_join(F.array_sort(F.transform(F.map_entries("d"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), " ").alias("said"), "d")
    said = written(said)  # read by every step below
    groups = said.groupBy(*key).agg(F.count(F.lit(1)).alias("products"), F.countDistinct("said").alias("statements")).where("products > 1")
    values = said.select(*key, "id", F.explode("d").alias("dimension", "value")).groupBy(*key, "dimension", "value").agg(F.count(F.lit(1)).alias("n"))
    split = values.groupBy(*key, "dimension").agg(F.array_join(F.array_sort(F.collect_set("value")), "|").alias("values"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    clash = split.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list(F.concat("dimension", F.lit(":"), "values"))), " ").alias("contradictions"))
    open_ = said.select(*key, "id", F.explode_outer("d").alias("dimension", "value")).join(split.select(*key, "dimension", F.lit(1).alias("split")), [*key, "dimension"], "left")
    free = open_.groupBy(*key, "id").agg(F.max("split").isNull().alias("free")).groupBy(*key).agg(F.count_if("free").alias("could_merge"))
    out = groups.join(clash, key, "left").join(free, key)
    return out.select(*key, "products", "statements", F.coalesce("contradictions", F.lit("")).alias("contradictions"), "could_merge")
