"""Baskets over shops: store totals, the greedy split, class picks, per-shop index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom import constants as C
from marketloom.functions import scalars as S
from marketloom.sources.work import spread


def shops_of(current: DataFrame) -> DataFrame:
    """(product_id, shops): every shop of a product with its lowest price, cheapest first; an entry per shop at most."""
    cheapest = current.groupBy("product_id", "merchant_id").agg(F.min("price_bani").alias("bani"))
    return cheapest.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("bani", "merchant_id"))).alias("shops"))


def dealt_lines(lines: DataFrame, current: DataFrame) -> DataFrame:
    """(basket_id, qty, sellers, banis): a row per line with its shops, cheapest first, and their prices; both null where nobody sells it.

    The rows of a basket lie in one partition, so that what is summed per basket
    and shop afterwards is not shuffled again.
    """
    shops = shops_of(current).select("product_id", F.transform("shops", lambda s: s["merchant_id"]).alias("sellers"), F.transform("shops", lambda s: s["bani"]).alias("banis"))
    rows = lines.where("basket_id is not null").join(shops, "product_id", "left")
    return spread(rows.select("basket_id", "qty", "sellers", "banis"), "basket_id")


def store_totals(lines: DataFrame, current: DataFrame, merchants: DataFrame) -> DataFrame:
    """Per basket and shop: lines found and missing, goods, delivery, total, minimum order met."""
    rows = dealt_lines(lines, current).select("basket_id", "qty", F.posexplode_outer(F.arrays_zip("sellers", "banis")).alias("at", "s"))
    rows = rows.groupBy("basket_id", F.col("s.sellers").alias("merchant_id")).agg(
        F.count(F.lit(1)).alias("found"), F.sum(F.col("s.banis") * F.col("qty")).alias("goods_bani"), F.count_if(F.coalesce("at", F.lit(0)) == 0).alias("firsts")
    )
    size = F.sum("firsts").over(Window.partitionBy("basket_id"))  # a line counts at its first shop, or at none
    rows = rows.withColumn("lines", size).where("merchant_id is not null").join(merchants.select("merchant_id", "delivery_fee", "free_over", "min_order"), "merchant_id")
    fee = F.when(F.col("goods_bani") >= F.col("free_over"), 0).otherwise(F.col("delivery_fee"))
    meets = F.col("goods_bani") >= F.coalesce("min_order", F.lit(0))
    return rows.select("basket_id", "merchant_id", "found", (F.col("lines") - F.col("found")).alias("missing"), "goods_bani", fee.alias("delivery_bani"), (F.col("goods_bani") + fee).alias("total_bani"), meets.alias("meets_minimum"))


def best_single(totals: DataFrame) -> DataFrame:
    """The cheapest complete shop of each basket."""
    order = Window.partitionBy("basket_id").orderBy("total_bani", "merchant_id")
    return totals.where("missing = 0 and meets_minimum").withColumn("rn", F.row_number().over(order)).where("rn = 1").select("basket_id", "merchant_id", "total_bani")


def split(lines: DataFrame, current: DataFrame, merchants: DataFrame, stores: int = C.MAX_STORES) -> DataFrame:
    """Greedy split: the cheapest shop per line, the ``stores`` shops of most value stay, other lines move to those.

    Every shop asks its own delivery fee; ``missing`` counts the basket's lines
    that none of the shops kept sells.  A basket without any offer has no row.
    Quantities are positive, so a line's cheapest shop is its product's.
    """
    rows = dealt_lines(lines, current)
    value = rows.groupBy("basket_id", F.get("sellers", F.lit(0)).alias("merchant_id")).agg(F.sum(F.get("banis", F.lit(0)) * F.col("qty")).alias("value"), F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("basket_id").orderBy(F.desc("value"), "merchant_id"))  # lines that nobody sells come last
    kept = F.collect_set(F.when(F.col("rn") <= stores, F.col("merchant_id")))
    keep = value.withColumn("rn", rank).groupBy("basket_id").agg(kept.alias("kept"), F.sum("n").alias("all_lines")).where(F.size("kept") > 0)
    sold = F.get(F.filter(F.arrays_zip("sellers", "banis"), lambda s: F.array_contains("kept", s["sellers"])), F.lit(0))
    moved = rows.join(keep, "basket_id").select("basket_id", "all_lines", "qty", sold.alias("s")).where("s is not null")
    out = moved.groupBy("basket_id", "all_lines", F.col("s.sellers").alias("merchant_id")).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.col("s.banis") * F.col("qty")).alias("goods_bani"))
    out = out.join(merchants.select("merchant_id", "delivery_fee", "free_over"), "merchant_id")
    fee = F.when(F.col("goods_bani") >= F.col("free_over"), 0).otherwise(F.col("delivery_fee"))
    taken = F.sum("lines").over(Window.partitionBy("basket_id"))
    return out.select("basket_id", "merchant_id", "lines", "goods_bani", fee.alias("delivery_bani"), (F.col("all_lines") - taken).alias("missing"))


def class_pick(current: DataFrame, favourites: DataFrame) -> DataFrame:
    """Per class one offer: a favourite product's first, then the cheapest per unit."""
    fav = favourites.select("product_id").distinct().withColumn("fav", F.lit(True))
    rows = current.where("class_id is not null").join(fav, "product_id", "left")
    rows = rows.withColumn("ppu", S.per_unit_bani(F.col("price_bani"), F.col("unit_size")))
    order = Window.partitionBy("class_id").orderBy(F.col("fav").isNull(), F.asc_nulls_last("ppu"), "price_bani", "product_id", "merchant_id")
    n = F.count(F.lit(1)).over(Window.partitionBy("class_id"))
    basis = F.when(F.col("fav"), "FAVOURITE").when(F.col("options") == 1, "ONLY_OPTION").otherwise("CHEAPEST")
    rows = rows.withColumn("rn", F.row_number().over(order)).withColumn("options", n).where("rn = 1")
    return rows.select("class_id", "product_id", "merchant_id", "price_bani", basis.alias("basis"))


def index_per_shop(current: DataFrame) -> DataFrame:
    """Per shop: classes it can price, and the sum of its cheapest price of each."""
    best = current.where("class_id is not null").groupBy("merchant_id", "class_id").agg(F.min("price_bani").alias("p"))
    return best.groupBy("merchant_id").agg(F.count(F.lit(1)).alias("classes"), F.sum("p").alias("total_bani"))


def ladder_unit_price(offers: DataFrame, pieces: tuple[int, ...] = (1, 3, 6)) -> DataFrame:
    """Totals at numbers of pieces for offers with a sound quantity ladder (tiers: array<struct<qty,bani>>)."""
    tiers, p = F.col("tiers"), F.col("price_bani")
    at = [S.tiered_total(tiers, p, F.lit(q)).cast("long").alias(f"total_{q}") for q in pieces]
    return offers.where(tiers.isNotNull() & S.valid_tiers(tiers, p)).select("product_id", "merchant_id", *at)


def ladder_hints(offers: DataFrame, qty: Column, within: int = 2) -> DataFrame:
    """Rungs to show, the discount of the best one, and the hint that a few pieces more cost less in all.

    Shown are rungs above one piece and below the base, but not those that a
    later rung is dearer than.  A hint names the next rung at most ``within``
    pieces away whose total is below that of ``qty`` pieces now.
    """
    p = F.col("price_bani")
    good = F.filter("tiers", lambda t: (t["qty"] > 1) & (t["bani"] < p))
    rows = offers.where("tiers is not null").withColumn("_good", F.array_sort(good)).withColumn("_qty", qty)
    shown = F.filter("_good", lambda t: ~F.exists("_good", lambda u: (u["qty"] > t["qty"]) & (u["bani"] > t["bani"])))
    rows = rows.withColumn("_shown", shown).withColumn("_now", S.tiered_total(F.col("_shown"), p, F.col("_qty")))
    nearer = F.filter("_shown", lambda t: (t["qty"] > F.col("_qty")) & (t["qty"] <= F.col("_qty") + within) & (t["qty"] * t["bani"] < F.col("_now")))
    best = F.array_min(F.transform("_shown", lambda t: t["bani"]))
    return rows.select(
        "product_id", "merchant_id", F.size("_shown").alias("rungs"), S.half_up((p - best) * 10000 / p).alias("discount_bp"),
        F.get(nearer, F.lit(0))["qty"].alias("hint_qty"), (F.col("_now") - F.get(nearer, F.lit(0))["qty"] * F.get(nearer, F.lit(0))["bani"]).alias("hint_saves"),
    )


def smeared_ladders(offers: DataFrame) -> DataFrame:
    """The same pair of rungs on five offers or more with different base prices."""
    rows = offers.select((F.col("price_bani") - F.col("price_bani") % 500).alias("rung"), "merchant_id", "price_bani")
    out = rows.groupBy("merchant_id", "rung").agg(F.count(F.lit(1)).alias("offers"), F.countDistinct("price_bani").alias("bases"))
    return out.where((F.col("offers") >= C.SMEAR_OFFERS) & (F.col("bases") >= C.SMEAR_BASES))
