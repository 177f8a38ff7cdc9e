"""Read models over current offers: summaries, spreads, deals, listings, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom import constants as C
from marketloom.functions import scalars as S


def product_summary(offers: DataFrame, current: Column) -> DataFrame:
    """Per product: lowest, highest and saving over current offers (0 when none), counts."""
    price = F.when(current, F.col("price_bani"))
    return offers.groupBy("product_id").agg(
        F.coalesce(F.min(price), F.lit(0)).alias("lowest_bani"),
        F.coalesce(F.max(price), F.lit(0)).alias("highest_bani"),
        F.coalesce(F.max(price) - F.min(price), F.lit(0)).alias("savings_bani"),
        F.count_if(current).alias("offer_count"),
        (F.count(F.lit(1)) - F.count_if(current)).alias("stale_count"),
        (F.count_if(current) > 0).alias("has_current"),
    )


def biggest_spreads(current: DataFrame, limit: int = 12, per_category: int = C.PER_CATEGORY) -> DataFrame:
    """Products with the largest gap between shops, at most ``per_category`` of a category.

    A gap over 50 % between two shops (70 % among more) is taken for a wrong match.
    """
    shop = current.groupBy("product_id", "category_id", "merchant_id").agg(F.min("price_bani").alias("p"))
    gap = shop.groupBy("product_id", "category_id").agg(F.min("p").alias("lo"), F.max("p").alias("hi"), F.count(F.lit(1)).alias("shops"))
    most = F.when(F.col("shops") == 2, C.TWO_SHOP_RATIO).otherwise(C.MANY_SHOP_RATIO)
    gap = gap.where((F.col("shops") >= 2) & (F.col("hi") > F.col("lo")) & (F.col("hi") / F.col("lo") - 1 <= most))
    gap = gap.withColumn("spread_bani", F.col("hi") - F.col("lo"))
    top = Window.partitionBy("category_id").orderBy(F.desc("spread_bani"), "product_id")
    gap = gap.withColumn("rn", F.row_number().over(top)).where(F.col("rn") <= per_category).drop("rn")
    return gap.orderBy(F.desc("spread_bani"), "product_id").limit(limit)


def daily_low(history: DataFrame) -> DataFrame:
    """Lowest price of a product per day; days without observations are not filled."""
    return history.groupBy("product_id", F.to_date("recorded_at").alias("day")).agg(F.min("price_bani").alias("low_bani"))


def drop_pct(low: DataFrame) -> DataFrame:
    """How far the last daily low is below the highest, in basis points; 0 under two days."""
    out = low.groupBy("product_id").agg(F.max("low_bani").alias("hi"), F.max_by("low_bani", "day").alias("last"), F.count(F.lit(1)).alias("days"))
    drop = F.when(F.col("days") >= 2, S.half_up((F.col("hi") - F.col("last")) * 10000 / F.col("hi"))).otherwise(0)
    return out.select("product_id", drop.cast("long").alias("drop_bp"), F.col("days"))


def product_signals(offers: DataFrame, current: Column, history: DataFrame, since: Column) -> DataFrame:
    """Nightly signals of a product with a non-stale offer: drop, spread, score, live offers."""
    live = offers.where(~F.col("is_stale")).groupBy("product_id").agg(
        F.min(F.when(current, F.col("price_bani"))).alias("lo"), F.max(F.when(current, F.col("price_bani"))).alias("hi"), F.count_if(current).alias("live")
    )
    drops = drop_pct(daily_low(history.where(F.col("recorded_at") >= since))).select("product_id", "drop_bp")
    spread = F.when(F.col("live") >= 2, S.half_up((F.col("hi") - F.col("lo")) * 10000 / F.col("hi"))).otherwise(0).cast("long")
    out = live.join(drops, "product_id", "left").select("product_id", "live", spread.alias("spread_bp"), F.coalesce("drop_bp", F.lit(0)).alias("drop_bp"))
    return out.withColumn("deal_score_bp", F.greatest("spread_bp", "drop_bp"))


def deals(offers: DataFrame, current: Column, history: DataFrame, since: Column, limit: int = 60) -> DataFrame:
    """Products worth showing: two live offers or more and a score of 8 % or more.

    Signals and summary come from one aggregation of the offers: current offers
    are never stale, so both look at the same prices.
    """
    price = F.when(current, F.col("price_bani"))
    live = offers.groupBy("product_id").agg(F.min(price).alias("lo"), F.max(price).alias("hi"), F.count_if(current).alias("live")).where(F.col("live") >= C.DEAL_MIN_OFFERS)
    drops = drop_pct(daily_low(history.where(F.col("recorded_at") >= since))).select("product_id", "drop_bp")
    saving = S.half_up((F.col("hi") - F.col("lo")) * 10000 / F.col("hi"))
    out = live.join(drops, "product_id", "left").withColumn("deal_score_bp", F.greatest(saving, F.coalesce("drop_bp", F.lit(0))))
    out = out.where(F.col("deal_score_bp") >= C.DEAL_MIN_SCORE * 100)
    out = out.select("product_id", "deal_score_bp", F.col("lo").alias("lowest_bani"), F.col("hi").alias("highest_bani"), saving.alias("savings_bp"))
    return out.orderBy(F.desc("deal_score_bp"), "product_id").limit(limit)


def price_story(history: DataFrame, current_low: DataFrame, now: Column) -> DataFrame:
    """What a product's history says: no-price, too-new, unchanged or story, with its low and high.

    One observation of two weeks or more is unchanged.  A story is at its low
    within 2 %, and a good time to buy if it also has STORY_MIN_POINTS
    observations and ever was dearer; only then can a trend be drawn.
    """
    seen = history.where("price_bani > 0").groupBy("product_id").agg(
        F.min("recorded_at").alias("first"), F.count(F.lit(1)).alias("points"), F.min("price_bani").alias("low"), F.max("price_bani").alias("high")
    )
    days = F.timestamp_diff("DAY", "first", now)
    rows = seen.join(current_low.select("product_id", F.col("lowest_bani").alias("current")), "product_id", "left")
    no_price = F.coalesce("current", F.lit(0)) <= 0
    kind = F.when(no_price, "no-price").when(days < C.STORY_MIN_DAYS, "too-new").when(F.col("points") == 1, "unchanged").otherwise("story")
    at_low = (kind == "story") & (F.col("current") - F.col("low") <= C.STORY_LOW_SHARE * F.col("low"))
    trend = (kind == "story") & (F.col("points") >= C.STORY_MIN_POINTS)
    return rows.select(
        "product_id", kind.alias("kind"), days.alias("observed_days"), "points", "low", "high", F.coalesce(at_low, F.lit(False)).alias("at_low"),
        F.coalesce(at_low & trend & (F.col("high") > F.col("low")), F.lit(False)).alias("good_time"), F.coalesce(trend, F.lit(False)).alias("can_draw_trend"),
    )


def category_listing(current: DataFrame) -> DataFrame:
    """Per category: products, shops, cheapest price; a department is the category modulo 5."""
    return current.groupBy("category_id").agg(
        F.countDistinct("product_id").alias("products"), F.countDistinct("merchant_id").alias("shops"), F.min("price_bani").alias("from_bani")
    )


def class_equivalents(current: DataFrame, limit: int = 12) -> DataFrame:
    """Per class the ``limit`` cheapest (product, shop) rows by unit price, unknown ones last."""
    row = current.where("class_id is not null").groupBy("class_id", "product_id", "merchant_id", "unit_size").agg(F.min("price_bani").alias("bani"))
    row = row.withColumn("per_unit_bani", S.per_unit_bani(F.col("bani"), F.col("unit_size")))
    order = Window.partitionBy("class_id").orderBy(F.asc_nulls_last(F.nullif("per_unit_bani", F.lit(0))), "bani", "product_id", "merchant_id")
    return row.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).drop("unit_size")


def count_stats(offers: DataFrame, current: DataFrame) -> DataFrame:
    """Headline counts; a product is comparable with two shops, or by its class reaching two."""
    shops = current.groupBy("product_id", "class_id").agg(F.countDistinct("merchant_id").alias("n"))
    classes = current.where("class_id is not null").groupBy("class_id").agg(F.countDistinct("merchant_id").alias("m"))
    both = shops.join(classes, "class_id", "left")
    wide = (F.col("n") >= 2) | (F.coalesce("m", F.lit(0)) >= 2)
    a = both.agg(F.count(F.lit(1)).alias("products"), F.count_if(F.col("n") >= 2).alias("comparable"), F.count_if(wide).alias("comparable_or_equivalent"))
    b = current.agg(F.count(F.lit(1)).alias("offers"), F.countDistinct("merchant_id").alias("chains"))
    return a.join(b.join(offers.agg(F.count(F.lit(1)).alias("all_offers"))))  # one row each


def comparability(current: DataFrame) -> DataFrame:
    """Products per section with at least 2, 3, 4 shops."""
    shops = current.groupBy("section", "product_id").agg(F.countDistinct("merchant_id").alias("n"))
    least = [F.count_if(F.col("n") >= k).alias(f"at_least_{k}") for k in (2, 3, 4)]
    return shops.groupBy("section").agg(F.count(F.lit(1)).alias("products"), *least)


def price_depth(current: DataFrame) -> DataFrame:
    """How many products have 1, 2, 3, 4, 5 or more shops: per section and over all (null)."""
    shops = current.groupBy("section", "product_id").agg(F.countDistinct("merchant_id").alias("n"))
    return shops.rollup("section", F.least("n", F.lit(5)).alias("depth")).agg(F.count(F.lit(1)).alias("products")).where("depth is not null or section is null")


def offer_ladder(placed: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """Offers left after each condition in turn, and how many it removed; one pass."""
    kept, counts = F.lit(True), [F.count(F.lit(1)).alias("c0")]
    for i, (_, condition) in enumerate(steps, 1):
        kept = kept & F.coalesce(condition, F.lit(False))
        counts.append(F.count_if(kept).alias(f"c{i}"))
    one = placed.agg(*counts)
    rows = [F.struct(F.lit(i).alias("step"), F.lit(n).alias("name"), F.col(f"c{i}").alias("left_over"), (F.col(f"c{i - 1}") - F.col(f"c{i}")).alias("removed")) for i, (n, _) in enumerate(steps, 1)]
    return one.select(F.inline(F.array(*rows)))


def offer_census(placed: DataFrame, now: Column, days: int = C.CENSUS_STALE_DAYS) -> DataFrame:
    """Every offer in the first bucket that fits; the buckets add up to all offers."""
    bucket = (
        F.when(~F.col("active"), "inactive").when(F.col("aggregator"), "platform").when(F.col("flagged"), "flagged")
        .when(F.col("availability") != "in stock", "out-of-stock").when(F.col("is_stale"), "stale")
        .when(F.col("recorded_at") < now - F.expr(f"interval {days} days"), "old").otherwise("live")
    )
    return placed.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("offers"), F.sum("price_bani").alias("sum_bani"))


def merchant_contribution(current: DataFrame) -> DataFrame:
    """Per merchant: offers, products, products where it is the only or one of two shops."""
    one = current.groupBy("product_id", "merchant_id").agg(F.count(F.lit(1)).alias("offers"))
    one = one.withColumn("shops", F.count(F.lit(1)).over(Window.partitionBy("product_id")))
    return one.groupBy("merchant_id").agg(
        F.sum("offers").alias("offers"), F.count(F.lit(1)).alias("products"),
        F.count_if(F.col("shops") == 2).alias("sole_second"), F.count_if(F.col("shops") == 1).alias("only_shop"),
    )


def category_nav(current: DataFrame, region: DataFrame, nation: DataFrame) -> DataFrame:
    """Departments and their leaf categories with product counts, in one pass."""
    counts = current.groupBy("category_id").agg(F.countDistinct("product_id").alias("products"))
    leaves = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).join(counts, F.col("n_nationkey") == F.col("category_id"), "left")
    return leaves.select(F.col("r_name").alias("department"), F.col("n_name").alias("category"), F.coalesce("products", F.lit(0)).alias("products"))


def platform_markup(placed: DataFrame) -> DataFrame:
    """Platform price against the cheapest shelf price of the same product: quantiles of the ratio, in basis points."""
    pair = placed.groupBy("product_id").agg(F.min(F.when(F.col("aggregator"), F.col("price_bani"))).alias("platform"), F.min(F.when(~F.col("aggregator"), F.col("price_bani"))).alias("shelf"))
    pair = pair.where("platform is not null and shelf > 0").select(S.half_up(F.col("platform") * 10000 / F.col("shelf")).alias("bp"))
    q = [F.floor(F.percentile("bp", F.lit(p / 100)) + 0.5).cast("long").alias(f"p{p}") for p in (10, 25, 50, 75, 90)]
    return pair.agg(F.count(F.lit(1)).alias("products"), *q)
