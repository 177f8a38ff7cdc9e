"""What pages and serializers show: unit price lows, item pages, pinned staples, index changes, discounts, classes to propose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions import scalars as S
from marketloom.operators.matching import alike
from marketloom.sources.work import written


def unit_lows(offers: DataFrame, current: Column) -> DataFrame:
    """Per product its lowest known unit price: of current offers, or of all where none is current; 0 if unknown."""
    per = S.per_unit_bani(F.col("price_bani"), F.col("unit_size"))
    known = F.when(per > 0, per)
    out = offers.groupBy("product_id").agg(F.count_if(current).alias("n"), F.min(F.when(current, known)).alias("now"), F.min(known).alias("ever"))
    return out.select("product_id", F.coalesce(F.when(F.col("n") > 0, F.col("now")).otherwise(F.col("ever")), F.lit(0)).alias("unit_low_bani"))


def item_pages(offers: DataFrame, current: Column, now: Column) -> DataFrame:
    """Per product its best offer (cheapest current, else cheapest that is no platform's), shops, and how old the best price is.

    Flagged offers are left out.
    """
    rows = offers.where(~F.col("flagged")).withColumn("_now", F.coalesce(current, F.lit(False)))
    rank = F.when(F.col("_now"), 0).when(~F.col("aggregator"), 1)
    best = F.min(F.when(rank.isNotNull(), F.struct(rank.alias("r"), F.col("price_bani"), F.col("merchant_id"), F.col("recorded_at"))))
    out = rows.groupBy("product_id").agg(best.alias("b"), F.countDistinct(F.when(F.col("_now"), F.col("merchant_id"))).alias("shops"))
    status = F.when(F.col("shops") == 0, "no-price").when(F.col("shops") == 1, "single-shop").otherwise("compared")
    hours = F.timestamp_diff("HOUR", "b.recorded_at", now)
    return out.select("product_id", F.col("b.merchant_id").alias("merchant_id"), F.col("b.price_bani").alias("price_bani"), (F.col("b.r") == 0).alias("is_current"), "shops", status.alias("status"), hours.alias("age_hours"))


def staples(pinned: DataFrame, current: DataFrame) -> DataFrame:
    """Pinned products (product_id, slot) with each shop's lowest price; products nobody sells stay, without a shop."""
    low = current.groupBy("product_id", "merchant_id").agg(F.min("price_bani").alias("low_bani"))
    return pinned.join(low, "product_id", "left").select("slot", "product_id", "merchant_id", "low_bani")


def change_within(series: DataFrame, days: int) -> DataFrame:
    """Change of a series (day, priced, total_bani) from the first point of its last ``days`` days to its last, if as many lines were priced."""
    last = series.agg(F.max_by(F.struct("day", "priced", "total_bani"), "day").alias("b"))  # one row
    rows = series.join(F.broadcast(last)).where((F.col("day") >= F.date_sub("b.day", days)) & (F.col("day") < F.col("b.day")))
    first = rows.groupBy("b").agg(F.min_by(F.struct("day", "priced", "total_bani"), "day").alias("a")).where("a.priced = b.priced")
    return first.select(F.col("a.day").alias("from_day"), F.col("b.day").alias("to_day"), (F.col("b.total_bani") - F.col("a.total_bani")).alias("change_bani"))


def discount_rows(offers: DataFrame, verdicts: DataFrame, limit: int = 50) -> DataFrame:
    """Real reductions of offers on the shelf now, the largest first; (product_id, merchant_id, ...)."""
    real = verdicts.where("verdict = 'real' and not needs_review").join(offers.select("product_id", "merchant_id", "price_bani", "recorded_at"), ["product_id", "merchant_id"])
    return real.select("product_id", "merchant_id", "price_bani", "real_bp", "basis").orderBy(F.desc("real_bp"), "product_id", "merchant_id").limit(limit)


def class_opportunities(current: DataFrame, step: float = 1.25, most_spread: float = 2.0, per_noun: int = 3) -> DataFrame:
    """Groups worth a class of their own: unclassed products of one leading word, unit and size step at several shops.

    Score is shops times members; prices may spread under twice; at most
    ``per_noun`` groups of a word.
    """
    head = F.get(S.tokens(S.normalize(F.col("name"))), F.lit(0))
    rows = current.where("class_id is null and unit_size > 0").withColumn("noun", head).withColumn("bucket", F.floor(F.ln("unit_size") / F.ln(F.lit(step))).cast("long"))
    per = F.col("price_bani") / F.col("unit_size")
    out = rows.groupBy("noun", "unit", "bucket").agg(
        F.countDistinct("product_id").alias("members"), F.countDistinct("merchant_id").alias("shops"), F.min(per).alias("lo"), F.max(per).alias("hi")
    )
    out = out.where((F.col("members") >= 2) & (F.col("shops") >= 2) & (F.col("hi") < most_spread * F.col("lo"))).withColumn("score", F.col("members") * F.col("shops"))
    order = Window.partitionBy("noun").orderBy(F.desc("score"), "unit", "bucket")
    return out.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= per_noun).select("noun", "unit", "bucket", "members", "shops", "score")


def class_proposals(products: DataFrame, classes: DataFrame, least: float = 0.34, size_window: float = 0.26) -> DataFrame:
    """For each unclassed product the class whose name it resembles most; (class_id, class_name, unit, size).

    Unit equal, size within the window, and the class's leading word among the
    product's first two; then the largest Jaccard share, ``least`` or more.
    Products (ids are unique) that read alike are compared with classes once.
    """
    texts, rows = alike(products.where("class_id is null"), "id", ["name", "unit", "unit_size"], "text")
    words = F.array_distinct(S.tokens(S.normalize(F.col("name"))))
    p = texts.select("id", "unit", "unit_size", words.alias("w"), F.explode(F.array_distinct(F.slice(words, 1, 2))).alias("lead"))
    c = classes.select("class_id", "unit", "size", F.array_distinct(S.tokens(S.normalize(F.col("class_name")))).alias("cw"))
    found = p.join(c.withColumn("lead", F.get("cw", F.lit(0))), ["unit", "lead"]).where(F.abs(F.col("unit_size") - F.col("size")) <= size_window * F.col("size") + 1e-9)
    found = found.withColumn("score_bp", S.half_up(S.jaccard(F.col("w"), F.col("cw")) * 10000)).where(F.col("score_bp") >= least * 10000)
    order = Window.partitionBy("id").orderBy(F.desc("score_bp"), "class_id")
    best = found.withColumn("rn", F.row_number().over(order)).where("rn = 1").select(F.col("id").alias("text"), "class_id", "score_bp")
    return rows.join(best, "text").select("id", "class_id", "score_bp")


def index_by_class(current: DataFrame) -> DataFrame:
    """Per class its cheapest offer at each shop and anywhere: shops pricing it, the best price and where; platforms do not count."""
    rows = current.where("class_id is not null and not aggregator").groupBy("class_id", "merchant_id").agg(F.min("price_bani").alias("p"))
    return rows.groupBy("class_id").agg(
        F.count(F.lit(1)).alias("shops"), F.min("p").alias("best_bani"), F.min_by("merchant_id", F.struct("p", "merchant_id")).alias("best_at"), F.max("p").alias("dearest_bani")
    )


def personal_deals(deals: DataFrame, products: DataFrame, favourites: DataFrame, limit: int = 10) -> DataFrame:
    """Per user the best deals in the categories of its favourites, without the favourites themselves.

    Deals are ranked within their category once; a user is offered as many of each
    category's first as it has favourites among them, and ``limit`` more.
    """
    placed = products.select(F.col("id").alias("product_id"), "category_id")
    liked = favourites.select("user_id", "product_id").distinct()
    order = (F.desc("deal_score_bp"), "product_id")
    ranked = written(deals.select("product_id", "deal_score_bp").join(placed, "product_id").withColumn("n", F.row_number().over(Window.partitionBy("category_id").orderBy(*order))))
    own = ranked.groupBy("product_id").agg(F.count(F.lit(1)).alias("own"))
    kinds = liked.join(placed, "product_id").join(own, "product_id", "left").groupBy("user_id", "category_id").agg(F.coalesce(F.sum("own"), F.lit(0)).alias("own"))
    kinds = written(kinds)
    offered = ranked.join(F.broadcast(kinds.agg(F.max("own").alias("most"))), F.col("n") <= F.col("most") + limit).drop("most")
    rows = kinds.select("user_id", "category_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("own") + limit)).alias("n")).join(offered, ["category_id", "n"])
    rows = rows.join(liked, ["user_id", "product_id"], "left_anti")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(*order)))
    return rows.where(F.col("place") <= limit).select("user_id", "place", "product_id", "deal_score_bp")
