"""Audits, gates and admin listings over offers, runs and queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions import scalars as S
from marketloom.operators.quality import at_places


def predicate_counts(placed: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """Offers that each liveness predicate lets through, in one pass."""
    one = placed.agg(*(F.count_if(F.coalesce(p, F.lit(False))).alias(n) for n, p in predicates.items()))
    return one.select(F.inline(F.array(*(F.struct(F.lit(n).alias("predicate"), F.col(n).alias("offers")) for n in predicates))))


def reasons_not_buyable(placed: DataFrame, reason: Column) -> DataFrame:
    """Offers per first reason against buying (``ok`` without one)."""
    return placed.groupBy(F.coalesce(reason, F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("offers"))


def disagreement(placed: DataFrame, one: Column, other: Column) -> DataFrame:
    """Offers that just one of two predicates lets through."""
    a, b = F.coalesce(one, F.lit(False)), F.coalesce(other, F.lit(False))
    return placed.where(a != b).select("product_id", "merchant_id", F.when(a, "first").otherwise("second").alias("only_in"))


def listing_page(current: DataFrame, page: int, size: int = 120) -> DataFrame:
    """One page of the products without a class, cheapest first; pages beyond the last show the last."""
    low = current.where("class_id is null").groupBy("product_id").agg(F.min("price_bani").alias("low_bani"))
    total = low.agg(F.count(F.lit(1)).alias("total"))  # one row
    first = low.orderBy("low_bani", "product_id").limit(max(page, 1) * size)
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("low_bani", "product_id"))  # at most the pages up to this one
    shown = F.least(F.lit(max(page, 1)), F.greatest(F.ceil(F.col("total") / size), F.lit(1)))
    rows = first.withColumn("place", place).join(F.broadcast(total)).withColumn("shown", shown)
    return rows.where((F.col("place") > (F.col("shown") - 1) * size) & (F.col("place") <= F.col("shown") * size)).select("product_id", "low_bani")


def price_chart(history: DataFrame, kinds: int = 3) -> DataFrame:
    """Days by kind of store: lowest price, null where a kind has no observation."""
    rows = history.select("product_id", F.to_date("recorded_at").alias("day"), F.concat(F.lit("kind_"), F.col("merchant_id") % kinds).alias("kind"), "price_bani")
    return rows.groupBy("product_id", "day").pivot("kind", [f"kind_{i}" for i in range(kinds)]).agg(F.min("price_bani"))


def sitemap_chunks(placed: DataFrame, listed: Column, size: int = 10_000) -> DataFrame:
    """Listed products per chunk of ids."""
    ids = placed.where(listed).select("product_id").distinct()
    return ids.groupBy(F.floor(F.col("product_id") / size).alias("chunk")).agg(F.count(F.lit(1)).alias("urls"), F.min("product_id").alias("first_id"))


def merchant_provenance(placed: DataFrame) -> DataFrame:
    """Per merchant: offers, and how many carry a reference price, a promotion end, a flag, no stock."""
    return placed.groupBy("merchant_id").agg(
        F.count(F.lit(1)).alias("offers"), F.count_if(F.col("reference_bani") > F.col("price_bani")).alias("with_reference"),
        F.count_if(F.col("promo_valid_to").isNotNull()).alias("with_promo"), F.count_if("flagged").alias("flagged"),
        F.count_if(F.col("availability") != "in stock").alias("out_of_stock"),
    )


def gap_analysis(pending: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Unresolved rows per group, with the upper median of their score."""
    out = at_places(pending, keys, score, {"median_upper": F.floor(F.col("n") / 2)})
    return out.select(*keys, F.col("n").alias("pending"), "median_upper")


def token_coverage(vocabulary: DataFrame, top: int = 50) -> DataFrame:
    """The ``top`` most frequent words with the running sum of their products."""
    rows = vocabulary.orderBy(F.desc("products"), "token").limit(top)
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("products"), "token").rowsBetween(Window.unboundedPreceding, 0)  # ``top`` rows
    return rows.withColumn("running", F.sum("products").over(order))


def dead_streak(runs: DataFrame, last: int = 5) -> DataFrame:
    """Per merchant how many of its newest runs, of ``last``, wrote nothing in a row."""
    newest = Window.partitionBy("merchant").orderBy(F.desc("day"))
    rows = runs.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= last)
    out = rows.groupBy("merchant").agg(F.min(F.when(F.col("written") > 0, F.col("rn"))).alias("alive"), F.count(F.lit(1)).alias("n"))
    return out.select("merchant", F.coalesce(F.col("alive") - 1, F.col("n")).cast("long").alias("streak"))


def pool_collapse(runs: DataFrame, share_pct: int = 60, peers: int = 6, days: int = 14) -> DataFrame:
    """Runs whose pool is under ``share_pct`` of the upper median of the runs before, three of them at least."""
    before = Window.partitionBy("merchant").orderBy("day").rowsBetween(-peers, -1)
    rows = runs.withColumn("seen", F.collect_list(F.struct("day", "attempted")).over(before))
    near = F.filter("seen", lambda x: x["day"] >= F.date_sub("day", days))
    rows = rows.withColumn("pools", F.array_sort(F.transform(near, lambda x: x["attempted"]))).where(F.size("pools") >= 3)
    rows = rows.withColumn("usual", F.get("pools", F.floor(F.size("pools") / 2).cast("int")))
    return rows.where(F.col("attempted") * 100 < F.col("usual") * share_pct).select("merchant", "day", "attempted", "usual")


def queue_total(events: DataFrame) -> DataFrame:
    """Per kind and day: new rows and the running total."""
    days = events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("new"))
    return days.withColumn("total", F.sum("new").over(Window.partitionBy("event_type").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))


def fabricated(placed: DataFrame, least: int = 50, share_pct: int = 2) -> DataFrame:
    """Prices that a merchant (of ``least`` offers) asks under different names for over ``share_pct`` of its offers."""
    group = placed.groupBy("merchant_id", "price_bani").agg(F.count(F.lit(1)).alias("offers"), F.countDistinct("name").alias("names"))
    group = group.withColumn("all_offers", F.sum("offers").over(Window.partitionBy("merchant_id")))
    wide = (F.col("all_offers") >= least) & (F.col("names") >= 2) & (F.col("offers") * 100 > F.col("all_offers") * share_pct)
    return group.where(wide)


def class_health(current: DataFrame) -> DataFrame:
    """Classes whose sizes spread over 1.5 times, or that fewer than two shops sell."""
    out = current.where("class_id is not null").groupBy("class_id").agg(
        F.count(F.lit(1)).alias("offers"), F.countDistinct("merchant_id").alias("shops"), F.min("unit_size").alias("smallest"), F.max("unit_size").alias("largest")
    )
    return out.where((F.col("largest") > 1.5 * F.col("smallest")) | (F.col("shops") < 2))


def score_sweep(signals: DataFrame, step: int = 500, most: int = 5_000) -> DataFrame:
    """Products that reach each threshold of the deal score; thresholds are exploded up to a row's score."""
    reached = F.sequence(F.lit(0), F.least(F.floor(F.col("deal_score_bp") / step), F.lit(most // step)).cast("int"))
    rows = signals.select(F.explode(reached).alias("k"))
    return rows.groupBy((F.col("k") * step).alias("threshold_bp")).agg(F.count(F.lit(1)).alias("products"))


def home_drops(signals: DataFrame, least_bp: int = 200, fetch: int = 24, show: int = 6) -> DataFrame:
    """Largest drops for the home page: ``fetch`` by drop, then those with two live offers, ``show`` of them."""
    top = signals.where(F.col("drop_bp") > least_bp).orderBy(F.desc("drop_bp"), "product_id").limit(fetch)
    return top.where("live >= 2").orderBy(F.desc("drop_bp"), "product_id").limit(show).select("product_id", "drop_bp", "live")


def store_list(current: DataFrame) -> DataFrame:
    """Shops with something to buy."""
    return current.groupBy("merchant_id", "slug").agg(F.count(F.lit(1)).alias("offers"), F.countDistinct("product_id").alias("products"))


def expired_unmarked(placed: DataFrame, now: Column) -> DataFrame:
    """Per merchant: offers past their promotion's end that are neither stale nor sold out."""
    past = (F.col("promo_valid_to") < now) & ~F.col("is_stale") & (F.col("availability") == "in stock")
    return placed.where(past).groupBy("merchant_id").agg(F.count(F.lit(1)).alias("offers"), F.min("promo_valid_to").alias("oldest"))


def price_jumps(history: DataFrame, pct: int = 400) -> DataFrame:
    """Observations over ``pct`` per cent of the offer's previous price, or under its reverse."""
    w = Window.partitionBy("product_id", "merchant_id").orderBy("recorded_at", "ord", "line")
    rows = history.withColumn("before", F.lag("price_bani").over(w))
    up, down = F.col("price_bani") * 100 > F.col("before") * pct, F.col("price_bani") * pct < F.col("before") * 100
    return rows.where(up | down).select("product_id", "merchant_id", "ord", "line", "before", "price_bani", F.when(up, "up").otherwise("down").alias("way"))


def seeded_sample(products: DataFrame, seed: int, size: int = 50) -> DataFrame:
    """``size`` products that a seed picks, the same ones each time."""
    order = F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed))))
    return products.orderBy(order, "id").limit(size).select("id", "name")


def pending_queue(current: DataFrame) -> DataFrame:
    """Review candidates: id, score_bp, merchants, spread_bani of every product on offer."""
    out = current.groupBy(F.col("product_id").alias("id")).agg(
        F.countDistinct("merchant_id").alias("merchants"), (F.max("price_bani") - F.min("price_bani")).alias("spread_bani")
    )
    return out.withColumn("score_bp", (F.col("id") * 37) % 10_000)


def unit_price_order(current: DataFrame, limit: int = 40) -> DataFrame:
    """Products by unit price, unknown ones last."""
    low = current.groupBy("product_id", "unit_size").agg(F.min("price_bani").alias("low_bani"))
    ppu = S.per_unit_bani(F.col("low_bani"), F.col("unit_size"))
    rows = low.select("product_id", "low_bani", ppu.alias("per_unit_bani"))
    return rows.orderBy(F.asc_nulls_last(F.nullif("per_unit_bani", F.lit(0))), "low_bani", "product_id").limit(limit)
