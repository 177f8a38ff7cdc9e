"""Data-quality operators: frames of violations (empty means pass), outliers, duplicates, fan-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom import constants as C
from marketloom.functions import scalars as S


def outliers(offers: DataFrame, visible: Column) -> DataFrame:
    """Visible offers further than 70 % of the median from the median of their product (3 shops or more)."""
    rows = offers.where(visible)
    mid = rows.groupBy("product_id").agg(F.median("price_bani").alias("median"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= C.OUTLIER_MIN_PEERS)
    out = rows.join(mid, "product_id").where(F.abs(F.col("price_bani") - F.col("median")) > C.OUTLIER_SHARE * F.col("median"))
    return out.select("product_id", "merchant_id", "price_bani", S.half_up(F.col("median") * 2).alias("median_x2"), "n")


def duplicate_keys(products: DataFrame) -> DataFrame:
    """Groups of products with the same section, words and size."""
    key = F.concat_ws("::", "section", S.name_bag(F.col("name")), F.concat_ws(":", "unit", S.half_up(F.col("unit_size") * 1000)))
    rows = products.select(key.alias("dup_key"), "id").groupBy("dup_key").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("keep_id"), F.max("id").alias("last_id"))
    return rows.where("members > 1")


def merged_duplicates(products: DataFrame, offers: DataFrame) -> DataFrame:
    """Offers moved to the product kept of each duplicate group; per (product, merchant) the cheapest stays."""
    key = F.concat_ws("::", "section", S.name_bag(F.col("name")), F.concat_ws(":", "unit", S.half_up(F.col("unit_size") * 1000)))
    keyed = products.select(key.alias("k"), "id")
    keep = keyed.groupBy("k").agg(F.min("id").alias("keep_id"))
    moved = keyed.join(keep, "k").select(F.col("id").alias("product_id"), "keep_id")
    rows = offers.join(moved, "product_id")
    return rows.groupBy(F.col("keep_id").alias("product_id"), "merchant_id").agg(F.min("price_bani").alias("price_bani"), F.count(F.lit(1)).alias("merged"))


def fan_out(offers: DataFrame) -> DataFrame:
    """Store items (same merchant and price) that cover more products than usual, and whether more than ever allowed."""
    rows = offers.groupBy("merchant_id", "price_bani").agg(F.countDistinct("product_id").alias("products"))
    return rows.where(F.col("products") > C.FANOUT_P95).withColumn("over_max", F.col("products") > C.FANOUT_MAX)


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Child rows without a parent."""
    return child.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def census_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by bucket on both sides, zero where a bucket is missing."""
    a = before.groupBy(*keys).agg(F.count(F.lit(1)).alias("before"))
    b = after.groupBy(*keys).agg(F.count(F.lit(1)).alias("after"))
    both = a.join(b, keys, "full_outer").select(*keys, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("before", "after")))
    return both.withColumn("change", F.col("after") - F.col("before"))


def invariants(placed: DataFrame, now: Column, days: int) -> DataFrame:
    """Name and number of violations of the row-level invariants, in one pass over the offers."""
    checks = {
        "price-positive": F.col("price_bani") > 0,
        "old-is-stale": F.col("is_stale") | (F.col("recorded_at") >= now - F.expr(f"interval {days} days")),
        "platform-iff-aggregator": F.col("aggregator") == (F.col("merchant_id") % 10 == 0),
        "reference-above-price": F.col("reference_bani") >= F.col("price_bani"),
        "unit-price-plausible": S.unit_price_refusal(F.col("unit"), F.col("price_bani"), F.col("unit_size")).isNull(),
        "expired-not-current": ~(F.coalesce(F.col("promo_valid_to") < now, F.lit(False)) & (F.col("availability") == "in stock") & ~F.col("is_stale")),
    }
    one = placed.agg(*(F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in checks.items()))
    return one.select(F.inline(F.array(*(F.struct(F.lit(n).alias("invariant"), F.col(f"`{n}`").alias("violations")) for n in checks))))


def wide_spreads(current: DataFrame, ratio: int = 3) -> DataFrame:
    """Products whose dearest shop asks ``ratio`` times the cheapest or more."""
    out = current.groupBy("product_id").agg(
        F.min("price_bani").alias("lo"), F.max("price_bani").alias("hi"), F.countDistinct("merchant_id").alias("shops"),
        F.min_by("merchant_id", F.struct("price_bani", "merchant_id")).alias("cheapest_at"),
    )
    return out.where((F.col("shops") >= 2) & (F.col("hi") >= ratio * F.col("lo")))


def withheld_spread(current: DataFrame) -> DataFrame:
    """Offers to withhold: unit price twice the product's cheapest or more."""
    per = current.withColumn("ppu", S.per_unit_bani(F.col("price_bani"), F.col("unit_size"))).where("ppu > 0")
    per = per.withColumn("least", F.min("ppu").over(Window.partitionBy("product_id")))
    return per.where("ppu >= 2 * least").select("product_id", "merchant_id", "ppu", "least")


def staleness_bands(placed: DataFrame, now: Column) -> DataFrame:
    """Offers by age."""
    age = F.timestamp_diff("DAY", "recorded_at", now)
    band = F.when(age < 1, "under 1 d").when(age < 7, "1-7 d").when(age < 14, "7-14 d").when(age <= 30, "14-30 d").otherwise("over 30 d")
    return placed.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("offers"), F.countDistinct("merchant_id").alias("merchants"))


def at_places(rows: DataFrame, keys: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """Per key the count n and the values at 0-based places (Columns over n) of its sorted values.

    Equal values are counted first, and a running sum over the distinct ones
    finds the places, so no group is gathered.
    """
    counts = rows.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    group = Window.partitionBy(*keys)
    upto = F.sum("_c").over(group.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumn("_to", upto).withColumn("n", F.sum("_c").over(group))
    here = lambda at: F.max(F.when((at >= F.col("_to") - F.col("_c")) & (at < F.col("_to")), F.col("_v")))
    return counts.groupBy(*keys).agg(F.max("n").alias("n"), *(here(at).alias(name) for name, at in places.items()))


def pool_sizes(history: DataFrame) -> DataFrame:
    """Per merchant the four conventions of the middle and of the 95th percentile of its prices."""
    n = F.col("n")
    places = {
        "lower": F.floor((n - 1) / 2), "median_upper": F.floor(n / 2),
        "p95_pn": F.least(n - 1, F.floor(n * 95 / 100)), "p95_qn1": F.floor((n - 1) * 95 / 100),
    }
    rows = at_places(history, ["merchant_id"], "price_bani", places)
    return rows.select("merchant_id", (F.col("lower") + F.col("median_upper")).alias("median_x2"), "median_upper", "p95_pn", "p95_qn1")


def parse_tally(parsed: DataFrame, raw: str, value: str, most_null: float = 0.05, least_rows: int = 20) -> DataFrame:
    """Rows, nulls and whether the null rate is alarming."""
    out = parsed.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(raw).isNotNull() & F.col(value).isNull()).alias("nulls"))
    return out.withColumn("alarm", (F.col("rows") >= least_rows) & (F.col("nulls") > most_null * F.col("rows")))
