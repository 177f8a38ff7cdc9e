"""Ordered analytics over price history: moves, carried-forward series, discounts, shrinking packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom import constants as C
from marketloom.functions import scalars as S

OFFER = ["product_id", "merchant_id"]


def _in_time() -> Window:
    return Window.partitionBy(*OFFER).orderBy("recorded_at", "ord", "line")


def price_moves(history: DataFrame, threshold_pct: int = 40) -> DataFrame:
    """Per merchant: observations, changes, changes of ``threshold_pct`` or more, largest in basis points."""
    rows = history.withColumn("before", F.lag("price_bani").over(_in_time()))
    move = S.half_up(F.abs(F.col("price_bani") - F.col("before")) * 10000 / F.col("before"))
    rows = rows.withColumn("move_bp", F.when(F.col("before") > 0, move))
    return rows.groupBy("merchant_id").agg(
        F.count(F.lit(1)).alias("points"), F.count_if(F.col("move_bp") > 0).alias("moves"),
        F.count_if(F.col("move_bp") >= threshold_pct * 100).alias("big"), F.coalesce(F.max("move_bp"), F.lit(0)).alias("biggest_bp"),
    )


def appended_on_change(history: DataFrame) -> DataFrame:
    """Observations that differ from the offer's previous one (the first always counts)."""
    rows = history.withColumn("before", F.lag("price_bani").over(_in_time()))
    return rows.where("before is null or before <> price_bani").drop("before")


def mass_move_days(history: DataFrame, writes: int = C.MASS_MOVE_WRITES, share: float = C.MASS_MOVE_SHARE, jump: float = C.MASS_MOVE_JUMP) -> DataFrame:
    """Days with ``writes`` or more on which over ``share`` of the offers moved by more than ``jump``."""
    rows = history.withColumn("before", F.lag("price_bani").over(_in_time()))
    big = F.abs(F.col("price_bani") - F.col("before")) > jump * F.col("before")
    day = rows.groupBy(F.to_date("recorded_at").alias("day")).agg(F.count(F.lit(1)).alias("writes"), F.count_if(F.coalesce(big, F.lit(False))).alias("big"))
    return day.where((F.col("writes") >= writes) & (F.col("big") > share * F.col("writes")))


def basket_series(history: DataFrame, basket: DataFrame) -> DataFrame:
    """Index of a fixed basket: per observed day the cheapest carried-forward price per line, and totals.

    Prices carry forward from a merchant's last observation on or before the
    day.  Only days on which some basket line was observed appear.
    """
    seen = history.join(basket, "product_id")
    day = seen.groupBy("product_id", "merchant_id", F.to_date("recorded_at").alias("day")).agg(
        F.max_by("price_bani", F.struct("recorded_at", "ord", "line")).alias("price")
    )
    days = day.select("day").distinct()
    pairs = day.select("product_id", "merchant_id").distinct()
    # every line and shop on every observed day: as large as the basket times the calendar
    grid = pairs.join(F.broadcast(days)).join(day, ["product_id", "merchant_id", "day"], "left")
    back = Window.partitionBy("product_id", "merchant_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.withColumn("carried", F.last("price", ignorenulls=True).over(back)).where("carried is not null")
    best = filled.groupBy("day", "product_id").agg(F.min("carried").alias("best"))
    return best.groupBy("day").agg(F.count(F.lit(1)).alias("priced"), F.sum("best").alias("total_bani"))


def period_change(series: DataFrame, days: int) -> DataFrame:
    """For each day the change of the total since the last point ``days`` earlier or before, if as many lines were priced."""
    points = series.select(F.struct("day", "priced", "total_bani").alias("p"), "day")
    targets = series.select(F.date_sub("day", days).alias("day"), F.struct("day", "priced", "total_bani").alias("now"))
    both = points.select("day", "p", F.lit(None).alias("now")).unionByName(targets.select("day", F.lit(None).alias("p"), "now"))
    order = Window.partitionBy(F.lit(1)).orderBy("day", F.col("now").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)  # one row a day
    out = both.withColumn("then", F.last("p", ignorenulls=True).over(order)).where("now is not null and then.priced = now.priced")
    return out.select(F.col("now.day").alias("day"), F.col("then.day").alias("then_day"), (F.col("now.total_bani") - F.col("then.total_bani")).alias("change_bani"))


def prior_minimum(history: DataFrame, now: Column, days: int = C.HISTORY_DAYS) -> DataFrame:
    """Lowest price before the current one within ``days``, with the price carried into the window.

    The trailing run of observations equal to the last price does not count as
    "before".
    """
    newest = Window.partitionBy(*OFFER).orderBy(F.desc("recorded_at"), F.desc("ord"), F.desc("line"))
    rows = history.withColumn("current", F.first("price_bani").over(newest)).withColumn("rn", F.row_number().over(newest))
    run = Window.partitionBy(*OFFER)
    rows = rows.withColumn("run_end", F.min(F.when(F.col("price_bani") != F.col("current"), F.col("rn"))).over(run))
    before = F.col("rn") >= F.col("run_end")
    cutoff = now - F.expr(f"interval {days} days")
    inside = before & (F.col("recorded_at") >= cutoff)
    carried = before & (F.col("recorded_at") < cutoff)
    out = rows.groupBy(*OFFER).agg(
        F.first("current").alias("current_bani"), F.min(F.when(inside, F.col("price_bani"))).alias("inside"),
        F.min_by(F.when(carried, F.col("price_bani")), F.when(carried, F.col("rn"))).alias("carried"), F.min("recorded_at").alias("first"),
    )
    coverage = F.least(F.lit(days), F.timestamp_diff("DAY", "first", now))
    return out.select(*OFFER, "current_bani", F.least("inside", "carried").alias("prior_min_bani"), coverage.cast("long").alias("coverage_days"))


def discount_verdicts(offers: DataFrame, prior: DataFrame) -> DataFrame:
    """Is a reduction real: against the shop's own 30-day figure (omnibus_bani) if it states one, else our prior minimum.

    Our minimum counts where the history is long enough.  real: cheaper than
    that; small: only cheaper than the advertised price; none; unknown without
    a baseline.  A shop's figure 5 % off ours, or an advertised price that is
    no higher, is to be reviewed.
    """
    stated = F.col("omnibus_bani") if "omnibus_bani" in offers.columns else F.lit(None).cast("long")
    rows = offers.select(*OFFER, "price_bani", "reference_bani", stated.alias("omnibus_bani")).join(prior.drop("current_bani"), OFFER)
    p, was, own = F.col("price_bani"), F.col("reference_bani"), F.col("omnibus_bani")
    ours = F.when(F.col("coverage_days") >= C.BASELINE_DAYS, F.col("prior_min_bani"))
    base = F.coalesce(own, ours)
    saving = F.coalesce(F.when(was > p, was - p), F.lit(0))
    verdict = F.when(base.isNull(), "unknown").when(p < base, "real").when(saving > 0, "small").otherwise("none")
    source = F.when(own.isNotNull(), "RETAILER").when(ours.isNotNull(), "OUR_HISTORY").otherwise("NONE")
    off = F.coalesce(F.abs(own - ours) * 10000 > ours * int(C.DISAGREEMENT * 10000), F.lit(False))
    review = off | F.coalesce(was <= p, F.lit(False))
    real = F.when(base.isNotNull(), F.greatest(base - p, F.lit(0)))
    return rows.select(
        *OFFER, verdict.alias("verdict"), source.alias("basis"), S.half_up(saving * 10000 / was).alias("claimed_bp"), S.half_up(real * 10000 / base).alias("real_bp"),
        off.alias("disagrees"), review.alias("needs_review"),
    )


def shrinkflation(observations: DataFrame) -> DataFrame:
    """Products whose pack shrank while the unit price rose; (product_id, recorded_at, size, price_bani).

    At least three observations, the last size smaller than the first by 3 % or
    more and confirmed by two trailing observations, unit price up by 2 % or more.
    """
    w = Window.partitionBy("product_id")
    rows = observations.withColumn("last_size", F.max_by("size", "recorded_at").over(w)).withColumn("n", F.count(F.lit(1)).over(w))
    other = F.max(F.when(F.col("size") != F.col("last_size"), F.col("recorded_at"))).over(w)
    rows = rows.withColumn("other", other)
    out = rows.groupBy("product_id").agg(
        F.first("n").alias("n"), F.min_by("size", "recorded_at").alias("first_size"), F.first("last_size").alias("last_size"),
        F.min_by("price_bani", "recorded_at").alias("first_bani"), F.max_by("price_bani", "recorded_at").alias("last_bani"),
        F.count_if(F.col("recorded_at") > F.col("other")).alias("confirmed"),
    )
    shrink = S.half_up((F.col("first_size") - F.col("last_size")) * 10000 / F.col("first_size"))
    rise = S.half_up((F.col("last_bani") / F.col("last_size") / (F.col("first_bani") / F.col("first_size")) - 1) * 10000)
    out = out.withColumn("shrink_bp", shrink).withColumn("unit_rise_bp", rise)
    good = (F.col("n") >= 3) & (F.col("shrink_bp") >= C.SHRINK_BP) & (F.col("confirmed") >= C.SHRINK_CONFIRMATIONS) & (F.col("unit_rise_bp") >= C.UNIT_RISE_BP)
    return out.where(good).select("product_id", "first_size", "last_size", "shrink_bp", "unit_rise_bp")


def run_collapse(runs: DataFrame) -> DataFrame:
    """Merchants whose newest successful run wrote half or less of the best of the three before."""
    newest = Window.partitionBy("merchant").orderBy(F.desc("day"))
    rows = runs.where("written > 0").withColumn("rn", F.row_number().over(newest)).where("rn <= 4")
    out = rows.groupBy("merchant").agg(F.max(F.when(F.col("rn") == 1, F.col("written"))).alias("newest"), F.max(F.when(F.col("rn") > 1, F.col("written"))).alias("best_before"))
    return out.where("newest * 2 <= best_before")


def night_moves(runs: DataFrame) -> DataFrame:
    """Nights whose written rows differ from the previous night by over 20 %."""
    rows = runs.groupBy("day").agg(F.sum("written").alias("written"))
    rows = rows.withColumn("before", F.lag("written").over(Window.partitionBy(F.lit(1)).orderBy("day")))  # one row a day
    return rows.where(F.abs(F.col("written") - F.col("before")) * 5 > F.col("before"))


def missing_nights(runs: DataFrame) -> DataFrame:
    """(merchant, day) without a run between a merchant's first and last day."""
    span = runs.groupBy("merchant").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = span.select("merchant", F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(runs.select("merchant", "day"), ["merchant", "day"], "left_anti")


def restock_gap(adds: DataFrame) -> DataFrame:
    """Usual days between a user's adds of a product: span over distinct days less one."""
    days = adds.select("user_id", "product_id", F.to_date("ts").alias("day")).distinct()
    out = days.groupBy("user_id", "product_id").agg(F.count(F.lit(1)).alias("distinct_days"), F.datediff(F.max("day"), F.min("day")).alias("span"))
    return out.where("distinct_days >= 2").select("user_id", "product_id", "distinct_days", S.half_up(F.col("span") / (F.col("distinct_days") - 1)).alias("usual_gap_days"))
