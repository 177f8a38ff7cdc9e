"""User-side analytics: inferred favourites, savings, alerts, popular adds, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom import constants as C
from marketloom.functions import scalars as S


def favourites_inferred(adds: DataFrame) -> DataFrame:
    """Products a user added on distinct days, three of which make an inferred favourite."""
    rows = adds.groupBy("user_id", "product_id").agg(F.count(F.lit(1)).alias("adds"), F.countDistinct(F.to_date("ts")).alias("distinct_days"))
    return rows.withColumn("inferred", F.col("distinct_days") >= C.INFERRED_AT)


def top_added(adds: DataFrame, limit: int = 50, per_caller: int = 3) -> DataFrame:
    """Most added products; a user counts at most ``per_caller`` times for one product."""
    rows = adds.groupBy("user_id", "product_id").agg(F.least(F.count(F.lit(1)), F.lit(per_caller)).alias("n"))
    return rows.groupBy("product_id").agg(F.sum("n").alias("adds")).orderBy(F.desc("adds"), "product_id").limit(limit)


def monthly_savings(events: DataFrame) -> DataFrame:
    """Savings per user and calendar month, in bani; (user_id, ts, bani)."""
    return events.groupBy("user_id", F.date_trunc("month", "ts").cast("date").alias("month")).agg(F.sum("bani").alias("saved_bani"))


def alerts_fired(watch: DataFrame, current: DataFrame, now: Column | None = None, hours: int = C.ALERT_HOURS) -> DataFrame:
    """Watches whose target is met, or whose product fell by over 3 %; (user_id, product_id, base_bani, target_bani).

    With a last_fired column, and ``now``, watches that fired within ``hours`` rest.
    """
    low = current.groupBy("product_id").agg(F.min("price_bani").alias("low"))
    rows = watch.join(low, "product_id")
    if now is not None and "last_fired" in watch.columns:
        rows = rows.where(F.col("last_fired").isNull() | (F.col("last_fired") <= now - F.expr(f"interval {hours} hours")))
    hit = F.coalesce(F.col("low") <= F.col("target_bani"), F.lit(False))
    fell = F.col("low") * 100 < F.col("base_bani") * (100 - int(C.ALERT_DROP * 100))
    return rows.where(hit | fell).select("user_id", "product_id", "low", F.when(hit, "target").otherwise("drop").alias("why"))


def pushes_due(favourites: DataFrame, signals: DataFrame, low: DataFrame, pushed: DataFrame, least_pct: int = C.PUSH_DROP_PCT) -> DataFrame:
    """(user_id, product_id, low_bani): favourites that fell by ``least_pct`` or more and are lower than when last pushed."""
    fell = signals.where(F.col("drop_bp") >= least_pct * 100).select("product_id").join(low.select("product_id", "low_bani"), "product_id")
    rows = favourites.select("user_id", "product_id").distinct().join(fell, "product_id").join(pushed.select("user_id", "product_id", "pushed_bani"), ["user_id", "product_id"], "left")
    return rows.where(F.col("pushed_bani").isNull() | (F.col("low_bani") < F.col("pushed_bani"))).select("user_id", "product_id", "low_bani")


def digest(favourites: DataFrame, signals: DataFrame, top: int = 5) -> DataFrame:
    """Per user its ``top`` favourites by drop."""
    rows = favourites.select("user_id", "product_id").distinct().join(signals.where("drop_bp > 0").select("product_id", "drop_bp"), "product_id")
    order = Window.partitionBy("user_id").orderBy(F.desc("drop_bp"), "product_id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select("user_id", "place", "product_id", "drop_bp")


def toggled(events: DataFrame) -> DataFrame:
    """Favourites after all toggles (user_id, product_id): those toggled an odd number of times."""
    return events.groupBy("user_id", "product_id").agg(F.count(F.lit(1)).alias("toggles")).where(F.col("toggles") % 2 == 1).select("user_id", "product_id")


def corroborated(votes: DataFrame, least: int = 2) -> DataFrame:
    """Suggested pairs, in either order, that ``least`` users made; a user's repeated votes count once; (user_id, a, b)."""
    pair = votes.select("user_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b")
    return pair.groupBy("a", "b").agg(F.countDistinct("user_id").alias("users")).where(F.col("users") >= least)


def budgets(writes: DataFrame) -> DataFrame:
    """The last budget of each (user, month) from all writes (user_id, ts, event_id, bani)."""
    month = F.date_trunc("month", "ts").cast("date").alias("month")
    return writes.groupBy("user_id", month).agg(F.max_by("bani", F.struct("ts", "event_id")).alias("budget_bani"))


def erased(users: DataFrame, tables: dict[str, DataFrame], key: str = "user_id") -> DataFrame:
    """What erasing users would take from each table: rows gone and rows kept; export is the semi join of the same tables."""
    out = None
    gone = users.select(key).distinct().withColumn("_gone", F.lit(True))
    for name, rows in tables.items():
        hit = F.count_if(F.coalesce("_gone", F.lit(False)))
        one = rows.select(key).join(gone, key, "left").agg(hit.alias("erased"), (F.count(F.lit(1)) - hit).alias("kept")).select(F.lit(name).alias("name"), "erased", "kept")
        out = one if out is None else out.unionByName(one)
    return out


def savings_recorded(events: DataFrame, offers: DataFrame, current: Column) -> DataFrame:
    """Saving of each add (user_id, product_id, ts): dearest less cheapest current offer, of products with two of them."""
    price = F.when(current, F.col("price_bani"))
    gap = offers.groupBy("product_id").agg((F.max(price) - F.min(price)).alias("saved_bani"), F.count_if(current).alias("n")).where("n >= 2").drop("n")
    return events.join(gap, "product_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("adds"), F.sum("saved_bani").alias("saved_bani"))


def rate_limited(events: DataFrame, most: int, minutes: int = 60) -> DataFrame:
    """(key, window start) with more than ``most`` calls in a fixed window; (user_id, ts)."""
    start = F.window("ts", f"{minutes} minutes")["start"]
    return events.groupBy("user_id", start.alias("window_start")).agg(F.count(F.lit(1)).alias("calls")).where(F.col("calls") > most)


def leaderboard(events: DataFrame, limit: int = 50) -> DataFrame:
    """Users by views and purchases together."""
    rows = events.where(F.col("event_type").isin("view", "purchase")).groupBy("user_id")
    return rows.agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_id").limit(limit)


def pending_rank(pending: DataFrame, limit: int = 20) -> DataFrame:
    """Review queue: the top six times ``limit`` by score, then by value; (id, score_bp, merchants, spread_bani)."""
    top = pending.orderBy(F.desc("score_bp"), "id").limit(limit * 6)
    value = F.when(F.col("merchants") == 1, 10000).otherwise(0) + F.floor(F.lit(2000) / (F.col("merchants") + 1)) + F.least(S.half_up(F.col("spread_bani") / 10), F.lit(1000)) + F.floor(F.col("score_bp") / 100)
    rows = top.withColumn("value", value.cast("long"))
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("value"), "id")  # at most six times limit rows
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("id", "value", "place")
