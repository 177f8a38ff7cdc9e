"""Structured Streaming forms of batch operators; each gives its batch twin's result."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WATERMARK = "2 days"


def daily_low_stream(history: DataFrame) -> DataFrame:
    """Lowest price of a product per day (batch: ``listings.daily_low``)."""
    rows = history.withWatermark("recorded_at", WATERMARK).groupBy("product_id", F.window("recorded_at", "1 day"))
    return rows.agg(F.min("price_bani").alias("low_bani")).select("product_id", F.col("window.start").cast("date").alias("day"), "low_bani")


def calls_per_window(events: DataFrame, minutes: int = 60) -> DataFrame:
    """Calls per user and fixed window (batch: ``users.rate_limited`` before its limit)."""
    rows = events.withWatermark("ts", WATERMARK).groupBy("user_id", F.window("ts", f"{minutes} minutes"))
    return rows.agg(F.count(F.lit(1)).alias("calls")).select("user_id", F.col("window.start").alias("window_start"), "calls")


def deduplicated(items: DataFrame, keys: list[str], time: str) -> DataFrame:
    """First row of each key within the watermark."""
    return items.withWatermark(time, WATERMARK).dropDuplicatesWithinWatermark(keys)


def changes_stream(observations: DataFrame) -> DataFrame:
    """Observations whose price differs from the offer's previous one (batch: ``series.appended_on_change``).

    State is the last price of each (product, merchant); rows of a micro-batch
    are taken in time order.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["recorded_at", "ord", "line"], kind="stable")
        last = state.get[0] if state.exists else None
        before = rows["price_bani"].shift(1)
        if last is not None and len(rows):
            before.iloc[0] = last
        changed = rows[before.isna() | (before != rows["price_bani"])]
        state.update((int(rows["price_bani"].iloc[-1]),))
        yield changed[["product_id", "merchant_id", "recorded_at", "price_bani"]]

    rows = observations.select("product_id", "merchant_id", "recorded_at", "ord", "line", "price_bani")
    return rows.groupBy("product_id", "merchant_id").applyInPandasWithState(
        run, "product_id long, merchant_id long, recorded_at timestamp, price_bani long", "last long", "append", GroupStateTimeout.NoTimeout
    )


def shopping_trips(events: DataFrame, hours: int = 12) -> DataFrame:
    """Trips of a user: events less than ``hours`` apart; (user_id, ts); the same plan works on a batch frame."""
    rows = events.withWatermark("ts", WATERMARK) if events.isStreaming else events
    out = rows.groupBy("user_id", F.session_window("ts", f"{hours} hours")).agg(F.count(F.lit(1)).alias("events"))
    return out.select("user_id", F.col("session_window.start").alias("started"), "events")


def first_seen(items: DataFrame, keys: list[str], time: str, days: int = 14) -> DataFrame:
    """First row of each key, kept in state for ``days``; one not seen for longer counts as new."""
    return items.withWatermark(time, f"{days} days").dropDuplicatesWithinWatermark(keys)


def cooled_down(hits: DataFrame, hours: int = 20) -> DataFrame:
    """Hits (user_id, product_id, ts) that may fire: none of the same watch fired within ``hours`` before.

    State is the time of the last one fired.  ``cooled_down_batch`` is its twin.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        fired = _fired(pd.concat(list(frames)).sort_values("ts", kind="stable"), last, hours)
        if len(fired):
            state.update((int(fired["ts"].iloc[-1].value // 1000),))
        yield fired

    rows = hits.select("user_id", "product_id", "ts")
    return rows.groupBy("user_id", "product_id").applyInPandasWithState(
        run, "user_id long, product_id long, ts timestamp", "last long", "append", GroupStateTimeout.NoTimeout
    )


def _fired(rows: pd.DataFrame, last: pd.Timestamp | None, hours: int) -> pd.DataFrame:
    keep = []
    for ts in rows["ts"]:
        keep.append(last is None or ts - last >= pd.Timedelta(hours=hours))
        last = ts if keep[-1] else last
    return rows[keep]


def cooled_down_batch(hits: DataFrame, hours: int = 20) -> DataFrame:
    """``cooled_down`` over a whole table: a watch's hits in time order, one fold per watch inside the JVM."""
    times = F.array_sort(F.collect_list("ts"))
    gap = F.expr(f"interval {hours} hours")
    none = F.array().cast("array<timestamp>")
    fold = F.aggregate("t", none, lambda out, x: F.when((F.size(out) == 0) | (x >= F.try_element_at(out, F.lit(-1)) + gap), F.concat(out, F.array(x))).otherwise(out))
    rows = hits.select("user_id", "product_id", F.col("ts").cast("timestamp").alias("ts")).groupBy("user_id", "product_id").agg(times.alias("t"))
    return rows.select("user_id", "product_id", F.explode(fold).alias("ts"))
