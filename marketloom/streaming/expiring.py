"""Keyed streams whose state ends: what a key is remembered by goes when it can no longer matter.

Every processor keeps one timer per key, at the moment its state turns
meaningless in event time.  Rows older than the watermark are left out by the
engine, so no row can ask for state that has gone.  Streams need the state
store provider of ``STATE_STORE``.  Rows of a micro-batch are taken in time order;
across batches they should arrive in order, else later ones count as they come.
Each processor has a batch twin over a whole table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: session settings for these streams
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
MICROS, MILLIS = 3_600_000_000, 3_600_000


def _in_order(rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(list(by), kind="stable")


def _micros(times: pd.Series) -> list[int]:
    return times.astype("datetime64[us]").astype("int64").tolist()


class _Timed(StatefulProcessor):
    """Keeps one timer per key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def ring_at(self, millis: int | None) -> None:
        """Move the key's timer."""
        for old in list(self.handle.listTimers()):
            if old != millis:
                self.handle.deleteTimer(old)
        if millis is not None:
            self.handle.registerTimer(millis)

    def close(self) -> None:
        pass


class CoolDown(_Timed):
    """Lets a hit through when none of its key was let through within ``hours`` before."""

    def __init__(self, hours: int) -> None:
        self.hours = hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        hits = _in_order(rows, "ts")
        last = self.last.get()[0] if self.last.exists() else None
        keep = []
        for at in _micros(hits["ts"]):
            keep.append(last is None or at - last >= self.hours * MICROS)
            last = at if keep[-1] else last
        self.last.update((last,))
        self.ring_at(last // 1000 + self.hours * MILLIS)
        yield hits[keep]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame()


class LastPrices(_Timed):
    """Lets an observation through when its price differs from the offer's last one, of at most ``days`` before.

    A key is a bucket of offers: their observations are compared at once, and their
    last prices are one list, read and written once a micro-batch.
    """

    def __init__(self, days: int) -> None:
        self.hours = 24 * days

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getListState("last", "product_id long, merchant_id long, price_bani long, at long")

    def _keep(self, rows: list[tuple]) -> None:
        self.last.put(rows) if rows else self.last.clear()
        self.ring_at(min(r[3] for r in rows) // 1000 + self.hours * MILLIS + 1 if rows else None)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        offer, known = ["product_id", "merchant_id"], list(self.last.get()) if self.last.exists() else []
        seen = _in_order(rows, "recorded_at", "ord", "line")
        seen["at"] = _micros(seen["recorded_at"])
        old = pd.DataFrame(known, columns=[*offer, "price_bani", "at"]).astype("int64")
        both = pd.concat([old.assign(old=True), seen.assign(old=False)]).sort_values(offer, kind="stable")
        before = both[[*offer, "price_bani", "at"]].shift()
        first = (both[offer] != before[offer]).any(axis=1)
        new = first | (both["at"] - before["at"] > self.hours * MICROS) | (both["price_bani"] != before["price_bani"])
        self._keep(list(both.loc[first.shift(-1, fill_value=True), [*offer, "price_bani", "at"]].itertuples(index=False, name=None)))
        yield both.loc[new & ~both["old"], [*offer, "recorded_at", "price_bani"]]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        self._keep([tuple(r) for r in self.last.get() if r[3] // 1000 + self.hours * MILLIS + 1 > now])
        yield pd.DataFrame()


class Ticks(_Timed):
    """Ticks an item of a user's list, or takes a tick off that is younger than ``hours``."""

    def __init__(self, hours: int) -> None:
        self.hours = hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.ticked = handle.getMapState("ticked", "item long", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        taps = _in_order(rows, "ts", "product_id")
        known = {k[0]: v[0] for k, v in self.ticked.iterator()}
        state = []
        for item, at in zip(taps["product_id"].tolist(), _micros(taps["ts"]), strict=True):
            fresh = item in known and at - known[item] < self.hours * MICROS
            state.append(not fresh)
            if fresh:
                del known[item]
                self.ticked.removeKey((item,))
            else:
                known[item] = at
                self.ticked.updateValue((item,), (at,))
        self.ring_at(min(known.values()) // 1000 + self.hours * MILLIS if known else None)
        yield taps.assign(ticked=state)[["user_id", "product_id", "ts", "ticked"]]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        known = {k[0]: v[0] for k, v in self.ticked.iterator()}
        for item in [k for k, at in known.items() if at // 1000 + self.hours * MILLIS <= now]:
            self.ticked.removeKey((item,))
            del known[item]
        if known:
            self.handle.registerTimer(min(known.values()) // 1000 + self.hours * MILLIS)
        yield pd.DataFrame()


def _run(rows: DataFrame, time: str, keys: list[str], processor: StatefulProcessor, schema: str, delay: str) -> DataFrame:
    return rows.withWatermark(time, delay).groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def cooled_down(hits: DataFrame, hours: int = 20, delay: str = "1 hour") -> DataFrame:
    """Hits (user_id, product_id, ts) that may fire: none of the same watch fired within ``hours`` before (batch: ``cooled_down_batch``)."""
    return _run(hits.select("user_id", "product_id", "ts"), "ts", ["user_id", "product_id"], CoolDown(hours), "user_id long, product_id long, ts timestamp", delay)


def price_changes(observations: DataFrame, days: int = 14, delay: str = "1 day", buckets: int = 1024) -> DataFrame:
    """Observations whose price differs from the offer's one before, or that come more than ``days`` after it (batch: ``price_changes_batch``).

    Offers are dealt over ``buckets``, whose number a checkpoint keeps for good; no column is null.
    """
    bucket = F.pmod(F.xxhash64("product_id", "merchant_id"), F.lit(buckets)).alias("bucket")
    rows = observations.select(bucket, "product_id", "merchant_id", "recorded_at", "ord", "line", "price_bani")
    return _run(rows, "recorded_at", ["bucket"], LastPrices(days), "product_id long, merchant_id long, recorded_at timestamp, price_bani long", delay)


def price_changes_batch(observations: DataFrame, days: int = 14) -> DataFrame:
    """``price_changes`` over a whole table; time, order and line decide what comes before."""
    order = Window.partitionBy("product_id", "merchant_id").orderBy("recorded_at", "ord", "line")
    rows = observations.withColumn("_was", F.lag("price_bani").over(order)).withColumn("_at", F.lag("recorded_at").over(order))
    new = F.col("_was").isNull() | (F.col("_was") != F.col("price_bani")) | (F.col("recorded_at") > F.col("_at") + F.expr(f"interval {days} days"))
    return rows.where(new).select("product_id", "merchant_id", "recorded_at", "price_bani")


def ticked_items(taps: DataFrame, hours: int = 12, delay: str = "1 hour") -> DataFrame:
    """What each tap (user_id, product_id, ts) does to the user's list: ticked true or false (batch: ``ticked_items_batch``)."""
    return _run(taps.select("user_id", "product_id", "ts"), "ts", ["user_id"], Ticks(hours), "user_id long, product_id long, ts timestamp, ticked boolean", delay)


def ticked_items_batch(taps: DataFrame, hours: int = 12) -> DataFrame:
    """``ticked_items`` over a whole table: an item's taps in time order, one fold per item inside the JVM.

    A tap ticks unless the last one ticked less than ``hours`` before.
    """
    times = F.array_sort(F.collect_list("ts"))
    gap = F.expr(f"interval {hours} hours")
    step = "struct<at:timestamp,ticked:boolean>"
    last = lambda out: F.try_element_at(out, F.lit(-1))
    fold = F.aggregate(
        "t", F.array().cast(f"array<{step}>"),
        lambda out, x: F.concat(out, F.array(F.struct(x.alias("at"), F.coalesce(~(last(out)["ticked"] & (x < last(out)["at"] + gap)), F.lit(True)).alias("ticked")).cast(step))),
    )
    rows = taps.select("user_id", "product_id", F.col("ts").cast("timestamp").alias("ts")).groupBy("user_id", "product_id").agg(times.alias("t"))
    return rows.select("user_id", "product_id", F.inline(fold)).withColumnRenamed("at", "ts")
