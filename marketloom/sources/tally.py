"""Counters of a parse, taken in the pass that writes its rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

MAX_SAMPLES, SAMPLE_CHARS = 20, 120
NULL_SHARE, UNAVAILABLE_SHARE, LEAST_SEEN = 0.05, 0.6, 20


class Untrusted(ValueError):
    """A run whose parse counters say that its source was read wrongly."""


@dataclass(frozen=True)
class Tally:
    """What a parse counted: tries, failures with up to MAX_SAMPLES of their inputs, and rows the shop itself marked unavailable."""

    label: str
    attempted: int
    nulls: int
    unavailable: int
    samples: list[str]

    @property
    def parsed(self) -> int:
        return self.attempted - self.nulls

    @property
    def null_rate(self) -> float:
        return self.nulls / self.attempted if self.attempted else 0.0

    @property
    def unavailable_rate(self) -> float:
        seen = self.attempted + self.unavailable
        return self.unavailable / seen if seen else 0.0

    @property
    def too_many_nulls(self) -> bool:
        return self.attempted >= LEAST_SEEN and self.null_rate > NULL_SHARE

    @property
    def too_many_unavailable(self) -> bool:
        return self.attempted + self.unavailable >= LEAST_SEEN and self.unavailable_rate > UNAVAILABLE_SHARE

    def checked(self) -> Tally:
        """The tally itself; raises when a rate is over its bound."""
        if self.too_many_nulls:
            raise Untrusted(f"{self.label}: {self.nulls} of {self.attempted} not parsed ({self.null_rate:.1%}), first {self.samples[:1]}")
        if self.too_many_unavailable:
            raise Untrusted(f"{self.label}: {self.unavailable} of {self.attempted + self.unavailable} unavailable ({self.unavailable_rate:.1%})")
        return self


def counters(raw: Column, value: Column, unavailable: Column) -> list[Column]:
    """Aggregates of a tally: attempted, nulls, unavailable, and one sample per slot that failed inputs hash to.

    A sample is the smallest input of its slot, so at most MAX_SAMPLES come about
    and the same rows give the same ones, however they are dealt.
    """
    out_of_stock = F.coalesce(unavailable, F.lit(False))
    failed = value.isNull() & ~out_of_stock
    text = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\s+", " "))
    shown = F.when(text == "", "(empty)").when(F.length(text) > SAMPLE_CHARS, F.concat(F.substring(text, 1, SAMPLE_CHARS), F.lit("…"))).otherwise(text)
    slot = F.pmod(F.xxhash64(text), F.lit(MAX_SAMPLES))
    samples = [F.min(F.when(failed & (slot == i), shown)).alias(f"sample_{i}") for i in range(MAX_SAMPLES)]
    return [F.count_if(~out_of_stock).alias("attempted"), F.count_if(failed).alias("nulls"), F.count_if(out_of_stock).alias("unavailable"), *samples]


class Counting:
    """A frame whose counters come with the pass that writes it.

    >>> counting = Counting(rows, "shop", F.col("raw"), F.col("bani"), F.col("sold_out"))
    >>> counting.frame.write.parquet(path)
    >>> counting.tally().checked()
    """

    def __init__(self, rows: DataFrame, label: str, raw: Column, value: Column, unavailable: Column | None = None) -> None:
        self.label, self._observed = label, Observation()
        self.frame = rows.observe(self._observed, *counters(raw, value, F.lit(False) if unavailable is None else unavailable))

    def tally(self) -> Tally:
        """The counters; waits for the first action on ``frame``."""
        return _tally(self.label, self._observed.get)


def _tally(label: str, got: dict) -> Tally:
    samples = sorted(got[f"sample_{i}"] for i in range(MAX_SAMPLES) if got[f"sample_{i}"] is not None)
    return Tally(label, got["attempted"], got["nulls"], got["unavailable"], samples)


def tallies(rows: DataFrame, by: str, raw: Column, value: Column, unavailable: Column | None = None) -> DataFrame:
    """The tally of every group of ``by``, in one aggregation: attempted, nulls, unavailable, samples, trusted."""
    made = rows.groupBy(by).agg(*counters(raw, value, F.lit(False) if unavailable is None else unavailable))
    samples = F.array_sort(F.array_compact(F.array(*(F.col(f"sample_{i}") for i in range(MAX_SAMPLES)))))
    seen = F.col("attempted") + F.col("unavailable")
    bad = ((F.col("attempted") >= LEAST_SEEN) & (F.col("nulls") > F.col("attempted") * NULL_SHARE)) | ((seen >= LEAST_SEEN) & (F.col("unavailable") > seen * UNAVAILABLE_SHARE))
    return made.select(by, "attempted", "nulls", "unavailable", samples.alias("samples"), (~bad).alias("trusted"))
