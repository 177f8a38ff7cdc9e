"""The liveness predicates: each a Column over an offer row, none of them merged.

They differ on purpose in recency, platform offers and expiry.  ``now`` is
always a parameter; null flags count as false.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketloom.functions import scalars as S


def _no(name: str) -> Column:
    return ~F.coalesce(F.col(name), F.lit(False))


def observed_since(now: Column, days: int) -> Column:
    """Seen within ``days`` before ``now``."""
    return F.col("recorded_at") >= now - F.expr(f"interval {days} days")


def in_stock() -> Column:
    return F.col("availability") == "in stock"


def unexpired(now: Column) -> Column:
    """No promotion end, or one not before ``now``."""
    return ~F.coalesce(F.col("promo_valid_to") < now, F.lit(False))


def is_current(now: Column, days: int, show_platforms: bool = False) -> Column:
    """What a shopper sees: in stock, fresh, unflagged, unexpired, recent, active, no platform price."""
    shown = in_stock() & _no("is_stale") & _no("flagged") & unexpired(now) & observed_since(now, days) & F.col("active")
    return shown if show_platforms else shown & _no("aggregator")


def is_live(now: Column, days: int) -> Column:
    """Public interface: stale and sold-out rows stay, labelled."""
    return F.col("active") & _no("flagged") & observed_since(now, days)


def is_index_live() -> Column:
    """Index v1: no recency, activity or platform condition."""
    return in_stock() & _no("flagged") & _no("is_stale")


def is_meta_live(now: Column, days: int) -> Column:
    """Counts for the metadata: platforms count, expiry is ignored."""
    return F.col("active") & is_index_live() & observed_since(now, days)


def is_visible(now: Column) -> Column:
    """Visible to the outlier test."""
    return is_index_live() & (F.col("price_bani") > 0) & unexpired(now)


def is_listed() -> Column:
    """Listed in the sitemap."""
    return _no("is_stale") & F.col("active")


def is_publishable(include_platforms: bool = False) -> Column:
    return _no("flagged") if include_platforms else _no("flagged") & _no("aggregator")


def is_displayed(now: Column, days: int, show_platforms: bool = False) -> Column:
    """``is_current`` of rows at hand: a flyer offer without a date counts, other ones without a date do not.

    Needs price_source beside the other columns; merchants are not asked.
    """
    dated = F.when(F.col("recorded_at").isNull(), F.col("price_source") == "FLYER").otherwise(observed_since(now, days))
    shown = in_stock() & _no("is_stale") & _no("flagged") & unexpired(now) & dated
    return shown if show_platforms else shown & (F.coalesce("price_source", F.lit("")) != "DELIVERY_PLATFORM")


def is_searchable(now: Column, days: int) -> Column:
    """Offers of the public search: as the metadata counts, without platforms."""
    return is_meta_live(now, days) & _no("aggregator")


def why_not_buyable(
    now: Column, blocked_brands: list[str], blocked_products: list[int] | None = None, blocked_tags: list[str] | None = None, has_cards: bool = True, columns: list[str] | None = None
) -> Column:
    """The first reason against buying, or null: blocked, anomaly, stale, expired, loyalty.

    A product is blocked by its id, its brand, or a tag that its folded name
    holds; card prices count only where ``columns`` has needs_card.
    """
    blocked = F.lower("brand").isin([b.lower() for b in blocked_brands]) if blocked_brands else F.lit(False)
    if blocked_products:
        blocked = blocked | F.col("product_id").isin(blocked_products)
    for tag in blocked_tags or []:
        blocked = blocked | F.contains(S.normalize(F.col("name"), glue_storage=False), S.normalize(F.lit(tag), glue_storage=False))
    why = (
        F.when(blocked, "blocked").when(~_no("flagged"), "anomaly").when(~_no("is_stale"), "stale")
        .when(~unexpired(now), "expired").when(~in_stock(), "stale")
    )
    if not has_cards and "needs_card" in (columns or []):
        why = why.when(~_no("needs_card"), "loyalty")
    return why
