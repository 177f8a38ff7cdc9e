"""Queries of the price-intelligence operators over the driver's tables, with SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom import constants as C
from marketloom.functions import prices
from marketloom.functions import scalars as S
from marketloom.operators import audits, baskets, listings, matching, predicates, quality, series, taxonomy, users
from marketloom.sources import bind
from marketloom.sources.bind import MAX_AGE_DAYS, Tables, now

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE_SQL: dict[str, str] = {}
#: modules that register further queries
_PARTS = ("catalog_changes", "catalog_gates", "catalog_pages", "catalog_rules", "catalog_shopping", "catalog_stats")
FLAGSHIP = "biggest_spreads"


def _query(name: str, build: Callable[[Tables], DataFrame], sql: str | None = None, bound: bool = True) -> None:
    """Register a query; ``bound`` puts the derived frames before its SQL."""
    _QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
    if sql is not None:
        _ORACLE_SQL[name] = (bind.SQL if bound else "") + sql


def _is_current() -> F.Column:
    return predicates.is_current(now(), MAX_AGE_DAYS)


def _summary(t: Tables) -> DataFrame:
    return listings.product_summary(t.placed, _is_current())


CURRENT_SQL = """(availability = 'in stock' AND NOT is_stale AND NOT aggregator AND NOT flagged AND active
  AND NOT coalesce(promo_valid_to < TIMESTAMP '2001-11-05', false) AND recorded_at >= TIMESTAMP '2001-11-05' - INTERVAL 730 DAY)"""
SUMMARY_SQL = f"""SELECT product_id, coalesce(min(price_bani) FILTER ({CURRENT_SQL}), 0) AS lowest_bani, coalesce(max(price_bani) FILTER ({CURRENT_SQL}), 0) AS highest_bani,
  coalesce(max(price_bani) FILTER ({CURRENT_SQL}) - min(price_bani) FILTER ({CURRENT_SQL}), 0) AS savings_bani, count(*) FILTER ({CURRENT_SQL}) AS offer_count,
  count(*) - count(*) FILTER ({CURRENT_SQL}) AS stale_count, count(*) FILTER ({CURRENT_SQL}) > 0 AS has_current FROM placed GROUP BY product_id"""
LOW_SQL = "SELECT product_id, CAST(recorded_at AS DATE) AS day, min(price_bani) AS low_bani FROM history {where} GROUP BY 1, 2"
DROP_SQL = """SELECT product_id, CASE WHEN count(*) >= 2 THEN CAST(floor((max(low_bani) - arg_max(low_bani, day)) * 10000 / max(low_bani) + 0.5) AS BIGINT) ELSE 0 END AS drop_bp, count(*) AS days FROM low GROUP BY product_id"""
SIGNALS_SQL = (
    ", low AS (" + LOW_SQL.format(where="WHERE recorded_at >= TIMESTAMP '2001-11-05' - INTERVAL 730 DAY") + "), drops AS (" + DROP_SQL + f"""),
  live AS (SELECT product_id, min(price_bani) FILTER ({CURRENT_SQL}) AS lo, max(price_bani) FILTER ({CURRENT_SQL}) AS hi, count(*) FILTER ({CURRENT_SQL}) AS live FROM placed WHERE NOT is_stale GROUP BY product_id),
  signals AS (SELECT product_id, live, CASE WHEN live >= 2 THEN CAST(floor((hi - lo) * 10000 / hi + 0.5) AS BIGINT) ELSE 0 END AS spread_bp, coalesce(drop_bp, 0) AS drop_bp FROM live LEFT JOIN drops USING (product_id))
"""
)


def _history_since(days: int) -> F.Column:
    return now() - F.expr(f"interval {days} days")


def _signals(t: Tables) -> DataFrame:
    return listings.product_signals(t.placed, _is_current(), t.history, _history_since(MAX_AGE_DAYS))


_query("current_offers", lambda t: t.current.select("product_id", "merchant_id", "price_bani"), "SELECT product_id, merchant_id, price_bani FROM cur")
_query("product_summary", _summary, SUMMARY_SQL)
_query(
    "biggest_spreads",
    lambda t: listings.biggest_spreads(t.current),
    """, shop AS (SELECT product_id, category_id, merchant_id, min(price_bani) AS p FROM cur GROUP BY ALL),
  gap AS (SELECT product_id, category_id, min(p) AS lo, max(p) AS hi, count(*) AS shops, max(p) - min(p) AS spread_bani FROM shop GROUP BY product_id, category_id),
  ok AS (SELECT *, row_number() OVER (PARTITION BY category_id ORDER BY spread_bani DESC, product_id) AS rn FROM gap
    WHERE shops >= 2 AND hi > lo AND hi / lo::DOUBLE - 1 <= CASE WHEN shops = 2 THEN 0.5 ELSE 0.7 END)
  SELECT product_id, category_id, lo, hi, shops, spread_bani FROM ok WHERE rn <= 2 ORDER BY spread_bani DESC, product_id LIMIT 12""",
)
_query("daily_low", lambda t: listings.daily_low(t.history), LOW_SQL.format(where=""))
_query("drop_pct", lambda t: listings.drop_pct(listings.daily_low(t.history)), ", low AS (" + LOW_SQL.format(where="") + ") " + DROP_SQL)
_query("product_signals", _signals, SIGNALS_SQL + "SELECT *, greatest(spread_bp, drop_bp) AS deal_score_bp FROM signals")
_query(
    "deals",
    lambda t: listings.deals(t.placed, _is_current(), t.history, _history_since(MAX_AGE_DAYS)),
    SIGNALS_SQL + f""", summary AS ({SUMMARY_SQL})
  SELECT product_id, greatest(spread_bp, drop_bp) AS deal_score_bp, lowest_bani, highest_bani, CAST(floor(savings_bani * 10000 / highest_bani + 0.5) AS BIGINT) AS savings_bp
  FROM signals JOIN summary USING (product_id) WHERE live >= 2 AND greatest(spread_bp, drop_bp) >= 800 AND offer_count >= 2 ORDER BY deal_score_bp DESC, product_id LIMIT 60""",
)
_query(
    "price_story",
    lambda t: listings.price_story(t.history, _summary(t), now()),
    f""", summary AS ({SUMMARY_SQL}), seen AS (SELECT product_id, min(recorded_at) AS f, count(*) AS points, min(price_bani) AS low, max(price_bani) AS high FROM history GROUP BY 1),
  k AS (SELECT seen.*, lowest_bani AS c, date_sub('day', f, TIMESTAMP '2001-11-05') AS d FROM seen LEFT JOIN summary USING (product_id)),
  n AS (SELECT *, CASE WHEN coalesce(c, 0) <= 0 THEN 'no-price' WHEN d < 14 THEN 'too-new' WHEN points = 1 THEN 'unchanged' ELSE 'story' END AS kind FROM k),
  f AS (SELECT *, coalesce(kind = 'story' AND c - low <= 0.02::DOUBLE * low, false) AS at_low, kind = 'story' AND points >= 3 AS trend FROM n)
  SELECT product_id, kind, d AS observed_days, points, low, high, at_low, at_low AND trend AND high > low AS good_time, trend AS can_draw_trend FROM f""",
)
_query(
    "category_listing",
    lambda t: listings.category_listing(t.current),
    "SELECT category_id, count(DISTINCT product_id) AS products, count(DISTINCT merchant_id) AS shops, min(price_bani) AS from_bani FROM cur GROUP BY 1",
)
_query(
    "class_equivalents",
    lambda t: listings.class_equivalents(t.current),
    """, r AS (SELECT class_id, product_id, merchant_id, unit_size, min(price_bani) AS bani FROM cur WHERE class_id IS NOT NULL GROUP BY ALL),
  u AS (SELECT class_id, product_id, merchant_id, bani, CASE WHEN unit_size > 0 THEN CAST(floor(bani / unit_size + 0.5) AS BIGINT) END AS per_unit_bani FROM r)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY nullif(per_unit_bani, 0) NULLS LAST, bani, product_id, merchant_id) AS place FROM u) WHERE place <= 12""",
)
_query(
    "count_stats",
    lambda t: listings.count_stats(t.offer, t.current),
    """, s AS (SELECT product_id, class_id, count(DISTINCT merchant_id) AS n FROM cur GROUP BY ALL), c AS (SELECT class_id, count(DISTINCT merchant_id) AS m FROM cur WHERE class_id IS NOT NULL GROUP BY 1)
  SELECT (SELECT count(*) FROM s) AS products, (SELECT count(*) FROM s WHERE n >= 2) AS comparable, (SELECT count(*) FROM s LEFT JOIN c USING (class_id) WHERE n >= 2 OR coalesce(m, 0) >= 2) AS comparable_or_equivalent,
  (SELECT count(*) FROM cur) AS offers, (SELECT count(DISTINCT merchant_id) FROM cur) AS chains, (SELECT count(*) FROM offer) AS all_offers""",
)
_query(
    "comparability",
    lambda t: listings.comparability(t.current),
    """, s AS (SELECT section, product_id, count(DISTINCT merchant_id) AS n FROM cur GROUP BY ALL)
  SELECT section, count(*) AS products, count(*) FILTER (n >= 2) AS at_least_2, count(*) FILTER (n >= 3) AS at_least_3, count(*) FILTER (n >= 4) AS at_least_4 FROM s GROUP BY 1""",
)
_query(
    "price_depth",
    lambda t: listings.price_depth(t.current),
    """, s AS (SELECT section, product_id, count(DISTINCT merchant_id) AS n FROM cur GROUP BY ALL)
  SELECT section, least(n, 5) AS depth, count(*) AS products FROM s GROUP BY 1, 2 UNION ALL SELECT NULL, NULL, count(*) FROM s""",
)
_LADDER = [
    ("active", lambda: F.col("active")), ("shelf", lambda: ~F.col("aggregator")), ("unflagged", lambda: ~F.col("flagged")),
    ("in-stock", predicates.in_stock), ("fresh", lambda: ~F.col("is_stale")), ("recent", lambda: predicates.observed_since(now(), MAX_AGE_DAYS)),
]
_LADDER_SQL = ["active", "NOT aggregator", "NOT flagged", "availability = 'in stock'", "NOT is_stale", "recorded_at >= TIMESTAMP '2001-11-05' - INTERVAL 730 DAY"]
_query(
    "offer_ladder",
    lambda t: listings.offer_ladder(t.placed, [(n, c()) for n, c in _LADDER]),
    " UNION ALL ".join(
        f"SELECT {i} AS step, '{n}' AS name, count(*) FILTER ({' AND '.join(_LADDER_SQL[:i])}) AS left_over, "
        f"count(*) FILTER ({' AND '.join(['true', *_LADDER_SQL[: i - 1]])}) - count(*) FILTER ({' AND '.join(_LADDER_SQL[:i])}) AS removed FROM placed"
        for i, (n, _) in enumerate(_LADDER, 1)
    ),
)
_query(
    "offer_census",
    lambda t: listings.offer_census(t.placed, now(), MAX_AGE_DAYS),
    """SELECT CASE WHEN NOT active THEN 'inactive' WHEN aggregator THEN 'platform' WHEN flagged THEN 'flagged' WHEN availability <> 'in stock' THEN 'out-of-stock' WHEN is_stale THEN 'stale'
  WHEN recorded_at < TIMESTAMP '2001-11-05' - INTERVAL 730 DAY THEN 'old' ELSE 'live' END AS bucket, count(*) AS offers, CAST(sum(price_bani) AS BIGINT) AS sum_bani FROM placed GROUP BY 1""",
)
_query(
    "merchant_contribution",
    lambda t: listings.merchant_contribution(t.current),
    """, o AS (SELECT product_id, merchant_id, count(*) AS offers FROM cur GROUP BY ALL), w AS (SELECT *, count(*) OVER (PARTITION BY product_id) AS shops FROM o)
  SELECT merchant_id, CAST(sum(offers) AS BIGINT) AS offers, count(*) AS products, count(*) FILTER (shops = 2) AS sole_second, count(*) FILTER (shops = 1) AS only_shop FROM w GROUP BY 1""",
)
_query(
    "category_nav",
    lambda t: listings.category_nav(t.current, t.read("region"), t.read("nation")),
    """, c AS (SELECT category_id, count(DISTINCT product_id) AS products FROM cur GROUP BY 1)
  SELECT r_name AS department, n_name AS category, coalesce(products, 0) AS products FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN c ON n_nationkey = category_id""",
)
_query(
    "platform_markup",
    lambda t: listings.platform_markup(t.placed),
    ", r AS (SELECT product_id, min(price_bani) FILTER (aggregator) AS p, min(price_bani) FILTER (NOT aggregator) AS s FROM placed GROUP BY 1), b AS (SELECT CAST(floor(p * 10000 / s::DOUBLE + 0.5) AS BIGINT) AS bp FROM r WHERE p IS NOT NULL AND s > 0) SELECT count(*) AS products, "
    + ", ".join(f"CAST(floor(quantile_cont(bp, {p / 100}) + 0.5) AS BIGINT) AS p{p}" for p in (10, 25, 50, 75, 90)) + " FROM b",
)

_MOVES = ", m AS (SELECT *, lag(price_bani) OVER (PARTITION BY product_id, merchant_id ORDER BY recorded_at, ord, line) AS before FROM history)"
_query(
    "price_moves",
    lambda t: series.price_moves(t.history, 3),
    _MOVES + """, b AS (SELECT *, CASE WHEN before > 0 THEN CAST(floor(abs(price_bani - before) * 10000 / before::DOUBLE + 0.5) AS BIGINT) END AS bp FROM m)
  SELECT merchant_id, count(*) AS points, count(*) FILTER (bp > 0) AS moves, count(*) FILTER (bp >= 300) AS big, coalesce(max(bp), 0) AS biggest_bp FROM b GROUP BY 1""",
)
_query(
    "appended_on_change",
    lambda t: series.appended_on_change(t.history).select("product_id", "merchant_id", "recorded_at", "price_bani"),
    _MOVES + " SELECT product_id, merchant_id, recorded_at, price_bani FROM m WHERE before IS NULL OR before <> price_bani",
)
_query(
    "mass_move_days",
    lambda t: series.mass_move_days(t.history, writes=10, share=0.01, jump=0.03),
    _MOVES + """, d AS (SELECT CAST(recorded_at AS DATE) AS day, count(*) AS writes, count(*) FILTER (coalesce(abs(price_bani - before) > 0.03::DOUBLE * before, false)) AS big FROM m GROUP BY 1)
  SELECT * FROM d WHERE writes >= 10 AND big > 0.01::DOUBLE * writes""",
)
_SERIES = """, basket AS (SELECT id AS product_id FROM product WHERE id <= 40), d AS (SELECT product_id, merchant_id, CAST(recorded_at AS DATE) AS day, arg_max(price_bani, (recorded_at, ord, line)) AS price FROM history JOIN basket USING (product_id) GROUP BY ALL),
  g AS (SELECT p.product_id, p.merchant_id, days.day, d.price FROM (SELECT DISTINCT product_id, merchant_id FROM d) p CROSS JOIN (SELECT DISTINCT day FROM d) days LEFT JOIN d ON d.product_id = p.product_id AND d.merchant_id = p.merchant_id AND d.day = days.day),
  f AS (SELECT *, last_value(price IGNORE NULLS) OVER (PARTITION BY product_id, merchant_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM g),
  b AS (SELECT day, product_id, min(carried) AS best FROM f WHERE carried IS NOT NULL GROUP BY 1, 2), s AS (SELECT day, count(*) AS priced, CAST(sum(best) AS BIGINT) AS total_bani FROM b GROUP BY 1)"""


def _basket_series(t: Tables) -> DataFrame:
    return series.basket_series(t.history, t.product.where("id <= 40").select(F.col("id").alias("product_id")))  # the pinned basket of 40 products


_query("index_locf", _basket_series, _SERIES + " SELECT * FROM s")
_query(
    "index_period_change",
    lambda t: series.period_change(_basket_series(t), 28),
    _SERIES + """ SELECT n.day AS day, o.day AS then_day, n.total_bani - o.total_bani AS change_bani FROM s n ASOF JOIN s o ON o.day <= n.day - 28 WHERE o.priced = n.priced""",
)
_PRIOR = """, r AS (SELECT *, first_value(price_bani) OVER w AS cur_p, row_number() OVER w AS rn FROM history WINDOW w AS (PARTITION BY product_id, merchant_id ORDER BY recorded_at DESC, ord DESC, line DESC)),
  e AS (SELECT *, min(CASE WHEN price_bani <> cur_p THEN rn END) OVER (PARTITION BY product_id, merchant_id) AS re FROM r),
  prior AS (SELECT product_id, merchant_id, any_value(cur_p) AS current_bani, least(min(price_bani) FILTER (rn >= re AND recorded_at >= TIMESTAMP '2001-11-05' - INTERVAL 730 DAY),
    arg_min(price_bani, rn) FILTER (rn >= re AND recorded_at < TIMESTAMP '2001-11-05' - INTERVAL 730 DAY)) AS prior_min_bani,
    CAST(least(730, date_sub('day', min(recorded_at), TIMESTAMP '2001-11-05')) AS BIGINT) AS coverage_days FROM e GROUP BY 1, 2)"""
_query("prior_minimum", lambda t: series.prior_minimum(t.history, now(), MAX_AGE_DAYS), _PRIOR + " SELECT * FROM prior")


def _stated(t: Tables) -> DataFrame:
    """Offers, of which those of every third shop state a 30-day figure: the price before reductions, less 2 %."""
    return t.offer.withColumn("omnibus_bani", F.when(F.col("merchant_id") % 3 == 0, S.half_up(F.col("reference_bani") * 98 / 100)))


def _verdicts(t: Tables) -> DataFrame:
    return series.discount_verdicts(_stated(t), series.prior_minimum(t.history, now(), MAX_AGE_DAYS))


_VERDICTS = (
    _PRIOR + """, d AS (SELECT o.product_id, o.merchant_id, price_bani AS p, reference_bani AS was, CASE WHEN o.merchant_id % 3 = 0 THEN CAST(floor(reference_bani * 98 / 100 + 0.5) AS BIGINT) END AS own, coverage_days,
    CASE WHEN coverage_days >= 14 THEN prior_min_bani END AS ours FROM offer o JOIN prior r ON r.product_id = o.product_id AND r.merchant_id = o.merchant_id), w AS (SELECT *, coalesce(own, ours) AS base, CASE WHEN was > p THEN was - p ELSE 0 END AS saving FROM d),
  v AS (SELECT product_id, merchant_id, CASE WHEN base IS NULL THEN 'unknown' WHEN p < base THEN 'real' WHEN saving > 0 THEN 'small' ELSE 'none' END AS verdict,
    CASE WHEN own IS NOT NULL THEN 'RETAILER' WHEN ours IS NOT NULL THEN 'OUR_HISTORY' ELSE 'NONE' END AS basis, CAST(floor(saving * 10000 / was::DOUBLE + 0.5) AS BIGINT) AS claimed_bp,
    CAST(floor(greatest(base - p, CASE WHEN base IS NULL THEN NULL ELSE 0 END) * 10000 / base::DOUBLE + 0.5) AS BIGINT) AS real_bp, coalesce(abs(own - ours) * 10000 > ours * 500, false) AS disagrees,
    coalesce(abs(own - ours) * 10000 > ours * 500, false) OR was <= p AS needs_review, ours, coverage_days FROM w)"""
)
_query("discount_verdicts", _verdicts, _VERDICTS + " SELECT * EXCLUDE (ours, coverage_days) FROM v")
_query(
    "run_collapse",
    lambda t: series.run_collapse(t.runs),
    """, r AS (SELECT *, row_number() OVER (PARTITION BY merchant ORDER BY day DESC) AS rn FROM runs WHERE written > 0),
  o AS (SELECT merchant, max(written) FILTER (rn = 1) AS newest, max(written) FILTER (rn > 1 AND rn <= 4) AS best_before FROM r WHERE rn <= 4 GROUP BY 1) SELECT * FROM o WHERE newest * 2 <= best_before""",
)
_query(
    "night_moves",
    lambda t: series.night_moves(t.runs),
    """, d AS (SELECT day, CAST(sum(written) AS BIGINT) AS written FROM runs GROUP BY 1), l AS (SELECT *, lag(written) OVER (ORDER BY day) AS before FROM d) SELECT * FROM l WHERE abs(written - before) * 5 > before""",
)
_query(
    "missing_nights",
    # every user a source of its own, which is silent on some days
    lambda t: series.missing_nights(t.read("events").select(F.col("user_id").alias("merchant"), F.to_date("ts").alias("day")).distinct()),
    """, runs1 AS (SELECT DISTINCT user_id AS merchant, CAST(ts AS DATE) AS day FROM events), s AS (SELECT merchant, min(day) AS a, max(day) AS b FROM runs1 GROUP BY 1), d AS (SELECT merchant, CAST(unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day FROM s)
  SELECT d.merchant, d.day FROM d ANTI JOIN runs1 r ON r.merchant = d.merchant AND r.day = d.day""",
)
_query(
    "restock_gap",
    lambda t: series.restock_gap(t.adds),
    """, d AS (SELECT DISTINCT user_id, product_id, CAST(ts AS DATE) AS day FROM adds), g AS (SELECT user_id, product_id, count(*) AS distinct_days, max(day) - min(day) AS span FROM d GROUP BY 1, 2)
  SELECT user_id, product_id, distinct_days, CAST(floor(span / (distinct_days - 1)::DOUBLE + 0.5) AS BIGINT) AS usual_gap_days FROM g WHERE distinct_days >= 2""",
)


def _packs(t: Tables) -> DataFrame:
    """Pack sizes over time: quantity stands for size, one observation a moment."""
    rows = t.read("lineitem").select(F.col("l_partkey").alias("product_id"), F.col("l_shipdate").alias("recorded_at"), F.col("l_quantity").alias("size"), F.col("l_extendedprice"))
    rows = rows.groupBy("product_id", "recorded_at").agg(F.min("size").alias("size"), F.min(S.half_up(F.col("l_extendedprice") * 100)).alias("price_bani"))
    return rows.where("size > 0")


_query(
    "shrinkflation",
    lambda t: series.shrinkflation(_packs(t)),
    """WITH p AS (SELECT l_partkey AS product_id, l_shipdate AS recorded_at, min(l_quantity) AS size, min(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS price_bani FROM lineitem GROUP BY 1, 2),
  l AS (SELECT *, last_value(size) OVER (PARTITION BY product_id ORDER BY recorded_at ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_size FROM p WHERE size > 0),
  o AS (SELECT *, max(CASE WHEN size <> last_size THEN recorded_at END) OVER (PARTITION BY product_id) AS other FROM l),
  g AS (SELECT product_id, count(*) AS n, arg_min(size, recorded_at) AS first_size, any_value(last_size) AS last_size, arg_min(price_bani, recorded_at) AS fb, arg_max(price_bani, recorded_at) AS lb, count(*) FILTER (recorded_at > other) AS confirmed FROM o GROUP BY 1),
  x AS (SELECT *, CAST(floor((first_size - last_size) * 10000 / first_size::DOUBLE + 0.5) AS BIGINT) AS shrink_bp, CAST(floor((lb / last_size::DOUBLE / (fb / first_size::DOUBLE) - 1) * 10000 + 0.5) AS BIGINT) AS unit_rise_bp FROM g)
  SELECT product_id, first_size, last_size, shrink_bp, unit_rise_bp FROM x WHERE n >= 3 AND shrink_bp >= 300 AND confirmed >= 2 AND unit_rise_bp >= 200""",
    bound=False,
)

_VISIBLE = "(availability = 'in stock' AND NOT flagged AND NOT is_stale AND price_bani > 0 AND NOT coalesce(promo_valid_to < TIMESTAMP '2001-11-05', false))"


def _planted(rows: DataFrame, every: int, times: int) -> DataFrame:
    """The offers, with the price of about one in ``every`` multiplied: faults to be found."""
    wrong = (F.col("product_id") * 7 + F.col("merchant_id")) % every == 0
    return rows.withColumn("price_bani", F.when(wrong, F.col("price_bani") * times).otherwise(F.col("price_bani")))


_PLANTED = "* REPLACE (CASE WHEN (product_id * 7 + merchant_id) % {every} = 0 THEN price_bani * {times} ELSE price_bani END AS price_bani)"
_query(
    "outliers",
    lambda t: quality.outliers(_planted(t.offer, 23, 3), predicates.is_visible(now())),
    f""", v AS (SELECT {_PLANTED.format(every=23, times=3)} FROM offer WHERE {_VISIBLE}), m AS (SELECT product_id, median(price_bani) AS med, count(*) AS n FROM v GROUP BY 1 HAVING count(*) >= 3)
  SELECT product_id, merchant_id, price_bani, CAST(floor(med * 2 + 0.5) AS BIGINT) AS median_x2, n FROM v JOIN m USING (product_id) WHERE abs(price_bani - med) > 0.7::DOUBLE * med""",
)
_BAG = "array_to_string(list_sort(list_distinct(string_split(lower(name), ' '))), ' ')"
_KEY = f"concat_ws('::', section, {_BAG}, concat_ws(':', unit, CAST(floor(unit_size * 1000 + 0.5) AS BIGINT)))"
_query(
    "dup_key_groups",
    lambda t: quality.duplicate_keys(t.product),
    f"SELECT {_KEY} AS dup_key, count(*) AS members, min(id) AS keep_id, max(id) AS last_id FROM product GROUP BY 1 HAVING count(*) > 1",
)
_query(
    "dedup_merge",
    lambda t: quality.merged_duplicates(t.product, t.offer),
    f""", k AS (SELECT id, min(id) OVER (PARTITION BY {_KEY}) AS keep_id FROM product)
  SELECT keep_id AS product_id, merchant_id, min(price_bani) AS price_bani, count(*) AS merged FROM offer JOIN k ON k.id = product_id GROUP BY 1, 2""",
)
_query(
    "fanout",
    # a price in whole tens of lei stands for a store item
    lambda t: quality.fan_out(t.offer.withColumn("price_bani", F.col("price_bani") - F.col("price_bani") % 1000)),
    "SELECT merchant_id, price_bani - price_bani % 1000 AS price_bani, count(DISTINCT product_id) AS products, count(DISTINCT product_id) > 8 AS over_max FROM offer GROUP BY 1, 2 HAVING count(DISTINCT product_id) > 3",
)
_query(
    "orphans",
    lambda t: quality.orphans(t.offer, t.merchant.where("active"), "merchant_id", "merchant_id").select("product_id", "merchant_id"),
    "SELECT product_id, merchant_id FROM offer WHERE NOT EXISTS (SELECT 1 FROM merchant m WHERE m.merchant_id = offer.merchant_id AND active)",
)
_query(
    "full_outer_census_diff",
    lambda t: quality.census_diff(t.placed.where("recorded_at < timestamp_ntz '2001-01-01'"), t.placed.where("recorded_at >= timestamp_ntz '2001-01-01'"), ["merchant_id"]),
    """, a AS (SELECT merchant_id, count(*) AS n FROM placed WHERE recorded_at < TIMESTAMP '2001-01-01' GROUP BY 1), b AS (SELECT merchant_id, count(*) AS n FROM placed WHERE recorded_at >= TIMESTAMP '2001-01-01' GROUP BY 1)
  SELECT coalesce(a.merchant_id, b.merchant_id) AS merchant_id, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after, coalesce(b.n, 0) - coalesce(a.n, 0) AS change FROM a FULL JOIN b ON a.merchant_id = b.merchant_id""",
)
_query(
    "invariants",
    lambda t: quality.invariants(t.placed, now(), MAX_AGE_DAYS),
    " UNION ALL ".join(
        f"SELECT '{n}' AS invariant, count(*) FILTER (NOT coalesce({c}, false)) AS violations FROM placed"
        for n, c in {
            "price-positive": "price_bani > 0",
            "old-is-stale": "is_stale OR recorded_at >= TIMESTAMP '2001-11-05' - INTERVAL 730 DAY",
            "platform-iff-aggregator": "aggregator = (merchant_id % 10 = 0)",
            "reference-above-price": "reference_bani >= price_bani",
            "unit-price-plausible": "NOT (price_bani IS NULL OR price_bani <= 0 OR (unit IN ('kg', 'l') AND unit_size < 0.05::DOUBLE) OR coalesce(floor(price_bani / unit_size + 0.5) > CASE unit WHEN 'kg' THEN 5000000 ELSE 10000000 END, false))",
            "expired-not-current": "NOT (coalesce(promo_valid_to < TIMESTAMP '2001-11-05', false) AND availability = 'in stock' AND NOT is_stale)",
        }.items()
    ),
)
_query(
    "wide_spreads",
    lambda t: quality.wide_spreads(t.current, 1),
    """SELECT product_id, min(price_bani) AS lo, max(price_bani) AS hi, count(DISTINCT merchant_id) AS shops, arg_min(merchant_id, (price_bani, merchant_id)) AS cheapest_at FROM cur GROUP BY 1 HAVING count(DISTINCT merchant_id) >= 2""",
)
_query(
    "withheld_spread",
    lambda t: quality.withheld_spread(_planted(t.current, 13, 2)),
    f""", p AS (SELECT product_id, merchant_id, CAST(floor(price_bani / unit_size + 0.5) AS BIGINT) AS ppu FROM (SELECT {_PLANTED.format(every=13, times=2)} FROM cur) WHERE unit_size > 0), l AS (SELECT *, min(ppu) OVER (PARTITION BY product_id) AS least FROM p WHERE ppu > 0) SELECT * FROM l WHERE ppu >= 2 * least""",
)
_query(
    "staleness_bands",
    lambda t: quality.staleness_bands(t.placed, now()),
    """, a AS (SELECT merchant_id, date_sub('day', recorded_at, TIMESTAMP '2001-11-05') AS d FROM placed)
  SELECT CASE WHEN d < 1 THEN 'under 1 d' WHEN d < 7 THEN '1-7 d' WHEN d < 14 THEN '7-14 d' WHEN d <= 30 THEN '14-30 d' ELSE 'over 30 d' END AS band, count(*) AS offers, count(DISTINCT merchant_id) AS merchants FROM a GROUP BY 1""",
)
_query(
    "percentile_conventions",
    lambda t: quality.pool_sizes(t.history),
    """, s AS (SELECT merchant_id, list_sort(list(price_bani)) AS s, count(*) AS n FROM history GROUP BY 1)
  SELECT merchant_id, s[((n - 1) // 2) + 1] + s[(n // 2) + 1] AS median_x2, s[(n // 2) + 1] AS median_upper, s[least(n - 1, n * 95 // 100) + 1] AS p95_pn, s[((n - 1) * 95 // 100) + 1] AS p95_qn1 FROM s""",
)


def _lines(t: Tables) -> DataFrame:
    rows = t.read("lineitem").groupBy(F.col("l_orderkey").alias("basket_id"), F.col("l_partkey").alias("product_id"))
    return rows.agg(F.sum("l_quantity").cast("long").alias("qty"))


_LINES = ", lines AS (SELECT l_orderkey AS basket_id, l_partkey AS product_id, CAST(sum(l_quantity) AS BIGINT) AS qty FROM lineitem GROUP BY 1, 2), best AS (SELECT product_id, merchant_id, min(price_bani) AS bani FROM cur GROUP BY 1, 2), priced AS (SELECT basket_id, product_id, merchant_id, qty, bani * qty AS cost FROM lines JOIN best USING (product_id))"
_TOTALS = (
    _LINES + """, g AS (SELECT basket_id, merchant_id, count(*) AS found, CAST(sum(cost) AS BIGINT) AS goods_bani FROM priced GROUP BY 1, 2), n AS (SELECT basket_id, count(*) AS lines FROM lines GROUP BY 1),
  totals AS (SELECT basket_id, merchant_id, found, lines - found AS missing, goods_bani, CASE WHEN goods_bani >= free_over THEN 0 ELSE delivery_fee END AS delivery_bani,
    goods_bani + CASE WHEN goods_bani >= free_over THEN 0 ELSE delivery_fee END AS total_bani, goods_bani >= coalesce(min_order, 0) AS meets_minimum FROM g JOIN n USING (basket_id) JOIN merchant USING (merchant_id))"""
)
_query("basket_store_totals", lambda t: baskets.store_totals(_lines(t), t.current, t.merchant), _TOTALS + " SELECT * FROM totals")
_query(
    "basket_best_single",
    lambda t: baskets.best_single(baskets.store_totals(_lines(t), t.current, t.merchant)),
    _TOTALS + " SELECT basket_id, merchant_id, total_bani FROM (SELECT *, row_number() OVER (PARTITION BY basket_id ORDER BY total_bani, merchant_id) AS rn FROM totals WHERE missing = 0 AND meets_minimum) WHERE rn = 1",
)
_query(
    "basket_split",
    lambda t: baskets.split(_lines(t), t.current, t.merchant),
    _LINES + """, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY basket_id, product_id ORDER BY cost, merchant_id) AS rn FROM priced) WHERE rn = 1),
  v AS (SELECT basket_id, merchant_id, sum(cost) AS value FROM f GROUP BY 1, 2), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY basket_id ORDER BY value DESC, merchant_id) AS rn FROM v) WHERE rn <= 3),
  m AS (SELECT p.*, row_number() OVER (PARTITION BY p.basket_id, product_id ORDER BY cost, p.merchant_id) AS rn FROM priced p SEMI JOIN k ON k.basket_id = p.basket_id AND k.merchant_id = p.merchant_id),
  g AS (SELECT basket_id, merchant_id, count(*) AS lines, CAST(sum(cost) AS BIGINT) AS goods_bani FROM m WHERE rn = 1 GROUP BY 1, 2), n AS (SELECT basket_id, count(*) AS all_lines FROM lines GROUP BY 1)
  SELECT basket_id, merchant_id, lines, goods_bani, CASE WHEN goods_bani >= free_over THEN 0 ELSE delivery_fee END AS delivery_bani, all_lines - CAST(sum(lines) OVER (PARTITION BY basket_id) AS BIGINT) AS missing
  FROM g JOIN n USING (basket_id) JOIN merchant USING (merchant_id)""",
)
_query(
    "class_pick",
    lambda t: baskets.class_pick(t.current, users.favourites_inferred(t.adds).where("distinct_days >= 2")),
    """, fav AS (SELECT DISTINCT product_id FROM (SELECT user_id, product_id, count(DISTINCT CAST(ts AS DATE)) AS d FROM adds GROUP BY 1, 2) WHERE d >= 2),
  r AS (SELECT c.*, fav.product_id IS NOT NULL AS fav, CASE WHEN unit_size > 0 THEN CAST(floor(price_bani / unit_size + 0.5) AS BIGINT) END AS ppu FROM cur c LEFT JOIN fav ON fav.product_id = c.product_id WHERE class_id IS NOT NULL),
  w AS (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY NOT fav, ppu NULLS LAST, price_bani, product_id, merchant_id) AS rn, count(*) OVER (PARTITION BY class_id) AS options FROM r)
  SELECT class_id, product_id, merchant_id, price_bani, CASE WHEN fav THEN 'FAVOURITE' WHEN options = 1 THEN 'ONLY_OPTION' ELSE 'CHEAPEST' END AS basis FROM w WHERE rn = 1""",
)
_query(
    "index_v2_per_shop",
    lambda t: baskets.index_per_shop(t.current),
    ", b AS (SELECT merchant_id, class_id, min(price_bani) AS p FROM cur WHERE class_id IS NOT NULL GROUP BY 1, 2) SELECT merchant_id, count(*) AS classes, CAST(sum(p) AS BIGINT) AS total_bani FROM b GROUP BY 1",
)


def _laddered(t: Tables) -> DataFrame:
    """All offers; every fifth shop has a ladder: 95 % of the price from 3 pieces on, 90 % from 6."""
    p = F.col("price_bani")
    rungs = F.array(*(F.struct(F.lit(q).alias("qty"), S.half_up(p * c / 100).alias("bani")) for q, c in ((3, 95), (6, 90))))
    return t.offer.withColumn("tiers", F.when(F.col("merchant_id") % 5 == 0, rungs))


_query(
    "ladder_unit_price",
    lambda t: baskets.ladder_unit_price(_laddered(t)),
    """, l AS (SELECT product_id, merchant_id, price_bani AS p, CAST(floor(price_bani * 95 / 100 + 0.5) AS BIGINT) AS a, CAST(floor(price_bani * 90 / 100 + 0.5) AS BIGINT) AS b FROM offer WHERE merchant_id % 5 = 0)
  SELECT product_id, merchant_id, p AS total_1, 3 * a AS total_3, 6 * b AS total_6 FROM l WHERE a < p AND b < a AND b >= p * 0.4::DOUBLE""",
)
_query(
    "smeared_ladders",
    lambda t: baskets.smeared_ladders(t.offer),
    "SELECT merchant_id, price_bani - price_bani % 500 AS rung, count(*) AS offers, count(DISTINCT price_bani) AS bases FROM offer GROUP BY 1, 2 HAVING count(*) >= 5 AND count(DISTINCT price_bani) >= 2",
)

_query("vocabulary", lambda t: matching.vocabulary(t.product), ", w AS (SELECT DISTINCT id, unnest(string_split(lower(name), ' ')) AS token FROM product) SELECT token, count(*) AS products FROM w WHERE token <> '' GROUP BY 1")
_query("head_noun_freq", lambda t: matching.head_noun_frequency(t.product), "SELECT string_split(lower(name), ' ')[1] AS head, count(*) AS products FROM product GROUP BY 1")
_CANDIDATES = """, c AS (SELECT a.id, b.id AS other_id FROM product a JOIN product b ON a.section = b.section AND a.unit = b.unit AND string_split(lower(a.name), ' ')[1] = string_split(lower(b.name), ' ')[1] AND a.id <> b.id
  AND abs(a.unit_size - b.unit_size) <= 0.06::DOUBLE * a.unit_size + 1e-9::DOUBLE WHERE a.unit_size > 0 AND b.unit_size > 0)"""
_query("structural_candidates", lambda t: matching.structural_candidates(t.product), _CANDIDATES + " SELECT * FROM c")
_query(
    "alternatives",
    lambda t: matching.alternatives(t.product, t.current),
    _CANDIDATES + """, l AS (SELECT product_id, min(price_bani) AS low FROM cur GROUP BY 1),
  r AS (SELECT c.id, other_id, low, row_number() OVER (PARTITION BY c.id ORDER BY low, a.brand = b.brand, other_id) AS place FROM c JOIN l ON l.product_id = other_id JOIN product a ON a.id = c.id JOIN product b ON b.id = other_id) SELECT * FROM r WHERE place <= 8""",
)
_query(
    "semantic_candidates",
    # the synthetic vectors are almost at right angles to each other, so a low threshold
    lambda t: matching.semantic_candidates(t.product.join(t.read("embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id"), 0.1),
    """, e AS (SELECT product.*, embedding FROM product JOIN embeddings ON vec_id = id) SELECT a.id, b.id AS other_id FROM e a JOIN e b ON a.section = b.section AND a.unit = b.unit AND a.id < b.id
  AND abs(a.unit_size - b.unit_size) <= 0.06::DOUBLE * a.unit_size + 1e-9::DOUBLE WHERE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.1::DOUBLE""",
)


_query(
    "favourites_inferred",
    lambda t: users.favourites_inferred(t.adds),
    "SELECT user_id, product_id, count(*) AS adds, count(DISTINCT CAST(ts AS DATE)) AS distinct_days, count(DISTINCT CAST(ts AS DATE)) >= 3 AS inferred FROM adds GROUP BY 1, 2",
)
_query(
    "top_added",
    lambda t: users.top_added(t.adds),
    ", u AS (SELECT user_id, product_id, least(count(*), 3) AS n FROM adds GROUP BY 1, 2) SELECT product_id, CAST(sum(n) AS BIGINT) AS adds FROM u GROUP BY 1 ORDER BY adds DESC, product_id LIMIT 50",
)
_query(
    "monthly_savings",
    lambda t: users.monthly_savings(t.read("events").select("user_id", "ts", S.half_up(F.col("value") * 100).alias("bani"))),
    "SELECT user_id, CAST(date_trunc('month', ts) AS DATE) AS month, CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS BIGINT) AS saved_bani FROM events GROUP BY 1, 2",
    bound=False,
)


def _watch(t: Tables) -> DataFrame:
    base = t.history.groupBy("product_id").agg(F.max("price_bani").alias("base_bani"))
    watch = t.adds.select("user_id", "product_id").distinct().join(base, "product_id")
    return watch.withColumn("target_bani", F.when(F.col("user_id") % 2 == 0, S.half_up(F.col("base_bani") * 95 / 100)))


_query(
    "alerts_fired",
    lambda t: users.alerts_fired(_watch(t), t.current),
    """, b AS (SELECT product_id, max(price_bani) AS base FROM history GROUP BY 1), l AS (SELECT product_id, min(price_bani) AS low FROM cur GROUP BY 1),
  w AS (SELECT a.user_id, a.product_id, base, low, CASE WHEN a.user_id % 2 = 0 THEN CAST(floor(base * 95 / 100 + 0.5) AS BIGINT) END AS tgt FROM (SELECT DISTINCT user_id, product_id FROM adds) a JOIN b USING (product_id) JOIN l USING (product_id))
  SELECT user_id, product_id, low, CASE WHEN coalesce(low <= tgt, false) THEN 'target' ELSE 'drop' END AS why FROM w WHERE coalesce(low <= tgt, false) OR low * 100 < base * 97""",
)
_query(
    "rate_limited",
    lambda t: users.rate_limited(t.read("events").select("user_id", "ts"), 1),
    "SELECT user_id, date_trunc('hour', ts) AS window_start, count(*) AS calls FROM events GROUP BY 1, 2 HAVING count(*) > 1",
    bound=False,
)
_query(
    "leaderboard",
    lambda t: users.leaderboard(t.read("events")),
    "SELECT user_id, count(*) AS n FROM events WHERE event_type IN ('view', 'purchase') GROUP BY 1 ORDER BY n DESC, user_id LIMIT 50",
    bound=False,
)

_query(
    "normalize_text",
    lambda t: t.read("documents").select("doc_id", S.normalize(F.col("text"), glue_storage=False).alias("norm")).select("doc_id", F.length("norm").alias("n"), F.md5("norm").alias("digest")),
    f"""WITH n AS (SELECT doc_id, trim(regexp_replace(lower(translate(coalesce(text, ''), '{S.FOLD_FROM}', '{S.FOLD_TO}')), '[^a-z0-9]+', ' ', 'g')) AS norm FROM documents)
  SELECT doc_id, CAST(length(norm) AS INTEGER) AS n, md5(norm) AS digest FROM n""",
    bound=False,
)
_query(
    "parse_decimal",
    lambda t: t.read("orders").select("o_orderkey", S.half_up(S.parse_decimal(F.replace(F.format_string("%.2f", F.col("o_totalprice")), F.lit("."), F.lit(","))) * 100).alias("bani")),
    "SELECT o_orderkey, CAST(floor(CAST(printf('%.2f', o_totalprice) AS DOUBLE) * 100 + 0.5) AS BIGINT) AS bani FROM orders",
    bound=False,
)
_EAN_DIGITS = "lpad(CAST(p_partkey * 7919 % 1000000000000 AS VARCHAR), 12, '0') || CAST(p_partkey % 10 AS VARCHAR)"
_query(
    "ean_valid",
    lambda t: t.read("part").select("p_partkey", S.ean_ok(F.concat(F.lpad((F.col("p_partkey") * 7919 % 1000000000000).cast("string"), 12, "0"), (F.col("p_partkey") % 10).cast("string"))).alias("ok")),
    f"""WITH e AS (SELECT p_partkey, {_EAN_DIGITS} AS s FROM part) SELECT p_partkey, list_sum(list_transform(range(1, 14), lambda i: CAST(s[i:i] AS INTEGER) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10 = 0 AS ok FROM e""",
    bound=False,
)
_query(
    "vat_rate",
    lambda t: t.read("part").select("p_partkey", S.vat_rate_bp(S.half_up(F.col("p_retailprice") * F.when(F.col("p_partkey") % 3 == 0, 121).when(F.col("p_partkey") % 3 == 1, 111).otherwise(115)), S.half_up(F.col("p_retailprice") * 100)).cast("int").alias("rate_bp")),
    """WITH r AS (SELECT p_partkey, floor(p_retailprice * CASE p_partkey % 3 WHEN 0 THEN 121 WHEN 1 THEN 111 ELSE 115 END + 0.5) AS w, floor(p_retailprice * 100 + 0.5) AS n FROM part),
  b AS (SELECT p_partkey, (w - n) * 10000 / n AS bp FROM r) SELECT p_partkey, CASE WHEN abs(bp - 2100) <= 25 THEN 2100 WHEN abs(bp - 1100) <= 25 THEN 1100 END AS rate_bp FROM b""",
    bound=False,
)
_query(
    "deposit",
    lambda t: t.product.select("id", S.deposit_bani(F.col("unit"), F.col("unit_size"), F.lit(6)).alias("deposit_bani")),
    "SELECT id, CAST(CASE WHEN unit = 'l' AND unit_size BETWEEN 0.1::DOUBLE AND 3.0::DOUBLE THEN 300 ELSE 0 END AS BIGINT) AS deposit_bani FROM product",
)
_query(
    "url_normalize",
    lambda t: t.read("pages").select("page_id", S.normalize_url(F.col("url")).alias("url")),
    r"""SELECT page_id, CASE WHEN regexp_matches(url, '^https?://') THEN regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''),
  '([?&])(utm_[a-z]+|gclid|fbclid|msclkid|from|ref)=[^&]*', '\1', 'g'), '&+', '&', 'g'), '\?&', '?', 'g'), '[?&]+$', ''), '^(https?://)www\.', '\1'), '/$', '') END AS url FROM pages""",
    bound=False,
)

_NOW, _RECENT = "TIMESTAMP '2001-11-05'", "recorded_at >= TIMESTAMP '2001-11-05' - INTERVAL 730 DAY"
_INDEX_SQL = "(availability = 'in stock' AND NOT flagged AND NOT is_stale)"
_UNEXPIRED_SQL = f"NOT coalesce(promo_valid_to < {_NOW}, false)"
_LIVENESS = {
    "current": (_is_current, CURRENT_SQL), "live": (lambda: predicates.is_live(now(), MAX_AGE_DAYS), f"active AND NOT flagged AND {_RECENT}"),
    "index": (predicates.is_index_live, _INDEX_SQL), "meta": (lambda: predicates.is_meta_live(now(), MAX_AGE_DAYS), f"active AND {_INDEX_SQL} AND {_RECENT}"),
    "visible": (lambda: predicates.is_visible(now()), f"{_INDEX_SQL} AND price_bani > 0 AND {_UNEXPIRED_SQL}"), "listed": (predicates.is_listed, "NOT is_stale AND active"),
    "publishable": (predicates.is_publishable, "NOT flagged AND NOT aggregator"), "publishable_all": (lambda: predicates.is_publishable(True), "NOT flagged"),
}
_query(
    "liveness_counts",
    lambda t: audits.predicate_counts(t.placed, {n: p() for n, (p, _) in _LIVENESS.items()}),
    " UNION ALL ".join(f"SELECT '{n}' AS predicate, count(*) FILTER ({sql}) AS offers FROM placed" for n, (_, sql) in _LIVENESS.items()),
)
_query(
    "buyable_reasons",
    lambda t: audits.reasons_not_buyable(t.placed, predicates.why_not_buyable(now(), ["Brand#11"])),
    f"""SELECT CASE WHEN lower(brand) = 'brand#11' THEN 'blocked' WHEN flagged THEN 'anomaly' WHEN is_stale THEN 'stale' WHEN NOT {_UNEXPIRED_SQL} THEN 'expired'
  WHEN availability <> 'in stock' THEN 'stale' ELSE 'ok' END AS reason, count(*) AS offers FROM placed GROUP BY 1""",
)
_query(
    "liveness_disagreement",
    lambda t: audits.disagreement(t.placed, _is_current(), predicates.is_meta_live(now(), MAX_AGE_DAYS)),
    f"""SELECT product_id, merchant_id, CASE WHEN a THEN 'first' ELSE 'second' END AS only_in
  FROM (SELECT product_id, merchant_id, {CURRENT_SQL} AS a, ({_LIVENESS["meta"][1]}) AS b FROM placed) WHERE a <> b""",
)
_query(
    "listing_page",
    lambda t: audits.listing_page(t.current, page=2),
    """, low AS (SELECT product_id, min(price_bani) AS low_bani FROM cur WHERE class_id IS NULL GROUP BY 1),
  n AS (SELECT *, row_number() OVER (ORDER BY low_bani, product_id) AS rn, least(2, greatest(1, (count(*) OVER () + 119) // 120)) AS page FROM low)
  SELECT product_id, low_bani FROM n WHERE rn > (page - 1) * 120 AND rn <= page * 120""",
)
_query(
    "price_chart",
    lambda t: audits.price_chart(t.history),
    "SELECT product_id, CAST(recorded_at AS DATE) AS day, " + ", ".join(f"min(price_bani) FILTER (merchant_id % 3 = {i}) AS kind_{i}" for i in range(3)) + " FROM history GROUP BY 1, 2",
)
_query(
    "sitemap_chunks",
    lambda t: audits.sitemap_chunks(t.placed, predicates.is_listed()),
    "SELECT product_id // 10000 AS chunk, count(DISTINCT product_id) AS urls, min(product_id) AS first_id FROM placed WHERE NOT is_stale AND active GROUP BY 1",
)
_query(
    "merchant_provenance",
    lambda t: audits.merchant_provenance(t.placed),
    """SELECT merchant_id, count(*) AS offers, count(*) FILTER (reference_bani > price_bani) AS with_reference, count(promo_valid_to) AS with_promo,
  count(*) FILTER (flagged) AS flagged, count(*) FILTER (availability <> 'in stock') AS out_of_stock FROM placed GROUP BY 1""",
)
_query(
    "gap_analysis",
    lambda t: audits.gap_analysis(t.placed.where(~F.coalesce(_is_current(), F.lit(False))), ["merchant_id", "availability"], "price_bani"),
    f"SELECT merchant_id, availability, count(*) AS pending, list_sort(list(price_bani))[count(*) // 2 + 1] AS median_upper FROM placed WHERE NOT {CURRENT_SQL} GROUP BY ALL",
)
_query(
    "dead_streak",
    lambda t: audits.dead_streak(t.runs),
    """, n AS (SELECT *, row_number() OVER (PARTITION BY merchant ORDER BY day DESC) AS rn FROM runs)
  SELECT merchant, coalesce(min(rn) FILTER (written > 0) - 1, count(*)) AS streak FROM n WHERE rn <= 5 GROUP BY 1""",
)
_query(
    "pool_collapse",
    lambda t: audits.pool_collapse(t.runs),
    """, n AS (SELECT *, row_number() OVER (PARTITION BY merchant ORDER BY day) AS rn FROM runs),
  p AS (SELECT a.merchant, a.day, a.attempted, list_sort(list(b.attempted))[count(*) // 2 + 1] AS usual FROM n a JOIN n b ON a.merchant = b.merchant AND b.rn BETWEEN a.rn - 6 AND a.rn - 1
    AND b.day >= a.day - 14 GROUP BY a.merchant, a.day, a.attempted HAVING count(*) >= 3)
  SELECT * FROM p WHERE attempted * 100 < usual * 60""",
)
_query(
    "queue_total",
    lambda t: audits.queue_total(t.read("events")),
    """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS "new" FROM events GROUP BY 1, 2)
  SELECT *, CAST(sum("new") OVER (PARTITION BY event_type ORDER BY day) AS BIGINT) AS total FROM d""",
    bound=False,
)
_query(
    "fabricated",
    lambda t: audits.fabricated(t.placed.withColumn("price_bani", F.col("price_bani") - F.col("price_bani") % 2000)),
    """, g AS (SELECT merchant_id, price_bani - price_bani % 2000 AS price_bani, count(*) AS offers, count(DISTINCT name) AS names FROM placed GROUP BY 1, 2),
  w AS (SELECT *, CAST(sum(offers) OVER (PARTITION BY merchant_id) AS BIGINT) AS all_offers FROM g) SELECT * FROM w WHERE all_offers >= 50 AND names >= 2 AND offers * 100 > all_offers * 2""",
)
_query(
    "class_health",
    lambda t: audits.class_health(t.current),
    """, c AS (SELECT class_id, count(*) AS offers, count(DISTINCT merchant_id) AS shops, min(unit_size) AS smallest, max(unit_size) AS largest FROM cur WHERE class_id IS NOT NULL GROUP BY 1)
  SELECT * FROM c WHERE largest > 1.5::DOUBLE * smallest OR shops < 2""",
)
_query(
    "score_sweep",
    lambda t: audits.score_sweep(_signals(t)),
    SIGNALS_SQL + "SELECT k * 500 AS threshold_bp, count(*) AS products FROM signals JOIN range(11) AS r(k) ON greatest(spread_bp, drop_bp) >= k * 500 GROUP BY 1",
)
_query(
    "home_drops",
    lambda t: audits.home_drops(_signals(t)),
    SIGNALS_SQL + """, top AS (SELECT * FROM signals WHERE drop_bp > 200 ORDER BY drop_bp DESC, product_id LIMIT 24)
  SELECT product_id, drop_bp, live FROM top WHERE live >= 2 ORDER BY drop_bp DESC, product_id LIMIT 6""",
)
_query("store_list", lambda t: audits.store_list(t.current), "SELECT merchant_id, slug, count(*) AS offers, count(DISTINCT product_id) AS products FROM cur GROUP BY ALL")
_query(
    "expired_unmarked",
    lambda t: audits.expired_unmarked(t.placed, now()),
    f"SELECT merchant_id, count(*) AS offers, min(promo_valid_to) AS oldest FROM placed WHERE promo_valid_to < {_NOW} AND NOT is_stale AND availability = 'in stock' GROUP BY 1",
)
_query(
    "price_jumps",
    lambda t: audits.price_jumps(t.history, pct=108),
    """, h AS (SELECT *, lag(price_bani) OVER (PARTITION BY product_id, merchant_id ORDER BY recorded_at, ord, line) AS before FROM history)
  SELECT product_id, merchant_id, ord, line, before, price_bani, CASE WHEN price_bani * 100 > before * 108 THEN 'up' ELSE 'down' END AS way FROM h
  WHERE price_bani * 100 > before * 108 OR price_bani * 108 < before * 100""",
)
_query(
    "seeded_sample",
    lambda t: audits.seeded_sample(t.product, seed=7),
    "SELECT id, name FROM product ORDER BY md5(id || ':7'), id LIMIT 50",
)
_query(
    "pending_rank",
    lambda t: users.pending_rank(audits.pending_queue(t.current)),
    """, q AS (SELECT product_id AS id, count(DISTINCT merchant_id) AS merchants, max(price_bani) - min(price_bani) AS spread_bani, (product_id * 37) % 10000 AS score_bp FROM cur GROUP BY 1),
  top AS (SELECT * FROM q ORDER BY score_bp DESC, id LIMIT 120),
  v AS (SELECT id, CAST(CASE WHEN merchants = 1 THEN 10000 ELSE 0 END + 2000 // (merchants + 1) + least(CAST(floor(spread_bani / 10 + 0.5) AS BIGINT), 1000) + score_bp // 100 AS BIGINT) AS value FROM top),
  r AS (SELECT *, row_number() OVER (ORDER BY value DESC, id) AS place FROM v) SELECT id, value, place FROM r WHERE place <= 20""",
)
_query(
    "unit_price_order",
    lambda t: audits.unit_price_order(t.current),
    """, l AS (SELECT product_id, unit_size, min(price_bani) AS low_bani FROM cur GROUP BY 1, 2),
  p AS (SELECT product_id, low_bani, CASE WHEN unit_size > 0 THEN CAST(floor(low_bani / unit_size + 0.5) AS BIGINT) END AS per_unit_bani FROM l)
  SELECT * FROM p ORDER BY nullif(per_unit_bani, 0) NULLS LAST, low_bani, product_id LIMIT 40""",
)
_query(
    "token_coverage",
    lambda t: audits.token_coverage(matching.vocabulary(t.product)),
    """, w AS (SELECT DISTINCT id, unnest(string_split(lower(name), ' ')) AS token FROM product),
  v AS (SELECT token, count(*) AS products FROM w GROUP BY 1 ORDER BY products DESC, token LIMIT 50)
  SELECT token, products, CAST(sum(products) OVER (ORDER BY products DESC, token ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM v""",
)


_RULES = [
    ("fasteners", "hardware", "bolt", None, None), ("rods", "hardware", "rod", None, "hot"), ("gears", "machines", "gear", "large gear", None), ("rings", "jewels", "ring", None, None),
    ("hot-goods", "kitchen", "hot", "hot plate", "anvil"), ("plates", "kitchen", "plate", None, None), ("second-hand", "used", "old", None, "gizmo"), ("small-parts", "hardware", "small", "small bolt", None),
]


def _rules(t: Tables) -> DataFrame:
    """A small taxonomy of the names' words, with phrases and words to avoid."""
    return t.spark.createDataFrame(_RULES, "category string, department string, word string, phrase string, avoid string")


_RULES_SQL = ", rules(category, department, word, phrase, avoid) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in r) + ")" for r in _RULES) + ")"


def _price_text() -> F.Column:
    """A price written in six ways, some beside a reference, a date or a price per kilogram."""
    p = F.col("price_bani")
    whole, cents = F.floor(p / 100).cast("string"), F.lpad((p % 100).cast("string"), 2, "0")
    comma, dear = F.concat(whole, F.lit(","), cents), F.concat(F.floor(p / 100 + 50).cast("string"), F.lit(",00"))
    ways = [
        F.concat(comma, F.lit(" lei")), F.concat(whole, F.lit("."), cents, F.lit(" RON")), F.concat(whole, F.lit(" "), cents, F.lit(" lei")), F.concat(F.lit("Pret: "), comma, F.lit(" lei, in loc de "), dear, F.lit(" lei")),
        F.concat(comma, F.lit(" lei (valabil pana la 31.12.2001)")), F.concat(comma, F.lit(" lei  9,99 lei/kg")),
    ]
    return F.get(F.array(*ways), (F.col("product_id") % len(ways)).cast("int"))


_query(
    "category_assign",
    lambda t: taxonomy.assign_by_name(t.product, _rules(t)),
    _RULES_SQL + """, w AS (SELECT id, string_split(lower(name), ' ') AS t, lower(name) AS norm FROM product), p AS (SELECT id, t, norm, unnest(t) AS word, unnest(range(len(t))) AS pos FROM w),
  s AS (SELECT id, category, department, max(least(CASE pos WHEN 0 THEN 95 WHEN 1 THEN 90 WHEN 2 THEN 82 WHEN 3 THEN 70 ELSE 50 END + CASE WHEN coalesce(contains(norm, phrase), false) THEN 15 ELSE 0 END, 100)) AS score
    FROM p JOIN rules r ON r.word = p.word WHERE avoid IS NULL OR NOT list_contains(t, avoid) GROUP BY 1, 2, 3),
  k AS (SELECT *, count(DISTINCT department) OVER (PARTITION BY id, score) AS n, row_number() OVER (PARTITION BY id ORDER BY score DESC, category) AS rn FROM s),
  b AS (SELECT id, category, CASE WHEN n > 1 THEN least(score, 52) ELSE score END AS score FROM k WHERE rn = 1)
  SELECT *, CASE WHEN score >= 62 THEN 'AUTO' WHEN score >= 42 THEN 'REVIEW' ELSE 'NONE' END AS band FROM b""",
)
_query(
    "brand_inferred",
    lambda t: taxonomy.infer_brand(t.product, t.spark.createDataFrame([("Blue",), ("blue Bolt",), ("Cold Anvil",), ("ring",), ("Old",)], "brand string")),
    """, b(brand) AS (VALUES ('Blue'), ('blue Bolt'), ('Cold Anvil'), ('ring'), ('Old')), m AS (SELECT id, b.brand, row_number() OVER (PARTITION BY id ORDER BY len(b.brand) DESC) AS rn FROM product JOIN b ON starts_with(lower(name) || ' ', lower(b.brand) || ' '))
  SELECT id, brand FROM m WHERE rn = 1""",
)
_query(
    "class_membership",
    lambda t: taxonomy.class_members(
        t.product, t.spark.createDataFrame([(1, ["bolt"], ["old"]), (2, ["cold", "ring"], []), (3, ["anvil"], ["hot", "cold"]), (4, ["gear", "bolt"], [])], "class_id long, require array<string>, exclude array<string>")
    ),
    """, w AS (SELECT id, string_split(lower(name), ' ') AS t FROM product), r(class_id, req, exc) AS (VALUES (1, ['bolt'], ['old']), (2, ['cold', 'ring'], []), (3, ['anvil'], ['hot', 'cold']), (4, ['gear', 'bolt'], []))
  SELECT class_id, id FROM w JOIN r ON list_has_all(t, req) AND NOT list_has_any(t, exc)""",
)
_query(
    "parse_price_text",
    lambda t: t.offer.select("product_id", "merchant_id", prices.parse_price(_price_text())["bani"].alias("read_bani")),
    "SELECT product_id, merchant_id, price_bani AS read_bani FROM offer",
)
def _size_text() -> F.Column:
    """A size written in four ways: packs, packs turned round, one piece in litres, one in millilitres."""
    n, size = (F.col("id") % 7 + 2).cast("string"), F.format_number("unit_size", 1)
    litre = F.concat(size, F.lit(" l"))
    ways = [F.concat_ws(" x ", n, litre), F.concat_ws(" x ", litre, n), litre, F.concat((F.col("unit_size") * 1000).cast("int").cast("string"), F.lit("ml"))]
    return F.concat_ws(" ", "name", F.get(F.array(*ways), (F.col("id") % 4).cast("int")))


_query(
    "parse_quantity_text",
    lambda t: t.product.withColumn("q", prices.parse_quantity(_size_text())).select("id", F.col("q.unit").alias("read_unit"), F.col("q.pack_count").alias("packs"), S.half_up(F.col("q.value")).alias("read_ml")),
    """, n AS (SELECT id, unit_size, CASE WHEN id % 4 < 2 THEN id % 7 + 2 ELSE 1 END AS packs FROM product)
  SELECT id, 'ML' AS read_unit, CAST(packs AS INTEGER) AS packs, CAST(floor(packs * unit_size * 1000 + 0.5) AS BIGINT) AS read_ml FROM n""",
)


def __getattr__(name: str) -> dict:
    """QUERIES and ORACLE_SQL, complete: the parts register theirs when first asked for, so each part can be imported by itself."""
    if name not in ("QUERIES", "ORACLE_SQL"):
        raise AttributeError(name)
    for part in _PARTS:
        importlib.import_module(f"marketloom.{part}")
    return _QUERIES if name == "QUERIES" else _ORACLE_SQL
