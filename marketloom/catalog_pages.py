"""Queries of page read models and user analytics, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom import catalog
from marketloom.catalog import CURRENT_SQL, _query
from marketloom.operators import pages, predicates, users
from marketloom.sources.bind import MAX_AGE_DAYS, Tables, now

_PER = "CASE WHEN unit_size > 0 THEN CAST(floor(price_bani / unit_size + 0.5) AS BIGINT) END"
_query(
    "unit_lows",
    lambda t: pages.unit_lows(t.placed, catalog._is_current()),
    f""", p AS (SELECT product_id, {_PER} AS per, {CURRENT_SQL} AS c FROM placed) SELECT product_id, coalesce(CASE WHEN count(*) FILTER (c) > 0 THEN min(per) FILTER (c AND per > 0) ELSE min(per) FILTER (per > 0) END, 0) AS unit_low_bani FROM p GROUP BY 1""",
)
_query(
    "item_pages",
    lambda t: pages.item_pages(t.placed, catalog._is_current(), now()),
    f""", p AS (SELECT *, coalesce({CURRENT_SQL}, false) AS c FROM placed WHERE NOT flagged), r AS (SELECT *, CASE WHEN c THEN 0 WHEN NOT aggregator THEN 1 END AS r FROM p),
  b AS (SELECT product_id, merchant_id, price_bani, recorded_at, r, row_number() OVER (PARTITION BY product_id ORDER BY r, price_bani, merchant_id) AS rn FROM r WHERE r IS NOT NULL),
  s AS (SELECT product_id, count(DISTINCT merchant_id) FILTER (c) AS shops FROM p GROUP BY 1)
  SELECT s.product_id, merchant_id, price_bani, r = 0 AS is_current, shops, CASE shops WHEN 0 THEN 'no-price' WHEN 1 THEN 'single-shop' ELSE 'compared' END AS status, date_sub('hour', recorded_at, TIMESTAMP '2001-11-05') AS age_hours
  FROM s LEFT JOIN b ON b.product_id = s.product_id AND rn = 1""",
)


def _pinned(t: Tables) -> DataFrame:
    """Forty slots: the products whose ids are the first multiples of three, some of which nobody sells."""
    return t.spark.range(40).select(F.col("id").alias("slot"), (F.col("id") * 3).alias("product_id"))


_query(
    "basket_staples",
    lambda t: pages.staples(_pinned(t), t.current),
    """, l AS (SELECT product_id, merchant_id, min(price_bani) AS low_bani FROM cur GROUP BY 1, 2), s AS (SELECT range AS slot, range * 3 AS product_id FROM range(40))
  SELECT slot, s.product_id, merchant_id, low_bani FROM s LEFT JOIN l ON l.product_id = s.product_id""",
)
_query(
    "index_change_within",
    lambda t: pages.change_within(catalog._basket_series(t), 365),
    catalog._SERIES + """, z AS (SELECT max(day) AS d FROM s), z1 AS (SELECT s.* FROM s JOIN z ON day = d), z2 AS (SELECT s.* FROM s, z WHERE day >= d - 365 AND day < d), z0 AS (SELECT * FROM z2 WHERE day = (SELECT min(day) FROM z2))
  SELECT z0.day AS from_day, z1.day AS to_day, z1.total_bani - z0.total_bani AS change_bani FROM z0 JOIN z1 ON z0.priced = z1.priced""",
)
_query(
    "discount_rows",
    lambda t: pages.discount_rows(t.current, catalog._verdicts(t)),
    catalog._VERDICTS + """ SELECT v.product_id, v.merchant_id, price_bani, real_bp, basis FROM v JOIN cur c ON c.product_id = v.product_id AND c.merchant_id = v.merchant_id
  WHERE verdict = 'real' AND NOT needs_review ORDER BY real_bp DESC, v.product_id, v.merchant_id LIMIT 50""",
)
_query(
    "class_opportunities",
    lambda t: pages.class_opportunities(t.current),
    """, r AS (SELECT string_split(lower(name), ' ')[1] AS noun, unit, CAST(floor(ln(unit_size) / ln(1.25::DOUBLE)) AS BIGINT) AS bucket, product_id, merchant_id, price_bani / unit_size AS per FROM cur WHERE class_id IS NULL AND unit_size > 0),
  g AS (SELECT noun, unit, bucket, count(DISTINCT product_id) AS members, count(DISTINCT merchant_id) AS shops FROM r GROUP BY 1, 2, 3 HAVING count(DISTINCT product_id) >= 2 AND count(DISTINCT merchant_id) >= 2 AND max(per) < 2.0::DOUBLE * min(per)),
  o AS (SELECT *, members * shops AS score, row_number() OVER (PARTITION BY noun ORDER BY members * shops DESC, unit, bucket) AS rn FROM g) SELECT noun, unit, bucket, members, shops, score FROM o WHERE rn <= 3""",
)


def _classes(t: Tables) -> DataFrame:
    """A class per name, unit and size among the classed products."""
    named = t.product.where("class_id is not null").groupBy(F.col("name").alias("class_name"), "unit", F.col("unit_size").alias("size"))
    return named.agg(F.min("id").alias("class_id"))


_query(
    "class_proposals",
    lambda t: pages.class_proposals(t.product, _classes(t)),
    """, k AS (SELECT name, unit, unit_size AS size, min(id) AS class_id FROM product WHERE class_id IS NOT NULL GROUP BY 1, 2, 3), q AS (SELECT id, unit, unit_size, string_split(lower(name), ' ') AS w FROM product WHERE class_id IS NULL),
  m AS (SELECT q.id, k.class_id, CAST(floor(len(list_intersect(q.w, string_split(lower(k.name), ' '))) / len(list_distinct(list_concat(q.w, string_split(lower(k.name), ' '))))::DOUBLE * 10000 + 0.5) AS BIGINT) AS score_bp
    FROM q JOIN k ON q.unit = k.unit AND list_contains(q.w, string_split(lower(k.name), ' ')[1]) AND abs(q.unit_size - k.size) <= 0.26::DOUBLE * k.size + 1e-9::DOUBLE)
  SELECT id, class_id, score_bp FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score_bp DESC, class_id) AS rn FROM m WHERE score_bp >= 3400) WHERE rn = 1""",
)
_query(
    "index_by_class",
    lambda t: pages.index_by_class(t.placed.where("availability = 'in stock'")),
    """, p AS (SELECT class_id, merchant_id, min(price_bani) AS p FROM placed WHERE availability = 'in stock' AND class_id IS NOT NULL AND NOT aggregator GROUP BY 1, 2)
  SELECT class_id, count(*) AS shops, min(p) AS best_bani, arg_min(merchant_id, (p, merchant_id)) AS best_at, max(p) AS dearest_bani FROM p GROUP BY 1""",
)
_query(
    "personal_deals",
    lambda t: pages.personal_deals(catalog._signals(t), t.product, t.adds.select("user_id", "product_id").distinct()),
    catalog.SIGNALS_SQL + """, fav AS (SELECT DISTINCT user_id, product_id FROM adds), k AS (SELECT DISTINCT user_id, category_id FROM fav JOIN product ON id = product_id),
  r AS (SELECT k.user_id, s.product_id, greatest(spread_bp, drop_bp) AS deal_score_bp FROM signals s JOIN product p ON p.id = s.product_id JOIN k ON k.category_id = p.category_id
    WHERE NOT EXISTS (SELECT 1 FROM fav f WHERE f.user_id = k.user_id AND f.product_id = s.product_id))
  SELECT user_id, place, product_id, deal_score_bp FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY deal_score_bp DESC, product_id) AS place FROM r) WHERE place <= 10""",
)


def _lows(t: Tables) -> DataFrame:
    return t.current.groupBy("product_id").agg(F.min("price_bani").alias("low_bani"))


def _pushed(t: Tables) -> DataFrame:
    """Even users were told of their products before, every third product at half its price now."""
    low = _lows(t).withColumn("pushed_bani", F.when(F.col("product_id") % 3 == 0, F.floor(F.col("low_bani") / 2)).otherwise(F.col("low_bani") + 1).cast("long"))
    return t.adds.where("user_id % 2 = 0").select("user_id", "product_id").distinct().join(low, "product_id")


_FAV_LOW = catalog.SIGNALS_SQL + ", fav AS (SELECT DISTINCT user_id, product_id FROM adds), low1 AS (SELECT product_id, min(price_bani) AS low_bani FROM cur GROUP BY 1)"
_query(
    "pushes_due",
    lambda t: users.pushes_due(t.adds, catalog._signals(t), _lows(t), _pushed(t), 1),
    _FAV_LOW + " SELECT user_id, fav.product_id, low_bani FROM fav JOIN signals s ON s.product_id = fav.product_id AND drop_bp >= 100 JOIN low1 ON low1.product_id = fav.product_id WHERE NOT (user_id % 2 = 0 AND fav.product_id % 3 = 0)",
)
_query(
    "digest",
    lambda t: users.digest(t.adds, catalog._signals(t)),
    _FAV_LOW + """, r AS (SELECT user_id, fav.product_id, drop_bp, row_number() OVER (PARTITION BY user_id ORDER BY drop_bp DESC, fav.product_id) AS place FROM fav JOIN signals s ON s.product_id = fav.product_id WHERE drop_bp > 0)
  SELECT user_id, place, product_id, drop_bp FROM r WHERE place <= 5""",
)
_query("favourites_toggled", lambda t: users.toggled(t.adds), "SELECT user_id, product_id FROM adds GROUP BY 1, 2 HAVING count(*) % 2 = 1")
_query(
    "votes_corroborated",
    lambda t: users.corroborated(t.adds.select("user_id", (F.col("product_id") % 12).alias("a"), (F.col("user_id") % 12).alias("b"))),
    """, v AS (SELECT user_id, least(product_id % 12, user_id % 12) AS a, greatest(product_id % 12, user_id % 12) AS b FROM adds WHERE product_id % 12 <> user_id % 12)
  SELECT a, b, count(DISTINCT user_id) AS users FROM v GROUP BY 1, 2 HAVING count(DISTINCT user_id) >= 2""",
)
_query(
    "budgets",
    lambda t: users.budgets(t.read("events").select("user_id", "ts", "event_id", F.floor(F.col("value") * 100).cast("long").alias("bani"))),
    "SELECT user_id, CAST(date_trunc('month', ts) AS DATE) AS month, arg_max(CAST(floor(value * 100) AS BIGINT), (ts, event_id)) AS budget_bani FROM events GROUP BY 1, 2",
    bound=False,
)
_query(
    "account_erasure",
    lambda t: users.erased(t.read("events").select("user_id").where("user_id % 10 = 3"), {"adds": t.adds, "events": t.read("events")}),
    "SELECT 'adds' AS name, count(*) FILTER (user_id % 10 = 3) AS erased, count(*) FILTER (user_id % 10 <> 3) AS kept FROM adds UNION ALL SELECT 'events', count(*) FILTER (user_id % 10 = 3), count(*) FILTER (user_id % 10 <> 3) FROM events",
)
_query(
    "savings_recorded",
    lambda t: users.savings_recorded(t.adds, t.placed, catalog._is_current()),
    f""", g AS (SELECT product_id, max(price_bani) FILTER ({CURRENT_SQL}) - min(price_bani) FILTER ({CURRENT_SQL}) AS saved FROM placed GROUP BY 1 HAVING count(*) FILTER ({CURRENT_SQL}) >= 2)
  SELECT user_id, count(*) AS adds, CAST(sum(saved) AS BIGINT) AS saved_bani FROM adds JOIN g USING (product_id) GROUP BY 1""",
)


def _watch_fired(t: Tables) -> DataFrame:
    """Watches of which every third user's fired ten hours ago."""
    return catalog._watch(t).withColumn("last_fired", F.when(F.col("user_id") % 3 == 0, now() - F.expr("interval 10 hours")))


_query(
    "alerts_cooled",
    lambda t: users.alerts_fired(_watch_fired(t), t.current, now()),
    f"{catalog._ORACLE_SQL['alerts_fired'].removeprefix(catalog.bind.SQL).replace('WHERE coalesce(low <= tgt', 'WHERE user_id % 3 <> 0 AND (coalesce(low <= tgt').rstrip()})",
)
_query(
    "product_searchable",
    lambda t: t.placed.where(predicates.is_searchable(now(), MAX_AGE_DAYS)).groupBy("product_id").agg(F.count(F.lit(1)).alias("offers")),
    "SELECT product_id, count(*) AS offers FROM placed WHERE active AND availability = 'in stock' AND NOT flagged AND NOT is_stale AND NOT aggregator AND recorded_at >= TIMESTAMP '2001-11-05' - INTERVAL 730 DAY GROUP BY 1",
)
_query(
    "cleared_products",
    lambda t: t.product.select(F.col("id").alias("product_id")).join(t.current.select("product_id"), "product_id", "left_anti"),
    "SELECT id AS product_id FROM product WHERE id NOT IN (SELECT product_id FROM cur)",
)
