"""Queries of statistics and stored-figure checks, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom import catalog, catalog_shopping
from marketloom.catalog import CURRENT_SQL, _query
from marketloom.operators import baskets, matching, stats
from marketloom.sources.bind import Tables


def _pending(t: Tables) -> DataFrame:
    """Every third product waits for a pair at the shop of its id modulo ten."""
    return t.product.where("id % 3 = 0").select(F.col("id").alias("product_id"), (F.col("id") % 10).alias("merchant_id"))


_query(
    "merchant_stats",
    lambda t: stats.merchant_stats(t.runs, t.placed, catalog._is_current(), _pending(t), F.lit("2024-01-31").cast("date")),
    f""", r AS (SELECT merchant, count(*) AS nights, count(*) FILTER (written = 0) AS failed, CAST(sum(written) AS BIGINT) AS written FROM runs WHERE day >= DATE '2024-01-31' - 14 GROUP BY 1),
  o AS (SELECT merchant_id, count(*) AS offers, count(*) FILTER ({CURRENT_SQL}) AS current, count(*) FILTER (is_stale) AS stale, count(*) FILTER (flagged) AS flagged FROM placed GROUP BY 1),
  q AS (SELECT id % 10 AS merchant_id, count(*) AS pending FROM product WHERE id % 3 = 0 GROUP BY 1)
  SELECT o.merchant_id, coalesce(nights, 0) AS nights, coalesce(failed, 0) AS failed, coalesce(written, 0) AS written, offers, current, stale, flagged, coalesce(pending, 0) AS pending
  FROM o LEFT JOIN r ON r.merchant = o.merchant_id LEFT JOIN q ON q.merchant_id = o.merchant_id""",
)


def _decisions(t: Tables) -> DataFrame:
    """Events as review decisions: purchases confirm, other kinds reject, clicks are undecided."""
    kind = F.when(F.col("event_type") == "purchase", "confirm").when(F.col("event_type") != "click", "reject")
    return t.read("events").select(
        kind.alias("decision"), F.concat(F.lit("rule-"), F.col("event_id") % 4).alias("reason"), (4200 + F.col("event_id") * 7 % 2000).alias("score_bp"),
        F.concat(F.lit("section-"), F.col("user_id") % 3).alias("section"), (F.col("user_id") % 5).alias("merchant_id"), F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 300).alias("rank"),
    )


_query(
    "match_stats",
    lambda t: stats.match_stats(_decisions(t)),
    """WITH d AS (SELECT event_type = 'purchase' AS yes, 'rule-' || event_id % 4 AS reason, 4200 + event_id * 7 % 2000 AS s, 'section-' || user_id % 3 AS section, CAST(user_id % 5 AS VARCHAR) AS m, CASE WHEN event_id % 3 <> 0 THEN event_id % 300 END AS r FROM events WHERE event_type <> 'click'),
  k AS (SELECT yes, 'all' AS "by", 'all' AS key FROM d UNION ALL SELECT yes, 'rule', reason FROM d UNION ALL SELECT yes, 'section', section FROM d UNION ALL SELECT yes, 'merchant', m FROM d
    UNION ALL SELECT yes, 'score', CASE WHEN s < 4600 THEN '0.42-0.46' WHEN s < 5000 THEN '0.46-0.50' WHEN s < 5400 THEN '0.50-0.54' WHEN s < 5800 THEN '0.54-0.58' ELSE '0.58+' END FROM d
    UNION ALL SELECT yes, 'rank', CASE WHEN r IS NULL THEN 'bulk' WHEN r <= 25 THEN '1-25' WHEN r <= 50 THEN '26-50' WHEN r <= 100 THEN '51-100' WHEN r <= 250 THEN '101-250' ELSE '251+' END FROM d),
  g AS (SELECT "by", key, count(*) FILTER (yes) AS confirmed, count(*) AS total FROM k GROUP BY 1, 2)
  SELECT *, CAST(floor(confirmed / total::DOUBLE * 10000 + 0.5) AS BIGINT) AS rate_bp, CASE WHEN total < 30 THEN 'not enough signal' WHEN confirmed / total::DOUBLE > 0.4 THEN 'too aggressive' WHEN confirmed / total::DOUBLE < 0.15 THEN 'working' ELSE 'not enough signal' END AS verdict FROM g""",
    bound=False,
)
_query(
    "pending_upper_bound",
    lambda t: stats.pending_upper_bound(t.current, _pending(t)),
    """, b AS (SELECT product_id, merchant_id, 1 AS have FROM cur UNION ALL SELECT id, id % 10, 0 FROM product WHERE id % 3 = 0 AND id IN (SELECT product_id FROM cur)), s AS (SELECT product_id, merchant_id, max(have) AS have FROM b GROUP BY 1, 2),
  p AS (SELECT product_id, sum(have) AS before, count(*) AS after FROM s GROUP BY 1)
  SELECT count(*) AS products, count(*) FILTER (after > before) AS gaining, count(*) FILTER (before >= 2) AS comparable_before, count(*) FILTER (after >= 2) AS comparable_after FROM p""",
)
_query(
    "truncations",
    lambda t: stats.truncations(t.runs, 4),
    "SELECT merchant, day, attempted, written, CASE WHEN written < attempted THEN 'read-less' ELSE 'cap' END AS why FROM runs WHERE written < attempted OR attempted >= 4",
)
_query(
    "derived_checks",
    # every eighth product's score is one too high
    lambda t: stats.derived_checks(catalog._signals(t).withColumn("deal_score_bp", F.col("deal_score_bp") + F.when(F.col("product_id") % 8 == 0, 1).otherwise(0))),
    catalog.SIGNALS_SQL + """SELECT 'not-negative' AS "check", count(*) FILTER (spread_bp < 0 OR drop_bp < 0) AS violations FROM signals UNION ALL SELECT 'over-whole', count(*) FILTER (greatest(spread_bp, drop_bp) > 10000) FROM signals
  UNION ALL SELECT 'score-is-larger', count(*) FILTER (product_id % 8 = 0) FROM signals UNION ALL SELECT 'spread-needs-two', count(*) FILTER (spread_bp > 0 AND live < 2) FROM signals""",
)
_query(
    "class_checks",
    lambda t: stats.class_checks(t.product, t.read("nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("category_id"))),
    """, u AS (SELECT class_id, unit, count(*) AS n, count(*) FILTER (category_id >= 20) AS x FROM product WHERE class_id IS NOT NULL GROUP BY 1, 2)
  SELECT class_id, CAST(sum(n) AS BIGINT) AS members, CAST(sum(n) - max(n) AS BIGINT) AS other_unit, CAST(sum(x) AS BIGINT) AS unplaced FROM u GROUP BY 1""",
)
_query(
    "stale_assignments",
    lambda t: stats.stale_assignments(
        t.product.select("id", "category_id", F.when(F.col("id") % 2 == 0, "rule").otherwise("person").alias("source")), t.product.select("id", (F.col("id") % 24).alias("category_id"))
    ),
    "SELECT id, category_id FROM product WHERE id % 2 = 0 AND category_id <> id % 24",
)
_query(
    "brand_gaps",
    lambda t: stats.brand_gaps(t.product.withColumn("brand", F.when(F.col("id") % 2 == 0, F.col("brand"))), matching.head_noun_frequency(t.product), 1_000_000),
    "SELECT id, string_split(lower(name), ' ')[1] AS maybe_brand FROM product WHERE id % 2 <> 0",
)


def _own_labels(t: Tables) -> DataFrame:
    """Every shop owns the label with its number's last two digits."""
    return t.merchant.select(F.col("slug").alias("owner"), F.concat(F.lit("brand "), F.col("merchant_id") % 100).alias("label"))


_query(
    "private_labels",
    lambda t: stats.private_label_owners(t.placed, _own_labels(t)),
    "SELECT product_id, min(slug) AS owner FROM placed WHERE replace(lower(brand), '#', ' ') = 'brand ' || merchant_id % 100 GROUP BY 1",
)


def _gadgets(t: Tables) -> DataFrame:
    """Products beside the next one, with codes, part numbers and models that agree in turn."""
    side = lambda p, shift: t.product.select(
        (F.col("id") - shift).alias("k"), F.concat_ws(" ", "name", "brand").alias(f"{p}_name"), F.when(F.col("id") % 2 == 0, F.col("brand")).alias(f"{p}_brand"), F.lit(None).cast("string").alias(f"{p}_ean"),
        F.concat(F.lit("mp-"), F.floor((F.col("id") - shift) / 3), F.when((F.col("id") - shift) % 3 == 0, F.lit("")).otherwise(F.lit(p))).alias(f"{p}_mpn"), F.when((F.col("id") - shift) % 5 == 0, F.lit("Model 9000")).alias(f"{p}_model"),
    )
    return side("a", 0).join(side("b", 1), "k")


_query(
    "electronics",
    lambda t: stats.match_electronics(_gadgets(t)).select("k", "reason", "confidence_bp"),
    """, a AS (SELECT id AS k, string_split(lower(name), ' ') AS w, CASE WHEN id % 2 = 0 THEN brand END AS b, len(CAST(id // 3 AS VARCHAR)) + 2 AS n FROM product),
  p AS (SELECT a.k, a.n, list_intersect(list_append(a.w, 'brand'), list_append(z.w, 'brand')) AS i, list_distinct(list_concat(list_append(a.w, 'brand'), z.w)) AS u, a.b AS ab, z.b AS zb FROM a JOIN a z ON z.k = a.k + 1),
  s AS (SELECT *, len(i) / len(u)::DOUBLE AS sim FROM p), r AS (SELECT *, CASE WHEN k % 3 = 0 AND n >= 4 THEN 'MPN_EXACT' WHEN k % 5 = 0 THEN 'MODEL_EXACT' WHEN coalesce(ab <> zb, false) THEN 'NO_MATCH' WHEN sim >= 0.8 THEN 'NAME_TIEBREAK' ELSE 'NO_MATCH' END AS reason FROM s)
  SELECT k, reason, CAST(CASE reason WHEN 'MPN_EXACT' THEN 9700 WHEN 'MODEL_EXACT' THEN 9500 WHEN 'NAME_TIEBREAK' THEN floor((0.6::DOUBLE + 0.3::DOUBLE * sim) * 10000 + 0.5) ELSE CASE WHEN coalesce(ab <> zb, false) THEN 0 ELSE floor(sim * 10000 + 0.5) END END AS BIGINT) AS confidence_bp FROM r""",
)
_query(
    "specs",
    lambda t: t.product.select("id", F.to_json(stats.specs(F.concat_ws(" ", "name", F.concat("id", F.lit(" mAh")), F.concat(F.col("id") % 9 + 10, F.lit(",5 inch")), F.lit("8 GB RAM 256gb i7")))).alias("specs")),
    """SELECT id, '{"screen":"' || id % 9 + 10 || '.5","ram":"8","storage":"256GB","cpu":"i7"' || CASE WHEN id BETWEEN 100 AND 99999 THEN ',"battery":"' || id || '"' ELSE '' END || '}' AS specs FROM product""",
)
_query(
    "names_sorted",
    lambda t: stats.sorted_names(t.product, "name", "id", 30),
    "SELECT row_number() OVER (ORDER BY name, id) AS place, id, name FROM product ORDER BY name, id LIMIT 30",
)
_query(
    "ladder_hints",
    lambda t: baskets.ladder_hints(catalog._laddered(t), F.lit(2)),
    """, l AS (SELECT product_id, merchant_id, price_bani AS p, CAST(floor(price_bani * 95 / 100 + 0.5) AS BIGINT) AS a, CAST(floor(price_bani * 90 / 100 + 0.5) AS BIGINT) AS b FROM offer WHERE merchant_id % 5 = 0)
  SELECT product_id, merchant_id, 2 AS rungs, CAST(floor((p - b) * 10000 / p::DOUBLE + 0.5) AS BIGINT) AS discount_bp, CASE WHEN 3 * a < 2 * p THEN 3 END AS hint_qty, CASE WHEN 3 * a < 2 * p THEN 2 * p - 3 * a END AS hint_saves FROM l WHERE a < p AND b < a""",
)
_query(
    "structural_pairs_wide",
    lambda t: matching.structural_candidates(t.product, 0.25),
    catalog._CANDIDATES.replace("0.06::DOUBLE", "0.25::DOUBLE") + " SELECT * FROM c",
)
_query(
    "structural_strict",
    lambda t: matching.undisputed_candidates(t.product, 0.25),
    catalog._CANDIDATES.replace("0.06::DOUBLE", "0.25::DOUBLE") + " SELECT c.* FROM c JOIN product a ON a.id = c.id JOIN product b ON b.id = other_id WHERE lower(a.name) = lower(b.name)",
)
