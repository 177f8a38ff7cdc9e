"""Price-comparison frames derived from the driver's relational tables.

Every frame is a plain projection or join, so filters and column choices of the
callers reach the Parquet scans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2001-11-05 00:00:00"
MAX_AGE_DAYS = 730


def now() -> Column:
    """The moment the synthetic data is looked at from."""
    return F.to_timestamp_ntz(F.lit(NOW))


@dataclass(frozen=True)
class Tables:
    """Reads tables of one folder lazily."""

    spark: SparkSession
    folder: str

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def product(self) -> DataFrame:
        """id, name, brand, section, unit, unit_size, category_id, class_id"""
        key = F.col("p_partkey")
        unit = F.when(key % 3 == 0, "kg").when(key % 3 == 1, "l").otherwise("buc")
        return self.read("part").select(
            key.alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.lower("p_type").alias("section"),
            unit.alias("unit"), (F.col("p_size") / 10.0).alias("unit_size"), (key % 25).alias("category_id"),
            F.when(key % 4 == 0, key % 40).alias("class_id"),
        )

    @property
    def merchant(self) -> DataFrame:
        """merchant_id, slug, active, aggregator, delivery_fee, free_over, min_order"""
        key = F.col("s_suppkey")
        return self.read("supplier").select(
            key.alias("merchant_id"), F.col("s_name").alias("slug"), (F.col("s_acctbal") >= 0).alias("active"), (key % 10 == 0).alias("aggregator"),
            (500 * (F.col("s_nationkey") % 4)).cast("long").alias("delivery_fee"), F.lit(20000).cast("long").alias("free_over"),
            F.when(key % 7 == 0, 5000).cast("long").alias("min_order"),
        )

    def _observed(self) -> DataFrame:
        """One row per price observation, before products are joined."""
        return self.read("lineitem").select(
            F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("merchant_id"), F.col("l_discount").alias("discount"),
            F.col("l_shipdate").alias("recorded_at"), F.col("l_orderkey").alias("ord"), F.col("l_linenumber").alias("line"),
            ((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.09)).alias("flagged"),
            ((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F")).alias("sold_out"), (F.col("l_quantity") >= 49).alias("is_stale"),
        )

    def _priced(self, observed: DataFrame) -> DataFrame:
        part = self.read("part").select(F.col("p_partkey").alias("product_id"), "p_retailprice")
        return observed.join(part, "product_id").select(
            "product_id", "merchant_id", F.floor(F.col("p_retailprice") * (1 - F.col("discount")) * 100 + 0.5).cast("long").alias("price_bani"),
            F.floor(F.col("p_retailprice") * 100 + 0.5).cast("long").alias("reference_bani"), "recorded_at", "ord", "line", "flagged",
            F.when(F.col("sold_out"), "out of stock").otherwise("in stock").alias("availability"), "is_stale",
            F.when(F.col("line") % 5 == 0, F.col("recorded_at") + F.expr("interval 400 days")).alias("promo_valid_to"),
        )

    @property
    def history(self) -> DataFrame:
        """One row per price observation of a product at a merchant."""
        return self._priced(self._observed())

    @property
    def offer(self) -> DataFrame:
        """The latest observation of every (product, merchant).

        Time, order and line make one decimal, so that the latest values are
        found by a hash aggregation that combines before the shuffle; products
        are joined to what is left.
        """
        micros = F.unix_micros(F.col("recorded_at").cast("timestamp")).cast("decimal(20,0)")
        rows = self._observed().withColumn("_at", (micros * F.lit(10**15).cast("decimal(17,0)") + F.col("ord") * 100 + F.col("line")).cast("decimal(38,0)"))
        kept = [c for c in rows.columns if c not in ("product_id", "merchant_id", "_at")]
        return self._priced(rows.groupBy("product_id", "merchant_id").agg(*(F.max_by(c, "_at").alias(c) for c in kept)))

    @property
    def current(self) -> DataFrame:
        """Offers a shopper may be shown, with product and merchant columns."""
        from marketloom.operators.predicates import is_current

        return self.placed.where(is_current(now(), MAX_AGE_DAYS))

    @property
    def placed(self) -> DataFrame:
        """All offers with their product and merchant."""
        return self.offer.join(self.merchant, "merchant_id").join(self.product.withColumnRenamed("id", "product_id"), "product_id")

    @property
    def runs(self) -> DataFrame:
        """Scraper runs: merchant, day, attempted, written."""
        e = self.read("events")
        wrote = F.count_if(F.col("event_type").isin("purchase", "view"))
        return e.groupBy((F.col("user_id") % 20).alias("merchant"), F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("attempted"), wrote.alias("written"))

    @property
    def adds(self) -> DataFrame:
        """Product adds of users: user_id, product_id, ts."""
        e = self.read("events").where("event_type = 'purchase'")
        return e.select("user_id", F.get_json_object("props", "$.k").cast("long").alias("product_id"), "ts")


#: the same frames as SQL, for the oracles
SQL = """WITH product AS (SELECT p_partkey AS id, p_name AS name, p_brand AS brand, lower(p_type) AS section,
  CASE p_partkey % 3 WHEN 0 THEN 'kg' WHEN 1 THEN 'l' ELSE 'buc' END AS unit, p_size / 10.0::DOUBLE AS unit_size, p_partkey % 25 AS category_id,
  CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 40 END AS class_id FROM part),
merchant AS (SELECT s_suppkey AS merchant_id, s_name AS slug, s_acctbal >= 0 AS active, s_suppkey % 10 = 0 AS aggregator,
  CAST(500 * (s_nationkey % 4) AS BIGINT) AS delivery_fee, CAST(20000 AS BIGINT) AS free_over,
  CAST(CASE WHEN s_suppkey % 7 = 0 THEN 5000 END AS BIGINT) AS min_order FROM supplier),
history AS (SELECT l_partkey AS product_id, l_suppkey AS merchant_id,
  CAST(floor(p_retailprice * (1 - l_discount) * 100 + 0.5) AS BIGINT) AS price_bani, CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) AS reference_bani,
  l_shipdate AS recorded_at, l_orderkey AS ord, l_linenumber AS line, (l_returnflag = 'R' AND l_discount >= 0.09::DOUBLE) AS flagged,
  CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'out of stock' ELSE 'in stock' END AS availability, l_quantity >= 49 AS is_stale,
  CASE WHEN l_linenumber % 5 = 0 THEN l_shipdate + INTERVAL 400 DAY END AS promo_valid_to FROM lineitem JOIN part ON l_partkey = p_partkey),
offer AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY product_id, merchant_id ORDER BY recorded_at DESC, ord DESC, line DESC) AS rn FROM history) WHERE rn = 1),
placed AS (SELECT o.*, m.* EXCLUDE (merchant_id), p.* EXCLUDE (id) FROM offer o JOIN merchant m USING (merchant_id) JOIN product p ON p.id = o.product_id),
cur AS (SELECT * FROM placed WHERE availability = 'in stock' AND NOT is_stale AND NOT aggregator AND NOT flagged AND active
  AND NOT coalesce(promo_valid_to < TIMESTAMP '2001-11-05', false) AND recorded_at >= TIMESTAMP '2001-11-05' - INTERVAL 730 DAY),
runs AS (SELECT user_id % 20 AS merchant, CAST(ts AS DATE) AS day, count(*) AS attempted, count(*) FILTER (event_type IN ('purchase', 'view')) AS written FROM events GROUP BY 1, 2),
adds AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_id, ts FROM events WHERE event_type = 'purchase')
"""
