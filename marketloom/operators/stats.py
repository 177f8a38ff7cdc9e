"""Statistics of shops, reviews and pending work, and the checks of stored figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom import constants as C
from marketloom.functions import scalars as S


def merchant_stats(runs: DataFrame, placed: DataFrame, current: Column, pending: DataFrame, now: Column, nights: int = 14) -> DataFrame:
    """Per merchant: nights run, failed ones and rows written in the last ``nights``; offers, current, stale and flagged ones; pending pairs."""
    seen = runs.where(F.col("day") >= F.date_sub(now.cast("date"), nights)).groupBy(F.col("merchant").alias("merchant_id")).agg(
        F.count(F.lit(1)).alias("nights"), F.count_if(F.col("written") == 0).alias("failed"), F.sum("written").alias("written")
    )
    offers = placed.groupBy("merchant_id").agg(F.count(F.lit(1)).alias("offers"), F.count_if(current).alias("current"), F.count_if("is_stale").alias("stale"), F.count_if("flagged").alias("flagged"))
    waiting = pending.groupBy("merchant_id").agg(F.count(F.lit(1)).alias("pending"))
    out = offers.join(seen, "merchant_id", "left").join(waiting, "merchant_id", "left")
    return out.select("merchant_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("nights", "failed", "written", "offers", "current", "stale", "flagged", "pending")))


def match_stats(decisions: DataFrame) -> DataFrame:
    """Confirmed and rejected pairs by rule, score band, section, merchant and rank band, with the verdict on each.

    decisions: decision (confirm or reject), reason, score_bp, section, merchant_id, rank
    (null for decisions in bulk); one pass, a row counted once per grouping.
    """
    s, r = F.col("score_bp"), F.col("rank")
    score = F.when(s < 4600, "0.42-0.46").when(s < 5000, "0.46-0.50").when(s < 5400, "0.50-0.54").when(s < 5800, "0.54-0.58").otherwise("0.58+")
    rank = F.when(r.isNull(), "bulk").when(r <= 25, "1-25").when(r <= 50, "26-50").when(r <= 100, "51-100").when(r <= 250, "101-250").otherwise("251+")
    keys = {"all": F.lit("all"), "rule": F.col("reason"), "score": score, "section": F.col("section"), "merchant": F.col("merchant_id").cast("string"), "rank": rank}
    rows = decisions.where(F.col("decision").isin("confirm", "reject")).select("decision", F.explode(F.array(*(F.struct(F.lit(k).alias("by"), c.alias("key")) for k, c in keys.items()))).alias("g"))
    out = rows.groupBy("g.by", "g.key").agg(F.count_if(F.col("decision") == "confirm").alias("confirmed"), F.count(F.lit(1)).alias("total"))
    rate = F.col("confirmed") / F.col("total")
    verdict = F.when(F.col("total") < C.CONFIRM_SAMPLE, "not enough signal").when(rate > C.CONFIRM_WEAK, "too aggressive").when(rate < C.CONFIRM_LOW, "working").otherwise("not enough signal")
    return out.withColumn("rate_bp", S.half_up(rate * 10000)).withColumn("verdict", verdict)


def pending_upper_bound(offers: DataFrame, pending: DataFrame) -> DataFrame:
    """One row: products on offer, those that pending pairs (product_id, merchant_id) could give a shop, and comparable ones before and after."""
    now = offers.select("product_id", "merchant_id").distinct().withColumn("have", F.lit(1))
    live = now.select("product_id").distinct()
    both = now.unionByName(pending.join(live, "product_id", "left_semi").select("product_id", "merchant_id", F.lit(0).alias("have")))
    shop = both.groupBy("product_id", "merchant_id").agg(F.max("have").alias("have"))
    per = shop.groupBy("product_id").agg(F.sum("have").alias("before"), F.count(F.lit(1)).alias("after"))
    return per.agg(
        F.count(F.lit(1)).alias("products"), F.count_if(F.col("after") > F.col("before")).alias("gaining"),
        F.count_if(F.col("before") >= 2).alias("comparable_before"), F.count_if(F.col("after") >= 2).alias("comparable_after"),
    )


def truncations(runs: DataFrame, cap: int) -> DataFrame:
    """Runs that read fewer rows than they found, or reached the cap: their lower count is no fact about the shop."""
    rows = runs.withColumn("why", F.when(F.col("written") < F.col("attempted"), "read-less").when(F.col("attempted") >= cap, "cap"))
    return rows.where("why is not null").select("merchant", "day", "attempted", "written", "why")


def derived_checks(signals: DataFrame) -> DataFrame:
    """Violations of what stored signals must obey: not negative, at most 100 %, the score is the larger part, a spread needs two offers."""
    checks = {
        "not-negative": (F.col("spread_bp") < 0) | (F.col("drop_bp") < 0), "over-whole": F.greatest("spread_bp", "drop_bp") > 10_000,
        "score-is-larger": F.col("deal_score_bp") != F.greatest("spread_bp", "drop_bp"), "spread-needs-two": (F.col("spread_bp") > 0) & (F.col("live") < 2),
    }
    one = signals.agg(*(F.count_if(F.coalesce(bad, F.lit(True))).alias(name) for name, bad in checks.items()))
    return one.select(F.inline(F.array(*(F.struct(F.lit(n).alias("check"), F.col(f"`{n}`").alias("violations")) for n in checks))))


def class_checks(products: DataFrame, categories: DataFrame) -> DataFrame:
    """Per class: members, members of another unit than most, and members in no known category (category_id)."""
    rows = products.where("class_id is not null").join(categories.select("category_id", F.lit(True).alias("placed")), "category_id", "left")
    unit = rows.groupBy("class_id", "unit").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("placed").isNull()).alias("unplaced"))
    return unit.groupBy("class_id").agg(F.sum("n").alias("members"), (F.sum("n") - F.max("n")).alias("other_unit"), F.sum("unplaced").alias("unplaced"))


def stale_assignments(assigned: DataFrame, proposed: DataFrame) -> DataFrame:
    """Rules' assignments (id, category_id, source) that no proposal supports any more; people's stay."""
    return assigned.where("source = 'rule'").join(proposed.select("id", "category_id"), ["id", "category_id"], "left_anti").select("id", "category_id")


def brand_gaps(products: DataFrame, heads: DataFrame, most: int = C.BRAND_HEADS) -> DataFrame:
    """Products without a brand whose leading word leads fewer than ``most`` names: the word may be a brand."""
    head = S.head_noun(S.tokens(S.normalize(F.col("name"))), F.array().cast("array<string>"), F.array().cast("array<string>"))
    rows = products.where(F.coalesce(F.trim("brand"), F.lit("")) == "").select("id", head.alias("head"))
    return rows.join(heads.where(F.col("products") < most), "head").select("id", F.col("head").alias("maybe_brand"))


def private_label_owners(offers: DataFrame, labels: DataFrame) -> DataFrame:
    """(product_id, owner): the shop whose own label a product's brand holds as whole words, if it sells the product; labels: owner, label."""
    key = lambda c: F.concat(F.lit(" "), S.normalize(F.col(c), glue_storage=False), F.lit(" "))
    known = labels.select("owner", key("label").alias("l")).where("trim(l) <> ''").withColumn("word", F.get(S.tokens(F.col("l")), F.lit(0)))
    brands = offers.select("product_id", "slug", key("brand").alias("b")).where("trim(b) <> ''").withColumn("word", F.explode(F.array_distinct(S.tokens(F.col("b")))))
    rows = brands.join(known, (brands["word"] == known["word"]) & F.contains("b", F.col("l")) & (F.col("slug") == F.col("owner")))
    return rows.groupBy("product_id").agg(F.min("owner").alias("owner"))


def match_electronics(pairs: DataFrame) -> DataFrame:
    """Whether two items of electronics are one, and why; a_ and b_ with name, brand, ean, mpn, model.

    Two valid EANs decide; then equal part numbers, equal models, and between
    brands that do not differ names that are 80 % alike.
    """
    part = lambda c: F.when(F.length(F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")) >= 4, F.regexp_replace(F.upper(c), "[^A-Z0-9]", ""))
    code = lambda c: F.when(S.ean_ok(F.col(c)), F.col(c))
    words = lambda c: F.array_distinct(F.filter(S.tokens(S.normalize(F.col(c), glue_storage=False)), lambda w: ~w.isin(C.STOPWORDS) & ~w.rlike("[0-9]")))
    brand = lambda c: F.nullif(S.normalize(F.col(c), glue_storage=False), F.lit(""))
    sim = S.jaccard(words("a_name"), words("b_name"))
    both = code("a_ean").isNotNull() & code("b_ean").isNotNull()
    differ = F.coalesce(brand("a_brand") != brand("b_brand"), F.lit(False))
    reason = (
        F.when(both, F.when(code("a_ean") == code("b_ean"), "EAN_EXACT").otherwise("NO_MATCH")).when(part("a_mpn") == part("b_mpn"), "MPN_EXACT")
        .when(part("a_model") == part("b_model"), "MODEL_EXACT").when(differ, "NO_MATCH").when(sim >= 0.8, "NAME_TIEBREAK").otherwise("NO_MATCH")
    )
    sure = {"EAN_EXACT": 10_000, "MPN_EXACT": 9_700, "MODEL_EXACT": 9_500}
    fixed = reduce(lambda out, kv: F.when(F.col("reason") == kv[0], kv[1]).otherwise(out), sure.items(), S.half_up((0.6 + 0.3 * sim) * 10000))
    score = F.when(F.col("reason") != "NO_MATCH", fixed).when(both | differ, 0).otherwise(S.half_up(sim * 10000))
    return pairs.withColumn("reason", reason).withColumn("confidence_bp", score.cast("long"))


def specs(name: Column) -> Column:
    """map of what an electronics name states: screen (inch), ram and storage (GB or TB), cpu, battery (mAh)."""
    found = {
        "screen": F.replace(F.regexp_extract(name, r"(?i)([0-9]{1,2}(?:[.,][0-9])?)\s*(?:inch|\"|''|toli)", 1), F.lit(","), F.lit(".")),
        "ram": F.regexp_extract(name, r"(?i)([0-9]{1,3})\s*GB\s*(?:RAM|memorie)", 1),
        "storage": F.upper(F.regexp_replace(F.regexp_extract(name, r"(?i)([0-9]{2,4}\s*(?:GB|TB))\b(?!\s*(?:RAM|memorie))", 1), r"\s", "")),
        "cpu": F.regexp_extract(name, r"(?i)\b(i[3579]|Ryzen\s*[0-9]|Snapdragon\s*[0-9]+|M[1-4](?:\s*Pro|\s*Max)?)\b", 1),
        "battery": F.regexp_extract(name, r"(?i)(?<![0-9])([0-9]{3,5})\s*mAh", 1),
    }
    whole = F.create_map(*(x for k, v in found.items() for x in (F.lit(k), v)))
    return F.map_filter(whole, lambda k, v: v != "")


def sorted_names(rows: DataFrame, name: str, key: str, limit: int) -> DataFrame:
    """The first rows by name as Romanian readers sort it, ties by key."""
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.collate(F.col(name), "ro"), key))
    first = rows.orderBy(F.collate(F.col(name), "ro"), key).limit(limit)  # ``limit`` rows in the window
    return first.withColumn("place", place).select("place", key, name)
