"""Named audits and gates: each a frame of findings or of counts, over offers, history, runs or decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom import constants as C
from marketloom.functions import listing_rules
from marketloom.functions import scalars as S
from marketloom.operators.quality import at_places
from marketloom.sources.work import written


def two_representations(offers: DataFrame) -> DataFrame:
    """Offers whose ladder as JSON text (ladder_json) says something else than their rungs (tiers), as sorted qty@bani."""
    rung = lambda t: F.concat_ws("@", t["qty"].cast("string"), t["bani"].cast("string"))
    shape = "array<struct<qty:int,bani:bigint>>"
    text = F.array_join(F.array_sort(F.transform(F.from_json("ladder_json", shape), rung)), ",")
    rows = offers.select("product_id", "merchant_id", F.coalesce(text, F.lit("")).alias("from_json"), F.coalesce(F.array_join(F.array_sort(F.transform("tiers", rung)), ","), F.lit("")).alias("from_tiers"))
    return rows.where("from_json <> from_tiers")


def figures_in_text(rows: DataFrame, text: str, price: str) -> DataFrame:
    """How many money figures a raw text holds, and where the stored price stands: only, first, last, least, greatest, between or absent."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"([0-9]+[.,][0-9]{2})(?![0-9])"), F.lit(1))
    bani = F.transform(found, lambda x: F.replace(F.replace(x, F.lit(","), F.lit("")), F.lit("."), F.lit("")).cast("long"))
    out = rows.withColumn("_f", bani)
    f, p = F.col("_f"), F.col(price)
    where = (
        F.when(~F.array_contains(f, p), "absent").when(F.size(f) == 1, "only").when(F.get(f, F.lit(0)) == p, "first").when(F.get(f, F.size(f) - 1) == p, "last")
        .when(F.array_min(f) == p, "least").when(F.array_max(f) == p, "greatest").otherwise("between")
    )
    return out.groupBy(F.size(f).alias("figures"), where.alias("place")).agg(F.count(F.lit(1)).alias("rows"))


def price_truth(current: DataFrame) -> DataFrame:
    """One row: products of two shops or more, and how many spread 1.5, 2 and 3 times; implied sizes that are not finite."""
    size = F.col("price_bani") / F.nullif(S.per_unit_bani(F.col("price_bani"), F.col("unit_size")), F.lit(0))
    per = current.withColumn("_s", size).groupBy("product_id").agg(
        F.min("price_bani").alias("lo"), F.max("price_bani").alias("hi"), F.countDistinct("merchant_id").alias("shops"), F.count_if(F.col("_s").isNull()).alias("odd")
    )
    several = F.col("shops") >= 2
    spread = lambda k: F.count_if(several & (F.col("hi") * 10 >= F.col("lo") * k)).alias(f"spread_{k}")
    return per.agg(F.count_if(several).alias("products"), spread(11), spread(15), spread(20), spread(30), F.sum("odd").alias("no_size"))


def unit_price_disagreement(offers: DataFrame, stated: str) -> DataFrame:
    """Per merchant how its stated unit prices differ from those of its own prices and sizes, by shape."""
    own = F.col("price_bani") / F.col("unit_size")
    return offers.groupBy("merchant_id", listing_rules.per_unit_mismatch(own, F.col(stated)).alias("shape")).agg(F.count(F.lit(1)).alias("offers"))


def size_from_slug(offers: DataFrame, slug: str) -> DataFrame:
    """Offers whose url slug states a size over 2 % off their own; "0-5-l" is 0.5 l."""
    text = F.regexp_replace(F.col(slug), "([0-9])-([0-9])", "$1.$2")
    number = F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)?)-(?:kg|l|buc)(?![a-z])", 1).try_cast("double")
    unit = F.regexp_extract(text, r"[0-9]-(kg|l|buc)(?![a-z])", 1)
    off = F.greatest(number / F.col("unit_size"), F.col("unit_size") / number)
    rows = offers.withColumn("slug_size", number).where((unit == F.col("unit")) & (off > 1.02))
    return rows.select("product_id", "merchant_id", "unit_size", "slug_size")


def ean_coverage(rows: DataFrame) -> DataFrame:
    """Per merchant: rows, those with a code and with a valid one (ean)."""
    return rows.groupBy("merchant_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(F.col("ean") != "", F.lit(False))).alias("present"), F.count_if(S.ean_ok(F.col("ean"))).alias("valid"))


def shops_per_code(rows: DataFrame) -> DataFrame:
    """How many valid codes are sold at 1, 2, 3 ... shops."""
    shops = rows.where(S.ean_ok(F.col("ean"))).groupBy("ean").agg(F.countDistinct("merchant_id").alias("shops"))
    return shops.groupBy("shops").agg(F.count(F.lit(1)).alias("codes"))


def dropped_prices(pool: DataFrame, live: DataFrame) -> DataFrame:
    """Per merchant: pool rows without a price, those a live offer contradicts, and those whose raw text is a stand-in ('' or 0).

    An offer may come with any number of its observations; those of rows without a price alone are told apart.
    """
    key = ["merchant_id", "product_id"]
    rows = written(pool.where(F.coalesce(F.col("price_bani"), F.lit(0)) <= 0).select(*key, "raw_text"))
    known = live.select(*key).join(rows.select(*key), key, "left_semi").distinct().withColumn("live", F.lit(True))
    rows = rows.join(known, key, "left")
    return rows.groupBy("merchant_id").agg(
        F.count(F.lit(1)).alias("dropped"), F.count_if(F.coalesce("live", F.lit(False))).alias("contradicted"), F.count_if(F.trim("raw_text").isin("", "0")).alias("stand_ins")
    )


def kept_over_refused(anomalies: DataFrame, offers: DataFrame) -> DataFrame:
    """Offers still at the accepted price of an anomaly whose other price was refused, and which way that lay.

    anomalies: product_id, merchant_id, accepted, refused.
    """
    open_ = anomalies.where("refused > 0 and accepted is not null")
    rows = open_.join(offers.select("product_id", "merchant_id", "price_bani"), ["product_id", "merchant_id"])
    rows = rows.where(F.abs(F.col("price_bani") - F.col("accepted")) <= 1)
    return rows.select("product_id", "merchant_id", "price_bani", "refused", F.when(F.col("refused") > F.col("price_bani"), "up").otherwise("down").alias("way"))


def descriptor_pairs(products: DataFrame, least: int = 2) -> DataFrame:
    """Words that part otherwise alike products: (word, other) of names in a cohort (brand, unit, size) that differ by one word each.

    Products (ids are unique) of one cohort, word and rest are counted first, and pairs are counts multiplied.
    """
    words = F.array_sort(F.array_distinct(S.tokens(S.normalize(F.col("name")))))
    rows = products.select("id", "brand", "unit", "unit_size", F.size(words).alias("n"), F.explode(words).alias("word"), words.alias("t"))
    rows = rows.select("id", "brand", "unit", "unit_size", "n", "word", F.array_join(F.array_remove("t", F.col("word")), " ").alias("rest"))
    rows = written(rows.groupBy("brand", "unit", "unit_size", "rest", "n", "word").agg(F.count(F.lit(1)).alias("k")))
    a, b = rows.alias("a"), rows.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("brand", "unit", "unit_size", "rest", "n")]
    on = same[0] & same[1] & same[2] & same[3] & same[4] & (F.col("a.word") < F.col("b.word"))
    out = a.join(b, on).groupBy(F.col("a.word").alias("word"), F.col("b.word").alias("other")).agg(F.sum(F.col("a.k") * F.col("b.k")).alias("pairs"))
    return out.where(F.col("pairs") >= least)


def variant_code_clusters(products: DataFrame) -> DataFrame:
    """Products alike but for numbers in their names: section, the name without them, members and distinct codes."""
    words = S.tokens(S.normalize(F.col("name")))
    codes = F.filter(words, lambda w: w.rlike("^[0-9]{1,4}$"))
    bare = F.array_join(F.filter(words, lambda w: ~w.rlike("^[0-9]{1,4}$")), " ")
    rows = products.select("section", bare.alias("bare"), F.array_join(codes, " ").alias("code"))
    out = rows.groupBy("section", "bare").agg(F.count(F.lit(1)).alias("members"), F.countDistinct("code").alias("codes"))
    return out.where("codes >= 2")


def platform_quantiles(placed: DataFrame) -> DataFrame:
    """Platform price against the cheapest shelf price by the index floor(q (n - 1)); exact and cheaper ones; products only there."""
    pair = placed.groupBy("product_id").agg(F.min(F.when(F.col("aggregator"), F.col("price_bani"))).alias("p"), F.min(F.when(~F.col("aggregator"), F.col("price_bani"))).alias("s"))
    both = pair.where("p is not null and s > 0").select(F.lit(1).alias("k"), S.half_up(F.col("p") * 10000 / F.col("s")).alias("bp"))
    q = at_places(both, ["k"], "bp", {f"q{x}": F.floor((F.col("n") - 1) * x / 100) for x in (10, 50, 90)})
    counts = both.groupBy("k").agg(F.count_if(F.col("bp") == 10000).alias("exact"), F.count_if(F.col("bp") < 10000).alias("cheaper"))
    only = pair.where("p is not null").groupBy(F.lit(1).alias("k")).agg(F.count_if(F.col("s").isNull()).alias("only_there"))
    return q.join(counts, "k").join(only, "k").drop("k")


def band_sweep(decided: DataFrame, labels: DataFrame, thresholds: list[int], keys: list[str]) -> DataFrame:
    """True and false matches and misses of (item_id, id) scores at each threshold, per key.

    decided: item_id, id, score_bp; labels: item_id, id, same (bool) and the keys.
    Every label counts; what has no score has 0.
    """
    rows = labels.join(decided.select("item_id", "id", "score_bp"), ["item_id", "id"], "left").withColumn("score_bp", F.coalesce("score_bp", F.lit(0)))
    rows = rows.withColumn("threshold_bp", F.explode(F.array(*(F.lit(x) for x in thresholds))))
    taken = F.col("score_bp") >= F.col("threshold_bp")
    return rows.groupBy(*keys, "threshold_bp").agg(
        F.count_if(taken & F.col("same")).alias("right"), F.count_if(taken & ~F.col("same")).alias("wrong"), F.count_if(~taken & F.col("same")).alias("missed")
    )


def best_rejected(rejected: DataFrame) -> DataFrame:
    """Per store item its best rejected candidate, with the words that each side has alone.

    rejected: item_id, id, score_bp, c_name, s_name.
    """
    order = Window.partitionBy("item_id").orderBy(F.desc("score_bp"), "id")
    best = rejected.withColumn("rn", F.row_number().over(order)).where("rn = 1")
    c, s = S.tokens(S.normalize(F.col("c_name"))), S.tokens(S.normalize(F.col("s_name")))
    alone = lambda x, y: F.array_join(F.array_sort(F.array_except(x, y)), " ")
    return best.select("item_id", "id", "score_bp", alone(c, s).alias("only_catalog"), alone(s, c).alias("only_store"))


def systematic_sample(rows: DataFrame, key: str, every: int, span: int = 65_536) -> DataFrame:
    """Every ``every``-th row in the order of a whole-number key, the first one included.

    Keys are ranked within spans; a running count over the spans (one row each)
    makes the ranks follow each other.
    """
    keyed = rows.withColumn("_span", F.floor(F.col(key) / span))
    sizes = keyed.groupBy("_span").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))
    placed = keyed.join(sizes.select("_span", F.coalesce(before, F.lit(0)).alias("_before")), "_span")
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_span").orderBy(key)) - 1
    return placed.withColumn("_rank", rank).where(F.col("_rank") % every == 0).select(*rows.columns)


def alternatives_coverage(sample: DataFrame, pairs: DataFrame) -> DataFrame:
    """Share of sampled products (id) with an alternative (id, other_id), and alternatives in all."""
    n = pairs.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return sample.select("id").join(n, "id", "left").agg(F.count(F.lit(1)).alias("products"), F.count("n").alias("covered"), F.coalesce(F.sum("n"), F.lit(0)).alias("alternatives"))


def chosen_recheck(chosen: DataFrame, current: DataFrame) -> DataFrame:
    """Chosen (merchant_id, product_id, price_bani) that are no current offer any more, or at another price."""
    now = current.select("merchant_id", "product_id", F.col("price_bani").alias("now_bani"))
    rows = chosen.join(now, ["merchant_id", "product_id"], "left")
    why = F.when(F.col("now_bani").isNull(), "gone").when(F.col("now_bani") != F.col("price_bani"), "price")
    return rows.withColumn("why", why).where("why is not null").groupBy("merchant_id", "why").agg(F.count(F.lit(1)).alias("offers"))


def discount_gate(verdicts: DataFrame, prior: DataFrame, least_pct: int = 90, least_days: int = 30) -> DataFrame:
    """Per merchant whether its discounts may be published: its own figures agree with our minimum nine times in ten, with history enough."""
    rows = verdicts.where("basis = 'RETAILER'").join(prior.where(f"coverage_days >= {C.BASELINE_DAYS} and prior_min_bani is not null").select("product_id", "merchant_id", "coverage_days"), ["product_id", "merchant_id"])
    out = rows.groupBy("merchant_id").agg(F.count(F.lit(1)).alias("claims"), F.count_if(~F.col("disagrees")).alias("agree"), F.max("coverage_days").alias("days"))
    return out.withColumn("publish", (F.col("agree") * 100 >= F.col("claims") * least_pct) & (F.col("days") >= least_days))


def product_trace(offers: DataFrame, terms: DataFrame) -> DataFrame:
    """Offers of products whose folded name holds a term (term), per term and merchant."""
    named = offers.withColumn("word", F.explode(F.array_distinct(S.tokens(S.normalize(F.col("name"))))))
    rows = named.join(terms.select(S.normalize(F.col("term")).alias("word")).distinct(), "word")
    return rows.groupBy("word", "merchant_id").agg(F.count(F.lit(1)).alias("offers"), F.min("price_bani").alias("lowest_bani"), F.countDistinct("product_id").alias("products"))


def displayed_numbers(summary: DataFrame, offers: DataFrame, current: Column) -> DataFrame:
    """Kinds of wrong numbers in stored summaries: no finite price, a headline that no current offer asks, a cheaper one left out, wrong counts."""
    again = offers.groupBy("product_id").agg(F.min(F.when(current, F.col("price_bani"))).alias("lo"), F.count_if(current).alias("n"))
    rows = summary.join(again, "product_id", "left")
    kinds = {
        "not-positive": F.col("has_current") & (F.col("lowest_bani") <= 0), "headline-gone": F.col("has_current") & F.col("lo").isNull(),
        "cheaper-left-out": F.col("has_current") & (F.col("lo") < F.col("lowest_bani")), "count": F.col("offer_count") != F.coalesce("n", F.lit(0)),
    }
    one = rows.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in kinds.items()))
    return one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"`{k}`").alias("products")) for k in kinds))))


def message_shapes(rows: DataFrame, text: str) -> DataFrame:
    """Messages by their shape: numbers are N."""
    return rows.groupBy(F.regexp_replace(text, "[0-9.,]+", "N").alias("shape")).agg(F.count(F.lit(1)).alias("rows"))


def silent_merchants(runs: DataFrame, merchants: DataFrame, now: Column, hours: int = C.SILENT_HOURS) -> DataFrame:
    """Merchants (merchant) with no successful run in the last ``hours``, and when their last one was; null if never."""
    last = runs.where("written > 0").groupBy("merchant").agg(F.max("day").alias("last_day"))
    rows = merchants.select("merchant").join(last, "merchant", "left")
    return rows.where(F.col("last_day").isNull() | (F.col("last_day").cast("timestamp_ntz") < now - F.expr(f"interval {hours} hours")))


def invariant_transitions(nights: DataFrame) -> DataFrame:
    """Changes of an invariant's state between consecutive nights it was seen on; (name, day, ok)."""
    order = Window.partitionBy("name").orderBy("day")
    rows = nights.withColumn("was", F.lag("ok").over(order)).where("was is not null and was <> ok")
    return rows.select("name", "day", F.when(F.col("ok"), "mended").otherwise("broken").alias("change"))


def regressions(nights: DataFrame) -> DataFrame:
    """Invariants (name, day, ok) that held on the night before last and broke on the last one."""
    newest = Window.partitionBy("name").orderBy(F.desc("day"))
    rows = nights.withColumn("rn", F.row_number().over(newest)).where("rn <= 2").groupBy("name")
    out = rows.agg(*(F.max(F.when(F.col("rn") == i, F.col(c))).alias(f"{c}{i}") for i in (1, 2) for c in ("day", "ok")))
    return out.where("ok2 and not ok1").select("name", F.col("day2").alias("before_day"), F.col("day1").alias("day"))


def register_difference(rows: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Values in use outside a register, and registered ones not in use."""
    used = rows.select(F.col(column).alias("value")).distinct().withColumn("used", F.lit(True))
    known = rows.sparkSession.createDataFrame([(v, True) for v in allowed], "value string, known boolean")
    both = used.join(known, "value", "full").where("used is null or known is null")
    return both.select("value", F.when(F.col("known").isNull(), "unregistered").otherwise("unused").alias("side"))
