"""Category assignment by name rules, brand inference, class membership rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom import constants as C
from marketloom.functions import scalars as S


def assign_by_name(products: DataFrame, rules: DataFrame) -> DataFrame:
    """Best category of each product; rules: category, department, word, phrase (nullable), avoid (nullable).

    A word scores by its place in the name (0.95, 0.90, 0.82, 0.70, then 0.50),
    a phrase that the name holds adds 0.15, an ``avoid`` word in the name rules
    the category out.  Two departments with the same best score leave 0.52.
    """
    words = products.select("id", S.tokens(S.normalize(F.col("name"))).alias("t"), S.normalize(F.col("name")).alias("norm"))
    by_word = words.select("id", "t", "norm", F.posexplode("t").alias("pos", "word")).join(rules, "word")
    by_word = by_word.where(F.col("avoid").isNull() | ~F.array_contains("t", F.col("avoid")))
    place = F.when(F.col("pos") == 0, 95).when(F.col("pos") == 1, 90).when(F.col("pos") == 2, 82).when(F.col("pos") == 3, 70).otherwise(50)
    bonus = F.when(F.coalesce(F.contains("norm", "phrase"), F.lit(False)), 15).otherwise(0)
    scored = by_word.groupBy("id", "category", "department").agg(F.max(F.least(place + bonus, F.lit(100))).alias("score"))
    top = Window.partitionBy("id").orderBy(F.desc("score"), "category")
    tie = F.size(F.collect_set("department").over(Window.partitionBy("id", "score"))) > 1
    best = scored.withColumn("tie", tie).withColumn("rn", F.row_number().over(top)).where("rn = 1")
    score = F.when(F.col("tie"), F.least("score", F.lit(52))).otherwise(F.col("score"))
    band = F.when(score >= C.AUTO_BAND * 100, "AUTO").when(score >= C.REVIEW_BAND * 100, "REVIEW").otherwise("NONE")
    return best.select("id", "category", score.alias("score"), band.alias("band"))


def infer_brand(products: DataFrame, brands: DataFrame) -> DataFrame:
    """The longest known brand that starts a product's name; brands: brand."""
    known = brands.select("brand", S.normalize(F.col("brand")).alias("b")).where("b <> ''").dropDuplicates(["b"])
    known = known.select("brand", "b", F.size(F.split("b", " ")).alias("n"))
    words = products.select("id", S.tokens(S.normalize(F.col("name"))).alias("t"))
    heads = words.select("id", F.explode(F.sequence(F.lit(1), F.least(F.size("t"), F.lit(4)))).alias("n"), "t").where("n > 0")
    heads = heads.select("id", "n", F.array_join(F.slice("t", 1, F.col("n")), " ").alias("b"))
    found = heads.join(known, ["b", "n"])
    return found.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n")))).where("rn = 1").select("id", "brand")


def class_members(products: DataFrame, rules: DataFrame) -> DataFrame:
    """(class_id, id) of products that hold every required word and no excluded one.

    rules: class_id, require array<string> (not empty), exclude array<string>.
    Products and rules meet on the first required word.
    """
    words = products.select("id", S.tokens(S.normalize(F.col("name"))).alias("t"))
    keyed = words.select("id", "t", F.explode(F.array_distinct("t")).alias("w"))
    wanted = rules.withColumn("w", F.get("require", F.lit(0)))
    rows = keyed.join(wanted, "w")
    fits = (F.size(F.array_except("require", "t")) == 0) & ~F.coalesce(F.arrays_overlap("exclude", "t"), F.lit(False))
    return rows.where(fits).select("class_id", "id").distinct()
