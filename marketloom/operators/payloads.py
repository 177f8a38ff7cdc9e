"""Brands in stored payloads: a level-by-level descent into JSON values kept as variants.

A level is a frame of nodes.  Nodes with a brand of their own are answers; only
payloads without one at their first level send their parts to the next.  A
node's path lists its place among its siblings, so the smallest path is what
reading the payload from the front meets first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.sources.work import written

# fixed values: keys under which payloads state a brand, the first that has one counts
BRAND_KEYS = ["brand", "manufacturerName", "marca", "producator", "brandName", "manufacturer"]
# fixed values: what stands in brand fields for no brand
NO_BRANDS = [
    "", "-", "--", "n/a", "na", "null", "undefined", "none", "no brand", "nobrand",
    "fara marca", "fara brand", "generic", "altele", "diverse", "mega",
]
DEEPEST = 4


def is_placeholder(value: Column) -> Column:
    """Whether a brand field names no brand: a stand-in, a note in brackets, or under two characters."""
    t = F.lower(F.trim(value))
    return t.isin(NO_BRANDS) | t.rlike(r"^\(.*\)$") | (F.length(t) < 2)


def _text(v: str, path: str) -> Column:
    """A string at a path of a variant; null for anything else."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(kind == "STRING", F.try_variant_get(v, path, "string"))


def own_brand(v: str) -> Column:
    """struct<value, key> of the first brand key that a node itself holds a brand under, as text or as {name}; else null."""
    found = []
    for key in BRAND_KEYS:
        for path, shown in ((f"$.{key}", key), (f"$.{key}.name", f"{key}.name")):
            text = _text(v, path)
            found.append(F.when(text.isNotNull() & ~is_placeholder(text), F.struct(F.trim(text).alias("value"), F.lit(shown).alias("key"))))
    return F.coalesce(*found)


def _parts(nodes: DataFrame) -> DataFrame:
    """The objects and lists right inside each node (id, path, doc, v), in the order in which its text has them."""
    spark = nodes.sparkSession
    inner = nodes.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).where("value is not null")
    kind = F.schema_of_variant("value")
    inner = inner.where(kind.startswith("OBJECT") | kind.startswith("ARRAY"))
    place = F.when(F.col("key").isNull(), F.col("pos")).otherwise(F.array_position(F.json_object_keys("doc"), F.col("key")).cast("int"))
    step = F.when(F.col("key").isNull(), F.concat(F.lit("$["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("$['"), "key", F.lit("']")))
    doc = F.coalesce(F.call_function("get_json_object", F.col("doc"), step), F.to_json("value"))
    return inner.select("id", F.concat("path", F.array(place)).alias("path"), doc.alias("doc"), F.col("value").alias("v"))


def payload_brands(rows: DataFrame, id_col: str = "id", payload_col: str = "payload", deepest: int = DEEPEST) -> DataFrame:
    """(id_col, value, key, depth): the brand of each payload that has one.

    What a depth-first reading in the order of the text meets first, down to
    ``deepest`` levels below the top.  Payloads that are null, empty, cut off or
    no JSON have no row; ids should be distinct, of equal ones the payload with
    the first answer counts.  Objects whose keys contain quotes are read in the
    order of their keys.
    """
    nodes = rows.select(F.col(id_col).alias("id"), F.array().cast("array<int>").alias("path"), F.col(payload_col).alias("doc"), F.try_parse_json(payload_col).alias("v"))
    nodes = nodes.where("v is not null").select("*", own_brand("v").alias("own"))
    hits = [nodes.where("own is not null").select("id", "path", "own")]
    rest = nodes.where("own is null").drop("own")
    for _ in range(deepest):
        rest = written(_parts(rest).select("*", own_brand("v").alias("own")))
        if rest.isEmpty():
            break
        hits.append(rest.where("own is not null").select("id", "path", "own"))
        rest = rest.where("own is null").drop("own")
    first = reduce(DataFrame.union, hits).groupBy("id").agg(F.min(F.struct("path", "own")).alias("f"))
    return first.select(F.col("id").alias(id_col), F.col("f.own.value").alias("value"), F.col("f.own.key").alias("key"), F.size("f.path").alias("depth"))
