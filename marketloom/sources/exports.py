"""Exports in key ranges with a manifest, and copies between stores, both checked and resumable.

A range's facts are its rows, the sum of a money column, and a checksum that no
order of rows changes: the sum of all rows' 64-bit hashes.  The manifest's entry
of a range is written after its rows were read back with the same facts, so an
export that broke goes on at the first range without one.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType

NULL = "\\N"  # stands for null in the files; a text that is just this cannot be told from it
RANGES = "range int, low long, high long, rows long, money decimal(38,2), checksum decimal(38,0)"


def _plain(df: DataFrame, name: str) -> Column:
    """A column as text that copies keep: numbers by value, times in UTC microseconds."""
    kind = df.schema[name].dataType
    if isinstance(kind, DoubleType | FloatType | DecimalType):
        return F.format_string("%.9e", F.col(name).cast("double"))
    if kind.typeName() in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("string")
    return F.col(name).cast("string")


def facts(df: DataFrame, money: str, by: list[str]) -> DataFrame:
    """Rows, money and checksum of each group; the checksum is of all columns but those of ``by``, by name."""
    hashed = F.xxhash64(*(F.coalesce(F.concat(F.lit("="), _plain(df, c)), F.lit("null")) for c in sorted(df.columns) if c not in by))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.col(money).cast("decimal(28,2)")), F.lit(0)).cast("decimal(38,2)").alias("money"),
        F.sum(hashed.cast("decimal(38,0)")).cast("decimal(38,0)").alias("checksum"),
    )


def key_ranges(df: DataFrame, key: str, count: int) -> list[tuple[int, int]]:
    """At most ``count`` ranges [low, high] of a whole-number key, of about equal rows; every non-null key is in one."""
    cuts = [i / count for i in range(1, count)]
    k = F.col(key).cast("long")
    one = df.agg(F.min(k).alias("low"), F.max(k).alias("high"), (F.percentile_approx(k, cuts, 10_000) if cuts else F.array()).alias("cuts")).first()
    if one["low"] is None:
        return []
    ends = sorted({*(one["cuts"] or []), one["high"]})
    return list(zip([one["low"], *(e + 1 for e in ends[:-1])], ends, strict=True))


def _range_of(key: str, ranges: list[tuple[int, int]]) -> Column:
    k = F.col(key).cast("long")
    return sum(((k > high).cast("int") for _, high in ranges[:-1]), F.lit(0))


def manifest(df: DataFrame, key: str, money: str, ranges: list[tuple[int, int]]) -> DataFrame:
    """The facts of every range of a table: range, low, high, rows, money, checksum; one pass over it."""
    spark = df.sparkSession
    bounds = spark.createDataFrame([(i, low, high) for i, (low, high) in enumerate(ranges)], "range int, low long, high long")
    found = facts(df.where(F.col(key).isNotNull()).withColumn("range", _range_of(key, ranges)), money, ["range"])
    return bounds.join(found, "range").select("range", "low", "high", "rows", "money", "checksum")


def _there(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The entries of the ranges that an export has finished."""
    if not _there(spark, f"{path}/manifest"):
        return spark.createDataFrame([], RANGES)
    return spark.read.schema(RANGES).json(f"{path}/manifest").select("range", "low", "high", "rows", "money", "checksum")


def export(df: DataFrame, key: str, money: str, path: str, ranges: int = 16, failing: Callable[[int], None] | None = None) -> DataFrame:
    """Write a table to ``path`` as CSV in key ranges; returns the manifest.

    Rows with a null key are a range of their own, -1.  Runs again after a break:
    finished ranges whose source still has the facts of their entry stay, all
    others are written.  Raises when a range reads back otherwise.  ``failing`` is
    called with each range's number before its entry is written.
    """
    spark = df.sparkSession
    cuts = key_ranges(df, key, ranges)
    nulls = facts(df.where(F.col(key).isNull()).withColumn("range", F.lit(-1)), money, ["range"])
    nulls = nulls.select("range", F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high"), "rows", "money", "checksum")
    wanted = [tuple(r) for r in (manifest(df, key, money, cuts).union(nulls) if cuts else nulls).orderBy("range").collect()]  # one row a range
    done = {tuple(r) for r in read_manifest(spark, path).collect()}
    for entry in wanted:
        n, low, high = entry[:3]
        if entry in done:
            continue
        rows = df.where(F.col(key).isNull() if n == -1 else F.col(key).between(low, high))
        folder = f"{path}/rows/range={n}"
        rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", '""').option("nullValue", NULL).csv(folder)
        back = facts(read_range(spark, path, n, df.schema.simpleString()[7:-1]).withColumn("range", F.lit(n)), money, ["range"]).first()
        if back is None or tuple(back)[1:] != entry[3:]:
            raise ValueError(f"range {n} reads back as {back}, not as {entry}")
        if failing is not None:
            failing(n)
        spark.createDataFrame([entry], RANGES).coalesce(1).write.mode("overwrite").json(f"{path}/manifest/range={n}")
    return spark.createDataFrame(wanted, RANGES)


def read_range(spark: SparkSession, path: str, n: int, schema: str) -> DataFrame:
    """The rows of one exported range; ``schema`` as "name:type,..."."""
    fields = ", ".join("`{}` {}".format(*f.split(":", 1)) for f in _fields(schema))
    reader = spark.read.schema(fields).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
    return reader.option("emptyValue", "").option("nullValue", NULL).csv(f"{path}/rows/range={n}")


def _fields(schema: str) -> list[str]:
    """Fields of a flat schema; commas inside brackets do not part fields."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            out.append(schema[start:i])
            start = i + 1
    return [*out, schema[start:]] if schema else []


def read_store(spark: SparkSession, url: str, table: str, key: str, parts: int = 8, quote: str = '"', **options: str) -> DataFrame:
    """A table of a JDBC store, read in ``parts`` concurrent ranges of a whole-number key (one query asks for the key's bounds); ``quote`` is put around the key's name."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    one = reader.option("query", f"SELECT min({quote}{key}{quote}) AS low, max({quote}{key}{quote}) AS high FROM {table}").load().first()
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if one[0] is None or one[0] == one[1]:
        return reader.load()
    return reader.option("partitionColumn", key).option("lowerBound", int(one[0])).option("upperBound", int(one[1])).option("numPartitions", parts).load()


def copy_store(spark: SparkSession, source: str, target: str, table: str, key: str, money: str, parts: int = 8, **options: str) -> dict[str, int | Decimal]:
    """Copy a table from one JDBC store to another; returns its rows and money.

    The target's table is replaced.  Raises when rows, money or checksum of the
    copy differ from the source's, so a change in between is an error, not a thin copy.
    """
    rows = read_store(spark, source, table, key, parts, **options)
    rows.write.format("jdbc").option("url", target).option("dbtable", table).option("truncate", True).options(**options).mode("overwrite").save()
    one, other = (facts(read_store(spark, u, table, key, parts, **options), money, []).first() for u in (source, target))
    if tuple(one) != tuple(other):
        raise ValueError(f"{table}: the source has {one}, the copy {other}")
    return {"rows": one["rows"], "money": one["money"]}
