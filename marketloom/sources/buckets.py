"""A table in key buckets that takes the same batch of changes any number of times.

A batch writes whole new versions of the buckets it touches into a folder of its
own, then names them in a ledger.  Readers take each bucket's version from the
latest batch in the ledger.  A batch already in the ledger is left out; one that
failed between the two writes runs again and overwrites its own folder only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class BucketTable:
    """Rows unique by ``keys`` in ``path``, dealt over a fixed number of buckets by a hash of the keys.

    Of rows with equal keys in one batch the one with the greatest ``order``
    column counts (null first, then by all columns).  ``path`` must be a folder that
    driver and executors share, for this table alone.
    """

    path: str
    schema: str
    keys: list[str]
    buckets: int = 64
    order: str | None = None

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("bucket")

    def _exists(self, spark: SparkSession, path: str) -> bool:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def _ledger(self, spark: SparkSession) -> DataFrame:
        """(batch, bucket) of all finished batches."""
        if not self._exists(spark, f"{self.path}/ledger"):
            return spark.createDataFrame([], "batch long, bucket int")
        return spark.read.schema("bucket int, batch long").parquet(f"{self.path}/ledger")

    def versions(self, spark: SparkSession) -> dict[int, int]:
        """The batch that wrote each bucket's current version: at most one entry per bucket."""
        return {r["bucket"]: r["batch"] for r in self._ledger(spark).where("bucket >= 0").groupBy("bucket").agg(F.max("batch").alias("batch")).collect()}

    def read(self, spark: SparkSession, only: set[int] | None = None) -> DataFrame:
        """The table's rows, or those of some buckets."""
        kept = {b: v for b, v in self.versions(spark).items() if only is None or b in only}
        if not kept:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*(f"{self.path}/data/batch={v}/bucket={b}" for b, v in sorted(kept.items())))

    def applied(self, spark: SparkSession, batch: int) -> bool:
        """Whether a batch is in the ledger."""
        return not self._ledger(spark).where(F.col("batch") == batch).isEmpty()

    def upsert(self, changes: DataFrame, batch: int) -> bool:
        """Rows of ``changes`` replace or join the table's; false where the batch was applied before.

        Batches must come one at a time, with growing numbers, as those of a stream do.
        """
        spark = changes.sparkSession
        if self.applied(spark, batch):
            return False
        self._write(changes, batch)
        touched = spark.read.parquet(f"{self.path}/data/batch={batch}") if self._wrote(spark, batch) else None
        named = touched.select("bucket").distinct() if touched is not None else spark.createDataFrame([(-1,)], "bucket int")
        # one file: the batch is in the ledger whole or not at all
        named.select(F.col("bucket").cast("int"), F.lit(batch).cast("long").alias("batch")).coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")
        return True

    def _wrote(self, spark: SparkSession, batch: int) -> bool:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/batch={batch}/bucket=*")
        return len(place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)) > 0

    def _write(self, changes: DataFrame, batch: int) -> None:
        """New versions of the touched buckets, in the batch's own folder."""
        spark = changes.sparkSession
        columns = StructType.fromDDL(self.schema).names
        first = [F.col(self.order).desc_nulls_last()] if self.order else []
        latest = Window.partitionBy(*self.keys).orderBy(*first, *(F.col(c).desc_nulls_last() for c in columns))
        rows = changes.select(*columns).withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")
        touched = {r["bucket"] for r in rows.select(self._bucket()).distinct().collect()}  # at most ``buckets``
        before = self.read(spark, touched)
        same = [before[k].eqNullSafe(rows[k]) for k in self.keys]
        on = same[0]
        for s in same[1:]:
            on = on & s
        kept = before.join(rows.select(*self.keys), on, "left_anti").unionByName(rows)
        kept.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch={batch}")

    def sink(self):  # noqa: ANN201
        """A function for ``foreachBatch``."""
        return lambda frame, batch: self.upsert(frame, batch) and None

    def clear_old(self, spark: SparkSession) -> int:
        """Delete versions that later ones replaced, and what no ledger names; tell how many folders went.  No reader may be open."""
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/batch=*/bucket=*")
        system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        current = {f"batch={v}/bucket={b}" for b, v in self.versions(spark).items()}
        old = [s.getPath() for s in system.globStatus(place) if f"{s.getPath().getParent().getName()}/{s.getPath().getName()}" not in current]
        return sum(bool(system.delete(p, True)) for p in old)
