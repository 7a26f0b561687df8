"""A table of one row for each key, kept in hash partitions: a batch rewrites only those its keys fall into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import first_per_key

BUCKETS = 64
_BUCKET = "key_bucket"


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _done(spark: SparkSession, path: str) -> bool:
    return _there(spark, f"{path}/_SUCCESS")


class KeyedTable:
    """Rows under ``path/rows``, by hash partitions of ``key``; their number is fixed by the first batch.

    A batch is merged into a copy of the partitions it touches first (``path/staged``), then
    the copy takes their place, then the batch is noted (``path/ledger``).  A batch that is
    noted changes nothing when it comes again; one that was cut short goes on from its copy.
    Batches must come one after the other.  Rows that fail ``check``, and rows without a
    key, go to ``path/rejected``; the others are written all the same.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        if not _done(spark, f"{self.path}/meta"):
            spark.createDataFrame([(key, buckets)], "key string, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/meta")
        known, self.buckets = spark.read.parquet(f"{self.path}/meta").first()
        if known != key:
            raise ValueError(f"the table's key is {known}")

    def rows(self) -> DataFrame:
        return self._stored().drop(_BUCKET)

    def _stored(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def upsert(self, rows: DataFrame, batch: int | str, order: str | Column, check: Column | None = None) -> bool:
        """Lays ``rows`` over the table; of rows of one key the first by ``order`` counts.  False for a batch that is noted already."""
        if _BUCKET in rows.columns:
            raise ValueError(f"{_BUCKET} is taken")
        ledger, copy = f"{self.path}/ledger/{batch}", f"{self.path}/staged/{batch}"
        if _done(self.spark, ledger):
            return False
        if not _done(self.spark, copy):
            self._merge(rows, copy, f"{self.path}/rejected/{batch}", order, check)
        merged = self.spark.read.parquet(copy) if self.spark.read.parquet(f"{copy}-size").first()[0] else None
        if merged is not None:
            merged.repartition(_BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_BUCKET).parquet(f"{self.path}/rows")
        self.spark.createDataFrame([(str(batch),)], "batch string").coalesce(1).write.mode("overwrite").parquet(ledger)
        self._drop(copy)
        self._drop(f"{copy}-size")
        return True

    def _merge(self, rows: DataFrame, copy: str, rejected: str, order: str | Column, check: Column | None) -> None:
        good = F.col(self.key).isNotNull() & (F.lit(True) if check is None else F.coalesce(check, F.lit(False)))
        rows.where(~good).write.mode("overwrite").parquet(rejected)
        new = first_per_key(rows.where(good), self.key, order).withColumn(_BUCKET, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
        # At most as many as there are partitions.
        touched = [r[0] for r in new.select(_BUCKET).distinct().collect()]
        merged = new
        if _there(self.spark, f"{self.path}/rows"):
            old = self._stored().where(F.col(_BUCKET).isin(touched)) if touched else self._stored().limit(0)
            merged = old.join(new.select(self.key), self.key, "left_anti").unionByName(new, allowMissingColumns=True)
        self.spark.createDataFrame([(len(touched),)], "n int").coalesce(1).write.mode("overwrite").parquet(f"{copy}-size")
        merged.write.mode("overwrite").parquet(copy)

    def _drop(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def upserts(stream: DataFrame, path: str, key: str, order: str, checkpoint: str, buckets: int = BUCKETS):  # noqa: ANN201  a stream writer
    """A stream's writer into a :class:`KeyedTable`; a batch is known by its number, so replays after a failure change nothing."""

    def land(rows: DataFrame, number: int) -> None:
        KeyedTable(rows.sparkSession, path, key, buckets).upsert(rows, number, order)

    return stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
