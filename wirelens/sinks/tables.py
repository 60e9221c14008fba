"""Keyed tables that grow by batches: plain partitioned Parquet under dynamic partition overwrite.

``BucketTable`` holds one row (or a few) per key. A merge reads the buckets that a batch touches, folds the batch in and
overwrites these partitions; all other files stay as they are. ``BatchTable`` only grows: each batch is a partition of
its own within its bucket or day. Both may be written again for the same batch after a failure and give the same table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows of one bucket that a task writes; larger buckets get several files.
ROWS_PER_FILE = 1_000_000


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at ``path``, on whatever store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def drop_partitions(spark: SparkSession, path: str, column: str, expired: Callable[[str], bool]) -> list[str]:
    """Delete the partitions ``column=value`` directly under ``path`` whose value is expired; returns the values."""
    if not exists(spark, path):
        return []
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for status in store.listStatus(where):
        name = status.getPath().getName()
        if status.isDirectory() and name.startswith(f"{column}=") and expired(name.split("=", 1)[1]):
            store.delete(status.getPath(), True)
            gone.append(name.split("=", 1)[1])
    return sorted(gone)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly under ``path``."""
    if not exists(spark, path):
        return []
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    return sorted(s.getPath().getName() for s in found if s.isDirectory())


def swap(spark: SparkSession, new: str, path: str, aside: str) -> None:
    """Put the folder ``new`` in the place of ``path``; what was there goes."""
    to = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    store = to(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(to(path)):
        store.rename(to(path), to(aside))
    if not store.rename(to(new), to(path)):
        raise OSError(f"cannot move {new} to {path}")
    if store.exists(to(aside)):
        store.delete(to(aside), True)


def _write(df: DataFrame, path: str, partitions: list[str]) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option(
        "maxRecordsPerFile", ROWS_PER_FILE).partitionBy(*partitions).parquet(path)


class BucketTable:
    """Rows by key in ``buckets`` partitions of the key's hash.

    Every rewritten bucket notes the number of the merge that wrote it (``stamp``; numbers only rise). A merge that is
    repeated after a failure leaves those buckets alone that already have its number. The number of buckets is fixed when
    the table is made and follows its expected size. ``schema`` lists the columns;
    ``bucket`` and ``stamp`` are the table's own.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 16):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path, schema, keys, buckets
        self.columns = spark.createDataFrame([], schema).columns

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame:
        schema = f"{self.schema}, stamp long, there boolean, bucket int"
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def read(self, only: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets (a partition filter)."""
        rows = self._stored() if only is None else self._stored().filter(F.col("bucket").isin(only))
        return rows.filter("there").select(*self.columns)

    def merge(self, changes: DataFrame, fold: Callable[[DataFrame, DataFrame], DataFrame], stamp: int) -> list[int]:
        """Replace the touched buckets by ``fold(their rows, changes)``; returns the numbers of the buckets written.

        ``changes`` has the key columns; ``fold`` gives rows of this table whose keys lie in the same buckets.
        """
        placed = changes.withColumn("bucket", self.bucket())
        done = {r.bucket for r in self._stored().filter(F.col("stamp") >= stamp).select("bucket").distinct().collect()}
        touched = sorted({r.bucket for r in placed.select("bucket").distinct().collect()} - done)
        if not touched:
            return []
        rows = fold(self.read(touched), placed.filter(F.col("bucket").isin(touched)).drop("bucket")).select(*self.columns)
        marks = self.spark.createDataFrame([(b,) for b in touched], "bucket int")  # an emptied bucket is replaced too
        full = rows.withColumn("bucket", self.bucket()).withColumn("there", F.lit(True)).unionByName(
            marks.withColumn("there", F.lit(False)), allowMissingColumns=True)
        salt = F.pmod(F.xxhash64(*[c for c in self.columns]), F.lit(4))  # a full bucket is written by several tasks
        stamped = full.withColumn("stamp", F.lit(stamp).cast("long")).select(*self.columns, "stamp", "there", "bucket")
        _write(stamped.repartition("bucket", salt), self.path, ["bucket"])
        return touched

    def upsert(self, rows: DataFrame, stamp: int) -> list[int]:
        """Rows by key: given ones replace stored ones of their key, other keys stay."""
        return self.merge(rows, lambda old, new: new.select(*self.columns).unionByName(old.join(new.select(*self.keys), self.keys, "left_anti")), stamp)


class BatchTable:
    """Rows that only come in, in partitions of one column (a bucket or a day) and the batch that brought them."""

    def __init__(self, spark: SparkSession, path: str, schema: str, by: str):
        self.spark, self.path, self.schema, self.by = spark, path, schema, by
        self.columns = [c for c in spark.createDataFrame([], schema).columns if c != by]

    def append(self, rows: DataFrame, batch_id: int) -> None:
        """Store the rows of a batch; a repeated batch replaces its own partitions."""
        _write(rows.select(*self.columns, self.by, F.lit(batch_id).cast("long").alias("batch")).repartition(self.by, F.pmod(F.xxhash64(*self.columns), F.lit(4))),
               self.path, [self.by, "batch"])

    def read(self, before: int | None = None) -> DataFrame:
        """All rows, or those of the batches before one."""
        schema = f"{self.schema}, batch long"
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], schema).select(*self.columns, self.by)
        rows = self.spark.read.schema(schema).parquet(self.path)
        return (rows if before is None else rows.filter(F.col("batch") < before)).select(*self.columns, self.by)
