"""Session helpers shared by every job."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """UTC rendering, adaptive joins, and small partitions for text-heavy stages.

    Text work is bound by CPU, not by bytes, so merged shuffle partitions may
    stay small; with large inputs the parallelism-first rule decides anyway.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    Only a local session (tests, laptops) may fall back to a temporary folder;
    a cluster without ``spark.checkpoint.dir`` is a configuration error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context.getCheckpointDir()
    if named is None and current is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="spark-")
    if current is None:
        context.setCheckpointDir(named)
        current = context.getCheckpointDir()
    return named or current


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder so iterative plans stay short.

    A reliable checkpoint survives lost executors, unlike the local one.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, at: str | None = None, codec: str = "snappy") -> DataFrame:
    """``df`` written once to the shared folder and read from there: short lineage that survives lost executors."""
    at = at or fresh_path(df.sparkSession, "table")
    df.write.option("compression", codec).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a step's own folder under the shared one, once nothing reads it any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps whose results are stored, rather than when the driver next collects garbage.

    Files of a DataFrame that is still referred to stay.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """Give a text table at least one task per core.

    Tagging is bound by CPU. A table of few row groups would run on as few
    cores; a large one already has more scan tasks than cores and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
