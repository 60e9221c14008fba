"""Structured Streaming jobs over landed files.

State that must outlive a micro-batch and be joined (titles, feed health,
campaigns, alerted CVEs) is a partitioned table in the shared folder: a micro-batch
adds partitions of its own or rewrites the buckets it touches, and doing so again
after a failure gives the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wirelens import fixed
from wirelens.session import fresh_path
from wirelens.streaming import alerts, campaigns, health, titles


def read_landing(spark: SparkSession, path: str, schema: str, pattern: str = "*.parquet", fmt: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    """File stream over a landing folder; each trigger takes a bounded number of files."""
    return (spark.readStream.format(fmt).schema(schema).option("pathGlobFilter", pattern)
            .option("maxFilesPerTrigger", files_per_trigger).load(path))


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is there, append to a Parquet table, return the table."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, handler, checkpoint: str, mode: str = "append") -> None:
    """Process what is there through ``handler(batch, batch_id)``."""
    query = stream.writeStream.outputMode(mode).foreachBatch(handler).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def ingest(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Restart-safe append of landed rows."""
    return run_to_table(stream, path, checkpoint)


def within_lateness(stream: DataFrame, ts: str = "ts", days: int = fixed.CUTOFF_DAYS) -> DataFrame:
    """Watermark with the ingest cutoff as lateness bound."""
    return stream.withWatermark(ts, f"{days} days")


def dedup_stream(stream: DataFrame, key: str = "hash", ts: str = "ts", days: int = fixed.CUTOFF_DAYS) -> DataFrame:
    """First row per key; the memory of keys is bounded by time."""
    return within_lateness(stream, ts, days).dropDuplicatesWithinWatermark([key])


def fuzzy_dedup_stream(stream: DataFrame, path: str, state_path: str, checkpoint: str, days: int | None = fixed.CUTOFF_DAYS) -> DataFrame:
    """Duplicate verdicts of each micro-batch of (pos, title, exempt, ts) against itself and the titles of ``days`` before.

    ``exempt`` and ``ts`` may be missing: then no row is exempt and nothing expires.
    """
    dated = "ts" in stream.columns
    seen = titles.SeenTitles(stream.sparkSession, state_path, days if dated else None)
    rows = stream.select("pos", "title", F.col("exempt") if "exempt" in stream.columns else F.lit(False).alias("exempt"),
                         (F.to_date("ts") if dated else F.lit("1970-01-01").cast("date")).alias("day"))

    def handle(batch: DataFrame, batch_id: int) -> None:
        seen.judge(batch, batch_id).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        seen.done()
        newest = batch.agg(F.max("day").cast("string")).first()[0]
        if newest:
            seen.expire(newest)

    run_batches(rows, handle, checkpoint)
    return stream.sparkSession.read.parquet(path)


def daily_counts_stream(stream: DataFrame, key: str, path: str, checkpoint: str, ts: str = "ts", days: int = fixed.CUTOFF_DAYS) -> DataFrame:
    """Running daily counts in update mode; the newest count of each (day, key) wins."""
    counted = within_lateness(stream, ts, days).groupBy(F.window(ts, "1 day").alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n"))

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.select(F.to_date("w.start").alias("day"), "key", "n").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    run_batches(counted, handle, checkpoint, "update")
    return stream.sparkSession.read.parquet(path).groupBy("day", "key").agg(F.max_by("n", "batch").alias("n"))


def feed_health_stream(stream: DataFrame, state_path: str, checkpoint: str) -> DataFrame:
    """Feed health of all fetches (url, ts, event_id, success, entry_count), in whatever order their files came."""
    state = health.Health(stream.sparkSession, state_path)
    run_batches(stream, state.add, checkpoint)
    return state.table()


def campaign_stream(stream: DataFrame, state_path: str, checkpoint: str, as_of: str) -> DataFrame:
    """Campaigns of all items (with pos, hash, event_ts and the text columns) after the last micro-batch."""
    state = campaigns.Campaigns(stream.sparkSession, state_path)
    run_batches(stream, state.add, checkpoint)
    return state.table(as_of)


def once_alerts_stream(stream: DataFrame, path: str, state_path: str, checkpoint: str, as_of: str, cap: int = fixed.KEV_ALERTS_PER_BATCH) -> DataFrame:
    """One alert per known-exploited CVE ever, at most ``cap`` per micro-batch; what is over waits for a later one.

    ``alerts.OnceAlerts`` over the same paths shows what waits and can fire it without new items.
    """
    state = alerts.OnceAlerts(stream.sparkSession, path, state_path, as_of, cap)
    run_batches(stream, state.round, checkpoint)
    return state.sent()


def outbox_stream(stream: DataFrame, path: str, checkpoint: str, style: str = "generic") -> DataFrame:
    """Alert payload rows of each micro-batch."""
    from wirelens.sinks import writers

    def handle(batch: DataFrame, batch_id: int) -> None:
        writers.alert_outbox(batch, style).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    run_batches(stream, handle, checkpoint)
    return stream.sparkSession.read.parquet(path)


def scratch(spark: SparkSession, label: str) -> tuple[str, str, str]:
    """Fresh (table, state, checkpoint) paths in the shared folder."""
    root = fresh_path(spark, label)
    return f"{root}/table", f"{root}/state", f"{root}/checkpoint"
