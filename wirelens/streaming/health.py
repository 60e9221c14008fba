"""Feed health kept up to date by micro-batches of fetches in any order.

The marks of a feed are totals and latest moments, which merge in any order, and its open streak: the failed fetches
after the last healthy one. A healthy fetch that comes late closes the part of the streak before it and no more, so the
moments of an open streak are kept, one row each and in buckets of their own; those that the last healthy fetch closes are
dropped when their bucket is next rewritten. What is read off the two tables is what the batch form gives for all fetches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wirelens.operators import feeds
from wirelens.session import cut
from wirelens.sinks.tables import BucketTable

AT = "struct<ts: timestamp, ord: long>"
MARKS = f"url string, ok {AT}, last {AT}, quiet {AT}, total long, good long, entries long"


class Health:
    """Marks per feed, and the failed fetches since its last healthy one, in buckets of time within the feed."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.marks = BucketTable(spark, f"{path}/marks", MARKS, ["url"], buckets)
        # a feed that fails all day spreads over as many buckets as there are hours
        self.open = BucketTable(spark, f"{path}/open", f"url string, slot timestamp, at {AT}", ["url", "slot"], buckets)

    def add(self, fetches: DataFrame, batch_id: int) -> None:
        """Fold one batch of fetches (url, ts, event_id, success, entry_count) in; may be repeated."""
        rows = feeds.moments(fetches)
        totals = cut(rows.groupBy("url").agg(
            F.max(F.when(F.col("healthy"), F.col("at"))).alias("ok"), F.max("at").alias("last"),
            F.max(F.when(F.col("success") & ~F.col("healthy"), F.col("at"))).alias("quiet"), F.count("*").alias("total"),
            F.count_if("success").alias("good"), F.sum(F.when(F.col("healthy"), F.col("entry_count").cast("long")).otherwise(0)).alias("entries")))
        self.marks.merge(totals, _merged, batch_id)
        ok = self.marks.read().select("url", "ok")
        failed = rows.filter(~F.col("success")).select("url", F.date_trunc("hour", "at.ts").alias("slot"), "at")
        self.open.merge(cut(failed.join(ok, "url").filter(_open()).drop("ok")),
                        lambda old, new: old.unionByName(new.select(*old.columns)).join(ok, "url").filter(_open()).drop("ok"), batch_id)

    def table(self) -> DataFrame:
        """Health per feed with the columns and statuses of the batch form."""
        marks = self.marks.read()
        streak = self.open.read().join(marks.select("url", "ok"), "url").filter(_open()).groupBy("url").agg(
            F.count("*").alias("errors"), F.min("at").alias("first_error"), F.max("at").alias("last_error"))
        quiet = F.when(F.col("ok").isNull() | (F.col("quiet") > F.col("ok")), F.col("quiet"))
        return feeds.judged(marks.join(streak, "url", "left").select(
            "url", F.col("ok").alias("last_ok"), "last", F.col("total").alias("fetches_total"), F.col("good").alias("fetches_successful"),
            F.col("entries").alias("entries_total"), "errors", "first_error", "last_error", quiet.alias("last_quiet")))


def _open():
    return F.col("ok").isNull() | (F.col("at") > F.col("ok"))


def _merged(old: DataFrame, new: DataFrame) -> DataFrame:
    given = new.select("url", *[F.col(c).alias(f"n_{c}") for c in ("ok", "last", "quiet", "total", "good", "entries")])
    return old.join(given, "url", "full_outer").select(
        "url", *[F.greatest(c, f"n_{c}").alias(c) for c in ("ok", "last", "quiet")],
        *[(F.coalesce(c, F.lit(0)) + F.coalesce(f"n_{c}", F.lit(0))).alias(c) for c in ("total", "good", "entries")])
