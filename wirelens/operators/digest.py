"""Digest candidates: age buckets, hoisting, fill rules, trailing context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wirelens import fixed
from wirelens.functions import times


def age_bucket(ts: Column, as_of: str) -> Column:
    """day1, day3, or older (also for undated rows)."""
    age = times.age_days(ts, times.as_timestamp(as_of))
    return F.when(age <= 1, "day1").when(age <= 3, "day3").otherwise("older")


def hoist_kev(df: DataFrame, as_of: str, hours: int = fixed.KEV_TENURE_HOURS, ts: str = "event_ts") -> DataFrame:
    """Known-exploited items of days 2-3 join the first bucket within their tenure."""
    age_hours = times.age_days(F.col(ts), times.as_timestamp(as_of)) * 24
    lifted = (F.col("bucket") == "day3") & F.coalesce("kev_listed", F.lit(False)) & (age_hours <= hours)
    marked = df.withColumn("hoisted", F.coalesce(lifted, F.lit(False)))
    return marked.withColumn("bucket", F.when(F.col("hoisted"), "day1").otherwise(F.col("bucket")))


def digest_candidates(df: DataFrame, cap: int = fixed.DIGEST_CAP, trigger: int = fixed.DIGEST_FILL, fill: int = fixed.DIGEST_FILL, ts: str = "event_ts") -> DataFrame:
    """First bucket, topped up to ``fill`` from the second when it has fewer than ``trigger`` items.

    When both are empty the whole corpus is used. Adds ``slot``; at most ``cap``
    rows, taken as a bounded top-N before they are numbered.
    """
    from pyspark.sql import Window

    sizes = df.agg(F.struct(F.count_if(F.col("bucket") == "day1").alias("fresh"), F.count_if(F.col("bucket") != "older").alias("dated")).alias("n"))
    counted = df.withColumn("_n", sizes.scalar()).withColumn("_fresh", F.col("_n.fresh")).withColumn("_dated", F.col("_n.dated"))
    if "hoisted" not in df.columns:
        counted = counted.withColumn("hoisted", F.lit(False))
    section = F.when(F.col("_dated") == 0, 0).when(F.col("bucket") == "day1", F.when(F.coalesce("hoisted", F.lit(False)), 1).otherwise(0)).when(F.col("bucket") == "day3", 2)
    order = [F.col("_section"), F.col(ts).desc_nulls_last(), F.col("pos")]
    taken = counted.withColumn("_section", section).filter(F.col("_section").isNotNull()).orderBy(*order).limit(max(cap, fill))
    numbered = taken.withColumn("slot", F.row_number().over(Window.orderBy(*order)))  # at most ``cap`` rows
    room = F.when(F.col("_fresh") < trigger, F.greatest(F.col("_fresh"), F.lit(fill))).otherwise(F.col("_fresh"))
    allowed = (F.col("_section") < 2) | (F.col("slot") <= room)
    return numbered.filter(allowed & (F.col("slot") <= cap)).drop("_n", "_fresh", "_dated", "_section")


def trailing_context(df: DataFrame, digest: DataFrame, categories: int = 5, titles: int = 15, ts: str = "event_ts") -> dict[str, DataFrame]:
    """Top categories and latest titles of the week outside the digest."""
    rest = df.filter("bucket <> 'day1'").join(digest.select("pos"), "pos", "left_anti")
    top = rest.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(categories)
    latest = rest.orderBy(F.col("bucket"), F.col(ts).desc_nulls_last(), "pos").limit(titles).select("pos", "title")
    return {"categories": top, "titles": latest}
