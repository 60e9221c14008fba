"""Daily counts, trend report, spikes against a rolling mean."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window

from wirelens import fixed
from wirelens.operators import tagging


def daily_counts(df: DataFrame, key: str, kind: str, ts: str = "ts") -> DataFrame:
    """Long table (day, kind, key, n). Counting the corpus makes a replay harmless."""
    day = F.to_date(ts).alias("day")
    return df.groupBy(day, F.col(key).alias("key")).agg(F.count("*").alias("n")).select("day", F.lit(kind).alias("kind"), "key", "n")


def keyword_counts(df: DataFrame, ts: str = "ts", rows=None) -> DataFrame:
    """Daily counts of the tracked keywords, one per item and keyword."""
    hits = tagging.tracked_keywords(df, rows).select(ts, F.explode_outer("tracked").alias("keyword")).filter(F.col("keyword").isNotNull())
    return daily_counts(hits, "keyword", "tracked_keyword", ts)


def spikes(counts: DataFrame, day: str, ratio: float = fixed.SPIKE_RATIO, min_count: int = fixed.SPIKE_MIN_COUNT,
           min_days: int = fixed.SPIKE_MIN_DAYS, history: int = fixed.SPIKE_HISTORY_DAYS) -> DataFrame:
    """Keys whose count on ``day`` is at least ``ratio`` times their mean over the recorded days before.

    Recorded days are the days that occur in the table (a missing key counts 0
    there). A keyword without history and with enough mentions is an emergence.
    ``counts`` is the stored daily table: it is read a few times and has one row
    per key and day, however many items there are.
    """
    today = F.to_date(F.lit(day))
    days = counts.filter(F.col("day") <= today).select("day").distinct()
    past = days.filter(F.col("day") < today).orderBy(F.desc("day")).limit(history)
    recorded = days.agg(F.count("*")).scalar()
    usual = past.agg(F.count("*")).scalar()
    first = past.agg(F.min("day")).scalar()
    window = counts.filter((F.col("day") >= first) & (F.col("day") <= today))
    summed = window.groupBy("kind", "key").agg(
        F.sum(F.when(F.col("day") == today, F.col("n"))).alias("today_count"),
        F.sum(F.when(F.col("day") < today, F.col("n")).otherwise(0)).alias("past_count"))
    judged = summed.withColumn("recorded_days", recorded).withColumn("avg_count", F.col("past_count") / usual).filter(
        (F.col("recorded_days") >= min_days) & (F.col("today_count") >= min_count))
    emerged = (F.col("past_count") == 0) & (F.col("kind") != "category")
    return judged.filter(emerged | ((F.col("past_count") > 0) & (F.col("today_count") >= F.col("avg_count") * ratio))).select(
        "key", F.when(emerged, "new_emergence").otherwise(F.col("kind")).alias("type"), "today_count", "avg_count",
        F.when(emerged, F.col("today_count").cast("double")).otherwise(F.col("today_count") / F.col("avg_count")).alias("spike_ratio"),
    ).orderBy(F.desc("spike_ratio"), "key")


def trend_report(counts: DataFrame, day: str, top: int = 20) -> dict[str, DataFrame]:
    """Top keywords, category sums over 7 and 30 days, daily totals and the date range."""
    today = F.to_date(F.lit(day))
    month = counts.filter(F.col("day") >= F.date_sub(today, fixed.TREND_HISTORY_DAYS))
    sums = month.groupBy("kind", "key").agg(
        F.sum(F.when(F.col("day") >= F.date_sub(today, 7), F.col("n")).otherwise(0)).alias("n_7d"), F.sum("n").alias("n_30d"))
    keywords = sums.filter("kind <> 'category'")
    return {
        "top_keywords_7d": keywords.filter("n_7d > 0").orderBy(F.desc("n_7d"), "key").limit(top),
        "top_keywords_30d": keywords.orderBy(F.desc("n_30d"), "key").limit(top),
        "categories": sums.filter("kind = 'category'"),
        "daily_totals": month.filter("kind = 'category'").groupBy("day").agg(F.sum("n").alias("total")),
        "date_range": month.agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count_distinct("day").alias("days")),
    }


def escalations(levels: DataFrame, key: str | None = None, ts: str = "ts", level: str = "level") -> DataFrame:
    """Previous level of each hour and whether it rose or fell.

    Levels are first reduced to the last one per key and hour, so the ordered
    window sees at most one row per hour, however many rows arrive.
    """
    from wirelens.functions import bands

    keys = [key] if key else []
    hourly = levels.groupBy(*keys, F.date_trunc("hour", ts).alias("hour")).agg(F.max(F.struct(ts, level)).alias("last"))
    named = hourly.select(*keys, "hour", F.col(f"last.{level}").alias("level"))
    before = F.lag("level").over(Window.partitionBy(*keys).orderBy("hour")) if keys else F.lag("level").over(Window.orderBy("hour"))
    ranked = named.withColumn("previous_level", before)
    step = bands.level_rank(F.col("level")) - bands.level_rank(F.col("previous_level"))
    return ranked.withColumn("change", F.when(F.col("previous_level").isNull(), "first").when(step > 0, "escalation")
                             .when(step < 0, "de-escalation").otherwise("same"))
