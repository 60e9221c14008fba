"""Feed health from fetch events, signal scores, reports.

The state of a feed depends on the order of its fetches, yet every field can be
read off a few marks: the last healthy fetch, the errors after it, the last
quiet fetch. Those are plain aggregates, so a feed that produces a third of all
events is summed in parallel instead of being replayed in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wirelens import fixed


def moments(events: DataFrame, url: str = "url", ts: str = "ts", order: str = "event_id") -> DataFrame:
    """(url, at, success, entry_count, healthy) of every fetch."""
    at = F.struct(F.col(ts).alias("ts"), F.col(order).alias("ord"))
    return events.select(F.col(url).alias("url"), at.alias("at"), "success", "entry_count", (F.col("success") & (F.col("entry_count") > 0)).alias("healthy"))


def fetch_marks(events: DataFrame, url: str = "url", ts: str = "ts", order: str = "event_id") -> DataFrame:
    """One row per feed: last healthy fetch, totals, and the errors and quiet fetches after it.

    Fetches are reduced per feed and hour first, so the rows of a feed with very
    many fetches meet their marks in as many groups as there are hours; only
    hourly rows are then combined per feed.
    """
    rows = moments(events, url, ts, order).withColumn("slot", F.date_trunc("hour", "at.ts"))
    hourly = rows.groupBy("url", "slot").agg(
        F.max(F.when(F.col("healthy"), F.col("at"))).alias("ok"), F.max("at").alias("last"),
        F.count("*").alias("total"), F.count_if("success").alias("good"),
        F.sum(F.when(F.col("healthy"), F.col("entry_count").cast("long")).otherwise(0)).alias("entries"))
    later = rows.join(hourly.select("url", "slot", "ok"), ["url", "slot"]).filter(F.col("ok").isNull() | (F.col("at") > F.col("ok")))
    after = later.groupBy("url", "slot").agg(
        F.count_if(~F.col("success")).alias("errors"), F.min(F.when(~F.col("success"), F.col("at"))).alias("first_error"),
        F.max(F.when(~F.col("success"), F.col("at"))).alias("last_error"), F.max(F.when(F.col("success"), F.col("at"))).alias("last_quiet"))
    slots = hourly.join(after, ["url", "slot"], "left")
    whole = slots.groupBy("url").agg(
        F.max("ok").alias("last_ok"), F.max("last").alias("last"), F.sum("total").alias("fetches_total"),
        F.sum("good").alias("fetches_successful"), F.sum("entries").alias("entries_total"))
    tail = slots.join(whole.select("url", "last_ok"), "url").filter(
        F.col("last_ok").isNull() | (F.col("ok") == F.col("last_ok")) | (F.col("slot") > F.col("last_ok.ts")))
    streak = tail.groupBy("url").agg(
        F.sum("errors").alias("errors"), F.min("first_error").alias("first_error"), F.max("last_error").alias("last_error"), F.max("last_quiet").alias("last_quiet"))
    return whole.join(streak, "url", "left")


def feed_health(events: DataFrame, url: str = "url", ts: str = "ts", order: str = "event_id") -> DataFrame:
    """State per feed after all its fetches (url, ts, success, entry_count)."""
    return judged(fetch_marks(events, url, ts, order))


def judged(marks: DataFrame) -> DataFrame:
    """Health columns and status of each feed from its marks."""
    def days(a: Column, b: Column) -> Column:
        return (F.unix_micros(a) - F.unix_micros(b)) / F.lit(86_400_000_000)

    error_days = days(F.col("last_error.ts"), F.col("first_error.ts"))
    after_errors = F.when(F.col("last_error").isNull(), "ok").when(error_days >= fixed.DEAD_DAYS, "dead").when(
        error_days >= fixed.SUSPECT_DAYS, "suspect").otherwise("error")
    quiet_last = F.col("last_quiet").isNotNull() & (F.col("last_error").isNull() | (F.col("last_quiet") > F.col("last_error")))
    quiet = F.when(F.col("last_ok").isNotNull() & (days(F.col("last_quiet.ts"), F.col("last_ok.ts")) >= fixed.STALE_DAYS), "stale").when(
        F.col("last_ok").isNull() & (F.col("fetches_successful") >= fixed.SILENT_MIN_FETCHES), "silent")
    return marks.select(
        "url", F.coalesce("errors", F.lit(0)).alias("consecutive_errors"), F.col("first_error.ts").alias("first_error"),
        F.col("last_ok.ts").alias("last_success"), F.col("last.ts").alias("last_checked"),
        F.when(quiet_last, F.coalesce(quiet, after_errors)).otherwise(after_errors).alias("status"),
        "fetches_total", "fetches_successful", "entries_total")


def error_streaks(events: DataFrame, as_of: str, url: str = "url", ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Open error streak per feed: errors since the last healthy fetch and their age in days."""
    from wirelens.functions import times

    state = feed_health(events, url, ts, order).filter("consecutive_errors > 0")
    return state.select("url", "consecutive_errors", "first_error", times.age_days(F.col("first_error"), times.as_timestamp(as_of)).alias("error_days"))


def signal_scores(health: DataFrame) -> DataFrame:
    """Score 0-100: success rate x productivity (20 entries per fetch is full) x freshness."""
    rate = F.col("fetches_successful") / F.nullif("fetches_total", F.lit(0))
    per_fetch = F.col("entries_total") / F.nullif("fetches_successful", F.lit(0))
    weights = F.create_map(*[F.lit(x) for pair in fixed.FRESHNESS.items() for x in pair])
    freshness = F.coalesce(F.try_element_at(weights, F.coalesce("status", F.lit("ok"))), F.lit(fixed.FRESHNESS_OTHER))
    score = rate * F.least(per_fetch / 20.0, F.lit(1.0)) * freshness * 100.0
    return health.withColumn("avg_entries_per_fetch", F.coalesce(per_fetch, F.lit(0.0))).withColumn(
        "signal_score", F.coalesce(score, F.lit(0.0))).orderBy(F.desc("signal_score"), "url")


def health_report(health: DataFrame) -> DataFrame:
    """One row: tracked feeds and the number in each status."""
    statuses = list(fixed.FRESHNESS)
    return health.agg(F.count("*").alias("total_tracked"), *[F.count_if(F.col("status") == s).alias(s) for s in statuses])


def failing_feeds(health: DataFrame) -> DataFrame:
    """Dead and suspect feeds with their errors, worst first."""
    return health.filter(F.col("status").isin("dead", "suspect")).select("url", "status", "consecutive_errors", "last_success").orderBy(
        F.desc("consecutive_errors"), "url")
