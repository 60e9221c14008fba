"""Usage, cost, run and feedback roll-ups; the weekly digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wirelens.functions import text as tx, times


def usage_rollup(events: DataFrame, dims: tuple[str, ...] = (), ts: str = "ts") -> DataFrame:
    """Calls and tokens per day and the given dimensions; events without tokens do not count."""
    counted = events.filter((F.col("prompt_tokens") > 0) | (F.col("completion_tokens") > 0))
    return counted.groupBy(F.to_date(ts).alias("day"), *dims).agg(
        F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))


def recent_usage(events: DataFrame, days: int = 7, ts: str = "ts") -> DataFrame:
    """The last recorded days, newest first."""
    return usage_rollup(events, ts=ts).orderBy(F.desc("day")).limit(days)


def cost_rollup(events: DataFrame, prices: dict[str, float], budget: float, ts: str = "ts") -> DataFrame:
    """Cost per day by four prices per million tokens, with the budget flag."""
    million = F.lit(1_000_000)
    fresh = F.col("input_tokens") - F.col("cache_read_tokens") - F.col("cache_write_tokens")
    cost = (fresh / million * prices["input"] + F.col("output_tokens") / million * prices["output"]
            + F.col("cache_read_tokens") / million * prices["cache_read"] + F.col("cache_write_tokens") / million * prices["cache_write"])
    daily = events.groupBy(F.to_date(ts).alias("day")).agg(F.sum(cost).alias("cost_usd"), F.count("*").alias("api_calls"))
    return daily.withColumn("over_budget", F.col("cost_usd") >= budget)


def run_metrics(df: DataFrame, seen_flag: str, cyber_flag: str, enriched_flag: str) -> DataFrame:
    """Funnel of one run in one pass: fetched, unique, cyber, enriched, and the shares."""
    row = df.agg(F.count("*").alias("fetched"), F.count_if(~F.col(seen_flag)).alias("deduped"),
                 F.count_if(~F.col(seen_flag) & F.col(cyber_flag)).alias("cyber"),
                 F.count_if(~F.col(seen_flag) & F.col(cyber_flag) & F.col(enriched_flag)).alias("enriched"))
    return row.withColumn("hit_rate", F.col("cyber") / F.nullif("deduped", F.lit(0)))


def feedback_summary(df: DataFrame, column: str = "correct_category", top: int = 10) -> DataFrame:
    """Most frequent corrections with the total number of submissions."""
    total = df.agg(F.count("*")).scalar()
    named = df.filter(~tx.blank(F.col(column).cast("string")))
    return named.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(top).withColumn("total", total)


def week_of(df: DataFrame, day: str, date: str = "date", key: str = "hash", fallback: str = "link") -> DataFrame:
    """Rows of the ISO week (Monday to Sunday) of ``day``, first day per key.

    ``date`` is the partition column, so other days are never read.
    """
    from wirelens.operators.corpus import keep_first

    monday = F.date_trunc("week", F.lit(day).cast("timestamp")).cast("date")
    week = df.filter((F.col(date) >= monday) & (F.col(date) < F.date_add(monday, 7)))
    keyed = week.withColumn("_key", F.coalesce(key, fallback))
    return keep_first(keyed, ["_key"], [F.col(date), F.col("pos")]).drop("_key")


def weekly_digest(df: DataFrame, categories: int = 5, sources: int = 10, incidents: int = 20, floor: int = 80) -> dict[str, DataFrame]:
    """Totals, top categories, top sources and the most confident incidents."""
    def top(column: str, n: int) -> DataFrame:
        return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)

    return {
        "totals": df.agg(F.count("*").alias("total_articles"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("average_confidence")),
        "categories": top("category", categories),
        "sources": top("source", sources),
        "incidents": df.filter(F.col("confidence") >= floor).orderBy(F.desc("confidence"), "pos").limit(incidents),
    }


def age_in_seconds(df: DataFrame, as_of: str, ts: str) -> DataFrame:
    """Seconds since the newest row, as the health ladder wants them."""
    return df.agg((times.age_days(F.max(ts), times.as_timestamp(as_of)) * 86400).alias("age"))
