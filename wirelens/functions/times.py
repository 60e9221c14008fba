"""Event times: tolerant parsing, windows, slugs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wirelens.rules import let

ZONE_OFFSETS = {
    # named zones of mail dates; any other name counts as UTC
    "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500",
    "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}
ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?$"
MAIL = r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}(:\d{2})?( .*)?$"


def parse_event_time(raw: Column) -> Column:
    """Timestamp of an ISO, mail or bare date string; null when none fits, never now."""
    return let(F.regexp_replace(F.trim(raw), r" +UTC$", ""), _parsed)


def _parsed(text: Column) -> Column:
    iso = F.regexp_replace(F.regexp_replace(text, "Z$", "+00:00"), r"(:\d{2}(?:[.,]\d+)?)([+-]\d{2})(\d{2})$", "$1$2:$3")
    iso = F.regexp_replace(iso, r"^(\d{4}-\d{2}-\d{2})$", "$1T00:00:00")
    iso = F.regexp_replace(iso, r"^(.{10}[T ]\d{2}:\d{2})([+-].*)?$", "$1:00$2")
    iso = F.when(iso.rlike(r"[+-]\d{2}:\d{2}$") & (F.length(iso) > 16), iso).otherwise(F.concat(iso, F.lit("+00:00")))

    mail = F.regexp_replace(text, r"^[A-Za-z]{3,9},?\s+(?=\d)", "")
    day_time = F.regexp_extract(mail, r"^(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2})", 1)
    seconds = F.regexp_extract(mail, r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}(:\d{2})", 1)
    zone_name = F.upper(F.regexp_extract(mail, r" ([A-Za-z]+)$", 1))
    zone = F.regexp_extract(mail, r" ([+-]\d{4})$", 1)
    for name, offset in ZONE_OFFSETS.items():
        zone = F.when(zone_name == name, F.lit(offset)).otherwise(zone)
    stamp = F.concat(
        F.initcap(day_time), F.when(seconds == "", F.lit(":00")).otherwise(seconds),
        F.lit(" "), F.when(zone == "", F.lit("+0000")).otherwise(zone),
    )
    return (
        F.when(text.rlike(ISO), F.try_to_timestamp(F.replace(iso, F.lit(","), F.lit("."))))
        .when(mail.rlike(MAIL), F.try_to_timestamp(stamp, F.lit("d MMM yyyy HH:mm:ss Z")))
    )


def event_time(*candidates: Column) -> Column:
    """First candidate that parses, in the order given."""
    return F.coalesce(*[parse_event_time(c) for c in candidates])


def earliest(*times: Column) -> Column:
    """Earliest non-null time, null when all are null."""
    return F.least(*times) if len(times) > 1 else times[0]


def time_slug(ts: Column, unit: str) -> Column:
    """Text label of the hour, day, week (Sunday-based), month or year of ``ts``."""
    if unit == "week":
        number = F.floor((F.dayofyear(ts) + 7 - F.dayofweek(ts)) / 7)
        return F.concat(F.date_format(ts, "yyyy"), F.lit("-W"), F.lpad(number.cast("string"), 2, "0"))
    formats = {"hour": "yyyy-MM-dd_HH", "day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}
    return F.date_format(ts, formats[unit])


def age_days(ts: Column, as_of: Column) -> Column:
    """Exact age in days as a double."""
    return (F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(86_400_000_000)


def as_timestamp(as_of: str) -> Column:
    """The reference instant of a job, given as an ISO text in UTC."""
    return F.lit(f"{as_of}+00:00" if "+" not in as_of and "Z" not in as_of else as_of).cast("timestamp")


def reporting_window(df: DataFrame, published: str = "published") -> DataFrame:
    """One row: number of distinct ISO days, first and last day, and the text of the span."""
    day = F.when(F.col(published).rlike(r"^\d{4}"), F.substring(F.col(published), 1, 10))
    spans = df.agg(F.count_distinct(day).alias("days"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    label = (
        F.when(F.col("days") == 0, F.lit("Last 7 days"))
        .when(F.col("days") == 1, F.lit("Last 24 hours"))
        .otherwise(F.concat(F.lit("Last "), F.col("days").cast("string"), F.lit(" days ("), F.col("first_day"),
                            F.lit(" to "), F.col("last_day"), F.lit(")")))
    )
    return spans.withColumn("label", label)
