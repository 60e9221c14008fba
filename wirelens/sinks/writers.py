"""Writers. Each takes a DataFrame and leaves the layout a reader expects."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from wirelens import fixed
from wirelens.functions import text as tx, times
from wirelens.operators.corpus import top_n
from wirelens.sinks import tables

EMITTER = "wirelens"


def write_snapshot(df: DataFrame, path: str, as_of: str) -> None:
    """Hour partition of the corpus; rewriting an hour replaces only that hour."""
    at = times.as_timestamp(as_of)
    stamped = df.withColumn("date", F.date_format(at, "yyyy-MM-dd")).withColumn("hour", F.date_format(at, "HH"))
    stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "hour").parquet(path)


def replace_latest(df: DataFrame, path: str) -> None:
    """The corpus at ``path`` anew: written beside it, then put in its place; the old copy goes."""
    aside = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    df.write.parquet(f"{aside}-new")
    tables.swap(df.sparkSession, f"{aside}-new", path, f"{aside}-old")


def write_keyed(df: DataFrame, path: str, key: str, merge: int, buckets: int = 16) -> list[int]:
    """Upsert into a keyed table: new rows win, absent keys stay, files of untouched buckets too.

    ``merge`` is the number of this upsert (rising); one that is repeated after a failure does no harm. The table has the
    columns of ``df``; of rows that share a key the smallest counts. Returns the buckets written.
    """
    one = df.groupBy(key).agg(F.min(F.struct(*[c for c in df.columns if c != key])).alias("row")).select(key, "row.*")
    return keyed_table(df, path, key, buckets).upsert(one, merge)


def keyed_table(df: DataFrame, path: str, key: str, buckets: int = 16) -> tables.BucketTable:
    """The table of ``write_keyed`` at ``path`` with the columns of ``df``."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return tables.BucketTable(df.sparkSession, path, schema, [key], buckets)


def rss_items(df: DataFrame) -> DataFrame:
    """Item rows in the column layout of a feed entry."""
    return df.select("title", "link", F.coalesce("published", F.lit("")).alias("pubDate"), F.col("summary").alias("description"),
                     "category", F.col("hash").alias("guid"))


def write_rss_items(df: DataFrame, path: str) -> None:
    """Feed entries as XML part files with one item per row."""
    rss_items(df).write.mode("overwrite").format("xml").option("rootTag", "channel").option("rowTag", "item").save(path)


def _stamp(raw, as_of: str):
    return F.date_format(F.coalesce(times.parse_event_time(raw), times.as_timestamp(as_of)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def stix_objects(df: DataFrame, iocs: DataFrame, as_of: str) -> DataFrame:
    """Exchange objects (id, type, object): one identity, a report per item, an indicator per supported value.

    Ids come from the content, so a rerun gives the same objects. Indicators are
    their own rows; a report refers to the identity that made it.
    """
    identity = tx.typed_id("identity", F.lit(EMITTER))
    who = df.sparkSession.range(1).select(identity.alias("id"), F.lit("identity").alias("type"), F.to_json(F.struct(
        F.lit("identity").alias("type"), F.lit("2.1").alias("spec_version"), identity.alias("id"), F.lit("2024-01-01T00:00:00Z").alias("created"),
        F.lit("2024-01-01T00:00:00Z").alias("modified"), F.lit(EMITTER).alias("name"), F.lit("system").alias("identity_class"))).alias("object"))
    slug = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit("-"))
    at, seed = _stamp(F.col("published"), as_of), F.coalesce(F.nullif("link", F.lit("")), F.col("title"))
    report_id = tx.typed_id("report", seed)
    reports = df.select(report_id.alias("id"), F.lit("report").alias("type"), F.to_json(F.struct(
        F.lit("report").alias("type"), F.lit("2.1").alias("spec_version"), report_id.alias("id"), identity.alias("created_by_ref"), at.alias("created"), at.alias("modified"),
        F.col("title").alias("name"), F.coalesce("summary", F.lit("")).alias("description"), at.alias("published"), F.array(F.lit("threat-report")).alias("report_types"),
        F.array(identity).alias("object_refs"), F.array(slug(F.coalesce("category", F.lit("General Cyber Threat"))), slug(F.coalesce("feed_region", F.lit("Global")))).alias("labels"),
        F.greatest(F.lit(0), F.least(F.lit(100), F.col("confidence"))).alias("confidence"),
        F.array(F.struct(F.col("source").alias("source_name"), F.col("link").alias("url"))).alias("external_references"))).alias("object"))
    pattern, seen, ind_id = tx.stix_pattern(F.col("kind"), F.col("value")), _stamp(F.col("published"), as_of), tx.typed_id("indicator", F.col("value"))
    indicators = iocs.filter(pattern.isNotNull()).select(ind_id.alias("id"), F.lit("indicator").alias("type"), F.to_json(F.struct(
        F.lit("indicator").alias("type"), F.lit("2.1").alias("spec_version"), ind_id.alias("id"), identity.alias("created_by_ref"), seen.alias("created"), seen.alias("modified"),
        F.concat(F.coalesce("malware", F.lit("unknown")), F.lit(" — "), F.lower("kind"), F.lit(" indicator")).alias("name"), pattern.alias("pattern"), F.lit("stix").alias("pattern_type"),
        seen.alias("valid_from"), F.array(F.lit("malicious-activity")).alias("labels"), F.array(F.lit("malicious-activity")).alias("indicator_types"))).alias("object"))
    return who.unionByName(reports).unionByName(indicators)


def stix_bundle_id(objects: DataFrame) -> DataFrame:
    """One row with the bundle id: a digest over the set of member ids, not over the clock.

    Member digests are summed as four 60-bit words, which is order-free, so the
    ids never have to meet in one place.
    """
    digest = F.sha2("id", 256)
    words = [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    summed = objects.select("id").distinct().agg(F.count("*").alias("members"), *[F.sum(w).alias(f"w{i}") for i, w in enumerate(words)])
    seed = F.concat_ws(",", *[F.col(c).cast("string") for c in ("members", "w0", "w1", "w2", "w3")])
    return summed.select(tx.typed_id("bundle", seed).alias("bundle_id"), "members")


def alert_outbox(df: DataFrame, style: str = "generic", order: str = "pos") -> DataFrame:
    """One payload row for the alertable items: five (chat) or ten (generic) shown, the rest counted."""
    shown = 5 if style == "chat" else 10
    total = df.agg(F.count("*")).scalar()
    first = top_n(df.withColumn("_all", F.lit(1)), ["_all"], [F.col(order)], shown, "rn")
    line = F.concat(F.lit("• ["), "category", F.lit("] <"), "link", F.lit("|"), "title", F.lit("> ("), F.col("confidence").cast("string"), F.lit("%)"))
    item = F.to_json(F.struct("title", F.col("link").alias("url"), "category", "confidence", F.col("feed_region").alias("region"), F.substring("summary", 1, 300).alias("summary")))
    packed = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", (line if style == "chat" else item).alias("x")))), lambda s: s["x"]).alias("items"))
    counted = packed.withColumn("alert_count", total).filter("alert_count > 0")
    more = F.when(F.col("alert_count") > shown, F.concat(F.lit("\n…and "), (F.col("alert_count") - shown).cast("string"), F.lit(" more"))).otherwise("")
    head = F.concat(F.col("alert_count").cast("string"), F.when(F.col("alert_count") > 1, " new high-confidence threats detected\n").otherwise(" new high-confidence threat detected\n"))
    body = F.concat(head, F.array_join("items", "\n"), more) if style == "chat" else F.concat(F.lit("["), F.array_join("items", ","), F.lit("]"))
    return counted.select(F.lit(style).alias("style"), "alert_count", body.alias("payload"))


def weekly_markdown(parts: dict[str, DataFrame]) -> DataFrame:
    """Markdown lines (section, line_no, line) of a weekly digest; every part is a bounded top list."""
    def numbered(df: DataFrame, section: int, order: list, line) -> DataFrame:
        from pyspark.sql import Window
        return df.select(F.lit(section).alias("section"), F.row_number().over(Window.orderBy(*order)).alias("line_no"), line.alias("line"))

    counts = F.concat(F.lit("- "), F.col("category"), F.lit(": "), F.col("n").cast("string"))
    return (
        parts["totals"].select(F.lit(1).alias("section"), F.lit(1).alias("line_no"), F.concat(
            F.lit("**Articles**: "), F.col("total_articles").cast("string"), F.lit(", mean confidence "), F.format_string("%.1f", "average_confidence")).alias("line"))
        .unionByName(numbered(parts["categories"], 2, [F.desc("n"), F.col("category")], counts))
        .unionByName(numbered(parts["sources"], 3, [F.desc("n"), F.col("source")], F.concat(F.lit("- "), F.col("source"), F.lit(": "), F.col("n").cast("string"))))
        .unionByName(numbered(parts["incidents"], 4, [F.desc("confidence"), F.col("pos")], F.concat(
            F.lit("- ["), F.col("title"), F.lit("]("), F.col("link"), F.lit(") — "), F.col("category"), F.lit(" ("), F.col("confidence").cast("string"), F.lit("%)")))))


def write_weekly(parts: dict[str, DataFrame], path: str) -> None:
    """Digest tables and their Markdown lines."""
    for name, df in {**parts, "markdown": weekly_markdown(parts)}.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def append_feedback(df: DataFrame, path: str) -> None:
    """Feedback rows as JSON lines."""
    df.write.mode("append").json(path)


def apply_retention(spark: SparkSession, path: str, as_of: str, days: int = fixed.ARCHIVE_DAYS, date: str = "date") -> list[str]:
    """Drop the partitions of a date-partitioned table that are over ``days`` old, by their value; nothing is read or copied."""
    oldest = (datetime.fromisoformat(as_of).date() - timedelta(days=days)).isoformat()
    return tables.drop_partitions(spark, path, date, lambda value: value[:10] < oldest)


def retain_outputs(spark: SparkSession, root: str, as_of: str, archives: tuple[str, ...] = ("hourly", "daily"), live: tuple[str, ...] = fixed.LIVE_OUTPUTS,
                   archive_days: int = fixed.ARCHIVE_DAYS, output_days: int = fixed.OUTPUT_DAYS) -> dict[str, list[str]]:
    """Retention over all outputs under ``root``: archives keep a month, other dated outputs a year, live ones everything."""
    return {name: apply_retention(spark, f"{root}/{name}", as_of, archive_days if name in archives else output_days)
            for name in tables.children(spark, root) if name not in live}
