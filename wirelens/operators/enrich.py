"""Risk catalogs onto items, and the views that read the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wirelens.functions import bands, text as tx, times
from wirelens.operators import tagging
from wirelens.operators.corpus import top_n


def _item_cves(df: DataFrame, key: str) -> DataFrame:
    """Distinct (key, cve_id) of the items that name any CVE."""
    # the outer form keeps the optimizer from evaluating the id search twice for a filter
    named = tagging.extract_all_cves(df).select(key, F.explode_outer("all_cves").alias("cve_id"))
    return named.filter(F.col("cve_id").isNotNull()).distinct()


def join_epss(df: DataFrame, epss: DataFrame, key: str = "hash") -> DataFrame:
    """Scores of the named CVEs re-nested per item, with the highest score and its label.

    Only (key, cve) pairs travel through the join; the wide rows are joined once
    at the end. The planner broadcasts the catalog when its size allows.
    """
    scored = _item_cves(df, key).join(epss, "cve_id")
    entry = F.struct("cve_id", "epss_score", "epss_percentile", bands.epss_risk(F.col("epss_score")).alias("risk_label"))
    nested = scored.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("epss_scores"), F.max("epss_score").alias("epss_max_score"))
    return df.join(nested, key, "left").withColumn(
        "epss_risk", F.when(F.col("epss_max_score").isNotNull(), bands.epss_risk(F.col("epss_max_score"))))


def join_kev(df: DataFrame, kev: DataFrame, key: str = "hash") -> DataFrame:
    """Known-exploited entries of the named CVEs, earliest date and ransomware use."""
    listed = _item_cves(df, key).join(kev, "cve_id")
    entry = F.struct(*[c for c in kev.columns if c == "cve_id"], *[c for c in kev.columns if c != "cve_id"])
    nested = listed.groupBy(key).agg(
        F.array_sort(F.collect_list(entry)).alias("kev_entries"),
        F.min(F.when(F.col("date_added") != "", F.col("date_added"))).alias("kev_min_date_added"),
        F.bool_or(F.col("ransomware_use") == "Known").alias("_known"))
    joined = df.join(nested, key, "left").withColumn("kev_listed", F.col("kev_entries").isNotNull())
    return joined.withColumn("kev_ransomware_use", F.when(F.col("kev_listed"), F.when(F.col("_known"), "Known").otherwise("Unknown"))).drop("_known")


def max_risk(scores: Column) -> Column:
    """Entry with the highest score; the lowest CVE id among equals."""
    return F.reduce(scores, F.get(scores, F.lit(0)), lambda best, s: F.when(s["epss_score"] > best["epss_score"], s).otherwise(best))


def cve_view(df: DataFrame, cve: str, ts: str = "event_ts") -> DataFrame:
    """Items that name the CVE, earliest first, with count, first reporter and score.

    The score is the one given for this CVE by the first scored item, else that
    item's first score.
    """
    wanted = cve.upper()
    found = df.filter(F.array_contains("cve_ids", wanted))
    own = F.get(F.filter("epss_scores", lambda s: s["cve_id"] == wanted), F.lit(0))["epss_score"]
    picked = F.coalesce(own, F.get(F.col("epss_scores"), F.lit(0))["epss_score"])
    facts = found.agg(F.struct(
        F.count("*").alias("n"), F.min_by("source", F.struct(F.coalesce(ts, F.lit("9999-12-31").cast("timestamp")), "hash")).alias("first"),
        F.min(F.when(picked.isNotNull(), F.struct("pos", picked.alias("score")))).alias("risk")).alias("facts")).scalar()
    # one subquery over the few items of the CVE, read by three columns
    return (found.withColumn("_facts", facts).withColumn("article_count", F.col("_facts.n")).withColumn("first_source", F.col("_facts.first"))
            .withColumn("epss_score", F.col("_facts.risk.score")).drop("_facts").orderBy(F.col(ts).asc_nulls_last(), "hash"))


def first_reporter(df: DataFrame, key: str, ts: str = "event_ts", source: str = "source", tie: str = "hash") -> DataFrame:
    """Source and time of the earliest dated row per key."""
    dated = df.filter(F.col(ts).isNotNull())
    return dated.groupBy(key).agg(F.min(F.struct(ts, tie, source)).alias("first")).select(
        key, F.col(f"first.{source}").alias("first_source"), F.col(f"first.{ts}").alias("first_ts"))


def rank_vulns(df: DataFrame, n: int = 8) -> DataFrame:
    """Items with a CVE, known-exploited first, then likelihood, then severity."""
    return df.filter(~tx.blank(F.col("cve_id"))).orderBy(
        F.coalesce("kev_listed", F.lit(False)).desc(), F.coalesce("epss_max_score", F.lit(0.0)).desc(),
        F.coalesce("cvss_score", F.lit(0.0)).desc(), F.asc("pos")).limit(n)


def kev_facts(df: DataFrame, as_of: str, max_age_days: int = 14, titles: int = 2) -> DataFrame:
    """Per known-exploited CVE of the items: stale, date_added, articles, and the first titles with their positions.

    Stale: an entry older than the age limit; a bad date does not make one stale.
    """
    pairs = df.filter("kev_listed").select("pos", "title", F.inline("kev_entries"))
    fresh = pairs.withColumn("cve_id", F.upper("cve_id")).filter(F.col("cve_id").rlike(r"^CVE-\d{4}-\d{4,7}$"))
    added = F.try_to_timestamp(F.when(F.col("date_added").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("date_added"))).cast("date")
    stale = F.coalesce(added < F.date_sub(F.to_date(times.as_timestamp(as_of)), max_age_days), F.lit(False))
    per_cve = fresh.groupBy("cve_id").agg(
        F.bool_or(stale).alias("stale"), F.min(F.when(F.col("date_added") != "", F.col("date_added"))).alias("date_added"),
        F.count("*").alias("articles"))
    first = top_n(fresh.select("cve_id", "pos", "title"), ["cve_id"], [F.col("pos")], titles)
    return per_cve.join(first.groupBy("cve_id").agg(F.array_sort(F.collect_list(F.struct("pos", "title"))).alias("shown")), "cve_id")


def kev_alerts(df: DataFrame, alerted: DataFrame, as_of: str, max_age_days: int = 14, cap: int = 5, titles: int = 2) -> tuple[DataFrame, DataFrame]:
    """(alerts to send, CVEs to mark): one alert per CVE that was never alerted.

    Entries older than the age limit are marked without an alert. Alerts beyond
    the cap are not marked and fire on the next run over the same items.
    """
    per_cve = kev_facts(df, as_of, max_age_days, titles).join(alerted.select("cve_id"), "cve_id", "left_anti")
    quiet = per_cve.filter("stale").select("cve_id")
    alerts = per_cve.filter("not stale").orderBy("cve_id").limit(cap).select(
        "cve_id", "date_added", "articles", F.transform("shown", lambda s: s["title"]).alias("titles"))
    return alerts, quiet.unionByName(alerts.select("cve_id"))


def upsert_epss(old: DataFrame, new: DataFrame, key: str = "cve_id") -> DataFrame:
    """Whole fresh rows over cached ones; cached rows stay when the source did not send them."""
    values = [c for c in old.columns if c != key]
    joined = old.select(key, F.struct(*values).alias("o")).join(new.select(key, F.struct(*values).alias("n")), key, "full_outer")
    return joined.select(key, F.coalesce("n", "o").alias("row")).select(key, *[F.col(f"row.{c}") for c in values])
