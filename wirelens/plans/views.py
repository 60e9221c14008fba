"""Query views: the read API as compositions of operators over the corpus and state tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wirelens.operators import audits, clusters as cl, corpus, digest, enrich, feeds, filters, trends, usage
from wirelens.sinks import writers


def articles(items: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """One page of the corpus, newest first, without bodies."""
    return corpus.page(items.drop("full_content"), offset, limit)


def since(items: DataFrame, cursor_ts: str | None, cursor_hash: str = "", limit: int = 200) -> DataFrame:
    """New items after a cursor, oldest first; ties on the cursor instant are not lost."""
    return corpus.since_page(items.drop("full_content"), cursor_ts, cursor_hash, limit, ts="event_ts")


def campaigns(table: DataFrame, status: str | None = None) -> DataFrame:
    """Campaigns, last updated first."""
    return filters.with_status(table, status).orderBy(F.desc("updated_at"), "campaign_id")


def campaign(table: DataFrame, items: DataFrame, campaign_id: str) -> DataFrame:
    """Items of one campaign in time order."""
    return cl.campaign_view(table.filter(F.col("campaign_id") == campaign_id), items).orderBy("seq")


def cve(items: DataFrame, cve_id: str) -> DataFrame:
    """Timeline of one CVE."""
    return enrich.cve_view(items, cve_id)


def trend(counts: DataFrame, day: str) -> dict[str, DataFrame]:
    """Trend report with the spikes of the day."""
    return {**trends.trend_report(counts, day), "spikes": trends.spikes(counts, day)}


def quality(items: DataFrame, health: DataFrame, feedback: DataFrame) -> dict[str, DataFrame]:
    """Corpus quality, category distribution, feed scores and classifier feedback."""
    return {"corpus": audits.quality(items), "categories": corpus.top_k(items, "category", 15), "feeds": feeds.health_report(health),
            "feed_scores": feeds.signal_scores(health), "feedback": usage.feedback_summary(feedback)}


def health(state: DataFrame, feed_table: DataFrame, items: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """Status ladder, feed report and freshness."""
    return {"status": audits.health_status(state), "feeds": feeds.health_report(feed_table), "failing": feeds.failing_feeds(feed_table),
            "freshness": audits.freshness(items, as_of, 3.0, "event_ts")}


def stix(items: DataFrame, iocs: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """Exchange objects and the id of their bundle."""
    objects = writers.stix_objects(items, iocs, as_of)
    return {"objects": objects, "bundle": writers.stix_bundle_id(objects)}


def digest_candidates(items: DataFrame, as_of: str, region: str | None = None) -> DataFrame:
    """Candidates of the global digest, or of one macro region with its smaller limits."""
    pool = filters.digest_filter(filters.by_macro_region(items, region) if region else items)
    bucketed = pool.withColumn("bucket", digest.age_bucket(F.col("event_ts"), as_of))
    if region:
        from wirelens import fixed

        return digest.digest_candidates(bucketed, fixed.REGIONAL_CAP, fixed.REGIONAL_TRIGGER, fixed.REGIONAL_FILL)
    return digest.digest_candidates(digest.hoist_kev(bucketed, as_of))


def dashboard(items: DataFrame, clusters: DataFrame, members: DataFrame) -> DataFrame:
    """Items without bodies, each with its oldest cluster, newest first."""
    return corpus.newest_first(cl.annotate_clusters(items.drop("full_content"), clusters, members))


def watchlist(keywords: DataFrame, vendors: list[dict], spark) -> DataFrame:
    """Watched keywords together with the suggested vendor names."""
    suggested = spark.createDataFrame([(v["group"], v["label"]) for v in vendors], "kind string, keyword string")
    return keywords.select("kind", "keyword").unionByName(suggested)
