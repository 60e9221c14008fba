"""Row filters and bounded work queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from wirelens import fixed, rules
from wirelens.functions import regions, text as tx, times
from wirelens.operators import tagging


def best_time(df: DataFrame) -> Column:
    """First parseable of published, ingested_at and timestamp, as far as the table has them."""
    return times.event_time(*[F.col(c) for c in ("published", "ingested_at", "timestamp") if c in df.columns])


def ingest_window(df: DataFrame, as_of: str, days: int = fixed.CUTOFF_DAYS, published: str = "published") -> DataFrame:
    """Fresh items only: older ones and undated ones are dropped."""
    cutoff = times.as_timestamp(as_of) - F.expr(f"INTERVAL {days} DAYS")
    return df.filter(times.parse_event_time(F.col(published)) >= cutoff)


def retained(df: DataFrame, as_of: str, days: int = fixed.CUTOFF_DAYS) -> DataFrame:
    """Corpus retention: drop only what is provably older than the cutoff."""
    cutoff = times.as_timestamp(as_of) - F.expr(f"INTERVAL {days} DAYS")
    ts = best_time(df)
    return df.filter(ts.isNull() | (ts >= cutoff))


def is_relevant(text: Column, categories=None, relevance=None) -> Column:
    """True when a category rule or the broad relevance pattern matches."""
    return rules.any_matches(text, [*(relevance or rules.load("relevance")), *(categories or rules.load("categories"))])


def is_noise(text: Column, noise=None) -> Column:
    """True when any noise pattern matches."""
    return rules.any_matches(text, noise or rules.load("noise"))


def drop_benign_domains(df: DataFrame, domain: str, benign: DataFrame, tlds: tuple[str, ...] = fixed.DOMAIN_TLDS) -> DataFrame:
    """Domains with a known top level that are not benign, nor under a benign parent.

    The benign table may be large, so it is joined, not inlined.
    """
    named = df.withColumn("_domain", F.lower(F.col(domain))).filter(F.substring_index("_domain", ".", -1).isin(*tlds))
    listed = benign.select(F.lower(F.col("domain")).alias("_domain")).distinct()
    parent = named.join(listed, "_domain", "left_anti").withColumn("_own", F.col("_domain")).withColumn(
        "_domain", F.substring_index("_own", ".", -2))
    return parent.join(listed, "_domain", "left_anti").drop("_domain", "_own")


def alertable(df: DataFrame, min_confidence: int = fixed.ALERT_MIN_CONFIDENCE) -> DataFrame:
    """Cyber items of high confidence."""
    return df.filter(F.col("is_cyber_attack") & (F.col("confidence") >= min_confidence))


WORK_QUEUES = {
    # kind: (predicate, default size of the queue)
    "escalation": (
        "is_cyber_attack AND ((category = 'General Cyber Threat' AND confidence <= 60) OR confidence < 70)", 20),
    "narrative": ("size(cve_ids) > 0 AND (cvss_score >= 8 OR epss_percentile >= 0.8)", 30),
    "deep_extract": ("is_cyber_attack AND length(full_content) >= 500", 40),
    "missing_summary": ("summary IS NULL OR trim(summary) = ''", 150),
}


def work_queue(df: DataFrame, kind: str, order: list[Column], size: int | None = None, batch: int | None = None) -> DataFrame:
    """The next ``size`` candidates of a kind; with ``batch`` also their batch number.

    The cap is the feature: what is not taken now waits for the next run.
    """
    predicate, default = WORK_QUEUES[kind]
    queue = df.filter(predicate).orderBy(*order).limit(size or default)
    if batch is None:
        return queue
    numbered = queue.withColumn("_rn", F.row_number().over(Window.orderBy(*order)))  # at most ``size`` rows
    return numbered.withColumn("batch_id", F.floor((F.col("_rn") - 1) / batch)).drop("_rn")


def by_macro_region(df: DataFrame, key: str) -> DataFrame:
    """Items of one macro region."""
    return df.filter(regions.in_macro_region(F.col("feed_region"), key))


def since(df: DataFrame, cursor_ts: str | None, cursor_hash: str = "", ts: str = "ts", key: str = "hash") -> DataFrame:
    """Rows after the composite cursor; rows that share its instant are not lost."""
    if cursor_ts is None:
        return df.filter(F.col(ts).isNotNull())
    at = times.as_timestamp(cursor_ts)
    return df.filter(F.struct(ts, key) > F.struct(at, F.lit(cursor_hash)))


def with_status(df: DataFrame, status: str | None = None) -> DataFrame:
    """Campaigns of one status, or all."""
    return df if status is None else df.filter(F.col("status") == status)


def mentions_cve(df: DataFrame, cve: str, ids: str = "cve_ids") -> DataFrame:
    """Items whose id list contains the CVE."""
    return df.filter(F.array_contains(ids, cve.upper()))


def keep_given_label(df: DataFrame) -> DataFrame:
    """Rule labels, but a supplied cyber label with confidence wins (columns given_*)."""
    given = F.coalesce(F.col("given_is_cyber") & (F.col("given_confidence") > 0), F.lit(False))
    return df.withColumns({
        "category": F.when(given, F.col("given_category")).otherwise(F.col("category")),
        "confidence": F.when(given, F.col("given_confidence")).otherwise(F.col("confidence")),
        "is_cyber_attack": F.when(given, F.lit(True)).otherwise(F.col("is_cyber_attack")),
    }).drop("given_is_cyber", "given_confidence", "given_category")


def drop_irrelevant(df: DataFrame, observation=None) -> DataFrame:
    """Cyber items only; with an Observation also the counts before and after."""
    flag = F.coalesce("is_cyber_attack", F.lit(False))
    if observation is not None:
        df = df.observe(observation, F.count(F.lit(1)).alias("seen"), F.count_if(flag).alias("kept"))
    return df.filter(flag)


def classified(df: DataFrame) -> DataFrame:
    """Items with rule labels; rows that already carry a label keep it."""
    given = df.withColumnsRenamed({"is_cyber_attack": "given_is_cyber", "confidence": "given_confidence", "category": "given_category"})
    return keep_given_label(tagging.classify(given))


def digest_filter(df: DataFrame, key: str = "pos") -> DataFrame:
    """Items fit for a digest: no dark web, no noise, confidence above 0, one per title key."""
    fit = df.filter(~F.coalesce("darkweb", F.lit(False)) & (F.col("category") != "Noise") & (F.col("confidence") != 0))
    first = F.row_number().over(Window.partitionBy("_key").orderBy(key))
    return fit.withColumn("_key", tx.title_key(F.col("title"))).withColumn("_rn", first).filter("_rn = 1").drop("_key", "_rn")
