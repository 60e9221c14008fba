"""One alert per known-exploited CVE ever, with a cap per round and a queue of what is over it.

A keyed table holds every CVE that items named: what is known of it while it waits, whether it is to stay silent, and
the round that fired it. A round folds the new items in, then fires the first waiting CVEs up to the cap. Nothing over
the cap is lost: it waits in the table and fires in a later round, with or without new items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wirelens import fixed
from wirelens.operators import enrich
from wirelens.session import cut
from wirelens.sinks.tables import BucketTable

WAITING = "fired is null and not stale"
TITLES = 2


class OnceAlerts:
    """The table under ``state_path`` and the alert rows under ``path``, one folder per round."""

    def __init__(self, spark: SparkSession, path: str, state_path: str, as_of: str, cap: int = fixed.KEV_ALERTS_PER_BATCH,
                 max_age_days: int = fixed.KEV_ALERT_MAX_AGE_DAYS):
        self.spark, self.path, self.as_of, self.cap, self.max_age_days = spark, path, as_of, cap, max_age_days
        self.cves = BucketTable(spark, state_path, (
            "cve_id string, stale boolean, date_added string, articles long, shown array<struct<pos: long, title: string>>, fired long"), ["cve_id"], buckets=4)

    def round(self, items: DataFrame | None, number: int) -> None:
        """Fold items (pos, title, kev_listed, kev_entries) in, if any, and fire up to the cap; may be repeated."""
        if items is not None:
            self.cves.merge(cut(enrich.kev_facts(items, self.as_of, self.max_age_days, TITLES)), _folded, 2 * number)
        # those that this round fired before it broke off are chosen again
        due = cut(self.cves.read().filter(f"({WAITING}) or fired = {number}").orderBy("cve_id").limit(self.cap).withColumn("fired", F.lit(number).cast("long")))
        self.cves.upsert(due, 2 * number + 1)
        due.select("cve_id", "date_added", "articles", F.transform("shown", lambda s: s["title"]).alias("titles")).write.mode("overwrite").parquet(f"{self.path}/round={number}")

    def waiting(self) -> DataFrame:
        """CVEs over the cap of all rounds so far, in the order in which they will fire."""
        return self.cves.read().filter(WAITING).orderBy("cve_id")

    def drain(self) -> None:
        """Rounds without new items until nothing waits."""
        while not self.waiting().isEmpty():
            self.round(None, self.sent().agg(F.max("round")).first()[0] + 1)

    def sent(self) -> DataFrame:
        """All alerts with the round that fired them."""
        return self.spark.read.schema("cve_id string, date_added string, articles long, titles array<string>, round long").parquet(self.path)


def _folded(old: DataFrame, new: DataFrame) -> DataFrame:
    """What is known of each CVE after more items; one that fired or is silent stays as it is."""
    given = new.select("cve_id", *[F.col(c).alias(f"n_{c}") for c in ("stale", "date_added", "articles", "shown")])
    settled = F.col("fired").isNotNull() | F.coalesce("stale", F.lit(False))
    empty = F.array().cast("array<struct<pos:bigint,title:string>>")

    def kept(name: str, merged):
        return F.when(settled, F.col(name)).otherwise(merged).alias(name)

    return old.join(given, "cve_id", "full_outer").select(
        "cve_id", kept("stale", F.coalesce("stale", F.lit(False)) | F.coalesce("n_stale", F.lit(False))),
        kept("date_added", F.least("date_added", "n_date_added")), kept("articles", F.coalesce("articles", F.lit(0)) + F.coalesce("n_articles", F.lit(0))),
        kept("shown", F.slice(F.array_sort(F.concat(F.coalesce("shown", empty), F.coalesce("n_shown", empty))), 1, TITLES)), "fired")
