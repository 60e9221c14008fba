"""Campaigns kept up to date by micro-batches of items.

Two tables: every (entity, item) edge, in buckets of the entity and only ever added to, and one row per entity with its
totals and whether the greedy cover keeps it. A batch adds its edges and folds them into the entities it names. Entities
that ever shared an item form a group; the cover of a group depends on nothing outside it, so only groups with a named
entity are covered again. Totals, first and last sighting are counts, minima and maxima of event time: the tables after
the last batch do not depend on how, or in which order, the items were cut into batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, Window

from wirelens import fixed
from wirelens.functions import bands, text as tx, times
from wirelens.operators import clusters as cl
from wirelens.operators.corpus import top_n
from wirelens.session import cut
from wirelens.sinks.tables import BatchTable, BucketTable, exists

ENTITY = cl.ENTITY
EDGES = "entity_type string, entity_name string, ord int, pos long, hash string, ts timestamp, bucket int"
ENTITIES = ("entity_type string, entity_name string, family long, article_count long, first struct<pos: long, ord: int>, first_seen timestamp,"
            " last_seen timestamp, since long, current boolean")


class Campaigns:
    """The two tables under ``path`` and what is read off them."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path = spark, path
        self.edges = BatchTable(spark, f"{path}/edges", EDGES, "bucket")
        self.entities = BucketTable(spark, f"{path}/entities", ENTITIES, ENTITY, buckets)

    def add(self, items: DataFrame, batch_id: int) -> None:
        """Fold one batch of items (pos, hash, event_ts and the text columns) in."""
        named = cl.entity_edges(items).join(items.select("pos", "hash", F.col("event_ts").alias("ts")), "pos")
        new = cut(named.withColumn("bucket", self.entities.bucket()))
        if new.isEmpty():
            return
        self.edges.append(new, batch_id)
        self.entities.merge(self._totals(new), _folded, 2 * batch_id)
        self._cover(self._joined(new, batch_id), batch_id)

    def _totals(self, edges: DataFrame) -> DataFrame:
        return edges.groupBy(*ENTITY).agg(F.count("*").alias("n"), F.min(F.struct("pos", "ord")).alias("at"), F.min("ts").alias("from"), F.max("ts").alias("to"))

    def _joined(self, new: DataFrame, batch_id: int) -> DataFrame:
        """(family, to) of the groups that the batch's items touch and link; stored, so that a repeated batch has the same."""
        at = f"{self.path}/joined/batch={batch_id}"
        if not exists(self.spark, f"{at}/_SUCCESS"):
            buckets = [r.bucket for r in new.select("bucket").distinct().collect()]
            linked = new.select(*ENTITY, "pos").join(self.entities.read(buckets).select(*ENTITY, "family"), ENTITY)
            links = linked.select(F.col("family").alias("a"), F.min("family").over(Window.partitionBy("pos")).alias("b")).distinct()
            cl.connected(links).select(F.col("node").alias("family"), F.col("family").alias("to")).write.mode("overwrite").parquet(at)
        return self.spark.read.schema("family long, to long").parquet(at)

    def _cover(self, joined: DataFrame, batch_id: int) -> None:
        """Cover the joined groups again; all others keep what they have."""
        members = cut(self.entities.read().join(joined, "family"))
        at = [r.bucket for r in members.select(self.entities.bucket().alias("bucket")).distinct().collect()]
        # entities with too few items take no part in the cover
        big = members.filter(F.col("article_count") >= fixed.CLUSTER_MIN_MEMBERS)
        edges = self.edges.read().filter(F.col("bucket").isin(at)).join(big.select(*ENTITY), ENTITY, "left_semi")
        chosen = cl.greedy_cover(edges.select(*ENTITY, "pos", "ord")).select(*ENTITY, F.lit(True).alias("kept"))
        state = members.join(chosen, ENTITY, "left").select(
            *ENTITY, F.col("to").alias("family"), "article_count", "first", "first_seen", "last_seen",
            F.coalesce("since", F.when(F.col("kept"), F.lit(batch_id))).alias("since"), F.coalesce("kept", F.lit(False)).alias("current"))
        self.entities.upsert(cut(state), 2 * batch_id + 1)

    def table(self, as_of: str) -> DataFrame:
        """One row per campaign: every entity that the cover ever kept; ``current`` marks those it keeps now."""
        return campaign_rows(self.entities.read().filter("since is not null"), as_of)

    def members(self) -> DataFrame:
        """All (entity, item) edges of the current campaigns; none is left out."""
        return self.edges.read().join(self.entities.read().filter("current").select(*ENTITY), ENTITY, "left_semi").select(*ENTITY, "pos", "hash", "ts")


def _folded(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entities after a batch: counts add up, sightings widen; a new entity is a group of its own."""
    both = old.join(new, ENTITY, "full_outer")
    return both.select(
        *ENTITY, F.coalesce("family", F.xxhash64(*ENTITY)).alias("family"),
        (F.coalesce("article_count", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("article_count"), F.least("first", "at").alias("first"),
        F.least("first_seen", "from").alias("first_seen"), F.greatest("last_seen", "to").alias("last_seen"), "since", F.coalesce("current", F.lit(False)).alias("current"))


def campaign_rows(entities: DataFrame, as_of: str) -> DataFrame:
    """Campaign facts of covered entities: id, sightings by event time, total and age band at ``as_of``."""
    now = times.as_timestamp(as_of)
    return entities.select(
        tx.campaign_id(*[F.col(c) for c in ENTITY]).alias("campaign_id"), *ENTITY, F.coalesce("first_seen", now).alias("first_observed"),
        F.coalesce("last_seen", now).alias("last_observed"), F.col("article_count").alias("total_observed_articles"),
        bands.campaign_status(F.coalesce("last_seen", now), now).alias("status"), "current")


def campaigns_of(items: DataFrame, as_of: str) -> DataFrame:
    """Batch twin: the current campaigns of all items at once."""
    edges = cut(cl.entity_edges(items).join(items.select("pos", F.col("event_ts").alias("ts")), "pos"))
    kept = cl.greedy_cover(edges.select(*ENTITY, "pos", "ord")).select(*ENTITY)
    facts = edges.join(kept, ENTITY, "left_semi").groupBy(*ENTITY).agg(
        F.count("*").alias("article_count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return campaign_rows(facts.withColumn("current", F.lit(True)), as_of)


def recent_hashes(members: DataFrame, cap: int = fixed.MAX_HASHES_PER_CAMPAIGN) -> DataFrame:
    """Per campaign the newest ``cap`` hashes in item order, a preview of ``members``."""
    last = top_n(members.filter(F.col("hash").isNotNull()), ENTITY, [F.desc("pos")], cap)
    return last.groupBy(*ENTITY).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "hash"))), lambda s: s["hash"]).alias("article_hashes"))
