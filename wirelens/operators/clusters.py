"""Entity edges, greedy cluster cover, campaigns and actor profiles.

Members of a cluster stay rows of an edge table: a cluster that holds a third
of the corpus is a join, never one huge array.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, functions as F, Window

from wirelens import fixed
from wirelens.functions import bands, text as tx, times
from wirelens.operators import tagging
from wirelens.operators.corpus import top_n, union_tail
from wirelens.session import cut, stored

ENTITY = ["entity_type", "entity_name"]


def entity_edges(df: DataFrame, pos: str = "pos") -> DataFrame:
    """Distinct (entity_type, entity_name, ord, pos): CVEs, actors and title organisations per item."""
    tagged = tagging.match_orgs(tagging.match_actors(tagging.extract_cves(df)))
    typed = F.concat(_typed("cve", F.col("cve_ids")), _typed("actor", F.col("actors.name")), _typed("org", F.col("orgs")))
    rows = tagged.select(F.col(pos).alias("pos"), F.posexplode_outer(typed).alias("ord", "e")).filter(F.col("ord").isNotNull())
    return rows.groupBy(F.col("e.entity_type").alias("entity_type"), F.col("e.entity_name").alias("entity_name"), "pos").agg(F.min("ord").alias("ord"))


def _typed(kind: str, names):
    empty = F.array().cast("array<struct<entity_type:string,entity_name:string>>")
    return F.coalesce(F.transform(names, lambda n: F.struct(F.lit(kind).alias("entity_type"), n.alias("entity_name"))), empty)


def entity_sizes(edges: DataFrame) -> DataFrame:
    """Members and first position of every entity."""
    return edges.groupBy(*ENTITY).agg(F.count("*").alias("article_count"), F.min(F.struct("pos", "ord")).alias("first"))


def connected(links: DataFrame) -> DataFrame:
    """(node, family) of the graph with number edges (a, b): the smallest number of each connected part."""
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("family")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("family").alias("near"))
        nearer = labels.join(near, "node").select("node", F.col("family").alias("old"), F.least("family", "near").alias("family"))
        tops = labels.select(F.col("node").alias("family"), F.col("family").alias("top"))  # pointer jumping: chains halve
        now = cut(nearer.join(tops, "family", "left").select("node", "old", F.least("family", F.coalesce("top", "family")).alias("family")))
        if now.filter("family <> old").isEmpty():
            return now.drop("old")
        labels = now.drop("old")


#: Rounds after which a cover whose open edges are few enough is finished by scans, and how many edges are few.
ROUNDS, SCAN_EDGES = 12, 1_000_000


def greedy_cover(edges: DataFrame, min_members: int = fixed.CLUSTER_MIN_MEMBERS, min_new: int = fixed.CLUSTER_MIN_NEW) -> DataFrame:
    """Entities that become clusters, largest first, with enough uncovered members.

    The sequential rule is decided in parallel rounds over the edges between
    undecided entities and items not covered by a better kept one: an entity with
    ``min_new`` items on which it is the best undecided one is kept, one with
    fewer edges left is dropped. The best undecided entity is always decided, so the rounds end.
    A long chain of ranks decides few entities a round; once few edges are left, each connected part of them is
    settled by one scan in rank order instead.
    """
    sizes = entity_sizes(edges).filter(F.col("article_count") >= min_members)
    rank = F.struct((-F.col("article_count")).alias("size"), F.col("first"), *ENTITY)
    state = cut(edges.select(*ENTITY, "pos").join(sizes, ENTITY).select(rank.alias("rank"), "pos", F.lit(False).alias("kept")))
    kept, rounds = [], 0
    while True:
        open_edges = state.filter(~F.col("kept"))
        left = open_edges.count()
        if not left:
            break
        if rounds >= ROUNDS and left <= SCAN_EDGES:
            kept.append(_scanned(open_edges.select("rank", "pos"), min_new))
            break
        state, rounds = cut(_cover_round(open_edges.select("rank", "pos"), min_new)), rounds + 1
        kept.append(state.filter("kept").select("rank").distinct())
    if not kept:
        return sizes.limit(0).select(*ENTITY, "article_count")
    return reduce(DataFrame.unionByName, kept).select(*[F.col(f"rank.{c}").alias(c) for c in ENTITY], (-F.col("rank.size")).alias("article_count"))


def _cover_round(edges: DataFrame, min_new: int) -> DataFrame:
    """(rank, pos, kept): edges of the entities kept in this round, and those still open after it; one job."""
    item = Window.partitionBy("pos")
    marked = edges.withColumn("own", F.col("rank") == F.min("rank").over(item))
    totals = marked.groupBy("rank").agg(F.count("*").alias("left"), F.count_if("own").alias("own"))
    judged = edges.join(totals, "rank").withColumn("kept", F.col("own") >= min_new)
    # an item covered by a kept entity is lost only to the entities that rank behind it
    by = F.min(F.when(F.col("kept"), F.col("rank"))).over(item)
    still = (F.col("left") >= min_new) & (F.col("by").isNull() | (F.col("rank") < F.col("by")))
    return judged.withColumn("by", by).filter(F.col("kept") | still).select("rank", "pos", "kept")


def _scanned(edges: DataFrame, min_new: int) -> DataFrame:
    """Kept ranks of the open edges: every connected part in rank order, each entity against the items covered before it."""
    numbered = edges.withColumn("a", F.xxhash64("rank"))
    links = numbered.withColumn("b", F.min("a").over(Window.partitionBy("pos"))).select("a", "b").distinct()
    families = connected(links).select(F.col("node").alias("a"), "family")
    # the place of an entity among all that are left stands for its rank
    ranks = cut(edges.select("rank").distinct().withColumn("a", F.xxhash64("rank")))
    places = ranks.withColumn("place", F.row_number().over(Window.orderBy("rank"))).select("a", "place")
    rows = numbered.select("a", "pos").join(families, "a").join(places, "a")

    def scan(part: pd.DataFrame) -> pd.DataFrame:
        covered, kept = set(), []
        for (_, a), items in part.sort_values("place").groupby(["place", "a"])["pos"]:
            fresh = set(items) - covered
            if len(fresh) >= min_new:
                covered |= fresh
                kept.append(a)
        return pd.DataFrame({"a": pd.Series(kept, dtype="int64")})

    return rows.groupBy("family").applyInPandas(scan, "a long").join(ranks, "a").select("rank")


def build_clusters(df: DataFrame, edges: DataFrame, pos: str = "pos", ts: str = "event_ts", preview: int = fixed.CLUSTER_PREVIEW) -> tuple[DataFrame, DataFrame]:
    """(clusters, members): summaries with an early preview, and the full member edges."""
    edges = stored(edges)  # the texts are tagged once
    chosen = cut(greedy_cover(edges))
    members = edges.select(*ENTITY, "pos").join(chosen.select(*ENTITY), ENTITY, "left_semi")
    facts = df.select(F.col(pos).alias("pos"), "hash", F.col(ts).alias("ts"), "title", "link", "source", "published", "category", F.substring("summary", 1, 200).alias("summary"))
    wide = members.join(facts, "pos")
    dates = wide.groupBy(*ENTITY).agg(F.min("ts").alias("first_seen"))
    early = top_n(wide, ENTITY, [F.col("ts").asc_nulls_last(), F.col("pos")], preview, "rn").groupBy(*ENTITY).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", F.struct("title", "link", "source", "published", "category", "summary").alias("item")))),
                    lambda s: s["item"]).alias("articles"))
    return chosen.join(dates, ENTITY).join(early, ENTITY), wide.select(*ENTITY, "pos", "hash", "ts")


def annotate_clusters(df: DataFrame, clusters: DataFrame, members: DataFrame, key: str = "hash", min_members: int = fixed.CLUSTER_MIN_MEMBERS) -> DataFrame:
    """Items with the oldest cluster they belong to, null outside any cluster."""
    big = clusters.filter(F.col("article_count") >= min_members).select(*ENTITY, "article_count", "first_seen")
    linked = members.select(*ENTITY, key).join(big, ENTITY)
    oldest = linked.groupBy(key).agg(F.min(F.struct(
        F.col("first_seen").isNull().alias("undated"), "first_seen", (-F.col("article_count")).alias("n"), *ENTITY)).alias("c"))
    story = F.struct(*[F.col(f"c.{c}").alias(c) for c in ENTITY], (-F.col("c.n")).alias("article_count"), F.col("c.first_seen").alias("first_seen"))
    return df.join(oldest.select(key, story.alias("cluster")), key, "left")


def upsert_campaigns(prior: DataFrame, clusters: DataFrame, members: DataFrame, as_of: str, cap: int = fixed.MAX_HASHES_PER_CAMPAIGN) -> DataFrame:
    """Campaign table after one batch of clusters, with the last ``cap`` hashes of each.

    Known campaigns move their first date back only, gain the new hashes and
    become active; campaigns outside the batch are re-banded by age. The member
    edges are cut to ``cap`` per entity before they are nested.
    """
    now = times.as_timestamp(as_of)
    recent = top_n(members.filter(F.col("hash").isNotNull()), ENTITY, [F.desc("pos")], cap, "rn")
    tails = recent.groupBy(*ENTITY).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "hash"))), lambda s: s["hash"]).alias("new_hashes"))
    counts = members.groupBy(*ENTITY).agg(F.count("hash").alias("n_hashes"))
    batch = clusters.select(*ENTITY, "article_count", "first_seen").join(tails, ENTITY, "left").join(counts, ENTITY, "left").withColumn("in_batch", F.lit(True))
    both = prior.join(batch, ENTITY, "full_outer")
    known, seen = F.col("campaign_id").isNotNull(), F.col("in_batch").isNotNull()
    merged = F.array_union(F.coalesce("article_hashes", F.array().cast("array<string>")), F.coalesce("new_hashes", F.array().cast("array<string>")))
    started = F.coalesce(F.col("first_seen"), now)
    fresh_total = F.when(F.coalesce("n_hashes", F.lit(0)) > 0, F.col("n_hashes")).otherwise(F.coalesce("article_count", F.lit(0)))
    return both.select(
        F.coalesce("campaign_id", tx.campaign_id(*[F.col(c) for c in ENTITY])).alias("campaign_id"), *ENTITY,
        F.when(~known, started).when(seen, F.least("first_observed", "first_seen")).otherwise(F.col("first_observed")).alias("first_observed"),
        F.when(~known, started).when(seen, now).otherwise(F.col("last_observed")).alias("last_observed"),
        F.when(~known, fresh_total).when(seen, F.greatest("total_observed_articles", F.size(merged).cast("long"), "article_count"))
        .otherwise(F.col("total_observed_articles")).alias("total_observed_articles"),
        union_tail(F.col("article_hashes"), F.col("new_hashes"), cap).alias("article_hashes"),
        F.when(seen, "active").otherwise(bands.campaign_status(F.col("last_observed"), now)).alias("status"),
        F.coalesce("created_at", now).alias("created_at"),
        F.when(seen, now).otherwise(F.col("updated_at")).alias("updated_at"))


def empty_campaigns(spark) -> DataFrame:
    """Campaign table before the first batch."""
    return spark.createDataFrame([], (
        "campaign_id string, entity_type string, entity_name string, first_observed timestamp, last_observed timestamp,"
        " total_observed_articles long, article_hashes array<string>, status string, created_at timestamp, updated_at timestamp"))


def campaign_view(campaigns: DataFrame, df: DataFrame, ts: str = "event_ts", members: DataFrame | None = None) -> DataFrame:
    """Items of each campaign in time order, with window count and first reporter.

    The window of a campaign are its kept hashes, a fixed number at most; with ``members`` (entity and hash rows, as from
    ``build_clusters`` or the stream's edge table) all its items.
    """
    links = campaigns.select("campaign_id", *ENTITY, F.explode("article_hashes").alias("hash")) if members is None else (
        members.join(campaigns.select("campaign_id", *ENTITY), ENTITY).select("campaign_id", *ENTITY, "hash").filter(F.col("hash").isNotNull()).distinct())
    joined = links.join(df.select("hash", "title", "link", "source", "published", "category", "feed_region", F.col(ts).alias("ts")), "hash")
    order = Window.partitionBy("campaign_id").orderBy(F.col("ts").asc_nulls_last(), "hash")
    return joined.withColumn("seq", F.row_number().over(order)).withColumn(
        "first_source", F.first("source").over(order)).withColumn("articles_in_window", F.count("*").over(Window.partitionBy("campaign_id")))


def actor_profiles(df: DataFrame, min_articles: int = 2, techniques: int = 8, tactics: int = 6) -> DataFrame:
    """Mentions per actor with its most frequent techniques and tactics, ties by name."""
    tagged = stored(tagging.match_actors(df).select(F.explode_outer("actors").alias("a"), "attack_techniques", "attack_tactics").filter(F.col("a").isNotNull()))
    mentions = tagged.groupBy("a.name", "a.type", "a.origin").agg(F.count("*").alias("article_count")).filter(F.col("article_count") >= min_articles)

    def top(values, n: int, field: str, out: str) -> DataFrame:
        counted = tagged.select(F.col("a.name").alias("name"), F.explode(values).alias(field)).groupBy("name", field).agg(F.count("*").alias("count"))
        best = top_n(counted, ["name"], [F.desc("count"), F.col(field)], n, "rn")
        return best.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", F.struct(field, "count").alias("item")))), lambda s: s["item"]).alias(out))

    return mentions.join(top(F.col("attack_techniques.technique_id"), techniques, "id", "observed_techniques"), "name", "left").join(
        top(F.col("attack_tactics"), tactics, "tactic", "observed_tactics"), "name", "left")
