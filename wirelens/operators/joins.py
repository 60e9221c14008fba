"""Lookups against history, pages, patches, feeds and catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wirelens.functions import text as tx, urls


def unseen(df: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key was not processed before."""
    return df.join(seen.select(*keys), keys, "left_anti")


def attach_text(df: DataFrame, pages: DataFrame, out: str = "full_content") -> DataFrame:
    """Page text by canonical link; one text per link, the longest wins."""
    texts = pages.groupBy(urls.canonical_url(F.col("url")).alias("_link")).agg(F.max(F.struct(F.length("text"), "text")).alias("_best"))
    joined = df.withColumn("_link", urls.canonical_url(F.col("link"))).join(texts, "_link", "left")
    return joined.withColumn(out, F.col("_best.text")).drop("_link", "_best")


def backfill(df: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Fill blank columns from the patch row of the same key; present values stay."""
    fixes = patch.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = df.join(fixes, key, "left")
    filled = {c: F.when(tx.blank(F.col(c).cast("string")), F.coalesce(f"_new_{c}", c)).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(filled).drop(*[f"_new_{c}" for c in columns])


def silent_feeds(feeds: DataFrame, items: DataFrame, url: str = "url", source: str = "source") -> DataFrame:
    """Configured feeds that no item names as its source."""
    return feeds.join(items.select(F.col(source).alias(url)).distinct(), url, "left_anti")


def prune(health: DataFrame, feeds: DataFrame, url: str = "url") -> DataFrame:
    """Health rows of feeds that are still configured."""
    return health.join(feeds.select(url), url, "left_semi")


def mirror(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """The target after syncing: rows of the source, tagged inserted, updated or same; absent rows go."""
    shared = [c for c in source.columns if c != key]
    old = target.select(key, F.struct(*shared).alias("_old"))
    joined = source.join(old, key, "left")
    equal = F.struct(*shared).eqNullSafe(F.col("_old"))  # a null is a value like any other here
    change = F.when(F.col("_old").isNull(), "inserted").when(~equal, "updated").otherwise("same")
    return joined.withColumn("change", change).drop("_old")


def delete_absent(df: DataFrame, keep: DataFrame, keys: list[str]) -> DataFrame:
    """Only rows whose key still exists."""
    return df.join(keep.select(*keys), keys, "left_semi")


def with_feed_meta(df: DataFrame, feeds: DataFrame, source: str = "source") -> DataFrame:
    """Feed attributes onto items; the feed table has one row per url."""
    meta = feeds.select(F.col("url").alias(source), F.col("category").alias("feed_category"), F.col("kind").alias("feed_kind"))
    return df.join(meta, source, "left")


def watchlist_hits(df: DataFrame, watchlist: DataFrame, columns: tuple[str, ...] = ("title", "summary"), out: str = "brand_tags") -> DataFrame:
    """Watched keywords contained in the text, sorted; null when none.

    The watchlist is capped at load (kind x keywords x length), so it travels
    as one bounded array in a scalar subquery instead of a join over all rows.
    """
    keywords = watchlist.agg(F.array_sort(F.collect_set("keyword")).alias("k")).scalar()
    text = F.lower(F.concat_ws(" ", *columns))
    with_list = df.withColumn("_text", text).withColumn("_words", keywords)
    hits = F.filter(F.col("_words"), lambda w: F.contains(F.col("_text"), F.lower(w)))
    return with_list.withColumn(out, tx.none_if_empty(hits)).drop("_text", "_words")


def ungrounded_ids(claims: DataFrame, sources: DataFrame, key: str, pattern: str, text: str = "text") -> DataFrame:
    """(key, id) pairs that a claim cites and no source text of the same key contains."""
    def cited(df: DataFrame) -> DataFrame:
        found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 0)
        return df.select(key, F.explode(F.array_distinct(F.transform(found, F.upper))).alias("id")).distinct()

    return cited(claims).join(cited(sources), [key, "id"], "left_anti")
