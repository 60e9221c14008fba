"""The rolling corpus: merging, keep-first, paging, ordering, caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from wirelens import fixed
from wirelens.functions import regions
from wirelens.operators import filters


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key.

    A filter on the row number lets Spark cut each task to one row per key
    before the shuffle, so a key that holds a third of all rows is no hot spot.
    """
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_rn = 1").drop("_rn")


def top_n(df: DataFrame, part: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """First ``n`` rows per group, pre-cut per task as in :func:`keep_first`."""
    name = rank or "_rn"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*part).orderBy(*order))).filter(F.col(name) <= n)
    return ranked if rank else ranked.drop(name)


def merge_corpus(new: DataFrame, old: DataFrame, pos: str = "pos") -> DataFrame:
    """New batch before old corpus, first per hash, then first per title.

    Rows without a hash or title are kept. The hash decides the title, so two
    passes give what one pass over the ordered rows would.
    """
    both = new.withColumn("_batch", F.lit(0)).unionByName(old.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    order = [F.col("_batch"), F.col(pos)]
    for key in ("hash", "title"):
        named = F.coalesce(F.col(key), F.lit("")) != ""
        # a row without the key is its own group
        own = F.when(named, F.col(key)).otherwise(F.concat_ws(":", F.lit("\u0000"), F.col("_batch"), F.col(pos)))
        both = keep_first(both.withColumn("_key", own), ["_key"], order).drop("_key")
    return both.drop("_batch")


def rolling_corpus(new: DataFrame, old: DataFrame, as_of: str, days: int = fixed.CUTOFF_DAYS, pos: str = "pos") -> DataFrame:
    """Merged, retained corpus with re-collapsed region labels."""
    kept = filters.retained(merge_corpus(new, old, pos), as_of, days)
    label = F.col("feed_region")
    return kept.withColumn("feed_region", F.when(label.contains(","), regions.collapse_regions(F.split(label, ","))).otherwise(label))


def newest_first(df: DataFrame, ts: str = "event_ts", key: str = "hash") -> DataFrame:
    """Newest event first, undated last, ties by key."""
    return df.orderBy(F.col(ts).desc_nulls_last(), F.col(key))


def page(df: DataFrame, offset: int, limit: int, ts: str = "event_ts", key: str = "hash") -> DataFrame:
    """One page with ``total`` and ``has_more`` on every row; limit 0 means all rows."""
    size = max(0, min(limit, 100))
    total = df.agg(F.count("*")).scalar()
    rows = newest_first(df, ts, key).offset(offset)
    shown = rows.limit(size) if size else rows
    more = F.lit(False) if size == 0 else F.col("total") > offset + size
    return shown.withColumn("total", total).withColumn("has_more", more)


def since_page(df: DataFrame, cursor_ts: str | None, cursor_hash: str = "", limit: int = 200, ts: str = "ts", key: str = "hash") -> DataFrame:
    """Oldest rows after the cursor with ``total_new`` and ``truncated``; page on with the last row."""
    size = max(1, min(limit, 1000))
    fresh = filters.since(df, cursor_ts, cursor_hash, ts, key)
    total = fresh.agg(F.count("*")).scalar()
    return fresh.orderBy(ts, key).limit(size).withColumn("total_new", total).withColumn("truncated", F.col("total_new") > size)


def top_k(df: DataFrame, key: str, k: int) -> DataFrame:
    """Most frequent values, ties by value."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(key)).limit(k)


def keep_last(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The last ``n`` rows of a state table; ``order`` is newest first."""
    return df.orderBy(*order).limit(n)


def priority_union(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the new table, then the old rows whose key it lacks."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def union_tail(old: Column, new: Column, cap: int) -> Column:
    """Ordered union of two hash lists, cut to the last ``cap`` entries."""
    merged = F.array_union(F.coalesce(old, F.array().cast("array<string>")), F.coalesce(new, F.array().cast("array<string>")))
    return F.slice(merged, F.greatest(F.size(merged) - cap, F.lit(0)) + 1, F.lit(cap))


def cited_minus_allowed(cited: Column, allowed: Column) -> Column:
    """Cited ids that are not allowed."""
    return F.array_except(cited, allowed)


def memo_misses(df: DataFrame, memo: DataFrame, as_of: str, version: str, max_age_days: int = 30, text: str = "text") -> DataFrame:
    """Rows whose versioned text hash has no live memo entry; adds the memo key."""
    from wirelens.functions import times

    cutoff = times.as_timestamp(as_of) - F.expr(f"INTERVAL {max_age_days} DAYS")
    live = memo.filter(F.col("cached_at") >= cutoff).select("memo_key")
    return df.withColumn("memo_key", F.sha2(F.concat(F.lit(version), F.col(text)), 256)).join(live, "memo_key", "left_anti")


def union_sources(*sources: DataFrame) -> DataFrame:
    """All landed sources as one raw table; absent columns become null."""
    merged = sources[0]
    for other in sources[1:]:
        merged = merged.unionByName(other, allowMissingColumns=True)
    return merged
