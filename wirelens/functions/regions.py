"""Region labels: collapsing, set algebra, country lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wirelens import fixed, rules
from wirelens.functions.text import strings


def collapse_regions(labels: Column, limit: int = fixed.MAX_MERGED_REGIONS) -> Column:
    """Sorted labels joined by commas; Global when none is specific or too many are."""
    specific = F.array_remove(F.array_remove(F.array_distinct(F.array_compact(labels)), "Global"), "")
    return F.when(F.size(specific).between(1, limit), F.array_join(F.array_sort(specific), ",")).otherwise("Global")


def split_regions(label: Column) -> Column:
    """Label string of the edge format as an array."""
    return F.split(F.coalesce(label, F.lit("Global")), ",")


def union_regions(original: Column, duplicate: Column, limit: int = fixed.MAX_MERGED_REGIONS) -> Column:
    """Merge a duplicate's labels into the original's; Global is terminal."""
    merged = collapse_regions(F.array_union(split_regions(original), split_regions(duplicate)), limit)
    return F.when(F.coalesce(original, F.lit("Global")) == "Global", F.lit("Global")).otherwise(merged)


def country_lookup(spark: SparkSession) -> DataFrame:
    """Lookup rows (country, region): two-letter codes and lower-case names."""
    rows = [(key, row["region"]) for row in rules.load("countries")
            for key in dict.fromkeys([*row["codes"], row["country"].lower(), *(word.lower() for word in row.get("other", ()))])]
    return spark.createDataFrame(rows, "country string, region string")


def country_to_region(df: DataFrame, country: str, lookup: DataFrame, out: str = "region") -> DataFrame:
    """Left join of a country code or name to its region, Global when unknown.

    ``lookup`` holds one row per country, so its size is bounded by the world;
    the planner still decides from its statistics whether to broadcast it.
    """
    table = lookup.select(F.col("country").alias("_country"), F.col("region").alias("_region"))
    keyed = df.withColumn("_key", F.lower(F.trim(F.col(country))))
    joined = keyed.join(table, F.col("_key") == F.col("_country"), "left")
    return joined.withColumn(out, F.coalesce("_region", F.lit("Global"))).drop("_key", "_country", "_region")


def in_macro_region(label: Column, key: str, labels: dict[str, tuple[str, ...]] = fixed.MACRO_REGIONS) -> Column:
    """True when any of the row's labels belongs to the macro region."""
    return F.arrays_overlap(F.split(F.coalesce(label, F.lit("")), ","), strings(labels[key]))
