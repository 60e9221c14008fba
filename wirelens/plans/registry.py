"""Registry of checked queries: a Spark callable and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wirelens.plans import headlines as hl
from wirelens.session import prepare, spread

TEXT_TABLES = ("documents", "pages", "conversations")
AS_OF = "2024-01-31 00:00:00"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given parquet tables of one scale folder, and the item view over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = prepare(spark), sf_dir

    def __call__(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return spread(table) if name in TEXT_TABLES else table

    def headlines(self) -> DataFrame:
        return hl.headlines(self("documents"))

    def events(self) -> DataFrame:
        """Events with an instant timestamp (the files carry a zone-less one; the session zone is UTC)."""
        events = self("events")
        return events.withColumn("ts", events.ts.cast("timestamp"))


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its oracle text."""
    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            text = sql.strip()
            if "headlines" in text or "item_cves" in text:  # the item view comes first
                view = hl.ORACLE_WITH
                if text.startswith("WITH RECURSIVE"):
                    view, text = view.replace("WITH", "WITH RECURSIVE", 1), "WITH" + text[14:]
                text = view + (", " + text[4:] if text.startswith("WITH") else text)
            ORACLES[name] = text
        return fn
    return add
