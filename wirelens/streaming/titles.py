"""Duplicate titles in a stream: blocks of titles that grow with the stream and expire by event time.

Two tables in partitions of the event day hold what came before: the distinct titles (their forms), and their blocks. A
micro-batch tokenises and packs its own rows and compares its blocks with each other and with the stored ones; stored
titles are never tokenised again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wirelens import fixed
from wirelens.operators import blocks, similar
from wirelens.session import drop, fresh_path, release, stored
from wirelens.sinks.tables import BatchTable, drop_partitions

TITLES = "pos long, form string, cves string, day date"
BLOCKS = f"{blocks.SCHEMA}, day date"


class SeenTitles:
    """Titles and blocks under ``path``; a batch is judged against those up to ``days`` older than its oldest row (None: all)."""

    def __init__(self, spark: SparkSession, path: str, days: int | None = fixed.CUTOFF_DAYS, threshold: float = fixed.FUZZY_THRESHOLD):
        self.spark, self.path, self.days, self.threshold = spark, path, days, threshold
        self.titles = BatchTable(spark, f"{path}/titles", TITLES, "day")
        self.blocks = BatchTable(spark, f"{path}/blocks", BLOCKS, "day")

    def _recent(self, table: BatchTable, batch_id: int, oldest) -> DataFrame:
        rows = table.read(before=batch_id)
        return rows if self.days is None or oldest is None else rows.filter(F.col("day") >= F.date_sub(F.lit(oldest), self.days))

    def judge(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Verdict per row of the batch (pos, title, exempt, day), as from ``duplicate_titles``, and the batch indexed.

        ``pos`` follows arrival: stored titles count as earlier. Rows of one batch are compared in its order whatever their
        days; undated ones count as of the batch's newest day. Exempt rows are never duplicates but later rows are
        compared with them. May be repeated for the same batch.
        """
        self.spent = fresh_path(self.spark, "batch")
        rows = stored(batch.select("pos", "title", F.coalesce("exempt", F.lit(False)).alias("exempt"), "day"), f"{self.spent}/rows", "zstd")
        oldest, newest = rows.agg(F.min("day"), F.max("day")).first()
        rows = rows.fillna({"exempt": False}).withColumn("day", F.coalesce("day", F.lit(newest or "1970-01-01").cast("date")))
        old_titles = self._recent(self.titles, batch_id, oldest)
        distinct = similar.distinct_titles(rows, "title", "pos", F.col("exempt")).drop("hashes").join(rows.select("pos", "day"), "pos")
        new = stored(distinct, f"{self.spent}/new", "zstd")
        release(self.spark)
        matches = self._matches(new, old_titles, batch_id, oldest)

        placed = similar.with_form(rows, F.col("title")).select("pos", "exempt", "form", "cves")
        first = new.groupBy("form").agg(F.min("pos").alias("first"))
        before = old_titles.join(new.select("form").distinct(), "form", "left_semi").groupBy("form").agg(F.min("pos").alias("old"))
        lookup = new.select("form", "cves", F.col("pos").alias("i")).join(first, "form").join(before, "form", "left").join(matches, "i", "left").drop("i")
        judged = placed.join(lookup, ["form", "cves"])
        known = F.col("old").isNotNull()
        copy = ~F.col("exempt") & (known | (F.col("pos") > F.col("first")))
        near = ~F.col("exempt") & F.col("j").isNotNull()
        return judged.select(
            "pos", (copy | near).alias("is_duplicate"), F.when(copy, "copy").when(near, "near").otherwise("new").alias("verdict"),
            F.when(copy & known, F.col("old")).when(copy, F.col("first")).when(near, F.col("j")).alias("match_pos"),
            F.when(copy, F.lit(1.0)).when(near, F.col("similarity")).alias("similarity"))

    def _matches(self, new: DataFrame, old_titles: DataFrame, batch_id: int, oldest) -> DataFrame:
        """(i, j, similarity) of the batch's distinct titles, and their blocks stored."""
        # a stored copy of a title on the same day adds nothing
        fresh = new.join(old_titles.select("form", "cves", "day").distinct(), ["form", "cves", "day"], "left_anti")
        self.titles.append(fresh, batch_id)
        words = blocks.words_of_a_block(self.spark)
        wide = fresh.filter(F.col("n_words") >= fixed.MIN_FUZZY_WORDS).withColumns(
            {"later": F.lit(True), "earlier": F.lit(True), "words": F.transform(F.split(F.trim("body"), " "), lambda w: F.xxhash64(w))})
        total = wide.agg(F.sum("n_words")).first()[0] or 0
        made = blocks.packed(wide.coalesce(max(4, -(-total // words))).sortWithinPartitions("day"), self.threshold, settle=True, words=words)
        packed = stored(made, f"{self.spent}/packed")
        found = stored(blocks.found_in(packed, self.threshold, old=self._recent(self.blocks, batch_id, oldest)), f"{self.spent}/found")
        # numbers of blocks differ between batches
        self.blocks.append(packed.withColumn("block", F.lit(batch_id).cast("long") * (1 << 44) + F.col("block")), batch_id)
        drop(self.spark, f"{self.spent}/packed")
        release(self.spark)
        return similar._best(found, self.threshold)

    def done(self) -> None:
        """Give up what the last batch stored for itself, once its verdicts are written."""
        drop(self.spark, self.spent)
        release(self.spark)

    def expire(self, newest: str) -> list[str]:
        """Drop the days that no row at most ``days`` late can still meet."""
        if self.days is None:
            return []
        oldest = self.spark.sql("SELECT string(date_sub(date(:newest), :days))", {"newest": newest, "days": 2 * self.days}).first()[0]
        gone = [drop_partitions(self.spark, f"{self.path}/{t}", "day", lambda v: v < oldest) for t in ("titles", "blocks")]
        return sorted(set(gone[0]) | set(gone[1]))
