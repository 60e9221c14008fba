"""Exact inner-product search by a vector-approximation file.

Every vector is stored as one byte per component, the number of its cell on an even grid. A scan of these cells gives
lower and upper bounds of every score: the product with the cell centres, plus or minus a margin that depends on the
query alone. Exact vectors are then read in the order of their upper bounds: first as many as are wanted, then those
whose bound still reaches the last of them; after that the result is certain.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelens.llm import columns as C
from wirelens.session import fresh_path

CELLS = 256
#: Queries that one pass over the approximations serves; also the bound of what is sent to every task.
BLOCK = 2048


def grid_vectors(table: DataFrame, *, vector: str = "embedding", key: str = "vec_id", scale: int = 1024) -> DataFrame:
    """key and v, the components as floor(scale * x), of the vectors that are whole and finite.

    Vectors that are null, empty, or hold a null or non-finite component are left out, and so are null keys. Of rows
    that share a key, the smallest vector counts. Components beyond a long count as its ends.
    """
    x = F.transform(F.col(vector), lambda e: e.cast("double"))
    good = (F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = table.where(F.col(key).isNotNull() & good).select(F.col(key).cast("long").alias("key"), F.transform(x, lambda e: F.floor(e * scale)).alias("v"))
    return rows.groupBy("key").agg(F.min("v").alias("v"))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers; shorter vectors are filled up with zeros."""
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(counts), width), np.float64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(counts)), counts)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)] = flat
    return out


def approximate(vectors: DataFrame, low: np.ndarray, step: np.ndarray) -> DataFrame:
    """key and cells (one byte per component) of every vector."""
    def task(batches):
        for part in batches:
            cells = np.floor((_matrix(part.column("v"), len(low)) - low) / step).clip(0, CELLS - 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([r.tobytes() for r in cells], pa.binary())], names=["key", "cells"])

    return vectors.mapInArrow(task, "key long, cells binary")


def _scan(files: DataFrame, ids: np.ndarray, queries: np.ndarray, low: np.ndarray, step: np.ndarray, k: int) -> DataFrame:
    """Candidates of each query: key and bounds of what a task's own lower bounds cannot rule out."""
    margin = np.abs(queries) @ step / 2 + 1e-6 * np.abs(queries) @ (np.abs(low) + CELLS * step)

    def task(batches):
        kept: list[list[np.ndarray]] = [[] for _ in ids]
        floor = np.full(len(ids), -np.inf)
        for part in batches:
            keys = part.column("key").to_numpy(zero_copy_only=False)
            cells = np.frombuffer(b"".join(part.column("cells").to_pylist()), np.uint8).reshape(len(keys), len(low))
            score = (cells * step + (low + step / 2)) @ queries.T
            score[keys[:, None] == ids[None]] = -np.inf
            for j in range(len(ids)):
                near = np.flatnonzero(score[:, j] + margin[j] >= floor[j])
                near = near[score[near, j] > -np.inf]
                if not len(near):
                    continue
                kept[j].append(np.rec.fromarrays([keys[near], score[near, j]], names="key,score"))
                both = np.concatenate(kept[j]).view(np.recarray)
                if len(both) > k:
                    floor[j] = max(floor[j], np.partition(both.score, len(both) - k)[len(both) - k] - margin[j])
                    both = both[both.score + margin[j] >= floor[j]]
                kept[j] = [both]
        for j in range(len(ids)):
            if kept[j]:
                r = kept[j][0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), ids[j])), pa.array(r.key), pa.array(r.score - margin[j]),
                                                  pa.array(r.score + margin[j])], names=["query", "key", "least", "most"])

    return files.mapInArrow(task, "query long, key long, least double, most double")


def search(table: DataFrame, queries: Callable[[Column], Column], *, vector: str = "embedding", key: str = "vec_id", k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank (from 1), the found key and score of the ``k`` highest inner products of each query.

    ``queries`` is a condition on the key column; every other vector is a candidate. Equal scores rank by smaller key; fewer
    candidates than ``k`` are all returned. Vectors of other lengths count as filled up with zeros. Scores beyond a long count
    as its ends. Of equal vectors the k + 1 smallest keys can be found, one of which may be the query itself: only they are scanned.
    """
    spark = C.session(table.sparkSession)
    at = fresh_path(spark, "vectors")
    grid_vectors(table, vector=vector, key=key, scale=scale).write.parquet(f"{at}/exact")
    exact = spark.read.parquet(f"{at}/exact")
    shape = "query_id long, rank int, {} long, score long".format(key)
    ends = exact.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.min("x"), F.max("x")).orderBy("d").collect()
    if not ends:
        return spark.createDataFrame([], shape)
    width = len(ends)
    low, high = np.array([min(0, r[1]) for r in ends], float), np.array([max(0, r[2]) for r in ends], float)
    step = np.maximum((high - low + 1) / CELLS, 1e-9)
    equal = Window.partitionBy("v").orderBy("key")
    several = exact.withColumn("n", F.row_number().over(equal)).where(F.col("n") <= k + 1).select("key", "v")
    approximate(several, low, step).write.parquet(f"{at}/cells")
    files = spark.read.parquet(f"{at}/cells")
    asked = exact.where(queries(F.col("key")))
    blocks = -(-asked.count() // BLOCK)
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).toArrow()
        if rows.num_rows:
            ids = rows.column("key").combine_chunks().to_numpy(zero_copy_only=False)
            q = _matrix(rows.column("v").combine_chunks(), width)
            _scan(files, ids, q, low, step, k).write.mode("append").parquet(f"{at}/candidates")
    if not blocks:
        return spark.createDataFrame([], shape)
    found = spark.read.parquet(f"{at}/candidates")
    by_least, by_most = Window.partitionBy("query").orderBy(F.desc("least"), "key"), Window.partitionBy("query").orderBy(F.desc("most"), "key")
    bound = found.withColumn("n", F.row_number().over(by_least)).where(F.col("n") <= k).groupBy("query").agg(F.min("least").alias("bound"), F.max("n").alias("n"))
    open_ = (found.join(bound, "query").where((F.col("n") < k) | (F.col("most") >= F.col("bound")))
             .withColumn("turn", F.row_number().over(by_most)).select("query", "key", "most", "turn"))
    open_.write.parquet(f"{at}/open")
    open_ = spark.read.parquet(f"{at}/open")
    first = _scored(open_.where(F.col("turn") <= k), exact)
    certain = first.groupBy("query").agg(F.min("score").alias("kth"))
    rest = open_.where(F.col("turn") > k).join(certain, "query").where(F.col("most") >= F.col("kth"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    every = first.unionByName(_scored(rest.select("query", "key"), exact))
    return (every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select(F.col("query").alias("query_id"), "rank", F.col("key").alias(key), "score"))


def _scored(pairs: DataFrame, exact: DataFrame) -> DataFrame:
    """query, key and exact score of each pair."""
    left = exact.select("key", F.col("v").alias("a"))
    right = exact.select(F.col("key").alias("query"), F.col("v").alias("b"))
    zero = F.lit(0).cast("long")
    pairs_of = F.zip_with("a", "b", lambda x, y: F.struct(F.coalesce(x, zero).alias("x"), F.coalesce(y, zero).alias("y")))
    exactly = F.aggregate(pairs_of, zero, lambda s, p: F.try_add(s, F.try_multiply(p.x, p.y)))
    about = F.aggregate(pairs_of, F.lit(0.0), lambda s, p: s + p.x.cast("double") * p.y.cast("double"))
    product = F.coalesce(exactly, F.when(about > 0, F.lit(2 ** 63 - 1)).otherwise(F.lit(-2 ** 63)))
    return pairs.join(left, "key").join(right, "query").select("query", "key", product.alias("score"))
