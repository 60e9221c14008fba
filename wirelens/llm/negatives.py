"""Hard negatives by Kronecker-packed products.

The components of several candidates are made non-negative by a bias of their dimension and laid side by side as fields
of one wide integer. A block of anchors multiplies that integer once per anchor component; the sum then holds the exact
product of the anchor with every one of these candidates in its field, from where shift and mask take it. Field widths
follow from the table's own ranges, so no field can run into the next. Tables whose products need more than 63 bits are
packed into integers of any length by the same steps.

Candidates are packed once. Each block of anchors then passes over them twice: for the best rows of the anchor's own
label (only words of that label are multiplied), and for the best rows of other labels inside the score window of each
positive. A task keeps as many rows per anchor or pair as are wanted, so what it returns does not grow with its input.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wirelens.llm import columns as C
from wirelens.session import fresh_path

#: Anchors that one pass over the candidates serves; also the bound of what is sent to every task.
BLOCK = 1024
#: Bits of a machine integer that fields may fill.
ROOM = 63
#: Candidates of an integer where a machine integer holds not even one.
WIDE_FIELDS = 3
LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Packing:
    """How candidates lie in an integer: ``fields`` of ``width`` bits each, components less ``bias``."""

    scale: int
    bias: list[int]
    width: int
    fields: int

    @property
    def wide(self) -> bool:
        return self.width * self.fields > ROOM

    @property
    def word_bytes(self) -> int:
        return 8 if not self.wide else -(-self.width * self.fields // 8) + 1

    def whole(self, lists: pa.Array) -> np.ndarray:
        """Rows of floor(scale * x) of equal length; missing components are zero."""
        counts = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, int)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        out = np.zeros((len(lists), len(self.bias)), object if self.wide else np.int64)
        rows = np.repeat(np.arange(len(lists)), counts)
        places = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
        out[rows, places] = [math.floor(Fraction(x) * self.scale) for x in flat.tolist()] if self.wide else np.floor(flat * self.scale).astype(np.int64)
        return out

    def pack(self, rows: np.ndarray) -> np.ndarray:
        """One word per dimension for every ``fields`` rows; a last group is filled up with the bias itself."""
        fill = -len(rows) % self.fields
        biased = np.concatenate([rows - np.array(self.bias, rows.dtype), np.zeros((fill, rows.shape[1]), rows.dtype)])
        groups = biased.reshape(-1, self.fields, rows.shape[1])
        return sum(groups[:, f] << (self.width * f) for f in range(self.fields))

    def products(self, words: np.ndarray, anchors: np.ndarray) -> np.ndarray:
        """Exact product of each packed row with each anchor: (words * fields, anchors)."""
        half = 1 << (self.width - 1)
        sums = words @ anchors.T + sum(half << (self.width * f) for f in range(self.fields))  # every field is >= 0 now
        own = (anchors * np.array(self.bias, anchors.dtype)).sum(axis=1) - half
        parts = [((sums >> (self.width * f)) & ((1 << self.width) - 1)) + own for f in range(self.fields)]
        return np.stack(parts, axis=1).reshape(len(words) * self.fields, len(anchors))

    def to_binary(self, words: np.ndarray) -> list[bytes]:
        if not self.wide:
            return [row.tobytes() for row in np.ascontiguousarray(words)]
        return [b"".join(int(x).to_bytes(self.word_bytes, "little", signed=True) for x in row) for row in words]

    def from_binary(self, packed: list[bytes]) -> np.ndarray:
        joined, size, n = b"".join(packed), self.word_bytes, len(self.bias)
        if not self.wide:
            return np.frombuffer(joined, np.int64).reshape(len(packed), n) if joined else np.zeros((len(packed), n), np.int64)
        flat = [int.from_bytes(joined[i:i + size], "little", signed=True) for i in range(0, len(joined), size)]
        out = np.empty(len(flat), object)
        out[:] = flat
        return out.reshape(len(packed), n)


def usable(table: DataFrame, *, vector: str, key: str, label: str) -> DataFrame:
    """key, label and x of the rows that take part; of rows that share a key, the smallest label and vector."""
    x = F.transform(F.col(vector), lambda e: e.cast("double"))
    good = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = table.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & good)
    one = rows.select(F.col(key).cast("long").alias("key"), F.struct(F.col(label).cast("long").alias("label"), x.alias("x")).alias("row"))
    return one.groupBy("key").agg(F.min("row").alias("row")).select("key", "row.label", "row.x")


def packing(rows: DataFrame, anchors: DataFrame, scale: int) -> Packing | None:
    """Bias and widths from the ranges of all rows and the largest reach of any anchor; None for an empty table."""
    ends = (rows.select(F.posexplode("x").alias("d", "x")).groupBy("d").agg(F.min("x"), F.max("x")).orderBy("d").collect())
    size = rows.agg(F.max(F.size("x"))).first()[0]
    if size is None:
        return None
    whole = lambda x: math.floor(Fraction(x) * scale)
    low = [min(0, whole(r[1])) for r in ends]  # 0: what a shorter vector counts as
    spread = [max(0, whole(r[2])) - lo for r, lo in zip(ends, low)]
    reach = sum(max(-lo, s + lo) * s for lo, s in zip(low, spread))  # of an anchor at the ends of every range
    if 0 < reach < 1 << 60:
        by_place = F.aggregate(F.zip_with("x", F.array(*[F.lit(float(s)) for s in spread]), lambda x, s: F.abs(F.floor(F.coalesce(x, F.lit(0.0)) * scale)) * s),
                               F.lit(0.0), lambda a, b: a + b)
        reach = min(reach, math.ceil((anchors.agg(F.max(by_place)).first()[0] or 0) * (1 + 1e-9)))
    width = reach.bit_length() + 2
    return Packing(scale, low, width, max(1, ROOM // width) if width <= ROOM else WIDE_FIELDS)


def packed(rows: DataFrame, how: Packing) -> DataFrame:
    """label, keys (of ``fields`` candidates of that label, null where a group is not full) and their words."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            labels, keys = (part.column(c).to_numpy(zero_copy_only=False) for c in ("label", "key"))
            v, out = how.whole(part.column("x")), ([], [], [])
            for label in np.unique(labels):
                own = np.flatnonzero(labels == label)
                words = how.to_binary(how.pack(v[own]))
                ids = keys[own].tolist() + [None] * (-len(own) % how.fields)
                for column, more in zip(out, ([int(label)] * len(words), [ids[i:i + how.fields] for i in range(0, len(ids), how.fields)], words)):
                    column.extend(more)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int64())), pa.array(out[2], pa.binary())],
                                             names=["label", "keys", "words"])

    return rows.mapInArrow(task, "label long, keys array<long>, words binary")


class Best:
    """The ``k`` rows of highest score, then smallest key, of each of ``n`` groups."""

    def __init__(self, n: int, k: int, how: Packing) -> None:
        kind = object if how.wide else np.int64
        self.k, self.floor = k, np.full(n, -(1 << 8 * how.word_bytes - 1) if how.wide else -LONG, kind)
        self.held = (np.zeros(0, np.int64), np.zeros(0, kind), np.zeros(0, np.int64))

    def offer(self, groups: np.ndarray, scores: np.ndarray, keys: np.ndarray) -> None:
        """Rows that reach ``floor``, the score from which a row may still enter its group."""
        if not len(groups):
            return
        g, s, k = (np.concatenate([a, b]) for a, b in zip(self.held, (groups, scores, keys)))
        order = np.lexsort((k, -s, g)) if s.dtype != object else np.array(sorted(range(len(g)), key=lambda i: (g[i], -s[i], k[i])))
        g, s, k = g[order], s[order], k[order]
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        place = np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)]))
        keep, full = place < self.k, place == self.k - 1
        self.held = g[keep], s[keep], k[keep]
        self.floor[g[full]] = s[full]


def _words(batches: Iterator[pa.RecordBatch], how: Packing) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """labels, words, and key of each field with a mask of those that are there."""
    for part in batches:
        keys = part.column("keys").flatten()
        there = keys.is_valid().to_numpy(zero_copy_only=False)
        yield (part.column("label").to_numpy(zero_copy_only=False), how.from_binary(part.column("words").to_pylist()),
               keys.fill_null(0).to_numpy(zero_copy_only=False), there)


def _rows(best: Best, ids: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    g, s, k = best.held
    if len(g):
        score = [max(-LONG - 1, min(LONG, int(x))) for x in s]
        exact = [str(int(x)) for x in s]
        columns = [pa.array(i[g], pa.int64()) for i in ids] + [pa.array(k, pa.int64()), pa.array(score, pa.int64()), pa.array(exact, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=[*names, "key", "score", "exact"])


def _own_label(files: DataFrame, how: Packing, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, k: int) -> DataFrame:
    """anchor, key, score: the ``k`` best other rows of the anchor's label that each task saw."""
    def task(batches):
        best = Best(len(ids), k, how)
        for row_labels, words, keys, there in _words(batches, how):
            for label in np.intersect1d(row_labels, labels):
                at, mine = np.flatnonzero(labels == label), np.flatnonzero(row_labels == label)
                score = how.products(words[mine], vectors[at])
                where = (mine[:, None] * how.fields + np.arange(how.fields)).ravel()
                open_ = there[where][:, None] & (keys[where][:, None] != ids[at]) & (score >= best.floor[at])
                r, c = np.nonzero(open_)
                best.offer(at[c], score[r, c], keys[where][r])
        yield from _rows(best, [ids], ["anchor"])

    return files.mapInArrow(task, "anchor long, key long, score long, exact string")


def _other_labels(files: DataFrame, how: Packing, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray,
                  pairs: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], k: int) -> DataFrame:
    """anchor, positive, key, score: the ``k`` best rows of other labels in the window of each pair that each task saw.

    ``pairs``: place of the anchor in ``ids``, positive, least and most score.
    """
    anchor, positive, least, most = pairs

    def task(batches):
        best = Best(len(anchor), k, how)
        for row_labels, words, keys, there in _words(batches, how):
            score = how.products(words, vectors)
            other = there[:, None] & (np.repeat(row_labels, how.fields)[:, None] != labels)
            floors = np.maximum(best.floor, least.astype(score.dtype))
            for p in np.array_split(np.arange(len(anchor)), -(-len(anchor) // 256)):
                s = score[:, anchor[p]]
                r, c = np.nonzero((s >= floors[p]) & (s <= most[p].astype(score.dtype)) & other[:, anchor[p]])
                best.offer(p[c], s[r, c], keys[r])
        yield from _rows(best, [ids[anchor], positive], ["anchor", "positive"])

    return files.mapInArrow(task, "anchor long, positive long, key long, score long, exact string")


def _first(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """The ``k`` rows of highest exact score, then smallest key, of each group, with their rank."""
    n = F.length("exact")  # decimal digits: numbers of any length in order
    below = F.col("exact").startswith("-")
    order = [F.desc(~below), F.when(below, n).otherwise(-n), F.when(below, F.col("exact")).asc(), F.when(~below, F.col("exact")).desc(), F.asc("key")]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def mine(table: DataFrame, anchors: Callable[[Column], Column], *, vector: str = "embedding", key: str = "vec_id", label: str = "label",
         scale: int = 256, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90)) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    A row's score is its product with the anchor, both as floor(scale * x); higher scores come first, ties by smaller
    key. Each anchor (a condition on the key) has its first ``positives`` other rows of the same label; each such pair
    its first ``negatives`` rows of another label whose score is within ``window`` percent of the positive's score.

    Rows with a null key, label or vector, or any null or non-finite component take no part. Of rows that share a key,
    the one of smallest label, then vector counts. Shorter vectors count as filled up with zeros. Other columns are not
    looked at. An anchor without positives or a pair without negatives gives no row. Scores beyond a long are compared
    exactly and returned as the nearest long.
    """
    spark = C.session(table.sparkSession)
    at = fresh_path(spark, "negatives")
    usable(table, vector=vector, key=key, label=label).write.parquet(f"{at}/rows")
    rows = spark.read.parquet(f"{at}/rows")
    asked = rows.where(anchors(F.col("key")))
    blocks = -(-asked.count() // BLOCK)
    how = packing(rows, asked, scale) if blocks else None
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if how is None:
        return spark.createDataFrame([], shape)
    packed(rows, how).write.parquet(f"{at}/packed")
    asked.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")).write.partitionBy("block").parquet(f"{at}/anchors")
    files, groups = spark.read.parquet(f"{at}/packed"), spark.read.parquet(f"{at}/anchors")
    both = "anchor long, positive long, key long, score long, exact string"
    for b in range(blocks):
        part = groups.where(F.col("block") == b).select("key", "label", "x").toArrow().combine_chunks()
        if not part.num_rows:
            continue
        ids, labels = (part.column(c).to_numpy() for c in ("key", "label"))
        vectors = how.whole(part.column("x").combine_chunks())
        best = _first(_own_label(files, how, ids, labels, vectors, positives), ["anchor"], positives)
        best.write.mode("append").parquet(f"{at}/positives/block={b}")
        found = _pairs(spark, f"{at}/positives/block={b}", ids, window)
        if len(found[0]):
            _other_labels(files, how, ids, labels, vectors, found, negatives).write.mode("append").parquet(f"{at}/found")
    if not _there(spark, f"{at}/found"):
        return spark.createDataFrame([], shape)
    known = spark.read.parquet(f"{at}/positives").select("anchor", F.col("key").alias("positive"), F.col("score").alias("positive_score"))
    return (_first(spark.read.schema(both).parquet(f"{at}/found"), ["anchor", "positive"], negatives).join(known, ["anchor", "positive"])
            .select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("key").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))


def _pairs(spark: SparkSession, at: str, ids: np.ndarray, window: tuple[int, int]) -> tuple[np.ndarray, ...]:
    """Pairs of one block (at most BLOCK times the wanted positives): place of the anchor, positive, score window."""
    rows = spark.read.parquet(at).select("anchor", "key", "exact").collect()
    place = {int(x): i for i, x in enumerate(ids)}
    least, most = (np.empty(len(rows), object) for _ in range(2))
    least[:] = [-(-window[0] * int(r.exact) // 100) for r in rows]
    most[:] = [window[1] * int(r.exact) // 100 for r in rows]
    return np.array([place[r.anchor] for r in rows], int), np.array([r.key for r in rows], np.int64), least, most


def _there(spark: SparkSession, at: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(at)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def anchored(rows: DataFrame) -> DataFrame:
    """The labels as mined: one more, modulo ten, where the key is divisible by seven."""
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


#: The same rows in SQL, comparing every anchor with every row.
ORACLE = """
with rows as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same,
         list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::bigint as score
  from rows a, rows b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
), positives as (
  select anchor_id, other_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
)
select anchor_id, positive_id,
       row_number() over (partition by anchor_id, positive_id order by score desc, other_id)::int as rank,
       other_id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id)
where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10
"""
