"""Exact Jaccard join of word-shingle sets by universe partition and pigeonhole.

Sets fall into bands of size. A band cuts the universe of shingles into segments by hash; two sets of enough
similarity differ in at most D shingles, so of D + 1 segments one is the same in both, and a segment that also knows
its one-deletion neighbours stands for two, which small sets need. A band has some more segments, of which every set
leaves out its lightest: two sets without a shingle in common must not meet because both have an empty segment. Sets
that share a segment meet under its key and are verified exactly. Only components are wanted, so the sets under a key
are first verified against one head; sets that this leaves in different components are compared in blocks after that,
or pair by pair as they met where this moves less.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirelens.llm import columns as C
from wirelens.llm.components import components
from wirelens.session import fresh_path

#: Ratio of the sizes that a band spans; over 100 / 85, so that a set meets its own band and the one below.
BAND = 1.3
#: Most sets and shingles of one block when members of a family are compared with each other.
BLOCK_SETS, BLOCK_SHINGLES = 1_000, 400_000
#: Keys that a task gathers before it writes them out with their local followers.
CHUNK_KEYS = 400_000
#: Further segments of a band, in hundredths of those that a set uses; the lightest stay out.
SPARE = 10
#: What one round of comparisons may shuffle, as a share of all stored sets; more takes several rounds.
ROUND_SHARE = 0.5


@dataclass(frozen=True)
class Join:
    """Shingle width in words and the least similarity, in hundredths."""

    width: int = 4
    percent: int = 85

    def differ(self, x: int) -> int:
        """Most shingles in which a set of at most ``x`` can differ from a linked one of any size up to its largest."""
        most = x + x * 100 // self.percent
        return most * (100 - self.percent) // (100 + self.percent)


@lru_cache(maxsize=None)
def band_top(number: int) -> int:
    return 5 if number <= 0 else max(band_top(number - 1) + 1, int(band_top(number - 1) * BAND))


def allocation(differ: int) -> tuple[int, int]:
    """Segments for sets that differ in so many shingles, and how many of them know one-deletion neighbours.

    So few segments that some could well be empty all know their neighbours; of more, a set may leave some out.
    """
    if differ <= 3:
        two = (differ + 1) // 2
        return differ + 1 - two, two
    return differ + 1 + max(2, -(-differ * SPARE // 100)), 0


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, text by text in ascending order, and how many each text has."""
    data, offsets = C.raw(texts)
    upper = (data >= 65) & (data <= 90)
    lowered = data + (upper * 32).astype(np.uint8)
    blank = (lowered == 32) | ((lowered >= 9) & (lowered <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    inner = ~blank
    starts = np.flatnonzero(inner & (np.r_[True, blank[:-1]] | edge[:-1])) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(inner & (np.r_[blank[1:], True] | edge[1:])) + 1 if len(data) else starts
    words = C.spans_hash(lowered, starts, ends)
    first = np.searchsorted(starts, offsets)
    sets, sizes = [], np.zeros(len(texts), np.int64)
    turn = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
    for i in range(len(texts)):
        w = words[first[i]:first[i + 1]]
        if not len(w):
            continue
        n = min(width, len(w))
        h = np.full(len(w) - n + 1, n, np.uint64)
        for j in range(n):
            h = C.mixed(h * turn[j % 5] + w[j:len(w) - n + 1 + j])
        h = np.unique(h)
        sets.append(h)
        sizes[i] = len(h)
    return np.concatenate([*sets, np.zeros(0, np.uint64)]), sizes


def _keys(found: np.ndarray, size: int, join: Join) -> np.ndarray:
    """Keys of one set in its own band and, if smaller sets of the band below can be linked to it, in that one."""
    out = []
    number = 0
    while band_top(number) < size:
        number += 1
    for band in (number, number - 1):
        if band < 0 or (band < number and size * join.percent > band_top(band) * 100):
            continue
        top = band_top(band)
        # what this very set can differ in from a linked one that has keys of the band
        differ = join.differ(size) if band == number else min(join.differ(size), (size + top) * (100 - join.percent) // (100 + join.percent))
        if not differ:
            continue  # only equal sets are linked
        m, two = allocation(join.differ(top))
        mark = np.uint64(band * 0x9E3779B1 + 1)
        segment = ((C.mixed(found + mark) >> np.uint64(16)) % np.uint64(m)).astype(np.int64)
        value = C.mixed(found ^ np.uint64(0x5851F42D4C957F2D))
        sums, held = np.zeros(m, np.uint64), np.bincount(segment, minlength=m)
        np.add.at(sums, segment, value)
        label = C.mixed(np.arange(m, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + mark)
        key = C.mixed(sums + label)
        if two:
            near = segment < two
            out += [key, C.mixed(sums[segment[near]] - value[near] + label[segment[near]])]
        else:
            # Of the m segments, at least m - differ are the same in a linked set. In the order of weight and key, which
            # both sets share, the last of these is never among the m - differ - 1 lightest of either.
            out.append(key[np.lexsort((key, held))[m - differ - 1:]])
    return np.concatenate([*out, np.zeros(0, np.uint64)])


def describe(docs: DataFrame, join: Join) -> DataFrame:
    """doc_id, n_shingles and a 128-bit digest of the set (low, high), for every document."""
    def task(batches):
        for part in C.slices(batches, "text"):
            found, sizes = shingle_sets(C.filled(part.column("text")), join.width)
            starts, some = np.cumsum(sizes) - sizes, sizes > 0
            low, high = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
            if len(found):
                low[some] = np.add.reduceat(C.mixed(found + np.uint64(11)), starts[some])
                high[some] = np.add.reduceat(C.mixed(found ^ np.uint64(0xA0761D6478BD642F)), starts[some])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), pa.array(low.view(np.int64)), pa.array(high.view(np.int64))],
                                             names=["doc_id", "n_shingles", "low", "high"])

    return docs.mapInArrow(C.lean(task), "doc_id long, n_shingles long, low long, high long")


def segment_keys(docs: DataFrame, join: Join) -> DataFrame:
    """key, doc and followers: the documents under each key, gathered per chunk of a task before they are shuffled.

    Copies of a set within a chunk are left to their digests.
    """
    def flush(keys, owners):
        key, doc = np.concatenate(keys), np.concatenate(owners)
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        fresh = np.r_[True, key[1:] != key[:-1]] | np.r_[True, doc[1:] != doc[:-1]]
        key, doc = key[fresh], doc[fresh]
        head = np.r_[True, key[1:] != key[:-1]]
        starts = np.flatnonzero(head)
        ends = np.cumsum(np.diff(np.r_[starts, len(key)]) - 1)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(doc[~head]))
        for i in range(0, len(starts), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(key[starts[i:i + 20_000]].view(np.int64)), pa.array(doc[starts[i:i + 20_000]]),
                                              lists.slice(i, 20_000)], names=["key", "doc", "followers"])

    def task(batches):
        keys, owners, many, seen = [], [], 0, set()
        for part in C.slices(batches, "text"):
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            found, sizes = shingle_sets(C.filled(part.column("text")), join.width)
            starts = np.cumsum(sizes) - sizes
            for i in np.flatnonzero(sizes):
                own = found[starts[i]:starts[i] + sizes[i]]
                digest = hash(own.tobytes())
                if digest in seen:
                    continue
                seen.add(digest)
                k = _keys(own, int(sizes[i]), join)
                keys.append(k)
                owners.append(np.full(len(k), ids[i], np.int64))
                many += len(k)
            if many >= CHUNK_KEYS:
                yield from flush(keys, owners)
                keys, owners, many, seen = [], [], 0, set()
        if many:
            yield from flush(keys, owners)

    return docs.mapInArrow(C.lean(task), "key long, doc long, followers array<long>")


def sets_of(docs: DataFrame, join: Join) -> DataFrame:
    """doc, its shingle hashes, their number, and the distinct 16-bit stumps of the hashes."""
    def task(batches):
        for part in C.slices(batches, "text"):
            found, sizes = shingle_sets(C.filled(part.column("text")), join.width)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(found.view(np.int64)))
            stumps = [np.unique((x >> np.uint64(48)).astype(np.uint16)).view(np.int16) for x in np.split(found, np.cumsum(sizes)[:-1])]
            ends = np.cumsum([len(x) for x in stumps]).astype(np.int32)
            short = pa.ListArray.from_arrays(pa.array(np.r_[np.int32(0), ends]), pa.array(np.concatenate(stumps)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(sizes), short], names=["doc", "shingles", "n", "stumps"])

    return docs.mapInArrow(C.lean(task), "doc long, shingles array<long>, n long, stumps array<smallint>")


def _linked(pairs: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, counted exactly.

    Stumps of the hashes go first, a quarter of the size: equal shingles have equal stumps, so the common stumps, and
    as many more as a set lost by clashes within it, bound the common shingles from above.
    """
    def sides(column: str):
        return [sets.select(F.col("doc").alias(side), F.col("n").alias(f"n_{side}"), F.col(column).alias(f"s_{side}")) for side in "ab"]

    def enough(common):
        return common * 100 >= (F.col("n_a") + F.col("n_b") - common) * join.percent

    left, right = sides("stumps")
    lost = F.least(F.col("n_a") - F.size("s_a"), F.col("n_b") - F.size("s_b"))
    near = pairs.join(left, "a").join(right, "b").where(enough(F.size(F.array_intersect("s_a", "s_b")) + lost)).select("a", "b")
    left, right = sides("shingles")
    return near.join(left, "a").join(right, "b").where(enough(F.size(F.array_intersect("s_a", "s_b")))).select("a", "b")


def _rounds(bulk: float, room: float) -> int:
    """How many rounds keep the shuffle of ``bulk`` bytes within its share of ``room`` bytes of sets."""
    return max(1, int(np.ceil((bulk or 0) / max(ROUND_SHARE * room, 1))))


def _sparse(members: DataFrame, apart: DataFrame) -> DataFrame:
    """Families of several blocks (members: family, rep, n) whose sets met so rarely that single pairs move fewer shingles.

    ``apart`` has the key, rep and, by key, what its pairs hold (cost).
    """
    whole = members.groupBy("family").agg(F.sum("n").alias("held"), F.ceil(F.sum(F.col("n") + BLOCK_SHINGLES // BLOCK_SETS) / BLOCK_SHINGLES).alias("blocks"))
    met = (apart.select("key", F.col("head").alias("rep"), "cost").distinct().join(members.select("rep", "family"), "rep")
           .groupBy("family").agg(F.sum("cost").alias("cost")))
    return whole.where("blocks > 1").join(met, "family").where("cost < held * blocks").select("family")


def _met_pairs(apart: DataFrame, join: Join) -> DataFrame:
    """a, b and the size of a: sets of different components and fitting sizes that met under a key."""
    x, y = (apart.select("key", F.col("rep").alias(s), F.col("n").alias(f"n_{s}"), F.col("component").alias(f"c_{s}")) for s in "ab")
    fits = (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * join.percent) & (F.col("c_a") != F.col("c_b"))
    return x.join(y, "key").where((F.col("a") > F.col("b")) & fits).select("a", "b", F.col("n_a").alias("n")).distinct()


def _family_tasks(members: DataFrame, join: Join) -> tuple[DataFrame, DataFrame]:
    """The members with their blocks, and the pairs of blocks to compare with the shingles that each deals out."""
    by_size = Window.partitionBy("family").orderBy("n", "rep")
    weight = F.sum(F.col("n") + BLOCK_SHINGLES // BLOCK_SETS).over(by_size)
    members = members.withColumn("block", F.floor(weight / BLOCK_SHINGLES))
    blocks = members.groupBy("family", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.sum("n").alias("held"))
    x, y = (blocks.select("family", *[F.col(c).alias(c + s) for c in ("block", "least", "most", "held")]) for s in ("_x", "_y"))
    return members, (x.join(y, "family").where((F.col("block_x") <= F.col("block_y")) & (F.col("least_y") * join.percent <= F.col("most_x") * 100))
             .select("family", "block_x", "block_y", (F.col("held_x") + F.when(F.col("block_x") != F.col("block_y"), F.col("held_y")).otherwise(0)).alias("dealt")))


def _linked_in_families(members: DataFrame, tasks: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """Linked pairs (a, b) of different components, of members (rep, n, component, family, block) of one family.

    A family is cut by size into blocks of a bounded number of sets and shingles; blocks of fitting sizes are compared
    with each other by a product of incidence matrices, so that no pair is written that is no link.
    """
    left = tasks.join(members.withColumnRenamed("block", "block_x"), ["family", "block_x"]).withColumn("side", F.lit(0))
    right = tasks.where("block_x <> block_y").join(members.withColumnRenamed("block", "block_y"), ["family", "block_y"]).withColumn("side", F.lit(1))
    dealt = left.unionByName(right).join(sets.select(F.col("doc").alias("rep"), "shingles"), "rep")

    def compare(table: pa.Table) -> pa.Table:
        rep, n, own = (table.column(c).to_numpy() for c in ("rep", "n", "component"))
        side = table.column("side").to_numpy()
        lists = table.column("shingles").combine_chunks()
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(rep)), lists.value_lengths().to_numpy(zero_copy_only=False))
        _, shingle, times = np.unique(flat, return_inverse=True, return_counts=True)
        shared = times[shingle] > 1
        number = np.cumsum(times > 1) - 1
        shingle, owner = number[shingle[shared]], owner[shared]
        order = np.argsort(shingle, kind="stable")
        shingle, owner = shingle[order], owner[order]
        first, second = np.flatnonzero(side == 0), np.flatnonzero(side == side.max())
        common = np.zeros((len(rep), len(rep)), np.float32)
        for start in range(0, int(shingle[-1]) + 1 if len(shingle) else 0, 4096):
            a, b = np.searchsorted(shingle, (start, start + 4096))
            grid = np.zeros((len(rep), 4096), np.float32)
            grid[owner[a:b], shingle[a:b] - start] = 1
            common[np.ix_(first, second)] += grid[first] @ grid[second].T
        i, j = np.nonzero((common * 100 >= (n[:, None] + n[None] - common) * join.percent) & (common > 0) & (own[:, None] != own[None]))
        return pa.table({"a": rep[i], "b": rep[j]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return dealt.groupBy("family", "block_x", "block_y").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", join: Join = Join()) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) for every document.

    Words are the runs without blanks, A to Z lower-cased; a document's set are its distinct shingles of ``width``
    words, or all its words as one if there are fewer. Texts without words (null, empty) have no shingles and link with
    nothing. Rows that share a doc_id are documents of their own: each has its own set, links and component. Rows without
    a doc_id are described but not linked; their component_id is null. Shingles are compared by 64-bit hashes.
    """
    C.session(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return _components(docs, join)
    rows = C.stored(docs.withColumn("__row", F.monotonically_increasing_id()))
    found = _components(rows.where("doc_id is not null").select(F.col("__row").alias("doc_id"), "text"), join)
    placed = C.stored(rows.select("doc_id", "__row").join(found.withColumnRenamed("doc_id", "__row"), "__row"))
    least = placed.groupBy("component_id").agg(F.min("doc_id").alias("least"))
    nameless = _components(rows.where("doc_id is null").select("doc_id", "text"), join)
    return placed.join(least, "component_id").select("doc_id", "n_shingles", F.col("least").alias("component_id")).unionByName(nameless)


def _components(docs: DataFrame, join: Join) -> DataFrame:
    """The same for documents whose doc_id, where there is one, is their own."""
    spark = C.session(docs.sparkSession)
    at = fresh_path(spark, "jaccard")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{at}/{name}")
        return spark.read.parquet(f"{at}/{name}")

    known = docs.where("doc_id is not null")
    facts = kept(describe(docs, join), "facts")
    digest = ["low", "high", "n_shingles"]
    heads = facts.where("n_shingles > 0").groupBy(*digest).agg(F.min("doc_id").alias("rep"))
    facts = kept(facts.join(heads, digest, "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")), "reps")
    together, gathered = Window.partitionBy("key"), F.concat(F.array("doc"), "followers")
    met = kept(segment_keys(known, join).select("key", "doc", gathered.alias("members"))
               .select("key", "members", F.min("doc").over(together).alias("head"), F.sum(F.size("members")).over(together).alias("total"))
               .where("total > 1").select("key", "head", "total", F.explode("members").alias("doc")), "met")
    C.release(spark)  # the keys are the bulk of all that is shuffled
    reps = facts.where("doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("rep"), F.min("n_shingles").alias("n"))
    a, b = reps.select(F.col("doc_id").alias("a"), F.col("rep").alias("ra"), F.col("n").alias("na")), reps.select(F.col("doc_id").alias("b"), F.col("rep").alias("rb"), F.col("n").alias("nb"))
    fits = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * join.percent) & (F.col("ra") != F.col("rb"))
    stars = kept(met.where("doc <> head").select(F.col("doc").alias("a"), F.col("head").alias("b")).distinct().join(a, "a").join(b, "b").where(fits)
                 .select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct(), "stars")
    C.release(spark)  # of pairs of documents that met, before texts are shuffled
    meeting = met.select("doc").distinct().join(reps.select(F.col("doc_id").alias("doc"), "rep"), "doc").select(F.col("rep").alias("doc_id")).distinct()
    # stored in buckets of the document, the sets are joined three times without being shuffled again
    named = f"sets_{uuid.uuid4().hex}"
    sets_of(known.join(meeting, "doc_id", "left_semi"), join).write.option("path", f"{at}/sets").bucketBy(
        int(spark.conf.get("spark.sql.shuffle.partitions")), "doc").saveAsTable(named)
    sets = spark.table(named)
    C.release(spark)
    def in_rounds(parts: int, work, name: str) -> DataFrame:
        """The parts of some work stored one after another, so that the shuffles of one are gone before the next."""
        for i in range(parts):
            work(i).write.mode("append").parquet(f"{at}/{name}")
            C.release(spark)
        return spark.read.parquet(f"{at}/{name}")

    room = 10 * (meeting.join(reps.groupBy(F.col("rep").alias("doc_id")).agg(F.min("n").alias("n")), "doc_id").agg(F.sum("n")).first()[0] or 0)
    bulk = stars.join(reps.select(F.col("doc_id").alias("a"), "n"), "a").agg(F.sum(F.least("n", F.lit(1 << 16)) * 2 + 32)).first()[0]
    parts = _rounds(bulk, room)
    links = in_rounds(parts, lambda i: _linked(stars.where(F.pmod(F.xxhash64("a", "b"), F.lit(parts)) == i), sets, join), "links")
    found = kept(components(links), "first")
    # what the heads left apart: sets that met in company under a key of several components
    wide = (met.where("total > 2").select("key", F.col("doc").alias("doc_id")).join(reps, "doc_id").select("key", "rep", "n").distinct()
            .join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")))
    wide = kept(wide, "wide")
    mixed = (wide.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.min("rep").alias("head"), F.count(F.lit(1)).alias("company"),
                                     ((F.count(F.lit(1)) - 1) * F.sum("n")).alias("cost"))
             .where("c0 <> c1 and company > 2").select("key", "head", "cost"))  # of two sets, one is the head's
    apart = kept(wide.join(mixed, "key").select("key", "rep", "head", "n", "component", "cost"), "apart")
    families = components(apart.select(F.col("rep").alias("a"), F.col("head").alias("b"))).select(F.col("node").alias("rep"), F.col("component").alias("family"))
    rest = kept(apart.select("rep", "n", "component").distinct().join(families, "rep"), "families")
    sparse = kept(_sparse(rest, apart), "sparse")
    few = None
    if not sparse.isEmpty():
        pairs = kept(_met_pairs(apart.join(rest.join(sparse, "family", "left_semi").select("rep"), "rep", "left_semi"), join).join(stars, ["a", "b"], "left_anti"), "pairs")
        C.release(spark)
        parts = _rounds(pairs.agg(F.sum(F.least("n", F.lit(1 << 16)) * 2 + 32)).first()[0], room)
        few = in_rounds(parts, lambda i: _linked(pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(parts)) == i).select("a", "b"), sets, join), "few")
        rest = rest.join(sparse, "family", "left_anti")
    members, tasks = _family_tasks(rest, join)
    members, tasks = kept(members, "members"), kept(tasks, "tasks")
    turns = _rounds(8 * (tasks.agg(F.sum("dealt")).first()[0] or 0), room)
    more = in_rounds(turns, lambda i: _linked_in_families(
        members, tasks.where(F.pmod(F.xxhash64("family", "block_x", "block_y"), F.lit(turns)) == i).drop("dealt"), sets, join), "more")
    spark.sql(f"DROP TABLE {named}")  # the name; an external table's files go next
    for spent in ("sets", "met", "wide", "apart", "members", "tasks"):
        C.drop(spark, f"{at}/{spent}")
    C.release(spark)
    bridged = found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)
    if few is not None:
        bridged = bridged.union(few)
    final = components(bridged)
    return (facts.join(final.withColumnRenamed("node", "rep"), "rep", "left")
            .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).alias("component_id")))


def without_near_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", join: Join = Join()) -> DataFrame:
    """One row of ``docs`` for each component of near copies.

    Every row counts for itself, also one without a doc_id or with that of another row. The row of smallest doc_id stays
    (missing ones come last; ties by hash of the text and of the other columns). Rows without words are near copies of none,
    but of those that share a doc_id one stays.
    """
    C.session(docs.sparkSession)
    plain = dict(docs.dtypes)[doc_id] in ("bigint", "int", "smallint", "tinyint")
    if plain and docs.groupBy(doc_id).count().where(F.col(doc_id).isNull() | (F.col("count") > 1)).isEmpty():
        named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))  # no second copy of the texts
        first = _components(named, join).where("doc_id = component_id").select(F.col("doc_id").cast(dict(docs.dtypes)[doc_id]).alias(doc_id))
        return docs.join(first, doc_id, "left_semi").select(*docs.columns)
    rows = C.stored(docs.withColumn("__row", F.monotonically_increasing_id()))
    groups = _components(rows.select(F.col("__row").alias("doc_id"), F.col(text).cast("string").alias("text")), join).select(F.col("doc_id").alias("__row"), "n_shingles", "component_id")
    order = F.struct(F.col(doc_id).isNull(), F.col(doc_id), F.xxhash64(text),
                     F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind]), F.col("__row").alias("__row"))
    first = (rows.select("__row", F.col(doc_id).alias("__key"), order.alias("__order")).join(groups, "__row")
             .groupBy(F.when(F.col("n_shingles") == 0, F.col("__key")).alias("__wordless"),
                      F.when((F.col("n_shingles") > 0) | F.col("__key").isNull(), F.col("component_id")).alias("__component"))
             .agg(F.min("__order").alias("__order")).select("__order.__row"))
    return rows.join(first, "__row", "left_semi").select(*docs.columns)
