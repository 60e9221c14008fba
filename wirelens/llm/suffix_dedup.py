"""Repeated passages by column-wise construction of a multi-document Burrows-Wheeler order.

Two equal passages of SPAN bytes have the same smallest k-gram at the same place. Texts are therefore cut into windows
around such anchors, and only windows with one anchor are compared. Their strings are laid out with the anchor in one
column. From the last column to the first, every round inserts one symbol per string: the order of the suffixes (the
transform) is updated by a stable sort on the new symbols, the common prefixes of neighbours by range minima. A start
whose suffix shares SPAN symbols with a neighbour is a repeated passage. As equal passages stand in the same column,
one column of the order is enough at a time. Blocks of strings are read from the shuffle one after another; no round
needs more than its block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from wirelens.llm import columns as C
from wirelens.session import fresh_path

SPAN, GRAM = 200, 24
#: Strings of one block; a block is cut only between anchors.
BLOCK_STRINGS = 20_000
#: Anchors with more strings than this are decided by fingerprints of every passage instead, dealt by fingerprint.
HOT_STRINGS = 50_000
#: Windows that a task gathers before it writes them out.
CHUNK_WINDOWS = 400_000
MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int, seed: int) -> np.ndarray:
    """Polynomial hash of byte spans that may overlap, by differences of prefix sums."""
    letters = C.mixed(np.arange(256, dtype=np.uint64) + np.uint64(seed))
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(letters[data] * _powers(base, len(data)), dtype=np.uint64)]
    back = _powers(pow(base, -1, 1 << 64), len(data) + 1)
    return C.mixed((sums[ends] - sums[starts]) * back[starts])


def _gram_hash(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place, by doubling."""
    base = 0x9E3779B97F4A7C15
    level, width, power = C.mixed(np.arange(256, dtype=np.uint64) + np.uint64(5))[data], 1, base
    parts, got = [], 0
    while True:
        if GRAM & width:
            parts.append((level, width, power))
        if width * 2 > GRAM:
            break
        level = level[:-width] * np.uint64(power) + level[width:]
        width, power = width * 2, power * power & MASK
    out = np.zeros(len(data) - GRAM + 1, np.uint64)
    for level, width, power in reversed(parts):
        out = out * np.uint64(power) + level[got:got + len(out)]
        got += width
    return C.mixed(out)


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the (last) smallest value of each run of ``width`` values, by doubling."""
    place, step = np.arange(len(values)), 1
    while True:
        shift = min(step, width - step)
        if shift <= 0:
            return place
        right = values[shift:] <= values[:-shift]
        values, place = np.where(right, values[shift:], values[:-shift]), np.where(right, place[shift:], place[:-shift])
        step += shift


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, first start, number of starts, anchor place, anchor hash and content digest of all windows of the rows."""
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if len(data) < SPAN:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    grams = _gram_hash(data)
    place = _smallest(grams, SPAN - GRAM + 1)
    inside = row_of[:len(place)] == row_of[SPAN - 1:]
    row_of = row_of[:len(place)]
    fresh = inside & np.r_[True, (place[1:] != place[:-1]) | ~inside[:-1]]
    starts = np.flatnonzero(fresh)
    stop = np.r_[np.flatnonzero(fresh | ~inside), len(place)]
    runs = stop[np.searchsorted(stop, starts, "right")] - starts
    digest = _span_hash(data, starts, starts + runs - 1 + SPAN, 0xD1342543DE82EF95, 17)
    row = row_of[starts]
    return row, starts - offsets[row], runs, place[starts] - offsets[row], grams[place[starts]], digest


def _pack(start: np.ndarray, left: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Start (up to 2^46), distance to the anchor and number of starts (below 2^8 each) in one number."""
    return start << 16 | left << 8 | (run - 1)


def _anchored(docs: DataFrame) -> DataFrame:
    """anchor, digest, doc, at (packed) and others (doc and at of further equal windows), gathered per chunk of a task."""
    def flush(parts):
        anchor, digest, doc, at = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((at, doc, digest, anchor))
        anchor, digest, doc, at = anchor[order], digest[order], doc[order], at[order]
        head = np.r_[True, (anchor[1:] != anchor[:-1]) | (digest[1:] != digest[:-1])]
        starts = np.flatnonzero(head)
        ends = 2 * np.cumsum(np.diff(np.r_[starts, len(anchor)]) - 1)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(np.stack([doc[~head], at[~head]], 1).ravel()))
        for i in range(0, len(starts), 20_000):
            s = starts[i:i + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(anchor[s].view(np.int64)), pa.array(digest[s].view(np.int64)), pa.array(doc[s]), pa.array(at[s]),
                                              lists.slice(i, 20_000)], names=["anchor", "digest", "doc", "at", "others"])

    def task(batches):
        parts, many = [], 0
        for part in C.slices(batches, "text"):
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            row, start, run, place, anchor, digest = windows(*C.raw(C.filled(part.column("text"))))
            parts.append((anchor, digest, ids[row], _pack(start, place - start, run)))
            many += len(row)
            if many >= CHUNK_WINDOWS:
                yield from flush(parts)
                parts, many = [], 0
        if many:
            yield from flush(parts)

    return docs.mapInArrow(C.lean(task), "anchor long, digest long, doc long, at long, others array<long>")


def repeated_starts(strings: list[bytes], left: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """String number and start (from its first) of every start whose SPAN bytes also start in another string.

    ``left`` is how far a string's anchor is from its start, ``run`` how many starts it has. Round by round, one column
    of symbols is inserted in front of all suffixes.
    """
    m, deepest = len(strings), int(left.max())
    sizes = np.array([len(s) for s in strings])
    column = deepest - left  # column of a string's first byte
    width = int((column + sizes).max())
    grid = np.zeros((width, m), np.uint8)
    flat = np.frombuffer(b"".join(strings), np.uint8)
    owner = np.repeat(np.arange(m), sizes)
    grid[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + column[owner], owner] = flat
    end = column + sizes
    order, common = np.arange(m), np.zeros(m, np.int64)  # common: shared symbols of a suffix and the one before it
    found_string, found_start = [], []
    for c in range(width - 1, -1, -1):
        symbol = grid[c, order].astype(np.int16)
        absent = c >= end[order]
        symbol[absent] = -1
        symbol[c < column[order]] = 300
        turn = np.argsort(symbol, kind="stable")
        turn = turn[:np.searchsorted(symbol[turn], 300)]
        if not len(turn):
            break
        mins = [common]  # range minima of the common prefixes, by doubling
        while (1 << len(mins)) <= len(common):
            half = 1 << (len(mins) - 1)
            mins.append(np.minimum(mins[-1][:-half], mins[-1][half:]))
        same = np.r_[False, symbol[turn[1:]] == symbol[turn[:-1]]] & (symbol[turn] >= 0)
        shared = np.zeros(len(turn), np.int64)
        a, b = turn[np.flatnonzero(same) - 1] + 1, turn[same] + 1  # minimum over [a, b)
        level = np.frexp((b - a).astype(float))[1] - 1
        got = np.zeros(len(a), np.int64)
        for k in np.unique(level):
            at = level == k
            got[at] = np.minimum(mins[k][a[at]], mins[k][b[at] - (1 << int(k))])
        shared[same] = got + 1
        order, common = order[turn], shared
        if c <= deepest:
            full = common >= SPAN
            hit = order[full | np.r_[full[1:], False]]
            start = c - column[hit]
            good = start < run[hit]
            found_string.append(hit[good])
            found_start.append(start[good])
    empty = np.zeros(0, np.int64)
    return np.concatenate([*found_string, empty]), np.concatenate([*found_start, empty])


def _strings(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """anchor, doc, at, content and hot of every wanted window, cut from the whole texts."""
    lists = wanted.groupBy("doc").agg(F.collect_list(F.struct("anchor", "at", "hot")).alias("w"))

    def task(batches):
        for part in C.slices(batches, "text"):
            ids, w = part.column("doc_id").to_numpy(zero_copy_only=False), part.column("w")
            data, offsets = C.raw(C.filled(part.column("text")))
            flat, rows = w.flatten(), pc.list_parent_indices(w).to_numpy(zero_copy_only=False)
            anchor, at, hot = (flat.field(i) for i in range(3))
            packed = at.to_numpy(zero_copy_only=False)
            starts = (packed >> 16) + offsets[rows]
            whole = data.tobytes()
            content = [whole[s:s + SPAN + r] for s, r in zip(starts.tolist(), (packed & 255).tolist())]
            for i in range(0, len(content), 4000):
                yield pa.RecordBatch.from_arrays([anchor.slice(i, 4000), pa.array(ids[rows[i:i + 4000]]), at.slice(i, 4000), pa.array(content[i:i + 4000], pa.binary()),
                                                  hot.slice(i, 4000)], names=["anchor", "doc", "at", "content", "hot"])

    return docs.join(lists, docs.doc_id == lists.doc).select("doc_id", "text", "w").mapInArrow(C.lean(task), "anchor long, doc long, at long, content binary, hot boolean")


def _ordered(strings: DataFrame) -> DataFrame:
    """doc, start, run of the repeated passages found by ordering the strings of each block of anchors."""
    def blocks(batches):
        held, many, last = [], 0, None
        for batch in batches:
            anchor = batch.column("anchor").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
            for a, b in zip(cuts, np.r_[cuts[1:], len(anchor)]):
                if many >= BLOCK_STRINGS and anchor[a] != last:
                    yield pa.Table.from_batches(held)
                    held, many = [], 0
                held.append(batch.slice(a, b - a))
                many, last = many + b - a, anchor[a]
        if many:
            yield pa.Table.from_batches(held)

    def task(batches):
        for block in blocks(batches):
            at = block.column("at").to_numpy()
            string, start = repeated_starts(block.column("content").to_pylist(), (at >> 8) & 255, (at & 255) + 1)
            order = np.lexsort((start, string))
            string, start = string[order], start[order]
            first = np.flatnonzero(np.r_[True, (string[1:] != string[:-1]) | (start[1:] != start[:-1] + 1)]) if len(string) else np.zeros(0, np.int64)
            run = np.diff(np.r_[first, len(string)])
            doc = block.column("doc").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(doc[string[first]]), pa.array((at >> 16)[string[first]] + start[first]), pa.array(run.astype(np.int64))],
                                             names=["doc", "start", "run"])

    return strings.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(C.lean(task), "doc long, start long, run long")


def _fingerprinted(strings: DataFrame) -> DataFrame:
    """The same for anchors of too many strings: passages meet by a 128-bit fingerprint, summed before the shuffle."""
    def task(batches):
        for batch in batches:
            data, offsets = C.raw(batch.column("content"))
            at, doc = batch.column("at").to_numpy(zero_copy_only=False), batch.column("doc").to_numpy(zero_copy_only=False)
            run = (at & 255) + 1
            which = np.repeat(np.arange(len(run)), run)
            step = np.arange(len(which)) - np.repeat(np.cumsum(run) - run, run)
            starts = offsets[which] + step
            yield pa.RecordBatch.from_arrays(
                [pa.array(_span_hash(data, starts, starts + SPAN, 0xD1342543DE82EF95, 23).view(np.int64)),
                 pa.array(_span_hash(data, starts, starts + SPAN, 0x2545F4914F6CDD1D, 29).view(np.int64)), pa.array(doc[which]), pa.array((at >> 16)[which] + step)],
                names=["f", "g", "doc", "start"])

    rows = strings.mapInArrow(C.lean(task), "f long, g long, doc long, start long")
    many = rows.groupBy("f", "g").count().where("count > 1").select("f", "g")
    return rows.join(many, ["f", "g"]).select("doc", "start", F.lit(1).cast("long").alias("run"))


def repeats(docs: DataFrame) -> DataFrame:
    """doc, start, run: the runs of starts, in bytes, at which a passage of SPAN bytes begins that begins elsewhere too.

    ``docs`` has doc_id (long, distinct, not null) and text.
    """
    spark = docs.sparkSession
    at = fresh_path(spark, "repeats")
    by_anchor, by_digest = Window.partitionBy("anchor"), Window.partitionBy("anchor", "digest").orderBy("doc", "at")
    whole = Window.partitionBy("anchor", "digest").orderBy("doc", "at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = (_anchored(docs).withColumn("least", F.min("digest").over(by_anchor)).withColumn("most", F.max("digest").over(by_anchor))
             .withColumn("rows", F.count(F.lit(1)).over(by_anchor)).where("rows > 1 or size(others) > 0")
             .withColumn("turn", F.row_number().over(by_digest)).withColumn("copies", F.sum(F.shiftright(F.size("others"), 1) + 1).over(whole)))
    found.select("anchor", "doc", "at", "others", "copies", (F.col("least") != F.col("most")).alias("open"), "turn", "rows").write.parquet(f"{at}/met")
    met = spark.read.parquet(f"{at}/met")
    every = F.concat(F.array(F.struct(F.col("doc"), F.col("at"))), F.transform(F.sequence(F.lit(0), F.shiftright(F.size("others"), 1) - 1), lambda i: F.struct(
        F.get("others", 2 * i).alias("doc"), F.get("others", 2 * i + 1).alias("at"))))
    every = F.when(F.size("others") == 0, F.array(F.struct(F.col("doc"), F.col("at")))).otherwise(every)
    sure = met.where("copies > 1").select(F.explode(every).alias("x")).select("x.doc", (F.shiftright("x.at", 16)).alias("start"),
                                                                             (F.col("x.at").bitwiseAND(F.lit(255)) + 1).alias("run"))
    wanted = met.where("open and turn = 1").select("doc", "anchor", "at", (F.col("rows") > HOT_STRINGS).alias("hot"))
    _strings(docs, wanted).write.parquet(f"{at}/strings")
    strings = spark.read.parquet(f"{at}/strings")
    return sure.unionByName(_ordered(strings.where("not hot"))).unionByName(_fingerprinted(strings.where("hot")))


def _covered(n: int, ranges: np.ndarray) -> tuple[np.ndarray, int]:
    """Whether each of ``n`` bytes is kept, and the number of maximal removed runs, from pairs of start and run."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, ranges[0::2], 1)
    np.add.at(edge, np.minimum(ranges[0::2] + ranges[1::2] - 1 + SPAN, n), -1)
    gone = np.cumsum(edge[:-1]) > 0
    return ~gone, int((gone & ~np.r_[False, gone[:-1]]).sum()) if n else 0


def remove_repeats(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep`` columns, n_bytes, n_removed, n_spans, kept_sha256 and kept (the text left), one row per document.

    Texts count as whole UTF-8 bytes (null: empty). A byte goes if a SPAN-byte string that covers it also starts
    anywhere else; strings are judged on the input. ``kept`` passes over characters that lost only some of their bytes.
    doc_id names a document: rows that share one are compared like any others, but lose what either of them loses; rows
    without one lose nothing.
    """
    C.session(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
                       *[F.col(c).alias(f"__{c}") for c in keep])
    lost = repeats(docs.select("doc_id", "text").where("doc_id is not null")).groupBy("doc").agg(F.flatten(F.collect_list(F.array("start", "run"))).alias("ranges"))

    def task(batches):
        for part in C.slices(batches, "text"):
            data, offsets = C.raw(C.filled(part.column("text")))
            lists = part.column("ranges")
            out = [[], [], [], [], []]
            for i in range(part.num_rows):
                raw = data[offsets[i]:offsets[i + 1]]
                ranges = lists[i].as_py()
                stays, spans = _covered(len(raw), np.array(ranges, np.int64)) if ranges else (None, 0)
                left = raw[stays].tobytes() if ranges else raw.tobytes()
                for column, value in zip(out, (len(raw), len(raw) - len(left), spans, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore"))):
                    column.append(value)
            own = [part.column(f"__{c}") for c in keep]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *own, *[pa.array(x, pa.int64()) for x in out[:3]], pa.array(out[3], pa.string()), pa.array(out[4], pa.string())],
                                             schema=shape)

    facts = [StructField("n_bytes", LongType()), StructField("n_removed", LongType()), StructField("n_spans", LongType()),
             StructField("kept_sha256", StringType()), StructField("kept", StringType())]
    kinds = docs.schema
    result = StructType([kinds["doc_id"], *[StructField(c, kinds[f"__{c}"].dataType) for c in keep], *facts])
    shape = to_arrow_schema(result)
    return (docs.join(lost, docs.doc_id == lost.doc, "left").select("doc_id", "text", "ranges", *[f"__{c}" for c in keep])
            .mapInArrow(C.lean(task), result))
