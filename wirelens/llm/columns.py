"""Whole-column text helpers for Arrow tasks, and the session settings these tasks rely on."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from wirelens.session import drop, prepare, release, stored  # noqa: F401

#: Text bytes that a task turns into number arrays at once; a longer single text is taken alone.
SLICE_BYTES = 1 << 20
#: Rows of one Arrow batch; with SLICE_BYTES it bounds what a Python worker holds.
BATCH_ROWS = 512
#: Bytes of one Arrow batch (a longer single row is taken alone): text, buffers and results stay a few times as much.
BATCH_BYTES = 4 << 20
LETTER, WORD, OTHER = r"\p{L}\p{M}", r"\p{L}\p{M}\p{N}", r"[^\p{L}\p{M}\p{N}\s]"


def session(spark: SparkSession) -> SparkSession:
    """Session for text tasks: small Arrow batches, so that long texts never gather in one worker."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def held_out(doc_id: Column) -> Column:
    """Whether a row belongs to the quarter that no classifier may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, *, rows: int, max_chars: int, seed: int) -> list:
    """Rows of text and y: of the ``rows`` labels first by hash, those whose text is there and not over ``max_chars``.

    ``docs`` has doc_id and text, ``labels`` doc_id and y. Labels are chosen before any text is touched, so only that
    many texts move.
    """
    turn = F.xxhash64("doc_id", F.lit(seed))
    first = labels.where("y is not null and doc_id is not null").orderBy(turn, "doc_id", "y").limit(rows)
    return (docs.where(F.col("text").isNotNull() & (F.length("text") <= max_chars)).join(F.broadcast(first), "doc_id")
            .orderBy(turn, "doc_id", "text", "y").limit(rows).select("text", "y").collect())


def lean(task: Callable) -> Callable:
    """An Arrow task that gives freed memory back when it ends: idle workers stay alive beside those of the next stage."""
    def run(batches):
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim()

    return run


def trim() -> None:
    """Give free heap pages back to the system, where the C library can."""
    library = _libc()
    if library is not None:
        library.malloc_trim(0)


@lru_cache(maxsize=1)
def _libc():
    """The C library, where it can trim its heap."""
    if sys.platform != "linux":
        return None
    library = ctypes.CDLL(None)
    return library if hasattr(library, "malloc_trim") else None


def with_text(docs: DataFrame, keep: tuple[str, ...], text: str) -> tuple[DataFrame, str]:
    """The ``keep`` columns and, as a string, the text; and the name of the text's column. A kept text travels once."""
    if text in keep and docs.schema[text].dataType == StringType():
        return docs.select(*keep), text
    return docs.select(*keep, F.col(text).cast("string").alias("__text")), "__text"


def filled(column) -> pa.Array:
    """One string array without nulls: a null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows whose texts take about ``limit`` bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start, before = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start, before = stop, int(ends[stop - 1])


def raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array and the offsets of its rows, without copying."""
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset:array.offset + len(array) + 1].astype(np.int64)
    data = array.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (finaliser of the public splitmix64 generator)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hash of each byte span ``[start, end)``; spans are not empty, disjoint and ascending."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    before = np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = np.arange(total, dtype=np.int64) - before
    take = place + np.repeat(starts, lengths)
    base = np.uint64(0x9E3779B97F4A7C15 + 2 * seed)
    powers = np.ones(int(lengths.max()) + 1, np.uint64)
    powers[1:] = base
    powers = np.cumprod(powers, dtype=np.uint64)
    letters = mixed(np.arange(256, dtype=np.uint64) + np.uint64(seed * 1009 + 1))[data[take]]
    sums = np.add.reduceat(letters * powers[place], np.cumsum(lengths) - lengths)
    return mixed(sums + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def distinct_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Blank-separated words: distinct words, a code for each occurrence, and the row of each occurrence."""
    lists = pc.split_pattern(texts, " ")
    flat, rows = lists.flatten(), pc.list_parent_indices(lists)
    keep = pc.not_equal(flat, "")
    flat, rows = flat.filter(keep), rows.filter(keep)
    coded = pc.dictionary_encode(flat)
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), rows.to_numpy(zero_copy_only=False)


def letter_words(texts: pa.Array) -> pa.Array:
    """Lower-cased runs of letters, separated by one blank each."""
    return pc.replace_substring_regex(pc.utf8_lower(texts), f"[^{LETTER}]+", " ")


def marked_words(texts: pa.Array) -> pa.Array:
    """Words as written, with runs of marks such as ``!!`` or ``|`` set apart as words of their own."""
    apart = pc.replace_substring_regex(texts, f"({OTHER}+)", r" \1 ")
    return pc.replace_substring_regex(apart, r"\s+", " ")


def word_buckets(words: pa.Array, buckets: int, seed: int = 1) -> np.ndarray:
    """Bucket number of each (non-empty) word."""
    data, offsets = raw(words)
    return (spans_hash(data, offsets[:-1], offsets[1:], seed) & np.uint64(buckets - 1)).astype(np.int64)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """Temperature that makes held-back rows most likely (golden section on its logarithm, from -1 to 3).

    The lower end keeps a few separable rows from making every probability 0 or 1.
    """
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        return -float(np.log(softmax(logits / np.exp(t))[np.arange(len(labels)), labels] + 1e-12).mean())

    low, high, ratio = -1.0, 3.0, (5 ** 0.5 - 1) / 2
    for _ in range(50):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))
