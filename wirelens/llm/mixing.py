"""Mix documents to target weights of soft domains: posteriors from labels, rates from projected gradients."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from wirelens.llm import columns as C
from wirelens.session import fresh_path


@dataclass(frozen=True)
class Model:
    """A linear softmax over which word buckets occur in a text."""

    domains: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def _present(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs of a text column, by row, and the words of each row."""
    words, codes, rows = C.distinct_words(C.marked_words(texts))
    count = np.bincount(rows, minlength=len(texts)) if len(codes) else np.zeros(len(texts), np.int64)
    at = C.word_buckets(words, buckets)
    pairs = np.unique(rows.astype(np.int64) * buckets + at[codes]) if len(codes) else np.zeros(0, np.int64)
    return pairs // buckets, pairs % buckets, count


def fit(docs: DataFrame, labelled: DataFrame, *, text: str = "text", doc_id: str = "doc_id", domain: str = "domain",
        rows: int = 6_000, max_chars: int = 20_000, buckets: int = 1 << 16, least: int = 3, epochs: int = 6,
        rate: float = 0.1, seed: int = 5) -> Model:
    """Learn domains from a bounded sample: the ``rows`` labels first by hash, texts of ``max_chars`` at most.

    Only buckets that ``least`` sample texts have get a weight. Null domains or texts teach nothing; without labels
    the model has no domain. A fifth of the sample fits the temperature.
    """
    sample = C.labelled_sample(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")),
                               labelled.select(F.col(doc_id).alias("doc_id"), F.col(domain).alias("y")),
                               rows=rows, max_chars=max_chars, seed=seed)
    domains = tuple(sorted({r.y for r in sample}))
    k = len(domains)
    weights, bias = np.zeros((buckets, k)), np.zeros(k)
    if not k:
        return Model((), weights, bias, 1.0)
    y = np.array([domains.index(r.y) for r in sample])
    sets = []
    for i in range(0, len(sample), 64):
        part = pa.array([r.text for r in sample[i:i + 64]], pa.string())
        row, bucket, _ = _present(part, buckets)
        sets += np.split(bucket, np.searchsorted(row, np.arange(1, len(part))))
    texts_with = np.bincount(np.concatenate(sets), minlength=buckets)
    sets = [s[texts_with[s] >= least] for s in sets]
    held, rng, seen = len(y) // 5, np.random.default_rng(seed), np.full((buckets, k), 1e-6)
    for _ in range(epochs):
        for i in held + rng.permutation(len(y) - held):
            at = sets[i]
            wrong = C.softmax((weights[at].sum(0) + bias)[None])[0]
            wrong[y[i]] -= 1
            seen[at] += wrong ** 2
            weights[at] -= rate * wrong / np.sqrt(seen[at])
            bias -= rate * 0.1 * wrong
    logits = np.array([weights[s].sum(0) + bias for s in sets[:held]]).reshape(-1, k)
    return Model(domains, weights.astype(np.float32), bias, C.temperature(logits, y[:held]))


def posteriors(docs: DataFrame, model: Model, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus n_tokens (words and marks of the whole text) and posterior (a probability per domain).

    A null text counts as empty: no tokens, and the posterior of a text without words.
    """
    k, buckets = len(model.domains), len(model.weights)

    def task(batches):
        for part in C.slices(batches, given):
            row, bucket, count = _present(C.filled(part.column(given)), buckets)
            logits = np.stack([np.bincount(row, model.weights[bucket, j], part.num_rows) for j in range(k)], 1) + model.bias
            sure = C.softmax(logits / model.temperature)
            columns = [part.column(i) for i, name in enumerate(part.schema.names) if name != "__text"]
            lists = pa.ListArray.from_arrays(np.arange(part.num_rows + 1, dtype=np.int32) * k, sure.ravel())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(count.astype(np.int64)), lists.cast(shape[-1].type)], schema=shape)

    out = StructType([*docs.select(*keep).schema.fields, StructField("n_tokens", LongType()),
                      StructField("posterior", ArrayType(DoubleType()))])
    shape = to_arrow_schema(out)
    inputs, given = C.with_text(docs, keep, text)
    return inputs.mapInArrow(C.lean(task), out)


def rates_from(posterior: np.ndarray, path: list[np.ndarray], floor: int | None = None) -> np.ndarray:
    """Rates after the steps so far, replayed from their directions: a row's rate depends on its posterior alone.

    Each step moves along the row's own gradient, weighted by its tokens, and projects to zero or more; rows whose
    likeliest domain is number ``floor`` are projected to one or more.
    """
    rate = np.ones(len(posterior))
    least = _least(posterior, floor)
    for direction in path:
        rate = np.maximum(least, rate - posterior @ direction)
    return rate


def _least(posterior: np.ndarray, floor: int | None) -> np.ndarray:
    """Lowest rate of each row: 1 where the likeliest domain is number ``floor``, else 0."""
    return (posterior.argmax(1) == floor).astype(float) if floor is not None and len(posterior) else np.zeros(len(posterior))


def _matrix(column, k: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(-1, k)


def fit_rates(table: DataFrame, targets: np.ndarray, *, floor: int | None = None, steps: int = 60,
              tolerance: float = 1e-4) -> list[np.ndarray]:
    """Projected gradient for ``min |sum(rate * n_tokens * posterior) - targets|^2`` with rates of zero or more.

    ``table`` has n_tokens and posterior; ``targets`` are tokens per domain. Every step is one pass that sends the
    driver a few numbers per task. Steps use the metric of the token-weighted Gram matrix of the rows whose rate is free
    to fall (few steps even for rare domains); once that gains nothing more they are plain gradients, which also settle targets that
    cannot be met. Returns the directions, from which any task can replay its rates.
    """
    k = len(targets)
    total = float(table.agg(F.sum("n_tokens")).first()[0] or 0)
    if not total:
        return []

    def task(path):
        def sums(batches):
            got, gram = np.zeros(k), np.zeros((k, k))
            for part in batches:
                p = _matrix(part.column("posterior"), k)
                n = part.column("n_tokens").to_numpy(zero_copy_only=False) / total
                rate = rates_from(p, path, floor)
                got += (rate * n) @ p
                gram += (p * (n * (rate > _least(p, floor)))[:, None]).T @ p
            yield pa.RecordBatch.from_arrays([pa.array([got.tolist()], pa.list_(pa.float64())),
                                              pa.array([gram.ravel().tolist()], pa.list_(pa.float64()))], names=["got", "gram"])
        return sums

    want = np.asarray(targets, float) / total
    path: list[np.ndarray] = []
    best, best_path, stale, plain = np.inf, [], 0, False
    for _ in range(steps):
        parts = table.select("n_tokens", "posterior").mapInArrow(task(path), "got array<double>, gram array<double>").collect()
        residual = np.sum([r.got for r in parts], axis=0) - want
        gram = np.sum([r.gram for r in parts], axis=0).reshape(k, k)
        off = float(np.linalg.norm(residual))
        stale = 0 if off < 0.99 * best else stale + 1
        if off < best:
            best, best_path = off, list(path)
        if np.abs(residual).max() <= tolerance or (stale >= 3 and plain):
            break
        if stale >= 3:
            plain, stale, path = True, 0, list(best_path)
            continue
        step = residual / np.linalg.eigvalsh(gram)[-1] if plain else np.linalg.solve(gram + 1e-7 * np.eye(k), residual)
        path = [*path, step]
    return best_path


def with_rates(table: DataFrame, path: list[np.ndarray], k: int, floor: int | None = None) -> DataFrame:
    """All columns of ``table`` plus rate."""
    def task(batches):
        for part in batches:
            rate = rates_from(_matrix(part.column("posterior"), k), path, floor)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rate)], schema=shape)

    out = StructType([*table.schema.fields, StructField("rate", DoubleType())])
    shape = to_arrow_schema(out)
    return table.mapInArrow(task, out)


def mix(docs: DataFrame, model: Model, weights: Mapping[str, float], *, text: str = "text", doc_id: str = "doc_id",
        keep: tuple[str, ...] = (), whole: str | None = None, seed: int = 3) -> DataFrame:
    """One row per document: doc_id, ``keep`` columns, n_tokens, posterior (by sorted domain), rate and copies.

    ``weights`` are the wanted token shares of the domains (others 0), of as many tokens as there are now. ``copies``
    is the rate rounded up or down by a hash of the key, so that its expectation is the rate. Without labelled domains
    or tokens every rate is 1. Rows that repeat a key are rated like any other row. With ``whole``, rows whose likeliest
    domain that is are never rated below 1: the mix repeats them, but loses none.
    """
    k = len(model.domains)
    spark = docs.sparkSession
    if not k:
        plain = docs.select(F.col(doc_id).alias("doc_id"), *keep, F.lit(0).cast("long").alias("n_tokens"),
                            F.array().cast("array<double>").alias("posterior"), F.lit(1.0).alias("rate"))
        return plain.withColumn("copies", F.lit(1).cast("long"))
    floor = model.domains.index(whole) if whole in model.domains else None
    at = fresh_path(spark, "posteriors")
    inputs = docs.select(F.col(doc_id).alias("doc_id"), *keep, *([] if text in keep else [F.col(text).alias("__whole")]))
    posteriors(inputs, model, text=text if text in keep else "__whole", keep=("doc_id", *keep)).write.parquet(at)
    table = spark.read.parquet(at)
    share = np.array([float(weights.get(name, 0.0)) for name in model.domains])
    total = float(table.agg(F.sum("n_tokens")).first()[0] or 0)
    rated = with_rates(table, fit_rates(table, share / max(share.sum(), 1e-12) * total, floor=floor), k, floor)
    uniform = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return rated.withColumn("copies", F.floor(F.col("rate") + F.coalesce(uniform, F.lit(0.5))).cast("long"))
