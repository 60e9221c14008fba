"""Quality of whole texts: random-indexing word vectors pooled per document, then a two-layer network, calibrated."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from wirelens.llm import columns as C


@dataclass(frozen=True)
class Model:
    """Word vectors by bucket, scaling of the pooled features, and the two layers."""

    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, ...]
    temperature: float
    prior: float


def index_vectors(buckets: int, dim: int, ones: int, seed: int) -> np.ndarray:
    """Random sparse ternary index vectors: ``ones`` entries of +1 or -1 for each bucket."""
    rng = np.random.default_rng(seed)
    out = np.zeros((buckets, dim), np.float32)
    for _ in range(ones):
        out[np.arange(buckets), rng.integers(0, dim, buckets)] += rng.choice([-1.0, 1.0], buckets)
    return out


def context_vectors(texts: list[str], buckets: int, dim: int, window: int, seed: int) -> np.ndarray:
    """Sum of the index vectors of the words around each word, as unit vectors; unseen words keep their index vector."""
    index = index_vectors(buckets, dim, 6, seed)
    out = np.zeros((buckets, dim), np.float32)
    for text in texts:
        words, codes, _ = C.distinct_words(C.marked_words(pa.array([text], pa.string())))
        if not len(codes):
            continue
        line = C.word_buckets(words, buckets)[codes]
        sums = np.zeros((len(line), dim), np.float32)
        for d in range(1, window + 1):
            if len(line) > d:
                sums[:-d] += index[line[d:]]
                sums[d:] += index[line[:-d]]
        np.add.at(out, line, sums)
    out = np.where((out != 0).any(1)[:, None], out, index)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Per text: mean and root mean square of its word vectors, log word count, share of distinct words."""
    n, (buckets, dim) = len(texts), vectors.shape
    words, codes, rows = C.distinct_words(C.marked_words(texts))
    out = np.zeros((n, 2 * dim + 2))
    if not len(codes):
        return out
    at = C.word_buckets(words, buckets)
    pairs = np.unique(rows.astype(np.int64) * len(words) + codes, return_counts=True)
    row, word, times = pairs[0] // len(words), pairs[0] % len(words), pairs[1].astype(np.float32)
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    some, count = row[starts], np.add.reduceat(times, starts)[:, None]
    found = vectors[at[word]]
    out[some, :dim] = np.add.reduceat(found * times[:, None], starts) / count
    out[some, dim:2 * dim] = np.sqrt(np.add.reduceat(found * found * times[:, None], starts) / count)
    out[some, 2 * dim] = np.log1p(count[:, 0])
    out[some, 2 * dim + 1] = np.diff(np.r_[starts, len(row)]) / count[:, 0]
    return out


def _probability(x: np.ndarray, layers: tuple[np.ndarray, ...]) -> np.ndarray:
    w1, b1, w2, b2 = layers
    return np.tanh(x @ w1 + b1) @ w2 + b2


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "quality",
        rows: int = 4_000, max_chars: int = 20_000, buckets: int = 1 << 14, dim: int = 48, window: int = 2,
        hidden: int = 24, epochs: int = 60, seed: int = 11) -> Model:
    """Learn word vectors and network from a bounded sample: the ``rows`` labels first by hash.

    A fifth of the sample is held back to fit the temperature. Null labels or texts teach nothing. Several labels of a
    document all count. With fewer than two classes every score is the share of label 1 (one half without any label).
    """
    sample = C.labelled_sample(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")),
                               labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")),
                               rows=rows, max_chars=max_chars, seed=seed)
    texts, y = [r.text for r in sample], np.array([int(r.y == 1) for r in sample], np.int64)
    vectors = context_vectors(texts, buckets, dim, window, seed)
    empty = (np.zeros((2 * dim + 2, hidden)), np.zeros(hidden), np.zeros((hidden, 2)), np.zeros(2))
    if len(set(y.tolist())) < 2:
        return Model(vectors, np.zeros(2 * dim + 2), np.ones(2 * dim + 2), empty, 1.0, float(y.mean()) if len(y) else 0.5)
    x = np.concatenate([pooled(pa.array(texts[i:i + 64], pa.string()), vectors) for i in range(0, len(texts), 64)])
    mean, scale = x.mean(0), x.std(0) + 1e-6
    x = (x - mean) / scale
    held = len(y) // 5
    rng = np.random.default_rng(seed)
    layers = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden),
              rng.normal(0, hidden ** -0.5, (hidden, 2)), np.zeros(2)]
    first, second, turn = [np.zeros_like(a) for a in layers], [np.zeros_like(a) for a in layers], 0
    for _ in range(epochs):
        for at in np.array_split(held + rng.permutation(len(y) - held), max(1, (len(y) - held) // 64)):
            inner = np.tanh(x[at] @ layers[0] + layers[1])
            wrong = C.softmax(inner @ layers[2] + layers[3])
            wrong[np.arange(len(at)), y[at]] -= 1
            wrong /= len(at)
            back = (wrong @ layers[2].T) * (1 - inner ** 2)
            grads = [x[at].T @ back + 1e-3 * layers[0], back.sum(0), inner.T @ wrong + 1e-3 * layers[2], wrong.sum(0)]
            turn += 1
            for a, g, m, v in zip(layers, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                a -= 0.003 * (m / (1 - 0.9 ** turn)) / (np.sqrt(v / (1 - 0.999 ** turn)) + 1e-8)
    heat = C.temperature(_probability(x[:held], tuple(layers)), y[:held])
    return Model(vectors.astype(np.float32), mean, scale, tuple(layers), heat, float(y.mean()))


def score(docs: DataFrame, model: Model, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus score, the calibrated probability (0 to 1) of label 1, for every row.

    Whole texts count. A null text scores as the empty text does; equal texts score the same.
    """
    def task(batches):
        for part in C.slices(batches, "__text", C.SLICE_BYTES // 2):
            features = (pooled(C.filled(part.column("__text")), model.vectors) - model.mean) / model.scale
            if model.layers[0].any():
                value = C.softmax(_probability(features, model.layers) / model.temperature)[:, 1]
            else:
                value = np.full(part.num_rows, model.prior)
            columns = [part.column(i) for i, name in enumerate(part.schema.names) if name != "__text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(value)], schema=shape)

    out = StructType([*docs.select(*keep).schema.fields, StructField("score", DoubleType())])
    shape = to_arrow_schema(out)
    return docs.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(task, out)
