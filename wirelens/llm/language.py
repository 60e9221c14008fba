"""Language of whole texts: averaged hashed subword embeddings, a linear softmax, calibrated rejection."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from wirelens.llm import columns as C

UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    """``table`` holds, per subword bucket, its embedding times the softmax weights: averages and products commute.

    ``fit`` holds, per bucket and language, how usual the bucket is in that language (log probability, less the usual
    mean of a text); a text is rejected if its confidence or its mean fit for the language found is too low.
    """

    languages: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float
    fit: np.ndarray
    misfit_below: float


def subwords(words: pa.Array, buckets: int, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams of ``<word>`` for each word, word by word, and how many each word has."""
    data, offsets = C.raw(pc.binary_join_element_wise("<", words, ">", ""))
    lengths = np.diff(offsets)
    word = np.repeat(np.arange(len(lengths)), lengths)
    left = np.repeat(offsets[1:], lengths) - np.arange(len(data))  # bytes to the end of the word
    letters = C.mixed(np.arange(256, dtype=np.uint64) + np.uint64(77))
    found, owner, rolled = [], [], np.zeros(len(data), np.uint64)
    for n in range(1, max(sizes) + 1):
        step = letters[data[n - 1:]] if n > 1 else letters[data]
        rolled[:len(step)] = rolled[:len(step)] * np.uint64(0x100000001B3) + step
        if n in sizes:
            fits = left >= n
            found.append((C.mixed(rolled[fits] + np.uint64(n)) & np.uint64(buckets - 1)).astype(np.int64))
            owner.append(word[fits])
    found, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return found[order], np.bincount(owner, minlength=len(lengths))


def _examples(texts: list[str], buckets: int, sizes: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text with their share of its subwords."""
    out = []
    for text in texts:
        words, codes, _ = C.distinct_words(C.letter_words(pa.array([text], pa.string())))
        if not len(codes):
            out.append((np.zeros(0, np.int64), np.zeros(0, np.float32)))
            continue
        found, many = subwords(words, buckets, sizes)
        weight = np.repeat(np.bincount(codes, minlength=len(words)), many)
        distinct, place = np.unique(found, return_inverse=True)
        share = np.bincount(place, weight)
        out.append((distinct, (share / share.sum()).astype(np.float32)))
    return out


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = 500, most: int = 400,
        max_chars: int = 12_000, buckets: int = 1 << 15, dim: int = 16, sizes: tuple[int, ...] = (2, 3, 4),
        epochs: int = 4, least_steps: int = 6_000, rate: float = 0.5, seed: int = 7, wrongly_rejected: float = 0.005) -> Model:
    """Train on a bounded sample: of each language the ``per_language`` rows first by hash, of ``max_chars`` at most.

    The sample is meant for ``most`` languages at most; of more, rows of the later ones by hash are left out of it.

    Rows without language, doc_id or letters teach nothing; of rows that share doc_id and language as many as there are
    chosen keys count in all. A fifth of the sample is held back to fit the temperature and the
    two rejection levels: of its correctly labelled texts the share ``wrongly_rejected`` is below the level of confidence,
    and as many below the level of fit. A softmax over the learned languages is sure of a text in none of them too; the
    fit, how usual the subwords of the text are in the language found, is not.
    Without labelled rows the model knows no language and answers ``und`` everywhere.
    """
    order = Window.partitionBy("lang").orderBy("turn", "doc_id")
    rows = (docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(doc_id, F.lit(seed)).alias("turn"))
            .where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= max_chars)))
    first = (rows.select("doc_id", "lang", "turn").withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_language)
             .select("doc_id", "lang", "place").distinct())  # texts join only the few chosen keys
    rows = (rows.join(F.broadcast(first.orderBy("place", "lang").limit(per_language * most)), ["doc_id", "lang"]).orderBy("place", "lang", "text")
            .limit(per_language * most).select("text", "lang").collect())
    languages = tuple(sorted({r.lang for r in rows}))
    number = {name: i for i, name in enumerate(languages)}
    pairs = [(x, number[r.lang]) for x, r in zip(_examples([r.text for r in rows], buckets, sizes), rows) if len(x[0])]
    if not pairs:
        return Model((), np.zeros((buckets, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0, np.zeros((buckets, 0), np.float32), 0.0)
    rng, k = np.random.default_rng(seed), len(languages)
    held = pairs[:len(pairs) // 5]
    learn = pairs[len(held):]
    embedding = rng.normal(0, 0.1, (buckets, dim)).astype(np.float32)
    weights, bias = np.zeros((dim, k), np.float32), np.zeros(k, np.float32)
    epochs = max(epochs, -(-least_steps // max(1, len(learn))))  # few texts are seen more often
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(learn)):
            (found, share), label = learn[i]
            hidden = share @ embedding[found]
            wrong = C.softmax((hidden @ weights + bias)[None])[0]
            wrong[label] -= 1
            back = weights @ wrong
            weights -= step * np.outer(hidden, wrong).astype(np.float32)
            bias -= step * wrong
            embedding[found] -= (step * 40) * share[:, None] * back[None]  # shares are small: a larger step for the many rows
    table = embedding @ weights
    logits = np.array([share @ table[found] + bias for (found, share), _ in held], np.float64).reshape(-1, k)
    labels = np.array([label for _, label in held], np.int64)
    heat = C.temperature(logits, labels)
    usual = np.full((buckets, k), 1 / buckets)
    for (found, share), label in learn:
        usual[found, label] += share  # one text of even subwords stands for those never seen
    usual = np.log(usual / usual.sum(0))
    level = misfit = -np.inf
    if len(labels):
        sure = C.softmax(logits / heat)
        right = sure.argmax(1) == labels
        mean = np.array([share @ usual[found, label] for (found, share), label in held])
        middle = np.full(k, np.median(mean))
        for label in set(labels[right].tolist()):  # languages differ in how even their subwords are
            middle[label] = np.median(mean[right & (labels == label)])
        usual, mean = usual - middle, mean - middle[labels]
        if right.any():
            level, misfit = np.quantile(sure.max(1)[right], wrongly_rejected), np.quantile(mean[right], wrongly_rejected)
    return Model(languages, table, bias, heat, float(level), usual.astype(np.float32), float(misfit))


def predict(docs: DataFrame, model: Model, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
            sizes: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """``keep`` columns plus lang_pred, score (calibrated probability, 0 to 1) and rejected, for every row.

    Whole texts count. A null text or one without a letter (combining marks alone are none) gives ``und``, score 0.0 and rejected; so does every text
    when the model knows no language. Equal texts get equal answers.
    """
    buckets = len(model.table)

    def task(batches):
        for part in C.slices(batches, given):
            n = part.num_rows
            texts = C.filled(part.column(given))
            words, codes, rows = C.distinct_words(C.letter_words(texts))
            names, score, fits = np.full(n, UNKNOWN, object), np.zeros(n), np.zeros(n)
            if len(codes) and model.languages:
                found, many = subwords(words, buckets, sizes)
                starts = np.cumsum(many) - many
                per_word = np.add.reduceat(model.table[found].astype(np.float64), starts)
                total = np.stack([np.bincount(rows, per_word[codes, j], n) for j in range(len(model.languages))], 1)
                count = np.bincount(rows, many[codes], n)
                known = (count > 0) & pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
                sure = C.softmax((total[known] / count[known, None] + model.bias) / model.temperature)
                names[known] = np.array(model.languages, object)[sure.argmax(1)]
                score[known] = sure.max(1)
                per_word = np.add.reduceat(model.fit[found].astype(np.float64), starts)
                usual = np.stack([np.bincount(rows, per_word[codes, j], n) for j in range(len(model.languages))], 1)
                fits[known] = usual[known, sure.argmax(1)] / count[known]
            rejected = (names == UNKNOWN) | (score < model.reject_below) | (fits < model.misfit_below)
            columns = [part.column(i) for i, name in enumerate(part.schema.names) if name != "__text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names.tolist(), pa.string()), pa.array(score),
                                              pa.array(rejected)], schema=shape)

    inputs, given = C.with_text(docs, keep, text)
    out = StructType([*docs.select(*keep).schema.fields, StructField("lang_pred", StringType()),
                      StructField("score", DoubleType()), StructField("rejected", BooleanType())])
    shape = to_arrow_schema(out)
    return inputs.mapInArrow(C.lean(task), out)


def accepted(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns (also such as are named like a result), that the model does not reject."""
    names = [f"__{i}" for i in range(len(docs.columns))]  # apart from the names of the results
    judged = predict(docs.toDF(*names), model, text=names[docs.columns.index(text)], keep=tuple(names))
    return judged.where(~F.col("rejected")).select(*names).toDF(*docs.columns)
