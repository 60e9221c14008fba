"""A corpus made ready for training: stages from raw documents to pieces, each a function of the rows before it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelens.llm import columns as C
from wirelens.llm import jaccard_join, language, mixing, queries, suffix_dedup
from wirelens.session import fresh_path

#: Columns that stages know by name.
KNOWN = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keeping_columns(stage: Stage) -> Stage:
    """The stage on documents with any further columns: they pass through, whatever their names."""
    @wraps(stage)
    def on_all(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        C.session(spark)
        apart = [c if c in KNOWN else f"__x{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*apart), sf_dir).select(*apart).toDF(*docs.columns)

    return on_all


@keeping_columns
def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents whose language the calibrated model rejects go."""
    model = language.fit(docs.where(~C.held_out(F.col("doc_id"))))
    return language.accepted(docs, model)


@keeping_columns
def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: one row of each group stays, the one of smallest doc_id."""
    return jaccard_join.without_near_copies(docs, join=NEAR)


@keeping_columns
def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: passages of 200 bytes that also begin elsewhere leave every text; n_chars follows."""
    left = suffix_dedup.remove_repeats(docs, keep=tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars")))
    return left.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("kept").cast("long"))


@keeping_columns
def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: every document enters as often as its fitted rate says; likely clean ones once at least.

    The copies of a document share its doc_id, and rows of one doc_id round their rates alike.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = mixing.fit(docs, queries.domains(labels))
    rated = mixing.mix(docs, model, queries.TARGETS, keep=tuple(c for c in docs.columns if c != "doc_id"), whole="clean")
    return rated.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every remaining text."""
    C.session(spark)
    return queries.encoded(docs)


#: Near copies share at least 0.8 of their five-word shingles.
NEAR = jaccard_join.Join(width=5, percent=80)
STAGES = [
    ("language", keep_known_language),
    ("near_copies", one_of_near_copies),
    ("repeats", without_repeats),
    ("mixing", mix_domains),
    ("pieces", encode_pieces),
]
#: No SQL can train the classifiers or find the paths of the first, fourth and fifth stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        at = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        C.release(spark)
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
