"""One query per operator over its whole table, with the parameters meant for production."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelens.llm import columns as C
from wirelens.llm import chat_format, fingerprints, html_text, jaccard_join, language, licences, mixing, negatives, pieces, quality, suffix_dedup, top_k, whitening


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return C.session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: four-word shingles, similarity of 0.85."""
    return jaccard_join.near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the three quarters that are not held out."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = C.held_out(F.col("doc_id"))
    model = language.fit(docs.where(~out))
    return language.predict(docs, model).withColumn("held_out", out)


#: Wanted shares of tokens: mostly clean text, with a little of the rest kept in view.
TARGETS = {"clean": 0.90, "poor": 0.08, "toxic": 0.02}


def domains(labels: DataFrame) -> DataFrame:
    """Domain of each labelled document: toxic, poor (quality 0) or clean."""
    name = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", name.alias("domain"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates at which documents enter a mix whose expected domain tokens match TARGETS."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = mixing.fit(docs, domains(_read(spark, sf_dir, "labels")))
    return mixing.mix(docs, model, TARGETS)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated quality of every document, learned from labels that are not held out."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = C.held_out(F.col("doc_id"))
    model = quality.fit(docs.where(~out), _read(spark, sf_dir, "labels").where(~out))
    return (quality.score(docs, model).withColumn("held_out", out)
            .withColumn("predicted", (F.col("score") >= 0.7).cast("int")))


#: Model file of the public tokenizers on this machine; any store that Spark reads will do.
PIECE_MODEL = "file:///opt/tokenizers/piece_bpe_32k.model"


def encoded(docs: DataFrame, path: str = PIECE_MODEL) -> DataFrame:
    """Pieces of every text, their number, and whether decoding them gives the text back."""
    model = pieces.read_model(docs.sparkSession, path)
    digest = F.sha2(F.translate(F.coalesce("text", F.lit("")), pieces.MARK, " "), 256)  # texts go to the tasks, but not back
    back = pieces.encode(docs.select("doc_id", "text", digest.alias("__digest")), model, keep=("doc_id", "__digest"), back=True)
    same = F.sha2("decoded", 256) == F.col("__digest")
    return back.select("doc_id", "pieces", F.size("pieces").alias("n_pieces"), same.alias("round_trip"))


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document."""
    return encoded(_read(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that passages of 200 bytes repeat, and what is left of it."""
    return suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(_read(spark, sf_dir, "pages"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest inner products of every hundredth vector among all others."""
    return top_k.search(_read(spark, sf_dir, "embeddings"), lambda key: key % 100 == 0)


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that every document names or quotes."""
    return licences.scan(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, with their likeness."""
    return fingerprints.against_edits(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, against its five best rows of the same label."""
    return negatives.mine(negatives.anchored(_read(spark, sf_dir, "embeddings")), lambda key: key % 100 == 0)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the first sixteen principal components, scaled to unit variance."""
    return whitening.whiten(whitening.grid(_read(spark, sf_dir, "embeddings")), components=16)


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that quotes control strings, formatted, and read back from what was written."""
    turns = chat_format.with_example(_read(spark, sf_dir, "conversations"))
    return chat_format.digests(C.stored(chat_format.formatted(turns)))


QUERIES = {
    "op1_pieces": op1_pieces,
    "op2_mixing": op2_mixing,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_language": op4_language,
    "op5_quality": op5_quality,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_html_text": op7_html_text,
    "op8_top_k": op8_top_k,
    "op9_licences": op9_licences,
    "op10_fingerprints": op10_fingerprints,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_whitening": op12_whitening,
    "op13_chat_format": op13_chat_format,
}
ORACLES = {
    "op9_licences": licences.oracle("documents"),
    "op11_hard_negatives": negatives.ORACLE,
    "op13_chat_format": chat_format.ORACLE,
}
