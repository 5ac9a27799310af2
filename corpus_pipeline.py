"""Documents to tokens in five stages, each an operator of marlstone.llm over all that the one before kept.

Language identification drops documents without a language; near-duplicate groups keep one document;
documents with a benchmark item go; personal data is masked; the texts are encoded and decoded.  All
but the last stage return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import decontam, langid, pieces, pii, queries, simhash
from marlstone.scratch import cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text whose strongest language has a smaller share is in no language; a mixture of two passes.
LEAST_SHARE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are in no language: null texts, texts without letters, texts without a main language."""
    rows = docs.select(*COLUMNS)
    model = langid.train(rows.where(~langid.held_out(F.col("doc_id"))))
    judged = langid.identify(rows, model, carry=COLUMNS)
    return judged.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SHARE)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group."""
    return simhash.keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontam.without(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces spans of personal data by their kind; ``n_chars`` follows the text."""
    rows = docs.select(*COLUMNS)
    found = pii.find(rows, pii.train(rows), carry=COLUMNS)
    masked = F.when(F.col("text").isNotNull(), pii.masked(F.col("body"), F.concat("base", "added")))
    done = found.select("doc_id", masked.alias("text"), "lang", "source", "n_chars")
    return done.select("doc_id", "text", "lang", "source", F.coalesce(F.length("text").cast("long"), F.col("n_chars")).alias("n_chars"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``lang``, ``source``, ``n_tokens``, ``ids`` and ``decoded``, the text that the ids give back."""
    return pieces.encode(docs, queries.piece_model(), carry=("doc_id", "lang", "source"))


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("PII", mask_personal_data),
    ("SentencePiece encoding and decoding", encode_pieces),
]
#: SQL has no XXH64, no SentencePiece and no expectation-maximisation; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage keeps is written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, f"stage{i}")
    return docs
