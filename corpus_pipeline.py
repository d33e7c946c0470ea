"""A training corpus from ``documents``: quality, near-duplicates, repeated passages, secrets, packed sequences.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one before it kept. Its result is written as
Parquet and read again. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm import quality, secret_scan
from passagework.llm.minhash import near_duplicate_documents
from passagework.llm.packing import pack
from passagework.llm.queries import vocabulary
from passagework.llm.repeats import remove_repeats
from passagework.llm.shared import Scratch, read


def _measured(docs: DataFrame) -> DataFrame:
    """Text lengths as the texts are now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) \
        if "n_chars" in docs.columns else docs


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose quality score reaches 0.3; null and empty texts are scored as empty ones."""
    model = quality.train_quality(docs, read(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model)
    return scored.filter(F.col("score") >= quality.LEAST_SCORE).select("_row.*")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group (five-word shingles, similarity 0.8 or more).

    Rows that repeat an id are one document and stay or go together; rows with a null id stay.
    """
    gone = near_duplicate_documents(docs).filter(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; words of 13-word windows that an earlier document has are removed. A text may end up empty."""
    return _measured(remove_repeats(docs))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; found secrets are masked."""
    ratios = secret_scan.train_markov(secret_scan.labelled_samples(docs))
    return _measured(secret_scan.mask_secrets(docs, ratios))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all rows in sequences of at most 4096 tokens."""
    return pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", without_near_duplicates),
    ("repeated_passages", without_repeated_passages),
    ("secrets", without_secrets),
    ("packing", packed_sequences),
]

# tokenizers and trained models are beyond SQL; tests compare run() with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, scratch = read(spark, sf_dir, "documents"), Scratch(spark)
    for _, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return docs
