"""The corpus pipeline: language identification, near-duplicate removal, secret redaction, source
mixing and tokenization. Each stage's result is written as Parquet in the cluster's shared folder and
reread as the next one's documents; every stage works on all rows that its predecessor kept.

Of every stage: an empty table gives an empty one of the same columns; columns beyond COLUMNS don't go
on, whatever their names; texts of any length are worked on whole; null and repeated ids, and null
sources and labels, are documents like any other. What null and empty texts, ties and repeated rows
become is said with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labtables.llm.bpe import bpe_round_trip
from labtables.llm.common import bounded_batches, released, table, written
from labtables.llm.langid import fit_language_model, predict_language
from labtables.llm.mixing import mix_documents
from labtables.llm.ngram_join import near_duplicates_removed
from labtables.llm.secret_scan import redact_secrets

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is undetermined (null, empty, no letters) or scored below the calibrated
    bound go; all others stay as they are, a score that ties with the bound included, and repeated rows
    all stay or all go. Without any label there is no model, so all documents go."""
    bounded_batches(spark)
    model = fit_language_model(docs)
    return predict_language(docs, model, keep=COLUMNS).filter(~F.col("rejected")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 or more on five-word shingles, the document
    of the smallest id stays (null last; of rows of one id by a hash of the text); of repeated rows one.
    Null and empty texts, and texts without words, link with nothing and stay."""
    bounded_batches(spark)
    return near_duplicates_removed(docs).select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced and n_chars follows (null for null texts). Equal
    texts become equal texts."""
    return redact_secrets(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, once or twice. Null and empty texts have no words
    and are not taken; repeated rows are queued one after another."""
    return mix_documents(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts; null is as the empty text, and repeated
    rows give equal rows."""
    bounded_batches(spark)
    return bpe_round_trip(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The language model and the merges have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of `sf_dir`: what bpe_round_trip returns for each copy of a document that
    the mix takes. Null and empty texts don't pass the first stage; repeated rows are one document after the
    second; an empty table gives no rows."""
    docs, read = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        released(*read)  # the disk holds two stages' documents at most
        read = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
