"""The numbered queries: each applies its operator to its whole table and returns its full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import tokenizer_alignment
from .bpe import bpe_round_trip
from .common import table
from .fingerprint import edited_report
from .html_wrapper import extract_main_text
from .langid import language_report
from .manifest import dataset_manifest
from .manifest import oracle as manifest_sql
from .media import media_features, text_media
from .mixing import ORACLE as MIX_SQL
from .mixing import mix_plan
from .ngram_join import ngram_components
from .packing import packed_digests, scratch_folder
from .recompression import ORACLE as REPEAT_SQL
from .recompression import kept_words
from .secret_scan import oracle as secret_sql
from .secret_scan import secret_report
from .wordpiece import token_counts


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(text_media(table(spark, sf_dir, "documents", "doc_id", "text")))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_report(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digests(table(spark, sf_dir, "documents", "doc_id", "text"), scratch_folder(spark, "ids"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents", "doc_id", "text"))


#: The name under which the report of what redaction takes was registered before it was op3_secrets itself.
op3_secrets_all = op3_secrets


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents", "doc_id", "text")).drop("set_key")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer_alignment(table(spark, sf_dir, "documents", "doc_id", "text"))


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_words(table(spark, sf_dir, "documents", "doc_id", "text"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset_manifest(table(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name.startswith("op")}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": MIX_SQL, "op3_secrets": secret_sql(), "op3_secrets_all": secret_sql(), "op12_repeats": REPEAT_SQL, "op13_manifest": manifest_sql()}
