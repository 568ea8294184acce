"""Queries and DuckDB SQL of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.reads import spread
from . import decontaminate, exact, licenses, lm, mixing, quality, repeats, secrets, simhash, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.removals(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return quality.scored(documents, quality.train(documents, _table(spark, sf_dir, "labels")))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(_table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(lm.train(_table(spark, sf_dir, "documents")))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return mixing.mixed(documents).select("doc_id", "source", "block", "slot", "position")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup_table(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontaminate.digest_columns(report)


QUERIES = {f.__name__: f for f in (op1_secrets, op2_licenses, op3_substring_dedup, op4_quality, op5_simhash, op6_lm_scoring, op7_url_filter, op8_mixing, op9_exact_dedup, op10_decontamination)}
ORACLES = {"op2_licenses": licenses.ORACLE, "op3_substring_dedup": repeats.ORACLE, "op7_url_filter": urls.ORACLE, "op9_exact_dedup": exact.ORACLE}
