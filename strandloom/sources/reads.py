"""Reads derived from the documents table: letters become bases and qualities by fixed maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Letter to base and letter to quality character.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
BASES = "ACGTACGTACGTACGTACGTACGTAC"
QUALITIES = "5?I+:B#D0FGH8CE<>1@A9=7;36"
READS_SQL = f"""reads as (
  select doc_id, 'doc' || doc_id as name, translate(s, '{LETTERS}', '{BASES}') as seq, translate(s, '{LETTERS}', '{QUALITIES}') as qual
  from (select doc_id, regexp_replace(lower(text), '[^a-z]', '', 'g') as s from documents))"""


SPREAD_BYTES = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores if its scan has fewer tasks than the session has cores, as for one small file.

    A large table has more splits than cores and stays as it is; so does a tiny one."""
    execution, cores = df._jdf.queryExecution(), df.sparkSession.sparkContext.defaultParallelism
    if int(execution.optimizedPlan().stats().sizeInBytes()) < SPREAD_BYTES or execution.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def doc_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, name, seq, qual (as text) of each document."""
    s = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select(
        "doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), F.translate(s, LETTERS, BASES).alias("seq"), F.translate(s, LETTERS, QUALITIES).alias("qual")
    )
