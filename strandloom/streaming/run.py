"""The same plans over streams. Every step is stateless per read, so output is append only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.model import Plan
from ..plans.run import fastq_records, segments


def read_stream(spark: SparkSession, folder: str, schema: str = "name string, seq string, qual string") -> DataFrame:
    """Reads that arrive as Parquet files in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def write_stream(reads: DataFrame, plan: Plan, path: str, checkpoint: str) -> StreamingQuery:
    """FASTQ records of a stream to text parts, exactly once."""
    return fastq_records(reads, plan).writeStream.format("text").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def observed(reads: DataFrame, plan: Plan, name: str = "counters") -> DataFrame:
    """Judged segments with counters observed on the way, for a StreamingQueryListener or an Observation."""
    passed = F.col("drop_reason").isNull()
    return segments(reads, plan).observe(name, F.count(F.lit(1)).alias("segments"), F.count_if(passed).alias("output_reads"), F.sum(F.when(passed, F.length("seq"))).alias("output_bases"))
