"""Readers: the Parquet tables, and bytes of files with a limit of size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 14_680_064


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_bytes(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """path, length, body (base64, null beyond the limit) and error of binary files."""
    files = spark.read.format("binaryFile").load(path)
    error = F.when(F.col("length") == 0, "empty").when(F.col("length") > most, "too large")
    return files.select("path", "length", F.when(error.isNull(), F.base64("content")).alias("body"), error.alias("error"))


SMALL = 1 << 30  # bytes


def spread(df: DataFrame) -> DataFrame:
    """A small table dealt to all cores: its file may be one row group, which one task reads. Larger ones, whose texts
    shouldn't be shuffled for that, stay as they are."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SMALL else df
