"""Documents from files, and JSON to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One document a line: (text, file)."""
    return spark.read.text(path).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One document a file: (text, file)."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"))


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """One document a file, as bytes that may be no UTF-8: (content, file, size)."""
    return spark.read.format("binaryFile").load(path).select("content", F.col("path").alias("file"), F.col("length").alias("size"))


def read_column(spark: SparkSession, path: str, column: str, *keep: str) -> DataFrame:
    """Documents in a column of Parquet; other columns than those named aren't read."""
    return spark.read.parquet(path).select(*keep, F.col(column).alias("text"))


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """A stream of files with one document a line."""
    return spark.readStream.text(path).select(F.col("value").alias("text"))


def write_lines(df: DataFrame, column: str, path: str, *, mode: str = "error") -> None:
    """One document a line.  A task's lines show only once it has ended well."""
    df.select(column).write.mode(mode).text(path)
