"""Messages as files, one message each, and tables of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_messages(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Whole files of any store that Spark reads: path, payload (bytes; parse_claims decodes them as Latin-1). Spark leaves out files without a byte."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", F.col("content").alias("payload"))


def read_scripts(spark: SparkSession, path: str, pattern: str = "*.xml") -> DataFrame:
    """XML files as text: path, payload."""
    return read_messages(spark, path, pattern).select("path", F.decode("payload", "UTF-8").alias("payload"))


def write_wire(messages: DataFrame, path: str, wire: str = "wire", key: str = "msg_id") -> None:
    """A table of emitted messages (Parquet): they may hold line breaks and control characters, which a text file would split."""
    messages.select(key, wire).write.mode("overwrite").parquet(path)
