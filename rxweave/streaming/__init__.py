"""Structured Streaming: the readers need no shuffle and no state, so a stream of messages runs the plan of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rxweave.operators import claims, prescriptions


def claim_stream(messages: DataFrame, payload: str = "payload") -> DataFrame:
    """Parsed claims of a stream, append mode, no state."""
    return claims.parse_claims(messages, payload)


def disposition_counts(messages: DataFrame, time: str, window: str = "10 minutes", late: str = "30 minutes", payload: str = "payload") -> DataFrame:
    """Responses by event-time window and disposition; a message later than ``late`` is left out."""
    status = claims.with_response_status(claims.parse_claims(messages, payload)).where("status IS NOT NULL")
    counted = status.withWatermark(time, late).groupBy(F.window(time, window), "status.disposition").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "disposition", "n")


def correlate_streams(responses: DataFrame, requests: DataFrame, key: str, time: str, within: str = "1 hour", payload: str = "payload") -> DataFrame:
    """Responses with the request whose id they name, if it came at most ``within`` before; old state is dropped by watermark."""
    left = prescriptions.parse_scripts(responses, payload).select(F.col(key).alias("response_id"), F.col(time).alias("response_time"), F.col("correlatesTo").alias("to_id")).withWatermark("response_time", within)
    right = prescriptions.parse_scripts(requests, payload).select(F.col(key).alias("request_id"), F.col(time).alias("request_time"), F.col("header.messageId").alias("id")).withWatermark("request_time", within)
    near = F.expr(f"to_id = id AND response_time BETWEEN request_time AND request_time + INTERVAL {within}")
    return left.join(right, near).select("response_id", "request_id", "response_time", "request_time")


def read_message_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """A stream of whole files: path, payload (bytes), modificationTime."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("content").alias("payload"), "modificationTime")


def write_stream(parsed: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet until the input is used up."""
    return parsed.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
