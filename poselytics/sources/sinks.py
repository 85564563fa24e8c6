"""Session results as JSON messages, to files or a topic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

ISO_TIMESTAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def report_messages(reports: DataFrame) -> DataFrame:
    """``key`` (session) and ``value`` (JSON; ISO-8601 times, absent fields left out)."""
    return reports.select(
        F.col("session_uuid").alias("key"),
        F.to_json(F.struct("*"), {"timestampFormat": ISO_TIMESTAMP}).alias("value"),
    )


def write_messages(messages: DataFrame, path: str) -> None:
    messages.select("value").write.mode("append").text(path)


def write_kafka(messages: DataFrame, servers: str, topic: str) -> None:
    """Needs the Spark Kafka connector on the class path."""
    (
        messages.write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .save()
    )


def stream_kafka(messages: DataFrame, servers: str, topic: str, checkpoint: str) -> DataStreamWriter:
    """Needs the Spark Kafka connector on the class path."""
    return (
        messages.writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
    )
