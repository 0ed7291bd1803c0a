"""Kafka text sources and sinks (they need Spark's Kafka package on the class path)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

#: Topics and consumer group of the published set-up (fixed values).
TOPIC_R, TOPIC_S, TOPIC_RESULT, GROUP = "FirstInputTestTopicV1", "SecondInputTestTopicV1", "TestLatencyResultTopicV1", "test_group_1"
RESULT_PARTITIONS = 3


def source_options(servers: str, topic: str, group: str = GROUP, offsets: str = "latest") -> dict[str, str]:
    """offsets: 'latest', or 'earliest' to read a topic from its start."""
    if offsets not in ("latest", "earliest"):
        raise ValueError("offsets: 'latest' or 'earliest'")
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "kafka.group.id": group, "startingOffsets": offsets}


def read_text(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """The records of a topic as a stream of texts (column value)."""
    return spark.readStream.format("kafka").options(**source_options(servers, topic, **options)).load().selectExpr("cast(value as string) as value")


def write_text(lines: DataFrame, servers: str, checkpoint: str, topic: str = TOPIC_RESULT, partitions: int = RESULT_PARTITIONS) -> DataStreamWriter:
    """lines (value) to a topic, by as many writers as it has partitions."""
    return lines.select("value").coalesce(partitions).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint)
