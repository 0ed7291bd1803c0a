"""The whole application: two text streams to joined rows, and their latency to a third.

    python -m bandweave.app --servers host:9092 --checkpoint path --rCopyNum 4 --sCopyNum 4 --R_surpass_S 0 --R_behind_S 0 [--print]
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bandweave.operators.routing import MatrixScheme
from bandweave.plans.spec import BandJoinSpec, parse_arguments
from bandweave.sources import kafka, records
from bandweave.streaming.band_join import report_latency, stream_band_join


def tuples(lines: DataFrame) -> DataFrame:
    """Records of a text stream (value), typed, with the time at which they were read."""
    return records.typed(records.parse_csv(lines)).withColumn("ingest_ms", records.now_ms())


def joined(r_lines: DataFrame, s_lines: DataFrame, spec: BandJoinSpec, strategy: str = "auto", cells: tuple[int, int] | None = None) -> DataFrame:
    """Joined rows of two text streams; ingest_ms is that of the later side, the probe."""
    out = stream_band_join(tuples(r_lines), tuples(s_lines), spec, strategy, cells)
    later = F.when(F.col("r_ts") > F.col("s_ts"), F.col("r.ingest_ms")).otherwise(F.col("s.ingest_ms"))
    return out.withColumn("ingest_ms", later)


def printed(rows: DataFrame, checkpoint: str) -> StreamingQuery:
    """Joined rows to the console, whole."""
    return rows.writeStream.format("console").option("truncate", False).option("checkpointLocation", checkpoint).start()


def to_topic(servers: str, topic: str = kafka.TOPIC_RESULT):
    """A sink for latency lines: a Kafka topic."""
    return lambda lines: lines.coalesce(kafka.RESULT_PARTITIONS).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def main(argv: Sequence[str]) -> None:
    parser = argparse.ArgumentParser(allow_abbrev=False)
    parser.add_argument("--servers", required=True)
    parser.add_argument("--checkpoint", required=True)
    parser.add_argument("--print", action="store_true")
    own, _ = parser.parse_known_args(argv)
    spec, r_copies, s_copies = parse_arguments(argv)
    spark = SparkSession.builder.appName("bandweave").config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider").getOrCreate()
    r, s = (kafka.read_text(spark, own.servers, t) for t in (kafka.TOPIC_R, kafka.TOPIC_S))
    rows = joined(r, s, spec, cells=MatrixScheme(r_copies=r_copies, s_copies=s_copies).cells())
    query = printed(rows, own.checkpoint) if own.print else report_latency(rows, "ingest_ms", to_topic(own.servers), own.checkpoint)
    query.awaitTermination()


if __name__ == "__main__":
    main(sys.argv[1:])
