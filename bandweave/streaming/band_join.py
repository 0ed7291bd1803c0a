"""The windowed band join as a stream-stream join.

Structured Streaming wants an equality between the sides, so the streams carry the bucket keys of the batch
strategies; watermarks and the time condition let Spark drop state that no later row can match. Rows older than the
watermark are dropped (a larger delay keeps more of them). Every pair is emitted once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bandweave.operators.band_join import band_condition, keyed
from bandweave.operators.metrics import latency_lines, latency_per_second
from bandweave.plans.spec import WATERMARK_MS, BandJoinSpec
from bandweave.sources.storage import shared_path


def with_watermark(df: DataFrame, ts_ms: str = "ts_ms", delay_ms: int = WATERMARK_MS) -> DataFrame:
    """event_time from epoch milliseconds, with a watermark so far behind the newest."""
    return df.withColumn("event_time", F.timestamp_millis(F.col(ts_ms))).withWatermark("event_time", f"{delay_ms} milliseconds")


def _milliseconds(n: int) -> Column:
    return F.expr(f"make_dt_interval(0, 0, 0, {n / 1000:.3f}BD)")


def stream_band_join(r: DataFrame, s: DataFrame, spec: BandJoinSpec, strategy: str = "auto", cells: tuple[int, int] | None = None, delay_ms: int = WATERMARK_MS) -> DataFrame:
    """The batch join's rows from two streams (or tables)."""
    chosen = spec.strategy(strategy)
    if chosen == "range":
        raise ValueError("a stream join needs buckets: use another strategy")
    cells = cells or ((4, 2) if chosen == "matrix" else (1, 1))

    def side(df: DataFrame, name: str, key: str, ts: str) -> DataFrame:
        df = df.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
        timed = df.select(F.struct(*df.columns).alias(name), F.col(key).cast("double").alias(f"{name}_key"), F.col(ts).cast("long").alias(f"{name}_ts"))
        return timed.withColumn(f"{name}_time", F.timestamp_millis(F.col(f"{name}_ts"))).withWatermark(f"{name}_time", f"{delay_ms} milliseconds")

    left, right, keys = keyed(side(r, "r", spec.r_key, spec.r_ts), side(s, "s", spec.s_key, spec.s_ts), spec, chosen, cells)
    right = right.withColumnsRenamed({k: f"_s{k}" for k in keys})
    condition = band_condition(spec)
    for k in keys:
        condition = (F.col(k) == F.col(f"_s{k}")) & condition
    condition = condition & (F.col("r_time") >= F.col("s_time") - _milliseconds(spec.r_window)) & (F.col("r_time") <= F.col("s_time") + _milliseconds(spec.s_window))
    return left.join(right, condition).select("r", "s", "r_key", "s_key", "r_ts", "s_ts", F.greatest("r_ts", "s_ts").alias("probe_ts"))


def run_once(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over what its sources have now and returns what it gave."""
    spark = stream.sparkSession
    out = shared_path(spark, name)
    query = stream.writeStream.format("parquet").option("checkpointLocation", shared_path(spark, f"{name}-state")).option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def report_latency(results: DataFrame, ingest: str, sink: Callable[[DataFrame], None], checkpoint: str, worker: str | None = None) -> StreamingQuery:
    """For each micro-batch, `count,mean,start,end` lines of the results' latency by second go to sink(lines)."""

    def batch(df: DataFrame, _: int) -> None:
        timed = df.withColumn("_now", F.unix_millis(F.current_timestamp())).withColumn("_latency", F.col("_now") - F.col(ingest))
        timed = timed.withColumn("_worker", F.col(worker) if worker else F.lit(0))
        sink(latency_lines(latency_per_second(timed, "_worker", "_now", "_latency")))

    return results.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
