"""Latency, rate and memory figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def result_latency(ingest: str = "ingest_ms") -> Column:
    """How long ago a result's probe was read; the clock is that of the micro-batch."""
    return F.unix_millis(F.current_timestamp()) - F.col(ingest)


def latency_per_second(results: DataFrame, worker: str, at: str, latency: str) -> DataFrame:
    """For each worker and second: results, mean latency, first and last time."""
    second = F.floor(F.col(at) / 1000).cast("long")
    return results.groupBy(F.col(worker).alias("worker"), second.alias("second")).agg(F.count(F.lit(1)).alias("n"), F.avg(latency).alias("avg_latency"), F.min(at).alias("start_ms"), F.max(at).alias("end_ms"))


def latency_lines(per_second: DataFrame) -> DataFrame:
    """`count,mean,start,end` as text."""
    return per_second.select(F.concat_ws(",", *(F.col(c).cast("string") for c in ("n", "avg_latency", "start_ms", "end_ms"))).alias("value"))


def input_rate(tagged: DataFrame, period_ms: int = 1000) -> DataFrame:
    """Tuples of each side for each period."""
    period = F.floor(F.col("ts_ms") / period_ms).cast("long")
    return tagged.groupBy(period.alias("period")).agg(F.count_if(F.col("side") == "R").alias("r_rate"), F.count_if(F.col("side") == "S").alias("s_rate"))


def observed_rates(tagged: DataFrame, name: str = "rates") -> DataFrame:
    """tagged, with the counts of both sides as observed metrics of its runs (of each micro-batch for streams)."""
    return tagged.observe(name, F.count_if(F.col("side") == "R").alias("r"), F.count_if(F.col("side") == "S").alias("s"))


def rate_sum(rates: DataFrame) -> DataFrame:
    """Rates of all routers together."""
    return rates.agg(F.sum("r_rate").alias("r_rate"), F.sum("s_rate").alias("s_rate"))


def memory_reduce(footprints: DataFrame) -> DataFrame:
    """Over a stream's workers (active, archived, total bytes): the largest active sub-index, the largest active or archived
    one, and the mean total as an integer."""
    return footprints.agg(F.max("active").alias("max_active"), F.max(F.greatest("active", "archived")).alias("max_any"), F.expr("sum(total) div count(*)").alias("avg_total"))
