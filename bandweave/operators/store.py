"""What the workers' ordered indexes do, over tables of stored tuples (key, ts_ms, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandweave.plans.spec import SUB_WINDOWS, WINDOW_MS


def range_lookup(df: DataFrame, low: float, high: float, low_inclusive: bool = True, high_inclusive: bool = True, min_ts: int | None = None) -> DataFrame:
    """Tuples with a key between low and high and no older than min_ts."""
    key = F.col("key")
    found = (key >= low if low_inclusive else key > low) & (key <= high if high_inclusive else key < high)
    return df.where(found if min_ts is None else found & (F.col("ts_ms") >= min_ts))


def remove_key_range(df: DataFrame, low: float, high: float) -> DataFrame:
    """What is left after the keys in [low, high) are removed."""
    return df.where(~((F.col("key") >= low) & (F.col("key") < high)) | F.col("key").isNull())


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """What is left after tuples that meet a condition are deleted; a null condition isn't met."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def sub_window(ts: str = "ts_ms", window_ms: int = WINDOW_MS, parts: int = SUB_WINDOWS) -> Column:
    """The number of the sub-window of a time."""
    return F.floor(F.col(ts) / F.lit(window_ms // parts)).cast("long")


def store_status(df: DataFrame, by: list[str]) -> DataFrame:
    """Tuples, and least and greatest time, of each sub-index."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("length"), F.min("ts_ms").alias("min_ts"), F.max("ts_ms").alias("max_ts"))


def expired(df: DataFrame, watermark: int, window_ms: int = WINDOW_MS, parts: int = SUB_WINDOWS) -> DataFrame:
    """What is left at a watermark: sub-indexes whose newest tuple is older than watermark - window go as a whole."""
    part = df.withColumn("_sub", sub_window(window_ms=window_ms, parts=parts))
    live = part.groupBy("_sub").agg(F.max("ts_ms").alias("_newest")).where(F.col("_newest") >= watermark - window_ms)
    return part.join(live, "_sub", "left_semi").drop("_sub")


def migrations(schemes: DataFrame, source: int | None = None, target: int | None = None) -> DataFrame:
    """Edges (source, target, data) of a migration from one node, or to one."""
    out = schemes if source is None else schemes.where(F.col("source") == source)
    return out if target is None else out.where(F.col("target") == target)
