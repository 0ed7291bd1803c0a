"""The windowed band join as DataFrame plans.

Catalyst has no range join: a pure inequality becomes a nested loop. So all strategies but `range` (with a small side) add equality keys
that every matching pair has in common exactly once, and leave the exact predicate to the join's condition:

- band_bucket: R is in the bucket of its key, S in the two or three that its band covers;
- time_bucket: the same over event time;
- grid: both, the default, since it bounds a bucket by key and by time;
- matrix: R in one row of cells, S in one column, in each time bucket, whatever the band; also as a salt inside buckets;
- equi: the key itself, with time buckets so that a hot key is spread over its time.

Pairs meet in one bucket only, so no distinct is needed and duplicates of input rows multiply as they should.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandweave.plans.spec import BandJoinSpec

#: Bucket numbers stay where doubles still count by one; keys beyond share the last buckets.
EDGE = float(1 << 50)
BUCKETS = ("_band", "_time", "_row", "_col")


def bucket(value: Column, width: float) -> Column:
    """floor(value / width), monotone, for every double: NaN has a bucket of its own above all."""
    scaled = value.cast("double") / F.lit(float(width))
    return F.when(F.isnan(scaled), F.lit(1 << 51)).otherwise(F.floor(F.greatest(F.lit(-EDGE), F.least(F.lit(EDGE), scaled)))).cast("long")


def _side(df: DataFrame, side: str, key: str, ts: str) -> DataFrame:
    return df.select(F.struct(*df.columns).alias(side), F.col(key).cast("double").alias(f"{side}_key"), F.col(ts).cast("long").alias(f"{side}_ts"))


def band_condition(spec: BandJoinSpec) -> Column:
    r, s = F.col("r_key"), F.col("s_key")
    upper = r <= s + F.lit(spec.surpass) if spec.bounds == "closed" else r < s + F.lit(spec.surpass)
    return (r >= s - F.lit(spec.behind)) & upper


def time_condition(spec: BandJoinSpec) -> Column:
    return (F.col("r_ts") >= F.col("s_ts") - F.lit(spec.r_window)) & (F.col("r_ts") <= F.col("s_ts") + F.lit(spec.s_window))


def _buckets(r: DataFrame, s: DataFrame, name: str, lower: Column, upper: Column, at: Column, width: float) -> tuple[DataFrame, DataFrame]:
    return r.withColumn(name, bucket(at, width)), s.withColumn(name, F.explode(F.sequence(bucket(lower, width), bucket(upper, width))))


def keyed(r: DataFrame, s: DataFrame, spec: BandJoinSpec, strategy: str, cells: tuple[int, int]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with the equality keys of the strategy."""
    keys: list[str] = []
    if strategy == "equi":
        r, s = r.withColumn("_band", F.col("r_key")), s.withColumn("_band", F.col("s_key") + F.lit(spec.surpass))
        keys.append("_band")
    if strategy in ("band_bucket", "grid"):
        r, s = _buckets(r, s, "_band", F.col("s_key") - F.lit(spec.behind), F.col("s_key") + F.lit(spec.surpass), F.col("r_key"), spec.width or 1.0)
        keys.append("_band")
    if strategy in ("time_bucket", "grid", "equi", "matrix"):
        r, s = _buckets(r, s, "_time", F.col("s_ts") - F.lit(spec.r_window), F.col("s_ts") + F.lit(spec.s_window), F.col("r_ts"), max(1, spec.span))
        keys.append("_time")
    if strategy == "matrix" or cells != (1, 1):
        rows, cols = cells
        r = r.withColumn("_row", F.pmod(F.xxhash64("r"), F.lit(rows))).withColumn("_col", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cols - 1).cast("long"))))
        s = s.withColumn("_col", F.pmod(F.xxhash64("s"), F.lit(cols))).withColumn("_row", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long"))))
        keys += ["_row", "_col"]
    return r, s, keys


def balanced_cells(r: DataFrame, s: DataFrame, spec: BandJoinSpec, bucket_rows: int = 100_000) -> tuple[int, int]:
    """Cells that leave about so many rows of either side in the largest band bucket and cell, by a count of the buckets."""
    largest = []
    for df, key in ((r, spec.r_key), (s, spec.s_key)):
        counts = df.groupBy(bucket(F.col(key), spec.width or 1.0).alias("_band")).count()
        largest.append(counts.agg(F.max("count").alias("n")).first().n or 0)
    rows, cols = (max(1, -(-n // bucket_rows)) for n in largest)
    return rows, cols


def band_join(r: DataFrame, s: DataFrame, spec: BandJoinSpec, strategy: str = "auto", cells: tuple[int, int] | None = None, range_rows: int = 100_000, streamed: str = "r") -> DataFrame:
    """Rows (r struct, s struct, r_key, s_key, r_ts, s_ts, probe_ts), probe_ts the later of the two times.

    cells: rows and columns of the matrix; with another strategy, a salt for skewed buckets (R is hashed over the rows and
    copied to the columns, S the other way round). range_rows: the strategy `range` is a nested loop with one side sent to all
    tasks; where both have more rows than that, time is cut into ranges as wide as the window, R is in one, S in those that its window
    meets, and each range is a loop of its own. streamed: the side whose rows come one after another, each with all its
    partners in a bucket, while a bucket of the other is held; of the larger side, a result of many pairs repeats short runs of partners,
    which files store in a fraction. Rows with a null key or time join nothing."""
    if streamed not in ("r", "s"):
        raise ValueError("streamed: 'r' or 's'")
    chosen = spec.strategy(strategy)
    cells = cells or ((4, 2) if chosen == "matrix" else (1, 1))
    left = _side(r, "r", spec.r_key, spec.r_ts).where("r_key is not null and r_ts is not null")
    right = _side(s, "s", spec.s_key, spec.s_ts).where("s_key is not null and s_ts is not null")
    condition = band_condition(spec) & time_condition(spec)
    if chosen == "range":
        small = [side.limit(range_rows + 1).count() <= range_rows for side in (left, right)]
        if not any(small):
            chosen = "time_bucket"
    if chosen == "range":
        found = left.join(F.broadcast(right), condition) if small[1] else F.broadcast(left).join(right, condition)
    else:
        left, right, keys = keyed(left, right, spec, chosen, cells)
        right = right.withColumnsRenamed({k: f"_s{k}" for k in keys})
        for k in keys:
            condition = (F.col(k) == F.col(f"_s{k}")) & condition
        found = left.join(right, condition) if streamed == "r" else right.join(left, condition)
    return found.select("r", "s", "r_key", "s_key", "r_ts", "s_ts", F.greatest("r_ts", "s_ts").alias("probe_ts"))
