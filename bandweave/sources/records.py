"""Text records and their parsing: comma-separated stream records, pipe-separated lineitem lines, Parquet events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Positions of fields in a lineitem line (fixed values).
ORDERKEY, QUANTITY, SHIPDATE, SHIPINSTRUCT, SHIPMODE = 0, 4, 10, 13, 14
FIRST_DAY = "1991-01-01"


def parse_csv(lines: DataFrame, column: str = "value") -> DataFrame:
    """source, key, ts, payload of `source,key,ts,payload` records. Fields after the fourth are cut off, so a payload
    ends at its first comma. Fewer than four fields, or an empty fourth as the last, are refused."""
    part = F.split(F.col(column), ",")
    ok = (F.size(part) > 4) | ((F.size(part) == 4) & (part[3] != ""))
    checked = F.when(ok, part).otherwise(F.raise_error(F.concat(F.lit("record with fewer than four fields: "), F.col(column))))
    return lines.select(checked.alias("_p")).select(*(F.col("_p")[i].alias(n) for i, n in enumerate(("source", "key", "ts", "payload"))))


def typed(tuples: DataFrame) -> DataFrame:
    """key as double and ts_ms as long beside the texts; a bad number fails the query."""
    return tuples.withColumns({"key": F.col("key").cast("double"), "ts_ms": F.col("ts").cast("long")})


def line_field(position: int, column: str = "value") -> Column:
    return F.split(F.col(column), "\\|")[position]


def day_number(day: Column, first: str = FIRST_DAY) -> Column:
    """Days since `first`, which is day 1; what isn't a date is day 1 too."""
    parsed = F.to_date(F.try_to_timestamp(day, F.lit("yyyy-MM-dd")))
    return F.coalesce(F.datediff(parsed, F.lit(first).cast("date")) + 1, F.lit(1))


def now_ms() -> Column:
    return F.unix_millis(F.current_timestamp())


def orderkey_tuples(lines: DataFrame, source: str, column: str = "value") -> DataFrame:
    """(source, order key, time of reading, line)."""
    return lines.select(F.lit(source).alias("source"), line_field(ORDERKEY, column).alias("key"), now_ms().cast("string").alias("ts"), F.col(column).alias("payload"))


def shipdate_tuples(lines: DataFrame, source: str, column: str = "value", first: str = FIRST_DAY) -> DataFrame:
    """(source, day number of the ship date, time of reading, line)."""
    return lines.select(F.lit(source).alias("source"), day_number(line_field(SHIPDATE, column), first).cast("string").alias("key"), now_ms().cast("string").alias("ts"), F.col(column).alias("payload"))


def filter_l1(column: str = "value") -> Column:
    """Shipped by truck, quantity over 45."""
    return (line_field(SHIPMODE, column) == "TRUCK") & (line_field(QUANTITY, column).cast("double") > 45)


def filter_l2(column: str = "value") -> Column:
    """Not shipped by truck."""
    return line_field(SHIPMODE, column) != "TRUCK"


def filter_l1_bnci(column: str = "value") -> Column:
    """Shipped by truck, quantity over 48."""
    return (line_field(SHIPMODE, column) == "TRUCK") & (line_field(QUANTITY, column).cast("double") > 48)


def filter_l2_bnci(column: str = "value") -> Column:
    """No ship instruction."""
    return line_field(SHIPINSTRUCT, column) == "NONE"


def epoch_ms(ts: str) -> Column:
    """Milliseconds of a zone-less timestamp, whatever the session's time zone."""
    return F.expr(f"(cast({ts} as timestamp_ntz) - TIMESTAMP_NTZ'1970-01-01 00:00:00') div INTERVAL '0.001' SECOND")


def events(spark: SparkSession, sf_dir: str, kind: str | None = None, key: str = "value") -> DataFrame:
    """event_id, key, ts_ms of one kind of events, or of all."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    table = table if kind is None else table.where(F.col("event_type") == kind)
    return table.select("event_id", F.col(key).cast("double").alias("key"), epoch_ms("ts").alias("ts_ms"))


def lineitem_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as pipe-separated lines. The tables here have no ship mode and instruction: return flag A stands for
    TRUCK, line status O for the instruction NONE."""
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    mode, instruction = F.expr("if(l_returnflag = 'A', 'TRUCK', 'AIR')"), F.expr("if(l_linestatus = 'O', 'NONE', 'COLLECT COD')")
    fields = [*(F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")), F.col("l_quantity").cast("int").cast("string"), F.lit("0"), F.lit("0"), F.lit("0"), "l_returnflag", "l_linestatus", day, day, day, instruction, mode, F.lit("-")]
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat_ws("|", *fields).alias("value"))
