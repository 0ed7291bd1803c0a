"""The registered queries of the join engine, and SQL that gives the same rows.

The tables have neither ship mode nor ship instruction: return flag A stands for TRUCK, line status O for
the instruction NONE (see bandweave.sources.records.lineitem_lines).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bandweave.operators import metrics, routing, store
from bandweave.operators.band_join import balanced_cells, band_join
from bandweave.plans.copies import legacy_copies_column, plan_copies_column
from bandweave.plans.spec import BandJoinSpec
from bandweave.sources import records
from bandweave.streaming.band_join import run_once, stream_band_join

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
MINUTES = 60_000


def registered(oracle: str):
    def add(query):
        QUERIES[query.__name__] = query
        ORACLES[query.__name__] = oracle
        return query

    return add


# Joins of events -----------------------------------------------------------------------------------------------

EVENTS = "select event_id, cast({key} as double) as key, epoch_us(ts) // 1000 as ts_ms from events where event_type = '{kind}'"


def pairs_sql(key: str, on: str, r_window: int = 600_000, s_window: int = 600_000) -> str:
    r, s = EVENTS.format(key=key, kind="click"), EVENTS.format(key=key, kind="purchase")
    return f"""select r.event_id as r_id, s.event_id as s_id, r.key as r_key, s.key as s_key, greatest(r.ts_ms, s.ts_ms) as probe_ts
from ({r}) r join ({s}) s on {on} and r.ts_ms >= s.ts_ms - {r_window} and r.ts_ms <= s.ts_ms + {s_window}"""


def band_sql(surpass: float, behind: float, upper: str = "<=") -> str:
    return f"r.key >= s.key - cast({behind} as double) and r.key {upper} s.key + cast({surpass} as double)"


def event_pairs(spark: SparkSession, sf_dir: str, spec: BandJoinSpec, strategy: str = "auto", key: str = "value", **options) -> DataFrame:
    """Clicks (R) joined with purchases (S)."""
    r, s = records.events(spark, sf_dir, "click", key), records.events(spark, sf_dir, "purchase", key)
    return ids(band_join(r, s, spec, strategy, **options))


def ids(joined: DataFrame) -> DataFrame:
    return joined.select(F.col("r.event_id").alias("r_id"), F.col("s.event_id").alias("s_id"), "r_key", "s_key", "probe_ts")


@registered(pairs_sql("user_id", "r.key = s.key"))
def equi_window_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_pairs(spark, sf_dir, BandJoinSpec(), key="user_id")


@registered(pairs_sql("value", band_sql(1, 1)))
def band_window_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_pairs(spark, sf_dir, BandJoinSpec(surpass=1, behind=1))


@registered(pairs_sql("value", band_sql(2, 1), 300_000, 900_000))
def band_join_asymmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_pairs(spark, sf_dir, BandJoinSpec(surpass=2, behind=1, r_window=5 * MINUTES, s_window=15 * MINUTES))


@registered(pairs_sql("value", band_sql(5, -2)))
def band_join_shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_pairs(spark, sf_dir, BandJoinSpec(surpass=5, behind=-2))


@registered(pairs_sql("value", band_sql(1, 1, "<")))
def band_join_half_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_pairs(spark, sf_dir, BandJoinSpec(surpass=1, behind=1, bounds="half_open"))


@registered(pairs_sql("value", band_sql(10, 10)))
def band_join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain inequality join; in ranges of time where neither side is small."""
    return event_pairs(spark, sf_dir, BandJoinSpec(surpass=10, behind=10), "range")


@registered(pairs_sql("value", band_sql(10, 10)))
def band_join_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_pairs(spark, sf_dir, BandJoinSpec(surpass=10, behind=10), "band_bucket")


@registered(pairs_sql("value", band_sql(10, 10)))
def band_join_time_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_pairs(spark, sf_dir, BandJoinSpec(surpass=10, behind=10), "time_bucket")


@registered(pairs_sql("value", band_sql(10, 10)))
def band_join_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_pairs(spark, sf_dir, BandJoinSpec(surpass=10, behind=10), "grid")


@registered(pairs_sql("value", band_sql(10, 10)))
def band_join_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_pairs(spark, sf_dir, BandJoinSpec(surpass=10, behind=10), "matrix", cells=(4, 2))


@registered(pairs_sql("value", band_sql(10, 10)))
def band_join_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid with a matrix inside its buckets, for skewed keys."""
    return event_pairs(spark, sf_dir, BandJoinSpec(surpass=10, behind=10), "grid", cells=(2, 2))


# Joins of lineitem ---------------------------------------------------------------------------------------------

LINES_SQL = """select l_orderkey || '|' || l_partkey || '|' || l_suppkey || '|' || l_linenumber || '|' || cast(l_quantity as integer) || '|0|0|0|' || l_returnflag || '|' || l_linestatus
    || '|' || strftime(l_shipdate, '%Y-%m-%d') || '|' || strftime(l_shipdate, '%Y-%m-%d') || '|' || strftime(l_shipdate, '%Y-%m-%d')
    || '|' || case when l_linestatus = 'O' then 'NONE' else 'COLLECT COD' end || '|' || case when l_returnflag = 'A' then 'TRUCK' else 'AIR' end || '|-' as value,
  * from lineitem"""
DAY_SQL = "date_diff('day', date '1991-01-01', cast(l_shipdate as date)) + 1"
PAIR_SQL = "r.l_orderkey as r_orderkey, r.l_linenumber as r_linenumber, s.l_orderkey as s_orderkey, s.l_linenumber as s_linenumber"


def lineitem_pairs(r: DataFrame, s: DataFrame, half_band: float) -> DataFrame:
    """Lines joined on their key alone: all have the same time. R is the narrower selection, so S is streamed."""
    spec = BandJoinSpec(surpass=half_band, behind=half_band)
    joined = band_join(r.withColumn("ts_ms", F.lit(0)), s.withColumn("ts_ms", F.lit(0)), spec, "band_bucket", balanced_cells(r, s, spec), streamed="s")
    return joined.select(*(F.col(f"{side}.l_{c}").alias(f"{side}_{c}") for side in "rs" for c in ("orderkey", "linenumber")))


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def shipday() -> Column:
    return (F.datediff(F.col("l_shipdate").cast("date"), F.lit("1991-01-01").cast("date")) + 1).cast("double")


@registered(f"select {PAIR_SQL} from (select *, {DAY_SQL} as day from lineitem where l_returnflag = 'A' and l_quantity > 45) r join (select *, {DAY_SQL} as day from lineitem where l_returnflag <> 'A') s on r.day between s.day - 1 and s.day + 1")
def tpc_bci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trucked large lines with others shipped within a day of them."""
    lines = lineitem(spark, sf_dir).withColumn("key", shipday()).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "key")
    return lineitem_pairs(lines.where("l_returnflag = 'A' and l_quantity > 45").drop("l_quantity", "l_returnflag"), lines.where("l_returnflag <> 'A'").drop("l_quantity", "l_returnflag"), 1)


@registered(f"select {PAIR_SQL} from (select * from lineitem where l_returnflag = 'A' and l_quantity > 48) r join (select * from lineitem where l_linestatus = 'O') s on r.l_orderkey between s.l_orderkey - 1 and s.l_orderkey + 1")
def tpc_bnci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trucked large lines with lines without instruction of neighbouring orders."""
    lines = lineitem(spark, sf_dir).withColumn("key", F.col("l_orderkey").cast("double"))
    cut = ["l_orderkey", "l_linenumber", "key"]
    return lineitem_pairs(lines.where("l_returnflag = 'A' and l_quantity > 48").select(cut), lines.where("l_linestatus = 'O'").select(cut), 1)


# Parsing and filters -------------------------------------------------------------------------------------------


def filtered(spark: SparkSession, sf_dir: str, condition) -> DataFrame:
    return records.lineitem_lines(spark, sf_dir).where(condition)


@registered(f"select value from ({LINES_SQL}) where l_returnflag = 'A' and l_quantity > 45")
def filter_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(spark, sf_dir, records.filter_l1())


@registered(f"select value from ({LINES_SQL}) where l_returnflag <> 'A'")
def filter_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(spark, sf_dir, records.filter_l2())


@registered(f"select value from ({LINES_SQL}) where l_returnflag = 'A' and l_quantity > 48")
def filter_l1_bnci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(spark, sf_dir, records.filter_l1_bnci())


@registered(f"select value from ({LINES_SQL}) where l_linestatus = 'O'")
def filter_l2_bnci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(spark, sf_dir, records.filter_l2_bnci())


@registered(f"select 'L1' as source, cast({DAY_SQL} as double) as key, value as payload from ({LINES_SQL})")
def shipdate_day_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuples = records.shipdate_tuples(records.lineitem_lines(spark, sf_dir), "L1")
    return records.typed(tuples).select("source", "key", "payload")


@registered(f"select 'L1' as source, cast(l_orderkey as double) as key, value as payload from ({LINES_SQL})")
def orderkey_tuple(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuples = records.orderkey_tuples(records.lineitem_lines(spark, sf_dir), "L1")
    return records.typed(tuples).select("source", "key", "payload")


@registered("select event_type as source, cast(user_id as double) as key, epoch_us(ts) // 1000 as ts_ms, split_part(event_id || ',' || props, ',', 1) as payload from events")
def csv_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as text records and back: a payload ends at its first comma."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    lines = table.select(F.concat_ws(",", "event_type", F.col("user_id").cast("string"), records.epoch_ms("ts").cast("string"), F.col("event_id").cast("string"), F.coalesce("props", F.lit(""))).alias("value"))
    return records.typed(records.parse_csv(lines)).select("source", "key", "ts_ms", "payload")


# Routing -------------------------------------------------------------------------------------------------------

TAGGED = f"select *, 'R' as side from ({EVENTS.format(key='value', kind='click')}) union all select *, 'S' as side from ({EVENTS.format(key='value', kind='purchase')})"
SERIAL = f"select *, event_id % 64 as router, row_number() over (partition by side, event_id % 64 order by event_id) % 32 as serial from ({TAGGED})"


def tagged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.tagged_union(records.events(spark, sf_dir, "click"), records.events(spark, sf_dir, "purchase"))


def numbered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their serial number at one of the routers; numbers wrap at the workers of a stream."""
    return routing.with_serial(tagged_events(spark, sf_dir), "event_id", F.col("event_id") % routing.ROUTERS, routing.R_NODES)


SCHEME = routing.MatrixScheme(r_copies=4, s_copies=8)


@registered(f"select event_id, key, ts_ms, side from ({TAGGED})")
def union_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged_events(spark, sf_dir)


@registered(f"select event_id, side, serial, cast(case when side = 'R' then serial % 8 * 4 + i else 32 + serial % 4 * 8 + i end as integer) as node from ({SERIAL}), range(8) t(i) where side = 'S' or i < 4")
def store_partitions_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.store_partitions(numbered_events(spark, sf_dir), SCHEME).select("event_id", "side", "serial", "node")


@registered(f"select event_id, side, serial, cast(case when side = 'R' then serial // 4 * 4 + i else 32 + serial // 8 * 8 + i end as integer) as node from ({SERIAL}), range(8) t(i) where side = 'S' or i < 4")
def store_partitions_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.store_partitions(numbered_events(spark, sf_dir), SCHEME, base=True).select("event_id", "side", "serial", "node")


@registered(f"select event_id, side, serial, cast(case when side = 'R' then 32 + serial % 8 + i * 8 else serial % 4 + i * 4 end as integer) as node from ({SERIAL}), range(8) t(i) where side = 'S' or i < 4")
def probe_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.probe_partitions(numbered_events(spark, sf_dir), SCHEME).select("event_id", "side", "serial", "node")


@registered(f"""with n as ({SERIAL}),
stored as (select event_id, side, 32 + serial % 4 * 8 + i as node from n, range(8) t(i) where side = 'S'),
probed as (select event_id, 32 + serial % 8 + i * 8 as node from n, range(4) t(i) where side = 'R')
select cast(p.node as integer) as node, count(*) as pairs from probed p join stored s on p.node = s.node group by 1""")
def routed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs of a probing R and a stored S meet on each worker."""
    tuples = numbered_events(spark, sf_dir)
    stored = routing.store_partitions(tuples.where("side = 'S'"), SCHEME).groupBy("node").agg(F.count(F.lit(1)).alias("s"))
    probing = routing.probe_partitions(tuples.where("side = 'R'"), SCHEME).groupBy("node").agg(F.count(F.lit(1)).alias("r"))
    return probing.join(stored, "node").select("node", (F.col("r") * F.col("s")).alias("pairs"))


@registered(f"select event_id, side, serial from ({SERIAL}) where serial between 8 and 15")
def serial_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.evict_by_serial(numbered_events(spark, sf_dir), 8, 15).select("event_id", "side", "serial")


@registered(f"select event_id, side, serial from ({SERIAL}) where serial % 4 = 1")
def serial_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes that the sub-index of row 1 of four copies answers."""
    return numbered_events(spark, sf_dir).where(routing.answers(4, 1)).select("event_id", "side", "serial")


# Figures -------------------------------------------------------------------------------------------------------


@registered(f"select r_id % 4 as worker, probe_ts // 1000 as second, count(*) as n, avg(gap) as avg_latency, min(probe_ts) as start_ms, max(probe_ts) as end_ms from (select *, abs(r_ts - s_ts) as gap from ({pairs_sql('value', band_sql(10, 10)).replace('select r.event_id', 'select r.ts_ms as r_ts, s.ts_ms as s_ts, r.event_id', 1)})) group by 1, 2")
def latency_per_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report over results whose latency is the time between their two sides."""
    r, s = records.events(spark, sf_dir, "click"), records.events(spark, sf_dir, "purchase")
    joined = band_join(r, s, BandJoinSpec(surpass=10, behind=10)).withColumns({"worker": F.col("r.event_id") % 4, "gap": F.abs(F.col("r_ts") - F.col("s_ts"))})
    return metrics.latency_per_second(joined, "worker", "probe_ts", "gap")


@registered(f"select ts_ms // 1000 as period, count(*) filter (side = 'R') as r_rate, count(*) filter (side = 'S') as s_rate from ({TAGGED}) group by 1")
def input_rate_per_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.input_rate(tagged_events(spark, sf_dir))


@registered(f"select count(*) filter (side = 'R') as r_rate, count(*) filter (side = 'S') as s_rate from ({TAGGED})")
def rate_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rate_sum(metrics.input_rate(tagged_events(spark, sf_dir)))


FOOTPRINTS = "select l_suppkey as worker, cast(sum(l_quantity) filter (l_linestatus = 'O') as bigint) as active, cast(sum(l_quantity) filter (l_linestatus = 'F') as bigint) as archived, cast(sum(l_quantity) as bigint) as total from lineitem group by 1"


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities by supplier in the place of bytes by worker."""
    of = lambda status: F.sum(F.when(F.col("l_linestatus") == status, F.col("l_quantity"))).cast("long")
    return lineitem(spark, sf_dir).groupBy(F.col("l_suppkey").alias("worker")).agg(of("O").alias("active"), of("F").alias("archived"), F.sum("l_quantity").cast("long").alias("total"))


@registered(f"select max(active) as max_active, max(greatest(active, archived)) as max_any, cast(sum(total) as bigint) // count(*) as avg_total from ({FOOTPRINTS})")
def memory_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.memory_reduce(footprints(spark, sf_dir))


@registered(f"""with f as (select ts_ms // 3600000 as hour, count(*) filter (side = 'R') as own, count(*) filter (side = 'S') as other, cast(sum(key) * 20000 as bigint) as active from ({TAGGED}) group by 1),
g as (select *, cast(1 << cast(hour % 6 as integer) as integer) as copies from f),
h as (select *, sqrt(other * 32.0 / nullif(own, 0)) as ideal from g)
select hour, copies, cast(case when own <= 0 or other <= 0 then copies when active >= 20971520 or ideal < copies then greatest(1, copies // 2)
  when ideal >= 2 * copies and active * 1.5 < 10485760 then least(32, copies * 2) else copies end as integer) as planned from h""")
def copy_planner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planner over figures by hour: rates of both sides, values in the place of bytes."""
    hour = F.floor(F.col("ts_ms") / 3_600_000).cast("long")
    figures = tagged_events(spark, sf_dir).groupBy(hour.alias("hour")).agg(F.count_if(F.col("side") == "R").alias("own"), F.count_if(F.col("side") == "S").alias("other"), F.round(F.sum("key") * 20000).cast("long").alias("active"))
    figures = figures.withColumn("copies", F.expr("shiftleft(1, cast(hour % 6 as int))"))
    planned = plan_copies_column(F.col("active"), F.col("active") * 1.5, F.col("copies"), F.col("own"), F.col("other"))
    return figures.select("hour", "copies", planned.alias("planned"))


@registered(f"""with f as (select ts_ms // 3600000 as hour, count(*) as n from ({TAGGED}) group by 1), g as (select *, cast(1 << cast(hour % 6 as integer) as integer) as copies from f)
select hour, copies, cast(least(32, greatest(1, case when n > 60 then copies // 2 when n < 20 then copies * 2 else copies end)) as integer) as planned from g""")
def legacy_planner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older policy by hour: a worker of over 60 tuples counts as overloaded, one of under 20 as idle."""
    hour = F.floor(F.col("ts_ms") / 3_600_000).cast("long")
    figures = tagged_events(spark, sf_dir).groupBy(hour.alias("hour")).agg(F.count(F.lit(1)).alias("n")).withColumn("copies", F.expr("shiftleft(1, cast(hour % 6 as int))"))
    return figures.select("hour", "copies", legacy_copies_column(F.col("copies"), routing.R_NODES, F.col("n") > 60, F.col("n") < 20).alias("planned"))


@registered(f"select node, cast(sum(n) as bigint) as tuples from (select cast(case when side = 'R' then serial % 8 * 4 + i else 32 + serial % 4 * 8 + i end as integer) as node, 1 as n from ({SERIAL}), range(8) t(i) where side = 'S' or i < 4) group by 1")
def dealt_by_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tuples the partition of each worker holds, counted inside the partitions."""
    routed = routing.by_node(routing.store_partitions(numbered_events(spark, sf_dir), SCHEME), SCHEME)
    return routed.groupBy(F.spark_partition_id().alias("node")).agg(F.count(F.lit(1)).alias("tuples"))


@registered(f"select key, count(*) as n, 1 as routers from ({TAGGED}) group by 1")
def dealt_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The routers that see a key: one."""
    routed = routing.by_key(tagged_events(spark, sf_dir)).withColumn("router", F.spark_partition_id())
    return routed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("router").cast("int").alias("routers"))


# Stored tuples -------------------------------------------------------------------------------------------------

CLICKS = EVENTS.format(key="value", kind="click")
NEWEST = f"(select max(ts_ms) from ({CLICKS}))"


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.events(spark, sf_dir, "click")


@registered(f"select event_id, ts_ms // 120000 as sub_window from ({CLICKS})")
def subwindow_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clicks(spark, sf_dir).select("event_id", store.sub_window().alias("sub_window"))


@registered(f"select ts_ms // 120000 as sub_window, count(*) as length, min(ts_ms) as min_ts, max(ts_ms) as max_ts from ({CLICKS}) group by 1")
def store_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.store_status(clicks(spark, sf_dir).withColumn("sub_window", store.sub_window()), ["sub_window"])


@registered(f"with c as ({CLICKS}) select event_id, key, ts_ms from c where ts_ms // 120000 in (select ts_ms // 120000 from c group by 1 having max(ts_ms) >= {NEWEST} - 500 - 86400000)")
def expire_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a window of a day leaves at the end of the stream."""
    tuples = clicks(spark, sf_dir)
    newest = tuples.agg(F.max("ts_ms").alias("t")).first().t or 0
    return store.expired(tuples, newest - 500, window_ms=86_400_000, parts=720)


@registered(f"select event_id, key, ts_ms from ({CLICKS}) where key > 50 and key <= 150 and ts_ms >= {NEWEST} - 864000000")
def range_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuples = clicks(spark, sf_dir)
    newest = tuples.agg(F.max("ts_ms").alias("t")).first().t or 0
    return store.range_lookup(tuples, 50, 150, low_inclusive=False, min_ts=newest - 864_000_000)


@registered(f"select event_id, key, ts_ms from ({CLICKS}) where not (key >= 50 and key < 150)")
def remove_key_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.remove_key_range(clicks(spark, sf_dir), 50, 150)


@registered(f"select event_id, key, ts_ms from ({CLICKS}) where event_id % 32 >= 30")
def conditional_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.delete_where(clicks(spark, sf_dir), F.col("event_id") % 32 < 30)


EDGES = "select cast(o_custkey % 8 as integer) as source, cast(o_orderkey % 8 as integer) as target, count(*) as data from orders group by 1, 2"


def migration_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.groupBy((F.col("o_custkey") % 8).cast("int").alias("source"), (F.col("o_orderkey") % 8).cast("int").alias("target")).agg(F.count(F.lit(1)).alias("data"))


@registered(f"select * from ({EDGES}) where source = 3")
def migration_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.migrations(migration_edges(spark, sf_dir), source=3)


@registered(f"select * from ({EDGES}) where target = 5")
def migration_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.migrations(migration_edges(spark, sf_dir), target=5)


# Streams -------------------------------------------------------------------------------------------------------


def event_stream(spark: SparkSession, sf_dir: str, kind: str, key: str) -> DataFrame:
    """One kind of events as a stream of the table's file."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.where(F.col("event_type") == kind).select("event_id", F.col(key).cast("double").alias("key"), records.epoch_ms("ts").alias("ts_ms"))


def streamed_pairs(spark: SparkSession, sf_dir: str, name: str, spec: BandJoinSpec, key: str, strategy: str = "auto") -> DataFrame:
    r, s = event_stream(spark, sf_dir, "click", key), event_stream(spark, sf_dir, "purchase", key)
    return run_once(ids(stream_band_join(r, s, spec, strategy)), name)


@registered(ORACLES["equi_window_join"])
def stream_equi_window_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streamed_pairs(spark, sf_dir, "stream-equi", BandJoinSpec(), "user_id")


@registered(ORACLES["band_window_join"])
def stream_band_window_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streamed_pairs(spark, sf_dir, "stream-band", BandJoinSpec(surpass=1, behind=1), "value")


@registered(ORACLES["band_join_matrix"])
def stream_band_join_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streamed_pairs(spark, sf_dir, "stream-matrix", BandJoinSpec(surpass=10, behind=10), "value", "matrix")
