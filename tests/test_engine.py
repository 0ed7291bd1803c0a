"""Parsing, filters, routing, stores, figures and the planner, against the fixed vectors of the survey."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from bandweave.operators import metrics, routing, store
from bandweave.plans.copies import Hysteresis, Widening, legacy_copies, plan_copies, plan_copies_column
from bandweave.sources import kafka, records

MIB = 1 << 20


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_csv(spark):
    got = records.typed(records.parse_csv(lines(spark, "r1,10.0,1000,abc", "r1,10.0,1000,a,b", "r1,1.5d,7,,x"))).collect()
    assert [(x.source, x.key, x.ts_ms, x.payload) for x in got] == [("r1", 10.0, 1000, "abc"), ("r1", 10.0, 1000, "a"), ("r1", 1.5, 7, "")]
    for bad in ("r1,10.0,1000", "r1,10.0,1000,", "r1,x,1000,a"):
        with pytest.raises(PySparkException):
            records.typed(records.parse_csv(lines(spark, bad))).collect()


def line(quantity=46, day="1996-03-13", instruction="NONE", mode="TRUCK"):
    return f"1|2|3|1|{quantity}|100.0|0.05|0.02|N|O|{day}|1996-02-12|1996-03-22|{instruction}|{mode}|comment"


def test_filters(spark):
    df = lines(spark, line(), line(45), line(49), line(mode="AIR"), line(instruction="COLLECT COD"))
    count = lambda f: df.where(f).count()
    assert [count(f()) for f in (records.filter_l1, records.filter_l2, records.filter_l1_bnci, records.filter_l2_bnci)] == [3, 1, 1, 4]


def test_day_numbers(spark):
    days = ["1991-01-01", "1991-01-02", "1992-01-02", "junk", "1990-12-31"]
    got = records.shipdate_tuples(lines(spark, *(line(day=d) for d in days)), "L").select("key").collect()
    assert [x.key for x in got] == ["1", "2", "367", "1", "0"]
    row = records.orderkey_tuples(lines(spark, line()), "L").first()
    assert (row.source, row.key, row.payload) == ("L", "1", line()) and int(row.ts) > 1_600_000_000_000


def test_epoch_ms_ignores_the_time_zone(spark):
    df = spark.sql("select TIMESTAMP_NTZ'2024-07-01 00:00:07.179575' as ts")
    was = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert df.select(records.epoch_ms("ts").alias("t")).first().t == 1719792007179
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)


def test_kafka_options():
    assert kafka.source_options("h:1", kafka.TOPIC_R)["startingOffsets"] == "latest"
    assert kafka.source_options("h:1", kafka.TOPIC_R, offsets="earliest")["startingOffsets"] == "earliest"
    with pytest.raises(ValueError):
        kafka.source_options("h:1", "t", offsets="middle")


def tuples(spark, *serials, side="R"):
    return spark.createDataFrame([(side, q) for q in serials], "side string, serial long")


def test_routing_vectors(spark):
    scheme = routing.MatrixScheme(r_copies=4, s_copies=4)
    nodes = lambda df: {q: sorted(x.node for x in df.where(F.col("serial") == q).collect()) for q in (1, 9, 31)}
    df = tuples(spark, 1, 9, 31)
    assert nodes(routing.store_partitions(df, scheme)) == {1: [4, 5, 6, 7], 9: [4, 5, 6, 7], 31: [28, 29, 30, 31]}
    assert nodes(routing.store_partitions(df, scheme, base=True)) == {1: [0, 1, 2, 3], 9: [8, 9, 10, 11], 31: [28, 29, 30, 31]}
    assert nodes(routing.probe_partitions(df, scheme)) == {1: list(range(33, 64, 4)), 9: list(range(33, 64, 4)), 31: list(range(35, 64, 4))}
    assert nodes(routing.store_partitions(tuples(spark, 1, 9, 31, side="S"), scheme))[1] == [36, 37, 38, 39]


def test_every_pair_meets_once(spark):
    for copies in (1, 2, 4, 8, 16, 32):
        scheme = routing.MatrixScheme(s_copies=copies)
        stored = routing.store_partitions(tuples(spark, *range(32), side="S"), scheme).withColumnRenamed("serial", "s")
        probing = routing.probe_partitions(tuples(spark, *range(32)), scheme)
        met = probing.join(stored.select("s", "node"), "node").groupBy("serial", "s").count().collect()
        assert len(met) == 1024 and {x["count"] for x in met} == {1}
    with pytest.raises(ValueError):
        routing.MatrixScheme(r_copies=64)
    with pytest.raises(ValueError):
        routing.MatrixScheme(r_copies=3)


def test_store(spark):
    df = spark.range(100).selectExpr("cast(id as double) as key", "id * 1000 as ts_ms", "id % 32 as serial")
    keys = lambda d: sorted(int(x.key) for x in d.collect())
    assert keys(store.range_lookup(df, 55, 57)) == [55, 56, 57]
    assert keys(store.range_lookup(df, 55, 57, False, False)) == [56]
    assert keys(store.range_lookup(df, 55, 57, min_ts=56000)) == [56, 57]
    left = store.delete_where(df, F.col("serial") < 30)
    assert keys(left) == [30, 31, 62, 63, 94, 95] and keys(store.range_lookup(left, 95, 100)) == [95]
    assert keys(store.delete_where(left, F.col("serial") < 31)) == [31, 63, 95]
    assert len(keys(store.remove_key_range(df, 10, 20))) == 90
    status = store.store_status(df.withColumn("one", F.lit(1)), ["one"]).first()
    assert (status.length, status.min_ts, status.max_ts) == (100, 0, 99000)
    assert keys(store.expired(df, 90_000, window_ms=50_000)) == list(range(40, 100))
    assert keys(routing.evict_by_serial(df, 30, 31)) == [30, 31, 62, 63, 94, 95]


def test_migrations(spark):
    df = spark.createDataFrame([(0, 1, 5), (0, 2, 6), (3, 1, 7)], "source int, target int, data long")
    assert store.migrations(df, source=0).count() == 2 and store.migrations(df, target=1).count() == 2 and store.migrations(df, 0, 1).count() == 1


VECTORS = [(0, 0, 1, 1000, 1000, 2), (0, 0, 2, 1000, 1000, 4), (0, 0, 4, 1000, 1000, 4), (0, 0, 8, 1000, 1000, 4), (21 * MIB, 21 * MIB, 4, 1, 1, 2), (0, 11 * MIB, 1, 1000, 1000, 1), (0, 0, 32, 10, 4000, 32), (0, 0, 4, 0, 5, 4), (30 * MIB, 0, 1, 1, 1, 1)]


def test_planner(spark):
    assert [plan_copies(*v[:5]) for v in VECTORS] == [v[5] for v in VECTORS]
    df = spark.createDataFrame(VECTORS, "active long, any_ long, copies int, own long, other long, planned int")
    planned = plan_copies_column(*(F.col(c) for c in ("active", "any_", "copies", "own", "other")))
    assert df.where(planned != F.col("planned")).count() == 0


def test_hysteresis():
    h = Hysteresis(4, 4)
    assert h.step(2, 4) == (2, 4)
    seen = [h.step(4, 8 if i > 3 else 4) for i in range(26)]
    assert seen[24] == (2, 4) and seen[25] == (4, 8)  # S rides along with 22 of 26 votes
    h = Hysteresis(4, 4, cool_down=3)
    assert [h.step(2, 4), *(h.step(1, 4) for _ in range(4))] == [(2, 4)] * 4 + [(1, 4)]


@pytest.mark.parametrize(("votes", "rides"), [(20, False), (21, True)])
def test_s_rides_along_by_the_votes_of_earlier_periods(votes, rides):
    h = Hysteresis(4, 4)
    seen = [h.step(8, 8 if i >= 25 - votes else 4) for i in range(26)]
    assert seen[24] == (4, 4) and seen[25] == (8, 8 if rides else 4)
    h = Hysteresis(4, 4)  # the other way round this period's vote counts
    seen = [h.step(8 if i >= 25 - votes + 1 else 4, 8) for i in range(26)]
    assert seen[25] == (8 if rides else 4, 8)


def test_copies_of_a_scheme_are_those_of_the_join(spark):
    from bandweave.operators.band_join import keyed
    from bandweave.plans.spec import BandJoinSpec

    scheme = routing.MatrixScheme(r_copies=2, s_copies=8)
    side = lambda n: spark.createDataFrame([(("a",), 1.0, 0)], f"{n} struct<x: string>, {n}_key double, {n}_ts long")
    r, s, _ = keyed(side("r"), side("s"), BandJoinSpec(), "band_bucket", scheme.cells())
    assert (r.count(), s.count()) == (2, 8)


def test_older_policy_and_widening():
    assert [legacy_copies(4, 32, True), legacy_copies(1, 32, True), legacy_copies(32, 32, False, True), legacy_copies(4, 32, False)] == [2, 1, 32, 4]
    w = Widening(2, 4, 1000)
    assert (w.store_copies(999), w.store_copies(1000), w.probe_copies(720_999), w.probe_copies(721_000)) == (2, 4, 2, 4)
    assert Widening(4, 2, 0).probe_copies(0) == 2


def test_figures(spark):
    df = spark.createDataFrame([(0, 1000, 5), (0, 1999, 7), (0, 2000, 9), (1, 1500, 1)], "w int, at long, gap long")
    got = metrics.latency_per_second(df, "w", "at", "gap")
    assert sorted(map(tuple, got.collect())) == [(0, 1, 2, 6.0, 1000, 1999), (0, 2, 1, 9.0, 2000, 2000), (1, 1, 1, 1.0, 1500, 1500)]
    assert "2,6.0,1000,1999" in [x.value for x in metrics.latency_lines(got).collect()]
    rates = metrics.input_rate(spark.createDataFrame([("R", 5), ("S", 999), ("R", 1000)], "side string, ts_ms long"))
    assert sorted(map(tuple, rates.collect())) == [(0, 1, 1), (1, 1, 0)] and tuple(metrics.rate_sum(rates).first()) == (2, 1)
    assert tuple(metrics.memory_reduce(spark.createDataFrame([(1, 5, 10), (3, 2, 5)], "active long, archived long, total long")).first()) == (3, 5, 7)


def test_latency_report(spark, tmp_path):
    from bandweave.streaming.band_join import report_latency

    spark.createDataFrame([(1, 0)], "id long, ingest_ms long").write.parquet(str(tmp_path / "in"))
    seen = []
    query = report_latency(spark.readStream.schema("id long, ingest_ms long").parquet(str(tmp_path / "in")), "ingest_ms", lambda df: seen.extend(df.collect()), str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    assert len(seen) == 1 and seen[0].value.startswith("1,")
