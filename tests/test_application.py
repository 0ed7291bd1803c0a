"""The application over text files in the place of topics, and the control loop."""

import pytest

from bandweave import app
from bandweave.operators import metrics, routing
from bandweave.plans.controller import Controller, Figures, from_progress
from bandweave.plans.spec import BandJoinSpec
from bandweave.streaming.band_join import run_once

DAY = 1_700_000_000_000


def text(spark, path, *lines):
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(str(path))
    return spark.readStream.text(str(path))


def test_text_streams_to_joined_rows_and_latency(spark, tmp_path):
    r = lambda n: text(spark, tmp_path / f"r{n}", f"r,10.0,{DAY},a,cut", f"r,11.0,{DAY + 5},b", f"r,30.0,{DAY},c")
    s = lambda n: text(spark, tmp_path / f"s{n}", f"s,10.5,{DAY + 9},x", f"s,99.0,{DAY},y")
    for n, cells in ((1, None), (2, (2, 3))):
        got = run_once(app.joined(r(n), s(n), BandJoinSpec(surpass=1, behind=1), cells=cells), "app").collect()
        assert sorted((x.r.payload, x.s.payload, x.probe_ts) for x in got) == [("a", "x", DAY + 9), ("b", "x", DAY + 9)]
        assert all(x.ingest_ms == x.s.ingest_ms for x in got)
    seen = []
    query = app.report_latency(app.joined(r(3), s(3), BandJoinSpec(surpass=1, behind=1)), "ingest_ms", lambda df: seen.extend(df.collect()), str(tmp_path / "state"))
    query.processAllAvailable()
    progress = query.lastProgress
    query.stop()
    assert [x.value.split(",")[0] for x in seen] == ["2"]
    assert from_progress(progress if isinstance(progress, dict) else progress.jsonValue if hasattr(progress, "jsonValue") else {}).r_rate >= 0


def test_arguments_are_needed():
    with pytest.raises(SystemExit):
        app.main(["--servers", "h:1"])


def test_controller():
    c = Controller(routing.MatrixScheme(r_copies=1, s_copies=8))
    assert (c.step(Figures(1000, 1000)).s_copies, c.scheme.r_copies) == (4, 1)  # down at once, up after 25 votes
    for _ in range(25):
        c.step(Figures(1000, 1000))
    assert c.scheme.r_copies == 2 and c.probe_copies("R") == 1 and c.cells() == (4, 2)
    c.now_ms += 720_000
    assert c.probe_copies("R") == 2
    assert c.step(Figures(0, 5)) == c.scheme
    assert c.step(Figures(1, 1, s_active=30 << 20)).s_copies == 2
    slow = Controller(routing.MatrixScheme(r_copies=8, s_copies=8), multiple=False)
    slow.step(Figures(1000, 1000))
    assert slow.scheme == routing.MatrixScheme(r_copies=4, s_copies=4) and slow.damped.waiting == 144
    figures = from_progress({"sources": [{"inputRowsPerSecond": 5.0}, {"inputRowsPerSecond": None}], "stateOperators": [{"memoryUsedBytes": 800, "numShufflePartitions": 4}]})
    assert figures == Figures(5.0, 0.0, 200, 200, 200, 200) and from_progress({}) == Figures(0.0, 0.0)


def test_dealing(spark):
    df = spark.range(100).selectExpr("id % 5 as key", "'R' as side", "id % 32 as serial")
    assert routing.shuffled(df, 3).rdd.getNumPartitions() == 3
    assert all(len({r.key for r in p}) * 20 == len(p) for p in routing.by_key(df, 4).rdd.glom().collect())
    scheme = routing.MatrixScheme()
    parts = routing.by_node(routing.store_partitions(df, scheme), scheme).rdd.glom().collect()
    assert len(parts) == 64 and all(r.node == i for i, p in enumerate(parts) for r in p)
    from pyspark.sql import Observation

    seen = Observation("rates")
    df.observe(seen, *metrics_counts()).count()
    assert seen.get == {"r": 100, "s": 0}
    assert metrics.observed_rates(df).count() == 100


def metrics_counts():
    from pyspark.sql import functions as F

    return F.count_if(F.col("side") == "R").alias("r"), F.count_if(F.col("side") == "S").alias("s")
