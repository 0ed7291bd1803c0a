"""Every strategy against a nested loop, over random bands, windows, ties and edges."""

import math
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from bandweave.operators.band_join import band_join
from bandweave.plans.spec import BandJoinSpec, parse_arguments
from bandweave.queries import lineitem_pairs
from bandweave.streaming.band_join import run_once, stream_band_join

SCHEMA = "id long, key double, ts_ms long"


def rows(rng, n, keys=(-5.0, -1.5, -1.0, -0.5, 0.0, 0.1, 0.25, 1.0, 2.0, 2.5, 99.5, 1e18, -1e18), span=40):
    return [(i, rng.choice(keys) if rng.random() < 0.6 else round(rng.uniform(-6, 6), 2), rng.randrange(span)) for i in range(n)]


def brute(r, s, spec):
    out = []
    for a in r:
        for b in s:
            if None in (a[1], a[2], b[1], b[2]):
                continue
            upper = a[1] <= b[1] + spec.surpass if spec.bounds == "closed" else a[1] < b[1] + spec.surpass
            if a[1] >= b[1] - spec.behind and upper and b[2] - spec.r_window <= a[2] <= b[2] + spec.s_window:
                out.append((a[0], b[0], max(a[2], b[2])))
    return sorted(out)


def got(df):
    return sorted((x.r.id, x.s.id, x.probe_ts) for x in df.collect())


SPECS = [
    BandJoinSpec(0, 0, 5, 7),
    BandJoinSpec(1, 1, 5, 5),
    BandJoinSpec(2, 1, 3, 11),
    BandJoinSpec(3, -1.5, 4, 0),
    BandJoinSpec(-0.5, 0.5, 9, 9),
    BandJoinSpec(1, 1, 6, 6, bounds="half_open"),
    BandJoinSpec(0.1, 0.2, 0, 0),
]


@pytest.mark.parametrize("strategy", ["auto", "range", "band_bucket", "time_bucket", "grid", "matrix"])
def test_strategies_equal_a_nested_loop(spark, strategy):
    rng = random.Random(strategy)
    for spec in SPECS:
        r, s = rows(rng, 40), rows(rng, 40)
        r += r[:3] + [(90, None, 3), (91, 1.0, None)]  # repeated rows multiply, nulls join nothing
        found = band_join(spark.createDataFrame(r, SCHEMA), spark.createDataFrame(s, SCHEMA), spec, strategy)
        assert got(found) == brute(r, s, spec), (strategy, spec)


def test_range_without_a_small_side(spark):
    """Ranges of time, each a loop of its own: nothing is refused, lost or met twice."""
    rng = random.Random(11)
    for spec in SPECS:
        r, s = rows(rng, 60) + [(90, None, 3), (91, 1.0, None)], rows(rng, 50)
        r += r[:3]
        found = band_join(spark.createDataFrame(r, SCHEMA), spark.createDataFrame(s, SCHEMA), spec, "range", range_rows=20)
        assert got(found) == brute(r, s, spec), spec
        assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_salted_buckets(spark):
    rng = random.Random(3)
    r, s, spec = rows(rng, 50, keys=(1.0,)), rows(rng, 50, keys=(1.0, 1.5)), SPECS[1]
    for cells in ((1, 3), (4, 2)):
        assert got(band_join(spark.createDataFrame(r, SCHEMA), spark.createDataFrame(s, SCHEMA), spec, "grid", cells)) == brute(r, s, spec)


def test_nan_and_infinite_keys(spark):
    r = [(1, math.nan, 0), (2, math.inf, 0), (3, -math.inf, 0), (4, 1.0, 0)]
    s = [(1, math.inf, 0), (2, math.nan, 0), (3, 1.5, 0)]
    spec = BandJoinSpec(1, 1)
    base = got(band_join(spark.createDataFrame(r, SCHEMA), spark.createDataFrame(s, SCHEMA), spec, "range"))
    assert (4, 3, 0) in base and (1, 2, 0) in base
    for strategy in ("band_bucket", "grid", "matrix"):
        found = got(band_join(spark.createDataFrame(r, SCHEMA), spark.createDataFrame(s, SCHEMA), spec, strategy))
        assert {(4, 3, 0), (1, 2, 0), (2, 1, 0)} <= set(found)


def test_edges(spark):
    """A key or time exactly on an edge matches, one beyond doesn't."""
    spec = BandJoinSpec(surpass=2, behind=1, r_window=10_000, s_window=20_000)
    cases = [(99, 100000, 1), (98.999, 100000, 0), (102, 100000, 1), (102.001, 100000, 0), (100, 90000, 1), (100, 89999, 0), (100, 120000, 1), (100, 120001, 0)]
    r = [(i, float(k), t) for i, (k, t, _) in enumerate(cases)]
    for strategy in ("range", "grid", "time_bucket", "matrix"):
        found = {x[0] for x in got(band_join(spark.createDataFrame(r, SCHEMA), spark.createDataFrame([(0, 100.0, 100000)], SCHEMA), spec, strategy))}
        assert found == {i for i, c in enumerate(cases) if c[2]}


def test_plan_has_no_nested_loop(spark):
    r, s = (spark.range(1000).selectExpr("id", "cast(id as double) as key", "id as ts_ms") for _ in range(2))
    for strategy in ("auto", "band_bucket", "time_bucket", "matrix"):
        plan = band_join(r, s, SPECS[1], strategy)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_larger_side_is_streamed(spark, tmp_path):
    """A line of S comes with all its partners in a bucket in one run, so files hold few values of S and short repeats of R's."""
    lines = spark.range(20_000).selectExpr("id as l_orderkey", "cast(id % 7 as int) as l_linenumber", "cast(xxhash64(id) % 10 as double) as key").where("key is not null")
    small, large = lines.where("l_orderkey % 40 = 0"), lines.where("l_orderkey % 40 > 30")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lineitem_pairs(small, large, 1).write.parquet(str(tmp_path / "pairs"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    pairs = runs = 0
    for f in (tmp_path / "pairs").glob("part-*"):
        s = pq.read_table(f).column("s_orderkey").to_numpy()
        pairs, runs = pairs + len(s), runs + (np.diff(s) != 0).sum() + 1
    assert pairs > 100_000 and runs <= 2 * large.count() + 4
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("part-*")) < pairs


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    # A stream's watermark starts at 1970, so the times must be later.
    r, s = (sorted(((i, k, 1_700_000_000_000 + t) for i, k, t in rows(rng, 60)), key=lambda x: x[2]) for _ in "rs")
    for name, x in (("r", r), ("s", s)):
        spark.createDataFrame(x, SCHEMA).coalesce(1).write.parquet(str(tmp_path / name))
    for strategy, spec in (("auto", SPECS[0]), ("grid", SPECS[1]), ("matrix", SPECS[2]), ("time_bucket", SPECS[3])):
        streams = (spark.readStream.schema(SCHEMA).parquet(str(tmp_path / name)) for name in "rs")
        assert got(run_once(stream_band_join(*streams, spec, strategy), "t")) == brute(r, s, spec)


def test_empty_sides(spark):
    empty, one = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, 1.0, 1)], SCHEMA)
    assert band_join(empty, one, SPECS[1]).count() == band_join(one, empty, SPECS[1]).count() == 0


def test_refused():
    for bad in (dict(surpass=-2, behind=1), dict(r_window=-1), dict(bounds="open"), dict(surpass=math.nan)):
        with pytest.raises(ValueError):
            BandJoinSpec(**bad)
    with pytest.raises(ValueError):
        SPECS[1].strategy("equi")
    with pytest.raises(ValueError):
        SPECS[1].strategy("magic")


def test_arguments():
    spec, r, s = parse_arguments("--rCopyNum 8 --sCopyNum 2 --R_surpass_S 1.5 --R_behind_S 0".split())
    assert (spec.surpass, spec.behind, r, s) == (1.5, 0, 8, 2)
    with pytest.raises(SystemExit):
        parse_arguments(["--rCopyNum", "8"])
