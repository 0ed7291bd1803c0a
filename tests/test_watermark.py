"""Late rows and state: what the watermark drops and what a larger delay keeps."""

import pytest

from bandweave.plans.spec import BandJoinSpec
from bandweave.streaming.band_join import run_once, stream_band_join, with_watermark

DAY = 1_700_000_000_000
SCHEMA = "id long, key double, ts_ms long"


def stream(spark, path, *batches):
    """A stream that reads one batch after the other."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/{i}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{path}/*")


@pytest.mark.parametrize(("delay_ms", "want"), [(500, {(1, 1), (2, 2)}), (10_000_000, {(1, 1), (2, 2), (3, 1)})])
def test_late_rows(spark, tmp_path, delay_ms, want):
    # A batch works with the watermark of those before it, so the late row comes two batches after.
    spec = BandJoinSpec(surpass=1, behind=1, r_window=1000, s_window=1000)
    r = stream(spark, tmp_path / "r", [(1, 1.0, DAY)], [(2, 5.0, DAY + 1_000_000)], [(5, 80.0, DAY + 1_000_020)], [(3, 1.0, DAY + 1)])
    s = stream(spark, tmp_path / "s", [(1, 1.5, DAY + 10)], [(2, 5.5, DAY + 1_000_010)], [(4, 50.0, DAY + 1_000_020)], [(6, 60.0, DAY + 1_000_030)])
    got = run_once(stream_band_join(r, s, spec, delay_ms=delay_ms), "late")
    assert {(x.r.id, x.s.id) for x in got.collect()} == want


def test_event_time(spark):
    df = with_watermark(spark.createDataFrame([(1, 1.0, DAY + 179)], SCHEMA))
    assert df.selectExpr("unix_millis(event_time) as t").first().t == DAY + 179
