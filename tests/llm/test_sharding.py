import re
import zlib
from collections import Counter

import pyarrow.parquet as pq
import pytest

from bandweave.llm import sharding as S


@pytest.mark.parametrize("n", [0, 1, 39, 40, 41, 1000])
def test_rows_law(spark, n):
    df = spark.range(n).selectExpr("id as doc_id", "concat('t', id) as text")
    got = S.shard_digests(df).collect()
    assert sorted(r.doc_id for r in got) == list(range(n))
    for r in got:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(f"t{r.doc_id}") + 16, zlib.crc32(f"t{r.doc_id}".encode()), "rows", None)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(40))
    counts = [len(slots.get(s, [])) for s in range(40)]
    assert max(counts) - min(counts) <= 1


def test_same_again_and_by_seed(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "'t' as text")
    order = lambda d: [r.doc_id for r in d.orderBy("_position").collect()]
    one, two = order(S.two_pass_shuffle(df, "doc_id")), order(S.two_pass_shuffle(df.repartition(7), "doc_id"))
    assert one == two != order(S.two_pass_shuffle(df, "doc_id", seed=1))
    assert order(S.two_pass_shuffle(df, "doc_id", bucket_bytes=96 * 100)) != one  # more buckets
    # A uniform order: neighbours in it are far apart, and each place of a bucket gets each rank alike.
    assert abs(sum(abs(a - b) for a, b in zip(one, one[1:])) / 2999 - 1000) < 60
    where = Counter((x // 300, i // 300) for i, x in enumerate(one))
    assert len(where) == 100 and max(where.values()) < 70


def test_odd_rows(odd_documents, tmp_path, spark):
    got = S.shard_digests(odd_documents).collect()
    assert len(got) == odd_documents.count()
    assert {(r.size, r.text_crc32) for r in got if r.doc_id in (0, 9)} == {(16, 0)}
    whole = S.shard(odd_documents, "doc_id", 3)
    assert whole.columns == [*odd_documents.columns, "shard", "slot"]
    S.write_shards(whole, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == odd_documents.count() and {r.shard for r in back.select("shard").collect()} == {0, 1, 2}


def test_plan_is_native(odd_documents):
    plan = S.shard(odd_documents, "doc_id", 40, bucket_bytes=50_000)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("passthrough") == 1


def test_whole_documents_are_shuffled_and_written(spark, tmp_path):
    docs = spark.range(120).selectExpr("id as doc_id", "repeat(concat('t', id % 10), 50000) as text", "array(repeat('u', 10)) as more", "id as _position", "1 as Slot")
    plan = S.two_pass_shuffle(docs, "doc_id", bucket_bytes=1 << 20)._jdf.queryExecution().executedPlan().toString()
    buckets = int(re.search(r"passthrough\(.*?, (\d+)\)", plan)[1])
    assert 11 <= buckets <= 24  # 12 to 18 MB of texts
    got = S.shard_digests(docs, bucket_bytes=1 << 20, path=str(tmp_path / "out")).collect()
    assert {(r.doc_id, r.text_crc32) for r in got} == {(i, zlib.crc32((f"t{i % 10}" * 50_000).encode())) for i in range(120)}
    place = {r.doc_id: (r.shard, r.slot) for r in got}
    for shard in range(40):  # the files of a shard, by name, hold its slots in order
        files = sorted((tmp_path / "out" / f"shard={shard}").glob("part-*"))
        rows = [r for f in files for r in pq.read_table(f, partitioning=None).to_pylist()]
        assert [(r["doc_id"], r["slot"]) for r in rows] == [(d, s) for d, (h, s) in sorted(place.items(), key=lambda x: x[1]) if h == shard]
        assert all(r["text"] == f"t{r['doc_id'] % 10}" * 50_000 and r["_position"] == r["doc_id"] for r in rows)


def test_hot_ids_and_equal_rows_fill_no_bucket(spark):
    """A third of all rows has one id, and as many are equal in all columns; 211 partitions."""
    docs = spark.range(0, 3000, 1, 211).selectExpr("case when id % 3 = 0 then null when id % 3 = 1 then 7L else id end as doc_id", "if(id % 3 = 1, 'same', concat('t', id)) as text")
    made = S.two_pass_shuffle(docs, "doc_id", bucket_bytes=20_000)
    sizes = [n for n in made.groupBy(S.F.spark_partition_id()).count().toPandas()["count"] if n]
    assert len(sizes) > 12 and max(sizes) < 3 * 3000 / len(sizes)
    assert sorted(r[0] for r in made.select("_position").collect()) == list(range(3000))
    got = S.shard_digests(docs, bucket_bytes=20_000).collect()
    assert Counter(r.doc_id for r in got)[7] == 1000 and {n for n in Counter(r.shard for r in got).values()} == {75}
