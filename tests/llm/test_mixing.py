import random

import duckdb
import pytest

from bandweave.llm import mixing as M


def by_hand(sizes, weights=(1, 2, 3), cap=3):
    """Targets by handing the excess over again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = total - sum(cap * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        t = {s: cap * sizes[s] if s in full else free * w[s] / sum(w[x] for x in open_) for s in names}
        over = {s for s in open_ if t[s] > cap * sizes[s]}
        if not over:
            return t
        full |= over


def rows(rng, sources):
    return [(i, " ".join("w" for _ in range(rng.choice([0, 1, 3, 10, 40]))) or rng.choice([None, ""]), rng.choice(sources)) for i in range(300)]


@pytest.mark.parametrize("sources", [["a"], ["a", "b", None], ["é", "z", "a", "Z", "😀", None, "b", "c"] + ["big"] * 30])
def test_targets_cuts_and_sql(spark, sources):
    rng = random.Random(len(sources))
    data = rows(rng, sources)
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(5)
    got = M.mix_digests(docs, range_rows=16).collect()
    sizes, taken = {}, {}
    of = {i: s for i, _, s in data}
    for r in got:
        sizes[of[r.doc_id]] = sizes.get(of[r.doc_id], 0) + r.size
        taken[of[r.doc_id]] = taken.get(of[r.doc_id], 0) + r.taken
        assert 0 <= r.taken <= 3 * r.size and r.size == len((data[r.doc_id][1] or "").split())
    want = by_hand(sizes)
    for r in got:
        assert r.source_size == sizes[of[r.doc_id]] and r.target == pytest.approx(want[of[r.doc_id]])
    for s in sizes:
        assert 0 <= want[s] - taken[s] < 1 + 1e-6
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    columns = ["doc_id", *M.ADDED]
    assert sorted(tuple(r) for r in got) == sorted(con.execute(f"select {', '.join(columns)} from ({M.ORACLE})").fetchall())
    assert sorted(tuple(r) for r in M.mix_digests(docs.repartition(2)).collect()) == sorted(tuple(r) for r in got)


def test_rows_of_the_mix(spark):
    docs = spark.createDataFrame([(i, "w " * 5, "a" if i < 90 else "b", i) for i in range(100)], "doc_id long, text string, source string, taken long")
    out = M.mixed(docs)
    assert out.columns == docs.columns
    counts = {}
    for r in out.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert {counts[i] for i in range(90, 100)} == {3}  # b's weight is 2 of 3, its cap 3 epochs
    assert sum(n for i, n in counts.items() if i < 90) == 70 and max(counts.values()) == 3


def test_odd_rows(odd_documents, documents):
    got = M.mix_digests(odd_documents).collect()
    assert len(got) == odd_documents.count() and sum(r.taken for r in got) == sum(r.size for r in got)
    assert M.mix_digests(odd_documents.limit(0)).count() == 0
    wordless = M.mix_digests(documents([(1, ""), (2, None)])).collect()
    assert [(r.size, r.target, r.taken) for r in wordless] == [(0, 0.0, 0)] * 2
    assert M.mix(odd_documents).columns == [*(c for c in odd_documents.columns if c != "size"), *M.ADDED, "copies"]


def test_plan_is_native(odd_documents):
    plan = M.mix_digests(odd_documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_names_that_clash_are_carried(documents, spark):
    docs = documents([(i, "w " * (i % 7)) for i in range(50)]).selectExpr("*", "doc_id + 1 as _key", "'x' as _source", "doc_id as row", "2 as range", "3 as copies", "4 as whole", "5 as part")
    got = {r.doc_id: r for r in M.mixed(docs).collect()}
    assert M.mixed(docs).columns == docs.columns and all((r._key, r._source, r.row, r.range, r.copies, r.whole, r.part) == (i + 1, "x", i, 2, 3, 4, 5) for i, r in got.items())
    out = M.mix(docs)
    assert out.columns == [*(c for c in docs.columns if c not in (*M.ADDED, "copies")), *M.ADDED, "copies"]
    assert all((r._key, r.row) == (r.doc_id + 1, r.doc_id) for r in out.collect())


def test_hot_ids_are_split(spark):
    """Two thirds of all rows have no id or one id."""
    docs = spark.range(3000).selectExpr("case when id % 3 = 0 then null when id % 3 = 1 then 4L else id end as doc_id", "repeat('w ', 1 + cast(id % 4 as int)) as text", "if(id % 3 = 2, 'b', 'a') as source")
    got = M.mix_digests(docs, range_rows=16).collect()
    a, b = ([r for r in got if (r.doc_id in (None, 4)) == x] for x in (True, False))
    for rows in (a, b):
        assert sum(r.taken for r in rows) == int(rows[0].target) and {r.source_size for r in rows} == {sum(r.size for r in rows)}
        low = min(r.taken // r.size for r in rows)
        assert sum(r.taken % r.size > 0 for r in rows) <= 1 and all(r.taken // r.size in (low, low + 1) for r in rows)
    assert sorted(map(str, got)) == sorted(map(str, M.mix_digests(docs, range_rows=16).collect()))
