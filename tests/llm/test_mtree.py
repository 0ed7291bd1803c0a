import math

import duckdb
import numpy as np
import pytest

from bandweave.llm import mtree as M

SCHEMA = "vec_id long, embedding array<float>, label int, far double, page int"


def brute(rows, k, every):
    """Every row with a fit vector counts; a query id's scores are those of all its rows."""
    fit = [(i, np.floor(64 * np.array(v, np.float32).astype(float))) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = max((len(v) for _, v in fit), default=0)
    fit = [(i, np.concatenate([v, np.zeros(size - len(v))])) for i, v in fit]
    out = []
    for q in sorted({i for i, _ in fit if i % every == 0}):
        score = sorted((-int(v @ w), j) for i, v in fit if i == q for j, w in fit if j != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(score)]
    return sorted(out)


def clustered(n, dims, seed, spread=0.2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    return [(i, (centres[i % 6] * (1 + i % 3) + spread * rng.normal(size=dims)).tolist(), 0, 0.0, 0) for i in range(n)]


@pytest.mark.parametrize("options", [dict(), dict(page_rows=20, near=1, fanout=3), dict(page_rows=15, block_bytes=300, group_bytes=900, near=2)])
def test_equals_brute_force(spark, options):
    rows = clustered(400, 8, len(options))
    rows += [(1000 + i, rows[0][1], 0, 0.0, 0) for i in range(70)]  # ties beyond k
    rows += [(2000, None, 0, 0.0, 0), (2020, [1.0, None] * 4, 0, 0.0, 0), (2040, [math.nan] * 8, 0, 0.0, 0), (2060, [math.inf] * 8, 0, 0.0, 0), (2080, [0.5, -0.5], 0, 0.0, 0), (2100, [], 0, 0.0, 0), rows[40], (None, [1.0] * 8, 0, 0.0, 0)]
    got = sorted(tuple(r) for r in M.search(spark.createDataFrame(rows, SCHEMA), **options).collect())
    assert got == brute(rows, 20, 20)


def test_few_rows(spark):
    rows = clustered(3, 4, 1)
    assert sorted(tuple(r) for r in M.search(spark.createDataFrame(rows, SCHEMA)).collect()) == brute(rows, 20, 20)
    for few in (rows[:1], [], [(0, None, 0, 0.0, 0)]):
        assert M.search(spark.createDataFrame(few, SCHEMA)).count() == 0


def test_rows_that_repeat_a_vec_id(spark):
    rows = [(20, None), (20, [2.0, 2.0]), (20, [2.0, 2.0]), (20, [-3.0, 1.0]), (40, [1.0, 0.0])] + [(i, [i / 7, 1.0]) for i in range(1, 9)]
    want = brute(rows, 5, 20)
    for n, data in ((1, rows), (2, rows[::-1]), (7, rows)):
        df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(n)
        assert sorted(tuple(r) for r in M.search(df, k=5, page_rows=8).collect()) == want


def test_equal_vectors_and_large_components(spark):
    """A third of all vectors is one; components of 1e4, where distances are differences of numbers of 1e13."""
    rng = np.random.default_rng(8)
    rows = [(i, [5.0] * 4 if i % 3 else (1e4 * rng.normal(size=4)).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in M.search(df, page_rows=30, group_bytes=2000).collect()) == brute(rows, 20, 20)


def tree_of(spark, rows, **options):
    data, dims, most = M.vectors(spark.createDataFrame(rows, SCHEMA), 64.0)
    return M.Tree(data, dims, most, **({"fanout": 4, "page_rows": 16, "group": 100, "seed": 5} | options))


def test_nodes_cover_what_is_under_them(spark):
    rows = clustered(400, 5, 3)
    tree = tree_of(spark, rows)
    assert tree.depth > 1
    entries, pages = {e.node: e for e in tree.entries.collect()}, tree.pages.collect()
    assert sorted(p.vec_id for p in pages) == [r[0] for r in rows]
    lift = lambda v: M.lifted(np.array([v]), tree.most)
    count = {}
    for p in pages:
        count[p.node] = count.get(p.node, 0) + 1
        node = p.node
        assert abs(p.far - M.distances(lift(p.v), lift(entries[node].v))[0, 0]) < 1e-6
        while node:
            e = entries[node]
            d = M.distances(lift(p.v), lift(e.v))[0, 0]
            assert e.least - 1e-6 <= d <= e.most + 1e-6
            if e.parent:
                assert abs(e.to_parent - M.distances(lift(e.v), lift(entries[e.parent].v))[0, 0]) < 1e-6
            node = e.parent
    assert max(count.values()) <= 16 and {n for n, e in entries.items() if e.n <= 16} == set(count)


def test_bounds_spare_work_and_lose_nothing(spark):
    rows = clustered(600, 5, 2, spread=0.02)
    tree = tree_of(spark, rows, page_rows=32)
    pages = {}
    for p in tree.pages.collect():
        pages.setdefault(p.node, []).append(p.v)
    e = tree.entries.where("parent = 0").collect()
    routers = M.lifted(np.array([x.v for x in e]), tree.most)
    q = M.asking(np.array([v for v in next(iter(pages.values()))[:9]]))
    arrays = [np.array([x[c] for x in e]) for c in ("to_parent", "least", "most")]
    _, low = M.bounds(q, np.zeros(len(q)), np.full(len(q), np.inf), routers, *arrays)
    for at, x in enumerate(e):
        under = [v for n, vs in pages.items() if n == x.node or str(bin(n)).startswith(bin(x.node)) for v in vs if n >> 8 == x.node or n == x.node]
        if under:
            assert (low[:, at] <= M.distances(q, M.lifted(np.array(under), tree.most)).min(axis=1) + 1e-6).all()
    _, near = M.bounds(q, np.zeros(len(q)), low.min(axis=1) + 1e-3, routers, *arrays)
    assert np.isfinite(near).mean() < 1


def test_pages_are_copied_to_those_who_ask(spark):
    tree = tree_of(spark, clustered(400, 5, 3))
    queries = tree.pages.where("vec_id % 20 = 0").select("row", M.F.col("vec_id").alias("query_id"), "v").withColumn("floor", M.F.lit(None).cast("long"))
    blocks = tree.descend(M.at_root(queries, tree.dims, False, 8), 8, 1, 1)
    asked = blocks.select("node").distinct().count()
    assert 0 < asked < tree.pages.select("node").distinct().count()
    assert tree.pages.join(blocks.select("node").distinct(), "node").count() < tree.pages.count()


def test_sql(spark):
    rows = clustered(200, 4, 5) + [(2000, None, 0, 0.0, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding float[])")
    con.executemany("insert into embeddings values (?, ?)", [r[:2] for r in rows])
    want = con.execute(f"select query_id, rank, vec_id, score from ({M.ORACLE})").fetchall()
    assert sorted(tuple(r) for r in M.search(df).collect()) == sorted(want)


def test_vectors_of_queries_go_once_to_sibling_pages(spark):
    """What a descent makes, which a task holds: the vectors of a block once for up to 32 pages of a node, not for each page."""
    rows = clustered(600, 32, 4)
    tree = tree_of(spark, rows, fanout=64)
    queries = tree.pages.where("vec_id % 3 = 0").select("row", M.F.col("vec_id").alias("query_id"), "v").withColumn("floor", M.F.lit(None).cast("long"))
    blocks = tree.descend(M.at_root(queries, tree.dims, False, 50), 50, 1, None)
    pages, asked = tree.pages.select("node").distinct().count(), blocks.select("node").distinct().count()
    made = blocks.agg(M.F.sum(M.F.length("v"))).first()[0]
    assert asked == pages > 30  # all are open without a floor
    assert made < 200 * 8 * 32 * pages / 4


@pytest.mark.parametrize("size", [0.1, 100, 1e4, 1e6])
def test_small_blocks_and_large_components(spark, size):
    """Whatever a step may make, and whatever type holds the vectors."""
    rng = np.random.default_rng(int(size))
    rows = [(i, (size * rng.normal(size=3)).astype(np.float32).tolist()) for i in range(250)]
    ints = [[math.floor(64 * x) for x in v] for _, v in rows]
    want = []
    for q in range(0, 250, 20):
        score = sorted((-sum(a * b for a, b in zip(ints[q], ints[i], strict=True)), i) for i in range(250) if i != q)[:7]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(score)]
    got = M.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=7, page_rows=6, fanout=40, made_bytes=20_000, group_bytes=1000)
    assert sorted(tuple(r) for r in got.collect()) == want
