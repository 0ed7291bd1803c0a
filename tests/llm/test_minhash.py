import random
import re

import numpy as np
import pyarrow as pa
import pytest

from bandweave.llm import minhash as M
from bandweave.llm import words as W
from bandweave.llm.components import components, merged


def shingle_set(text, width):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()


def brute(rows, width, percent):
    """(shingles, smallest doc_id reachable) by comparing all pairs."""
    sets = {i: shingle_set(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                a_, b_ = find(a), find(b)
                root[max(a_, b_)] = min(a_, b_)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed, groups=12, copies=14, size=60):
    """Groups of texts that drift away from each other, so that many pairs are close to the threshold."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    for _ in range(groups):
        now = [word() for _ in range(size + rng.randrange(40))]
        for _ in range(copies):
            if rng.random() < 0.3:
                texts.append(" ".join(now).upper() if rng.random() < 0.5 else "  ".join(now))
            now = list(now)
            for _ in range(rng.randrange(3)):
                now[rng.randrange(len(now))] = word()
            if rng.random() < 0.2:
                now = now[: -rng.randrange(1, 8)]
            texts.append(" ".join(now))
    rng.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("width", "percent", "options"), [(3, 85, {}), (5, 80, {}), (3, 85, dict(block=4, rounds=1, hot=5)), (3, 60, dict(block=5, block_shingles=200, rounds=3, broadcast_rows=0))])
def test_equals_all_pairs(documents, width, percent, options):
    rows = near_copies(percent + width, groups=8 if options else 12)
    got = M.near_duplicates(documents(rows), width=width, percent=percent, **options).collect()
    want = brute(rows, width, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert 1 < len({c for _, c in want.values()}) < len(rows)


def test_one_large_group(documents):
    """Copies of one text with edits of all degrees, more than a block holds, and exact copies."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(150):
        t = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 8, 14])):
            t[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_duplicates(documents(rows), width=3, percent=85, block=16).collect()}
    assert got == brute(rows, 3, 85)


def test_odd_rows(odd_documents, spark):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(odd_documents, width=3, percent=85).collect()}
    rows = {r.doc_id: r.text for r in odd_documents.collect()}
    want = brute(list(rows.items()), 3, 85)
    assert got == {(i, n, c, c == i) for i, (n, c) in want.items()}
    assert M.near_duplicates(odd_documents.limit(0)).count() == 0
    out = M.deduplicated(odd_documents, width=3, percent=85)
    assert out.columns == odd_documents.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, (_, c) in want.items() if c == i)  # the row that is there twice stays once


def test_signature_estimates_similarity():
    rng = np.random.default_rng(4)
    for n in (800, 200, 35):
        both = rng.integers(0, 2**63, 400, dtype=np.uint64)
        a, b = (np.concatenate([both, rng.integers(0, 2**63, n, dtype=np.uint64)]) for _ in "ab")
        true = 400 / (400 + 2 * n)
        assert abs((M.signature(a, 512) == M.signature(b, 512)).mean() - true) < 0.08
    x = np.arange(1 << 16, dtype=np.uint32)
    assert len(np.unique(M.spread(x.copy()))) == 1 << 16


def test_band_count():
    for percent in (60, 80, 85, 95):
        n = M.band_count(percent, 4, 1e-7)
        assert (1 - (percent / 100) ** 4) ** n <= 1e-7 < (1 - (percent / 100) ** 4) ** (n - 1)


def test_shingles():
    texts = ["a b c d", "a b", "a", "", "A  b\tc d", "b a"]
    t = next(W.texts(pa.array(texts), lower=True))
    h, at = M.shingles(t, 3)
    sets = [set(h[at[i] : at[i + 1]].tolist()) for i in range(len(t))]
    assert list(map(len, sets)) == [2, 1, 1, 0, 2, 1] and sets[0] == sets[4] and sets[1] != sets[5]


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, i) for i in range(5001, 5100)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root if find(i) != i}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    # Two graphs together, one of them a part of the other; and the rest of its edges added later.
    table = spark.createDataFrame([(x, a, b) for i, (a, b) in enumerate(edges) for x in ("all", "half")[: 1 + i % 2]], "which string, a long, b long")
    both = components(table, "which")
    half = both.where("which = 'half'").drop("which")
    assert {r.node: r.root for r in both.where("which = 'all'").collect()} == got
    assert {r.node: r.root for r in half.collect()} == {r.node: r.root for r in components(table.where("which = 'half'").drop("which")).collect()}
    later = merged(half, spark.createDataFrame(edges[::2], "a long, b long")).collect()
    assert {r.node: r.root for r in later} == got and len(later) == len(got)
    assert merged(half, spark.createDataFrame([], "a long, b long")).count() == half.count()


def test_rows_without_id(documents):
    rows = [(1, "a b c d"), (2, "a b c d"), (None, "a b c d"), (None, "a b c d"), (None, None), (3, "x y z")]
    got = [tuple(r) for r in M.near_duplicates(documents(rows), width=3, percent=85).collect()]
    want = [(1, 2, 1, True), (2, 2, 1, False), (3, 1, 3, True), (None, 2, None, True), (None, 2, None, True), (None, 0, None, True)]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = sorted((r.doc_id, r.text) for r in M.deduplicated(documents([*rows, (1, "a b c d")]), width=3, percent=85).collect() if r.doc_id is not None)
    assert kept == [(1, "a b c d"), (3, "x y z")]
    assert M.deduplicated(documents([*rows, (1, "a b c d")]), width=3, percent=85).where("doc_id is null").count() == 3


def test_rows_that_repeat_an_id(documents):
    """Whatever the order of the rows, the smallest set of an id is the one that is compared."""
    base = [f"b{i}" for i in range(60)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:-1], "x"])), (2, " ".join(f"c{i}" for i in range(80))), (3, " ".join(f"c{i}" for i in range(79)))]
    results = {tuple(sorted(map(tuple, M.near_duplicates(documents(order).repartition(n), width=3, percent=85).collect()))) for order, n in ((rows, 1), (rows[::-1], 3))}
    assert len(results) == 1
    assert {r[2] for r in next(iter(results)) if r[0] in (1, 2) and r[1] == 58} == {1}


def test_a_group_that_is_linked_to_its_pivot_is_not_compared_again(spark, documents):
    """Copies with one changed word each, far more than a block holds: no sets travel after the pivots."""
    rng = random.Random(2)
    base = [f"b{i}" for i in range(100)]
    rows = [(i, " ".join([*base[: (k := rng.randrange(100))], f"x{i}", *base[k + 1 :]])) for i in range(200)]
    docs = documents(rows)
    sets = M.shingle_sets(docs.select("doc_id", "text"), 3)
    seen = []
    links, M.links = M.links, lambda clusters, *a: (seen.append(clusters.groupBy("cluster").agg(M.F.count_distinct("part").alias("n")).where("n > 1").count()), links(clusters, *a))[1]
    try:
        got = M.near_duplicates(docs, width=3, percent=85, block=16, hot=20).collect()
    finally:
        M.links = links
    assert {r.component_id for r in got} == {0} and sets.count() == 200 and seen == [0]
