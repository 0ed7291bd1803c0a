"""Circulant MinHash near-duplicate detection, confirmed by exact Jaccard similarity on full shingle sets.

1. Every text becomes the set of its word shingles (64-bit hashes), and the set a signature: one permutation
   scatters the shingles, a second one, shifted round its circle by k, gives coordinate k. Bands of
   coordinates are bucket keys. As many bands are taken as leave a pair at the threshold without a common
   bucket with probability `miss`. `rows`, the coordinates of a band, is what to raise for corpora of billions:
   unlike texts of similarity s share a bucket with probability s**rows each, at the price of more bands.
2. Texts with equal sets become one node. In each bucket with several nodes one is the pivot, and the exact
   similarity of the others to it is taken. Jaccard distance is a metric: a node that is linked with one of
   similarity s to the pivot has s - (1 - threshold) or more itself. So nodes of `near` - (1 - threshold) or more join
   the pivot's cluster, nodes under `near` stay in the bucket for another pivot, and no link falls between.
   After `rounds` pivots the rest of a bucket is one cluster.
3. Nodes at the threshold or more from a pivot are linked for good. Within clusters, and only there, the other links are sought,
   between nodes that those links haven't joined yet: clusters that are one component are done, small ones meet whole, large ones
   in blocks of nodes of like set size, of which two that can hold links meet in one task. Blocks of the cluster's largest
   component don't meet each other, so a group of copies costs its size times what is left over, not its square. A
   task gives back no more than a spanning forest of its links, which is all that components need.
4. Components of all links, by distributed star steps over the components of the links to pivots; each document gets its node's.

Cases: ASCII letters are lower-cased first. A text with fewer words than a shingle has its whole sequence as its
one shingle; null, empty and wordless texts have none and are linked with nothing. Rows that repeat a doc_id
count as one document, whose set for links is the smallest of theirs (each row gets its result). A null doc_id has no component to
name: such rows are linked with nothing and kept, their component null. An empty table gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandweave.llm import words as W
from bandweave.llm.common import counted, dropped, in_arrow, map_arrow, written
from bandweave.llm.components import components, merged

U64, U32 = np.uint64, np.uint32


def shingles(t: W.Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of some texts, and where each text's begin. A text of fewer words than
    `width` has its whole sequence as one shingle, one without words has none."""
    h = W.hashed(t.data, t.starts, t.ends)
    n = np.diff(t.words)
    sizes = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(sizes)])
    first = np.repeat(t.words[:-1] - at[:-1], sizes) + np.arange(at[-1])  # the first word of each shingle
    length = np.minimum(np.repeat(n, sizes), width)
    out = np.zeros(at[-1], U64)
    for k in range(width):
        here = length > k
        out[here] = W.mix(out[here] * U64(0x9FB21C651E98DF25) + h[first[here] + k] + U64(k + 1))
    return out, at


def spread(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit integers (in place)."""
    x ^= x >> U32(16)
    x *= U32(0x7FEB352D)
    x ^= x >> U32(15)
    x *= U32(0x846CA68B)
    x ^= x >> U32(16)
    return x


def signature(shingle: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash: the first permutation scatters the shingles, the second, shifted by k places
    round the circle of 2**32, gives coordinate k."""
    scattered = (shingle ^ (shingle >> U64(32))).astype(U32)
    scattered = spread(scattered * U32(0x9E3779B1) + U32(0x3C6EF372))
    shift = np.arange(coordinates, dtype=U32)[:, None]
    least = np.full(coordinates, 0xFFFFFFFF, U32)
    for i in range(0, len(scattered), 2048):
        np.minimum(least, spread(scattered[None, i : i + 2048] + shift).min(axis=1), out=least)
    return least


def bands(sig: np.ndarray, count: int) -> np.ndarray:
    """A 64-bit key for each band of a signature."""
    rows = sig.reshape(count, -1).astype(U64)
    key = np.arange(1, count + 1, dtype=U64)
    for k in range(rows.shape[1]):
        key = W.mix(key * U64(0x9FB21C651E98DF25) + rows[:, k])
    return key


def band_count(percent: int, rows: int, miss: float) -> int:
    return max(1, math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows)))


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate([np.empty(0, np.int64), *(v.view(np.int64) for v in values)])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def signed(docs: DataFrame, width: int, rows: int, count: int) -> DataFrame:
    """(doc_id, n, hi, lo, bands): the size of each text's set, 128 bits that stand for the set, and its
    bucket keys (none for an empty set)."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, hi, lo, keys = [], [], [], []
            for t in W.texts(batch.column("text"), lower=True):
                h, at = shingles(t, width)
                for i in range(len(t)):
                    own = np.unique(h[at[i] : at[i + 1]])
                    n.append(len(own))
                    hi.append(int(W.mix(own).sum(dtype=U64).view(np.int64)))
                    lo.append(int(W.mix(own ^ U64(0xA5A5A5A55A5A5A5A)).sum(dtype=U64).view(np.int64)))
                    keys.append(bands(signature(own, rows * count), count) if len(own) else np.empty(0, U64))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), _lists(keys)], ["doc_id", "n", "hi", "lo", "bands"])

        return step

    return map_arrow(docs, make, "doc_id long, n long, hi long, lo long, bands array<long>")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(node, n, set) of docs (doc_id, text)."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = []
            for t in W.texts(batch.column("text"), lower=True):
                h, at = shingles(t, width)
                sets += [np.unique(h[at[i] : at[i + 1]]) for i in range(len(t))]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), _lists(sets)], ["node", "n", "set"])

        return step

    return map_arrow(docs, make, "node long, n long, set array<long>")


def met(many: DataFrame, one: DataFrame, key: str, hot: int, broadcast_rows: int) -> DataFrame:
    """many join one, which has a row for each key. Keys of more than `hot` rows are dealt to parts by the hash of the node, and their
    row of `one` is copied to these; there are no more such keys than rows / hot."""
    heavy, (n,) = counted(many.groupBy(key).count().where(F.col("count") > hot).select(key, F.ceil(F.col("count") / hot).cast("int").alias("_parts")), "heavy")
    if not n:
        return many.join(one, key)
    heavy = F.broadcast(heavy) if n <= broadcast_rows else heavy
    dealt = many.join(heavy, key, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64("node"), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    copied = one.join(heavy, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copied, [key, "_part"]).drop("_part")


def similarities(pairs: DataFrame, sets: DataFrame, hot: int, broadcast_rows: int) -> DataFrame:
    """pairs (pivot, node) with the sizes of intersection and union of their full sets."""
    one = pairs.join(sets.select("node", "n", F.col("set").alias("_set")), "node")
    pivots = pairs.select(F.col("pivot").alias("node")).distinct().join(sets, "node").select(F.col("node").alias("pivot"), F.col("n").alias("_pivot_n"), F.col("set").alias("_pivot_set"))
    both = met(one, pivots, "pivot", hot, broadcast_rows)
    common = both.withColumn("both", F.size(F.array_intersect("_set", "_pivot_set")).cast("long"))
    return common.select("pivot", "node", "both", (F.col("n") + F.col("_pivot_n") - F.col("both")).alias("either"))


def clustered(buckets: DataFrame, sets: DataFrame, percent: int, near: int, rounds: int, hot: int, broadcast_rows: int, used: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """buckets (band, node) -> edges (a, b) that hold together all nodes that a bucket's links can join, and those of them that
    are links. used: gets the tables that the edges are read from."""
    edges = linked = None
    for _ in range(rounds):
        pivots = buckets.groupBy("band").agg(F.min("node").alias("pivot"))
        pairs = written(met(buckets, pivots, "band", hot, broadcast_rows).where("node <> pivot"), "pairs")
        known = written(similarities(pairs.select("pivot", "node").distinct(), sets, hot, broadcast_rows), "similarities")
        pair = known.select(F.col("pivot").alias("a"), F.col("node").alias("b"), "both", "either")
        joined, link = (pair.where(f"100 * both >= {x} * either").select("a", "b") for x in (near - 100 + percent, percent))
        edges, linked = (joined, link) if edges is None else (edges.union(joined), linked.union(link))
        left = pairs.join(known.where(f"100 * both < {near} * either").select("pivot", "node"), ["pivot", "node"], "left_semi").select("band", "node")
        again = left.groupBy("band").agg(F.min("node").alias("_min"), F.max("node").alias("_max")).where("_min <> _max").select("band")
        buckets = written(left.join(again, "band"), "buckets")
        used += (pairs, known, buckets)
    rest = buckets.join(buckets.groupBy("band").agg(F.min("node").alias("pivot")), "band").where("node <> pivot")
    return edges.union(rest.select(F.col("pivot").alias("a"), F.col("node").alias("b"))), linked


def forest(set_of: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Positions of a spanning forest of the links between sets; where side has two values, of those
    between the sides."""
    size = np.array([len(x) for x in set_of])
    values, owner = np.concatenate(set_of), np.repeat(np.arange(len(size)), size)
    _, word = np.unique(values, return_inverse=True)
    shared = np.bincount(word)[word] > 1  # a shingle of one set counts for no pair
    word, owner = word[shared], owner[shared]
    names, word = np.unique(word, return_inverse=True)
    a, b = (np.flatnonzero(side == x) for x in (side.min(), side.max()))
    common = np.zeros((len(a), len(b)), np.float32)
    row = np.empty(len(size), np.int64)
    order = np.argsort(word, kind="stable")
    word, owner = word[order], owner[order]
    for lo in range(0, len(names), 4096):
        i, j = np.searchsorted(word, [lo, lo + 4096])
        has = np.zeros((len(size), min(4096, len(names) - lo)), np.float32)
        has[owner[i:j], word[i:j] - lo] = 1
        common += has[a] @ has[b].T
    x, y = np.nonzero(100 * common >= percent * (size[a][:, None] + size[b][None, :] - common))
    row = np.arange(len(size))

    def root(k: int) -> int:
        while row[k] != k:
            row[k] = k = row[row[k]]
        return k

    out = []
    for p, q in zip(a[x].tolist(), b[y].tolist(), strict=True):
        r, s = root(p), root(q)
        if r != s:
            row[max(r, s)] = min(r, s)
            out.append((p, q))
    return out


def links(clusters: DataFrame, sets: DataFrame, percent: int, block: int, block_shingles: int, used: list[DataFrame]) -> DataFrame:
    """clusters (node, cluster, part) -> edges (a, b) of forests of the links within clusters between nodes of different parts, and
    maybe of others. used: gets the tables that the edges are read from."""
    known = clusters.join(sets.select("node", "n"), "node")
    parts = known.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("_of"), F.sum("n").alias("_sum"))
    totals = parts.groupBy("cluster").agg(F.sum("_of").alias("_nodes"), F.sum("_sum").alias("_all"), F.count(F.lit(1)).alias("_parts"), F.max_by("part", F.struct("_of", "part")).alias("_main")).where("_parts > 1")
    # Linked sets differ in size by less than the threshold's factor, so by one grade at most.
    grade = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent)))
    whole = (F.col("_nodes") <= block) & (F.col("_all") <= block_shingles)
    graded = known.join(totals, "cluster").withColumn("grade", F.when(whole, -1).otherwise(grade).cast("int")).withColumn("main", ~whole & (F.col("part") == F.col("_main")))
    graded = written(graded.select("node", "cluster", "n", "grade", "main"), "graded")
    of = lambda main: F.ceil(F.greatest(F.count_if(F.col("main") == main) / F.lit(block), F.sum(F.when(F.col("main") == main, F.col("n")).otherwise(0)) / F.lit(block_shingles))).cast("int")
    counts = written(graded.groupBy("cluster", "grade").agg(of(True).alias("_m"), of(False).alias("_o")), "grades")
    used += (graded, counts)
    # A grade's blocks: those of the main component first.
    own = F.when(F.col("main"), F.pmod(F.xxhash64("node"), F.col("_m"))).otherwise(F.col("_m") + F.pmod(F.xxhash64("node"), F.col("_o"))).cast("int")
    beside = lambda d, name: counts.select("cluster", (F.col("grade") - d).alias("grade"), F.col("_m").alias(f"{name}_m"), F.col("_o").alias(f"{name}_o")).where("grade >= -1")
    placed = graded.join(counts, ["cluster", "grade"]).withColumn("own", own)
    placed = placed.join(beside(1, "_up").where("grade >= 0"), ["cluster", "grade"], "left").join(beside(-1, "_down").where("grade > 0"), ["cluster", "grade"], "left")
    place = lambda grade, i, up, j, side: F.struct(grade.alias("grade"), i.alias("i"), up.alias("up"), j.alias("j"), side.alias("side"))
    zero, one, g = F.lit(0), F.lit(1), F.col("grade")

    def blocks(name: str, make) -> Column:
        """make(j) for the blocks of a grade that a node meets: all of them, or those that aren't of the main component."""
        first, k = F.when(F.col("main"), F.col(f"{name}_m")).otherwise(0), F.col(f"{name}_m") + F.col(f"{name}_o")
        return F.when(first < k, F.transform(F.sequence(first, k - 1), make)).otherwise(F.expr("array()"))

    # Two blocks of a grade meet as (i, j), i <= j; those of neighbouring grades as (i below, j above).
    same = blocks("", lambda j: place(g, F.least("own", j), zero, F.greatest("own", j), F.when(F.col("own") <= j, 0).otherwise(1)))
    up = blocks("_up", lambda j: place(g, F.col("own"), one, j, zero))
    down = blocks("_down", lambda j: place(g - 1, j, one, F.col("own"), one))
    tasks = placed.select("node", "cluster", F.explode(F.concat(same, up, down)).alias("t")).select("node", "cluster", "t.*")
    key = ["cluster", "grade", "up", "i", "j"]
    dealt = tasks.join(sets.select("node", "set"), "node").repartition(*key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray]] = []
        now, out = None, ([], [])

        def finish() -> None:
            side = np.array([x[1] for x in held])
            if len(held) > 1 and not (now[2] and side.min() == side.max()):
                for p, q in forest([x[2] for x in held], side, percent):
                    out[0].append(held[p][0])
                    out[1].append(held[q][0])
            held.clear()

        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in key), strict=True))
            nodes, sides, column = batch.column("node").to_pylist(), batch.column("side").to_pylist(), batch.column("set")
            at, flat = column.offsets.to_numpy(), column.values.to_numpy()
            for r, k in enumerate(keys):
                if k != now:
                    if held:
                        finish()
                    now = k
                held.append((nodes[r], sides[r], flat[at[r] : at[r + 1]].copy()))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], ["a", "b"])
                out = ([], [])
        if held:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], ["a", "b"])

    return in_arrow(dealt, run, "a long, b long")


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, rows: int = 4, miss: float = 1e-7, near: int = 40, rounds: int = 2, block: int = 512, block_shingles: int = 400_000, broadcast_rows: int = 200_000, hot: int = 4096) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept). width: words of a shingle; percent: the least Jaccard
    similarity of a link; hot: rows of a key that go to one part of a join; the rest is in the module's description."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = written(signed(texts, width, rows, band_count(percent, rows, miss)), "signatures")
    signs = every.where("doc_id is not null")
    copies = written(signs.where("n > 0").groupBy("hi", "lo", "n").agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("_max")).where("node <> _max").drop("_max"), "copies")
    member = signs.join(copies, ["hi", "lo", "n"], "left").withColumn("node", F.coalesce("node", "doc_id"))
    banded = member.where("node = doc_id").select(F.explode("bands").alias("band"), "node")
    shared = banded.groupBy("band").agg(F.min("node").alias("_min"), F.max("node").alias("_max")).where("_min <> _max").select("band")
    buckets = written(banded.join(shared, "band").distinct(), "buckets")
    wanted, (n,) = counted(buckets.select(F.col("node").alias("doc_id")).distinct(), "candidates")
    chosen = texts.join(F.broadcast(wanted) if n <= broadcast_rows else wanted, "doc_id", "left_semi")
    sets = shingle_sets(chosen, width).groupBy("node").agg(F.min(F.struct("n", "set")).alias("_set")).select("node", "_set.n", "_set.set")
    sets = written(sets, "sets")
    used = [buckets, wanted, sets]
    edges, linked = clustered(buckets, sets, percent, near, rounds, hot, broadcast_rows, used)
    both = components(edges.withColumn("linked", F.lit(False)).union(linked.withColumn("linked", F.lit(True))), "linked")
    roots, parts = (both.where(F.col("linked") == x).drop("linked") for x in (False, True))
    whole = roots.select("node", F.col("root").alias("cluster")).union(roots.select(F.col("root").alias("node"), F.col("root").alias("cluster")).distinct())
    clusters = written(whole.join(parts, "node", "left").select("node", "cluster", F.coalesce("root", "node").alias("part")), "clusters")
    more = links(clusters, sets, percent, block, block_shingles, used)
    found = merged(parts, more).withColumnRenamed("root", "_root")
    for table in (*used, clusters):  # the result is read from signs, copies and the components
        dropped(table)
    component = F.coalesce("_root", "node")
    out = member.select("doc_id", "n", "node").join(found, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))
    alone = every.where("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(alone)


def deduplicated(docs: DataFrame, *, broadcast_rows: int = 200_000, **options) -> DataFrame:
    """One row of docs, all columns, for each group of near duplicates: that of the smallest doc_id; and all rows without one."""
    found = written(near_duplicates(docs, broadcast_rows=broadcast_rows, **options).where("doc_id is not null"), "near-duplicates")
    sized = lambda ids, n: F.broadcast(ids) if n <= broadcast_rows else ids
    repeated, (n,) = counted(found.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    gone, (of,) = counted(found.where("not kept").select("doc_id").distinct(), "dropped")
    out = docs.join(sized(gone, of), "doc_id", "left_anti")
    if n:
        repeated = sized(repeated, n)
        out = out.join(repeated, "doc_id", "left_anti").unionByName(out.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return out.select(*docs.columns)


#: The same rows in DuckDB's SQL for shingles of 3 words and 85 %.
ORACLE = """
with recursive words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x : x <> '') as w
  from documents),
sets as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)] end) as s from words),
sized as (select doc_id, len(s) as n from sets),
each as (select doc_id, unnest(s) as x from sets),
pairs as (
  select a.doc_id as u, b.doc_id as v, count(*) as n_both from each a join each b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
linked as (
  select u, v from pairs join sized a on a.doc_id = u join sized b on b.doc_id = v where 100 * n_both >= 85 * (a.n + b.n - n_both)),
edges as (select u, v from linked union all select v, u from linked),
reached as (
  select doc_id, doc_id as at from sized
  union
  select r.doc_id, e.v from reached r join edges e on e.u = r.at)
select s.doc_id, cast(s.n as bigint) as n_shingles, min(r.at) as component_id, min(r.at) = s.doc_id as kept
from sized s join reached r on r.doc_id = s.doc_id group by s.doc_id, s.n
"""
