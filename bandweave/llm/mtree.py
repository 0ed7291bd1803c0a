"""Exact top-k inner products by best-first search of a distributed M-tree.

Integer vectors v get one more component, sqrt(M - |v|^2) with M the largest squared norm, queries get 0 there: then
|q - v|^2 = |q|^2 + M - 2 <q, v>, so the largest inner products are the nearest neighbours in a metric.

Tree: a node of more than `page_rows` vectors is split by distance. Some of its own vectors, drawn by hash, become the routers of
its children (`fanout` at most), and every vector goes to the nearest; equal routers share theirs. This repeats level by level, in
groups of (node, salt), until every leaf is a page of `page_rows` at most, so routers grow with the table and a node with a third
of all vectors is no larger task than others. An entry holds a node's router, the router's distance to the parent's,
the covering radius and the least distance of all vectors under it; a vector in a page holds its distance to the page's router.
Entries and pages are tables, met by (siblings, group of queries); each is copied to the groups that ask for it and no others.
A block of queries takes its vectors along once to all inner nodes under a node, and once to each 32 pages there (a carrier); each child
has a row of places in it. Lower nodes are split as widely as they can be, so that few carriers are needed.
Blocks are as small as what a step can make of them demands, so no task holds more than about `made_bytes` of results.
Vectors travel as the smallest integers that hold them all.

Search, in two descents of blocks of queries. The first follows each query's best entries to its `near` most promising pages, and the
k-th best score there bounds its radius. The second opens every entry whose bound lies within. Stored distances spare
computations twice by the triangle inequality: |d(q, parent) - d(router, parent)| - radius passes over a node without
its distance, |d(q, router) - d(v, router)| over a vector. Results are exact; drawn routers only shape the tree.

Cases: vectors that are null or hold a null, NaN or infinite component take no part, as queries or candidates, nor do rows without
vec_id; shorter vectors count as filled up with zeros. Every row that repeats a vec_id is a candidate of its own, though not for
queries of the same vec_id; a vec_id that several query rows have gets the k best of all their scores. Ties go to the smaller
vec_id. With fewer than k candidates all are returned. An empty table gives an empty result. Columns other than vec_id and
embedding are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandweave.llm.common import dropped, in_arrow, map_arrow, parts, written
from bandweave.llm.words import mix

#: Children's numbers take this many bits of a node's; the root is 0.
BITS = 8
#: Pages whose numbers differ in so many bits only are met together.
SIBLINGS = 5
#: Types of components: NumPy's, and the squared norm below which all components fit.
KINDS = {"tinyint": (np.int8, 2.0**14), "smallint": (np.int16, 2.0**30), "int": (np.int32, 2.0**60), "double": (np.float64, np.inf)}


def integers(column: pa.Array, scale: float, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their vectors floor(scale * x) as float64, filled up to dims)."""
    column = column.cast(pa.large_list(pa.float64()))
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    size = np.diff(offsets)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    fit = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False) & (bad[offsets[1:]] == bad[offsets[:-1]]))
    out = np.zeros((len(fit), max(dims, int(size[fit].max(initial=0)))))
    for n in np.unique(size[fit]):
        rows = np.flatnonzero(size[fit] == n)
        out[rows, :n] = flat[offsets[fit[rows]][:, None] + np.arange(n)]
    return fit, np.floor(scale * out)


def vectors(table: DataFrame, scale: float) -> tuple[DataFrame, int, float]:
    """Table (row, vec_id, v array) of integer vectors, v of the smallest type of KINDS that holds them all, row a number of its own
    for each, the dimension, and the largest squared norm."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            fit, v = integers(batch.column("embedding"), scale, 0)
            return pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(fit)), pa.array(list(v), pa.list_(pa.float64())), pa.array((v * v).sum(axis=1))], ["vec_id", "v", "norm"])

        return step

    known = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null")
    made = written(map_arrow(known, make, "vec_id long, v array<double>, norm double").withColumn("row", F.monotonically_increasing_id()), "vectors")
    top = made.agg(F.max("norm").alias("m"), F.max(F.size("v")).alias("d")).first()
    kind = next(k for k, (_, squared) in KINDS.items() if (top.m or 0.0) < squared)
    return made.select("row", "vec_id", F.col("v").cast(f"array<{kind}>").alias("v")), top.d or 0, top.m or 0.0


def kind_of(table: DataFrame) -> str:
    """Of KINDS, what the vectors of a table are in."""
    return table.schema["v"].dataType.elementType.simpleString()


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    return integers(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, 1.0, dims)[1]


def lifted(v: np.ndarray, most: float) -> np.ndarray:
    """v with the component that makes inner products distances."""
    return np.concatenate([v, np.sqrt(np.maximum(0.0, most - (v * v).sum(axis=1)))[:, None]], axis=1)


def asking(v: np.ndarray) -> np.ndarray:
    return np.concatenate([v, np.zeros((len(v), 1))], axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T))


def slack(dims: int, most: float) -> float:
    """Of rounding, on distances: these are roots of differences of squares of up to `most`, and travel as floats."""
    return 4 * float(np.sqrt(np.finfo(float).eps * (dims + 2) * (most + 1))) + 2.0**-21 * float(np.sqrt(most + 1))


def radius_of(q: np.ndarray, score: np.ndarray, most: float) -> np.ndarray:
    """The distance that an inner product means for each query; infinite for -inf."""
    return np.sqrt(np.maximum(0.0, (q * q).sum(axis=1) + most - 2 * score))


def nearest(v: np.ndarray, routers: np.ndarray, row: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The router of each vector and the distance to it; equal routers share their vectors by a hash of the rows."""
    own, kind = np.unique(routers, axis=0, return_inverse=True)
    kind = kind.ravel()
    d = distances(v, own)
    which = d.argmin(axis=1)
    order, n = np.argsort(kind, kind="stable"), np.bincount(kind)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    deal = (mix(row.astype(np.uint64) + np.uint64(seed) * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(1)).astype(np.int64)
    return order[first[which] + deal % n[which]], d[np.arange(len(v)), which]


def bounds(q: np.ndarray, far: np.ndarray, reach: np.ndarray, routers: np.ndarray, to_parent: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For queries at `far` from a node's router, and its entries: the distance to an entry's router where it had to be computed, and
    the least distance that a vector under it can have, infinite where that is out of reach."""
    d, low = np.full((len(q), len(routers)), np.nan), np.full((len(q), len(routers)), np.inf)
    by_parent = np.abs(far[:, None] - to_parent[None, :]) - most[None, :] <= reach[:, None]
    rows, nodes = np.flatnonzero(by_parent.any(axis=1)), np.flatnonzero(by_parent.any(axis=0))
    if len(rows) and len(nodes):
        to = distances(q[rows], routers[nodes])
        bound = np.maximum(0.0, np.maximum(to - most[nodes], least[nodes] - to))
        bound[(bound > reach[rows][:, None]) | ~by_parent[np.ix_(rows, nodes)]] = np.inf
        d[np.ix_(rows, nodes)], low[np.ix_(rows, nodes)] = to, bound
    return d, low


def exact(most: float) -> type:
    """The type that inner products are exact in: what holds `most` holds all partial sums."""
    return np.float32 if most < 2**24 else np.float64 if most < 2**52 else np.int64


def best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to the smaller id."""
    if len(ids) > 4 * k:
        floor = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= floor)
        return some[np.lexsort([ids[some], -score[some]])[:k]]
    return np.lexsort([ids, -score])[:k]


HITS = "query_id long, vec_id long, score long"
ENTRY = "node long, parent long, v array<double>, to_parent double, n long, least double, most double"
#: Queries that travel together to a node: their places in a carrier and distances to the node's router, packed. Of the blocks of
#: siblings (32 pages, or all inner nodes under a node) with the same `first`, one is the carrier: the queries' rows (not for pages), vec_ids,
#: vectors and floors of scores; first is the first of the rows.
BLOCK = "node long, leaf boolean, first long, at binary, far binary, rows binary, ids binary, v binary, floor binary"
NAMES = [x.split()[0] for x in BLOCK.split(", ")]


def block_table(out: list[tuple]) -> pa.Table:
    types = {"node": pa.int64(), "leaf": pa.bool_(), "first": pa.int64()}
    columns = zip(*out, strict=True) if out else [[]] * len(NAMES)
    return pa.table([pa.array(c, types.get(n, pa.binary())) for n, c in zip(NAMES, columns, strict=True)], NAMES)


class Hits:
    """The k best of each query (a place) among what add() is given; of no more than `most` are kept at a time, or k of each query."""

    def __init__(self, k: int, most: int = 1 << 20):
        self.k, self.most, self.n, self.found = k, most, 0, [(np.empty(0, np.int64),) * 3]

    def add(self, who: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.found.append((who, ids, score))
        self.n += len(who)
        if self.n > self.most:
            self.best()
            self.most = max(self.most, 2 * self.n)

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        who, ids, score = (np.concatenate(x) for x in zip(*self.found, strict=True))
        order = np.lexsort([ids, -score, who])
        who = who[order]
        order = order[np.arange(len(who)) - np.searchsorted(who, who) < self.k]
        self.found = [(np.concatenate([x[0] for x in self.found])[order], ids[order], score[order])]
        self.n = len(order)
        return self.found[0]


def top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def sized(small: DataFrame, rows: int = 200_000) -> DataFrame:
    """A table of numbers to be sent to all tasks, if it has no more rows than that; else to be joined as it is."""
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small


class Tree:
    """entries: ENTRY's rows of all nodes but the root; pages: (node, vec_id, row, v, far) of the leaves; depth: levels under the root."""

    def __init__(self, data: DataFrame, dims: int, most: float, fanout: int, page_rows: int, group: int, seed: int):
        self.dims, self.most, self.slack, self.depth, self.kind, self.levels = dims, most, slack(dims, most), 0, kind_of(data), []
        entries, pages, used, routers = [], [], [], None
        now = data.withColumns({"node": F.lit(0).cast("long"), "far": F.lit(0.0)})

        def assign(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return left.select(["row", "vec_id", "v", "node", "far"])
            if not right.num_rows:
                raise ValueError("a node without routers")
            row = left.column("row").to_numpy()
            which, far = nearest(lifted(matrix(left.column("v"), dims), most), lifted(matrix(right.column("v"), dims), most), row, seed + right.column("level")[0].as_py())
            return pa.table([left.column("row"), left.column("vec_id"), left.column("v"), pa.array(right.column("node").to_numpy()[which]), pa.array(far)], ["row", "vec_id", "v", "node", "far"])

        while True:
            sizes = written(now.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("least"), F.max("far").alias("most")), "sizes")
            used.append(sizes)
            if routers is not None:
                entries.append(routers.join(sizes, "node").select(*(x.split()[0] for x in ENTRY.split(", "))))
            large = sizes.where(F.col("n") > page_rows)
            pages.append(now.join(sized(sizes.where(F.col("n") <= page_rows).select("node")), "node", "left_semi"))
            if large.isEmpty():
                break
            self.depth += 1
            if self.depth * BITS >= 64:
                raise ValueError("the tree is deeper than numbers of nodes can say; raise fanout or page_rows")
            wanted = F.col("n") * 2 / F.lit(page_rows)
            below = F.greatest(F.lit(0), F.ceil(F.log(float(fanout), wanted) - 1e-9) - 1)  # full levels under the children
            kids = F.least(F.lit(fanout), F.ceil(wanted), F.greatest(F.lit(8), F.ceil(wanted / F.pow(F.lit(float(fanout)), below)))).cast("int")
            large = sized(large.select("node", F.col("n").alias("_n"), kids.alias("_kids"), F.ceil(F.col("n") / F.lit(group)).cast("int").alias("_salts")))
            own = now.join(large, "node")
            hashed = F.xxhash64(F.lit(seed + self.depth), "row")
            # Some more than are needed; the chance that none is drawn is e**-32.
            drawn = own.where(F.pmod(hashed, F.lit(1 << 40)) / F.lit(float(1 << 40)) < (4 * F.col("_kids") + 32) / F.col("_n"))
            drawn = drawn.withColumn("_j", F.row_number().over(Window.partitionBy("node").orderBy(hashed, "row"))).where("_j <= _kids")
            routers = written(drawn.select((F.shiftleft("node", BITS) + F.col("_j")).alias("node"), F.col("node").alias("parent"), "v", F.col("far").alias("to_parent"), "_salts"), "routers")
            dealt = own.withColumn("salt", F.pmod(F.xxhash64("row"), F.col("_salts")).cast("int")).drop("_n", "_kids", "_salts")
            there = routers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).select("node", "parent", "v", "salt", F.lit(self.depth).alias("level"))
            now = written(dealt.groupBy("node", "salt").cogroup(there.groupBy("parent", "salt")).applyInArrow(assign, f"row long, vec_id long, v array<{self.kind}>, node long, far double"), "level")
            used += [routers, now]
        union = lambda tables: tables[0] if len(tables) == 1 else tables[0].unionByName(union(tables[1:]))
        self.entries = written(union(entries), "entries") if entries else None
        self.pages = written(union([p.select("node", "row", "vec_id", "v", "far") for p in pages]), "pages")
        self.page_rows = page_rows
        for df in used:
            dropped(df)

    def descend(self, start: DataFrame, block: int, groups: int, near: int | None) -> DataFrame:
        """Blocks at the root -> blocks at the pages that are open to their queries, with `to`, the group that they meet pages in; near:
        only so many of the best pages of an inner node, and its best inner node."""
        dims, most, slack_, page_rows, kind = self.dims, self.most, self.slack, self.page_rows, self.kind

        def step(entries: pa.Table, asked: pa.Table) -> pa.Table:
            out: list[tuple] = []
            if entries.num_rows and asked.num_rows:
                entries = entries.sort_by([("parent", "ascending"), ("node", "ascending")])
                routers, node, parent = lifted(matrix(entries.column("v"), dims), most), entries.column("node").to_numpy(), entries.column("parent").to_numpy()
                to_parent, least, radius, n = (entries.column(c).to_numpy() for c in ("to_parent", "least", "most", "n"))
                blocks = asked.select(NAMES).to_pylist()
                v, rows, ids, floor = carried(next(r for r in blocks if r["v"] is not None), kind)
                reach = radius_of(v, floor, most) + slack_
                for r in blocks:
                    here = slice(*np.searchsorted(parent, [r["node"], r["node"] + 1]))
                    at, far = placed(r)
                    d, low = bounds(asking(v[at]), far, reach[at], routers[here], to_parent[here], least[here], radius[here])
                    open_, leaf = np.isfinite(low), n[here] <= page_rows
                    if near is not None:
                        open_ = best_entries(np.where(open_, low + 1e-6 * np.nan_to_num(d), np.inf), leaf, near)
                    kinds = np.where(leaf, node[here] >> SIBLINGS, -1)
                    for kind_ in np.unique(kinds):
                        some, is_leaf = np.flatnonzero(kinds == kind_), bool(kind_ >= 0)
                        who = np.flatnonzero(open_[:, some].any(axis=1))
                        for q in (who[lo : lo + block] for lo in range(0, len(who), block)):
                            w = at[q]
                            carrier = packed(v[w], None if is_leaf else rows[w], ids[w], floor[w], kind)
                            for child in some[open_[np.ix_(q, some)].any(axis=0)]:
                                i = np.flatnonzero(open_[q, child])
                                out.append((int(node[here][child]), is_leaf, int(rows[w[0]]), *places(i, d[q[i], child]), *carrier))
                                carrier = (None,) * 4
            return block_table(out)

        reached, now = [], start
        for level in range(self.depth):
            inner = now.where("not leaf").withColumn("up", F.shiftright("node", BITS))
            asked = inner.select(F.col("node").alias("parent"), F.col("up").alias("_up"), F.col("first").alias("_first")).distinct()
            there = self.entries.join(asked, "parent")
            now = written(there.groupBy("_up", "_first").cogroup(inner.groupBy("up", "first")).applyInArrow(step, BLOCK), f"level-{level}")
            self.levels.append(now)
            reached.append(now.where("leaf"))
        out = start if not reached else reached[0]
        for more in reached[1:]:
            out = out.union(more)
        return out.withColumn("to", F.pmod(F.xxhash64("first"), F.lit(groups)).cast("int"))

    def visit(self, blocks: DataFrame, k: int) -> DataFrame:
        """HITS: the k best that the pages of a node have for each query sent to them."""
        dims, most, slack_, kind = self.dims, self.most, self.slack, self.kind

        def meet(pages: pa.Table, asked: pa.Table) -> pa.Table:
            found, q_ids = Hits(k), np.empty(0, np.int64)
            if pages.num_rows and asked.num_rows:
                pages, blocks = pages.sort_by("node"), asked.select(NAMES).to_pylist()
                node, ids, far, c = pages.column("node").to_numpy(), pages.column("vec_id").to_numpy(), pages.column("far").to_numpy(), matrix(pages.column("v"), dims).astype(exact(most))
                carriers = [(r["first"], carried(r, kind)) for r in blocks if r["v"] is not None]
                v, _, q_ids, floor = (np.concatenate(x) for x in zip(*(x for _, x in carriers), strict=True))
                before = dict(zip((first for first, _ in carriers), np.cumsum([0, *(len(x[2]) for _, x in carriers)]), strict=False))
                reach, v, floor = radius_of(v, floor, most) + slack_, v.astype(exact(most)), floor_of(floor, exact(most))
                by_node: dict[int, list] = {}
                for r in blocks:
                    at, q_far = placed(r)
                    by_node.setdefault(r["node"], []).append((before[r["first"]] + at, q_far))
                for page, sent in by_node.items():
                    lo, hi = np.searchsorted(node, [page, page + 1])
                    who, q_far = (np.concatenate(x) for x in zip(*sent, strict=True))
                    order = np.argsort(q_far)
                    for w in (order[i : i + 512] for i in range(0, len(order), 512)):
                        q, near, wide = who[w], q_far[w], reach[who[w]]
                        some = lo + np.flatnonzero((far[lo:hi] >= (near - wide).min()) & (far[lo:hi] <= (near + wide).max()))
                        score = v[q] @ c[some].T
                        i, j = np.nonzero(score >= floor[q][:, None])
                        other = q_ids[q[i]] != ids[some[j]]
                        i, j = i[other], j[other]
                        score, many = score[i, j].astype(np.int64), np.bincount(i, minlength=len(q))
                        few = many[i] <= k
                        found.add(q[i[few]], ids[some[j[few]]], score[few])
                        ends = np.cumsum(many)
                        for x in np.flatnonzero(many > k):
                            of = slice(ends[x] - many[x], ends[x])
                            chosen = best(ids[some[j[of]]], score[of], k)
                            found.add(np.full(len(chosen), q[x]), ids[some[j[of][chosen]]], score[of][chosen])
            who, ids, score = found.best()
            return pa.table({"query_id": q_ids[who], "vec_id": ids, "score": score})

        sent = blocks.withColumn("up", F.shiftright("node", SIBLINGS))
        there = self.pages.drop("row").join(sent.select("node", F.col("up").alias("_up"), F.col("to").alias("_to")).distinct(), "node")
        return there.groupBy("_up", "_to").cogroup(sent.groupBy("up", "to")).applyInArrow(meet, HITS)


def best_entries(low: np.ndarray, leaf: np.ndarray, near: int) -> np.ndarray:
    """For each query the `near` leaves and the one inner node with the least values, if these are finite."""
    out = np.zeros(low.shape, bool)
    for kind, n in ((leaf, near), (~leaf, 1)):
        at = np.flatnonzero(kind)
        if len(at):
            first = np.argsort(low[:, at], axis=1, kind="stable")[:, :n]
            np.put_along_axis(out, at[first], True, axis=1)
    return out & np.isfinite(low)


def packed(v: np.ndarray, rows: np.ndarray | None, ids: np.ndarray, floor: np.ndarray, kind: str) -> tuple[bytes | None, bytes, bytes, bytes]:
    """rows, ids, v and floor of a carrier."""
    return None if rows is None else rows.tobytes(), ids.tobytes(), v.astype(KINDS[kind][0]).tobytes(), floor.tobytes()


def carried(r: dict, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(v, rows, ids, floor) of a carrier; no rows for pages."""
    rows, ids, floor = np.frombuffer(r["rows"] or b"", np.int64), np.frombuffer(r["ids"], np.int64), np.frombuffer(r["floor"], float)
    return np.frombuffer(r["v"], KINDS[kind][0]).reshape(len(ids), -1).astype(float), rows, ids, floor


def places(at: np.ndarray, far: np.ndarray) -> tuple[bytes, bytes]:
    """at and far of a block."""
    return at.astype(np.uint16).tobytes(), far.astype(np.float32).tobytes()


def placed(r: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(r["at"], np.uint16).astype(np.int64), np.frombuffer(r["far"], np.float32).astype(float)


def floor_of(floor: np.ndarray, kind: type) -> np.ndarray:
    """Floors of scores as the type that scores are in, or a little less where doubles don't hold them; -inf is the least one."""
    if kind is not np.int64:
        return floor.astype(kind)
    return np.where(np.isinf(floor), np.iinfo(np.int64).min, np.nextafter(np.where(np.isinf(floor), 0, floor), -np.inf).astype(np.int64) - 1)


def at_root(queries: DataFrame, dims: int, leaf: bool, block: int) -> DataFrame:
    """Blocks of queries (row, query_id, v, floor) at the root."""
    kind = kind_of(queries)

    def run(batches):
        for part in parts(batches, block):
            n, floor, rows = part.num_rows, part.column("floor").to_numpy(zero_copy_only=False).astype(float), part.column("row").to_numpy()
            floor = np.where(np.isnan(floor), -np.inf, floor)
            carrier = packed(matrix(part.column("v"), dims), rows, part.column("query_id").to_numpy(), floor, kind)
            yield from block_table([(0, leaf, int(rows[0]), *places(np.arange(n), np.zeros(n)), *carrier)]).to_batches()

    return in_arrow(queries.select("row", "query_id", "v", "floor"), run, BLOCK)


def search(table: DataFrame, *, k: int = 20, every: int = 20, scale: float = 64.0, fanout: int = 128, page_rows: int = 1024, near: int = 4, block_bytes: int = 1 << 17, group_bytes: int = 1 << 23, made_bytes: int = 1 << 26, seed: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose vec_id is divisible by `every`, the k others of the largest
    inner products of floor(scale * x). block_bytes: vectors of queries that travel together; group_bytes: about how much of queries
    meets a node in one task, and of vectors in a step of the building; made_bytes: what a step of a descent can make of a block."""
    data, dims, most = vectors(table, scale)
    if not data.limit(1).count():
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not 2 <= fanout < 1 << BITS:
        raise ValueError("fanout: 2 to 255")
    width = 8 * (dims + 1)
    # A block can come to fanout nodes of a parent: from each its vectors go on to its inner nodes and each 32 pages, and 6 bytes to each child.
    carriers = 2 + (fanout >> SIBLINGS)
    block = max(1, min(block_bytes // width, made_bytes // (fanout * (carriers * (width + 16) + 6 * fanout)), 1 << 16))
    group = max(1, group_bytes // width)
    tree = Tree(data, dims, most, fanout, page_rows, group, seed)
    queries = data.where(F.col("vec_id") % every == 0).select("row", F.col("vec_id").alias("query_id"), "v")
    groups = max(1, -(-queries.count() // group))
    first = at_root(queries.withColumn("floor", F.lit(None).cast("long")), dims, not tree.depth, block)
    found = written(top(tree.visit(tree.descend(first, block, groups, near), k), k), "first")
    for df in tree.levels:
        dropped(df)
    floor = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    second = at_root(queries.join(floor, "query_id", "left"), dims, not tree.depth, block)
    # All vectors of a score of the floor or more are under entries that are open now, those of the first descent among them.
    return top(tree.visit(tree.descend(second, block, groups, None), k), k).select("query_id", "rank", "vec_id", "score")


#: The same rows in DuckDB's SQL.
ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x : floor(64 * cast(x as double))) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x : x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score
  from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 20 = 0),
ranked as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from scored)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 20
"""
