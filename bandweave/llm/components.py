"""Connected components by alternating large-star and small-star steps, each a table in the shared folder.

No task sees the whole neighbourhood of a vertex: minima are taken by partial aggregates, and edges meet
them in a join of which skewed partitions can be split. The number of steps grows with the logarithm
of the vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandweave.llm.common import counted, dropped, written


def components(edges: DataFrame, by: str | None = None) -> DataFrame:
    """edges (a, b) of longs -> table (node, root): root is the smallest node reachable. Nodes that are
    their own root are left out, as are loops. by: a column of edges, and of the result, that says which of
    several graphs an edge belongs to; they are treated together, in as many steps as the one that needs most."""
    of = [by] if by else []
    hashed = F.sum(F.xxhash64(*of, "u", "v") % (1 << 40))
    now, state = counted(edges.select(*of, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges", hashed)
    while state[0]:
        # Large-star: the larger end of an edge goes to the least neighbour of the smaller end. Where this is the least
        # of its own neighbourhood, as the centre of a star is, it has no smaller neighbour and the edge stays.
        least = now.groupBy(*of, F.col("u").alias("v")).agg(F.min("v").alias("m"))
        large = written(now.join(least, [*of, "v"], "left").select(*of, "u", F.coalesce("m", "v").alias("v")).distinct(), "large-star")
        least = large.groupBy(*of, "u").agg(F.min("v").alias("m"))
        moved = large.join(least, [*of, "u"]).where("v <> m").select(*of, F.col("v").alias("u"), F.col("m").alias("v"))
        before, (small, state) = state, counted(moved.union(least.select(*of, "u", F.col("m").alias("v"))).distinct(), "small-star", hashed)
        dropped(large)
        dropped(now)
        now = small
        if state == before:
            break
    return now.select(*of, F.col("u").alias("node"), F.col("v").alias("root"))


def merged(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Components (node, root) and more edges (a, b) -> components of both.
    Only what the edges join takes part in the steps, a component as one node."""
    end = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"_{name}"))
    apart = edges.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    above = components(apart)
    top = above.select(F.col("node").alias("root"), F.col("root").alias("_top"))
    return roots.join(top, "root", "left").select("node", F.coalesce("_top", "root").alias("root")).union(above)
