"""Replicated routing over a two-part matrix of workers, as relational operations.

A worker group stores copies of a tuple; a tuple of the other stream probes one worker of every group. Each pair then
meets on exactly one worker for each direction of probing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Workers that store R, and as many that store S (fixed values).
R_NODES = S_NODES = 32
ROUTERS = 64


@dataclass(frozen=True)
class MatrixScheme:
    """Nodes and copies of both streams; copies must divide nodes."""

    r_nodes: int = R_NODES
    r_copies: int = 4
    s_nodes: int = S_NODES
    s_copies: int = 4

    def __post_init__(self) -> None:
        for nodes, copies in ((self.r_nodes, self.r_copies), (self.s_nodes, self.s_copies)):
            if not 1 <= copies <= nodes or nodes % copies:
                raise ValueError("copies must divide the nodes")

    def of(self, side: str) -> tuple[int, int, int]:
        """Nodes, copies and first worker of a stream's store."""
        return (self.r_nodes, self.r_copies, 0) if side == "R" else (self.s_nodes, self.s_copies, self.r_nodes)

    def cells(self) -> tuple[int, int]:
        """Rows and columns for band_join(cells=...): R is copied to every column, S to every row."""
        return self.s_copies, self.r_copies


def tagged_union(r: DataFrame, s: DataFrame) -> DataFrame:
    """Both streams as one, with their side; columns by name."""
    return r.withColumn("side", F.lit("R")).unionByName(s.withColumn("side", F.lit("S")))


def shuffled(tuples: DataFrame, routers: int = ROUTERS) -> DataFrame:
    """Tuples dealt to the routers at random."""
    return tuples.repartition(routers)


def by_key(tuples: DataFrame, routers: int = ROUTERS, key: str = "key") -> DataFrame:
    """Tuples of one key to one router."""
    return tuples.repartition(routers, key)


def by_node(routed: DataFrame, scheme: MatrixScheme) -> DataFrame:
    """Routed tuples with their worker as partition."""
    return routed.repartitionById(scheme.r_nodes + scheme.s_nodes, F.col("node").cast("int"))


def with_serial(df: DataFrame, order: str, router: Column, modulus: int | None = None, width: int = 1 << 20) -> DataFrame:
    """The serial number of each tuple at its router and side, from 1, optionally modulo; order is a column of numbers. Tuples are
    numbered within runs of `width` of these, on top of the counts of the runs before, so no task sorts all of a router."""
    parted = df.withColumn("router", router).withColumn("_run", F.floor(F.col(order) / F.lit(width)))
    key = ["side", "router", "_run"]
    before = Window.partitionBy("side", "router").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = parted.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    number = (F.col("_before") + F.row_number().over(Window.partitionBy(*key).orderBy(order))).cast("long")
    return parted.join(runs, key).withColumn("serial", number if modulus is None else number % modulus).select(*df.columns, "router", "serial")


def _nodes(scheme: MatrixScheme, side: str, store: bool, base: bool) -> Column:
    if store:
        nodes, copies, offset = scheme.of(side)
        group = F.floor(F.col("serial") % nodes / copies) if base else F.col("serial") % (nodes // copies)
        first = group * copies + offset
        return F.sequence(first.cast("int"), (first + copies - 1).cast("int"))
    nodes, copies, offset = scheme.of("S" if side == "R" else "R")
    first = (F.col("serial") % copies + offset).cast("int")
    return F.sequence(first, first + nodes - copies, F.lit(copies))


def store_partitions(tuples: DataFrame, scheme: MatrixScheme, base: bool = False) -> DataFrame:
    """tuples (side, serial) with `node`: each worker that stores the tuple. base: the group is serial div copies
    instead of serial mod groups."""
    return tuples.withColumn("node", F.explode(F.when(F.col("side") == "R", _nodes(scheme, "R", True, base)).otherwise(_nodes(scheme, "S", True, base))))


def probe_partitions(tuples: DataFrame, scheme: MatrixScheme) -> DataFrame:
    """tuples (side, serial) with `node`: each worker of the other stream that the tuple probes."""
    return tuples.withColumn("node", F.explode(F.when(F.col("side") == "R", _nodes(scheme, "R", False, False)).otherwise(_nodes(scheme, "S", False, False))))


def evict_by_serial(stored: DataFrame, low: int, high: int) -> DataFrame:
    """What is left after tuples with a serial number outside [low, high] are deleted."""
    return stored.where(F.col("serial").between(low, high))


def answers(copies: int, row: int) -> Column:
    """Whether the sub-index with that row of a scheme answers a probe with column serial."""
    return F.col("serial") % copies == row
