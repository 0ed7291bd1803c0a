"""What the operators of this subpackage share: the shared folder, written tables and Arrow batches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Separators of words in all contracts: space and the bytes 0x09 to 0x0D.
WORD = "[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only where the session names none and runs on this machine alone is a
    temporary one set; a cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: what follows neither computes it again nor depends on the
    executors that made it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str, *figures: Column) -> tuple[DataFrame, tuple]:
    """written(), with the number of rows and other aggregates of them, taken as the table is written."""
    seen = Observation()
    rows = [F.count(F.lit(1)), *figures]
    out = written(df.observe(seen, *(x.alias(f"f{i}") for i, x in enumerate(rows))), name)
    return out, tuple(seen.get[f"f{i}"] for i in range(len(rows)))


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that written() made, once nothing reads it any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def importable(spark: SparkSession) -> None:
    """Python workers that start from now on look for this package where the driver has it. On a cluster it may
    be installed anywhere else as well."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])


def in_arrow(df: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    importable(df.sparkSession)
    return df.mapInArrow(run, schema)


def parts(batches: Iterable[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with state for each task: make() runs once in a task, what it returns once for each small part of a
    batch, so that a task holds one batch and the results of a part."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for part in parts(batches):
            yield step(part)

    return in_arrow(df, run, schema)


def n_words(text: Column) -> Column:
    """Number of words of a text, null counting as empty; split() is faster than a regexp count."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("long")


def prefix_sums(sums: DataFrame, groups: list[str], index: str, value: str, out: str, width: int = 1024) -> DataFrame:
    """sums, one row for each (groups, index), with `out`: the sum of `value` over the rows of the group with
    a smaller index. In two levels: within runs of `width` indices, then over the totals of the runs, so no
    task sorts more than a run or the runs of one group."""
    run = F.floor(F.col(index) / F.lit(width))
    runs = sums.groupBy(*groups, run.alias("__run")).agg(F.sum(value).alias("__in_run"))
    before = Window.partitionBy(*groups).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__before", F.coalesce(F.sum("__in_run").over(before), F.lit(0))).drop("__in_run")
    within = Window.partitionBy(*groups, "__run").orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    each = sums.withColumn("__run", run).join(runs, [*groups, "__run"])
    return each.withColumn(out, F.col("__before") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("__run", "__before")
