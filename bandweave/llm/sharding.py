"""Two-pass external shuffle of a table into shards, in DataFrame operations only.

Pass one scatters whole rows by a seeded hash of all their values into buckets that fit a task's memory; a bucket is a
partition. Pass two gathers each bucket into an array, puts it into a fixed order, permutes it by
Fisher-Yates (Spark's shuffle(), seeded by the seed and the bucket's number, which is that of its partition, so a task that
runs again gives the same) and writes it. Buckets follow one another; the rows of the whole sequence are dealt to shards in equal
runs, so that a bucket's task writes straight into one shard, or a few where buckets are larger than shards. Nothing of this
depends on the session's settings or on the order of the rows.

The law that holds is `rows`: the shards' counts are at most one apart. Groups (equal texts) aren't kept together.

Cases: a null text counts as no bytes, with CRC 0. Rows that repeat a doc_id, or have none, lie in buckets like any others. Rows equal
in all columns share a bucket; where they make it several times too large, its rows are scattered again by their places in the
table (so then, and only for those rows, the order follows the table's files). An empty table gives an empty result. All columns are
carried through the shuffle, by the query as well; columns named shard and slot are replaced. Columns of maps can't be hashed and
don't take part in the scattering.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandweave.llm.common import prefix_sums, shared_dir, unused


def row_size(df: DataFrame) -> Column:
    """About what a row of df takes: the bytes of its texts and nested values, and a fixed part."""
    sizes = [F.octet_length(F.col(f.name) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.col(f.name).cast("string")) for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType))]
    return sum((F.coalesce(n, F.lit(0)).cast("long") for n in sizes), F.lit(96 + 8 * len(df.columns)).cast("long"))


def two_pass_shuffle(df: DataFrame, key: str, *, row_bytes: Column | None = None, bucket_bytes: int = 64 << 20, seed: int = 42, position: str | None = None) -> DataFrame:
    """df in a random order: `position` (_position, if that is free) counts its rows from 0 without gaps. row_bytes: what a row
    takes in memory, row_size() if not given, from which follows the number of buckets."""
    position, size = position or unused(df, "_position"), row_size(df) if row_bytes is None else row_bytes
    held = int(df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first().n)
    buckets = max(1, -(-held // bucket_bytes))
    values = [c for c in (key, *(c for c in df.columns if c != key)) if not isinstance(df.schema[c].dataType, T.MapType)]
    bucket = F.pmod(F.xxhash64(F.lit(seed), *values), F.lit(buckets)).cast("int")
    row = F.struct(key, *(c for c in df.columns if c != key))
    dealt = df.select(bucket.alias("bucket"), size.alias("bytes"), row.alias("row"))
    # More than a chance of hashing: at most a quarter of all buckets, and none in a table without masses of equal rows.
    full = [r.bucket for r in dealt.groupBy("bucket").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") > 4 * max(bucket_bytes, held // buckets)).collect()]
    if full:
        again = F.pmod(F.xxhash64(F.lit(seed), F.lit("again"), F.monotonically_increasing_id()), F.lit(buckets)).cast("int")
        dealt = dealt.withColumn("again", again).withColumn("bucket", F.when(F.col("bucket").isin(full), F.col("again")).otherwise(F.col("bucket"))).drop("again")
    dealt = dealt.drop("bytes")
    begins = prefix_sums(dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), [], "bucket", "n", "begin").drop("n")
    whole = dealt.repartitionById(buckets, "bucket").groupBy("bucket").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    # One row for each bucket is sent to all tasks, so that the rows don't move again.
    placed = whole.select("bucket", F.posexplode(F.shuffle("rows", seed)).alias("at", "row"))
    return placed.join(F.broadcast(begins), "bucket").select("row.*", (F.col("begin") + F.col("at")).alias(position))


def shard(df: DataFrame, key: str, shards: int, *, row_bytes: Column | None = None, bucket_bytes: int = 64 << 20, seed: int = 42) -> DataFrame:
    """df with shard and slot: shard s holds the positions from floor(s n / shards) up to the next shard's."""
    df = df.drop("shard", "slot")
    rows, at = max(df.count(), 1), unused(df, "_position")
    moved = two_pass_shuffle(df, key, row_bytes=row_bytes, bucket_bytes=bucket_bytes, seed=seed, position=at)
    number = F.expr(f"cast(({at} * {shards} + {shards - 1}) div {rows} as int)")
    return moved.withColumn("shard", number).withColumn("slot", F.expr(f"{at} - (shard * {rows}L) div {shards}").cast("long")).drop(at)


def write_shards(sharded: DataFrame, path: str) -> None:
    """Parquet folders shard=0, shard=1 and so on, by the tasks that permuted the buckets; the files of a folder, by name, hold its
    slots in order."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_digests(docs: DataFrame, *, shards: int = 40, bucket_bytes: int = 64 << 20, seed: int = 42, path: str | None = None) -> DataFrame:
    """Where each document goes, with size and CRC of its text, read from the shards that were written to `path` (a new one in the
    shared folder, if not given)."""
    path = path or f"{shared_dir(docs.sparkSession)}/shards-{uuid.uuid4().hex}"
    sharded = shard(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id", shards, bucket_bytes=bucket_bytes, seed=seed)
    write_shards(sharded, path)
    text = F.coalesce("text", F.lit(""))
    return docs.sparkSession.read.schema(sharded.schema).parquet(path).select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
