"""Mixing sources to target weights, in DataFrame operations only.

Every document gets a hash-random key. Within its source, documents are range-sorted by that key: the key's
first bits name a range, ranges are summed (partial sums before the shuffle), their prefix sums taken in two
levels, and each range sorted by itself, so a source with a third of all rows is no larger task than
others. A document's place in its source is then the prefix sum of the words before it, and the source is cut at
its exact budget: whole epochs first, then the documents up to the budget's rest.

Targets: sources by code point, null last, weigh `weights` in turn and share the words of all documents; a target
stops at `cap` times its source's words and what it leaves is shared by weight among the rest. That is the
level l with sum(min(l * weight, cap * words)) = all words, found by sorting sources by cap * words / weight.

Cases: a null text has no words. A null source is a source. Sources without words have target 0.
Rows that repeat a doc_id are documents of their own, side by side in the order. Ties of keys are broken by doc_id,
size and CRC of the text; rows equal in all of these are alike. Where ids repeat so often that a range grows to 16 times its
size, its rows are dealt to parts by hash and the parts follow one another. An empty table gives an empty result. Further
columns are carried by mix() unless they have a name that it adds (size, source_size, target, taken, copies: those are replaced).
The targets are found in one task over one row for each source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandweave.llm.common import n_words, prefix_sums, written

ADDED = ("size", "source_size", "target", "taken")


def targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """sizes (source, source_size), one row a source, with target and budget (whole words)."""
    ranked = sizes.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("_cap", F.col("source_size") * cap)
    order = Window.orderBy((F.col("_cap") / F.col("_weight")), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    ranked = ranked.withColumn("_free", F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("_cap").over(before), F.lit(0))).withColumn("_weights", F.sum("_weight").over(after))
    # The first source, in this order, that its share of what is left doesn't fill sets the level for all after it.
    ranked = ranked.withColumn("_open", F.col("_free") * F.col("_weight") < F.col("_cap") * F.col("_weights"))
    first = lambda c: F.first(F.when(F.col("_open"), F.col(c)), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    level = F.col("_weight") * first("_free").cast("double") / first("_weights").cast("double")
    return ranked.withColumn("target", F.coalesce(level, F.col("_cap").cast("double"))).withColumn("budget", F.floor("target")).select("source", "source_size", "target", "budget")


def mix(docs: DataFrame, *, weights: Sequence[int] = (1, 2, 3), cap: int = 3, range_rows: int = 512, seed: str = "mix", carried: Sequence[str] | None = None) -> DataFrame:
    """docs' columns (those of `carried`, if given) with size (words), source_size, target, taken (words, all epochs together) and
    copies: how often the mix takes the document as a whole, where the one at the cut counts if half of it or more is
    before the cut. range_rows: about how many documents of a source are sorted together."""
    carried = [c for c in carried or docs.columns if c.lower() not in (*ADDED, "copies")]
    # Rows travel as one column, so that no name of theirs meets one of these. Sizes are counted once, into a table.
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    named = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source"))  # never null, for joins
    sized = docs.select(F.struct(*carried).alias("doc"), F.col("doc_id").alias("id"), named.alias("source"), n_words(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("crc"), key.alias("key"), F.monotonically_increasing_id().alias("row"))
    sized = written(sized, "mix-sizes")
    most = sized.groupBy("source").count().agg(F.max("count").alias("n")).first().n or 0
    bits = min(31, max(0, -(-most // range_rows) - 1).bit_length())
    ranged = sized.withColumn("range", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), 32 - bits) if bits else F.lit(0).cast("long"))
    sums = written(ranged.groupBy("source", "range").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")), "mix-ranges")
    at = ["source", "range", "part"]
    full = sums.where(F.col("rows") > 16 * range_rows).select("source", "range", F.ceil(F.col("rows") / range_rows).cast("int").alias("parts"))
    if full.isEmpty():
        ranged, inner = ranged.withColumn("part", F.lit(0)), None
    else:  # documents of one id, or without: they share a key, so their range is dealt to parts by hash
        ranged = ranged.join(full, ["source", "range"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
        split = ranged.join(full.drop("parts"), ["source", "range"], "left_semi").groupBy(*at).agg(F.sum("size").alias("words"))
        inner = prefix_sums(split, ["source", "range"], "part", "words", "in_range").drop("words")
    planned = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")).select(F.expr("if(source = '', null, substring(source, 2))").alias("source"), "source_size"), weights, cap)
    planned = planned.withColumn("source", named)
    before = prefix_sums(sums.drop("rows"), ["source"], "range", "words", "before").drop("words").join(planned, "source")
    inside = Window.partitionBy(*at).orderBy("key", "id", "size", "crc", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumn("upto", F.sum("size").over(inside) - F.col("size")).join(before, ["source", "range"])
    placed = placed.withColumn("in_range", F.lit(0).cast("long")) if inner is None else placed.join(inner, at, "left")
    placed = placed.withColumn("at", F.col("before") + F.coalesce("in_range", F.lit(0)) + F.col("upto"))
    placed = placed.withColumn("epochs", F.expr("if(source_size = 0, 0L, budget div source_size)")).withColumn("rest", F.expr("budget - epochs * source_size"))
    placed = placed.withColumn("last", F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("at"))))
    placed = placed.withColumn("taken", (F.col("epochs") * F.col("size") + F.col("last")).cast("long"))
    placed = placed.withColumn("copies", (F.col("epochs") + F.expr("if(size > 0 and 2 * last >= size, 1, 0)")).cast("int"))
    return placed.select(*(F.col("doc")[c].alias(c) for c in carried), *ADDED, "copies")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix, all columns of docs, each document as often as the mix takes it whole."""
    whole = docs.select(F.col("doc_id"), "source", "text", F.struct(*docs.columns).alias("whole"))
    taken = mix(whole, carried=["whole"], **options)
    return taken.select("whole", F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1), "copies")))).select("whole.*")


def mix_digests(docs: DataFrame, **options) -> DataFrame:
    """The mix without the texts."""
    return mix(docs.withColumn("doc_id", F.col("doc_id").cast("long")), carried=["doc_id"], **options).select("doc_id", *ADDED)


#: The same rows in DuckDB's SQL.
ORACLE = """
with sized as (
  select doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x : x <> '')) as size,
    md5('mix:' || coalesce(cast(doc_id as varchar), '')) as k from documents),
sizes as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
ranked as (
  select *, 1 + (row_number() over (order by source asc nulls last) - 1) % 3 as w, 3 * source_size as top from sizes),
swept as (
  select *, cast(sum(source_size) over () - coalesce(sum(top) over (order by cast(top as double) / w, source asc nulls last
      rows between unbounded preceding and 1 preceding), 0) as bigint) as free,
    cast(sum(w) over (order by cast(top as double) / w, source asc nulls last rows between current row and unbounded following) as bigint) as ws
  from ranked),
opened as (select *, free * w < top * ws as is_open from swept),
level as (select free as l_free, ws as l_ws from opened where is_open order by cast(top as double) / w, source asc nulls last limit 1),
planned as (
  select source, source_size, case when is_open then cast(w as double) * cast(l_free as double) / cast(l_ws as double) else cast(top as double) end as target
  from opened left join level on true),
placed as (
  select s.doc_id, s.size, p.source_size, p.target, cast(floor(p.target) as bigint) as budget,
    cast(sum(s.size) over (partition by s.source order by s.k, s.doc_id, s.size rows unbounded preceding) as bigint) - s.size as before
  from sized s join planned p on s.source is not distinct from p.source),
cut as (select *, case when source_size = 0 then 0 else budget // source_size end as epochs from placed)
select doc_id, cast(size as bigint) as size, source_size, target,
  cast(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) as bigint) as taken
from cut
"""
