"""The registered queries of this subpackage: op<N>_<name>(spark, sf_dir), each a thin use of its operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandweave.llm import html_text, language, minhash, mixing, mtree, packing, pii, quality_rules, secrets, sharding
from bandweave.llm.common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(table(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op3_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymised(docs, pii.TRIAL_KEY)


def op4_html_min_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_two_pass_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digests(table(spark, sf_dir, "documents"))


def op6_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_held_out(table(spark, sf_dir, "documents"))


def op7_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.search(table(spark, sf_dir, "embeddings"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digests(table(spark, sf_dir, "documents"))


def base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op9's rows: the counts and the base rules."""
    return op9_quality_rules(spark, sf_dir).drop("score", "kept")


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op5's rows: sizes, and the rows and slots of shards."""
    rows = op5_two_pass_shards(spark, sf_dir)
    shards = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("slot").alias("least"), F.max("slot").alias("most"), F.sum_distinct("slot").alias("slots"))
    sizes = rows.groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    return shards.selectExpr("'shard' as what", "cast(shard as long) as which", "n", "least", "most", "slots").unionByName(sizes.selectExpr("'size' as what", "size as which", "n", "0L as least", "0L as most", "0L as slots"))


def undetermined_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op6's rows: which texts have no language, and the languages there are."""
    rows = op6_language_crf(spark, sf_dir)
    return rows.select("doc_id", (F.col("lang_pred") == "und").alias("und"), ((F.col("score") >= 0) & (F.col("score") <= 1)).alias("fit"))


SHARDS_ORACLE = """
with n as (select count(*) as n from documents),
s as (select i as shard, (i + 1) * n // 40 - i * n // 40 as n from n, range(40) t(i))
select 'shard' as what, cast(shard as bigint) as which, cast(n as bigint) as n, cast(0 as bigint) as least, cast(n - 1 as bigint) as most, cast(n * (n - 1) // 2 as bigint) as slots from s where n > 0
union all
select 'size', strlen(coalesce(text, '')) + 16, count(*), 0, 0, 0 from documents group by 2
"""
UNDETERMINED_ORACLE = "select doc_id, not regexp_matches(coalesce(text, ''), '\\p{L}') as und, true as fit from documents"

QUERIES = {f.__name__: f for f in (
    op1_secret_scan, op2_minhash_near_dedup, op3_pii_pseudonyms, op4_html_min_cut, op5_two_pass_shards,
    op6_language_crf, op7_mtree_top_k, op8_best_fit_packing, op9_quality_rules, op10_source_mix,
    base_counts, shard_sizes, undetermined_language,
)}
#: Only what SQL can express on whole tables.
ORACLES: dict[str, str] = {
    "op2_minhash_near_dedup": minhash.ORACLE, "op7_mtree_top_k": mtree.ORACLE, "op10_source_mix": mixing.ORACLE,
    "base_counts": quality_rules.BASE_ORACLE, "shard_sizes": SHARDS_ORACLE, "undetermined_language": UNDETERMINED_ORACLE,
}
