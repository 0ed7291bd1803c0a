"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Every text is a bag of hashed word unigrams and bigrams. Two multinomials over the hash buckets, one
from trusted documents, one from the whole raw corpus, give each text the mean over its n-grams of
log(p_target / p_raw). A text whose mean is under the threshold is rejected; nothing is sampled at
random. Simple counts of the text (few words, repeated windows of words) reject before that.

The raw counts cover all texts, the target's all trusted documents but those held back: a quarter of the labelled ones, by a
hash of doc_id, all of which set the threshold by a histogram of their scores. Labels are sent to all tasks if there are no more
than `broadcast_rows`, and joined with the documents by a shuffle otherwise, with the same result.

Cases: a null text counts as empty; a text without words has no n-gram, score 0 and fails the base rules.
Rows with equal doc_id are judged one by one. Without labels of either kind the threshold is -inf (the
base rules alone decide). An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandweave.llm import words as W
from bandweave.llm.common import in_arrow, map_arrow, parts, written

U64 = np.uint64
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def ngram_bins(t: W.Texts, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all unigrams and bigrams of some texts, and the number of the text of each."""
    h = W.hashed(t.data, t.starts, t.ends)
    doc = np.repeat(np.arange(len(t)), np.diff(t.words))
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    two = W.mix(h[pair] * U64(0x9FB21C651E98DF25) + h[pair + 1])
    return np.concatenate([h, two]) & U64(bins - 1), np.concatenate([doc, doc[pair]])


def ngram_counts(docs: DataFrame, bins: int) -> DataFrame:
    """(bin, raw, target): how often each bucket occurs in all texts and in those flagged `trusted`.

    A task adds up its own texts, so at most `bins` rows leave it, however many texts it had."""
    schema = "bin int, raw long, target long"

    def run(batches):
        count = np.zeros((2, bins), np.int64)
        for batch in parts(batches):
            trusted = np.asarray(batch.column("trusted").fill_null(False))
            for t in W.texts(batch.column("text")):
                at, doc = ngram_bins(t, bins)
                at = at.astype(np.int64)
                count[0] += np.bincount(at, minlength=bins)
                count[1] += np.bincount(at[trusted[t.first + doc]], minlength=bins)
        at = np.flatnonzero(count[0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(count[0, at]), pa.array(count[1, at])], ["bin", "raw", "target"])

    each = in_arrow(docs.select("text", "trusted"), run, schema)
    return each.groupBy("bin").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, bins: int) -> np.ndarray:
    """log(p_target / p_raw) by bucket. The raw share of a bucket smooths the target, so a bucket that
    neither has seen says nothing. The table has `bins` rows at most, whatever the corpus."""
    got = counts.toArrow()
    count = np.zeros((2, bins))
    at = got.column("bin").to_numpy()
    count[0, at], count[1, at] = got.column("raw").to_numpy(), got.column("target").to_numpy()
    raw = (count[0] + 1) / (count[0].sum() + bins)
    prior = 1e-3 * max(1.0, count[1].sum())
    return np.log((count[1] + prior * raw) / (count[1].sum() + prior) / raw).astype(np.float32)


def repeated(h: np.ndarray, width: int) -> int:
    """Words that stand in a window of `width` words found twice or more."""
    n = len(h) - width + 1
    if n < 2:
        return 0
    window = np.zeros(n, U64)
    for k in range(width):
        window = window * U64(0x9FB21C651E98DF25) + h[k : k + n]
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    step = np.zeros(len(h) + 1, np.int64)
    np.add.at(step, np.flatnonzero(twice), 1)
    np.add.at(step, np.flatnonzero(twice) + width, -1)
    return int((np.cumsum(step[:-1]) > 0).sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def judged(column: pa.Array, ratio: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), base_failed, score and kept of some texts."""
    n, bins = len(column), len(ratio)
    out, score = np.zeros((5, n), np.int64), np.zeros(n)
    for t in W.texts(column):
        rows = slice(t.first, t.first + len(t))
        h = W.hashed(t.data, t.starts, t.ends)
        doc = np.repeat(np.arange(len(t)), np.diff(t.words))
        point = np.concatenate([[0], np.cumsum((t.data & 0xC0) != 0x80)])  # code points before each byte
        out[0, rows] = np.diff(t.words)
        out[1, rows] = np.bincount(doc, weights=point[t.ends] - point[t.starts], minlength=len(t))
        out[2, rows] = np.diff(np.concatenate([[0], np.cumsum(SYMBOL[t.data])])[t.at])
        at, owner = ngram_bins(t, bins)
        grams = np.bincount(owner, minlength=len(t))
        score[rows] = np.bincount(owner, weights=ratio[at.astype(np.int64)], minlength=len(t)) / np.maximum(grams, 1)
        for i in range(len(t)):
            if t.words[i + 1] > t.words[i]:
                text = t.text(i)
                out[3, t.first + i] = repeated_lines(text) if b"\n" in text else 0
                out[4, t.first + i] = repeated(h[t.words[i] : t.words[i + 1]], 5)
    failed = (out[0] < 10) | (100 * out[4] > 20 * out[0])
    return out, failed, score, ~failed & (score >= threshold)


def scored(docs: DataFrame, ratios: np.ndarray, threshold: float) -> DataFrame:
    """SCHEMA's columns for every row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out, failed, score, kept = judged(batch.column("text"), shared.value, threshold)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (*out, failed, score, kept))], [x.split()[0] for x in SCHEMA.split(", ")])

        return step

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, SCHEMA)


def best_threshold(score: np.ndarray, good: np.ndarray, cost: float, n: np.ndarray | None = None) -> float:
    """The cut with the least cost, where rejecting a good document costs `cost` times as much as
    keeping a bad one; midway between the neighbouring scores. n: how many documents each score stands for. -inf without
    documents of both kinds."""
    if not len(score) or good.all() or not good.any():
        return -np.inf
    order = np.argsort(score, kind="stable")
    score, good, n = score[order], good[order], np.ones(len(score)) if n is None else n[order]
    edge = np.concatenate([[True], score[1:] != score[:-1], [True]])  # cuts between different scores
    lost, caught = (np.concatenate([[0], np.cumsum(x * n)]) / (x * n).sum() for x in (good, ~good))  # by the rows under the cut
    cut = int(np.argmin(np.where(edge, cost * lost - caught, np.inf)))
    return float(-np.inf if cut == 0 else (score[cut - 1] + score[min(cut, len(score) - 1)]) / 2)


def hash_unit(key: Column, seed: int) -> Column:
    """A number in [0, 1) from a key."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 40)) / F.lit(float(1 << 40))


#: Scores of held back documents are counted in steps of 1 / STEPS; a score lies between -7 and the log of the corpus' n-grams.
STEPS = 1024


def fit(docs: DataFrame, labels: DataFrame, bins: int, cost: float, seed: int, broadcast_rows: int) -> tuple[np.ndarray, float]:
    """Log ratios and threshold. labels: doc_id, quality (1: trusted)."""
    clean = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") == 1).alias("good"))
    clean = written(clean.withColumn("fold", hash_unit(F.col("doc_id"), seed) < 0.75), "labels")
    clean = F.broadcast(clean) if clean.count() <= broadcast_rows else clean
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ratios = log_ratios(ngram_counts(texts.join(clean, "doc_id", "left").withColumn("trusted", F.expr("good and fold")), bins), bins)
    held = clean.where("not fold").select("doc_id", "good")
    got = scored(texts.join(held, "doc_id"), ratios, -np.inf).where("not base_failed").join(held, "doc_id")
    got = got.groupBy(F.floor(F.col("score") * STEPS).alias("step"), "good").count().toArrow()  # two rows for each step
    step, good, n = (got.column(c).to_numpy() for c in ("step", "good", "count"))
    return ratios, float(np.ceil(best_threshold(step.astype(float), good.astype(bool), cost, n)) / STEPS)


def judge_documents(docs: DataFrame, labels: DataFrame, *, bins: int = 1 << 16, cost: float = 20.0, seed: int = 7, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Counts, score and verdict of every document. bins: hash buckets, a power of two; cost: how much worse it is to lose a
    good document than to keep a bad one."""
    if bins & (bins - 1):
        raise ValueError("bins must be a power of two")
    ratios, threshold = fit(docs, labels, bins, cost, seed, broadcast_rows)
    return scored(docs, ratios, threshold)


def keep_documents(docs: DataFrame, labels: DataFrame, *, bins: int = 1 << 16, cost: float = 20.0, seed: int = 7, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The rows of docs, all columns, that judge_documents() keeps; the texts move nowhere."""
    ratios, threshold = fit(docs, labels, bins, cost, seed, broadcast_rows)
    shared, at = docs.sparkSession.sparkContext.broadcast(ratios), docs.columns.index("text")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array(judged(batch.column(at), shared.value, threshold)[3]))

        return step

    return map_arrow(docs, make, docs.schema)


#: The counts in DuckDB's SQL.
BASE_ORACLE = """
with split as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x : x <> '') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x : regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l
  from documents),
windows as (
  select r, unnest(range(1, len(w) - 3)) as i, unnest(list_transform(range(1, len(w) - 3), lambda k : array_to_string(w[k : k + 4], ' '))) as x from split where len(w) >= 6),
twice as (select r, i from (select r, i, count(*) over (partition by r, x) as n from windows) where n > 1),
covered as (select r, count(distinct i + k) as n from twice, range(5) s(k) group by r),
counted as (
  select doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, cast(coalesce(n, 0) as bigint) as n_repeat_words
  from split left join covered using (r))
select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from counted
"""
