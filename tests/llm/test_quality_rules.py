import random
import re

import numpy as np
import pytest

from bandweave.llm import quality_rules as Q


def base(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    n, r = len(words), len(twice)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), r, n < 10 or 100 * r > 20 * n


def test_base_counts(documents):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "bé", "c#", "d|", "e\n", "\nf", "日"]) for _ in range(rng.randrange(60))) for _ in range(150)]
    texts += ["", None, " \n ", "x y z w v " * 4, "same line here\n" * 3, "a b c d e q a b c d e", "one\r\none\r\none"]
    rows = list(enumerate(texts))
    got = Q.scored(documents(rows), np.zeros(1 << 8, np.float32), -np.inf).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got} == {i: base(t) for i, t in rows}
    assert all(r.kept != r.base_failed for r in got)


def test_scores_equal_a_count_by_hand(documents, spark):
    """The same log ratios from plain dictionaries over the same hash."""
    texts = ["a b c d", "a b x y", "x y x y", ""]
    docs = documents(list(enumerate(texts))).selectExpr("text", "doc_id < 2 as trusted")
    bins = 1 << 12
    counts = {r.bin: (r.raw, r.target) for r in Q.ngram_counts(docs, bins).collect()}
    assert sum(r for r, _ in counts.values()) == 21 and sum(t for _, t in counts.values()) == 14
    ratios = Q.log_ratios(Q.ngram_counts(docs, bins), bins)
    for b, (raw, target) in counts.items():
        share = (raw + 1) / (21 + bins)
        assert ratios[b] == pytest.approx(np.log((target + 0.014 * share) / 14.014 / share), rel=1e-4)
    score = {r.doc_id: r.score for r in Q.scored(documents(list(enumerate(texts))), ratios, 0.0).collect()}
    assert score[0] > score[1] > score[2] and score[3] == 0


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioubcdfglmnprst") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    clean = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(30, 90)))
    junk = lambda: " ".join(rng.choice(vocabulary).upper() + "!!" for _ in range(rng.randrange(30, 90)))
    return [(i, junk() if i % 10 == 0 else clean()) for i in range(n)]


def test_junk_goes_and_unseen_clean_documents_stay(documents, spark):
    rows = corpus()
    labels = spark.createDataFrame([(i, int(i % 10 != 0), 0) for i, _ in rows if i < 250], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in Q.judge_documents(documents(rows), labels).collect()}
    assert got == {i: i % 10 != 0 for i, _ in rows}
    docs = documents(rows)
    stayed = Q.keep_documents(docs, labels)
    assert stayed.columns == docs.columns and {r.doc_id for r in stayed.collect()} == {i for i, k in got.items() if k}


def test_odd_rows_and_tables(odd_documents, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = Q.judge_documents(odd_documents, none).collect()
    assert len(got) == odd_documents.count()
    assert {r.doc_id for r in got if r.kept} == set()  # one long word, and one word over and over, fail as well
    assert Q.judge_documents(odd_documents.limit(0), none).count() == 0
    labels = spark.createDataFrame([(3, None, 0), (None, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    assert Q.judge_documents(odd_documents, labels).count() == odd_documents.count()


def test_threshold():
    score, good = np.array([1.0, 2, 3, 4, 5]), np.array([False, False, True, True, True])
    assert Q.best_threshold(score, good, 20) == 2.5
    assert Q.best_threshold(score, np.ones(5, bool), 20) == -np.inf
    assert Q.best_threshold(score, ~good, 20) == -np.inf


def test_threshold_of_counted_scores():
    rng = np.random.default_rng(4)
    score, good = rng.integers(0, 12, 300).astype(float), rng.random(300) < 0.8
    values, n = np.unique(np.stack([score, good]), axis=1, return_counts=True)
    cut = Q.best_threshold(values[0], values[1].astype(bool), 3, n)
    cost = lambda c: 3 * (good & (score < c)).sum() / good.sum() - (~good & (score < c)).sum() / (~good).sum()
    assert cost(cut) == pytest.approx(min(cost(c - 0.5) for c in range(14)))


def test_labels_of_any_number_give_the_same(documents, spark):
    rows = corpus()
    labels = spark.createDataFrame([(i, int(i % 10 != 0), 0) for i, _ in rows if i < 250], "doc_id long, quality int, toxic int")
    same = [sorted(map(tuple, Q.judge_documents(documents(rows), labels, broadcast_rows=n).collect())) for n in (0, 1000)]
    assert same[0] == same[1]
