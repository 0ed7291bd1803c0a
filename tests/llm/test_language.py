import itertools
import random

import numpy as np
import pyarrow as pa

from bandweave.llm import language as L

SYLLABLES = {"aa": "the ing tion er and", "bb": "sch ung ein keit ü", "cc": "eux que ré ment ou"}


def text(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang].split(), k=rng.randrange(1, 4))) for _ in range(n))


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    return [(i, text(rng, lang, rng.randrange(5, 60)), lang) for i in range(n) for lang in [rng.choice(list(SYLLABLES))]]


def test_forward_backward_equals_all_paths():
    rng = np.random.default_rng(0)
    model = L.Model.empty(["a", "b", "c"], np.empty(0, np.uint64))
    model.moves, model.first = rng.normal(size=(3, 3)), rng.normal(size=3)
    lengths = [1, 4, 0, 3]
    begins = np.concatenate([[0], np.cumsum(lengths)])
    emission = rng.normal(size=(begins[-1], 3)) * 2
    expected = np.zeros((3, 3))
    got = L.forward_backward(emission, begins, model, expected)
    want, moved = np.zeros_like(got), np.zeros((3, 3))
    for i, n in enumerate(lengths):
        paths = list(itertools.product(range(3), repeat=n)) if n else []
        score = np.array([sum(emission[begins[i] + t, p[t]] for t in range(n)) + model.first[p[0]] + sum(model.moves[p[t], p[t + 1]] for t in range(n - 1)) for p in paths])
        share = np.exp(score - score.max()) / np.exp(score - score.max()).sum() if n else []
        for p, s in zip(paths, share, strict=True):
            for t in range(n):
                want[begins[i] + t, p[t]] += s
            for t in range(n - 1):
                moved[p[t], p[t + 1]] += s
    assert np.allclose(got, want) and np.allclose(expected, moved)


def test_emissions_equal_features_one_by_one():
    rng = np.random.default_rng(5)
    words = ["ab", "the", "Łódź", "x", "longer-word"]
    t = next(L.W.texts(L.padded(pa.array([" ".join(words), "the x"]))))
    lexicon = np.sort(L.W.hashed(t.data, t.starts, t.ends)[[1]])
    model = L.Model.empty(["a", "b"], lexicon)
    model.tables = [rng.normal(size=x.shape).astype(np.float32) for x in model.tables]
    got = model.emissions(L.features(t, lexicon))

    def code(b):
        return np.array([int.from_bytes(b, "little")], np.uint32)

    for k, w in enumerate([*words, "the", "x"]):
        raw = w.lower().encode()
        want = np.zeros(2)
        for (n, bits), table in zip(L.NGRAMS.items(), model.tables, strict=False):
            around = b" " + raw + b" "
            for i in range(max(len(around) - n + 1, 0)):
                want += table[L._bins(code(around[i : i + n]), bits, n)[0]]
        want += model.tables[2][L._bins(code(raw[:3]), L.AFFIX_BITS, 0x51)[0]] + model.tables[3][L._bins(code(raw[-3:]), L.AFFIX_BITS, 0xA3)[0]]
        want += model.tables[4][0 if w == "the" else 1]
        assert np.allclose(got[k], want, atol=1e-4), w


def test_held_out_accuracy_and_inputs(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in L.identify_held_out(docs).collect()}
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    unseen = [(got[i].lang_pred == lang) for i, _, lang in rows if got[i].held_out]
    assert len(unseen) > 50 and np.mean(unseen) >= 0.98 and all(0 <= r.score <= 1 for r in got.values())
    # Labels of held-out documents change nothing.
    wrong = spark.createDataFrame([(i, t, "zz" if got[i].held_out else lang) for i, t, lang in rows], "doc_id long, text string, lang string")
    assert sorted(map(tuple, L.identify_held_out(wrong).collect())) == sorted(map(tuple, got.values()))


def test_words_of_code_switched_texts():
    model = L.trained([(lang, t) for _, t, lang in corpus()])
    sequences, labels = L.stretches([(lang, t) for _, t, lang in corpus(seed=9)], np.random.default_rng(2))
    _, _, runs = L.predicted(pa.array(sequences), model, runs=True)
    flat = [x for r in runs for x, n in r for _ in range(n)]
    assert np.mean([a == b for a, b in zip(flat, itertools.chain(*labels), strict=True)]) > 0.93
    assert model.moves.diagonal().min() > (model.moves - 9 * np.eye(3)).max()


def test_odd_texts(odd_documents, documents, spark):
    labelled = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    model = L.fit(labelled)
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(odd_documents, model).collect()}
    assert {i for i, (lang, _) in got.items() if lang == "und"} == {0, 1, 9} and got[0] == got[9] == ("und", 0.0)
    marks = documents([(1, "12 34 — … ??"), (2, "日本"), (3, "٣٤"), (4, "é")])
    assert {r.doc_id: r.lang_pred == "und" for r in L.identify(marks, model).collect()} == {1: True, 2: False, 3: True, 4: False}
    assert L.identify(odd_documents.limit(0), model).count() == 0
    nothing = L.identify_held_out(odd_documents.withColumn("lang", odd_documents.lang.substr(9, 0)).where("false").union(odd_documents.selectExpr("doc_id", "text", "null", "source", "n_chars", "kept", "score", "size")))
    assert {(r.lang_pred, r.score) for r in nothing.collect()} == {("und", 0.0)}
    one = {r.doc_id: (r.lang_pred, r.score) for r in L.identify_held_out(odd_documents).collect()}
    assert one[3] == ("en", 1.0) and one[0] == ("und", 0.0)
    runs = L.identify(documents([(1, "the eux")]), model, runs=True).first().runs
    assert sum(r.words for r in runs) == 2


def test_learns_from_whole_texts(spark):
    """Texts that open in one language and go on in their own."""
    rng = random.Random(9)
    rows = [(i, text(rng, "aa", 160) + " " + text(rng, lang, 300), lang) for i in range(120) for lang in [("bb", "cc")[i % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in L.identify_held_out(docs).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows if got[i].held_out]) >= 0.95
