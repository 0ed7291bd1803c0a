"""The pipeline against brute-force versions of its stages, and what each hands on."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

import random  # noqa: E402

from test_minhash import brute  # noqa: E402
from test_mixing import by_hand  # noqa: E402
from test_packing import check, ids  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("aeioubcdfglmnprst") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(160):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 120))]
        bad = i % 9 == 0
        rows.append((i, " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words), "en", f"src{i % 4}", 0))
        labels.append((i, int(not bad), 0))
    rows += [(200 + i, rows[i][1] + " tail", "en", "src1", 0) for i in range(1, 30) if i % 9]
    rows += [(300, rows[1][1], None, None, 0), (301, None, "en", "src0", 0), (302, "", "en", "src0", 0), (303, "call +1 (578) 555-6437 " + rows[2][1][:60] + " new words of it", "en", "src2", 0), rows[5]]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, {r[0]: r for r in rows}


def test_stages_one_by_one(spark, corpus, tmp_path):
    path, rows = corpus
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, path)
        assert out.columns == COLUMNS or name == "packing"
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
    good = {i for i, r in rows.items() if r[1] and not r[1].endswith("!!") and not (i % 9 == 0 and i < 160)}
    assert {r.doc_id for r in kept["quality rules"]} == good
    want = brute([(i, rows[i][1]) for i in good], 5, 80)
    assert sorted(r.doc_id for r in kept["near-dedup"]) == sorted(i for i, (_, c) in want.items() if c == i)
    names = {r.doc_id: r for r in kept["pii"]}
    assert all(names[r.doc_id].text == r.text for r in kept["near-dedup"] if "555-" not in r.text)
    assert "+1 (578) 555-6437" not in names[303].text and names[303].n_chars == len(names[303].text)
    sizes, taken = {}, {}
    for r in kept["pii"]:
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    for r in kept["mix"]:
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    for source, target in by_hand(sizes).items():
        assert abs(taken.get(source, 0) - target) <= 130  # a document's words
    assert sum(r.length for r in kept["packing"]) == sum(len(ids(r.text)) for r in kept["mix"])
    check(kept["packing"], 2048)
    again = pipeline.run(spark, path).collect()
    assert sorted((r.doc_id, r.length, r.ids_crc32) for r in again) == sorted((r.doc_id, r.length, r.ids_crc32) for r in kept["packing"])


def test_empty_documents(spark, corpus, tmp_path):
    path, _ = corpus
    for name in ("documents", "labels"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
    assert pipeline.ORACLE_SQL is None and 4 <= len(pipeline.STAGES) <= 5
