"""The stages one after the other on a small corpus, each held against what brute force would keep."""

import random

import corpus_pipeline
from assayer.llm.common import kept

from .conftest import DOCUMENT, prose
from .test_llm_duplicates import brute_components, brute_removed


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    passage, item = prose(rng, 70), prose(rng, 40)
    rows, marks = [], []
    for i in range(400):
        text = prose(rng, 90)
        if i % 8 == 0:
            text = text.replace(" ", " vileword ", 3)
        if i % 20 == 1:
            text = text.replace(" ", "$$$ ")
        if i % 40 == 2:
            text = f"{text}\n{passage}\n{prose(rng, 20)}"
        if i % 50 == 3:
            text = f"{text} {item} {prose(rng, 10)}"
        if i % 25 == 4 and i > 50:
            text = rows[i - 50][1].replace(" ", " also ", 1)
        rows.append((i, text, "en", f"s{i % 2}", len(text)))
        marks.append((i, int("$$$" not in text), int("vileword" in text)))
    documents = spark.createDataFrame(rows, DOCUMENT)
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect() if name != "quality" else documents.collect()
        docs = kept(stage(spark, docs, str(tmp_path)))
        seen[name] = before, docs.collect()
        if name != "packing":
            assert docs.columns == DOCUMENT.names
    ids = lambda found: {r.doc_id for r in found}
    before, after = seen["quality"]
    assert ids(before) - ids(after) == {i for i, good, toxic in marks if toxic or not good}
    before, after = seen["near_duplicates"]
    _, of = brute_components([tuple(r) for r in before], 5)
    assert ids(after) == {i for i, c in of.items() if i == c} != ids(before)
    before, after = seen["substrings"]
    want = brute_removed([tuple(r) for r in before], corpus_pipeline.PASSAGE)
    assert ids(after) == {i for i, (n, gone, _) in want.items() if gone < n or not n}
    for r in after:
        n, gone, _ = want[r.doc_id]
        assert len(r.text.split()) == n - gone and (not gone or r.n_chars == len(r.text))
    assert any(gone for _, gone, _ in want.values())
    before, after = seen["decontamination"]
    assert ids(before) - ids(after) == {r.doc_id for r in before if item in r.text}
    before, after = seen["packing"]
    assert ids(before) == ids(after) and {"start", "length", "sequence_id"} <= set(docs.columns)


def test_nothing_goes_in_and_out(spark, tmp_path):
    spark.createDataFrame([], DOCUMENT).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
