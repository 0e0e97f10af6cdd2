import collections
import math
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from assayer.llm import weak_labels
from assayer.llm.hmm import Lanes, score_documents
from assayer.llm.language import ORDER, Model, _letters, identify, windows
from assayer.llm.weak_labels import ABSTAIN, BAD, GOOD, Vocabulary, classify, label_model, read, units

from .conftest import DOCUMENT, LABEL, prose


def crc(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode())


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def test_base_scores_equal_brute_force(docs, rows, nothing):
    counts = collections.Counter()
    for r in rows:
        if crc(r[0]) % 10:
            counts.update(tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    found = score_documents(docs, states=2, warm=1, rounds=1, block_bytes=5000).collect()
    assert len(found) == len(rows)
    want = collections.defaultdict(list)
    for r in rows:
        t = tokens(r[1])
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        want[r[0]].append((len(t), sum(counts[w] > 0 for w in t), base))
    for r in found:
        assert r.held_out == (crc(r.doc_id) % 10 == 0) and r.train_tokens == n and r.score < 0
        assert any((r.n_tokens, r.n_known) == w[:2] and r.base_score == pytest.approx(w[2]) for w in want[r.doc_id])
    assert score_documents(nothing, states=2, warm=1, rounds=1).count() == 0


def test_recursions_equal_enumeration():
    rng = np.random.default_rng(1)
    start, move = np.array([0.3, 0.7]), np.array([[0.8, 0.2], [0.4, 0.6]])
    emit = rng.dirichlet(np.ones(4), 2).T
    texts = [np.array(x) for x in ([0, 1, 2, 3], [2], [3, 3, 1], [1, 0])]
    lanes = Lanes(texts)
    got = lanes.log_likelihoods(lanes.forward(start, move, emit)[1])
    first, moves, emissions = np.zeros(2), np.zeros((2, 2)), np.zeros((2, 4))
    for text, log in zip(texts, got, strict=True):
        total, sums = 0.0, []
        for path in np.ndindex(*[2] * len(text)):
            p = start[path[0]] * emit[text[0], path[0]]
            for a, b, x in zip(path, path[1:], text[1:], strict=False):
                p *= move[a, b] * emit[x, b]
            total += p
            sums.append((path, p))
        assert log == pytest.approx(math.log(total))
        for path, p in sums:
            first[path[0]] += p / total
            for a, b in zip(path, path[1:], strict=False):
                moves[a, b] += p / total
            for s, x in zip(path, text, strict=True):
                emissions[s, x] += p / total
    a, b, c, log = lanes.expected(start, move, emit)
    assert np.allclose(a, first) and np.allclose(b, moves) and np.allclose(c, emissions) and log == pytest.approx(got.sum())


def test_latent_states_help(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 80, lang), lang, "s", 1) for i, lang in enumerate(["en", "de"] * 60)]
    found = score_documents(spark.createDataFrame(rows, DOCUMENT).repartition(4), states=2, warm=4, rounds=3).filter("held_out").collect()
    assert sum(r.score for r in found) > sum(r.base_score for r in found)


def test_languages(docs, rows, nothing):
    found = identify(docs).collect()
    texts = {r[0]: r for r in rows if r[0] is not None}
    assert len(found) == len(rows)
    for r in found:
        assert r.held_out == (crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1
        if r.doc_id is None:
            continue
        text = texts[r.doc_id][1]
        if text is None or not any(c.isalpha() for c in text):
            assert r.lang_pred == "und" and r.score == 0
        elif r.doc_id < 40:
            assert r.lang_pred == texts[r.doc_id][2]
    assert identify(nothing).count() == 0
    assert {r.lang_pred for r in identify(docs.withColumn("lang", docs.lang.substr(9, 1)).filter("doc_id = 45")).collect()} == {"und"}


def test_kneser_ney_sums_to_one():
    """After any history the characters' probabilities, the unseen ones together, make one."""
    letters = _letters()
    counts = collections.Counter("banana bandana cab abba nab".split())
    codes, owner = windows(list(counts), letters)
    import pandas as pd

    table = pd.DataFrame(codes, columns=["a", "b", "c", "d"]).assign(n=1).groupby(["a", "b", "c", "d"], as_index=False)["n"].sum().assign(lang="x")
    model = Model(table)
    alphabet = sorted(table["d"].unique().tolist())
    for history in ([0, 0, 0], [0, 0, 98], [98, 97, 110], [99, 99, 99]):
        rows = np.array([[*history, c] for c in alphabet])
        total = np.exp(model.score(rows)).sum()
        unseen = np.exp(model.score(np.array([[*history, 12345]])))[0, 0]
        assert total + unseen == pytest.approx(1.0, abs=2e-2)
    assert codes.shape[1] == ORDER and len(owner) == len(codes)


def test_label_model_finds_who_is_right():
    rng = np.random.default_rng(2)
    truth = rng.random(20_000) < 0.2
    right = (0.95, 0.9, 0.8)
    digits = np.stack([np.where(rng.random(len(truth)) < 0.2, ABSTAIN, np.where((rng.random(len(truth)) < r) == truth, BAD, GOOD)) for r in right], axis=1)
    patterns, which, counts = np.unique(digits @ [9, 3, 1], return_inverse=True, return_counts=True)
    bad, table = label_model(patterns, counts, 3)
    assert ((bad[which] >= 0.5) == truth).mean() > 0.93
    accuracy = table[1, :, BAD] / (table[1, :, BAD] + table[1, :, GOOD])
    assert accuracy[0] > accuracy[1] > accuracy[2]


def test_quality(spark, nothing, labels):
    rng = random.Random(6)
    rows, marks = [], []
    for i in range(600):
        text = prose(rng, 80, "en" if i % 3 else "de")
        if i % 6 == 0:
            text = text.replace(" ", " vileword ", 3)
        if i % 10 == 1:
            text = text.replace(" ", "### ")
        rows.append((i, text, "en", "s", 1))
        marks.append((i, int(i % 10 != 1), int(i % 6 == 0)))
    rows += [(None, None, None, None, None), (600, "", "en", "s", 0), (5, rows[5][1], "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCUMENT).repartition(3)
    found = classify(docs, spark.createDataFrame(marks[:300], LABEL)).collect()
    assert len(found) == len(rows)
    for r in found:
        i = r.row.doc_id
        if i is None or i == 600:
            assert not r.kept
        else:
            assert r.kept == (i % 6 != 0 and i % 10 != 1), i
    assert classify(nothing, labels).count() == 0
    assert classify(docs, labels.limit(0)).count() == len(rows)


def test_no_window_or_language_is_left_out(spark):
    """A rare language next to a large one keeps its model, whatever fits at once; all windows have their exact estimates."""
    import pandas as pd

    from assayer.llm.language import COLUMNS, count_windows, estimate, score_texts

    rng = random.Random(14)
    rare = lambda: " ".join("".join(rng.choice("абвгдежз") for _ in range(5)) for _ in range(30))
    rows = [(i, prose(rng, 200), "en", "s", 1) for i in range(60)] + [(100 + i, rare(), "ru", "s", 1) for i in range(24)]
    docs = spark.createDataFrame(rows, DOCUMENT).repartition(3)
    found = identify(docs, 4000).collect()
    assert [r.lang_pred for r in sorted(found)] == ["en"] * 60 + ["ru"] * 24
    counted = count_windows(docs.selectExpr("if(doc_id % 3 > 0, lang, null) AS lang", "text"))
    logs = estimate(counted, ["en", "ru"])
    table = counted.filter("lang IS NOT NULL").toPandas()
    model = Model(pd.DataFrame(table))
    got = logs.toPandas()
    assert len(got) == counted.select(*COLUMNS).distinct().count()
    assert np.allclose(np.stack(got["logs"]), model.score(got[list(COLUMNS)].to_numpy(np.int64)), atol=1e-4)
    few, all_ = (score_texts(docs.select("doc_id", "text"), logs, 2, n).orderBy("doc_id").collect() for n in (4000, 10**6))
    assert [(r.doc_id, r.events) for r in few] == [(r.doc_id, r.events) for r in all_]
    assert np.allclose([r.losses for r in few], [r.losses for r in all_], rtol=1e-5)


def test_every_round_sees_all_learning_texts(spark, monkeypatch):
    from pyspark.sql import functions as F

    from assayer.llm import hmm

    sizes = []
    real = hmm.expectations
    monkeypatch.setattr(hmm, "expectations", lambda texts, parameters: sizes.append(texts.count()) or real(texts, parameters))
    ids = spark.range(200).filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(32)) != 0).select(F.col("id").alias("doc_id"))
    seq = [hmm.shrunk(np.array(x)) for x in ([0, 1, 0, 1, 0, 1], [2, 3, 2, 3, 2, 3])]
    texts = ids.withColumn("seq", F.when(F.col("doc_id") % 2 == 0, F.lit(seq[0])).otherwise(F.lit(seq[1])))
    _, _, emit = hmm.train(texts, np.ones(5), 2, 2, 1)
    assert sizes == [texts.count()] * 3
    assert abs(emit[:, 0] - emit[:, 1]).max() > 0.1  # no round without a text made the states alike
    _, _, emit = hmm.train(texts.limit(0), np.ones(5), 2, 2, 1)
    assert abs(emit[:, 0] - emit[:, 1]).max() > 0.01


def test_letters_of_all_planes():
    letters = _letters()
    assert len(letters) == 0x110000 and all(letters[ord(c)] == c.isalpha() for c in "\U00030000\U0003134a\U00031350\U0002a700a1 \U0010ffff")
    codes, owner = windows(["\U00030000\U00030001"], letters)
    assert len(codes) == len(owner) == 3


def test_words_of_most_texts_are_learned_once(monkeypatch):
    """However many words are met once, those met again and again stay known; each text has its own distinct words."""
    monkeypatch.setattr(weak_labels, "MEMO", 100)
    learned = []
    monkeypatch.setattr(weak_labels, "units", lambda words: learned.extend(words) or units(words))
    book, common = Vocabulary(), [f"common{i}" for i in range(20)]
    for part in range(40):
        texts = [[*common, *(f"once{part}.{i}.{j}" for j in range(5)), *common] for i in range(3)] + [[]]
        for words, numbers in zip(texts, book.numbers(texts), strict=True):
            assert sorted(map(bytes, book.hashes[numbers])) == sorted(map(bytes, units(list(set(words)))))
        assert len(book.hashes) <= 100
    assert sum(w in common for w in learned) == 20
    many = [[f"many{i}" for i in range(500)], common]
    assert [len(x) for x in book.numbers(many)] == [500, 20]


def test_a_batch_of_texts_is_read_in_parts():
    """A worker holds the words it met and a part of a batch's texts, not all of them, beside the batch itself."""
    batch = pa.RecordBatch.from_arrays([pa.array([f"{i}" + " " * 8000 for i in range(4000)])], names=["text"])
    tracemalloc.start()
    assert sum(n for *_, n in read(batch)) == 4000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < batch.nbytes / 2
