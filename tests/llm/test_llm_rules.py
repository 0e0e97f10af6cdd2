import re
from math import comb

import pytest
from pyspark.sql import functions as F

from assayer.llm.rules import apply_rules, at_most, certify, measures

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    found = WORDS.findall(text)
    places, covered, lines, repeated = {}, set(), set(), 0
    for p in range(len(found) - 2):
        places.setdefault(tuple(found[p : p + 3]), []).append(p)
    for at in places.values():
        if len(at) > 1:
            covered |= {p + j for p in at for j in range(3)}
    for line in text.split("\n"):
        if WORDS.search(line):
            repeated += line in lines
            lines.add(line)
    n = len(found)
    return n, sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_base_equals_brute_force(docs, rows, labels, nothing):
    found = apply_rules(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, found)) == sorted(key((r[0], *base(r[1]))) for r in rows)
    assert apply_rules(nothing, labels).count() == 0
    assert apply_rules(docs, labels.limit(0)).filter("NOT base_failed AND NOT kept").count() == 0


@pytest.mark.parametrize("n,k,rate", [(20, 0, 0.1), (400, 7, 0.02), (1000, 10, 0.02), (5, 0, 0.5)])
def test_binomial_tail_is_exact(spark, n, k, rate):
    got = spark.range(1).select(at_most(F.lit(k).cast("long"), F.lit(n).cast("long"), F.lit(rate))).first()[0]
    want = sum(comb(n, i) * rate**i * (1 - rate) ** (n - i) for i in range(k + 1))
    assert got == pytest.approx(want, rel=1e-9)


def test_cutoffs_keep_the_good(spark):
    """Symbols tell bad from good in one stratum; the other has too few labels to certify anything."""
    text = "some words of good prose that go on and on " * 3
    rows = [(i, " ".join(f"{w}{i}{j}" for j, w in enumerate(text.split() * 3)), "a") for i in range(3000)]
    bad = [(i, r[1].replace(" ", "### "), "a") for i, r in enumerate(rows[:300], 3000)]
    few = [(i, r[1].replace(" ", "### "), "b") for i, r in enumerate(rows[:20], 4000)]
    docs = spark.createDataFrame(rows + bad + few, "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows] + [(r[0], 0, 0) for r in bad] + [(r[0], 1, 0) for r in few], "doc_id long, quality int, toxic int")
    chosen = {r.stratum: r.cutoffs for r in certify(measures(docs), labels).collect()}
    assert chosen["a"][0] is not None and chosen["b"][0] is None
    kept = {(r.lang, r.kept): r.n for r in apply_rules(docs, labels).withColumn("lang", F.col("stratum")).groupBy("lang", "kept").agg(F.count("*").alias("n")).collect()}
    assert kept.get(("a", True)) == 3000 and kept.get(("a", False)) == 300 and kept.get(("b", True)) == 20
