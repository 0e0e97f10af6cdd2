import random
import re
from collections import Counter

import numpy as np
import pytest

from assayer.llm import divergence as d

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ROW = "doc_id long, text string, lang string, source string, n int, term int, value int, part int, tile int, s int"


def expected(rows, least, terms):
    read = [tuple(x or "" for x in row) for row in rows]
    found = [(lang, source, Counter(TERM.findall(text.translate(FOLD)))) for text, lang, source in read]
    groups = {}
    for lang, source, counts in found:
        groups.setdefault(lang, {}).setdefault(source, Counter()).update(counts)
    out = []
    for lang, sources in groups.items():
        texts = Counter(t for at, _, counts in found if at == lang for t in counts)
        kept = sorted(t for t, n in texts.items() if n >= least)
        every = sum(sources.values(), Counter())

        def p(counts):
            whole = sum(counts[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // whole for t in kept}

        q = p(every)
        shares = {source: p(counts) for source, counts in sources.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for source, own in shares.items():
            pairs = [(-sum(f(own[t], other[t]) for t in kept), item) for item, other in shares.items() if item != source]
            named = [(-f(own[t], q[t]), t) for t in kept if sources[source][t] and own[t] > q[t]]
            for part, ranked, most in (("pair", pairs, None), ("term", named, terms)):
                ranked.sort(key=lambda x: (x[0], x[1].encode()))
                out += [(lang, source, part, item, -value, rank) for rank, (value, item) in enumerate(ranked[:most], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    terms = ["a", "B", "é", "Straße", "abcdefgh", "ABCDEFGHI", "sixteenletterwrd", "seventeen_letters", "x" * 17, "x" * 33, "x" * 70, "y" * 1500, "z" * 1500 + "q", "文字", "İx", "ÿ", "zz", "z", "\U0001f600"]
    signs = [" ", "\n", "1", "-", "_", "\x00", "", "@", "[", "`", "{", "\x7f"]
    rows = []
    for _ in range(120):
        text = "".join(rng.choice(terms[: rng.randint(1, len(terms))]) + rng.choice(signs) for _ in range(rng.randint(0, 25)))
        rows.append((text, rng.choice(["en", "en", "de", None, ""]), rng.choice(["s1", "s2", "s3", "é", None])))
    rows += [(None, "en", "silent"), ("", None, None), ("only", "lone", "one"), (None, None, None), ("word " * 30_000, "en", "s1"), ("12 34", "en", "digits")]
    return rows + rows[:5]


@pytest.mark.parametrize("small", [True, False])
def test_equals_brute_force(spark, texts, small, partitions, monkeypatch):
    if small:
        monkeypatch.setattr(d, "PAIR_SOURCES", 2)
        monkeypatch.setattr(d, "PAIR_TERMS", 3)
    rows = [(i, *row, 1, 2, 3, 4, 5, 6) for i, row in enumerate(texts)]
    got = d.divergence(spark.createDataFrame(rows, ROW).repartition(3), least=4, terms=6).collect()
    assert sorted(map(tuple, got)) == expected(texts, 4, 6)


def test_blocks_of_any_size(spark, texts, monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"text": t or "", "lang": a or "", "source": b or ""} for t, a, b in texts])
    found = []
    for size in (1, 200, 1 << 20):
        monkeypatch.setattr(d, "BLOCK_BYTES", size)
        counts = Counter()
        for data, ends, names in d._blocks(batch):
            known = sorted(set(names))
            groups = np.array([known.index(n) for n in names])
            for starts, sizes, group, n, texts_in in d.count_block(data, ends, groups):
                for s, k, g, *numbers in zip(starts, sizes, group, n, texts_in, strict=True):
                    counts.update({(known[g], data[s : s + k].tobytes(), c): int(x) for c, x in zip("nd", numbers, strict=True)})
        found.append(counts)
    want = Counter()
    for t, a, b in texts:
        terms = TERM.findall((t or "").translate(FOLD))
        want.update(((a or "", b or ""), x.encode(), "n") for x in terms)
        want.update(((a or "", b or ""), x.encode(), "d") for x in set(terms))
    assert found[0] == found[1] == found[2] == want


def test_radix_is_stable():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 4, (2, 1000)).astype(np.uint64) << np.uint64(17)
    want = sorted(range(1000), key=lambda i: (words[0][i], words[1][i]))
    assert d.radix(words[0], words[1]).tolist() == want


def test_shares_are_exact():
    rng = random.Random(4)
    for top in (10, 10**6, 2**53 - 3):
        whole = [rng.randint(2, top) for _ in range(50)]
        n = [rng.randint(0, max(w - 2, 0)) for w in whole]
        got = d.shares(np.array(n), np.array(whole)).tolist()
        assert got == [1 + 10**9 * (a + 2) // b for a, b in zip(n, whole, strict=True)]


def test_no_rows(spark):
    assert d.divergence(spark.createDataFrame([], ROW)).count() == 0


def test_terms_are_not_broadcast(spark, texts):
    """The terms' files are a hundredth of their rows in memory: Spark would take them for a small table."""
    rows = [(i, *row, 1, 2, 3, 4, 5, 6) for i, row in enumerate(texts)]
    found = d.divergence(spark.createDataFrame(rows, ROW), least=4, terms=6)
    assert found.collect()
    joins = re.findall("BroadcastHashJoin .*", found._jdf.queryExecution().executedPlan().toString())
    assert joins and not [join for join in joins if "BuildLeft" in join]
