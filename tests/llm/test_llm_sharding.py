import random
from collections import Counter

import pytest

from assayer.llm.sharding import hypergeometric, matrix, shuffle


def test_shards_are_exact_and_slots_gapless(docs, rows, nothing):
    found = shuffle(docs, 4).collect()
    assert len(found) == len(rows)
    sizes = Counter(r.shard for r in found)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for shard, size in sizes.items():
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(size))
    key = lambda i, t: (i if i is not None else -1, t or "")
    assert sorted(key(r.row.doc_id, r.row.text) for r in found) == sorted(key(*r[:2]) for r in rows)
    assert shuffle(nothing, 4).count() == 0


def test_more_shards_than_rows(spark):
    found = shuffle(spark.range(3), 8).collect()
    assert sorted(r.row.id for r in found) == [0, 1, 2] and {r.slot for r in found} == {0}


def test_the_matrix_has_both_margins():
    rng = random.Random(2)
    for _ in range(50):
        counts = [rng.randint(0, 40) for _ in range(rng.randint(1, 6))]
        total, shards = sum(counts), rng.randint(1, 5)
        sizes = [total // shards + (j < total % shards) for j in range(shards)]
        drawn = matrix(counts, sizes, rng.randint(0, 9))
        assert [sum(r) for r in drawn] == counts
        assert [sum(c) for c in zip(*drawn, strict=True)] == sizes


@pytest.mark.parametrize("total,good,draws", [(10, 4, 3), (60, 30, 20), (7, 7, 3)])
def test_draws_follow_the_distribution(total, good, draws):
    from math import comb

    rng, n = random.Random(5), 20_000
    seen = Counter(hypergeometric(rng, total, good, draws) for _ in range(n))
    for k in range(draws + 1):
        p = comb(good, k) * comb(total - good, draws - k) / comb(total, draws)
        assert abs(seen[k] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-9


def test_places_are_uniform(spark):
    found = shuffle(spark.range(0, 4000, 1, 5), 4).collect()
    low = sum(r.row.id < 800 for r in found if r.shard == 0)  # the first of five partitions
    assert abs(low - 200) < 60
    half = sum(r.slot < 500 for r in found if r.row.id < 800)
    assert abs(half - 400) < 80
