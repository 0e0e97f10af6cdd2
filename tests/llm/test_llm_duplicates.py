import collections
import hashlib
import random

import numpy as np
import pytest

from assayer.llm import near_dup
from assayer.llm.common import hashes, long_windows, rolling
from assayer.llm.components import components
from assayer.llm.decontamination import Items, blocks, find
from assayer.llm.near_dup import link
from assayer.llm.substrings import cut, remove_repeats

from .conftest import DOCUMENT, prose


def shingles(text, k):
    found = (text or "").encode().lower().split()
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + k]) for i in range(len(found) - k + 1)) if len(found) >= k else frozenset([tuple(found)])


def brute_components(rows, k):
    sets = {r[0]: shingles(r[1], k) for r in rows if r[0] is not None}
    of = {i: i for i in sets}
    while True:
        before = dict(of)
        for i in sets:
            for j in sets:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    of[i] = min(of[i], of[j])
        if of == before:
            return sets, of


@pytest.mark.parametrize("k", [2, 5])
def test_components_equal_brute_force(spark, docs, rows, k):
    rng = random.Random(8)
    more = []
    original = prose(rng, 120).split()
    more.append((160, " ".join(original), "en", "s", 1))
    for i in range(60):  # a star: copies are near the original, less so each other
        near = list(original)
        for place in rng.sample(range(len(near)), 1 if k == 5 else 4):
            near[place] = f"new{i}x{place}"
        more.append((100 + i, " ".join(near), "en", "s", 1))
    chain = [f"w{j}" for j in range(120)]
    for i in range(12):
        more.append((200 + i, " ".join(chain[2 * i : 2 * i + 90]), "en", "s", 1))
    given = spark.createDataFrame(more, DOCUMENT).repartition(3)
    rows = [*rows, *more]
    sets, of = brute_components(rows, k)
    found = link(docs.select(*DOCUMENT.names).unionByName(given), k=k).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), of[r.doc_id], of[r.doc_id] == r.doc_id), r.doc_id


@pytest.mark.parametrize("beside", [1024, 3])
def test_links_that_the_trees_miss_are_found(spark, docs, rows, monkeypatch, beside):
    found = near_dup.neighbours
    monkeypatch.setattr(near_dup, "neighbours", lambda nodes: found(nodes).limit(0))
    monkeypatch.setattr(near_dup, "BESIDE", beside)
    rng = random.Random(9)
    more = []
    for base in range(3):
        original = prose(rng, 60 + 50 * base).split()
        for i in range(12):
            near = list(original)
            for place in rng.sample(range(len(near)), i):
                near[place] = f"new{base}x{i}x{place}"
            more.append((300 + 20 * base + i, " ".join(near), "en", "s", 1))
    more += [(400 + i, " ".join(f"v{j}" for j in range(2 + i)), "en", "s", 1) for i in range(12)]
    sets, of = brute_components([*rows, *more], 2)
    result = link(docs.select(*DOCUMENT.names).unionByName(spark.createDataFrame(more, DOCUMENT)), k=2).collect()
    assert {r.doc_id: r.component_id for r in result if r.doc_id is not None} == of


def test_bitmaps_never_count_too_many_differences():
    rng = np.random.default_rng(5)
    for size in (0, 1, 3, 31, 32, 33, 64, 500, 5000):
        for other in (size, size + 1, size + size // 5 + 2):
            x = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            y = np.unique(np.concatenate([x[len(x) // 4 :], rng.integers(0, 2**64, other - len(x) + len(x) // 4, dtype=np.uint64)]))
            differ = len(np.setxor1d(x, y))
            found = near_dup.differing(near_dup.bitmap(x), near_dup.bitmap(y))
            assert differ // 3 <= found <= differ, (size, other)
            assert near_dup.differing(near_dup.bitmap(y), near_dup.bitmap(x)) == found


@pytest.mark.parametrize("beside", [1024, 2])
def test_texts_of_pairs_far_apart_are_not_read(spark, monkeypatch, beside):
    """Texts of the same passages share all their shingles with some others, but only the planted pairs are similar."""
    rng = random.Random(10)
    passages = [" ".join(f"p{i}w{j}" for j in range(6)) for i in range(40)]
    rows = [(i, " ".join(rng.sample(passages, 8))) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " more") for i in range(5)]
    read, confirmed = [], near_dup.confirmed
    monkeypatch.setattr(near_dup, "confirmed", lambda pairs, *a: read.append(pairs.count()) or confirmed(pairs, *a))
    monkeypatch.setattr(near_dup, "BESIDE", beside)
    found = near_dup.neighbours
    monkeypatch.setattr(near_dup, "neighbours", lambda nodes: found(nodes).limit(0))
    sets, of = brute_components(rows, 2)
    assert sum(bool(sets[i] & sets[j]) for i in sets for j in sets if i < j) > 500
    result = link(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()
    assert {r.doc_id: r.component_id for r in result} == of and sum(i != j for i, j in of.items()) == 5
    assert read[-1] < 20


@pytest.mark.parametrize("beside", [1024, 3])
def test_texts_that_share_few_rare_shingles_do_not_meet(spark, monkeypatch, beside):
    """All texts of a group have some phrases in common: these must not make every two of them candidates."""
    phrases = lambda i: (f"g{i % 4}p{j}a g{i % 4}p{j}b t{i}u{j}" for j in range(12))
    rows = [(i, " ".join([*phrases(i), *(f"t{i}w{j}" for j in range(60))])) for i in range(80)]
    rows += [(100 + i, rows[i][1] + " more") for i in range(5)]
    rows += [(200 + i, " ".join(f"s{i // 2}w{j}" for j in range(5 + i % 2))) for i in range(10)]
    met, kept, prefixes, found = [], near_dup.kept, near_dup._by_prefixes, near_dup.neighbours

    def recorded(*given):
        monkeypatch.setattr(near_dup, "kept", lambda frame: met.append(out := kept(frame)) or out)
        out = prefixes(*given)
        monkeypatch.setattr(near_dup, "kept", kept)
        return out

    monkeypatch.setattr(near_dup, "_by_prefixes", recorded)
    monkeypatch.setattr(near_dup, "BESIDE", beside)
    monkeypatch.setattr(near_dup, "COUNTED", 1)  # the order knows nothing, so phrases are among the first of many
    monkeypatch.setattr(near_dup, "neighbours", lambda nodes: found(nodes).limit(0))
    sets, of = brute_components(rows, 2)
    result = link(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()
    assert {r.doc_id: r.component_id for r in result} == of and sum(i != j for i, j in of.items()) == 10
    assert met[-1].columns == ["a", "b"] and met[-1].count() == 10


def test_a_batch_of_pairs_is_held_in_parts(spark, monkeypatch):
    """Links are the same if texts and pairs are taken a few at a time."""
    monkeypatch.setattr(near_dup, "TEXTS", 3)
    monkeypatch.setattr(near_dup, "PAIRS", 10)
    found = near_dup.neighbours
    monkeypatch.setattr(near_dup, "neighbours", lambda nodes: found(nodes).limit(0))
    rng = random.Random(13)
    base = prose(rng, 100).split()
    rows = [(i, " ".join(w if rng.random() > 0.02 else f"n{i}x{j}" for j, w in enumerate(base))) for i in range(40)]
    sets, of = brute_components(rows, 2)
    result = link(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()
    assert {r.doc_id: r.component_id for r in result} == of


def test_nothing_is_linked_with_nothing(nothing):
    assert link(nothing).count() == 0


def test_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(1000, 1400)]
    star = [(5, i) for i in range(2000, 2300)]
    found = components(spark.createDataFrame([*chain, *star, (7, 7), (9, 8), (8, 9)], "a long, b long").repartition(7)).collect()
    want = {i: 1000 for i in range(1001, 1401)} | {i: 5 for i in range(2000, 2300)} | {9: 8}
    assert {r.id: r.component for r in found} == want and len(found) == len(want)


@pytest.mark.parametrize("block", [16, 1 << 18])
def test_links_of_many_blocks_and_of_one(spark, monkeypatch, block):
    """Links that fit one block are contracted in one task, without rounds; those of many blocks meet in rounds."""
    from assayer.llm import components as module

    rounds, real = [], module._stars
    monkeypatch.setattr(module, "LINKS", block)
    monkeypatch.setattr(module, "_stars", lambda edges: rounds.append(1) or real(edges))
    chain = [(i, i + 1) for i in range(1000, 1100)]
    found = components(spark.createDataFrame([*chain, (7, 7), (9, 8), (8, 9), (8, 9)], "a long, b long").repartition(7)).collect()
    want = {i: 1000 for i in range(1001, 1101)} | {9: 8}
    assert {r.id: r.component for r in found} == want and len(found) == len(want)
    assert bool(rounds) == (block == 16)


def brute_removed(rows, window):
    order = sorted((r for r in {r[0]: r for r in rows if r[0] is not None}.values()), key=lambda r: r[0])
    seen, out = set(), {}
    for doc, text, *_ in order:
        found = (text or "").encode().split()
        gone = [False] * len(found)
        for p in range(len(found) - window + 1):
            key = tuple(found[p : p + window])
            if key in seen:
                gone[p : p + window] = [True] * window
            seen.add(key)
        stay = [w for w, g in zip(found, gone, strict=True) if not g]
        out[doc] = len(found), sum(gone), hashlib.sha256(b" ".join(stay)).hexdigest()
    return out


@pytest.mark.parametrize("window,prefix", [(20, 6), (4, 2)])
def test_removed_words_equal_brute_force(docs, rows, nothing, partitions, window, prefix):
    want = brute_removed(rows, window)
    found = remove_repeats(docs, window, prefix).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.row.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.row.doc_id], r.row.doc_id
        if not r.n_removed:
            assert r.cut_text == r.row.text
    assert remove_repeats(nothing).count() == 0


def test_what_stays_is_untouched():
    assert cut(b" a  b\tc d\ne f ", np.array([0, 0, 1, 1, 0, 0], bool)) == b"a  b e f"
    assert cut(b"a b", np.array([1, 1], bool)) == b""


def test_window_hashes_tell_windows_apart():
    rng = random.Random(3)
    items = [rng.choice([b"a", b"b"]) for _ in range(400)]
    for k in (1, 2, 5, 20):
        for values in (rolling(hashes(items), k), long_windows(hashes(items), k)):
            names = [tuple(items[i : i + k]) for i in range(len(items) - k + 1)]
            assert len(set(zip(names, values.tolist(), strict=True))) == len(set(names)) == len(set(values.tolist()))


def test_blocks_guarantee_the_radius():
    rng = np.random.default_rng(1)
    for radius in (3, 9):
        for _ in range(200):
            a = rng.integers(0, 2**63, 1, dtype=np.uint64)
            b = a.copy()
            for bit in rng.choice(64, radius, replace=False):
                b ^= np.uint64(1) << np.uint64(bit)
            assert any((x == y).all() for x, y in zip(blocks(a, radius), blocks(b, radius), strict=True))


def test_items_are_found_whatever_the_case(docs, items, nothing, rows):
    found = [(r.row.doc_id, r.matches) for r in find(docs, items).collect()]
    assert len(found) == len(rows)
    matched = {doc: sorted(m.item_id for m in matches) for doc, matches in found if matches}
    assert matched == {6: [1, 1]}
    assert all(m.start == 5 and m.n_words == 30 and m.similarity == pytest.approx(1) for doc, matches in found if matches for m in matches)
    assert find(nothing, items).count() == 0
    assert all(not r.matches for r in find(docs, items.limit(0)).collect())


def test_similarity_is_exact():
    rng = random.Random(9)
    item = prose(rng, 58)
    part = Items([(1, item), (2, prose(rng, 40))], 9)
    words = item.split()
    near = [*words[:57], "changed"]
    from assayer.llm.decontamination import Hashes

    own, other = (set(zip(*[w[i:] for i in range(5)], strict=False)) for w in (words, near))
    weight = collections.Counter()
    weight.update(own)
    texts = Hashes()(["", " ".join(["before"] * 30 + near + ["after"] * 30)])
    none, hits = part.hits(texts)
    best = part.search(texts[1], hits)
    assert not len(none)
    one = np.log1p(2)
    assert len(best) == 1 and best[0]["similarity"] == pytest.approx(len(own & other) * one / (len(own | other) * one))


def test_no_edge_cut_or_edge_changed_item_is_missed():
    """Against brute force over all windows; words replaced or cut off at an edge change many bits of a fingerprint."""
    from assayer.llm.decontamination import SIMILARITY, Hashes

    rng = random.Random(12)
    fresh = lambda n: [f"w{rng.getrandbits(40)}" for _ in range(n)]
    texts = [fresh(n) for n in range(22, 95, 3) for _ in range(4)]
    texts += [(fresh(6) * 9)[: rng.randint(30, 50)] for _ in range(20)] + [fresh(n) for n in (1, 3, 4, 5, 6)]
    part = Items(list(enumerate(" ".join(x) for x in texts)))
    missed = [0, 0]
    for i, words in enumerate(texts):
        cut, n = len(words) // 10, len(words)
        for near in (words[cut:], words[: n - cut], [*fresh(cut), *words[cut:]], [*words[: n - cut], *fresh(cut)]):
            h, = Hashes()([" ".join([*fresh(30), *near, *fresh(30), *words[: n // 2]])])
            found = {m["item_id"]: m for m in part.search(h, part.hits([h])[0])}
            alike = [part.similarity(h[at : at + n], i) for at in range(len(h) - n + 1)]
            if max(alike) < SIMILARITY - 1e-9:
                assert i not in found
                continue
            assert i in found and found[i]["similarity"] == pytest.approx(max(alike)), (i, max(alike))
            assert part.similarity(h[found[i]["start"] :][:n], i) == found[i]["similarity"]
            missed[found[i]["distance"] > 9] += 1
    assert missed[1] > 20  # beyond the radius there was


def test_links_inside_a_template_are_found(spark):
    """Texts that share a template lie just below the limit; only planted pairs of them are linked."""
    rng = random.Random(4)
    size, n, pairs = 400, 600, 150
    rows = []
    for i in range(n):
        text = [f"t{j}" for j in range(size)]
        for place in rng.sample(range(0, size, 3), 32):
            text[place] = f"u{i}x{place}"
        rows.append(text)
    for q in range(pairs):
        rows[2 * q + 1] = list(rows[2 * q])
        for place in rng.sample(range(1, size, 3), 20):
            rows[2 * q + 1][place] = f"v{q}x{place}"
    sets = [shingles(" ".join(x), 2) for x in rows]
    similar = lambda i, j: 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    assert all(similar(2 * q, 2 * q + 1) for q in range(pairs)) and not any(similar(i, i + 2) for i in range(n - 2))
    given = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(rows)], "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.component_id for r in link(given, k=2).collect()}
    assert sum(found[2 * q + 1] == 2 * q for q in range(pairs)) >= 0.99 * pairs
    assert all(found[i] == i for i in range(n) if i >= 2 * pairs or i % 2 == 0)
