"""Benchmark decontamination: windows as long as an item, compared exactly by their weighted shingles.

A window can reach the similarity asked for only if it holds that share of the item's own weight. So the items
whose weight a text's shingles make up so far are looked for in it, and the weighted Jaccard similarities of all
their windows follow from two running sums: nothing is left out by chance. SimHash fingerprints tell how far
the best window is from its item; they leave windows out only if a radius is asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, kept, rolling, worker_state

SHINGLE, SIMILARITY = 5, 0.8
# What sums of weights may be off by.
ROUNDING = 1e-9
# Items that are sent to every task at once; a larger benchmark takes more passes over the documents.
ITEMS_AT_ONCE = 20_000
EDGES = b".,;:!?|%$&*#()[]\"'"
MEMO = 600_000
BITS = np.arange(64, dtype=np.uint64)


class Hashes:
    """Hashes of words without case and the punctuation around them; a word of nothing else has 0 and is skipped."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        split = [t.lower().split() for t in texts]
        new: set[str] = set()
        for words in split:
            new.update(filterfalse(self.known.__contains__, words))
        if len(self.known) + len(new) > MEMO:
            self.known, new = {}, set().union(*split)
        self.known.update((w, self.of(w)) for w in new)
        found = [np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words)) for words in split]
        return [h[h > 0] for h in found]

    @staticmethod
    def of(word: str) -> int:
        bare = word.encode("utf-8", "replace").strip(EDGES)
        return xxhash.xxh3_64_intdigest(bare) | 1 if bare else 0


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """64-bit fingerprints from sums of signs, a column per bit."""
    return ((sums > 0).astype(np.uint64) << BITS).sum(axis=1, dtype=np.uint64)


def signs(h: np.ndarray) -> np.ndarray:
    return ((h[:, None] >> BITS) & np.uint64(1)).astype(np.int32) * 2 - 1


def blocks(prints: np.ndarray, radius: int) -> list[np.ndarray]:
    """The radius + 1 blocks of fingerprints."""
    edges = np.linspace(0, 64, radius + 2).astype(int)
    return [(prints >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]


class Items:
    """A bounded part of the benchmark, ready to be searched for."""

    def __init__(self, rows: list[tuple[int, str]], radius: int | None = None) -> None:
        hashed = Hashes()([t or "" for _, t in rows])
        found = [(i, h) for (i, _), h in zip(rows, hashed, strict=True) if len(h)]
        self.radius = radius
        self.ids = [i for i, _ in found]
        self.sizes = np.array([len(h) for _, h in found], np.int64)
        self.shingles = [np.unique(rolling(h, min(SHINGLE, len(h)))) for _, h in found]
        # Shingles that few items have weigh more.
        names, counts = np.unique(np.concatenate(self.shingles or [np.empty(0, np.uint64)]), return_counts=True)
        self.names, self.weights = names, np.log1p(len(found) / np.maximum(counts, 1))
        self.prints = np.array([fingerprints(signs(h).sum(axis=0)[None])[0] for _, h in found], np.uint64)
        self.totals = np.array([self.weight(x).sum() for x in self.shingles])
        # The items of each shingle, side by side.
        self.places = [np.searchsorted(names, x) for x in self.shingles]
        place = np.concatenate([*self.places, np.empty(0, np.int64)]).astype(np.int64)
        self.holders = np.repeat(np.arange(len(found)), [len(x) for x in self.places])[np.argsort(place, kind="stable")]
        self.edges = np.cumsum([0, *counts.tolist()])
        self.lengths = sorted({min(int(n), SHINGLE) for n in self.sizes})
        self.seen = np.zeros(1 << 22, bool)
        self.seen[names >> np.uint64(42)] = True

    def hits(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """For each text the places where a shingle of some item begins."""
        h = np.concatenate(texts)
        text = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
        found = []
        for k in self.lengths:
            own = rolling(h, k)
            at = np.flatnonzero(self.seen[own >> np.uint64(42)])
            at = at[text[at] == text[at + k - 1]]
            near = np.minimum(np.searchsorted(self.names, own[at]), len(self.names) - 1)
            found.append(at[self.names[near] == own[at]])
        places = np.unique(np.concatenate(found))
        starts = np.cumsum([0, *(len(x) for x in texts)])
        cuts = np.searchsorted(places, starts)
        return [places[a:b] - start for a, b, start in zip(cuts[:-1], cuts[1:], starts[:-1], strict=True)]

    def weight(self, shingles: np.ndarray) -> np.ndarray:
        """Weights; a shingle of no item weighs as one of a single item."""
        if not len(self.names):
            return np.ones(len(shingles))
        at = np.minimum(np.searchsorted(self.names, shingles), len(self.names) - 1)
        return np.where(self.names[at] == shingles, self.weights[at], np.log1p(len(self.ids)))

    def possible(self, place: np.ndarray) -> np.ndarray:
        """The items of which these shingles, named by their places, make up the share of weight that a match needs."""
        place = np.unique(place)
        low, counts = self.edges[place], self.edges[place + 1] - self.edges[place]
        at = np.repeat(low, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        shared = np.bincount(self.holders[at], np.repeat(self.weights[place], counts), len(self.ids))
        return np.flatnonzero(shared >= (SIMILARITY - ROUNDING) * self.totals)

    def search(self, h: np.ndarray, hits: np.ndarray) -> list[dict]:
        """The best window of each item that a text's words have in it."""
        best: dict[int, dict] = {}
        largest = int(self.sizes.max())
        # Places further apart than the longest item are looked at apart.
        for part in np.split(hits, np.flatnonzero(np.diff(hits) > largest) + 1):
            a, b = max(0, int(part[0]) - largest), min(len(h), int(part[-1]) + largest + SHINGLE)
            for k in self.lengths:
                own = rolling(h[a:b], k)
                near = np.minimum(np.searchsorted(self.names, own), len(self.names) - 1)
                known = np.flatnonzero(self.names[near] == own)
                known = known[np.argsort(near[known], kind="stable")]
                place = near[known]
                items = [i for i in self.possible(place).tolist() if min(SHINGLE, self.sizes[i]) == k]
                if not items:
                    continue
                weight = self.weight(own)
                # Where each shingle was before: a window counts it once.
                order = np.argsort(own, kind="stable")
                again = own[order[1:]] == own[order[:-1]]
                before = np.full(len(own), -1)
                before[order[1:][again]] = order[:-1][again]
                for i in items:
                    low, high = (np.searchsorted(place, self.places[i], side) for side in ("left", "right"))
                    counts = high - low
                    at = np.sort(known[np.repeat(low, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)])
                    for found in np.split(at, np.flatnonzero(np.diff(at) >= self.sizes[i] - k + 1) + 1):
                        if weight[found].sum() >= (SIMILARITY - ROUNDING) * self.totals[i]:
                            self._best(best, h, a, i, found, weight, before)
        return [best[i] for i in sorted(best)]

    def _best(self, best: dict[int, dict], h: np.ndarray, a: int, item: int, found: np.ndarray, weight: np.ndarray, before: np.ndarray) -> None:
        """Compare the item with all windows around the places, counted from `a`, where its shingles were found."""
        n = int(self.sizes[item])
        m = n - min(SHINGLE, n) + 1
        low, high = max(0, int(found[0]) - m + 1), min(len(weight), int(found[-1]) + m)
        starts = high - low - m + 1
        if starts <= 0:
            return
        place = np.arange(high - low)
        # A shingle counts in the windows that begin after its place before and not after itself.
        begin = np.maximum(before[low:high] - low, np.maximum(place - m, -1)) + 1

        def sums(at: np.ndarray) -> np.ndarray:
            w = weight[low + at]
            return np.cumsum(np.bincount(begin[at], w, len(place) + 1) - np.bincount(at + 1, w, len(place) + 1))[:starts]

        common = sums(found - low)
        alike = common / (sums(place) + self.totals[item] - common)
        good = np.flatnonzero(alike >= SIMILARITY - 1e-6)
        if len(good) and self.radius is not None:
            signed = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(signs(h[a + low : a + low + starts + n - 1]), axis=0, dtype=np.int32)])
            good = good[np.bitwise_count(fingerprints(signed[good + n] - signed[good]) ^ self.prints[item]) <= self.radius]
        if not len(good):
            return
        start = a + low + int(good[alike[good] >= alike[good].max() - ROUNDING][0])
        window = h[start : start + n]
        exact = self.similarity(window, item)
        if exact >= SIMILARITY - ROUNDING and (item not in best or exact > best[item]["similarity"]):
            distance = int(np.bitwise_count(fingerprints(signs(window).sum(axis=0)[None])[0] ^ self.prints[item]))
            best[item] = {"item_id": self.ids[item], "start": start, "n_words": n, "similarity": exact, "distance": distance}

    def similarity(self, words: np.ndarray, item: int) -> float:
        own = np.unique(rolling(words, min(SHINGLE, len(words))))
        common = self.weight(np.intersect1d(own, self.shingles[item], assume_unique=True)).sum()
        return float(common / (self.weight(own).sum() + self.weight(self.shingles[item]).sum() - common))


MATCH = "struct<item_id:bigint,start:bigint,n_words:bigint,similarity:double,distance:int>"


def find(docs: DataFrame, items: DataFrame, radius: int | None = None) -> DataFrame:
    """docs' rows, as struct `row`, with `matches`: the items they contain, each with its best window.

    A match is a window as long as the item whose five-word shingles (fewer words: the whole) have a weighted
    Jaccard similarity of 0.8 or more with the item's. `start` counts words that aren't punctuation only. Null or
    empty texts and items match nothing; repeated rows and items are each reported; an empty benchmark matches nothing.
    With a `radius`, windows whose fingerprint is more bits away from the item's don't count.
    """
    total = items.count()
    parts = max(1, -(-total // ITEMS_AT_ONCE))
    chosen = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    numbered = chosen if parts == 1 else kept(chosen.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(parts))))
    found = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"), F.array().cast(f"array<{MATCH}>").alias("matches"))
    schema = found.schema
    for part in range(parts):
        some = numbered if parts == 1 else numbered.filter(F.col("part") == part).drop("part")
        sent = docs.sparkSession.sparkContext.broadcast((some.collect(), radius))  # ITEMS_AT_ONCE rows at most, about

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            rows, radius = sent.value
            part, hashed = Items([tuple(r) for r in rows], radius), worker_state("item_words", Hashes)
            for batch in batches:
                out = batch.column("matches").to_pylist()
                texts = batch.column("text").to_pylist()
                for at in range(0, len(texts) if part.ids else 0, 256):
                    found = hashed([t or "" for t in texts[at : at + 256]])
                    for i, (h, hits) in enumerate(zip(found, part.hits(found), strict=True)):
                        if len(hits):
                            out[at + i] = out[at + i] + part.search(h, hits)
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), pa.array(out, batch.schema.field("matches").type)], names=["row", "text", "matches"])

        found = found.mapInArrow(run, schema)
    return found.drop("text")


def op10_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("row.doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")
