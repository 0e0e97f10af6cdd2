"""A quality classifier from weak labels.

Overlapping heuristics vote on whether a text is junk and on whether it is toxic; they may abstain. For each
of the two, expectation-maximisation over the counts of vote patterns estimates how accurate each heuristic
is. The posterior labels of a bounded sample train a linear scorer over hashed features of the text, and the
scorer alone judges every document.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain, islice, repeat
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, documents, hashes, kept, mix, worker_state

# Labelled rows from which the list of toxic words is taken, and the list's longest length.
LABELLED, LISTED = 100_000, 5_000
# A unit is listed if its being in toxic texts only has a chance below exp(-CHANCE).
CHANCE = 8.0
# Rows of each posterior class that train the scorer; the scorer's hashed features.
SAMPLE, FEATURES = 4_000, 1 << 18
# Lengths of the word beginnings that stand beside whole words.
BEGINNINGS = (4, 5, 6)
EDGES = ".,;:!?|%$&*#()[]\"'"
SYMBOLS, CAPITALS = b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
JUNK, TOXIC = ("symbols", "capitals", "doubled", "varied", "marks"), ("words", "beginnings", "dense")
ABSTAIN, GOOD, BAD = 0, 1, 2
# For each junk heuristic the share up to which it votes good and from which it votes bad.
SHARES = ((0.01, 0.06), (0.15, 0.4), (0.02, 0.2), (-0.4, -0.2), (0.02, 0.1))
# Steps of the same shares that are features of the scorer.
STEPS = ((0.01, 0.03, 0.06, 0.12, 0.25), (0.1, 0.15, 0.25, 0.4, 0.6), (0.02, 0.05, 0.1, 0.2, 0.4), (-0.4, -0.3, -0.2, -0.1), (0.02, 0.05, 0.1, 0.3, 0.6))
# A feature is used if so many sample rows have it and its log odds are so large.
LEAST, TOLD = 8, 2.5
MEMO = 200_000


def units(words: list[str]) -> np.ndarray:
    """A row per word: hashes of the word and of its beginnings, 0 where it has none; punctuation around it doesn't count."""
    bare = [w.strip(EDGES) for w in words]
    sizes = np.fromiter(map(len, bare), np.int64, len(bare))
    out = np.zeros((len(bare), 1 + len(BEGINNINGS)), np.uint64)
    out[:, 0] = np.where(sizes > 0, hashes([b.encode("utf-8", "replace") for b in bare]) | np.uint64(1), np.uint64(0))
    longest = max(BEGINNINGS)
    heads = np.array([b[:longest] for b in bare], f"U{longest}").view(np.uint32).reshape(-1, longest).astype(np.uint64)
    for column, n in enumerate(BEGINNINGS, start=1):
        sums = np.full(len(bare), n, np.uint64)
        for j in range(n):
            sums = sums * np.uint64(BASE) + heads[:, j]
        out[:, column] = np.where(sizes > n, mix(sums) | np.uint64(1), np.uint64(0))
    return out


class Vocabulary:
    """Words of texts as numbers, each with the hashes of its units, kept between a worker's tasks.

    Words are known by this process's 64-bit hashes of them. When there are too many, the half that was used most
    stays: most words of a corpus are met once, and those that most texts have needn't be learned anew.
    """

    def __init__(self) -> None:
        self.keys = np.zeros(0, np.int64)
        self.hashes = np.zeros((0, 1 + len(BEGINNINGS)), np.uint64)
        self.uses = np.zeros(0, np.int64)
        self.generation = 0
        self._sort()

    def _sort(self) -> None:
        self.order = np.argsort(self.keys, kind="stable")
        self.rising = self.keys[self.order]

    def _look(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.rising, keys), len(self.keys) - 1)
        return np.where(self.rising[at] == keys, self.order[at], -1)

    def _forget(self) -> None:
        stay = np.sort(np.argsort(-self.uses, kind="stable")[: MEMO // 2])
        # Later uses count for more.
        self.keys, self.hashes, self.uses = self.keys[stay], self.hashes[stay], self.uses[stay] // 2
        self.generation += 1
        self._sort()

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        self.keys = np.concatenate([self.keys, keys])
        self.hashes = np.concatenate([self.hashes, units(words)])
        self.uses = np.concatenate([self.uses, np.zeros(len(keys), np.int64)])
        self._sort()

    def numbers(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The numbers of each text's distinct words, which are learned if they are new."""
        words = list(chain.from_iterable(texts))
        keys, first, place = np.unique(np.fromiter(map(hash, words), np.int64, len(words)), return_index=True, return_inverse=True)
        found = self._look(keys)
        if len(self.keys) + (found < 0).sum() > MEMO:
            self._forget()
            found = self._look(keys)
        new = np.flatnonzero(found < 0)
        if len(new):
            self._learn(keys[new], [words[i] for i in first[new].tolist()])
            found[new] = np.arange(len(self.keys) - len(new), len(self.keys))
        # Each text's distinct words, by their places among those of all these texts.
        pairs = np.sort(np.repeat(np.arange(len(texts)), [len(x) for x in texts]) * len(keys) + place)
        owner, place = np.divmod(pairs[np.diff(pairs, prepend=-1) > 0], max(len(keys), 1))
        numbers = found[place]
        self.uses += np.bincount(numbers, minlength=len(self.keys))
        ends = np.searchsorted(owner, np.arange(len(texts) + 1))
        return [numbers[i:j] for i, j in zip(ends, ends[1:], strict=False)]


class Told:
    """What is told of each word of a vocabulary by its units, worked out once a word."""

    def __init__(self, vocabulary: Vocabulary, tell: Callable[[np.ndarray], np.ndarray]) -> None:
        self.vocabulary, self.tell = vocabulary, tell
        self.generation, self.values = -1, np.zeros(0)

    def sum(self, numbers: np.ndarray) -> float:
        if self.generation != self.vocabulary.generation:
            self.generation, self.values = self.vocabulary.generation, np.zeros(0)
        done, size = len(self.values), len(self.vocabulary.hashes)
        if done < size:
            self.values = np.concatenate([self.values, self.tell(self.vocabulary.hashes[done:size])])
        return float(self.values[numbers].sum())


def shares(text: str, words: list[str], distinct: int) -> list[float]:
    """What the junk heuristics look at: how much of the text is symbols, capitals, doubled words; how varied it is; marks."""
    chars = max(len(text) - text.count(" ") - text.count("\n"), 1)
    n = max(len(words), 1)
    doubled = sum(map(eq, words, islice(words, 1, None)))
    raw = text.encode("utf-8", "replace")
    symbols, capitals = (len(raw) - len(raw.translate(None, signs)) for signs in (SYMBOLS, CAPITALS))
    marks = text.count("!!") + text.count("|") + (sum(text.count(3 * c) for c in SYMBOLS.decode()) if symbols else 0)
    return [symbols / chars, capitals / chars, doubled / n, -distinct / n if n >= 50 else -1.0, marks / n]


def vocabulary() -> Vocabulary:
    return worker_state("weak_label_words", Vocabulary)


def read(batch: pa.RecordBatch) -> Iterator[tuple[int, list[float], np.ndarray, int]]:
    """For each text its place, shares, the numbers of its distinct words and how many words it has."""
    book = vocabulary()
    texts = batch.column("text")
    for at in range(0, len(texts), 256):
        part = [x or "" for x in texts.slice(at, 256).to_pylist()]
        split = [x.lower().split() for x in part]
        for i, (text, words, numbers) in enumerate(zip(part, split, book.numbers(split), strict=True)):
            yield at + i, shares(text, words, len(numbers)), numbers, len(words)


def listed_units(listed: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """How many of each word's units are listed as toxic."""
    return lambda hashes: np.isin(hashes, listed).sum(axis=1).astype(float) if len(listed) else np.zeros(len(hashes))


def toxic_units(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(unit): hashes of words and beginnings that labelled toxic texts have and others hardly ever do."""
    marked = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter("toxic IS NOT NULL").orderBy(F.xxhash64("doc_id")).limit(LABELLED)
    # The labelled rows are LABELLED at most, so the texts need not move to meet them.
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(marked), "doc_id").select("text", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = batch.column("toxic").to_numpy(zero_copy_only=False) == 1
            found = [np.unique(vocabulary().hashes[numbers]) for _, _, numbers, _ in read(batch)]
            if not found:
                continue
            sizes = [len(x) for x in found]
            names, which = np.unique(np.concatenate(found), return_inverse=True)
            toxic = np.bincount(which, np.repeat(flags, sizes), len(names)).astype(np.int64)
            clean = np.bincount(which, minlength=len(names)) - toxic
            # Unit 0, what a word has not, counts the texts.
            names = np.append(names[names > 0], np.uint64(0))
            toxic, clean = (np.append(x[-len(names) + 1 :] if len(names) > 1 else x[:0], n) for x, n in ((toxic, flags.sum()), (clean, (~flags).sum())))
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(clean), pa.array(toxic)], names=["unit", "clean", "toxic"])

    counted = chosen.mapInArrow(run, "unit long, clean long, toxic long").groupBy("unit").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counted = kept(counted.filter("unit = 0 OR toxic >= 3"))
    total = counted.filter("unit = 0").first()
    if total is None or not total.toxic:
        return counted.filter("false").select("unit")
    odds = F.ln((F.col("toxic") + 0.5) / (total.toxic + 1)) - F.ln((F.col("clean") + 0.5) / (total.clean + 1))
    rare = F.col("clean") * 500 <= F.lit(total.clean)
    # How unlikely it is that so many of the labelled texts that have the unit are toxic by chance.
    chance = F.col("toxic") * math.log(max(total.toxic + total.clean, 2) / total.toxic)
    told = (odds >= 3.5) & (chance >= CHANCE) & (F.col("toxic") >= 20 * F.col("clean"))
    return counted.filter((F.col("unit") != 0) & rare & told).orderBy(F.desc(odds), "unit").limit(LISTED).select("unit")


def votes(docs: DataFrame, listed: np.ndarray) -> DataFrame:
    """(doc_id, junk, toxic): the heuristics' votes, one digit of base 3 each. `listed` has LISTED hashes at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = Told(vocabulary(), listed_units(listed))
        for batch in batches:
            out = np.zeros((batch.num_rows, 2), np.int64)
            for i, found, numbers, n in read(batch):
                junk = [BAD if x >= bad else GOOD if x <= good else ABSTAIN for x, (good, bad) in zip(found, SHARES, strict=True)]
                hits = told.sum(numbers)
                # Whole words and beginnings are hashed alike: one hit may be a beginning, several are a word with its own.
                toxic = [BAD if hits >= 2 else GOOD, BAD if hits else GOOD, BAD if hits > 0.004 * n else GOOD if not hits else ABSTAIN]
                for j, kinds in enumerate((junk, toxic)):
                    for vote in kinds if n else [ABSTAIN] * len(kinds):
                        out[i, j] = out[i, j] * 3 + vote
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out[:, 0]), pa.array(out[:, 1])], names=["doc_id", "junk", "toxic"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, junk long, toxic long")


def label_model(patterns: np.ndarray, counts: np.ndarray, heuristics: int, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior probability of bad for each pattern, and P(vote | good or bad) for each heuristic.

    Begins with every pattern that has a bad vote taken as bad; votes are independent given the class.
    """
    digits = patterns[:, None] // 3 ** np.arange(heuristics)[::-1] % 3
    bad = np.where((digits == BAD).any(axis=1), 0.9, 0.05)
    table = np.zeros((2, heuristics, 3))
    for _ in range(rounds):
        for y, weight in enumerate((1 - bad, bad)):
            for v in range(3):
                table[y, :, v] = ((digits == v) * (weight * counts)[:, None]).sum(axis=0) + 0.5
        table /= table.sum(axis=2, keepdims=True)
        prior = min(max((bad @ counts + 1) / (counts.sum() + 2), 1e-4), 0.5)
        logs = [np.log(table[y][np.arange(heuristics), digits]).sum(axis=1) for y in range(2)]
        bad = 1 / (1 + np.exp(np.clip(logs[0] - logs[1] + np.log((1 - prior) / prior), -500, 500)))
    return bad, table


def steps_of(found: list[float], hits: float) -> np.ndarray:
    """Places of a text's hashed features that aren't words: every step that its shares and its listed units reach."""
    own = [_step(name, step) for name, x, steps in zip(JUNK, found, STEPS, strict=True) for step in steps if x >= step]
    own += [_step("listed", step) for step in (1, 2, 3, 5) if hits >= step]
    return (np.array(own, np.uint64) % np.uint64(FEATURES)).astype(np.int64)


def features(found: list[float], own: np.ndarray, hits: float) -> np.ndarray:
    """Places of all of a text's hashed features, a unit once for each distinct word that has it."""
    return np.concatenate([(own[own > 0] % np.uint64(FEATURES)).astype(np.int64), steps_of(found, hits)])


@cache
def _step(name: str, step: float) -> int:
    return xxhash.xxh3_64_intdigest(f"{name} {step}")


def fit(rows: list[np.ndarray], target: np.ndarray, rounds: int = 400, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer; features that few rows have or that tell little stay at 0.

    Both classes weigh the same. The squared weights are penalised, so a feature of a few rows stays weak.
    """
    weights, bias = np.zeros(FEATURES), 0.0
    if not len(target):
        return weights, -10.0
    place = np.concatenate(rows)
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(x) for x in rows])
    bad = np.bincount(place, target[row], FEATURES)
    good = np.bincount(place, minlength=FEATURES) - bad
    odds = np.log((bad + 0.5) / (target.sum() + 1)) - np.log((good + 0.5) / ((1 - target).sum() + 1))
    told = (bad + good >= LEAST) & (np.abs(odds) >= TOLD)
    use = told[place]
    place, row = place[use], row[use]
    names, place = np.unique(place, return_inverse=True)
    share = max(target.mean(), 1e-6)
    weight = np.where(target >= 0.5, 0.5 / share, 0.5 / max(1 - share, 1e-6))
    w = np.zeros(len(names) + 1)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):  # Adam over the whole sample
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[place], len(target)) + w[-1], -30, 30)))
        error = (p - target) * weight
        slope = np.append(np.bincount(place, error[row], len(names)) + penalty * w[:-1], error.sum())
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        w -= 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    weights[names] = w[:-1]
    return weights, float(w[-1])


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs' rows, as struct `row`, with `bad` (probability) and `kept`.

    Labels only give the list of toxic words, from LABELLED rows at most; without any, nothing is toxic. At
    most SAMPLE rows of either posterior class, those with the lowest hashes of doc_id, train the scorer. Null
    or empty text has no words: it is bad, score 1. Repeated rows and null ids are judged each; an empty table
    gives an empty result.
    """
    listed = np.array([r[0] for r in toxic_units(docs, labels).collect()], np.int64).view(np.uint64)
    voted = kept(votes(docs, listed))
    post = {}
    for facet, kinds in (("junk", JUNK), ("toxic", TOXIC)):
        found = voted.groupBy(facet).count().toPandas()
        if len(found):
            bad, _ = label_model(found[facet].to_numpy(), found["count"].to_numpy(), len(kinds))
            post[facet] = dict(zip(found[facet].tolist(), bad.tolist(), strict=True))

    def posterior(facet: str):
        pairs = [F.lit(x) for pair in post[facet].items() for x in pair]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(facet)), F.lit(0.0))

    weights, bias = fit([], np.zeros(0))
    if post:
        labelled = voted.withColumn("bad", 1 - (1 - posterior("junk")) * (1 - posterior("toxic"))).select("doc_id", "bad").filter("doc_id IS NOT NULL")
        halves = [labelled.filter(side).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(SAMPLE) for side in ("bad >= 0.5", "bad < 0.5")]
        sample = kept(halves[0].unionByName(halves[1]).dropDuplicates(["doc_id"]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            told = Told(vocabulary(), listed_units(listed))
            for batch in batches:
                found = [features(s, vocabulary().hashes[x], told.sum(x)) for _, s, x, _ in read(batch)]
                yield pa.RecordBatch.from_arrays([batch.column("bad"), pa.array([x.astype(np.int32).tobytes() for x in found], pa.binary())], names=["bad", "features"])

        # The sample's size is bounded: SAMPLE rows of each class.
        chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
        rows = chosen.select("text", "bad").mapInArrow(run, "bad double, features binary").toArrow()
        weights, bias = fit([np.frombuffer(x, np.int32) for x in rows.column("features").to_pylist()], rows.column("bad").to_numpy())
    sent = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias, listed))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, listed = sent.value
        weight = lambda hashes: (weights[(hashes % np.uint64(FEATURES)).astype(np.int64)] * (hashes > 0)).sum(axis=1, dtype=np.float64)
        words, told = Told(vocabulary(), weight), Told(vocabulary(), listed_units(listed))
        for batch in batches:
            out = np.ones(batch.num_rows)
            for i, s, numbers, n in read(batch):
                if n:
                    log = words.sum(numbers) + weights[steps_of(s, told.sum(numbers))].sum(dtype=np.float64) + bias
                    out[i] = 1 / (1 + np.exp(-np.clip(log, -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out)], names=["row", "bad"])

    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    schema = rows.select("row", F.lit(0.0).alias("bad")).schema
    return rows.mapInArrow(judge, schema).withColumn("kept", F.col("bad") < threshold)


def op2_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("row.doc_id", F.col("bad").alias("bad_probability"), "kept")
