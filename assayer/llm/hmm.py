"""A hidden Markov language model over words, trained by Baum-Welch on all learning documents.

Words are counted over the corpus by way of the blocks' dictionaries. Every word belongs to an emission
class: the most frequent words have one each, the others share one with the words that end alike. A state
emits a class, the class a word in proportion to its count, so the model's size is fixed while its word
counts grow with the corpus. Each iteration sums the expected counts of all partitions; the scaled forward
recursion gives each text's exact likelihood.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, crc_text, documents, encode, entries, grown, kept, shrunk

STATES = 6
# Words with a class of their own; classes that the others share by their last characters; their number.
OWN, SHARED, ENDING = 8192, 4096, 3
SMOOTH = 0.1
# Rarer words have no class of their own; what absolute discounting takes from an expected count.
OWN_LEAST, DISCOUNT = 10, 0.75
# Tokens whose recursions one task holds at a time.
CHUNK_TOKENS = 1_000_000
END = b""


def number(text: bytes, book: dict[bytes, int]) -> tuple[np.ndarray, None]:
    """A text's words and its end, A-Z in lower case, as places in the dictionary."""
    found = text.lower().split()
    found.append(END)
    return np.fromiter((book.setdefault(w, len(book)) for w in found), np.int64, len(found)), None


def word_classes(encoded: DataFrame) -> tuple[DataFrame, int, int, np.ndarray]:
    """(word, c, class) of every word; the number of training tokens and of distinct ones; the classes' masses.

    The last class is that of unknown words, which have mass `SMOOTH` together.
    """
    counted = kept(entries(encoded).groupBy("word").agg(F.sum("total").alias("c")))
    n, v = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    top = counted.filter(F.col("c") >= OWN_LEAST).orderBy(F.desc("c"), "word").limit(OWN).select("word").toPandas()["word"]
    own = counted.sparkSession.createDataFrame(pd.DataFrame({"word": [bytes(w) for w in top], "own": range(len(top))}), "word binary, own int")
    ending = F.pmod(F.xxhash64(F.right(F.col("word").cast("string"), F.lit(ENDING))), F.lit(SHARED)).cast("int")
    unknown = OWN + SHARED
    classes = F.when(F.col("c") == 0, unknown).otherwise(F.coalesce("own", ending + OWN))
    # The table of own classes has OWN rows at most.
    classed = kept(counted.join(F.broadcast(own), "word", "left").select("word", "c", classes.alias("class")))
    mass = np.zeros(unknown + 1)
    for row in classed.filter("c > 0").groupBy("class").agg(F.sum(F.col("c") + SMOOTH).alias("m")).collect():
        mass[row[0]] = row[1]
    mass[unknown] = SMOOTH
    return classed, int(n), int(v), mass


def by_class(encoded: DataFrame, classed: DataFrame, n: int, v: int, mass: np.ndarray) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, within, seq): texts as classes; within is ln P(words | classes)."""
    placed = entries(encoded).select("word", "block", "pos").join(classed, "word").select(F.col("block").alias("of"), "pos", "c", "class")
    z = n + SMOOTH * (v + 1)

    def rows(docs: pa.Table, book: pa.Table) -> pa.Table:
        order = np.argsort(book.column("pos").to_numpy())
        c = book.column("c").to_numpy()[order]
        kind = book.column("class").to_numpy()[order].astype(np.int64)
        log = np.log(c + SMOOTH)
        out = {k: [] for k in ("n_tokens", "n_known", "base_score", "within", "seq")}
        for packed in docs.column("seq").to_pylist():
            seq = grown(packed)
            logs = log[seq].sum()
            classes = kind[seq]
            values = (len(seq), int((c[seq] > 0).sum()), (logs - len(seq) * math.log(z)) / math.log(10), logs - np.log(mass[classes]).sum(), shrunk(classes))
            for k, x in zip(out, values, strict=True):
                out[k].append(x)
        kinds = dict(n_tokens=pa.int64(), n_known=pa.int64(), base_score=pa.float64(), within=pa.float64(), seq=pa.binary())
        return pa.table({"doc_id": docs.column("doc_id")} | {k: pa.array(x, kinds[k]) for k, x in out.items()})

    docs = encoded.filter(F.col("words").isNull()).select("block", "doc_id", "seq")
    schema = "doc_id long, n_tokens long, n_known long, base_score double, within double, seq binary"
    return kept(docs.groupBy("block").cogroup(placed.groupBy("of")).applyInArrow(rows, schema))


class Lanes:
    """Texts side by side, longest first, so that at each step those still running are a prefix."""

    def __init__(self, texts: list[np.ndarray]) -> None:
        sizes = np.array([len(x) for x in texts])
        self.order = np.argsort(-sizes, kind="stable")
        sizes = sizes[self.order]
        self.running = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
        self.starts = np.concatenate([[0], np.cumsum(self.running)])
        lane = np.repeat(np.arange(len(texts)), sizes)
        step = np.arange(len(lane)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.place = self.starts[step] + lane
        self.lane = np.empty(len(lane), np.int64)
        self.lane[self.place] = lane
        self.symbols = np.empty(len(lane), np.int64)
        self.symbols[self.place] = np.concatenate([texts[i] for i in self.order])

    def forward(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled state probabilities after each symbol, the scales, and the symbols' emissions; emit has a row per symbol."""
        seen = emit[self.symbols]
        alpha, scale = np.empty_like(seen), np.empty(len(seen), seen.dtype)
        state = np.broadcast_to(start, (self.running[0], len(start)))
        for t, n in enumerate(self.running.tolist()):
            a = self.starts[t]
            now = (state if t == 0 else state[:n] @ move) * seen[a : a + n]
            total = now.sum(axis=1)
            state = now / total[:, None]
            alpha[a : a + n], scale[a : a + n] = state, total
        return alpha, scale, seen

    def log_likelihoods(self, scale: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.order))
        out[self.order] = np.bincount(self.lane, np.log(scale), len(self.order))
        return out

    def expected(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts of first states, moves and emissions, and the log likelihood."""
        alpha, scale, seen = self.forward(start, move, emit)
        beta = np.ones_like(alpha)
        ahead = np.empty_like(alpha)
        for t in range(len(self.running) - 2, -1, -1):
            a, b, n = self.starts[t], self.starts[t + 1], self.running[t + 1]
            ahead[b : b + n] = seen[b : b + n] * beta[b : b + n] / scale[b : b + n, None]
            beta[a : a + n] = ahead[b : b + n] @ move.T
        gamma = alpha * beta
        moves = np.zeros_like(move, np.float64)
        if len(self.running) > 1:
            later = np.arange(self.running[0], len(alpha))
            back = later - np.repeat(self.running[:-1], self.running[1:])
            moves = move * (alpha[back].T @ ahead[later])
        emissions = np.stack([np.bincount(self.symbols, gamma[:, k], len(emit)) for k in range(len(start))])
        return gamma[: self.running[0]].sum(axis=0), moves, emissions, float(np.log(scale.astype(np.float64)).sum())


def chunks(texts: list[np.ndarray]) -> Iterator[list[int]]:
    """Places of texts of similar lengths, so many tokens together."""
    part, held = [], 0
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
        if part and held + len(texts[i]) > CHUNK_TOKENS:
            yield part
            part, held = [], 0
        part.append(i)
        held += len(texts[i])
    if part:
        yield part


Parameters = tuple[np.ndarray, np.ndarray, np.ndarray]
# Share of the log likelihood that an iteration must gain for another to follow.
GAIN = 1e-4


def expectations(texts: DataFrame, parameters: Parameters) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch's expected counts, summed over partitions; they are as large as the model."""
    sent = texts.sparkSession.sparkContext.broadcast(parameters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, move, emit = (x.astype(np.float32) for x in sent.value)
        sums = [np.zeros(start.shape), np.zeros(move.shape), np.zeros(emit.T.shape)]
        total = 0.0
        for batch in batches:
            found = [grown(x) for x in batch.column("seq").to_pylist()]
            for part in chunks(found):
                *counts, log = Lanes([found[i] for i in part]).expected(start, move, emit)
                for a, b in zip(sums, counts, strict=True):
                    a += b
                total += log
        flat = np.concatenate([x.ravel() for x in sums] + [[total]])
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["i", "x"])

    start, move, emit = parameters
    summed = texts.select("seq").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
    flat = np.zeros(start.size + move.size + emit.size + 1)
    flat[summed["i"]] = summed["x"]
    a, b = start.size, start.size + move.size
    return flat[:a], flat[a:b].reshape(move.shape), flat[b:-1].reshape(emit.T.shape), float(flat[-1])


def train(texts: DataFrame, mass: np.ndarray, states: int, warm: int, rounds: int, gain: float = GAIN) -> Parameters:
    """Parameters after `warm` and then `rounds` iterations at most, each over all texts; where to begin if there are none.

    It ends with the iteration whose log likelihood is better than that of the one before by no more than the share `gain`.
    """
    prior = mass / mass.sum()
    rng = np.random.default_rng(5)
    start, move = np.full(states, 1 / states), np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    emit = prior[:, None] * rng.uniform(0.5, 1.5, (len(prior), states))
    parameters = (start, move, emit / emit.sum(axis=0))
    before = None
    for _ in range(warm + rounds):
        first, moves, emissions, log = expectations(texts, parameters)
        if not first.sum():
            break  # an update that saw no text would make all states alike for good
        start = (first + 1) / (first.sum() + states)
        move = (moves + 1) / (moves.sum(axis=1, keepdims=True) + states)
        # What is taken from each expected count goes to the classes by their share of the corpus, and so every class is possible.
        taken = np.minimum(emissions, DISCOUNT)
        emit = (emissions - taken + (taken.sum(axis=1, keepdims=True) + 1) * prior) / (emissions.sum(axis=1, keepdims=True) + 1)
        parameters = (start, move, np.ascontiguousarray(emit.T))
        if before is not None and log - before <= gain * abs(before):
            break
        before = log
    return parameters


def score_documents(docs: DataFrame, states: int = STATES, warm: int = 8, rounds: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of (doc_id, text).

    Documents whose crc32(doc_id as text) mod 10 is 0 are held out (a null doc_id is); the rest is learned
    from. Null text is empty: its only token is the end. Repeated rows count and are scored each; other columns are
    left out. Without anything to learn from, all tokens are unknown and have probability 1.
    """
    learn = crc_text("doc_id") % 10 != 0
    encoded = encode(docs, number, block_bytes, learn)
    classed, n, v, mass = word_classes(encoded)
    texts = by_class(encoded, classed, n, v, mass)
    parameters = train(texts.filter(crc_text("doc_id") % 10 != 0), mass, states, warm, rounds)
    sent = docs.sparkSession.sparkContext.broadcast(parameters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [grown(x) for x in batch.column("seq").to_pylist()]
            score = np.zeros(len(found))
            for part in chunks(found):
                lanes = Lanes([found[i] for i in part])
                score[part] = lanes.log_likelihoods(lanes.forward(*sent.value)[1])
            score = (score + batch.column("within").to_numpy()) / math.log(10)
            names = ["doc_id", "n_tokens", "n_known", "base_score"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(score)], names=[*names, "score"])

    scored = texts.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    held = (crc_text("doc_id") % 10 == 0).alias("held_out")
    return scored.select("doc_id", held, "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op9_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))
