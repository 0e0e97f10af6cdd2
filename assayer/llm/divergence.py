"""How far the sources of a language are from each other and from it, over terms counted by length.

A block of texts is one array of bytes: where its terms begin and end is found for all of them at once. Terms
of up to 8 bytes become one 64-bit word and those of up to 16 bytes two, first byte highest, so that numbers
sort as bytes do; they are sorted by radix, 16 bits a pass, and their runs are counted. Longer terms lie in
buckets of doubling width that are sorted as bytes, each bucket apart. The sorts are stable and documents lie
by language and source, so one pass over the sorted terms counts occurrences and documents for every source.

Counts of blocks meet by language, source and term, combined before the shuffle. Pairs of sources are summed
in blocks of terms and tiles of sources; what no source of a tile has is one number for all of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, kept

# Bytes of text whose terms are sorted at once (a longer text is a block of its own).
BLOCK_BYTES = 8 * 1024 * 1024
# Documents of a language that a term must be in; terms a source's report names.
LEAST_DOCUMENTS, TERMS = 10, 10
# Kept terms and sources of one task of pairs; table cells handled at once.
PAIR_TERMS, PAIR_SOURCES, CELLS = 4096, 256, 1 << 21
SCALE = 1_000_000_000
# Widths beyond this are sorted as byte strings one by one.
WIDEST = 1024

# A term's bytes: letters of ASCII and all bytes of other characters.
_INSIDE = np.zeros(256, bool)
_INSIDE[0x80:] = _INSIDE[ord("A") : ord("Z") + 1] = _INSIDE[ord("a") : ord("z") + 1] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
# The first k bytes of a word.
_FIRST = np.array([((1 << 64) - 1) ^ ((1 << (64 - 8 * k)) - 1) for k in range(9)], np.uint64)


def radix(*words: np.ndarray) -> np.ndarray:
    """The stable order of rows of 64-bit words, the most significant word first."""
    order = None
    for word in reversed(words):
        for shift in (0, 16, 32, 48):
            digit = ((word >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
            if len(digit) and (digit == digit[0]).all():
                continue
            # numpy sorts 16-bit numbers stably by radix.
            step = np.argsort(digit if order is None else digit[order], kind="stable")
            order = step if order is None else order[step]
    return np.arange(len(words[0])) if order is None else order


def _spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where terms begin, how long they are and the place of their text; `ends` are the texts' ends."""
    inside = _INSIDE[data]
    head, last = inside.copy(), inside.copy()
    head[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    border = ends[ends > 0]
    last[border - 1] = inside[border - 1]
    border = border[border < len(data)]
    head[border] = inside[border]
    starts = np.flatnonzero(head)
    return starts, np.flatnonzero(last) + 1 - starts, np.searchsorted(ends, starts, "right")


def _runs(changed: np.ndarray, group: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First places, sizes and numbers of texts of the runs of one term and group in sorted order."""
    changed[1:] |= group[1:] != group[:-1]
    fresh = changed.copy()
    fresh[1:] |= text[1:] != text[:-1]
    first = np.flatnonzero(changed)
    return first, np.diff(first, append=len(changed)), np.add.reduceat(fresh.astype(np.int64), first)


def count_block(data: np.ndarray, ends: np.ndarray, groups: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(starts, lengths, group, n, n_texts) of each term of each group, by places in `data`, which must be folded.

    `groups` has a number for each text, and equal ones must lie together.
    """
    starts, sizes, text = _spans(data, ends)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    word = np.ndarray((len(data) + 9,), ">u8", padded, 0, (1,))

    def counted(chosen: np.ndarray, order: np.ndarray, changed: np.ndarray):
        at = chosen[order]
        first, n, texts = _runs(changed, groups[text[at]], text[at])
        at = at[first]
        return starts[at], sizes[at], groups[text[at]], n, texts

    for low, high in ((0, 8), (8, 16)):
        chosen = np.flatnonzero((sizes > low) & (sizes <= high))
        if not len(chosen):
            continue
        words = []
        for place in range(0, high, 8):
            words.append(word[starts[chosen] + place].astype(np.uint64) & _FIRST[np.minimum(sizes[chosen] - place, 8)])
        order = radix(*words)
        changed = np.ones(len(order), bool)
        changed[1:] = np.logical_or.reduce([w[order][1:] != w[order][:-1] for w in words])
        yield counted(chosen, order, changed)
    width = 32
    while (sizes > width // 2).any() and width <= WIDEST:
        chosen = np.flatnonzero((sizes > width // 2) & (sizes <= width))
        for part in range(0, len(chosen), CELLS):
            some = chosen[part : part + CELLS]
            at = np.minimum(starts[some][:, None] + np.arange(width), len(data) - 1)
            rows = np.where(np.arange(width) < sizes[some][:, None], data[at], 0).astype(np.uint8)
            rows = np.ascontiguousarray(rows).view(f"S{width}").ravel()
            order = np.argsort(rows, kind="stable")
            rows = rows[order]
            yield counted(some, order, np.concatenate([[True], rows[1:] != rows[:-1]]))
        width *= 2
    chosen = np.flatnonzero(sizes > WIDEST)
    if len(chosen):
        terms = [data[s : s + n].tobytes() for s, n in zip(starts[chosen].tolist(), sizes[chosen].tolist(), strict=True)]
        order = np.array(sorted(range(len(terms)), key=terms.__getitem__))
        yield counted(chosen, order, np.array([True, *(terms[a] != terms[b] for a, b in zip(order[:-1], order[1:], strict=True))]))


def _gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The named stretches of bytes, each one value."""
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[at])])


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[str, str]]]]:
    """A batch's texts by language and source, cut into blocks: folded bytes, the texts' ends, their groups."""
    names = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True))
    order = sorted(range(len(names)), key=names.__getitem__)
    texts = batch.column("text").cast(pa.large_binary())
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1])[order]
    start, held = 0, 0
    for end in range(1, len(order) + 1):
        held += int(sizes[end - 1])
        if end == len(order) or held + int(sizes[end]) > BLOCK_BYTES:
            some = texts.take(pa.array(order[start:end]))
            offsets = np.frombuffer(some.buffers()[1], np.int64)[some.offset : some.offset + len(some) + 1]
            if held:
                data = np.frombuffer(some.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
                yield _FOLD[data], offsets[1:] - offsets[0], [names[i] for i in order[start:end]]
            start, held = end, 0


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term binary, n, n_docs): how often and in how many rows each term occurs. Texts mustn't be null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, ends, names in _blocks(batch):
                known = list(dict.fromkeys(names))
                number = {name: i for i, name in enumerate(known)}
                groups = np.array([number[name] for name in names])
                langs, sources = (pa.array([name[i] for name in known], pa.string()) for i in (0, 1))
                for starts, sizes, group, n, texts in count_block(data, ends, groups):
                    at = pa.array(group)
                    yield pa.RecordBatch.from_arrays([langs.take(at), sources.take(at), _gathered(data, starts, sizes).cast(pa.binary()), pa.array(n), pa.array(texts)], names=["lang", "source", "term", "n", "n_docs"])

    counted = docs.mapInArrow(run, "lang string, source string, term binary, n long, n_docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def share(n: str, whole: str) -> Column:
    """1 + floor(SCALE * (n + 2) / whole) of columns, exact for any counts."""
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(10,0)) * CAST({n} + 2 AS DECIMAL(20,0))) div CAST({whole} AS DECIMAL(20,0))")


def shares(n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The same of arrays: long division, three digits a step, exact for `whole` up to 2**53."""
    whole = np.maximum(whole, 1)
    found, rest = np.divmod(n + 2, whole)
    for _ in range(3):
        rest = rest * 1000
        found, rest = found * 1000 + rest // whole, rest % whole
    return found + 1


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


PAIRS = "lang string, source string, other string, v long, u long, f0 long, kept_terms long"


def _pairs(rows: pa.Table, side: pa.Table) -> pa.Table:
    """Partial sums of the pairs of two tiles' sources over the terms of one block that any of them has."""
    side = side.sort_by("s")
    names, tile, whole = side.column("source").to_pylist(), side.column("tile").to_numpy(), side.column("whole").to_numpy()
    a, b = np.flatnonzero(tile == tile.min()), np.flatnonzero(tile == tile.max())
    zero = shares(np.zeros(len(whole), np.int64), whole)
    coded = rows.column("term").combine_chunks().dictionary_encode()
    terms = len(coded.dictionary)
    place = np.zeros(int(side.column("s").to_numpy().max()) + 1, np.int64)
    place[side.column("s").to_numpy()] = np.arange(len(names))
    at, n = place[rows.column("at").to_numpy()], rows.column("n").to_numpy()
    p = np.repeat(zero[None], terms, axis=0)
    p[coded.indices.to_numpy(), at] = shares(n, whole[at])
    total = np.zeros((len(a), len(b)), np.int64)
    step = max(1, CELLS // (len(a) * len(b)))
    for start in range(0, terms, step):
        some = p[start : start + step]
        total += _distance(some[:, a][:, :, None], some[:, b][:, None, :]).sum(axis=0)
    i, j = np.nonzero(a[:, None] < b[None, :])
    x, y = a[i], b[j]
    size = len(x)
    fixed = side.column("lang")[0].as_py(), terms, side.column("terms")[0].as_py()
    columns = [pa.array([fixed[0]] * size, pa.string()), pa.array([names[k] for k in x], pa.string()), pa.array([names[k] for k in y], pa.string()), pa.array(total[i, j])]
    columns += [pa.array(np.full(size, fixed[1], np.int64)), pa.array(_distance(zero[x], zero[y])), pa.array(np.full(size, fixed[2], np.int64))]
    return pa.Table.from_arrays(columns, names=[part.split()[0] for part in PAIRS.split(", ")])


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, terms: int = TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) for every row's (text, lang, source).

    Part `pair` has every other source of the language, the farthest first, and part `term` the `terms` terms
    that a source has most in excess of its language. A language's terms are those in `least` of its rows; a
    repeated doc_id is a row like any other. Null text, lang and source are empty strings, which are a group
    of their own; ties go by the item's bytes; a text without terms still makes its source a group; an empty
    table gives an empty result; other columns are left out. A text is counted whole, in memory of some
    20 times its size. All pairs of sources are the result, so their number is the square of a language's sources.
    """
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    # The window of a term has a row for each source.
    of_term = Window.partitionBy("lang", "term")
    totals = term_counts(read).select("lang", "source", "term", "n", F.sum("n").over(of_term).alias("total"), F.sum("n_docs").over(of_term).alias("docs"), F.row_number().over(of_term.orderBy("source")).alias("place"))
    known = kept(totals.filter(F.col("docs") >= least).select("lang", "source", "term", "n", "total", "place"))
    own = known.groupBy("lang", "source").agg(F.sum("n").alias("own"), F.count_if(F.col("place") == 1).alias("first"))
    whole = own.groupBy("lang").agg(F.sum("first").alias("terms"), F.sum("own").alias("all"))
    found = read.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(whole, "lang", "left")
    terms_of = F.coalesce("terms", F.lit(0))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    facts = found.select("lang", "source", terms_of.alias("terms"), (F.coalesce("own", F.lit(0)) + 2 * terms_of).alias("whole"), (F.coalesce("all", F.lit(0)) + 2 * terms_of).alias("lang_whole"), place.alias("s"))
    facts = facts.select("*", F.floor(F.col("s") / PAIR_SOURCES).cast("int").alias("tile"), F.ceil(F.greatest("terms", F.lit(1)) / PAIR_TERMS).cast("int").alias("blocks"))
    facts = kept(facts.withColumn("tiles", F.max("tile").over(Window.partitionBy("lang")) + 1))
    # Every term's row has its source's facts. As a left join this never broadcasts the terms, whose files are a
    # hundredth of their rows' size in memory; so nothing below may drop rows for a fact that is null.
    met = known.join(facts, ["lang", "source"], "left")

    excess = met.select("lang", "source", F.col("term").cast("string").alias("item"), share("n", "whole").alias("p"), share("total", "lang_whole").alias("q")).filter("coalesce(p > q, true)")
    excess = excess.select("lang", "source", F.lit("term").alias("part"), "item", F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    excess = excess.withColumn("rank", rank).filter(F.col("rank") <= terms)

    both = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("o")
    dealt = met.select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "tile", both, "s", "term", "n")
    side = facts.select("lang", "source", "terms", "whole", "s", "tile", both, "blocks").select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
    low, high = F.least("tile", "o").alias("low"), F.greatest("tile", "o").alias("high")
    dealt = dealt.select("lang", "block", low, high, F.col("s").alias("at"), "term", "n").groupBy("lang", "block", "low", "high")
    side = side.select("lang", "block", low, high, "s", "source", "tile", "whole", "terms").groupBy("lang", "block", "low", "high")
    parts = dealt.cogroup(side).applyInArrow(_pairs, PAIRS)
    summed = parts.groupBy("lang", "source", "other").agg((F.sum("v") + (F.max("kept_terms") - F.sum("u")) * F.max("f0")).alias("value"))
    sides = F.array(F.struct("source", F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item")))
    pairs = summed.select("lang", F.explode(sides).alias("e"), "value").select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
    return excess.unionByName(pairs.withColumn("rank", rank)).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(documents(spark, sf_dir))
