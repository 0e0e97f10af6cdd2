"""Token counts: pieces are counted once per distinct pre-token and summed by document, no ids kept.

Every block of documents has a dictionary of its pre-tokens. The dictionaries' entries meet by
pre-token, where its pieces are counted once, and the counts go back to the blocks, where the
documents' pre-token frequencies wait. A frequent pre-token has one row per block, however often it
occurs, so no key is hot.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, documents, encode, entries, grown, shrunk

FILE = "byte_bpe_50k.json"
# The pre-tokens of the byte-level tokenizer, and its only special string.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", regex.V1)
SPECIAL = "<|endoftext|>"
# A space beside other white space may be part of a longer run, and must be split with it.
RUNS = regex.compile(r"\s | \s|^ | $", regex.V1)


class Splitter:
    """Numbers a text's pre-tokens by their places in a dictionary; the special string is one of its own.

    A single space before anything that isn't white space always begins a pre-token, so texts without runs
    of white space are split there, and each distinct word of the dictionary's block is matched once.
    """

    def __init__(self) -> None:
        self.book: dict[bytes, int] | None = None
        self.known: dict[str, list[int]] = {}

    def match(self, text: str) -> list[int]:
        book = self.book
        return [book.setdefault(x.encode(), len(book)) for x in PRE_TOKEN.findall(text)]

    def __call__(self, text: bytes, book: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        if book is not self.book:
            self.book, self.known = book, {}
        places: list[int] = []
        times: list[int] = []
        for n, part in enumerate(text.decode("utf-8", "replace").split(SPECIAL)):
            if n:
                places.append(book.setdefault(SPECIAL.encode(), len(book)))
                times.append(1)
            if RUNS.search(part):
                found = self.match(part)
                places += found
                times += [1] * len(found)
                continue
            first, *rest = part.split(" ")
            found = self.match(first)
            places += found
            times += [1] * len(found)
            for word, count in Counter(rest).items():
                found = self.known.get(word)
                if found is None:
                    found = self.known[word] = self.match(" " + word)
                for place in found:
                    places.append(place)
                    times.append(count)
        distinct, which = np.unique(np.array(places, np.int64), return_inverse=True)
        return distinct, np.bincount(which, np.array(times, np.int64), len(distinct)).astype(np.int64)


def _pieces(path: str | None, file: str):
    """A function from pre-tokens to their numbers of pieces, special strings included."""
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(file)
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def count(items: list[str]) -> list[int]:
        return [len(x.ids) for x in tokenizer.encode_batch(items, add_special_tokens=False)]

    return count


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 1024, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of (doc_id, text).

    `path` is the tokenizer's file on the executors (None: the public one's). Null text is empty and has
    no tokens; a null or repeated doc_id gives a row for each of its rows; other columns are left out; an
    empty table gives an empty result.
    """
    encoded = encode(docs, Splitter(), block_bytes)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        count = _pieces(path, FILE)
        last: tuple[bytes | None, int] = (None, 0)
        for batch in batches:  # sorted by word: each distinct one is counted once
            coded = batch.column("word").dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            todo = [w for w in distinct if w != last[0]]
            found = dict(zip(todo, count([w.decode("utf-8", "replace") for w in todo]), strict=True))
            if last[0] is not None:
                found.setdefault(last[0], last[1])
            numbers = np.array([found[w] for w in distinct], np.int32)[coded.indices.to_numpy()]
            if len(numbers):
                last = (batch.column("word")[len(numbers) - 1].as_py(), int(numbers[-1]))
            yield by_block(batch.column("block").to_numpy(), batch.column("pos").to_numpy(), numbers)

    def by_block(block: np.ndarray, pos: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
        """What a batch knows of each block in one row."""
        order = np.lexsort((pos, block))
        block, pos, numbers = block[order], pos[order], numbers[order]
        blocks, starts = np.unique(block, return_index=True)
        parts = list(zip(starts.tolist(), [*starts[1:].tolist(), len(block)], strict=True))
        columns = [pa.array(blocks), pa.array([shrunk(pos[a:b], rising=True) for a, b in parts], pa.binary()), pa.array([shrunk(numbers[a:b]) for a, b in parts], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["block", "pos", "n"])

    by_word = entries(encoded).select("word", "block", "pos").repartition("word").sortWithinPartitions("word")
    counted = by_word.mapInArrow(pieces, "block long, pos binary, n binary")

    def total(docs: pa.Table, book: pa.Table) -> pa.Table:
        pairs = [(grown(p, rising=True), grown(n)) for p, n in zip(book.column("pos").to_pylist(), book.column("n").to_pylist(), strict=True)]
        numbers = np.zeros(1 + max((int(p[-1]) for p, _ in pairs), default=0), np.int64)
        for p, n in pairs:
            numbers[p] = n
        packed = zip(docs.column("seq").to_pylist(), docs.column("freq").to_pylist(), strict=True)
        tokens = [int(numbers[grown(s, rising=True)] @ grown(f)) for s, f in packed]
        return pa.table({"doc_id": docs.column("doc_id"), "n_bytes": docs.column("n_bytes"), "n_tokens": pa.array(tokens, pa.int64())})

    rows = encoded.filter(F.col("words").isNull()).select("block", "doc_id", "n_bytes", "seq", "freq")
    summed = rows.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(total, "doc_id long, n_bytes long, n_tokens long")
    return summed.withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))
