"""Helpers the operators share: words, hashes, tables kept in the shared folder, per-block dictionaries."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import kept as kept

# The contract's words are runs of anything but these six bytes, which are also
# what bytes.split() splits at; in UTF-8 they never occur inside a character.
NOT_WORD = r"[\x20\x09-\x0D]+"

# A block's dictionary and texts are held by one task at a time; a block ends at the partition's
# end or after so many bytes of text.
BLOCK_BYTES = 64 * 1024 * 1024

BASE = 0x9E3779B97F4A7C15


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_text(column: str | Column) -> Column:
    """crc32 of an id's decimal text, what the contract's folds are taken from (null id: of '')."""
    return F.crc32(F.coalesce(F.col(column).cast("string") if isinstance(column, str) else column.cast("string"), F.lit("")).cast("binary"))


def words(text: bytes | None, fold: bool) -> list[bytes]:
    """The words of a text as UTF-8, A-Z in lower case if fold; none for a null text."""
    if not text:
        return []
    return (text.lower() if fold else text).split()


def hashes(items: list[bytes], seed: int = 0) -> np.ndarray:
    """64-bit hashes, the same in every process."""
    return np.fromiter((xxhash.xxh3_64_intdigest(x, seed) for x in items), np.uint64, len(items))


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a sum of products so that all bits depend on all input bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """One 64-bit hash for each run of k consecutive values, order counting."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    base = np.uint64(BASE)
    for j in range(k):
        out = out * base + mix(h[j : j + n] + np.uint64(j + 1))
    return mix(out)


def long_windows(h: np.ndarray, k: int, base: int = BASE) -> np.ndarray:
    """As `rolling`, in time that doesn't depend on k: differences of a running sum over powers of an odd base."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    powers = np.full(len(h), base, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    inverse = np.full(n, pow(base, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h) * powers, dtype=np.uint64)])
    return mix((sums[k:] - sums[:n]) * np.cumprod(inverse, dtype=np.uint64))


def worker_state(name: str, make: Callable[[], object]) -> object:
    """What a Python worker keeps between tasks: functions arrive anew with each task, modules stay.

    A worker keeps one thing at a time: another name's takes the place of what an earlier job left.
    """
    home = sys.modules.setdefault("_assayer_worker", types.ModuleType("_assayer_worker"))
    if getattr(home, "name", None) != name:
        home.kept = None
        home.name, home.kept = name, make()
    return home.kept


def task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A text column as UTF-8; null is empty."""
    return [x or b"" for x in batch.column(name).cast(pa.large_binary()).to_pylist()]


def shrunk(values: np.ndarray, rising: bool = False) -> bytes:
    """Whole numbers in [0, 2**31) as compressed bytes; `rising` ones as their differences."""
    values = np.diff(values, prepend=0) if rising else values
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def grown(data: bytes, rising: bool = False) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    values = np.ascontiguousarray(raw.T).view("<u4").ravel().astype(np.int64)
    return np.cumsum(values) if rising else values


ENCODED = "block long, doc_id long, n_bytes long, seq binary, freq binary, words array<binary>, totals array<long>"
Book = dict[bytes, int]


def encode(docs: DataFrame, number: Callable[[bytes, Book], tuple[np.ndarray, np.ndarray | None]], block_bytes: int = BLOCK_BYTES, train: Column | None = None) -> DataFrame:
    """Documents as numbers into a dictionary of their block: one row per document, one per block.

    `number` gives a text's units by their places in the block's dictionary, to which it adds new ones:
    all places in order, or the rising distinct places and how often each occurs. A document's row has both
    shrunk (`seq`, `freq`). A block's row has its dictionary (`words`) and how often each unit occurs in the
    documents for which `train` holds (`totals`). What belongs to a unit of the whole corpus is then joined
    to one row per block and unit instead of every occurrence, so no unit is a hot key.
    """
    chosen = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    chosen.append((F.lit(True) if train is None else train).alias("train"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = dict(block=pa.int64(), doc_id=pa.int64(), n_bytes=pa.int64(), seq=pa.binary(), freq=pa.binary(), words=pa.list_(pa.binary()), totals=pa.list_(pa.int64()))
        blocks, held, book = 0, 0, {}
        totals = np.zeros(1024, np.int64)

        def rows(**columns):
            size = len(columns["block"])
            return pa.RecordBatch.from_arrays([pa.array(columns.get(k, [None] * size), t) for k, t in kinds.items()], names=list(kinds))

        def dictionary():
            return rows(block=[label], words=[list(book)], totals=[totals[: len(book)]])

        label = task() << 24
        for batch in batches:
            out = {k: [] for k in ("block", "doc_id", "n_bytes", "seq", "freq")}
            ids, learn = batch.column("doc_id").to_pylist(), batch.column("train").to_pylist()
            for doc, text, counts in zip(ids, texts_of(batch), learn, strict=True):
                if held and held + len(text) > block_bytes:
                    if out["block"]:
                        yield rows(**out)
                        out = {k: [] for k in out}
                    yield dictionary()
                    blocks, held, book = blocks + 1, 0, {}
                    label, totals = (task() << 24) | blocks, np.zeros(1024, np.int64)
                held += len(text)
                seq, freq = number(text, book)
                if len(totals) < len(book):
                    totals = np.concatenate([totals, np.zeros(len(book), np.int64)])
                if counts and freq is None:
                    np.add.at(totals, seq, 1)
                elif counts:
                    totals[seq] += freq
                packed = shrunk(seq, rising=freq is not None), None if freq is None else shrunk(freq)
                for k, v in zip(out, (label, doc, len(text), *packed), strict=True):
                    out[k].append(v)
            if out["block"]:
                yield rows(**out)
        if book:
            yield dictionary()

    return kept(docs.select(*chosen).mapInArrow(run, ENCODED))


def entries(encoded: DataFrame) -> DataFrame:
    """(word, block, pos, total): every unit once per block."""
    books = encoded.filter(F.col("words").isNotNull())
    zipped = books.select("block", F.posexplode(F.arrays_zip("words", "totals")).alias("pos", "entry"))
    return zipped.select(F.col("entry.words").alias("word"), "block", "pos", F.col("entry.totals").alias("total"))
