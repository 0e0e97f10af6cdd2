"""Packing along a space-filling curve: similar documents become neighbours in a sequence.

Token ids are counted into a vector per document, hashed to a fixed number of signed coordinates and
projected to four dimensions; the Hilbert key of the projection orders the documents. They are range
partitioned by the key, so a hot key is split by document, and each partition lays its documents end to
end and cuts them every `size` ids. What is left at a partition's end is cut into powers of two, which
need no padding.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, kept, task, worker_state

FILE = "word_bpe_49k.json"
END = 1
# A sign that makes one id by itself, and whose id nothing else makes.
BAR = "|"
DIMENSIONS, BITS = 4, 12
# Signs between a letter and white space: a pre-token of their own.
STOPS = re.compile(r"[.,;:!?](?<=[^\W\d_].)[.,;:!?]*(?=\s|$)")
# Anything but Latin letters and signs whose lower case, one character for one, all agree on.
UNUSUAL = re.compile("[^\x00-\u012f\u0131-\u024f\u2000-\u206f]")
# Words whose ids a worker keeps; beyond it starts anew.
MEMO = 1_200_000


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with whole coordinates below 2**bits; one row per point.

    The coordinates' bits are first turned into the curve's transposed index (for every bit from the top,
    rotate and reflect what lies below it) and then interleaved.
    """
    x = points.astype(np.uint64).T.copy()
    n = len(x)
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        bit = np.uint64(1 << level)
        below = np.uint64((1 << level) - 1)
        for axis in range(n):
            up = (x[axis] & bit) != 0
            swapped = np.where(up, np.uint64(0), (x[0] ^ x[axis]) & below)
            x[0] = np.where(up, x[0] ^ below, x[0] ^ swapped)
            if axis:
                x[axis] ^= swapped
    for axis in range(1, n):
        x[axis] ^= x[axis - 1]
    flip = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[n - 1] >> np.uint64(level)) & one, np.uint64((1 << level) - 1), np.uint64(0))
    x ^= flip
    key = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, -1, -1):
        for axis in range(n):
            key = (key << one) | ((x[axis] >> np.uint64(level)) & one)
    return key.astype(np.int64)


def directions(vocabulary: int, coordinates: int = 256) -> np.ndarray:
    """For each id its share of the projection: ids are hashed to signed coordinates, those projected."""
    rng = np.random.default_rng(7)
    place, sign = rng.integers(0, coordinates, vocabulary), rng.choice([-1.0, 1.0], vocabulary)
    return (rng.standard_normal((coordinates, DIMENSIONS))[place] * sign[:, None]).astype(np.float32)


class Ids:
    """The ids of words as bytes of little-endian 16-bit numbers, encoded on first sight."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer
        self.known: dict[str, bytes] = {}
        one, other = (tokenizer.encode(x, add_special_tokens=False).ids for x in ("Aa, Éb... c", "aa , éb ... c"))
        self.split = split if one == other else str.split

    def learn(self, texts: list[list[str]]) -> None:
        new: set[str] = set()
        for words in texts:
            new.update(filterfalse(self.known.__contains__, words))
        if len(self.known) + len(new) > MEMO:
            self.known.clear()
            new = set().union(*texts)
        self.encode(new)

    def encode(self, new: set[str]) -> None:
        for w in [w for w in new if BAR in w]:
            self.known[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, np.uint16).tobytes()
        plain = [w for w in new if BAR not in w]
        between, mark = f"\n{BAR}\n", self.tokenizer.encode(BAR, add_special_tokens=False).ids
        # Many words are encoded as one text, with a bar, which none of them has, between any two.
        lots = [plain[at : at + 1024] for at in range(0, len(plain), 1024)]
        for part in lots:
            ids = np.array(self.tokenizer.encode_batch_fast([between.join(part)], add_special_tokens=False)[0].ids, np.uint16)
            cuts = (np.flatnonzero(ids == mark[0]) * 2).tolist()
            raw = ids.tobytes()
            self.known.update(zip(part, (raw[a:b] for a, b in zip([0, *(c + 2 for c in cuts)], [*cuts, len(raw)], strict=True)), strict=True))


def split(text: str) -> list[str]:
    """A text's words with the stops behind them apart, in lower case where that is safe.

    For a tokenizer that folds case and never joins letters with what isn't one the ids stay those of the text.
    Special strings, which aren't folded, stay as they are.
    """
    if "<|" not in text and (text.isascii() or not UNUSUAL.search(text)):
        text = text.lower()
    return STOPS.sub(r" \g<0>", text).split()


def _tokenizer(path: str | None):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(FILE)
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    if tokenizer.get_vocab_size() > 1 << 16:
        raise ValueError("ids must fit 16 bits")
    return tokenizer


def _plain(text: str) -> bool:
    """Whether Python and the tokenizer see the same white space in a text."""
    return not any(c in text for c in "\x1c\x1d\x1e\x1f")


def tokenize(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, key, ids): a document's ids with its end (16 bits each) and its place on the curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = worker_state(f"ids of {path}", lambda: Ids(_tokenizer(path)))
        towards, end = directions(1 << 16), np.array([END], np.uint16).tobytes()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for at in range(0, len(texts), 512):
                part = [x or "" for x in texts[at : at + 512]]
                words = [book.split(x) if _plain(x) else None for x in part]
                book.learn([w for w in words if w])
                ids = []
                for text, found in zip(part, words, strict=True):
                    if found is None:
                        own = np.array(book.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16).tobytes()
                    else:
                        own = b"".join(map(book.known.__getitem__, found))
                    ids.append(own + end)
                flat = np.frombuffer(b"".join(ids), np.uint16)
                sizes = np.fromiter((len(x) // 2 for x in ids), np.int64, len(ids))
                sums = np.add.reduceat(towards[flat], np.cumsum(sizes) - sizes, axis=0)
                lengths = np.maximum(np.sqrt(sizes), 1)[:, None]
                # Sums over independent signs have about the length sqrt(ids); an arctangent maps them to a cube.
                cube = (np.arctan(sums / lengths) / np.pi + 0.5) * (1 << BITS)
                keys = hilbert(np.clip(cube, 0, (1 << BITS) - 1), BITS)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(part)), pa.array(keys), pa.array(ids, pa.binary())], names=["doc_id", "key", "ids"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, key long, ids binary")


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, hilbert_key long, ids binary"


def pack(docs: DataFrame, size: int = 2048, path: str | None = None, partitions: int | None = None) -> DataFrame:
    """The pieces of all documents in sequences of at most `size` ids (a power of two), one row per piece.

    Null text is empty (its only id is the end); repeated rows are packed once each; null doc_ids are kept
    as null; other columns are left out; an empty table has no pieces. `ids` holds the piece's ids, 16 bits
    little-endian. A sequence is `size` long, or a smaller power of two at a partition's end.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = task() << 40
        number = filled = 0
        open_: list[list] = []  # pieces of the sequence that isn't full yet: at most one sequence's ids

        def piece(doc, start, ids, total, key, sequence, offset):
            wide = ids.astype("<u4")
            return [doc, start, len(ids), zlib.crc32(wide.tobytes()), total, sequence, offset, key, ids.tobytes()]

        def table(rows):
            names = [x.split()[0] for x in PIECES.split(", ")]
            kinds = [pa.int64()] * 8 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            out = []
            for doc, key, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "ids")), strict=True):
                ids = np.frombuffer(raw, np.uint16)
                at = 0
                while at < len(ids):
                    take = min(len(ids) - at, size - filled)
                    open_.append([doc, at, ids[at : at + take], len(ids), key])
                    at, filled = at + take, filled + take
                    if filled == size:
                        offset = 0
                        for p in open_:
                            out.append(piece(*p, first + number, offset))
                            offset += len(p[2])
                        open_, filled, number = [], 0, number + 1
            if out:
                yield table(out)
        out = []
        while open_:  # the rest, in powers of two
            room = 1 << (filled.bit_length() - 1)
            offset = 0
            while offset < room:
                doc, start, ids, total, key = open_.pop(0)
                take = min(len(ids), room - offset)
                out.append(piece(doc, start, ids[:take], total, key, first + number, offset))
                offset += take
                if take < len(ids):
                    open_.insert(0, [doc, start + take, ids[take:], total, key])
            filled, number = filled - room, number + 1
        if out:
            yield table(out)

    keyed = kept(tokenize(docs, path))
    order = ["key", F.xxhash64("doc_id"), "doc_id", "ids"]
    dealt = keyed.repartitionByRange(partitions, *order[:3]) if partitions else keyed.repartitionByRange(*order[:3])
    return dealt.sortWithinPartitions(*order).mapInArrow(run, PIECES)


def op1_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir)).drop("ids")
