"""Substring dedup: words inside a long enough passage that also begins earlier are removed.

Suffixes of all texts, one from each word on, are split by prefixes whose length depends on how crowded they
are. A first, short prefix is looked at only at sampled places: of all k-word prefixes inside a window of w
words the one with the least hash, which two equal windows have in common. Suffixes under a prefix that occurs
once can't share w words with another and end there. The others go on to the prefix of w words, the depth at
which an internal node of the suffix tree is a repeat; a node's first leaf, in the order of texts and places, is
the occurrence to keep. Nodes that follow each other in a text make up its maximal repeats.

Every task first merges the equal prefixes it has itself, so no prefix has more rows than there are tasks. Texts
with the same words throughout are settled as wholes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, hashes, kept, long_windows, mix, rolling, texts_of, words

WINDOW, PREFIX = 20, 6
# Prefixes that a task merges at a time.
HELD = 4_000_000
SHORT, KNOWN, WHOLE = 0, 1, 2
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sampled(h: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of a text its k-word prefix of least hash: the hash, and whether the window differs in it from the last."""
    grams = rolling(h, k)
    n = len(h) - window + 1
    least, place = grams[:n].copy(), np.arange(n)
    for step in range(1, window - k + 1):
        now = grams[step : step + n]
        less = now < least
        least[less] = now[less]
        place[less] = np.flatnonzero(less) + step
    return least, np.diff(place, prepend=-1) != 0


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it in some column."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _short_prefixes(docs: DataFrame, window: int, k: int) -> DataFrame:
    """(kind, h, g, doc_id, known): sampled prefixes and whole texts, each once per task, and what a task knows already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs: list[np.ndarray] = []
        ds: list[np.ndarray] = []
        whole: list[tuple[int, int, int]] = []
        held = 0

        def rows(kind, h, g, doc, known=None):
            n = len(doc)
            kinds = [pa.array(np.full(n, kind, np.int32)), pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), pa.array(doc), pa.array(known if known else [None] * n, pa.binary())]
            return pa.RecordBatch.from_arrays(kinds, names=["kind", "h", "g", "doc_id", "known"])

        def flush():
            if whole:
                table = np.array(sorted(whole), dtype=[("h", "u8"), ("g", "u8"), ("doc", "i8")])
                first = runs(table["h"], table["g"])
                yield rows(WHOLE, table["h"][first], table["g"][first], table["doc"][first])
                least = table["doc"][first][np.cumsum(first) - 1]
                copies = table["doc"][~first & (table["doc"] != least)]
                if len(copies):
                    yield rows(KNOWN, copies.astype(np.uint64), copies.astype(np.uint64), copies, [b""] * len(copies))
            if not hs:
                return
            h, doc = np.concatenate(hs), np.concatenate(ds)
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            new = runs(h)
            size = np.diff(np.append(np.flatnonzero(new), len(h)))[np.cumsum(new) - 1]
            alone = size == 1
            zero = np.zeros(int(alone.sum()), np.uint64)
            yield rows(SHORT, h[alone], zero, doc[alone])
            several = h[new & ~alone]
            if len(several):
                # One row without a text says that the prefix occurs here; this task's texts know it.
                n = len(several)
                nothing = [pa.array(np.full(n, SHORT, np.int32)), pa.array(several.view(np.int64)), pa.array(np.zeros(n, np.int64)), pa.array([None] * n, pa.int64()), pa.array([None] * n, pa.binary())]
                yield pa.RecordBatch.from_arrays(nothing, names=["kind", "h", "g", "doc_id", "known"])
                order = np.argsort(doc[~alone], kind="stable")
                h, doc = h[~alone][order], doc[~alone][order]
                cuts = np.append(np.flatnonzero(runs(doc)), len(doc)).tolist()
                own = doc[cuts[:-1]]
                yield rows(KNOWN, own.astype(np.uint64), own.astype(np.uint64), own, [np.unique(h[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                found = words(text, fold=False)
                if doc is None or len(found) < window:
                    continue
                least, new = sampled(hashes(found), window, k)
                # A prefix that one text samples at several places is one that occurs several times.
                hs.append(least[new])
                ds.append(np.full(int(new.sum()), doc))
                digest = xxhash.xxh3_128_intdigest(b" ".join(found))
                whole.append((digest >> 64, digest & (2**64 - 1), doc))
                held += len(hs[-1])
            if held > HELD:
                yield from flush()
                hs, ds, whole, held = [], [], [], 0
        yield from flush()

    return docs.select("doc_id", "text").mapInArrow(run, "kind int, h long, g long, doc_id long, known binary")


def _crowded(rows: DataFrame) -> DataFrame:
    """(doc_id, copy, prefixes): for each text whether a smaller doc_id has the same words, and its prefixes that occur again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first_doc = None, None
        for batch in _and_end(batches):
            if batch is not None:
                table = pa.Table.from_batches([batch])
                held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
                if held.num_rows < 2:
                    continue
            if held is None or not held.num_rows:
                continue
            kind, h, g = (held.column(c).to_numpy() for c in ("kind", "h", "g"))
            null = held.column("doc_id").is_null().to_numpy()
            doc = held.column("doc_id").fill_null(-1).to_numpy()
            new = runs(kind, h, g)
            follows = ~new
            if first_doc is not None and first_doc[:3] == (kind[0], h[0], g[0]):
                follows[0] = True
                start = first_doc[3]
            else:
                start = doc[0]
            followed = np.append(~new[1:], False)
            begins = np.where(new, doc, 0)
            place = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
            leader = begins[place]
            leader[place == 0] = start
            # The last row waits for the next batch, which tells whether it is followed.
            upto = len(doc) if batch is None else len(doc) - 1
            mask = np.zeros(len(doc), bool)
            mask[:upto] = True
            short = mask & (kind == SHORT) & (follows | followed) & ~null
            copy = mask & (kind == WHOLE) & follows & (doc != leader)
            known = mask & (kind == KNOWN)
            blobs = held.column("known").filter(pa.array(known)).to_pylist()
            raw = h[short].astype(np.uint64).tobytes()
            prefixes = [raw[i : i + 8] for i in range(0, len(raw), 8)]
            docs = np.concatenate([doc[short], doc[copy], doc[known]])
            flags = np.concatenate([np.zeros(len(prefixes), bool), np.ones(int(copy.sum()), bool), np.array([not b for b in blobs], bool)])
            out = [*prefixes, *[b""] * int(copy.sum()), *blobs]
            yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(flags), pa.array(out, pa.binary())], names=["doc_id", "copy", "prefixes"])
            if batch is not None:
                first_doc = (kind[-1], h[-1], g[-1], int(leader[-1])) if not new[-1] else None
                held = held.slice(len(doc) - 1)

    sorted_rows = rows.repartition("kind", "h", "g").sortWithinPartitions("kind", "h", "g", "doc_id")
    found = sorted_rows.mapInArrow(run, "doc_id long, copy boolean, prefixes binary")
    return kept(found.groupBy("doc_id").agg(F.max("copy").alias("copy"), F.collect_list("prefixes").alias("prefixes")))


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _repeats(docs: DataFrame, crowded: DataFrame, window: int, k: int) -> DataFrame:
    """(doc_id, whole, starts): the places (int32) where windows begin that also begin earlier; `whole`: all of them."""

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def rows(h, g, doc, place, starts=None):
            columns = [pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), pa.array(doc), pa.array(place.astype(np.int32)), pa.array(starts if starts else [None] * len(doc), pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["h", "g", "doc_id", "place", "starts"])

        def flush():
            if not parts:
                return
            h, g, doc, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((place, doc, g, h))
            h, g, doc, place = h[order], g[order], doc[order], place[order]
            first = runs(h, g)
            yield rows(h[first], g[first], doc[first], place[first])
            at = np.flatnonzero(first)[np.cumsum(first) - 1]
            later = ~first & ((doc != doc[at]) | (place != place[at]))
            yield from by_doc(doc[later], place[later])

        def by_doc(doc, place):
            order = np.lexsort((place, doc))
            doc, place = doc[order], place[order]
            cuts = np.append(np.flatnonzero(runs(doc)), len(doc)).tolist() if len(doc) else []
            if cuts:
                own = doc[cuts[:-1]]
                starts = [place[a:b].astype(np.int32).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield rows(own.astype(np.uint64), own.astype(np.uint64), own, np.full(len(own), -1), starts)

        for batch in batches:
            whole = []
            for doc, text, copy, blobs in zip(batch.column("doc_id").to_pylist(), texts_of(batch), batch.column("copy").to_pylist(), batch.column("prefixes").to_pylist(), strict=True):
                if copy:
                    whole.append(doc)
                    continue
                found = words(text, fold=False)
                prefixes = np.frombuffer(b"".join(blobs or []), np.uint64)
                if len(found) < window or not len(prefixes):
                    continue
                h = hashes(found)
                at = np.flatnonzero(np.isin(sampled(h, window, k)[0], prefixes))
                if not len(at):
                    continue
                parts.append((long_windows(h, window)[at], long_windows(mix(h ^ np.uint64(window)), window, 0xC2B2AE3D27D4EB4F)[at], np.full(len(at), doc), at))
                held += len(at)
            if whole:
                own = np.array(whole, np.int64)
                yield rows(own.astype(np.uint64), own.astype(np.uint64), own, np.full(len(own), -2), [b""] * len(own))
            if held > HELD:
                yield from flush()
                parts, held = [], 0
        yield from flush()

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            h, g, doc, place = (batch.column(c).to_numpy() for c in ("h", "g", "doc_id", "place"))
            single = place >= 0
            settled = np.flatnonzero(~single)
            blobs = batch.column("starts").take(pa.array(settled)).to_pylist()
            h, g, doc_, place_ = h[single], g[single], doc[single], place[single]
            later = np.zeros(0, bool)
            if len(h):
                first = runs(h, g)
                at = np.flatnonzero(first)[np.cumsum(first) - 1]
                lead_doc, lead_place = doc_[at], place_[at]
                if last is not None and last[:2] == (h[0], g[0]):
                    mine = at == 0
                    lead_doc, lead_place = np.where(mine, last[2], lead_doc), np.where(mine, last[3], lead_place)
                later = (lead_doc != doc_) | (lead_place != place_)
                last = (h[-1], g[-1], lead_doc[-1], lead_place[-1])
            raw = place_[later].astype(np.int32).tobytes()
            starts = [raw[i : i + 4] for i in range(0, len(raw), 4)] + blobs
            whole = np.concatenate([np.zeros(int(later.sum()), bool), place[settled] == -2])
            ids = np.concatenate([doc_[later], doc[settled]])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(whole), pa.array(starts, pa.binary())], names=["doc_id", "whole", "starts"])

    met = docs.select("doc_id", "text").join(crowded, "doc_id").mapInArrow(suffixes, "h long, g long, doc_id long, place int, starts binary")
    order = ["h", "g", "doc_id", "place"]
    found = met.repartition("h", "g").sortWithinPartitions(*order).mapInArrow(nodes, "doc_id long, whole boolean, starts binary")
    return kept(found.groupBy("doc_id").agg(F.max("whole").alias("whole"), F.collect_list("starts").alias("starts")))


def cut(text: bytes, gone: np.ndarray) -> bytes:
    """A text without the words marked as gone; what stands between two words that stay is as it was."""
    spans = [m.span() for m in WORD.finditer(text)]
    stay = np.flatnonzero(~gone)
    if not len(stay):
        return b""
    cuts = np.flatnonzero(np.diff(stay) > 1)
    begins, ends = [stay[0], *stay[cuts + 1]], [*stay[cuts], stay[-1]]
    return b" ".join(text[spans[a][0] : spans[b][1]] for a, b in zip(begins, ends, strict=True))


def remove_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """docs' rows, as struct `row`, with `cut_text`, n_words, n_removed and kept_sha256.

    A window is `window` consecutive words of one text; every word of a window whose words also begin at a smaller
    doc_id, or earlier in the same text, goes. Windows are judged on the texts as they come. A text that loses
    nothing stays as it is to the byte (null stays null and has no words). Rows with a null doc_id come before and
    after nothing and lose nothing; rows of one doc_id are one text; texts shorter than a window lose nothing.
    """
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    crowded = _crowded(_short_prefixes(chosen, window, prefix))
    repeats = _repeats(chosen, crowded, window, prefix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("cut_text", "n_words", "n_removed", "kept_sha256")}
            nulls = batch.column("text").is_null().to_pylist()
            for text, null, whole, blobs in zip(texts_of(batch), nulls, batch.column("whole").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                found = words(text, fold=False)
                n = len(found)
                marks = np.zeros(n + 1, np.int64)
                starts = np.frombuffer(b"".join(blobs or []), np.int32)
                if n >= window and (whole or len(starts)):
                    starts = np.arange(n - window + 1) if whole else np.unique(starts)
                    marks[starts] += 1
                    marks[starts + window] -= 1
                gone = np.cumsum(marks)[:n] > 0
                lost = int(gone.sum())
                stay = [w for w, g in zip(found, gone.tolist(), strict=True) if not g] if lost else found
                values = (cut(text, gone).decode("utf-8") if lost else None if null else text.decode("utf-8"), n, lost, hashlib.sha256(b" ".join(stay)).hexdigest())
                for k, x in zip(out, values, strict=True):
                    out[k].append(x)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(x, t) for x, t in zip(out.values(), kinds, strict=True))], names=["row", *out])

    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").alias("text"))
    met = rows.join(repeats.withColumnRenamed("doc_id", "_doc"), "_doc", "left").select("row", "text", "whole", "starts")
    extra = [F.lit("").alias("cut_text"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("kept_sha256")]
    schema = rows.select("row", *[F.when(F.lit(True), c).alias(n) for c, n in zip(extra, ("cut_text", "n_words", "n_removed", "kept_sha256"), strict=True)]).schema
    for field in schema.fields:
        field.nullable = True
    return met.mapInArrow(run, schema)


def op8_prefix_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("row.doc_id", "n_words", "n_removed", "kept_sha256")
