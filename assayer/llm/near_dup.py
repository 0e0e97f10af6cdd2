"""Near-duplicates by an LSH forest over MinHash signatures, links confirmed on full shingle sets.

Texts with equal sets are one node, named by their smallest doc_id. Every tree sorts the nodes by its part of
their signatures; neighbours with a common prefix are candidates, so the depth at which two nodes meet follows
how crowded their region of the tree is. What the signatures rate far too low is left out, the rest is
confirmed on the texts, a node's best candidates first. In regions that hold several components, the members
then meet the region's nodes with the most links, round by round until the last finds no link. What all of a
crowded region share can't tell its nodes apart, however deep a tree is; so there the trees go on with what
few nodes have: every shingle of a node's sample that is rare among the crowded nodes is a branch, and the nodes
that follow each other in most of their branches are candidates. So far a group of any size costs as many comparisons
as it has members, and no group is gathered anywhere.

What the trees missed is found exactly: two sets similar enough share several shingles among the first of each, in any
order that all sets have in common. Nodes of different components that share as many there, and could still share enough
after them, are candidates too, all of them. Those whose bitmaps differ in too many bits to be similar enough are left
out, all others are confirmed on the texts. Where many different texts share what is rarest in them, that is quadratic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, hashes, kept, mix, rolling, texts_of, words, worker_state
from .components import components

TREES, DEPTH = 14, 6
# Hashes that neighbours in a tree must share, and that the members of a region share.
LEAST_PREFIX, REGION_PREFIX = 3, 4
# Standard deviations by which a signature may underrate a pair.
DEVIATIONS = 4.0
# Followers in a tree's order that a node meets; a node's candidates that are confirmed first.
FOLLOWERS, FIRST = 2, 3
# Nodes of most links in a region that members of other components meet, round by round.
HUBS = (1, 8)
# Shingles of a crowded node that are branches of their own, on the average; nodes that a branch has at most, since
# one with more tells too little apart; branches in which two nodes must follow each other.
SAMPLE, RARE, SHARED = 256, 64, 2
# Nodes, about, whose shingles are counted for the order that sets are read in, and shingles the order knows to be
# frequent: these change how many candidates there are, not which links are found. Nodes of a shared shingle that
# one task compares with the others at a time.
COUNTED, FREQUENT, BESIDE = 20_000, 1 << 20, 1024
# Shingles that similar sets share among the first of each, unless they are smaller than that: the more are asked for, the
# longer are the firsts and the fewer the candidates. Texts, and pairs, that a task holds apart from its input at a time.
COMMON, TEXTS, PAIRS = 8, 512, 1 << 18


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that what is made of their texts stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            yield batch.slice(at, TEXTS)


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles; of the whole if it has fewer words."""
    found = words(text, fold=True)
    return np.unique(rolling(hashes(found), min(k, len(found)))) if found else np.empty(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """TREES * DEPTH minima, each under a hash of its own, 32 bits of them."""
    seeds = mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    low = np.full(len(seeds), 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096]
        low = np.minimum(low, ((part[None] ^ (seeds >> np.uint64(7))[:, None]) * seeds[:, None]).min(axis=1))
    return (mix(low) >> np.uint64(32)).astype(np.uint32)


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, set, signature): `set` names the text's shingle set, null if it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("shingles", dict)  # what an earlier operator's words took goes
        for batch in _few(batches):
            sizes, names, signs = [], [], []
            for text in texts_of(batch):
                found = shingle_set(text, k)
                sizes.append(len(found))
                names.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                signs.append(signature(found).astype(">u4").tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(signs, pa.binary())], names=["doc_id", "n_shingles", "set", "signature"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept(chosen.mapInArrow(run, "doc_id long, n_shingles long, set binary, signature binary"))


def branches(nodes: DataFrame) -> DataFrame:
    """(tree, path, id): every node in every tree."""
    width = 4 * DEPTH
    trees = F.sequence(F.lit(0), F.lit(TREES - 1))
    split = nodes.select("id", "signature", F.explode(trees).alias("tree"))
    return split.select("tree", F.substring("signature", F.col("tree") * width + 1, F.lit(width)).alias("path"), "id")


def neighbours(nodes: DataFrame) -> DataFrame:
    """(a, b), a < b: nodes that follow each other in the order of some tree and share the prefix asked for.

    The order is range partitioned by node too, so a crowded region is spread over tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, ids = batch.column("tree").to_numpy(), batch.column("id").to_numpy()
            path = np.frombuffer(b"".join(batch.column("path").to_pylist()), ">u4").reshape(-1, DEPTH)
            carried = 0 if last is None else len(last[0])
            if carried:
                tree, ids, path = (np.concatenate([x, y]) for x, y in zip(last, (tree, ids, path), strict=True))
            found = []
            for step in range(1, FOLLOWERS + 1):
                near = (tree[step:] == tree[:-step]) & (path[step:, :LEAST_PREFIX] == path[:-step, :LEAST_PREFIX]).all(axis=1)
                near[: max(carried - step, 0)] = False  # met in the batch before
                found.append(np.stack([ids[:-step][near], ids[step:][near]]))
            pairs = np.sort(np.concatenate(found, axis=1), axis=0)
            last = tree[-FOLLOWERS:], ids[-FOLLOWERS:], path[-FOLLOWERS:]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    order = ["tree", "path", "id"]
    return branches(nodes).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "a long, b long").filter("a <> b").distinct()


def rated(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(a, b, rate): the pairs whose signatures don't speak against the similarity, with the share that agrees."""
    size = TREES * DEPTH
    least = similarity - DEVIATIONS * (similarity * (1 - similarity) / size) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), ">u4").reshape(-1, size) for c in ("x", "y"))
            rate = (x == y).mean(axis=1)
            good = rate >= least
            columns = [batch.column(c).filter(pa.array(good)) for c in ("a", "b")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rate[good])], names=["a", "b", "rate"])

    x = nodes.select(F.col("id").alias("a"), F.col("signature").alias("x"))
    y = nodes.select(F.col("id").alias("b"), F.col("signature").alias("y"))
    return kept(pairs.join(y, "b").join(x, "a").mapInArrow(run, "a long, b long, rate double"))


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """(a, b, linked) of the pairs, by their full sets."""
    percent = round(similarity * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray | None] = (None, None)
        for batch in batches:
            linked = []
            ids = batch.column("a").to_pylist()
            for a, x, y in zip(ids, texts_of(batch, "x"), texts_of(batch, "y"), strict=True):
                if last[0] != a:
                    last = a, shingle_set(x, k)
                own = shingle_set(y, k)
                common = len(np.intersect1d(last[1], own, assume_unique=True))
                linked.append(100 * common >= percent * (len(last[1]) + len(own) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked)], names=["a", "b", "linked"])

    x = texts.select(F.col("id").alias("a"), F.col("text").alias("x"))
    y = texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
    met = pairs.select("a", "b").join(y, "b").join(x, "a").select("a", "b", "x", "y")
    return kept(met.mapInArrow(run, "a long, b long, linked boolean"))


def _between(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose ends aren't known to be in one component."""
    of = lambda end: found.select(F.col("id").alias(end), F.col("component").alias(f"c_{end}"))
    joined = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return joined.filter(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).drop("c_a", "c_b")


def _crowded(paths: DataFrame, links: DataFrame, found: DataFrame) -> DataFrame:
    """(tree, region, id, degree, component): the members of regions that hold several components."""
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    members = paths.join(ends, "id", "left").join(found, "id", "left").select("tree", "region", "id", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("component", "id").alias("component"))
    members = kept(members)
    several = kept(members.groupBy("tree", "region").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("tree", "region"))
    return members.join(several, ["tree", "region"], "left_semi")


def _by_rare_shingles(crowded: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(a, b): for each node the FIRST others that it follows in most branches of rare shingles.

    The branches are range partitioned by node too, so one that all nodes have is spread over tasks.
    """

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            found = []
            for text in texts_of(batch):
                own = shingle_set(text, k)
                # The lowest hashes below a bound that follows from the set's size, so that two sets sample the same ones.
                low = own if len(own) <= SAMPLE else own[own <= np.uint64(SAMPLE / len(own) * (2**64 - 2**12))]
                found.append(low.view(np.int64))
            ends = np.cumsum([0, *map(len, found)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found) if found else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists], names=["id", "shingles"])

    def follow(shingles: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, shingles[1:] != shingles[:-1]]) if len(ids) else np.empty(0, np.int64)
        sizes = np.diff(np.r_[starts, len(ids)])
        good = np.repeat((sizes > 1) & (sizes <= RARE), sizes)
        shingles, ids = shingles[good], ids[good]
        found = []
        for step in range(1, FOLLOWERS + 1):
            near = (shingles[step:] == shingles[:-step]) & (ids[step:] != ids[:-step])
            found.append(np.stack([ids[:-step][near], ids[step:][near]]) if len(ids) > step else np.empty((2, 0), np.int64))
        pairs = np.sort(np.concatenate(found, axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = ids = np.empty(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            shingles = np.concatenate([shingles, batch.column("shingle").to_numpy()])
            ids = np.concatenate([ids, batch.column("id").to_numpy()])
            cut = len(shingles) - int(np.argmax(shingles[::-1] != shingles[-1])) if shingles[0] != shingles[-1] else 0
            yield follow(shingles[:cut], ids[:cut])
            # The last branch may go on in the next batch; of one with too many nodes no more is held than shows that.
            shingles, ids = shingles[cut:][-RARE - 1 :], ids[cut:][-RARE - 1 :]
        yield follow(shingles, ids)

    chosen = texts.join(kept(crowded.select("id").distinct()), "id", "left_semi").select("id", "text")
    own = chosen.mapInArrow(sample, "id long, shingles array<long>").select(F.explode("shingles").alias("shingle"), "id")
    order = ["shingle", F.xxhash64("shingle", "id"), "id"]
    pairs = own.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "a long, b long")
    pairs = kept(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= SHARED))
    both = pairs.select("a", "b", "shared", F.explode(F.array("a", "b")).alias("id"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("shared"), "a", "b"))
    return both.withColumn("place", place).filter(F.col("place") <= FIRST).select("a", "b").distinct()


def _with_hubs(crowded: DataFrame, hubs: int) -> DataFrame:
    """(a, b): members of regions of several components, each with the region's nodes of most links in others."""
    place = F.row_number().over(Window.partitionBy("tree", "region").orderBy(F.desc("degree"), "id"))
    best = kept(crowded.withColumn("place", place).filter(F.col("place") <= hubs).select("tree", "region", "place", F.col("id").alias("hub"), F.col("component").alias("of")))
    main = best.filter("place = 1").select("tree", "region", F.col("of").alias("main"))
    # The component of the first hub has most of a crowded region; its members wait for the others to come.
    rest = crowded.join(main, ["tree", "region"]).filter("component <> main")
    met = rest.join(best, ["tree", "region"]).filter("component <> of")
    return met.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def _frequent(docs: DataFrame, nodes: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of frequent shingles, FREQUENT at most, and how often each is in a sample of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            found = [shingle_set(text, k) for text in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64))], names=["shingle"])

    chosen = docs.filter(F.pmod(F.xxhash64("id"), F.lit(max(-(-nodes // COUNTED), 1))) == 0)
    counted = kept(chosen.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).cast("int").alias("n")).filter("n > 1"))
    # All that are as frequent as the bound allows.
    least, total = None, 0
    for n, shingles in counted.groupBy(F.least("n", F.lit(4096)).alias("n")).count().orderBy(F.desc("n")).collect():
        total += shingles
        if total > FREQUENT:
            break
        least = n
    found = counted.filter(F.lit(False) if least is None else F.col("n") >= least).toArrow()
    hashed, often = (found.column(c).to_numpy() for c in ("shingle", "n"))
    order = np.argsort(hashed.view(np.uint64))
    return hashed.view(np.uint64)[order], often[order]


def bitmap(shingles: np.ndarray) -> bytes:
    """For each of at least two bits a shingle whether an odd number of shingles falls on it."""
    size = max(64, 1 << (2 * len(shingles) - 1).bit_length()) if len(shingles) else 64
    found = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(found.astype(np.uint8)).tobytes()


def differing(x: bytes, y: bytes) -> int:
    """Shingles that at least are in one of the sets only, by their bitmaps."""
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(np.frombuffer(v, np.uint8).reshape(-1, size), axis=0).tobytes() if len(v) > size else v for v in (x, y))
    return (int.from_bytes(x, "little") ^ int.from_bytes(y, "little")).bit_count()


def _met(members: DataFrame, key: str, good: Column) -> DataFrame:
    """Members (key, id, component, main, n, ..) of a key, each with others (o_id, ..) of other components that are `good`, once.

    Those of a key's main component needn't meet each other; the rest meet all, so many of them at a time.
    """
    rest = members.filter("component <> main").withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / BESIDE).cast("int"))))
    every = members.select(key, F.pmod(F.xxhash64("id"), F.floor((F.col("n") - 1) / BESIDE) + 1).cast("int").alias("part"), *[F.col(c).alias(f"o_{c}") for c in members.columns if c not in (key, "main", "n")])
    once = (F.col("o_component") == F.col("main")) | (F.col("id") < F.col("o_id"))
    return rest.join(every, [key, "part"]).filter((F.col("component") != F.col("o_component")) & once & good)


def _with_main(members: DataFrame, key: str) -> DataFrame:
    """The members (key, id, component, ..) of keys of several components, with the one that has most and how many there are."""
    by = members.groupBy(key, "component").agg(F.count(F.lit(1)).alias("n"))
    shared = by.groupBy(key).agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("components"))
    return members.join(shared.filter("components > 1").drop("components"), key)


def _in_order(docs: DataFrame, nodes: int, k: int, percent: int) -> DataFrame:
    """(id, size, shingles, bits): of each set the first shingles, the least frequent ones, that tell whether it can be linked.

    Of the shingles that two similar sets share, the first COMMON (or all that the smaller must share, if it must share
    fewer) are among the first of both, since all others that must be shared come after them.
    """
    frequent, often = _frequent(docs, nodes, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            found, sizes, bits = [], [], []
            for text in texts_of(batch):
                own = shingle_set(text, k)
                rank = np.zeros(len(own), np.int64)
                if len(frequent) and len(own):
                    at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
                    rank = np.where(frequent[at] == own, often[at], 0)
                least = (percent * len(own) + 99) // 100
                found.append(own[np.lexsort((own, rank))[: len(own) - least + min(COMMON, least)]].view(np.int64))
                sizes.append(len(own))
                bits.append(bitmap(own))
            ends = np.cumsum([0, *map(len, found)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found) if found else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), lists, pa.array(bits, pa.binary())], names=["id", "size", "shingles", "bits"])

    return docs.mapInArrow(run, "id long, size long, shingles array<long>, bits binary")


def _by_prefixes(docs: DataFrame, nodes: DataFrame, joined: DataFrame, k: int, similarity: float) -> DataFrame:
    """(a, b): all nodes of different components that may be similar enough, by the least frequent of their shingles."""
    percent = round(similarity * 100)
    names = ["shingle", "id", "component", "size", "place"]

    def crowd(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.nulls(rows.shape[1], pa.int64())], names=[*names, "other"])

    def counted(found: list[np.ndarray]) -> pa.RecordBatch:
        a, b, asked = np.concatenate(found, axis=1)
        order = np.lexsort((asked, b, a))
        a, b, asked = a[order], b[order], asked[order]
        starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.empty(0, np.int64)
        nulls = pa.nulls(len(starts), pa.int64())
        columns = [nulls, pa.array(a[starts]), nulls, pa.array(np.diff(np.r_[starts, len(a)])), pa.array(asked[starts]), pa.array(b[starts])]
        return pa.RecordBatch.from_arrays(columns, names=[*names, "other"])

    def meet(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        shingle, ids, component, size, place = rows
        starts = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1]]) if len(ids) else np.empty(0, np.int64)
        sizes = np.diff(np.r_[starts, len(ids)])
        if (sizes > BESIDE).any():
            yield crowd(rows[:, np.repeat(sizes > BESIDE, sizes)])
        after = np.repeat(starts + np.where(sizes > BESIDE, 0, sizes), sizes) - np.arange(len(ids))
        at, step, found, n = np.arange(len(ids)), 0, [], 0
        while len(at):
            step += 1
            at = at[after[at] > step]
            # The last of the shared ones asked for has that many fewer shared ones behind it than the first.
            asked = np.minimum(COMMON, (percent * np.minimum(size[at], size[at + step]) + 99) // 100)
            left = np.minimum((size - place)[at], (size - place)[at + step]) + asked - 1
            good = (component[at] != component[at + step]) & ((100 + percent) * left >= percent * (size[at] + size[at + step]))
            x, y = ids[at[good]], ids[at[good] + step]
            found.append(np.stack([np.minimum(x, y), np.maximum(x, y), asked[good]]))
            n += len(x)
            if n > PAIRS:
                yield counted(found)
                found, n = [], 0
        if found:
            yield counted(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, held = None, np.empty((5, 0), np.int64)
        for batch in batches:
            rows = np.concatenate([held, np.stack([batch.column(c).to_numpy() for c in names])], axis=1)
            if hot is not None and (rows[0] == hot).any():
                yield crowd(rows[:, rows[0] == hot])
                rows = rows[:, rows[0] != hot]
            cut = int(np.searchsorted(rows[0], rows[0, -1])) if rows.shape[1] else 0
            yield from meet(rows[:, :cut])
            # The last shingle may go on in the next batch; of one with too many nodes none is held.
            held = rows[:, cut:]
            if held.shape[1] > BESIDE:
                hot = held[0, 0]
                yield crowd(held)
                held = held[:, :0]
        yield from meet(held)

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("size", "o_size", "bits", "o_bits"))
            good = pa.array([(100 + percent) * differing(x, y) <= (100 - percent) * (m + n) for m, n, x, y in zip(*columns, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(good) for c in ("a", "b")], names=["a", "b"])

    named = nodes.select("id").join(joined, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    first = kept(_in_order(docs, nodes.count(), k, percent).join(named, "id"))
    places = first.select("id", "size", "component", F.posexplode("shingles").alias("place", "shingle")).select(*[F.col(c).cast("long").alias(c) for c in names])
    met = kept(places.repartition("shingle").sortWithinPartitions("shingle").mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "other"])))
    few = met.filter("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b"), F.col("size").alias("n"), F.col("place").alias("asked"))
    asked = F.least(F.lit(COMMON), F.ceil(percent * F.least("size", "o_size") / 100)).cast("long")
    left = F.least(F.col("size") - F.col("place"), F.col("o_size") - F.col("o_place")) + asked - 1
    enough = (100 + percent) * left >= percent * (F.col("size") + F.col("o_size"))
    many = _met(kept(_with_main(met.filter("other IS NULL").drop("other"), "shingle")), "shingle", enough)
    many = many.select(F.least("id", "o_id").alias("a"), F.greatest("id", "o_id").alias("b"), F.lit(1).cast("long").alias("n"), asked.alias("asked"))
    shared = few.unionByName(many).groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("asked").alias("asked"))
    pairs = kept(shared.filter("n >= asked").select("a", "b"))
    x, y = (first.select(F.col("id").alias(end), F.col("size").alias(f"{o}size"), F.col("bits").alias(f"{o}bits")) for end, o in (("a", ""), ("b", "o_")))
    return pairs.join(y, "b").join(x, "a").mapInArrow(alike, "a long, b long").distinct()


def link(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of (doc_id, text).

    Two texts are linked if the Jaccard similarity of their sets of k-word shingles, A-Z in lower case, is
    `similarity` or more (whole percents). component_id is the smallest doc_id that links reach, and that
    document is kept. Texts without words are linked with nothing. Rows with a null doc_id are compared with
    nothing, have a null component and are kept; rows of one doc_id are one document; other columns are left out.
    """
    found = sketches(docs, k)
    classes = found.filter("set IS NOT NULL AND doc_id IS NOT NULL").groupBy("set").agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature"))
    classes = kept(classes)
    nodes = classes.select("id", "signature").dropDuplicates(["id"])
    met = kept(neighbours(nodes))
    pending = rated(met, nodes, similarity)
    involved = kept(pending.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    chosen = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    texts = kept(chosen.join(involved, "id", "left_semi").dropDuplicates(["id"]))
    some = kept(nodes.join(involved, "id", "left_semi"))
    paths = kept(branches(some).select("tree", F.substring("path", 1, 4 * REGION_PREFIX).alias("region"), "id"))

    ends = pending.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("e"), "rate").select("e.*", "rate")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("rate"), "other"))
    first = ends.withColumn("place", place).filter(F.col("place") <= FIRST).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    first = kept(first)
    links = confirmed(first, texts, k, similarity).filter("linked").select("a", "b")
    joined = components(links)
    todo, rounds = pending.select("a", "b").join(first, ["a", "b"], "left_anti"), [HUBS[0], None, *HUBS[1:]]
    while rounds:
        crowded = kept(_crowded(paths, links, joined))
        candidates = _with_hubs(crowded, rounds[0]) if rounds[0] else _by_rare_shingles(crowded, texts, k)
        candidates = kept(candidates.join(met, ["a", "b"], "left_anti"))
        met = met.unionByName(candidates)
        rest = _between(todo.unionByName(rated(candidates, some, similarity).select("a", "b")), joined)
        more = confirmed(rest, texts, k, similarity).filter("linked").select("a", "b")
        found_more = more.limit(1).count() > 0
        if len(rounds) > 1 or not found_more:
            rounds.pop(0)  # the widest round is repeated for as long as it finds links
        todo = todo.limit(0)
        if found_more:
            links = kept(links.unionByName(more))
            joined = components(links)
    chosen = chosen.filter("id IS NOT NULL")
    missed = kept(_by_prefixes(chosen, nodes, joined, k, similarity))
    ends = missed.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    more = confirmed(missed, kept(chosen.join(ends, "id", "left_semi").dropDuplicates(["id"])), k, similarity).filter("linked").select("a", "b")
    if more.limit(1).count():
        joined = components(kept(links.unionByName(more)))
    named = classes.select("set", F.col("id")).join(joined, "id", "left").select("set", F.coalesce("component", "id").alias("component"))
    out = found.select("doc_id", "n_shingles", "set").join(named, "set", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op7_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(documents(spark, sf_dir), k=2)
