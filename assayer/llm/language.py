"""Language identification by character models with interpolated Kneser-Ney smoothing.

Letters of words are counted as four-character windows per language; the lower orders' continuation counts
follow from the distinct windows. Discounts, probabilities and back-offs are aggregates and joins over all windows;
every window of the texts gets its probabilities in all languages, and these are looked up in arrays sorted by the
windows' hashes, in as many passes as it takes. A text's language is the one with the lowest cross-entropy per character; how
sure that is, and from which cross-entropy on a text is rejected, is calibrated on learning documents that
were not counted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_text, documents, kept, mix

ORDER = 4
COLUMNS = ("a", "b", "c", "d")
# Probabilities that are sent to every task at once; a larger model takes more passes over the texts.
AT_ONCE = 4_000_000
# Words whose cross-entropies a worker keeps before it starts anew.
MEMO = 400_000
SHARPNESS = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0)
WEIGHTS = tuple(2**40 + 2 * i + 1 for i in range(ORDER))


def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    found = np.zeros(0x110000, bool)
    found[[c for c in range(len(found)) if chr(c).isalpha()]] = True
    return found


def windows(words: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows of all letter runs in the words, and the word each belongs to.

    A window's last character is the one to predict: a letter, or 0 for the end of a run. What lies before
    the run's beginning is 0.
    """
    codes = np.frombuffer(("\n".join(words) + "\n").encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    owner = np.cumsum(codes == 10) - (codes == 10)
    c = np.where(letters[codes], codes, 0)
    before = [np.concatenate([np.zeros(k, np.int64), c[:-k]])[: len(c)] if k else c for k in range(ORDER)]
    for k in range(2, ORDER):
        before[k] = np.where(before[k - 1] == 0, 0, before[k])
    events = (c != 0) | (before[1] != 0)
    return np.stack(before[::-1], axis=1)[events], owner[events]


def window_hash(codes: np.ndarray) -> np.ndarray:
    """Hashes of windows of any order, by code points; the order counts."""
    out = np.full(len(codes), codes.shape[1], np.uint64)
    for j in range(codes.shape[1]):
        out = mix(out * np.uint64(WEIGHTS[0]) + codes[:, j].astype(np.uint64) * np.uint64(WEIGHTS[j]) + np.uint64(j))
    return out


def count_windows(texts: DataFrame) -> DataFrame:
    """(lang, a, b, c, d, n): how often each window occurs in the texts (lang, text) of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letters()
        found: dict[str, Counter] = {}

        def flush():
            for lang, counts in found.items():
                codes, owner = windows(list(counts), letters)
                if not len(codes):
                    continue
                weight = np.fromiter(counts.values(), np.int64, len(counts))[owner]
                _, first, which = np.unique(window_hash(codes), return_index=True, return_inverse=True)
                n = np.bincount(which, weight, len(first)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), *(pa.array(codes[first, j]) for j in range(ORDER)), pa.array(n)], names=["lang", "a", "b", "c", "d", "n"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update((text or "").lower().split())
            if sum(map(len, found.values())) > 1_000_000:
                yield from flush()
                found = {}
        yield from flush()

    counted = texts.mapInArrow(run, "lang string, a long, b long, c long, d long, n long")
    return counted.groupBy("lang", "a", "b", "c", "d").agg(F.sum("n").alias("n"))


def estimate(counted: DataFrame, languages: list[str]) -> DataFrame:
    """(a, b, c, d, logs): of every window of `counted` (lang, a, b, c, d, n) the log probabilities of its last character.

    `logs` has the languages' in order. Rows without a lang are windows that are to be scored but weren't learned.
    """
    each = lambda values: F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("lang")]
    by_place = lambda value: F.map_from_entries(F.collect_list(F.struct(each({x: i for i, x in enumerate(languages)}), value)))
    places = F.sequence(F.lit(0), F.lit(len(languages) - 1))
    tables = {ORDER: counted.filter("lang IS NOT NULL")}
    for order in range(ORDER - 1, 0, -1):  # continuation counts: in how many longer windows
        tables[order] = kept(tables[order + 1].groupBy("lang", *COLUMNS[-order:]).agg(F.count(F.lit(1)).alias("n")))
    alphabet = tables[1].select("d").distinct().count() + 1
    lower = logs = None
    for order in range(1, ORDER + 1):
        table, names, history = tables[order], list(COLUMNS[-order:]), list(COLUMNS[-order:-1])
        whole = {r.lang: r for r in table.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).collect()}
        discounts = {x: min(max(r.ones / max(r.ones + 2 * r.twos, 1), 0.1), 0.9) for x, r in whole.items()}
        discount = each(discounts)
        wanted = counted.select(*names).distinct()
        if order == 1:
            floor = [float(np.log(discounts[x] * whole[x].kinds / whole[x].total / alphabet)) for x in languages]
            table = table.withColumns({"total": each({x: r.total for x, r in whole.items()}), "kinds": each({x: r.kinds for x, r in whole.items()}), "shorter": F.lit(1 / alphabet)})
            rest = wanted.withColumn("rest", F.array(*[F.lit(x) for x in floor]))
        else:
            sums = kept(table.groupBy("lang", *history).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")))
            table = table.join(sums, ["lang", *history]).join(lower, ["lang", *names[1:]])
            # A window unseen in a language has its back-off weight times the shorter window.
            backs = sums.groupBy(*history).agg(by_place(F.ln(discount * F.col("kinds") / F.col("total"))).alias("backs"))
            rest = wanted.join(logs, names[1:]).join(backs, history, "left")
            rest = rest.select(*names, F.transform(places, lambda i: F.coalesce(F.col("backs")[i], F.lit(0.0)) + F.get("logs", i)).alias("rest"))
        p = (F.col("n") - discount) / F.col("total") + discount * F.col("kinds") / F.col("total") * F.col("shorter")
        table = kept(table.select("lang", *names, p.alias("shorter")))
        seen = table.groupBy(*names).agg(by_place(F.ln("shorter")).alias("seen"))
        logs = kept(rest.join(seen, names, "left").select(*names, F.transform(places, lambda i: F.coalesce(F.col("seen")[i], F.get("rest", i))).alias("logs")))
        lower = table
    return logs


class Model:
    """The estimates over counts that one process holds; `estimate` is the same over tables of any size.

    Sorted hashes of windows of all orders, and for each language a log probability and a back-off weight."""

    def __init__(self, counts: pd.DataFrame) -> None:
        """`counts` has (lang, a, b, c, d, n)."""
        self.languages = sorted(counts["lang"].unique().tolist())
        alphabet = max(counts["d"].nunique(), 1) + 1
        columns = ["a", "b", "c", "d"]
        per = {lang: self._estimate(counts[counts["lang"] == lang], columns, alphabet) for lang in self.languages}
        self.keys, self.logs, self.backs = [], [], []
        lower_keys = lower_logs = None
        for order in range(1, ORDER + 1):
            seen = pd.concat([per[x][order - 1].assign(lang=i) for i, x in enumerate(self.languages)], ignore_index=True)
            codes = seen[columns[-order:]].to_numpy(np.int64)
            keys, where = np.unique(window_hash(codes), return_inverse=True)
            first = np.zeros(len(keys), np.int64)
            first[where] = np.arange(len(where))
            logs = np.full((len(keys), len(self.languages)), np.nan, np.float32)
            logs[where, seen["lang"]] = seen["log"]
            missing = np.isnan(logs)
            if order == 1:
                floor = np.array([per[x][ORDER] for x in self.languages], np.float32)
                logs = np.where(missing, floor, logs)
                self.floor = floor
            else:
                # A window unseen in a language has its back-off weight times the shorter window.
                shorter = codes[first][:, 1:]
                base = lower_logs[np.searchsorted(lower_keys, window_hash(shorter))]
                context = self.back(codes[first][:, :-1], per)
                logs = np.where(missing, context + base, logs)
            self.keys.append(keys)
            self.logs.append(logs)
            lower_keys, lower_logs = keys, logs
        self.contexts = []
        for order in range(1, ORDER):
            seen = pd.concat([per[x][ORDER + 1][order].assign(lang=i) for i, x in enumerate(self.languages)], ignore_index=True)
            keys, where = np.unique(window_hash(seen[[f"h{j}" for j in range(order)]].to_numpy(np.int64)), return_inverse=True)
            backs = np.zeros((len(keys), len(self.languages)), np.float32)
            backs[where, seen["lang"]] = seen["back"]
            self.contexts.append((keys, backs))

    def back(self, histories: np.ndarray, per: dict) -> np.ndarray:
        out = np.zeros((len(histories), len(self.languages)), np.float32)
        order = histories.shape[1]
        wanted = window_hash(histories)
        for i, lang in enumerate(self.languages):
            table = per[lang][ORDER + 1][order]
            keys = window_hash(table[[f"h{j}" for j in range(order)]].to_numpy(np.int64))
            sort = np.argsort(keys)
            at = np.minimum(np.searchsorted(keys[sort], wanted), len(keys) - 1)
            out[:, i] = np.where(keys[sort][at] == wanted, table["back"].to_numpy()[sort][at], 0.0)
        return out

    @staticmethod
    def _estimate(counts: pd.DataFrame, columns: list[str], alphabet: int) -> list:
        """Log probabilities by order, the log probability of an unseen character, and back-off weights by order."""
        tables, value = [], counts.groupby(columns, as_index=False)["n"].sum()
        tables.append(value)
        for order in range(ORDER - 1, 0, -1):  # continuation counts: in how many longer windows
            value = value.groupby(columns[-order:], as_index=False).size().rename(columns={"size": "n"})
            tables.append(value)
        tables.reverse()
        out, backs, lower = [], {}, None
        floor = 0.0
        for order, table in enumerate(tables, start=1):
            ones, twos = (table["n"] == 1).sum(), (table["n"] == 2).sum()
            discount = min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.9)
            history = columns[-order:-1]
            if history:
                sums = table.groupby(history, as_index=False)["n"].agg(total="sum", kinds="size")
                table = table.merge(sums, on=history)
                table = table.merge(lower, on=columns[-order + 1 :])
            else:
                sums = pd.DataFrame({"total": [table["n"].sum()], "kinds": [len(table)]})
                table = table.assign(total=table["n"].sum(), kinds=len(table), shorter=1 / alphabet)
            weight = discount * table["kinds"] / table["total"]
            table["p"] = (table["n"] - discount) / table["total"] + weight * table["shorter"]
            if order == 1:
                floor = float(np.log(discount * len(table) / max(table["n"].sum(), 1) / alphabet))
            else:
                backs[order - 1] = pd.DataFrame({f"h{j}": sums[c] for j, c in enumerate(history)} | {"back": np.log(discount * sums["kinds"] / sums["total"])})
            out.append(table[columns[-order:]].assign(log=np.log(table["p"])))
            lower = table[columns[-order:]].assign(shorter=table["p"])
        return [*out, floor, backs]

    def score(self, codes: np.ndarray) -> np.ndarray:
        """Log probabilities of windows' last characters, a column per language."""
        out = np.zeros((len(codes), len(self.languages)), np.float32)
        rest = np.arange(len(codes))
        for order in range(ORDER, 0, -1):
            part = codes[rest][:, -order:]
            wanted, keys = window_hash(part), self.keys[order - 1]
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            hit = keys[at] == wanted
            out[rest[hit]] += self.logs[order - 1][at[hit]]
            rest, part = rest[~hit], part[~hit]
            if not len(rest):
                return out
            if order > 1:
                keys, backs = self.contexts[order - 2]
                wanted = window_hash(part[:, :-1])
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                out[rest] += np.where((keys[at] == wanted)[:, None], backs[at], 0)
        out[rest] += self.floor
        return out


def score_texts(docs: DataFrame, logs: DataFrame, size: int, at_once: int = AT_ONCE) -> DataFrame:
    """docs with `losses` (for each of `size` languages the text's negative log probability) and `events` (its characters).

    `logs` has all windows of the texts. Each pass adds what its part of them contributes.
    """
    parts = max(1, -(-logs.count() * size // at_once))
    found = docs.select("*", F.array_repeat(F.lit(0.0), size).alias("losses"), F.lit(0).cast("long").alias("events"))
    schema = found.schema
    for part in range(parts):
        some = logs.filter(F.pmod(F.xxhash64(*COLUMNS), F.lit(parts)) == part).select(*COLUMNS, F.col("logs").cast("array<float>").alias("logs")).toArrow()
        keys = window_hash(np.stack([some.column(c).to_numpy() for c in COLUMNS], axis=1).astype(np.int64))
        order = np.argsort(keys)
        values = some.column("logs").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
        spread = docs.sparkSession.sparkContext.broadcast((keys[order], values[order]))  # at_once probabilities, about

        def run(batches: Iterator[pa.RecordBatch], spread=spread) -> Iterator[pa.RecordBatch]:
            (keys, values), letters = spread.value, _letters()
            known: dict[str, int] = {}
            table = np.zeros((0, size + 1), np.float32)
            for batch in batches:
                texts = batch.column("text").to_pylist()
                sums = np.zeros((len(texts), size + 1))
                for at in range(0, len(texts), 256):
                    split = [(x or "").lower().split() for x in texts[at : at + 256]]
                    new = [w for w in set().union(*split) if w not in known]
                    if len(known) + len(new) > MEMO:
                        known, table = {}, table[:0]
                        new = list(set().union(*split))
                    if new:
                        codes, owner = windows(new, letters)
                        wanted = window_hash(codes)
                        place = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
                        here = np.flatnonzero(keys[place] == wanted) if len(keys) else place[:0]
                        scores = values[place[here]]
                        found = [np.bincount(owner[here], -scores[:, i], len(new)) for i in range(size)]
                        found.append(np.bincount(owner, minlength=len(new)))
                        known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                        table = np.concatenate([table, np.stack(found, axis=1).astype(np.float32)])
                    for i, words in enumerate(split):
                        if words:
                            sums[at + i] = table[[known[w] for w in words]].sum(axis=0, dtype=np.float64)
                losses = sums[:, :size].ravel() + batch.column("losses").flatten().to_numpy()
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, len(texts) * size + 1, size), pa.int32()), pa.array(losses))
                names = [c for c in batch.schema.names if c not in ("losses", "events")]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), flat, pa.array(sums[:, size].astype(np.int64))], names=[*names, "losses", "events"])

        found = found.mapInArrow(run, schema)
        if part + 1 < parts:
            found = kept(found)  # one part at a time in a task's memory
    return found.drop("text")


def identify(docs: DataFrame, at_once: int = AT_ONCE, reject: float = 0.001) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, cross_entropy, accepted) for every row of (doc_id, text, lang).

    Documents whose crc32(doc_id) mod 4 is 2 are held out; of the others with a lang, remainders 1 and 3 are
    counted and remainder 0 calibrates. `score` is the calibrated probability of the prediction. A text whose
    cross-entropy exceeds all but the share `reject` of calibrating texts of its predicted language isn't
    accepted. Null text, or one without a letter, is `und` with score 0, and so is every text where nothing can
    be learned. Rows are judged each on their text alone; ties go to the first language by name.
    """
    fold = crc_text("doc_id") % 4
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), fold.cast("int").alias("fold"))
    learned = F.when(F.col("lang").isNotNull() & F.col("fold").isin(1, 3), F.col("lang"))
    counted = kept(count_windows(rows.select(learned.alias("lang"), "text")))
    languages = sorted(r[0] for r in counted.filter("lang IS NOT NULL").select("lang").distinct().collect())
    held = (F.col("fold") == 2).alias("held_out")
    if not languages:
        return rows.select("doc_id", held, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(False).alias("accepted"))
    scored = kept(score_texts(rows, estimate(counted, languages), len(languages), at_once))
    names = F.array(*[F.lit(x) for x in languages])
    ce = F.transform("losses", lambda x: x / F.col("events"))
    best = F.array_min("ce")
    found = scored.filter("events > 0").withColumn("ce", ce).select("*", F.get(names, F.array_position("ce", best).cast("int") - 1).alias("lang_pred"), best.alias("cross_entropy"))
    known = found.filter(F.col("lang").isNotNull() & (F.col("fold") == 0) & F.array_contains(names, F.col("lang")))
    truth = F.get("ce", F.array_position(names, F.col("lang")).cast("int") - 1)

    def partition(sharpness: float):
        return F.aggregate("ce", F.lit(0.0), lambda a, x: a + F.exp((F.col("cross_entropy") - x) * sharpness))

    losses = [F.sum((truth - F.col("cross_entropy")) * s + F.ln(partition(s))).alias(str(i)) for i, s in enumerate(SHARPNESS)]
    fitted = known.agg(*losses).first()
    sharpness = min(zip((x if x is not None else 0.0 for x in fitted), SHARPNESS, strict=True))[1]
    limits = {r[0]: r[1] for r in known.groupBy("lang_pred").agg(F.expr(f"percentile_approx(cross_entropy, {1 - reject})")).collect()}
    limit = F.get(F.array(*[F.lit(limits.get(x)).cast("double") for x in languages]), F.array_position(names, F.col("lang_pred")).cast("int") - 1)
    judged = scored.withColumn("ce", F.when(F.col("events") > 0, ce)).withColumn("cross_entropy", F.array_min("ce"))
    judged = judged.withColumn("lang_pred", F.coalesce(F.get(names, F.array_position("ce", F.col("cross_entropy")).cast("int") - 1), F.lit("und")))
    score = F.coalesce(1 / partition(sharpness), F.lit(0.0))
    return judged.select("doc_id", held, "lang_pred", score.alias("score"), "cross_entropy", F.coalesce(F.col("cross_entropy") <= limit, F.lit(False)).alias("accepted"))


def op6_character_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
