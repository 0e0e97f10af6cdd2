"""Quality rules whose cutoffs are certified on labelled documents.

A rule rejects a text in which some share (symbols, capitals, repeated words, repeated lines) is above a
cutoff. For each stratum and rule the cutoffs are tried from the most lenient on; the exact binomial test of
"at least this share of good documents is rejected" must fail at each step, and the last that does is taken.
Trying in a fixed order needs no correction over cutoffs; over strata and rules the level is divided.
All of it is expressions on the text's own row and sums by stratum.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_WORD, documents, kept

RULES = ("symbols", "capitals", "repeats", "lines")
CUTOFFS = (0.9, 0.75, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.16, 0.13, 0.1, 0.08, 0.06, 0.04, 0.03, 0.02, 0.01)
# The contract's symbols; A-Z.
SYMBOLS, CAPITALS = "#*$%&|<>", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WHITE = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over a value that is computed once for the row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def repeated_words(items: Column) -> Column:
    """How many words lie in a three-word window that occurs twice or more in the array.

    Windows are hashed to 64 bits and sorted with their places; the places of equal neighbours are sorted
    again, and each adds what the ones before it don't cover.
    """

    def windows(h: Column) -> Column:
        last = F.size(h) - 3
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.struct(F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)).alias("h"), i.alias("p")),
        )

    def twice(s: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i + 1) | same(x, i - 1)), lambda x: x["p"]))

    def cover(places: Column) -> Column:
        start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        step = lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    hashed = F.transform(items, lambda w: F.xxhash64(w))
    found = let(hashed, lambda h: let(F.sort_array(windows(h)), lambda s: cover(twice(s))))
    return F.when(F.size(items) < 4, F.lit(0).cast("long")).otherwise(found)


def measures(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Counts and shares of every text; a null text has no words. The stratum may be null."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = docs.select(F.col("doc_id"), F.col(stratum).cast("string").alias("stratum"), text.alias("text"))
    items = F.filter(F.split("text", NOT_WORD), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = let(items, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    line_counts = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    found = plain.select(
        "doc_id",
        "stratum",
        counts.alias("counts"),
        line_counts.alias("lines"),
        _without(F.col("text"), WHITE).cast("long").alias("word_chars"),
        (F.length("text") - _without(F.col("text"), SYMBOLS)).cast("long").alias("n_symbols"),
        (F.length("text") - _without(F.col("text"), CAPITALS)).cast("long").alias("n_capitals"),
    ).select("doc_id", "stratum", "counts.*", "lines.*", "word_chars", "n_symbols", "n_capitals")
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    shares = F.array(share("n_symbols", "word_chars"), share("n_capitals", "word_chars"), share("n_repeat_words", "n_words"), share("n_dup_lines", "n_lines"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.withColumns({"shares": shares, "base_failed": failed})


def at_most(k: Column, n: Column, rate: Column) -> Column:
    """P(Bin(n, rate) <= k) for k <= rate * n, exact up to rounding: the largest term in logs, the rest as ratios."""
    log_choose = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), F.lit(0.0), lambda a, i: a + F.ln((n - i + 1) / i))
    largest = log_choose + k * F.ln(rate) + (n - k) * F.ln(1 - rate)
    down = F.when(k > 0, F.sequence(k, F.lit(1).cast("long"), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def add(a: Column, i: Column) -> Column:
        term = a["t"] * i * (1 - rate) / ((n - i + 1) * rate)
        return F.struct(term.alias("t"), (a["s"] + term).alias("s"))

    return F.exp(largest) * F.aggregate(down, start, add, lambda a: a["s"])


def certify(measured: DataFrame, labels: DataFrame, rate: float = 0.04, level: float = 0.05, cutoffs: tuple[float, ...] = CUTOFFS) -> DataFrame:
    """(stratum, n_good, cutoffs): for each rule the strictest certified cutoff, null where none is.

    With probability 1 - level, in no stratum do the rules together reject more than `rate` of the good
    documents, of which the labelled ones (quality = 1) are the holdout.
    """
    good = labels.groupBy("doc_id").agg(F.max("quality").alias("quality")).filter("quality = 1").select("doc_id")
    held = measured.join(good, "doc_id", "left_semi")
    above = [F.sum((F.col("shares")[r] > c).cast("long")).alias(f"k_{r}_{j}") for r in range(len(RULES)) for j, c in enumerate(cutoffs)]
    counted = kept(held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *above))
    strata = max(counted.count(), 1)
    each = rate / len(RULES)

    def passed(r: int, j: int) -> Column:
        k = F.col(f"k_{r}_{j}")
        test = at_most(k, F.col("n"), F.lit(each)) <= level / (strata * len(RULES))
        return F.when(k > each * F.col("n"), F.lit(False)).otherwise(test)

    def strictest(r: int) -> Column:
        tried = F.array(*[F.struct(F.lit(c).alias("c"), passed(r, j).alias("ok")) for j, c in enumerate(cutoffs)])
        start = F.struct(F.lit(True).alias("on"), F.lit(None).cast("double").alias("c"))
        step = lambda a, x: F.struct((a["on"] & x["ok"]).alias("on"), F.when(a["on"] & x["ok"], x["c"]).otherwise(a["c"]).alias("c"))
        return F.aggregate(tried, start, step, lambda a: a["c"])

    return counted.select("stratum", F.col("n").alias("n_good"), F.array(*[strictest(r) for r in range(len(RULES))]).alias("cutoffs"))


def apply_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **settings) -> DataFrame:
    """One row per row of docs with its counts, the base's verdict, the rules it failed and whether it is kept.

    A stratum without a certified cutoff (too few labelled documents, or none) rejects nothing by that rule; the
    null stratum is one of its own. Null text has no words and fails the base. Repeated rows are judged each.
    """
    measured = kept(measures(docs, stratum))
    chosen = kept(certify(measured, labels, **settings))
    joined = measured.join(chosen.withColumnRenamed("stratum", "of"), F.col("stratum").eqNullSafe(F.col("of")), "left")
    broken = F.array_compact(
        F.array(*[F.when(F.col("shares")[r] > F.col("cutoffs")[r], F.lit(name)) for r, name in enumerate(RULES)])
    )
    return joined.withColumn("failed_rules", broken).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def op4_certified_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = apply_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return found.select(*columns, F.concat_ws(",", "failed_rules").alias("failed_rules"))
