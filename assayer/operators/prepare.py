"""Preparing cases for requests: decoding, cleaning, joining appendices, judging fills."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing, jsontext, text
from ..sources.texts import decoded


def prepare_cases(
    cases: DataFrame, files: DataFrame, appendices: DataFrame, cleanup: Sequence[str], layout: dict[str, str] | None = None,
    key: tuple[str, bytes] | None = None,
) -> DataFrame:
    """Every case with the text of its vignette and appendices, whether the source drifted, and any problem.

    `cases`: digest, source, source_id, hex, appendices (ordered array of digests);
    `files`: source, source_id, content; `appendices`: digest, text.
    A case holds few appendices, so they are joined per reference and put back in order. A case
    whose file isn't there or doesn't decode, or that refers to an appendix that isn't there, stays
    with null in that text's place and says so in `problem`.

    With a `key` (its id and secret) fingerprints are keyed. Where cases have a `key_id`, one that isn't the key's (null
    for none) can't be compared: the case says so, and whether it drifted stays unknown.
    """
    read = cases.join(files, ["source", "source_id"], "left")
    observed = hashing.fingerprint(F.col("content")) if key is None else hashing.hmac_fingerprint(F.col("content"), key[1])
    given = F.lit(None if key is None else key[0]).cast("string")
    keyed = F.col("key_id") if "key_id" in cases.columns else given
    other = ~keyed.eqNullSafe(given)
    named = lambda c: F.coalesce(F.concat(F.lit("'"), c, F.lit("'")), F.lit("None"))
    placed = (
        cases.select("digest", F.posexplode("appendices").alias("pos", "appendix"))
        .join(appendices.select(F.col("digest").alias("appendix"), "text"), "appendix", "left")
        .groupBy("digest")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("placed"), F.count_if(F.col("text").isNull()).alias("missing"))
        .select("digest", F.transform("placed", lambda p: p["text"]).alias("texts"), "missing")
    )
    texts = F.coalesce("texts", F.array().cast("array<string>"))
    missing = F.coalesce("missing", F.lit(0))
    problem = (
        F.when(other, F.concat(F.lit("the case's vignette is fingerprinted with key "), named(keyed), F.lit(", not "), named(given)))
        .when(F.col("content").isNull(), F.lit("its source has no such file"))
        .when(decoded(F.col("content")).isNull(), F.lit("its file isn't UTF-8"))
        .when(missing > 0, F.concat(missing.cast("string"), F.lit(" of its appendices are missing")))
    )
    return read.join(placed, "digest", "left").select(
        "digest",
        text.clean(decoded(F.col("content")), cleanup).alias("vignette"),
        F.when(missing == 0, text.join_appendices(texts, **(layout or {}))).alias("appendices"),
        observed.alias("fingerprint"),
        F.when(~other, observed != F.col("hex")).alias("drifted"),
        (F.col("content").isNotNull() & decoded(F.col("content")).isNull()).alias("undecodable"),
        problem.alias("problem"),
    )


def judge_fill(items: Column, written: Column | None = None) -> Column:
    """`text@1`: one string as it is, strings one per line, anything else as indented JSON.

    `items` is array<variant>; a single item that is itself a list is written as that list. Objects have their
    members in order where the items are given as written, too (tape.picks).
    """

    def listed(values: Column) -> Column:
        strings = F.forall(values, lambda v: F.schema_of_variant(v) == "STRING")
        joined = F.array_join(F.transform(values, lambda v: v.try_cast("string")), "\n")
        return F.when(strings, joined)

    only = F.when(F.size(items) == 1, F.get(items, F.lit(0)))
    inner = only.try_cast("array<variant>")
    plain = F.when(F.schema_of_variant(only) == "STRING", only.try_cast("string")).when(
        inner.isNotNull(), listed(inner)
    ).when(F.size(items) != 1, listed(items))
    texts = F.transform(items, lambda v: F.to_json(v)) if written is None else written
    whole = F.when(F.size(items) == 1, F.get(texts, F.lit(0))).otherwise(
        F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))
    )
    return F.coalesce(plain, jsontext.indented(F.when(plain.isNull(), whole)))
