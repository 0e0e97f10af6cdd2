"""Titles that are made of other titles: recipes of their parts, cases with their appendices, forks by their changes.

Every thread and digest is first a list of parts, each a text or the title of something else. Titles are then folded
from below: what has no open part is titled, and its title goes into the parts that name it, level by level.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsontext, text
from ..session import checkpoint_dir
from .catalog import about, heads

# Fixed value: how a digest is written.
DIGEST = r"^sha256:[0-9a-f]{64}\z"
PART = ["key", "pos", "text", "ref"]


def _thread(c: Column | str) -> Column:
    return F.concat(F.lit("t:"), (F.col(c) if isinstance(c, str) else c).cast("string"))


def _digest(c: Column | str) -> Column:
    return F.concat(F.lit("d:"), F.col(c) if isinstance(c, str) else c)


def _own(c: Column | str) -> Column:
    return F.concat(F.lit("o:"), F.col(c) if isinstance(c, str) else c)


def fold(parts: DataFrame) -> DataFrame:
    """(key, title) from parts (key, pos, text, ref), where a part with a `ref` is that key's title.

    A step fills in what the last one titled; there are as many steps as titles are nested, each checkpointed. A part
    that names nothing known is its key without what it is; titles that go round stay out.
    """
    checkpoint_dir(parts.sparkSession)
    known = parts.select(F.col("key").alias("ref")).distinct()
    unknown = F.when(F.col("ref").isNotNull() & F.col("known").isNull(), F.substring("ref", 3, 1 << 20))
    joined = parts.join(known.withColumn("known", F.lit(True)), "ref", "left")
    open_parts = joined.select("key", "pos", F.coalesce(unknown, "text").alias("text"), F.when(F.col("known"), F.col("ref")).alias("ref")).checkpoint()

    def titled(rows: DataFrame) -> DataFrame:
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("text")))), lambda p: p["text"])
        return rows.groupBy("key").agg(F.count("ref").alias("open"), F.array_join(ordered, "").alias("title")).where("open = 0").select("key", "title").checkpoint()

    done = new = titled(open_parts)
    while not new.isEmpty():
        left = open_parts.join(new.select("key"), "key", "left_anti")
        filled = left.join(new.select(F.col("key").alias("ref"), "title"), "ref", "left")
        open_parts = filled.select("key", "pos", F.coalesce("title", "text").alias("text"), F.when(F.col("title").isNull(), F.col("ref")).alias("ref")).checkpoint()
        new = titled(open_parts)
        done = done.unionByName(new)
    return done


def _list(rows: DataFrame, key: Column, order: Column, ref: Column, first: Column, between: str) -> DataFrame:
    """Parts of a list of titles: `first` stands before the first one, `between` before each other."""
    by = rows.select(key.alias("key"), order.alias("at"), ref.alias("item"), first.alias("first"))
    lists = by.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "item"))).alias("items"), F.any_value("first").alias("first"))
    spread = lists.select("key", "first", F.posexplode("items").alias("n", "i"))
    before = F.when(F.col("n") == 0, F.col("first")).otherwise(F.lit(between))
    both = F.array(F.struct((F.col("n") * 2 + 10).alias("pos"), before.alias("text"), F.lit(None).cast("string").alias("ref")), F.struct((F.col("n") * 2 + 11).alias("pos"), F.lit(None).cast("string").alias("text"), F.col("i.item").alias("ref")))
    return spread.select("key", F.inline(both))


def _single(key: Column, rows: DataFrame, words: Column | None = None, ref: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select(key.alias("key"), F.lit(0).alias("pos"), (none if words is None else words).alias("text"), (none if ref is None else ref).alias("ref"))


def change_parts(varied: DataFrame) -> DataFrame:
    """What a fork changes, (thread, path, after as JSON), as parts after its base's title."""
    key = F.regexp_replace(F.regexp_replace("path", "^/recipe/", ""), "^/", "")
    after = F.col("after")
    string = F.when(after.startswith('"'), F.get_json_object(F.concat(F.lit('{"s":'), after, F.lit("}")), "$.s"))
    is_digest = F.coalesce(string.rlike(DIGEST), F.lit(False))
    words = (
        F.when(after.isNull() | (after == "null"), F.concat(F.lit("no "), key))
        .when(is_digest, F.concat(key, F.lit(": ")))
        .when(string.isNotNull(), F.concat(key, F.lit(": "), text.snippet(string)))
        .otherwise(F.concat(key, F.lit(": "), jsontext.spaced(after)))
    )
    each = varied.select("thread", F.struct("path", F.concat(F.lit(", "), words).alias("text"), F.when(is_digest, _digest(string)).alias("ref")).alias("c"))
    listed = each.groupBy("thread").agg(F.sort_array(F.collect_list("c")).alias("cs")).select("thread", F.posexplode("cs").alias("n", "c"))
    none = F.lit(None).cast("string")
    both = F.array(
        F.struct((F.col("n") * 2 + 10).alias("pos"), F.col("c.text").alias("text"), none.alias("ref")),
        F.struct((F.col("n") * 2 + 11).alias("pos"), none.alias("text"), F.col("c.ref").alias("ref")),
    )
    return listed.select(_thread("thread").alias("key"), F.inline(both)).where("text IS NOT NULL OR ref IS NOT NULL")


def recipe_parts(keys: DataFrame, recipes: DataFrame) -> DataFrame:
    """Keys (key, compilation) titled by their recipe's parts, in order; `recipes`: compilation, purpose, pos, digest."""
    made = keys.join(recipes, "compilation")
    first = F.when(F.col("purpose") == "generation", "").otherwise("judge: ")
    return _list(made, F.col("key"), F.col("pos"), _digest("digest"), first, " · ")


def title_parts(
    edits: DataFrame, entries: DataFrame, forked: DataFrame, varied: DataFrame, described: DataFrame, recipes: DataFrame,
    compilations: DataFrame, cases: DataFrame,
) -> DataFrame:
    """What every thread's (`t:...`) and digest's (`d:...`) title is made of.

    `forked`: thread, origin; `varied`: thread, path, after; `described`: digest, description, of every digest there is;
    `recipes`: compilation, purpose, pos, digest; `compilations`: skeleton, compilation; `cases`: digest, root (its family's
    title), appendices. A digest's own title, when no thread names it, is `o:...`.
    """
    last = heads(edits).select("thread", "digest", "compilation")
    known = about(entries).select("thread", "name", "deleted")
    checkpoint_dir(edits.sparkSession)
    # A row a thread, which every kind of title asks for.
    state = last.join(known, "thread", "left").withColumn("deleted", F.coalesce("deleted", F.lit(False))).checkpoint()
    named = F.col("name").isNotNull()
    unnamed = state.where(~named)
    fork = unnamed.join(forked.select("thread", "origin"), "thread")
    plain = unnamed.join(forked.select("thread"), "thread", "left_anti")
    changed = varied.join(fork.select("thread"), "thread", "left_semi")
    same = fork.join(varied.select("thread").distinct(), "thread", "left_anti")
    compiled = plain.where("compilation IS NOT NULL").join(recipes.select("compilation").distinct(), "compilation", "left_semi")
    other = plain.join(compiled.select("thread"), "thread", "left_anti")
    threads = [
        _single(_thread("thread"), state.where(named), F.col("name")),
        _single(_thread("thread"), same, F.lit("a fork of ")),
        _single(_thread("thread"), fork, ref=_thread("origin")).withColumn("pos", F.lit(1)),
        change_parts(changed),
        recipe_parts(compiled.select(_thread("thread").alias("key"), "compilation"), recipes),
        _single(_thread("thread"), other, ref=_own("digest")),
    ]
    is_case = cases.select("digest")
    held = edits.select("digest", "thread").distinct().join(is_case, "digest", "left_anti").join(state.select("thread", F.col("digest").alias("head"), "name", "deleted"), "thread")
    is_head = F.col("digest") == F.col("head")
    rank = F.when(is_head & named, 0).when(is_head, 1).when(named, 2) + F.when(F.col("deleted"), 3).otherwise(0)
    label = F.when(is_head, F.col("name")).otherwise(F.concat("name", F.lit(" (earlier)")))
    best = held.withColumn("rank", rank).where("rank IS NOT NULL").groupBy("digest").agg(F.min_by(F.struct(label.alias("label"), F.col("thread").alias("by")), F.struct("rank", "thread")).alias("b"))
    others = described.select("digest").join(is_case, "digest", "left_anti").join(best, "digest", "left")
    title_of = F.when(F.col("b").isNull(), _own("digest")).when(F.col("b.label").isNull(), _thread(F.col("b.by")))
    first = compilations.join(recipes.select("compilation").distinct(), "compilation", "left_semi").groupBy(F.col("skeleton").alias("digest")).agg(F.min("compilation").alias("compilation"))
    listed = cases.select("digest", F.posexplode("appendices").alias("at", "appendix"))
    digests = [
        _single(_digest("digest"), others, F.col("b.label"), title_of),
        _single(_own("digest"), described.join(first, "digest", "left_anti"), F.col("description")),
        recipe_parts(first.select(_own("digest").alias("key"), "compilation"), recipes),
        _single(_digest("digest"), cases, F.col("root")),
        _list(listed, _digest("digest"), F.col("at"), _digest("appendix"), F.lit(" with "), ", "),
    ]
    return reduce(DataFrame.unionByName, [p.select("key", F.col("pos").cast("int").alias("pos"), "text", "ref") for p in (*threads, *digests)])
