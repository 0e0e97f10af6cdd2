"""Families of vignettes: how sources, bindings and cases agree.

A vignette is (source, source_id, hex); a family's current binding is its latest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from ..session import checkpoint_dir
from . import graph, windows
from .catalog import behind, latest
from .catalog import heads as catalog_heads
from .findings import finding, message

VIGNETTE = ["source", "source_id", "hex"]


def current(bindings: DataFrame) -> DataFrame:
    return latest(bindings, ["family"])


def survey(bindings: DataFrame, listing: DataFrame) -> DataFrame:
    """A listing of sources against the current bindings, one row per listed id and family gone.

    An id is unchanged or changed where a family is bound to it. Otherwise it is a rename
    where exactly one family has its content under an id that is no longer listed, else it is
    new; families accounted for by none of these are gone. Many copies of one content meet
    as counts, not as pairs.
    """
    now = current(bindings).select("family", *VIGNETTE)
    listed = listing.select("source", "source_id", F.col("hex").alias("listed_hex"))
    by_id = listed.join(
        now.groupBy("source", "source_id").agg(F.max_by(F.struct("family", "hex"), "family").alias("b")),
        ["source", "source_id"],
        "left",
    )
    known = by_id.where("b IS NOT NULL").select(
        "source",
        "source_id",
        F.col("b.family").alias("family"),
        F.when(F.col("b.hex") == F.col("listed_hex"), "unchanged").otherwise("changed").alias("status"),
    )
    # Candidates for a rename are families whose id isn't listed, counted per content.
    left = now.join(listed.select("source", "source_id"), ["source", "source_id"], "left_anti")
    candidates = left.groupBy("source", F.col("hex").alias("listed_hex")).agg(
        F.count("*").alias("n"), F.max("family").alias("family")
    )
    unknown = by_id.where("b IS NULL").select("source", "source_id", "listed_hex").join(
        candidates.where("n = 1"), ["source", "listed_hex"], "left"
    )
    fresh = unknown.select(
        "source", "source_id", "family", F.when(F.col("family").isNotNull(), "renamed").otherwise("new").alias("status")
    )
    found = known.unionByName(fresh)
    gone = now.join(found.where("family IS NOT NULL").select("family"), "family", "left_anti").select(
        "source", "source_id", "family", F.lit("gone").alias("status")
    )
    return found.unionByName(gone)


def family_of(cases: DataFrame, bindings: DataFrame) -> DataFrame:
    """Each case's family: that of the latest binding, current or not, to exactly its vignette."""
    bound = bindings.groupBy(*VIGNETTE).agg(F.max_by("family", "id").alias("family"))
    return cases.join(bound, VIGNETTE)


def holders(bindings: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted vignette (`key`, VIGNETTE, optionally `but`: a family to pass over), the
    first other family now holding its id or its content.

    Two equi-joins, one per condition. Each side is first reduced to the two lowest families per
    id or content: the lowest one that isn't `but` is among them, and copies don't multiply.
    """
    now = current(bindings).select("family", *VIGNETTE)

    def by(column: str) -> DataFrame:
        lowest = now.groupBy("source", column).agg(F.min("family").alias("first"))
        rest = now.join(lowest, ["source", column]).where("family > first")
        second = rest.groupBy("source", column).agg(F.min("family").alias("second"))
        return lowest.join(second, ["source", column], "left")

    def held(column: str) -> DataFrame:
        joined = wanted.join(by(column), ["source", column])
        other = F.when(~F.col("first").eqNullSafe(F.col("but")), F.col("first")).otherwise(F.col("second"))
        return joined.select("key", other.alias("family")).where("family IS NOT NULL")

    same_id = held("source_id").select("key", "family", F.lit(True).alias("same_id"))
    same_hex = held("hex").select("key", "family", F.lit(False).alias("same_id"))
    return (
        same_id.unionByName(same_hex)
        .groupBy("key", "family")
        .agg(F.bool_or("same_id").alias("same_id"))
        .groupBy("key")
        .agg(F.min(F.struct("family", "same_id")).alias("h"))
        .select("key", "h.family", "h.same_id")
    )


def case_canonical(source: str = "source", source_id: str = "source_id", hex_: str = "hex", appendices: str = "appendices"):
    """A case's canonical document; no appendices are left out, as any default is."""
    vignette = F.struct(
        F.struct(F.col(hex_).alias("hex")).alias("fingerprint"), F.col(source_id).alias("id"), F.col(source).alias("source")
    )
    listed = F.when(F.size(appendices) > 0, F.col(appendices))
    return F.to_json(F.struct(listed.alias("appendices"), F.lit("case").alias("kind"), F.lit(1).alias("v"), vignette.alias("vignette")))


def appendix_canonical(text: str = "text", source: str = "source", source_id: str = "source_id", hex_: str = "hex"):
    vignette = F.struct(
        F.struct(F.col(hex_).alias("hex")).alias("fingerprint"), F.col(source_id).alias("id"), F.col(source).alias("source")
    )
    return F.to_json(F.struct(F.lit("appendix").alias("kind"), F.col(text).alias("text"), F.lit(1).alias("v"), vignette.alias("vignette")))


def repair_plan(repairs: DataFrame, cases: DataFrame, appendices: DataFrame) -> DataFrame:
    """What moving families to new vignettes does to the cases bound to their old ones.

    `repairs`: family, VIGNETTE (old), new_source_id, new_hex; exactly one of id and content
    changes. `cases`: digest, VIGNETTE, appendices (array); `appendices`: digest, text. Every
    appendix is bound anew, every case is rebuilt on them, and both get their new digests.
    """
    moving = repairs.where(
        (F.col("source_id") != F.col("new_source_id")) != (F.col("hex") != F.col("new_hex"))
    )
    bound = cases.join(moving, VIGNETTE)
    rebound = (
        bound.select("digest", "source", "new_source_id", "new_hex", F.posexplode("appendices").alias("pos", "appendix"))
        .join(appendices.select(F.col("digest").alias("appendix"), "text"), "appendix")
        .withColumn("new_appendix", hashing.digest(appendix_canonical("text", "source", "new_source_id", "new_hex")))
        .groupBy("digest")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "new_appendix"))).alias("placed"))
        .select("digest", F.transform("placed", lambda p: p["new_appendix"]).alias("new_appendices"))
    )
    joined = bound.join(rebound, "digest", "left").withColumn(
        "new_appendices", F.coalesce("new_appendices", F.array().cast("array<string>"))
    )
    return joined.select(
        "family",
        "digest",
        "new_appendices",
        hashing.digest(case_canonical("source", "new_source_id", "new_hex", "new_appendices")).alias("new_digest"),
    )


def refused(repairs: DataFrame, bindings: DataFrame) -> DataFrame:
    """(family, reason): repairs that change both or neither of id and content, or want what another family has."""
    one = (F.col("source_id") != F.col("new_source_id")) != (F.col("hex") != F.col("new_hex"))
    wanted = repairs.where(one).select(
        F.col("family").alias("key"), "source", F.col("new_source_id").alias("source_id"), F.col("new_hex").alias("hex"), F.col("family").alias("but")
    )
    held = holders(bindings, wanted).join(wanted.select("key", "source_id"), "key")
    taken = F.when(F.col("same_id"), F.concat(F.lit("the id '"), "source_id", F.lit("'"))).otherwise("that content")
    return repairs.where(~one).select("family", F.lit("a repair changes exactly one of the id or the fingerprint").alias("reason")).unionByName(
        held.select(F.col("key").alias("family"), message("family ", held["family"], " already has ", taken).alias("reason"))
    )


def repairs_in_full(
    repairs: DataFrame, bindings: DataFrame, cases: DataFrame, appendices: DataFrame, expectations: DataFrame, heads: DataFrame
) -> DataFrame:
    """Everything that moving families to new vignettes does: (family, kind, digest, new_digest, thread, reason).

    `repairs`, `cases` as for `repair_plan`; `appendices`: digest, VIGNETTE, text; `expectations`: digest, case, canonical;
    `heads`: thread, digest. Refused families have a reason and no more. The appendices that bound cases hold, and
    those bound to the old vignette that head a thread, are bound anew; cases are rebuilt on them; on a rename the
    expectations of such cases that head a thread are keyed anew. Heads move to what became of them.
    """
    checkpoint_dir(repairs.sparkSession)
    no = refused(repairs, bindings).checkpoint()
    moving = repairs.join(no, "family", "left_anti").select("family", *VIGNETTE, "new_source_id", "new_hex")
    bound = cases.join(moving, VIGNETTE).checkpoint()
    held = bound.select("family", "source", "new_source_id", "new_hex", F.explode("appendices").alias("digest"))
    texts = appendices.select("digest", "text")
    heading = appendices.join(heads.select("digest"), "digest", "left_semi").join(moving, VIGNETTE)
    rebound = held.join(texts, "digest").unionByName(heading.select("family", "source", "new_source_id", "new_hex", "digest", "text")).dropDuplicates(["digest"])
    start = rebound.select("family", "digest", F.lit("appendix").alias("kind"), appendix_canonical("text", "source", "new_source_id", "new_hex").alias("canonical")).unionByName(
        bound.select("family", "digest", F.lit("case").alias("kind"), case_canonical("source", "new_source_id", "new_hex", "appendices").alias("canonical"))
    )
    renamed = bound.where(F.col("source_id") != F.col("new_source_id")).select("family", F.col("digest").alias("case"))
    keyed = expectations.join(heads.select("digest"), "digest", "left_semi").join(renamed, "case")
    start, keyed = start.checkpoint(), keyed.checkpoint()
    refs = bound.select(F.col("digest").alias("src"), F.explode("appendices").alias("dst")).unionByName(keyed.select(F.col("digest").alias("src"), F.col("case").alias("dst")))
    kinds = start.select("family", "digest", "kind").unionByName(keyed.select("family", "digest", F.lit("expectation").alias("kind")))
    made = graph.rewrite(start.select("digest", "canonical"), keyed.select("digest", "canonical"), refs).join(kinds, "digest")
    none = F.lit(None).cast("string")
    threads = heads.select(F.col("thread").cast("string").alias("thread"), "digest")
    bound_heads = made.where("kind = 'expectation'").unionByName(made.where("kind = 'appendix'").join(heading.select("digest"), "digest", "left_semi"))
    moves = bound_heads.join(threads, "digest").select("family", F.lit("move").alias("kind"), "digest", "new_digest", "thread", none.alias("reason"))
    rows = made.select("family", "kind", "digest", "new_digest", none.alias("thread"), none.alias("reason"))
    return rows.unionByName(moves).unionByName(no.select("family", F.lit("refused").alias("kind"), none.alias("digest"), none.alias("new_digest"), none.alias("thread"), "reason"))


def replaced(cases: DataFrame, appendices: DataFrame) -> DataFrame:
    """(digest, replacement): cases (digest, source, now_source_id, now_hex, appendices) as they are on another vignette."""
    held = cases.select("digest", "source", "now_source_id", "now_hex", F.posexplode("appendices").alias("pos", "appendix"))
    texts = appendices.select(F.col("digest").alias("appendix"), "text")
    made = hashing.digest(appendix_canonical("text", "source", "now_source_id", "now_hex"))
    placed = held.join(texts, "appendix").groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("pos", made.alias("new")))).alias("placed"))
    joined = cases.drop("appendices").join(placed.select("digest", F.transform("placed", lambda p: p["new"]).alias("appendices")), "digest", "left")
    joined = joined.withColumn("appendices", F.coalesce("appendices", F.array().cast("array<string>")))
    return joined.select("digest", hashing.digest(case_canonical("source", "now_source_id", "now_hex", "appendices")).alias("replacement"))


def stale_cases(refs: DataFrame, cases: DataFrame, bindings: DataFrame, deleted: DataFrame) -> DataFrame:
    """References (path, digest) to cases whose family has a newer vignette; deleted families are passed over."""
    now = current(bindings).select("family", *[F.col(c).alias(f"now_{c}") for c in VIGNETTE], F.col("id").alias("binding"))
    placed = family_of(cases, bindings).join(deleted, "family", "left_anti").join(now, "family")
    same = F.lit(True)
    for c in VIGNETTE:
        same = same & (F.col(c) == F.col(f"now_{c}"))
    return refs.join(placed.where(~same), "digest").select("path", "digest", "family", "binding", "now_source_id", "now_hex")


def behind_of(
    edits: DataFrame, entries: DataFrame, refs: DataFrame, recipes: DataFrame, cases: DataFrame, appendices: DataFrame,
    bindings: DataFrame, deleted: DataFrame,
) -> DataFrame:
    """What threads' heads hold that has moved on: (root, path, digest, thread, head, head_digest, binding, replacement).

    A head holds what its component refers to (`refs`: src, path, dst), what its recipe does (`recipes`: compilation, path,
    dst), and what the cases among these do. One row is for each thread that moved past a digest, and one for each
    case whose family, if not `deleted`, has a newer vignette: the binding and the case as it is on that.
    """
    last = catalog_heads(edits).select(F.col("thread").alias("root"), "digest", "compilation")
    own = last.join(refs.withColumnRenamed("src", "digest"), "digest").select("root", "path", F.col("dst").alias("digest"))
    made = last.where("compilation IS NOT NULL").join(recipes, "compilation").select("root", F.concat(F.lit("/recipe"), "path").alias("path"), F.col("dst").alias("digest"))
    held = graph.paths(own.unionByName(made), refs, cases)
    moved = behind(held.withColumnRenamed("root", "src"), edits, entries).withColumnRenamed("src", "root")
    # A case that is held in many places is looked up once.
    named = held.select("digest").distinct().withColumn("path", F.lit(""))
    stale = stale_cases(named, cases, bindings, deleted).select("digest", "binding", "now_source_id", "now_hex")
    anew = replaced(cases.select("digest", "source", "appendices").join(stale, "digest"), appendices)
    cases_behind = held.join(stale.select("digest", "binding").join(anew, "digest"), "digest")
    none = lambda kind: F.lit(None).cast(kind)
    return moved.select("root", "path", "digest", "thread", "head", "head_digest", none("bigint").alias("binding"), none("string").alias("replacement")).unionByName(
        cases_behind.select(
            "root", "path", "digest", none("bigint").alias("thread"), none("bigint").alias("head"), none("string").alias("head_digest"), "binding", "replacement"
        )
    )


def case_titles(cases: DataFrame, bindings: DataFrame, named: DataFrame) -> DataFrame:
    """A case's title: its family's name or current vignette, marked where the case is an earlier one."""
    now = current(bindings).select("family", *[F.col(c).alias(f"now_{c}") for c in VIGNETTE])
    placed = family_of(cases, bindings).select("digest", "family")
    joined = cases.join(placed, "digest", "left").join(now, "family", "left").join(named, "family", "left")
    root = F.coalesce("name", F.concat("now_source", F.lit("/"), "now_source_id"))
    same = F.lit(True)
    for c in VIGNETTE:
        same = same & (F.col(c) == F.col(f"now_{c}"))
    own = F.concat("source", F.lit("/"), "source_id")
    title = F.when(F.col("family").isNull(), own).when(same, root).otherwise(F.concat(root, F.lit(" (earlier)")))
    return joined.select("digest", title.alias("title"))


def binding_violations(bindings: DataFrame, width: int = 1 << 30) -> DataFrame:
    """Bindings that don't keep their family's source and either its id or its content."""
    before = windows.previous(bindings, ["family"], F.floor(F.col("id") / width), "id", VIGNETTE)
    kept = (F.col("source") == F.col("prev_source")) & (
        (F.col("source_id") == F.col("prev_source_id")) | (F.col("hex") == F.col("prev_hex"))
    )
    return finding(
        before.where(F.col("prev_id").isNotNull() & ~kept),
        "binding.jump",
        message("binding ", F.col("id"), " keeps neither the id nor the content of binding ", F.col("prev_id")),
        F.col("family"),
        level="error",
    )


def bound_to(documents: DataFrame, kind: str, vignettes: DataFrame) -> DataFrame:
    """Components of a kind bound to exactly one of the vignettes."""
    return documents.where(F.col("kind") == kind).join(vignettes, VIGNETTE, "left_semi")
