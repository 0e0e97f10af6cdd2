"""References between components: closures, checks and collapses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from ..session import checkpoint_dir
from .findings import finding, message, union


def closure(roots: DataFrame, refs: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Every digest reached from the roots (column `digest`), each once.

    Semi-naive: a step follows only what the last one found, so references are filtered by the
    frontier before anything is made distinct. Each step's new digests are
    checkpointed to the shared folder, so plans don't grow with depth and a lost executor
    costs no earlier step. The number of steps is the depth of the graph.
    """
    checkpoint_dir(roots.sparkSession)
    edges = refs.select(F.col(src).alias("_src"), F.col(dst).alias("digest"))
    frontier = roots.select("digest").distinct().checkpoint()
    seen = frontier
    while not frontier.isEmpty():
        reached = (
            edges.join(frontier.select(F.col("digest").alias("_src")), "_src", "left_semi")
            .select("digest")
            .distinct()
        )
        frontier = reached.join(seen, "digest", "left_anti").checkpoint()
        seen = seen.unionByName(frontier)
    return seen


def paths(roots: DataFrame, refs: DataFrame, through: DataFrame, depth: int = 1) -> DataFrame:
    """(root, path, digest): what roots (root, path, digest) hold, and what that holds in turn.

    A reference is followed where it leads to one of `through` (digest), `depth` times; each keeps the path it was
    reached by, so a digest reached twice is there twice. The bound keeps the plan's size fixed.
    """
    edges = refs.select(F.col("src").alias("digest"), F.col("path").alias("_path"), F.col("dst").alias("_dst"))
    found = frontier = roots.select("root", "path", "digest")
    for _ in range(depth):
        onward = frontier.join(through.select("digest").distinct(), "digest", "left_semi").join(edges, "digest")
        frontier = onward.select("root", F.concat("path", "_path").alias("path"), F.col("_dst").alias("digest"))
        found = found.unionByName(frontier)
    return found


def rewrite(start: DataFrame, docs: DataFrame, refs: DataFrame) -> DataFrame:
    """(digest, new_digest, canonical): documents that change when those of `start` do, all the way up.

    `start` and `docs`: digest, canonical; `refs`: src, dst. A holder's document names the new digests in place of the
    old ones, which gives it a new digest, and so its holders. A step follows what the last one changed; a document
    changed by several steps is made anew from what all of them found. There are as many steps as the longest way
    up, each checkpointed.
    """
    checkpoint_dir(start.sparkSession)
    start, refs = start.select("digest", "canonical").checkpoint(), refs.select("src", "dst").distinct().checkpoint()
    base = start.unionByName(docs.select("digest", "canonical").join(start, "digest", "left_anti")).checkpoint()
    known = start.select("digest", hashing.digest(F.col("canonical")).alias("new_digest"), "canonical").checkpoint()
    frontier = known
    while not frontier.isEmpty():
        holders = refs.join(frontier.select(F.col("digest").alias("dst")), "dst", "left_semi").select("src").distinct()
        names = known.select(F.col("digest").alias("dst"), "new_digest")
        # A document's own references are all that is gathered for it.
        moved = refs.join(holders, "src", "left_semi").join(names, "dst").groupBy(F.col("src").alias("digest"))
        moved = moved.agg(F.collect_list(F.struct("dst", "new_digest")).alias("moved"))
        quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
        text = F.aggregate("moved", F.col("canonical"), lambda t, m: F.replace(t, quoted(m["dst"]), quoted(m["new_digest"])))
        made = base.join(moved, "digest").select("digest", text.alias("canonical")).withColumn("new_digest", hashing.digest(F.col("canonical")))
        before = known.select("digest", F.col("new_digest").alias("before"))
        frontier = made.join(before, "digest", "left").where(~F.col("new_digest").eqNullSafe(F.col("before"))).select("digest", "new_digest", "canonical").checkpoint()
        known = known.join(frontier, "digest", "left_anti").unionByName(frontier).checkpoint()
    return known


def dangling(refs: DataFrame, components: DataFrame) -> DataFrame:
    """References to digests no component has."""
    known = components.select(F.col("digest").alias("dst"))
    missing = refs.join(known, "dst", "left_anti")
    return finding(
        missing, "ref.missing", message(F.col("dst"), " is missing"), F.concat("src", "path"), level="error"
    )


def mistyped(refs: DataFrame, components: DataFrame) -> DataFrame:
    """References to a component of a kind their place doesn't allow (`kinds` is an array)."""
    kinds = components.select(F.col("digest").alias("dst"), "kind")
    wrong = refs.join(kinds, "dst").where(~F.array_contains("kinds", F.col("kind")))
    return finding(
        wrong,
        "ref.kind",
        message(F.col("kind"), " is not one of ", F.array_join("kinds", ", ")),
        F.concat("src", "path"),
        level="error",
    )


def broken(refs: DataFrame, components: DataFrame, own: DataFrame) -> DataFrame:
    """`dangling` and `mistyped` references of the components `own` (digest).

    What is referred to is looked up once for all references to it, and only references that are wrong are asked
    whose they are.
    """
    ends = refs.select("dst", "kinds").distinct()
    known = components.select(F.col("digest").alias("dst"), "kind", F.lit(False).alias("missing"))
    wrong = ends.join(known, "dst", "left").withColumn("missing", F.coalesce("missing", F.lit(True)))
    wrong = wrong.where(F.col("missing") | ~F.array_contains("kinds", F.col("kind")))
    wrong = wrong.select(F.col("dst").alias("_dst"), F.col("kinds").alias("_kinds"), "kind", "missing")
    met = refs.join(wrong, F.col("dst").eqNullSafe(F.col("_dst")) & F.col("kinds").eqNullSafe(F.col("_kinds")))
    met = met.select("src", "path", "dst", "missing", F.when(~F.col("missing"), message(F.col("kind"), " is not one of ", F.array_join("kinds", ", "))).alias("wrong"))
    found = met.join(own.select(F.col("digest").alias("src")), "src", "left_semi")
    text = F.when(F.col("missing"), message(F.col("dst"), " is missing")).otherwise(F.col("wrong"))
    return finding(found, F.when(F.col("missing"), "ref.missing").otherwise("ref.kind"), text, F.concat("src", "path"), level="error")


def compilations(refs: DataFrame, path: str = "/skeleton") -> DataFrame:
    """What refers to a component from a given place."""
    return refs.where(F.col("path") == path).select(F.col("dst").alias("skeleton"), F.col("src").alias("compilation"))


def land(facts: DataFrame, levels: list[str]) -> DataFrame:
    """Follow each model's collapsing levels to the one they land on.

    `facts` has (model, level, next) with `next` null where a level stands for itself. A
    model has one row per known level, so its levels fit one map and no join is needed; a
    level still collapsing after as many hops as there are levels goes round.
    """
    collapses = facts.groupBy("model").agg(
        F.map_from_entries(
            F.collect_list(F.when(F.col("next").isNotNull(), F.struct("level", "next")))
        ).alias("collapse"),
        F.collect_list("level").alias("known"),
    )
    exploded = collapses.select("model", "collapse", F.explode("known").alias("level"))
    landed = F.aggregate(
        F.sequence(F.lit(1), F.lit(len(levels))),
        F.col("level"),
        lambda at, _: F.coalesce(F.try_element_at(F.col("collapse"), at), at),
    )
    placed = exploded.withColumn("landed", landed)
    goes_round = F.try_element_at(F.col("collapse"), F.col("landed")).isNotNull()
    return placed.select(
        "model", "level", F.when(~goes_round, F.col("landed")).alias("landed"), goes_round.alias("goes_round")
    )


def appendix_elsewhere(cases: DataFrame, appendices: DataFrame) -> DataFrame:
    """Cases whose appendix is bound to another vignette; vignette is (source, source_id, hex)."""
    bound = appendices.select(
        F.col("digest").alias("appendix"), F.struct("source", "source_id", "hex").alias("bound")
    )
    wrong = cases.join(bound, "appendix").where(F.struct("source", "source_id", "hex") != F.col("bound"))
    return finding(
        wrong,
        "case.appendix",
        message("appendix ", F.col("appendix"), " is bound to another vignette"),
        F.col("digest"),
        level="error",
    )


def wrong_purpose(users: DataFrame, skeletons: DataFrame) -> DataFrame:
    """Trials on judge skeletons and judges on generation skeletons."""
    joined = users.join(skeletons.select(F.col("digest").alias("skeleton"), "purpose"), "skeleton")
    wanted = F.when(F.col("kind") == "trial", "generation").otherwise("judge")
    return finding(
        joined.where(F.col("purpose") != wanted),
        "skeleton.purpose",
        message(F.col("kind"), " uses a ", F.col("purpose"), " skeleton"),
        F.col("digest"),
        level="error",
    )


def doubled_tools(toolsets: DataFrame) -> DataFrame:
    """Toolsets (digest, name per row) naming a tool more than once."""
    doubled = toolsets.groupBy("digest", "name").agg(F.count("*").alias("n")).where("n > 1")
    return finding(
        doubled, "toolset.names", message("tools named more than once: ", F.col("name")), F.col("digest"), level="error"
    )


def cross_checks(*found: DataFrame) -> DataFrame:
    return union(*found)
