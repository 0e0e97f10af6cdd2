"""The catalogue: threads of edits, entries about them, and what follows from the latest rows.

Rows are append-only and ordered by id; the latest row for a key is the one with the
greatest id, whatever its time. `max_by` finds it with a partial aggregate before the
shuffle, so a thread with very many rows sends one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from . import windows
from .findings import each, finding, message


def latest(rows: DataFrame, keys: list[str], order: str = "id") -> DataFrame:
    """The latest row per key, with all its columns."""
    others = [c for c in rows.columns if c not in keys]
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*others), order).alias("_latest"))
        .select(*keys, *[F.col(f"_latest.{c}").alias(c) for c in others])
    )


def heads(edits: DataFrame) -> DataFrame:
    return latest(edits, ["thread"])


def about(entries: DataFrame, subject: str = "thread") -> DataFrame:
    """Each subject's current state from its entries.

    Single-valued fields are the latest entry's; tags and collaborators are the members whose
    latest toggle is present. A subject's set is bounded by the distinct members it has had.
    """
    # One row per (subject, field, member): the member is null for single-valued fields.
    member = F.when(F.col("field") == "tag", F.col("value")).when(
        F.col("field") == "collaborator", F.col("person").cast("string")
    )
    last = latest(entries.withColumn("member", member), [subject, "field", "member"])

    def single(field: str, column: str) -> Column:
        return F.max(F.when(F.col("field") == field, F.col(column)))

    def members(field: str, column: str) -> Column:
        kept = (F.col("field") == field) & F.col("present")
        return F.sort_array(F.collect_set(F.when(kept, F.col(column))))

    return last.groupBy(subject).agg(
        single("name", "value").alias("name"),
        single("description", "value").alias("description"),
        single("language", "value").alias("language"),
        single("owner", "person").alias("owner"),
        F.coalesce(F.bool_or(F.when(F.col("field") == "deleted", F.col("present"))), F.lit(False)).alias("deleted"),
        members("tag", "value").alias("tags"),
        members("collaborator", "person").alias("collaborators"),
    )


def with_about(threads: DataFrame, known: DataFrame, key: str = "thread") -> DataFrame:
    """Threads with their state; one without entries is unnamed and not deleted."""
    joined = threads.join(known.withColumnRenamed("thread", key) if key != "thread" else known, key, "left")
    return joined.withColumn("deleted", F.coalesce("deleted", F.lit(False)))


def live_heads(edits: DataFrame, entries: DataFrame, kind: str, deleted: bool = False) -> DataFrame:
    # The entries of the kind's threads are all that is folded.
    found = heads(edits.where(F.col("kind") == kind))
    known = about(entries.join(found.select("thread"), "thread", "left_semi"))
    return with_about(found, known).where(F.col("deleted") == deleted)


def find(threads: DataFrame, entries: DataFrame, kind: str, name: str, owner: int | None = None) -> DataFrame:
    """Threads of a kind that are named so now, not deleted, and owned by someone if asked."""
    of_kind = threads.where(F.col("kind") == kind).select(F.col("id").alias("thread"))
    known = about(entries.join(of_kind, "thread", "left_semi"))
    found = known.where((F.col("name") == name) & ~F.col("deleted"))
    return found if owner is None else found.where(F.col("owner") == owner)


def history(edits: DataFrame, width: int = 1 << 20) -> DataFrame:
    """Every thread's edits numbered in order."""
    return windows.numbered(edits, ["thread"], F.floor(F.col("id") / width), ["id"], "position")


def forks(threads: DataFrame, edits: DataFrame) -> DataFrame:
    """Threads forked from another, with that thread."""
    origin = edits.select(F.col("id").alias("forked_from"), F.col("thread").alias("origin"))
    return threads.where("forked_from IS NOT NULL").join(origin, "forked_from").select("origin", F.col("id").alias("fork"))


def heads_holding(edits: DataFrame, digests: DataFrame) -> DataFrame:
    """Threads whose head holds one of the digests; an earlier edit doesn't count."""
    touched = edits.join(edits.join(digests, "digest", "left_semi").select("thread").distinct(), "thread", "left_semi")
    return heads(touched).join(digests, "digest", "left_semi")


def subjects_naming(entries: DataFrame, person: int | Column) -> DataFrame:
    return entries.where(F.col("person") == person).select("thread").distinct()


def behind(refs: DataFrame, edits: DataFrame, entries: DataFrame) -> DataFrame:
    """References whose thread has moved on: the digest is in a live thread, but not its head.

    `refs`: src, path, digest. A digest held by many edits of one thread is one candidate.
    """
    held = edits.select("digest", "thread").distinct()
    moved = (
        heads(edits)
        .select("thread", F.col("id").alias("head"), F.col("digest").alias("head_digest"))
        .join(about(entries).where("deleted").select("thread"), "thread", "left_anti")
    )
    stale = held.join(moved, "thread").where("digest <> head_digest")
    return refs.join(stale, "digest").select("src", "path", "digest", "thread", "head", "head_digest")


# ------------------------------------------------------------------------ forks and bases


def bases(threads: DataFrame, edits: DataFrame) -> DataFrame:
    """Each fork with its base edit (the latest `based_on`, else where it forked), its head and
    the origin's head."""
    based = edits.where("based_on IS NOT NULL").groupBy("thread").agg(F.max_by("based_on", "id").alias("based_on"))
    last = heads(edits)
    made = ["compilation"] if "compilation" in edits.columns else []

    def named(side: str) -> list[Column]:
        return [F.col(c).alias(f"{side}_{c}") for c in ("digest", *made)]

    own = last.select("thread", F.col("id").alias("fork_head"), *named("fork"))
    origin = last.select(F.col("thread").alias("origin"), F.col("id").alias("origin_head"), *named("origin"))
    at = edits.select(F.col("id").alias("base"), F.col("thread").alias("origin"), *named("base"))
    return (
        threads.where("forked_from IS NOT NULL")
        .select(F.col("id").alias("thread"), "forked_from")
        .join(based, "thread", "left")
        .withColumn("base", F.coalesce("based_on", "forked_from"))
        .join(at, "base")
        .join(own, "thread")
        .join(origin, "origin")
        .withColumn("moved", F.col("origin_head") != F.col("base"))
    )


def variation(forked: DataFrame, fields: DataFrame) -> DataFrame:
    """The fields a fork changes from its base: (path, before, after), null where absent.

    `fields` has one row per top-level field of a digest's document: digest, path, value.
    """
    before = forked.select("thread", F.col("base_digest").alias("digest")).join(fields, "digest").select("thread", "path", F.col("value").alias("before"))
    after = forked.select("thread", F.col("fork_digest").alias("digest")).join(fields, "digest").select("thread", "path", F.col("value").alias("after"))
    return before.join(after, ["thread", "path"], "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))


def proposal(forked: DataFrame, varied: DataFrame, fields: DataFrame) -> DataFrame:
    """Where the origin moved: its head's fields with the fork's changes on top.

    A field the fork removed goes; one it added or changed takes the fork's value.
    """
    moved = forked.where("moved")
    head = moved.select("thread", F.col("origin_digest").alias("digest")).join(fields, "digest").select("thread", "path", F.col("value").alias("head"))
    changes = varied.join(moved.select("thread"), "thread", "left_semi").withColumn("changed", F.lit(True))
    merged = head.join(changes, ["thread", "path"], "full_outer")
    value = F.when(F.col("changed"), F.col("after")).otherwise(F.col("head"))
    return merged.select("thread", "path", value.alias("value")).where("value IS NOT NULL")


def recipe_fields(recipes: DataFrame) -> DataFrame:
    """(compilation, path, value): what recipes (compilation, recipe as JSON) hold, each field's value as JSON, nulls too."""
    parsed = recipes.select("compilation", F.parse_json("recipe").alias("v"))
    fields = parsed.lateralJoin(parsed.sparkSession.tvf.variant_explode(F.col("v").outer()))
    return fields.select("compilation", F.concat(F.lit("/recipe/"), "key").alias("path"), F.to_json("value").alias("value"))


def by_recipe() -> Column:
    """Whether a fork is compared to its base by their recipes: both must be compiled."""
    return F.col("base_compilation").isNotNull() & F.col("fork_compilation").isNotNull()


def _shape(forked: DataFrame, side: str, fields: DataFrame, recipes: DataFrame) -> DataFrame:
    made = forked.where(by_recipe()).select("thread", F.col(f"{side}_compilation").alias("compilation")).join(recipes, "compilation")
    plain = forked.where(~by_recipe()).select("thread", F.col(f"{side}_digest").alias("digest")).join(fields, "digest")
    return made.select("thread", "path", "value").unionByName(plain.select("thread", "path", "value"))


def variation_in_shape(forked: DataFrame, fields: DataFrame, recipes: DataFrame) -> DataFrame:
    """As `variation`, by recipe where fork and base are compiled (`recipes`: recipe_fields), else by the documents' fields."""
    before, after = (_shape(forked, side, fields, recipes).withColumnRenamed("value", name) for side, name in (("base", "before"), ("fork", "after")))
    return before.join(after, ["thread", "path"], "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))


def proposal_in_shape(forked: DataFrame, varied: DataFrame, fields: DataFrame, recipes: DataFrame) -> DataFrame:
    """As `proposal`, the fork's changes merged into the origin's recipe or document: (thread, path, value).

    In a recipe a field that the fork took out is null; in a document it goes. There is no proposal where the fork has
    a recipe and the origin's head has none.
    """
    moved = forked.where("moved").where(~by_recipe() | F.col("origin_compilation").isNotNull())
    head = _shape(moved, "origin", fields, recipes).withColumnRenamed("value", "head")
    changes = varied.join(moved.select("thread", by_recipe().alias("made")), "thread")
    merged = head.join(changes, ["thread", "path"], "full_outer")
    value = F.when(F.col("made"), F.coalesce("after", F.lit("null"))).when(F.col("made").isNotNull(), F.col("after")).otherwise(F.col("head"))
    return merged.select("thread", "path", value.alias("value")).where("value IS NOT NULL")


def based_on_violations(threads: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits based on something that isn't in their origin at or after the fork point."""
    points = threads.select(F.col("id").alias("thread"), F.col("forked_from").alias("point"))
    at = edits.select(F.col("id").alias("point"), F.col("thread").alias("origin"))
    target = edits.select(F.col("id").alias("based_on"), F.col("thread").alias("based_thread"))
    checked = (
        edits.where("based_on IS NOT NULL")
        .join(points, "thread")
        .join(at, "point", "left")
        .join(target, "based_on", "left")
    )
    good = F.coalesce(
        (F.col("based_thread") == F.col("origin")) & (F.col("based_on") >= F.col("point")), F.lit(False)
    )
    return finding(
        checked.where(~good),
        "edit.based_on",
        message("edit ", F.col("based_on"), " is not in the origin of thread ", F.col("thread")),
        F.col("id"),
        level="error",
    )


# -------------------------------------------------------------------------------- naming


def display_names(edits: DataFrame, entries: DataFrame, described: DataFrame) -> DataFrame:
    """What to call each digest (`described`: digest, description).

    By precedence: the name of a live thread whose head it is; a live thread it heads though
    unnamed, by its description; the name of a live thread it was in earlier; the same among
    deleted threads; its own description. Among several threads the first wins.
    """
    last = heads(edits).select("thread", F.col("digest").alias("head_digest"))
    known = about(entries).select("thread", "name", "deleted")
    held = (
        edits.select("digest", "thread")
        .distinct()
        .join(last, "thread")
        .join(known, "thread", "left")
        .withColumn("deleted", F.coalesce("deleted", F.lit(False)))
    )
    is_head = F.col("digest") == F.col("head_digest")
    rank = (
        F.when(is_head & F.col("name").isNotNull(), 0).when(is_head, 1).when(F.col("name").isNotNull(), 2)
    ) + F.when(F.col("deleted"), 3).otherwise(0)
    label = F.when(is_head, F.col("name")).otherwise(F.concat("name", F.lit(" (earlier)")))
    best = (
        held.withColumn("rank", rank)
        .where("rank IS NOT NULL")
        .groupBy("digest")
        .agg(F.min_by(F.struct(label.alias("label")), F.struct("rank", "thread")).alias("best"))
        .select("digest", F.col("best.label").alias("label"))
    )
    return described.join(best, "digest", "left").select("digest", F.coalesce("label", "description").alias("title"))


def head_recipes(edits: DataFrame, compilations: DataFrame) -> DataFrame:
    """The recipe of each thread's head, through its compilation (`compilation`, `recipe`)."""
    compiled = heads(edits).where("compilation IS NOT NULL")
    return compiled.join(compilations, "compilation").select("thread", F.col("id").alias("head"), "recipe")


# ----------------------------------------------------------------------------- languages


def language_vote(parts: DataFrame, compilations: DataFrame, languages: DataFrame) -> DataFrame:
    """A compiled skeleton's language: the one its recipes agree on, or none.

    A recipe has one where all its text parts do and it's known; the vote is over the recipes
    that have one. `parts`: recipe, digest; `compilations`: skeleton, recipe;
    `languages`: id, digest, value.
    """
    own = latest(languages, ["digest"]).select("digest", F.col("value").alias("language"))
    per_recipe = (
        parts.join(own, "digest", "left")
        .groupBy("recipe")
        .agg(
            F.when(
                (F.count_if(F.col("language").isNull()) == 0) & (F.min("language") == F.max("language")), F.max("language")
            ).alias("language")
        )
    )
    votes = compilations.join(per_recipe, "recipe", "left").groupBy("skeleton")
    return votes.agg(F.when(F.min("language") == F.max("language"), F.max("language")).alias("language"))


def recipe_languages(recipes: DataFrame, parts: DataFrame, languages: DataFrame) -> DataFrame:
    """(recipe, language): that of its translations where it has some, else the one all its text parts have.

    `recipes`: recipe, translations (a digest or null); `parts`: recipe, digest (null for a part it lacks); `languages`:
    id, digest, value.
    """
    own = latest(languages, ["digest"]).select("digest", F.col("value").alias("language"))
    agreed = (
        parts.join(own, "digest", "left")
        .groupBy("recipe")
        .agg(F.when((F.count_if(F.col("language").isNull()) == 0) & (F.min("language") == F.max("language")), F.max("language")).alias("agreed"))
    )
    into = own.select(F.col("digest").alias("translations"), F.col("language").alias("into"))
    found = recipes.join(into, "translations", "left").join(agreed, "recipe", "left")
    return found.select("recipe", F.when(F.col("translations").isNotNull(), F.col("into")).otherwise(F.col("agreed")).alias("language"))


def languages_of(components: DataFrame, compilations: DataFrame, by_recipe: DataFrame, languages: DataFrame, families: DataFrame) -> DataFrame:
    """(digest, language) of components (digest, kind, of): `of` is what an expectation, trial or judge takes its language from.

    A case has its family's (`families`: digest, language); a compiled skeleton (`compilations`: skeleton, recipe) the one
    its recipes with a language agree on, an uncompiled one its own; expectations, trials and judges that of their case
    or skeleton; others their own.
    """
    own = latest(languages, ["digest"]).select("digest", F.col("value").alias("own"))
    votes = compilations.join(by_recipe, "recipe", "left").groupBy(F.col("skeleton").alias("digest"))
    votes = votes.agg(F.when(F.min("language") == F.max("language"), F.max("language")).alias("vote"), F.lit(True).alias("compiled"))
    case = families.select("digest", F.col("language").alias("family"))
    direct = components.join(own, "digest", "left").join(votes, "digest", "left").join(case, "digest", "left")
    kind = F.col("kind")
    language = F.when(kind == "case", F.col("family")).when((kind == "skeleton") & F.col("compiled"), F.col("vote")).otherwise(F.col("own"))
    told = direct.select("digest", kind, "of", language.alias("language"))
    taken = told.where(kind.isin("expectation", "trial", "judge")).select("digest", "of")
    through = taken.join(told.select(F.col("digest").alias("of"), "language"), "of", "left").select("digest", "language")
    return told.where(~kind.isin("expectation", "trial", "judge")).select("digest", "language").unionByName(through)


def language_mixed(trials: DataFrame, cases: DataFrame) -> DataFrame:
    """Trials (trial, language) whose cases (trial, language) speak another or an unknown language."""
    counted = (
        cases.groupBy("trial", F.col("language").alias("case_language"))
        .agg(F.count("*").alias("n"))
        .join(trials, "trial")
    )
    other = F.col("case_language") != F.col("language")
    per_trial = counted.groupBy("trial", "language").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("case_language").isNull(), F.col("n")).otherwise(0)).alias("unknown"),
        F.sum(F.when(other, F.col("n")).otherwise(0)).alias("other"),
        F.array_join(F.sort_array(F.collect_set(F.when(other, F.col("case_language")))), ", ").alias("others"),
    )
    has = F.col("language").isNotNull()
    return each(
        per_trial,
        [
            (~has, "language.unknown", "the request's language is unknown", "info"),
            (
                has & (F.col("unknown") > 0), "language.unknown",
                message("the language of ", F.col("unknown"), " of ", F.col("n"), " cases is unknown"), "info",
            ),
            (
                has & (F.col("other") > 0), "language.mixed",
                message(
                    "the request is ", F.col("language"), ", but ", F.col("other"), " of ", F.col("n"), " cases ",
                    F.when(F.col("other") == 1, "is").otherwise("are"), " ", F.col("others"),
                ),
                "warning",
            ),
        ],
        subject=F.col("trial"),
    )


# --------------------------------------------------------------------------------- plans


def owner_sweep(entries: DataFrame, person: int) -> DataFrame:
    """The entries that delete what a person owns and unshare what they share, where that changes
    anything: (thread, field, person, present)."""
    naming = entries.join(subjects_naming(entries, person), "thread", "left_semi")
    known = about(naming)
    steps = F.array_compact(
        F.array(
            F.when(
                (F.col("owner") == person) & ~F.col("deleted"),
                F.struct(F.lit("deleted").alias("field"), F.lit(None).cast("bigint").alias("person"), F.lit(True).alias("present")),
            ),
            F.when(
                F.array_contains("collaborators", F.lit(person).cast("bigint")),
                F.struct(F.lit("collaborator").alias("field"), F.lit(person).cast("bigint").alias("person"), F.lit(False).alias("present")),
            ),
        )
    )
    return known.select("thread", F.inline(steps))


def sync_plan(records: DataFrame, edits: DataFrame) -> DataFrame:
    """What putting each record (thread, digest) does: created, validated or updated."""
    last = heads(edits).select("thread", F.col("digest").alias("head_digest"))
    status = (
        F.when(F.col("head_digest").isNull(), "created")
        .when(F.col("head_digest") == F.col("digest"), "validated")
        .otherwise("updated")
    )
    return records.join(last, "thread", "left").select("thread", "digest", status.alias("status"))


def share_plan(threads: DataFrame, entries: DataFrame, person: int) -> DataFrame:
    """Threads not yet shared with a person."""
    known = about(entries).select("thread", "collaborators")
    shared = F.coalesce(F.array_contains("collaborators", F.lit(person).cast("bigint")), F.lit(False))
    return threads.select(F.col("id").alias("thread")).join(known, "thread", "left").where(~shared).select("thread")


def gift_plan(threads: DataFrame, edits: DataFrame, entries: DataFrame, person: int) -> DataFrame:
    """Per source thread, what a person's own fork of it needs: kept, restored or forked.

    A live fork is kept; else the newest deleted one comes back; else a new one is made.
    """
    owned = about(entries).where(F.col("owner") == person).select(F.col("thread").alias("fork"), "deleted")
    mine = (
        forks(threads, edits)
        .join(owned, "fork")
        .groupBy("origin")
        .agg(F.bool_or(~F.col("deleted")).alias("live"), F.max("fork").alias("newest"))
    )
    action = F.when(F.col("live"), "kept").when(F.col("newest").isNotNull(), "restored").otherwise("forked")
    return (
        threads.select(F.col("id").alias("origin"))
        .join(mine, "origin", "left")
        .select("origin", action.alias("action"), F.when(action == "restored", F.col("newest")).alias("fork"))
    )


# --------------------------------------------------------------------------------- rules

# Fixed value.
LANGUAGE = r"^[a-z]{2,3}(-[A-Za-z0-9]{1,8})*\z"
# Fixed value.
TEXT_FIELDS = ["description", "tag", "language"]
PERSON_FIELDS = ["owner", "collaborator"]
REMOVABLE_FIELDS = ["name", "tag", "collaborator", "deleted"]


def entry_shape(entries: DataFrame) -> DataFrame:
    """Entries whose value, person or presence doesn't go with their field."""
    field, present = F.col("field"), F.col("present")
    wants_text = field.isin(*TEXT_FIELDS) | ((field == "name") & present)
    wants_person = field.isin(*PERSON_FIELDS)
    return each(
        entries,
        [
            (
                (F.col("value").isNotNull() != wants_text) | (F.col("person").isNotNull() != wants_person),
                "entry.shape", message("wrong value or person for ", field), "error",
            ),
            (
                ~(present | field.isin(*REMOVABLE_FIELDS)), "entry.removed",
                message(field, " can't be removed, only replaced"), "error",
            ),
            (field.isin("name", "tag") & (F.col("value") == ""), "entry.empty", message(field, " can't be empty"), "error"),
            (
                (field == "language") & ~F.col("value").rlike(LANGUAGE), "entry.language",
                message("'", F.col("value"), "' is not a language tag such as 'sv' or 'pt-BR'"), "error",
            ),
        ],
        subject=F.col("id"),
    )


def label_positions(labels: DataFrame, scorers: DataFrame) -> DataFrame:
    """Labels for a part a scorer doesn't have (`scorers`: scorer, n_views, n_resources)."""
    size = F.when(F.col("part") == "view", F.col("n_views")).otherwise(F.col("n_resources"))
    wrong = labels.join(scorers, "scorer").where(~F.col("position").between(0, size - 1))
    return finding(
        wrong, "label.position", message("no ", F.col("part"), " at position ", F.col("position")), F.col("scorer"), level="error"
    )


# Fixed value.
LANGUAGE_KINDS = [
    "chunk.instructions", "chunk.few_shot", "chunk.prompt", "chunk.output", "chunk.toolset",
    "chunk.translations", "skeleton",
]


def language_rules(languages: DataFrame, components: DataFrame, compilations: DataFrame) -> DataFrame:
    """Languages given to what has none of its own: other kinds, and compiled skeletons."""
    compiled = compilations.select(F.col("skeleton").alias("digest")).distinct().withColumn("compiled", F.lit(True))
    rows = languages.join(components.select("digest", "kind"), "digest", "left").join(compiled, "digest", "left")
    kind = F.col("kind")
    return each(
        rows,
        [
            (kind.isNull(), "language.subject", "not in the store", "error"),
            (~kind.isin(*LANGUAGE_KINDS), "language.kind", message(kind, " components have no language of their own"), "error"),
            (
                (kind == "skeleton") & F.col("compiled").isNotNull(), "language.compiled",
                "a compiled skeleton's language comes from its recipe", "error",
            ),
            (~F.col("value").rlike(LANGUAGE), "language.tag", message("'", strip(F.col("value")), "' is not a language tag"), "error"),
        ],
        subject=F.col("digest"),
    )
