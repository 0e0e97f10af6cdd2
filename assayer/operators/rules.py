"""Rules over configuration tables: pins, templates, runtimes, facts, clearance, shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .findings import each, finding, message, union

# What counts as pinned, and what reads the date.
COMMIT = r"^[0-9a-f]{40}\z"
STORE_PATH = r"(?s)^/nix/store/[0-9a-z]{32}-.+\z"
READS_DATE = r"strftime_now|date_string|\bnow\s*\("
PINNED_VLLM = "0.24."


def lint_pins(models: DataFrame, engines: DataFrame, scorers: DataFrame) -> DataFrame:
    """Revisions and closures that can move: (digest, revision), (digest, closure), (digest, revision)."""
    closure, revision = F.col("closure"), F.col("revision")
    return union(
        finding(
            models.where(~revision.rlike(COMMIT)), "model.revision",
            message("revision '", revision, "' is not a commit and can move"), F.col("digest"),
        ),
        finding(
            engines.where(~closure.rlike(STORE_PATH)), "engine.closure",
            message("closure '", closure, "' is not a Nix store path"), F.col("digest"),
        ),
        finding(scorers.where(revision.isNull()), "scorer.revision", "scorer code has no revision", F.col("digest")),
    )


def lint_templates(engines: DataFrame) -> DataFrame:
    """Chat templates (digest, chat_template, template) that don't match or read the date."""
    return each(
        engines,
        [
            (F.sha2("template", 256) != F.col("chat_template"), "engine.chat_template", "chat template does not match the declared digest", "warning"),
            (F.col("template").rlike(READS_DATE), "engine.chat_template_date", "chat template reads the current date", "warning"),
        ],
        subject=F.col("digest"),
    )


def lint_pairs(pairs: DataFrame) -> DataFrame:
    """What an engine does to a skeleton's request, for every (skeleton, engine) a trial or judge pairs.

    One row per pair with the skeleton's `contract` (native, tool, text), `temperature`, `has_budget`,
    `has_tools` (the body offers any, the answer's own included), `has_toolset`, `tool_choice`,
    `enable_thinking`, `effort`, `schema_has_ref`, and the engine's `server`, `version`, `argv` and
    `by_default` (whether its model reasons unasked). All rules are columns of that one row.
    """
    flags = text.flag_names(F.col("argv"))
    has = lambda *names: F.arrays_overlap(F.col("flags"), F.array(*[F.lit(n) for n in names]))
    has_all = lambda *names: F.size(F.array_except(F.array(*[F.lit(n) for n in names]), F.col("flags"))) == 0
    rows = pairs.withColumn("flags", F.coalesce(flags, F.array().cast("array<string>")))
    known = F.coalesce((F.col("server") == "vllm") & F.col("version").startswith(PINNED_VLLM), F.lit(False))
    constrained = F.col("contract").isin("native", "tool")
    refused = F.col("has_tools") & ~has_all("--enable-auto-tool-choice", "--tool-call-parser")
    thinking, effort = F.col("enable_thinking"), F.col("effort")
    asked = (
        F.when((thinking == F.lit(False)) | (effort == "none"), F.lit(False))
        .when((thinking == F.lit(True)) | effort.isNotNull() | F.col("has_budget"), F.lit(True))
    )
    unasked = F.when(~has("--default-chat-template-kwargs"), F.col("by_default"))
    reasons = F.coalesce(asked, unasked)
    before_reasoning = constrained & ~refused & ~has("--reasoning-parser") & ~F.coalesce(reasons == F.lit(False), F.lit(False))
    t = F.col("temperature")
    return each(
        rows,
        [
            (
                ~known & constrained & F.col("schema_has_ref"), "schema.ref_unverified",
                "the schema has $ref, which this engine isn't known to resolve; inline_refs@1 removes them", "warning",
            ),
            (known & (t > 0) & (t < 0.01), "vllm.temperature_clamped", message("vLLM 0.24 raises temperature ", t, " to 0.01"), "warning"),
            (
                known & F.col("has_budget") & ~has("--reasoning-parser", "--reasoning-config"), "vllm.thinking_budget_refused",
                "vLLM 0.24 refuses thinking_token_budget without --reasoning-parser or --reasoning-config", "warning",
            ),
            (
                known & refused, "vllm.tools_refused",
                message(
                    "vLLM 0.24 refuses tool_choice ", F.col("tool_choice"), " without --enable-auto-tool-choice and "
                    "--tool-call-parser; for harmony and Mistral models it goes out unconstrained instead",
                ), "warning",
            ),
            (
                known & (F.col("contract") == "native") & F.col("has_toolset"), "vllm.native_tools_uncallable",
                "with tool_choice auto, vLLM 0.24 constrains the whole answer to response_format, so no tool can be called", "warning",
            ),
            (
                known & before_reasoning, "vllm.grammar_before_reasoning",
                "without --reasoning-parser, vLLM 0.24 constrains the answer from its first token, so a model can't reason first",
                F.when(F.coalesce(reasons, F.lit(False)), "warning").otherwise("info"),
            ),
        ],
        subject=F.col("subject"),
    )


def facts_checks(pairs: DataFrame, facts: DataFrame, levels: DataFrame) -> DataFrame:
    """Requests against what is known of their model.

    `pairs`: subject, model, effort, kwargs, has_budget, contract; `facts`: model, budget_refused,
    output_refused and output_note (maps by contract); `levels`: model, effort, kwargs, the settings
    its reasoning levels write. Settings match where any level writes them, null as null.
    """
    settings = levels.select("model", F.coalesce("effort", F.lit("")).alias("e"), F.coalesce("kwargs", F.lit("{}")).alias("k")).distinct()
    asked = pairs.withColumn("e", F.coalesce("effort", F.lit(""))).withColumn("k", F.coalesce("kwargs", F.lit("{}")))
    joined = (
        asked.join(facts.withColumn("known", F.lit(True)), "model", "left")
        .join(settings.withColumn("matched", F.lit(True)), ["model", "e", "k"], "left")
    )
    known = F.coalesce("known", F.lit(False))
    of_contract = lambda column: F.try_element_at(F.col(column), F.col("contract"))
    return each(
        joined,
        [
            (~known, "facts.missing", message("no facts about '", F.col("model"), "', so model-level checks were skipped"), "info"),
            (
                known & ((F.col("e") != "") | (F.col("k") != "{}")) & F.col("matched").isNull(), "facts.reasoning_unmatched",
                "the skeleton's reasoning settings match none of the model's reasoning levels", "warning",
            ),
            (known & F.col("has_budget") & F.col("budget_refused").isNotNull(), "facts.budget_refused", F.col("budget_refused"), "warning"),
            (known & of_contract("output_refused").isNotNull(), "facts.output_refused", of_contract("output_refused"), "warning"),
            (
                known & of_contract("output_refused").isNull() & of_contract("output_note").isNotNull(), "facts.output_note",
                of_contract("output_note"), "info",
            ),
        ],
        subject=F.col("subject"),
    )


def sampling_unmatched(pairs: DataFrame, recommended: DataFrame) -> DataFrame:
    """Sampling that other models' facts recommend and this model's don't: (subject, model, sampling).

    Who recommends a setting is gathered per setting, a set of model names, before it meets the
    pairs: the pairs that share a setting never meet each other.
    """
    by_setting = recommended.groupBy("sampling").agg(F.sort_array(F.collect_set("model")).alias("models"))
    copied = (
        pairs.where(F.col("sampling").isNotNull() & (F.col("sampling") != "{}"))
        .join(by_setting, "sampling")
        .where(~F.array_contains("models", F.col("model")))
    )
    return finding(
        copied, "facts.sampling_unmatched",
        message("the skeleton's sampling is what the facts recommend for ", F.array_join("models", ", "), ", not for ", F.col("model")),
        F.col("subject"),
    )


def _sorted(levels: DataFrame) -> DataFrame:
    """Rows per model and level, to be joined by sorting: the optimizer takes levels spread from a model's row for no larger than that row, and would gather them on the driver to broadcast them."""
    return levels.hint("merge")


def model_settings(landed: DataFrame, writes: DataFrame, recommended: DataFrame) -> DataFrame:
    """Per model and reasoning level, what it writes and samples, or why the model refuses it.

    `landed`: model, level, landed, goes_round; `writes`: model, level, effort, refused;
    `recommended`: model, level, sampling.
    """
    at = landed.join(_sorted(writes.withColumnRenamed("level", "landed").withColumn("has_fact", F.lit(True))), ["model", "landed"], "left")
    at = at.join(_sorted(recommended.withColumnRenamed("level", "landed")), ["model", "landed"], "left")
    refusal = (
        F.when(F.col("goes_round"), "the collapses go round")
        .when(F.col("has_fact").isNull(), message("nothing is known about reasoning '", F.col("landed"), "'"))
        .when(F.col("refused").isNotNull(), F.col("refused"))
        .when(F.col("sampling").isNull(), message("no sampling is recommended for reasoning '", F.col("landed"), "'"))
    )
    return at.select(
        "model", "level", refusal.alias("refused"),
        F.when(refusal.isNull(), F.col("effort")).alias("effort"),
        F.when(refusal.isNull(), F.col("sampling")).alias("sampling"),
    )


def default_settings(settings: DataFrame, defaults: DataFrame) -> DataFrame:
    """What each model does when no level is asked for: (model, level, refused, effort, sampling, reasons).

    `settings`: model, level, landed, refused_level (why the level it lands on is refused), effort, sampling, refused (why
    it can't be used as a whole); `defaults`: model, level (null where none is known). `reasons` is whether it reasons by
    default: unknown where the level is refused, else whether it lands on another level than off.
    """
    both = defaults.join(_sorted(settings), ["model", "level"], "left")
    unknown = F.col("level").isNull()
    refused = F.when(unknown, "no default reasoning level is known").otherwise(F.col("refused"))
    reasons = F.when(~unknown & F.col("refused_level").isNull(), F.col("landed") != "off")
    return both.select("model", "level", refused.alias("refused"), "effort", "sampling", reasons.alias("reasons"))


def resolved(landed: DataFrame, writes: DataFrame, recommended: DataFrame) -> DataFrame:
    """Settings with the level they land on and why that level alone is refused, for `default_settings`."""
    facts = writes.select("model", F.col("level").alias("landed"), F.lit(True).alias("has_fact"), F.col("refused").alias("no"))
    level = landed.join(_sorted(facts), ["model", "landed"], "left")
    why = (
        F.when(F.col("goes_round"), "the collapses go round")
        .when(F.col("has_fact").isNull(), message("nothing is known about reasoning '", F.col("landed"), "'"))
        .otherwise(F.col("no"))
    )
    return model_settings(landed, writes, recommended).join(_sorted(level.select("model", "level", "landed", why.alias("refused_level"))), ["model", "level"])


def clearance(runs: DataFrame, run_cases: DataFrame, sources: DataFrame, cleared: DataFrame) -> DataFrame:
    """Runs that would send sensitive sources where they aren't cleared to go.

    `runs`: run, endpoint, served_engine, engine, has_tools; `run_cases`: run, source;
    `sources`: source, sensitive; `cleared`: source, endpoint.
    """
    wrong_engine = runs.where(~F.col("served_engine").eqNullSafe(F.col("engine")))
    sensitive = (
        run_cases.select("run", "source").distinct().join(sources.where("sensitive").select("source"), "source").join(runs, "run")
    )
    uncleared = sensitive.join(cleared.select("source", "endpoint"), ["source", "endpoint"], "left_anti")
    return union(
        finding(
            wrong_engine, "gate.engine",
            message("endpoint '", F.col("endpoint"), "' serves engine ", F.col("served_engine"), ", the trial's is ", F.col("engine")),
            log_id=F.col("run"), level="error",
        ),
        finding(
            uncleared, "gate.uncleared", message("endpoint '", F.col("endpoint"), "' isn't cleared for source ", F.col("source"), ", which is sensitive"),
            F.col("source"), F.col("run"), "error",
        ),
        finding(
            sensitive.where("has_tools"), "gate.tools",
            message("the skeleton's tools would get content from source ", F.col("source"), ", which is sensitive, and tools can't be cleared yet"),
            F.col("source"), F.col("run"), "error",
        ),
    )


def shape(rows: DataFrame, document: str, json: str, fields: dict[str, tuple[str, bool]], allowed: dict[str, list[str]] | None = None) -> DataFrame:
    """Whether documents have a declared shape, one row per problem added to each row.

    `fields`: name to (VARIANT type name, required); unknown members are problems, and so are
    strings outside `allowed`.
    """
    doc = F.col(document)
    found = []
    for name, (kind, required) in fields.items():
        value = F.try_variant_get(doc, f"$.{name}", "variant")
        actual = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
        if required:
            found.append(F.when(value.isNull(), F.lit(f"{name} is required")))
        found.append(F.when(value.isNotNull() & (actual != kind), message(f"{name} is {kind} here, not ", actual)))
        if allowed and name in allowed:
            ok = value.try_cast("string").isin(*allowed[name])
            found.append(F.when((actual == "STRING") & ~ok, message(f"{name} may not be '", value.try_cast("string"), "'")))
    unknown = F.transform(
        F.array_except(F.json_object_keys(json), F.array(*[F.lit(n) for n in fields])), lambda k: F.concat(k, F.lit(" is not known"))
    )
    problems = F.concat(F.array_compact(F.array(*found)), F.coalesce(unknown, F.array(F.lit("not an object"))))
    return rows.withColumn("problem", F.explode(problems))


def redacted(row_type: str, rows: DataFrame, log_id: str, drop: list[str]) -> DataFrame:
    """A ledger row type as it may leave: (row_type, log_id, payload) without the columns named."""
    kept = [c for c in rows.columns if c not in drop]
    return rows.select(
        F.lit(row_type).alias("row_type"), F.col(log_id).cast("string").alias("log_id"), F.to_json(F.struct(*sorted(kept))).alias("payload")
    )


# The ledger's row types, and whether their rows derive from cases.
CASE_DERIVED = {
    "run_stage": False, "run_item": True, "canary_call": False, "score_stage": False, "score_item": True,
}


def redacted_export(tables: dict[str, tuple[DataFrame, str, list[str]]]) -> DataFrame:
    """Every row type that doesn't derive from cases, its case-derived columns left out."""
    parts = [redacted(name, rows, log_id, drop) for name, (rows, log_id, drop) in tables.items() if not CASE_DERIVED[name]]
    return union(*parts)
