"""Scoring answers against targets: metrics, views and summaries."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import ENGINE_VERSION
from ..functions import aggregates, jsontext, patterns, responses, selectors, tape, text


def scored(value: Column | None, answer: Column | None = None, reason: str | Column | None = None) -> Column:
    """A view's score, what in the answer it rests on, and why it is what it is."""
    reason = F.lit(reason) if reason is None or isinstance(reason, str) else reason
    return F.struct(
        (F.lit(None) if value is None else value).cast("double").alias("value"),
        (F.lit(None) if answer is None else answer).cast("string").alias("answer"),
        reason.cast("string").alias("reason"),
    )


@dataclass(frozen=True)
class Expected:
    """A target as columns: its compiled pattern, whether nothing is expected, and any reason
    it cannot be scored against."""

    compiled: Column
    nothing: Column
    reason: Column


def first_rank(items: Column, expected: Expected) -> Column:
    """The rank of the first item the pattern is in, 0 for none."""
    return F.coalesce(F.array_position(patterns.hits(items, expected.compiled), True), F.lit(0))


def reciprocal_rank(items: Column, expected: Expected) -> Column:
    """1/rank of the first item the pattern is in."""

    def ranked(hits: Column) -> Column:
        at = F.array_position(hits, True)
        return F.when(at == 0, scored(F.lit(0.0), reason="not listed")).otherwise(
            scored(
                F.lit(1.0) / at,
                F.concat(at.cast("string"), F.lit(". "), F.get(items, at.cast("int") - 1)),
            )
        )

    hits = patterns.hits(items, expected.compiled)
    return (
        F.when(expected.nothing, scored(None, reason="nothing is expected to be found"))
        .when(items.isNull(), scored(F.lit(0.0), reason="no answer"))
        .otherwise(text.let(hits, ranked))
    )


def first_mention(items: Column, expected: Expected) -> Column:
    """The code-point offset of the first mention in its item, the target held to one unit."""

    def in_item(item: Column) -> Column:
        words = F.transform(
            text.words_lines(text.unit_texts(item)), lambda line: patterns.find_word(line, expected.compiled)
        )
        return text.let(
            words,
            lambda w: text.let(
                F.array_position(F.transform(w, lambda at: at != patterns.NOWHERE), True).cast("int"),
                lambda nth: F.struct(item.alias("item"), nth.alias("nth"), F.get(w, nth - 1).alias("word")),
            ),
        )

    found = F.filter(F.transform(items, in_item), lambda f: f["nth"] > 0)

    def first(hits: Column) -> Column:
        hit = F.get(hits, F.lit(0))
        unit = F.get(text.unit_texts(hit["item"]), hit["nth"] - 1)
        value = text.unit_start(hit["item"], hit["nth"] - 1) + text.word_offset(unit, hit["word"])
        return F.when(F.size(hits) == 0, scored(None, reason="never named")).otherwise(
            scored(value, text.strip(unit))
        )

    return (
        F.when(expected.nothing, scored(None, reason="nothing is expected to be found"))
        .when(items.isNull(), scored(None, reason="no answer"))
        .otherwise(text.let(found, first))
    )


def mentions(items: Column, expected: Expected) -> Column:
    """1 when the pattern is in any item; with nothing expected, 1 when there is no item."""
    at = F.array_position(patterns.hits(items, expected.compiled), True).cast("int")
    return (
        F.when(items.isNull(), scored(F.lit(0.0), reason="no answer"))
        .when(
            expected.nothing & (F.size(items) > 0),
            scored(F.lit(0.0), F.get(items, F.lit(0)), "none expected"),
        )
        .when(expected.nothing, scored(F.lit(1.0), reason="none named, as expected"))
        .otherwise(
            text.let(
                at,
                lambda n: F.when(n == 0, scored(F.lit(0.0), reason="not named")).otherwise(
                    scored(F.lit(1.0), F.get(items, n - 1))
                ),
            )
        )
    )


Metric = Callable[[Column, Expected], Column]
METRICS: dict[str, Metric] = {
    "reciprocal_rank": reciprocal_rank,
    "first_mention": first_mention,
    "mentions": mentions,
}


# A metric whose results change gets another version; the name stays.
METRIC_VERSIONS = {"reciprocal_rank": "1", "first_mention": "1", "mentions": "1"}


# Metrics of others: an Arrow UDF each, registered while a session runs.
REGISTERED: dict[str, Callable[..., Column]] = {}
RESULT = "struct<value:double,answer:string,reason:string>"


def register_metric(name: str, function: Callable[..., Column], version: str) -> None:
    """Make a metric known under a name: a pandas or Arrow UDF of (items, pattern, nothing).

    It gets batches of the items a view picked (a list of strings, null where the run has no answer), the target's
    pattern and whether nothing is expected, and its result must be the struct RESULT. Where there is no target it
    gets nulls and isn't asked. A name can be registered again only with another version.
    """
    kind = getattr(function, "returnType", None)
    if kind is None or getattr(kind, "simpleString", lambda: kind)() != RESULT:
        raise ValueError(f"metric {name!r} must be a UDF that returns {RESULT}")
    if name in METRICS or METRIC_VERSIONS.get(name) == version:
        raise ValueError(f"metric {name!r} of version {METRIC_VERSIONS[name]} is there already")
    REGISTERED[name], METRIC_VERSIONS[name] = function, version


def stamped(scores: DataFrame, metric: str = "metric") -> DataFrame:
    """Scores with the versions of what computed them, so that results can be told apart later."""
    versions = F.create_map(*[F.lit(x) for kv in sorted(METRIC_VERSIONS.items()) for x in kv])
    return scores.withColumns(
        {"engine_version": F.lit(ENGINE_VERSION), "metric_version": F.try_element_at(versions, F.col(metric))}
    )


def target_parts(picked: Column) -> Column:
    """Decode what an expectation selector picked: a pattern, `false`, or why it can't be scored.

    `picked` is array<variant>; the result is struct<pattern, nothing, reason>.
    """
    one = F.get(picked, F.lit(0))
    kind = F.schema_of_variant(one)
    as_object = one.try_cast("map<string,variant>")
    member = lambda name: F.when(
        F.schema_of_variant(F.element_at(as_object, name)) == "STRING",
        F.element_at(as_object, name).try_cast("string"),
    )

    def part(pattern, nothing, reason):
        return F.struct(
            F.lit(pattern).cast("string").alias("pattern"),
            F.lit(nothing).alias("nothing"),
            F.lit(reason).cast("string").alias("reason"),
        )

    return (
        F.when(picked.isNull() | (F.size(picked) == 0), part(None, False, "no target"))
        .when(
            F.size(picked) > 1,
            part(None, False, F.concat(F.size(picked).cast("string"), F.lit(" targets, not one"))),
        )
        .when((kind == "BOOLEAN") & ~F.coalesce(one.try_cast("boolean"), F.lit(True)), part(None, True, None))
        .when(kind == "STRING", part(one.try_cast("string"), False, None))
        .when(member("pattern").isNotNull(), part(member("pattern"), False, None))
        .when(
            member("text").isNotNull(),
            part(None, False, "the target has words, for a judge, but no pattern"),
        )
        .otherwise(part(None, False, "the target has no pattern"))
    )


def decode_targets(targets: DataFrame, picked: str, into: str = "target") -> DataFrame:
    """Targets decoded and their patterns compiled; an unreadable pattern is a reason."""
    parts = targets.withColumn(into, target_parts(F.col(picked)))
    compiled = parts.withColumn("_c", patterns.compile_pattern(F.col(f"{into}.pattern")))
    return compiled.withColumn(
        into,
        F.struct(
            F.col(f"{into}.pattern").alias("pattern"),
            F.col(f"{into}.nothing").alias("nothing"),
            F.coalesce(
                F.col(f"{into}.reason"),
                F.concat(F.lit("the pattern doesn't read: "), F.col("_c.problem")),
            ).alias("reason"),
            F.col("_c").alias("compiled"),
        ),
    ).drop("_c")


def expected_of(target: Column) -> Expected:
    return Expected(target["compiled"], target["nothing"], target["reason"])


def item_texts(picked: Column) -> Column:
    """Picked items as text: nulls dropped before ranking, anything but a string as JSON."""
    return F.transform(
        F.filter(picked, lambda v: ~F.is_variant_null(v)),
        lambda v: F.when(F.schema_of_variant(v) == "STRING", v.cast("string")).otherwise(
            jsontext.spaced(F.to_json(v))
        ),
    )


def written_texts(picked: Column) -> Column:
    """As `item_texts`, from items as they are written (tape.picks): members in order, numbers as spelled."""
    return F.transform(
        F.filter(picked, lambda t: t != "null"),
        lambda t: F.when(t.startswith('"'), F.parse_json(t).cast("string")).otherwise(jsontext.spaced(t)),
    )


def score(metric: str, items: Column, target: Column) -> Column:
    """One view's score of one row: value and detail."""
    if metric not in METRICS and metric not in REGISTERED:
        raise ValueError(f"no metric {metric!r}, only {sorted([*METRICS, *REGISTERED])}")
    expected = expected_of(target)
    if metric in REGISTERED:
        asked = lambda c: F.when(expected.reason.isNull(), c)
        found = REGISTERED[metric](asked(items), asked(target["pattern"]), asked(expected.nothing))
        return F.when(expected.reason.isNotNull(), scored(None, reason=expected.reason)).otherwise(
            scored(found["value"], found["answer"], found["reason"])
        )
    return F.when(expected.reason.isNotNull(), scored(None, reason=expected.reason)).otherwise(
        text.let(items, lambda bound: METRICS[metric](bound, expected))
    )


@dataclass(frozen=True)
class View:
    """One comparison a scorer makes."""

    metric: str
    output: str = ""
    expectation: str = ""
    split: str | None = None
    params: Mapping[str, str] = field(default_factory=dict)


def output_texts(answer: Column, view: View, has_answer: Column, written: Column | None = None) -> Column:
    """The texts a view picks from an answer (VARIANT); null where there is no answer.

    Objects and lists are read off the answer's text where it is given (`written`).
    """
    texts = item_texts(selectors.select(answer, view.output))
    if written is not None:
        composed = F.when(written.rlike(r"^[ \t\n\r]*[\[{]"), written)
        texts = F.coalesce(written_texts(tape.picks(composed, view.output)), texts)
    if view.split is not None:
        if view.split != "lines@1":
            raise ValueError(f"no split {view.split!r}")
        texts = F.flatten(F.transform(texts, text.lines))
    return F.when(has_answer, texts)


def _targets(views: list[View]) -> dict[str, str]:
    """A column for each distinct expectation selector; views often share what they select."""
    return {s: f"_target{i}" for i, s in enumerate(dict.fromkeys(v.expectation for v in views))}


def decoded_expectations(expectations: DataFrame, views: list[View], expectation: str) -> DataFrame:
    """Expectations with what each view looks for, decoded and compiled once, in place of the document."""
    frame = expectations.withColumns({f"{name}p": selectors.select(F.col(expectation), s) for s, name in _targets(views).items()})
    for name in _targets(views).values():
        frame = decode_targets(frame, f"{name}p", name).drop(f"{name}p")
    return frame.drop(expectation)


def score_decoded(
    pairs: DataFrame, views: list[View], answer: str, params: Mapping[str, str] | None = None, written: str | None = None
) -> DataFrame:
    """Every view of every row of answers (VARIANT) with decoded expectations, one output row per view.

    The views of a row are scored in one pass over it and exploded at the end, so the answers
    are read once and nothing is shuffled. A null answer is a run without one; a row whose
    expectation is missing has no target. Scorer params are overlaid by the view's. `written` names
    the column with the answers' text, for items whose members' order counts.
    """
    targets = _targets(views)
    keys = [c for c in pairs.columns if c not in (answer, written) and c not in targets.values()]
    text_of = None if written is None else F.col(written)
    outputs = {k: f"_texts{i}" for i, k in enumerate(dict.fromkeys((v.output, v.split) for v in views))}
    has_answer = F.col(answer).isNotNull()
    frame = pairs.withColumns(
        {name: output_texts(F.col(answer), View("", output=o, split=s), has_answer, text_of) for (o, s), name in outputs.items()}
    )
    rows = []
    for i, view in enumerate(views):
        merged = {**(params or {}), **view.params}
        target = F.col(targets[view.expectation])
        scores = score(view.metric, F.col(outputs[view.output, view.split]), target)
        rows.append(
            F.struct(
                F.lit(i).alias("view"),
                F.lit(view.metric).alias("metric"),
                F.when(target.isNull(), scored(None, reason="no target")).otherwise(scores).alias("scored"),
                F.to_json(F.create_map(*[F.lit(x) for kv in sorted(merged.items()) for x in kv])).alias("params")
                if merged
                else F.lit("{}").alias("params"),
            )
        )
    return frame.select(*keys, F.explode(F.array(*rows)).alias("_row")).select(
        *keys, "_row.view", "_row.metric", "_row.scored.value", "_row.scored.answer", "_row.scored.reason", "_row.params"
    )


def score_views(
    pairs: DataFrame, views: list[View], answer: str, expectation: str, params: Mapping[str, str] | None = None
) -> DataFrame:
    """Every view of every (answer, expectation) row, both VARIANT, one output row per view.

    Where expectations are a table of their own, decode them before they are joined.
    """
    return score_decoded(decoded_expectations(pairs, views, expectation), views, answer, params)


def score_runs(
    items: DataFrame, expectations: DataFrame, views: list[View], params: Mapping[str, str] | None = None
) -> DataFrame:
    """Score items of runs from their responses: answer by contract, expectation by case, every view, versions.

    `items`: run, case_id, replicate, response (JSON text, null if the call failed), contract,
    answer_tool; `expectations`: case_id, expectation (JSON text), one per case. Patterns are
    compiled on the expectations, before they meet the answers. An item without an expectation
    is unscored, for the reason that there is no target.
    """
    # Parsed and read in steps of their own: what follows looks at each several times.
    how = F.col("contract"), F.col("answer_tool")
    parsed = items.select("run", "case_id", "replicate", "contract", "answer_tool", F.try_parse_json("response").alias("_response"))
    answers = parsed.select(
        "run", "case_id", "replicate", responses.answer(F.col("_response"), *how).alias("_answer"), responses.answer_text(F.col("_response"), *how).alias("_written")
    )
    expected = expectations.select("case_id", F.try_parse_json("expectation").alias("_expectation"))
    pairs = answers.join(decoded_expectations(expected, views, "_expectation"), "case_id", "left")
    return stamped(score_decoded(pairs, views, "_answer", params, "_written"))


def summarise_runs(scores: DataFrame, runs: DataFrame, views: list[View], digits: int | None = None) -> DataFrame:
    """Summaries by run and view over the grid of both: a run without scores has a row for each view too."""
    named = F.array(*[F.struct(F.lit(i).alias("view"), F.lit(v.metric).alias("metric")) for i, v in enumerate(views)])
    grid = runs.select("run", F.inline(named))
    counted = summarise(scores, ["run", "view"], digits=digits)
    empty = {c: F.coalesce(F.col(c), F.lit(0).cast(t)) for c, t in counted.dtypes if c not in ("run", "view")}
    return grid.join(counted, ["run", "view"], "left").withColumns(empty)


def unknown_metrics(views: DataFrame, metric: str = "metric") -> DataFrame:
    """Views naming a metric no function is registered for."""
    return views.where(~F.col(metric).isin(*METRICS, *REGISTERED))


def summarise(scores: DataFrame, by: list[str], value: str = "value", digits: int | None = None) -> DataFrame:
    return scores.groupBy(*by).agg(*aggregates.summary(F.col(value), digits))


def poolable(scores: DataFrame, flagged: DataFrame, by: list[str], digits: int | None = None) -> DataFrame:
    """Summaries over the logs without a disqualifying finding, grouped by what was pinned and recorded."""
    return summarise(scores.join(flagged, "log_id", "left_anti"), by, digits=digits)


# Findings after which a log's results aren't pooled with others'.
DISQUALIFYING = ("case.drift", "attestation.model", "attestation.prompt_tokens_drift", "ledger.seal")


def pooled(scores: DataFrame, logs: DataFrame, findings: DataFrame, factors: list[str], digits: int | None = None) -> DataFrame:
    """Summaries of scores (log_id, value) over logs that share everything pinned and recorded, and number of logs.

    `logs`: log_id and the factors: trial, execution, rig, code that ran. Logs with a disqualifying finding stay out.
    """
    out = findings.where(F.col("code").isin(*DISQUALIFYING)).select("log_id").distinct()
    fit = logs.withColumn("log_id", F.col("log_id").cast("string")).join(out, "log_id", "left_anti")
    of = scores.withColumn("log_id", F.col("log_id").cast("string")).join(fit, "log_id")
    counts = fit.groupBy(*factors).agg(F.count("*").alias("n_logs"))
    same = [F.col(f).eqNullSafe(F.col(f"_{f}")) for f in factors]
    counts = counts.select(*[F.col(f).alias(f"_{f}") for f in factors], "n_logs")
    return summarise(of, factors, digits=digits).join(counts, same).drop(*[f"_{f}" for f in factors])


def conflicts(expectations: DataFrame, schema: Column) -> DataFrame:
    """What keeps a scoring's expectations from being used: two for one case, or another schema's."""
    doubled = (
        expectations.groupBy("scoring", "case_id")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .select(
            "scoring",
            F.concat(F.lit("case "), F.col("case_id").cast("string"), F.lit(" has more than one expectation")).alias("problem"),
            "n",
        )
    )
    foreign = expectations.where(F.col("expectation_schema") != schema).select(
        "scoring",
        F.concat(F.lit("expectation "), F.col("digest").cast("string"), F.lit(" is not in the scorer's schema")).alias("problem"),
        F.lit(1).cast("bigint").alias("n"),
    )
    return doubled.unionByName(foreign)


def hit_rates(answers: DataFrame, views: list[View], answer: str, by: list[str], digits: int = 9) -> DataFrame:
    """The share of answers in which each view's output selector picks something."""
    picked = F.array(
        *[
            F.struct(
                F.lit(v.metric).alias("metric"),
                F.lit(v.output).alias("selector"),
                F.when(F.size(selectors.select(F.col(answer), v.output)) > 0, 1.0).otherwise(0.0).alias("hit"),
            )
            for v in views
        ]
    )
    return (
        answers.select(*by, F.explode(picked).alias("v"))
        .groupBy(*by, "v.metric", "v.selector")
        .agg(F.round(F.avg("v.hit"), digits).alias("hit_rate"), F.count("*").alias("n"))
    )
