"""Checks of whole ledgers: every run and score at once, findings out.

Calls come as one row each: run, case_id, replicate, started_us, finished_us, attempts,
returned_model, token_hex, vignette_hex. Runs come as one row each with their trial's grid
(`n_cases` x `n_seeds`), execution and stage times.

Fixed values: the findings' codes, levels and messages, which others look for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import windows
from .findings import each, finding, message, settled, union

ITEM = ["run", "case_id", "replicate"]


def item_name() -> Column:
    return message(F.col("case_id"), "/", F.col("replicate"))


# ------------------------------------------------------------------------------ the grid


def grid(runs: DataFrame) -> DataFrame:
    """Every (case, replicate) of every run's trial.

    The cases are spread over the cluster before each is multiplied by its replicates, so a
    large trial isn't generated by the one task that holds its run.
    """
    cases = runs.select(
        "run", "n_seeds", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_cases") - 1)).alias("case_id")
    )
    return cases.repartition("run", "case_id").select(
        "run", "case_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_seeds") - 1)).alias("replicate")
    )


def in_grid() -> Column:
    return F.col("case_id").between(0, F.col("n_cases") - 1) & F.col("replicate").between(0, F.col("n_seeds") - 1)


def missing_items(runs: DataFrame, items: DataFrame) -> DataFrame:
    """The grid's items that no row is for; finished runs only."""
    return grid(runs.where("finished_us IS NOT NULL")).join(items.select(*ITEM), ITEM, "left_anti")


def incomplete(runs: DataFrame, items: DataFrame) -> DataFrame:
    """How many items finished runs lack, without listing the grid: its size less what is there."""
    finished = runs.where("finished_us IS NOT NULL").select("run", "n_cases", "n_seeds")
    present = (
        items.select(*ITEM).distinct().join(finished, "run").where(in_grid()).groupBy("run").agg(F.count("*").alias("n"))
    )
    counts = finished.join(present, "run", "left").select(
        "run", (F.col("n_cases") * F.col("n_seeds") - F.coalesce("n", F.lit(0))).alias("missing")
    )
    return finding(
        counts.where("missing > 0"),
        "run.incomplete",
        message(F.col("missing"), " items missing"),
        log_id=F.col("run"),
    )


def strays(runs: DataFrame, items: DataFrame) -> DataFrame:
    """Items outside their trial, and items there more than once."""
    grids = runs.select("run", "n_cases", "n_seeds")
    outside = items.join(grids, "run").where(~in_grid())
    doubled = items.groupBy(*ITEM).agg(F.count("*").alias("n")).where("n > 1")
    return union(
        finding(outside, "run.stray", "run item outside the trial", item_name(), F.col("run"), "error"),
        finding(doubled, "run.duplicate", "duplicate run items", item_name(), F.col("run"), "error"),
    )


# ------------------------------------------------------------------------- send schedule

# Chunks of at most 65,536 positions: a key's last four hex digits are dropped.
_NUMERIC_CHUNK = 12
_HASH_CHUNK = 4


def order_key() -> Column:
    """A string that sorts items as their run's execution sends them."""
    major = (
        F.when(F.col("send_order") == "replicate_major@1", F.col("replicate") * F.col("n_cases") + F.col("case_id"))
        .otherwise(F.col("case_id") * F.col("n_seeds") + F.col("replicate"))
    )
    shuffled = F.sha2(
        F.concat_ws(":", F.col("shuffle_seed"), F.col("case_id"), F.col("replicate")), 256
    )
    return F.when(F.col("send_order") == "shuffled@1", shuffled).otherwise(F.lpad(F.hex(major), 16, "0"))


def order_chunk() -> Column:
    return F.when(
        F.col("send_order") == "shuffled@1", F.substring("order_key", 1, _HASH_CHUNK)
    ).otherwise(F.substring("order_key", 1, _NUMERIC_CHUNK))


def schedule(runs: DataFrame) -> DataFrame:
    """The whole grid with each item's position in its run's send order.

    Case- and replicate-major positions are arithmetic; only shuffled runs are sorted.
    """
    columns = ["run", "n_cases", "n_seeds", "send_order", "shuffle_seed"]
    shuffled = F.col("send_order") == "shuffled@1"
    major = runs.where(~shuffled)
    placed = grid(major).join(major.select(*columns), "run").select(
        *ITEM, F.conv(order_key(), 16, 10).cast("bigint").alias("position")
    )
    return placed.unionByName(shuffled_schedule(runs.where(shuffled)))


def shuffled_schedule(runs: DataFrame) -> DataFrame:
    columns = ["run", "n_cases", "n_seeds", "send_order", "shuffle_seed"]
    keyed = grid(runs).join(runs.select(*columns), "run").withColumn("order_key", order_key())
    numbered = windows.numbered(keyed, ["run"], order_chunk(), ["order_key"], "position")
    return numbered.select(*ITEM, "position")


def out_of_order(runs: DataFrame, items: DataFrame) -> DataFrame:
    """Per run, items sent before one scheduled ahead of them."""
    columns = ["run", "n_cases", "n_seeds", "send_order", "shuffle_seed"]
    keyed = (
        items.join(runs.select(*columns), "run")
        .where(in_grid())
        .withColumn("order_key", order_key())
    )
    seen = windows.running(
        keyed, ["run"], order_chunk(), ["order_key"], {"latest": ("max", F.col("started_us"))}
    )
    early = seen.groupBy("run").agg(F.count_if(F.col("started_us") < F.col("latest")).alias("early"))
    return finding(
        early.where("early > 0"),
        "execution.order",
        message(F.col("early"), " items were sent before items scheduled ahead of them"),
        log_id=F.col("run"),
    )


# ----------------------------------------------------------------------- other execution


def over_concurrency(runs: DataFrame, calls: DataFrame, width: int = windows.SECOND) -> DataFrame:
    peaks = windows.peak(calls, "run", "started_us", "finished_us", width)
    over = peaks.join(runs.select("run", "concurrency"), "run").where("peak > concurrency")
    return finding(
        over,
        "execution.concurrency",
        message(F.col("peak"), " calls were in flight at once, declared ", F.col("concurrency")),
        log_id=F.col("run"),
    )


def over_retries(runs: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls are counted by their number of attempts before the join, a few rows per run."""
    counts = calls.groupBy("run", "attempts").agg(F.count("*").alias("n"))
    over = (
        counts.join(runs.select("run", "retries"), "run")
        .where("attempts > retries + 1")
        .groupBy("run", "retries")
        .agg(F.sum("n").alias("n"))
    )
    return finding(
        over,
        "execution.retries",
        message(F.col("n"), " calls took more than the ", F.col("retries") + 1, " attempts allowed"),
        log_id=F.col("run"),
    )


def unfingerprinted(calls: DataFrame) -> DataFrame:
    """Items with a call lacking a prompt-token fingerprint; only those calls are shuffled."""
    items = calls.where("token_hex IS NULL").select(*ITEM).distinct()
    counts = items.groupBy("run").agg(F.count("*").alias("n"))
    return finding(
        counts,
        "attestation.prompt_tokens",
        message(F.col("n"), " items have no prompt token fingerprint"),
        log_id=F.col("run"),
    )


def canary_phases(calls: DataFrame, canaries: DataFrame) -> DataFrame:
    """Start canaries still running at the first item, end canaries begun before the last item's end."""
    bounds = calls.groupBy("run").agg(F.min("started_us").alias("first"), F.max("finished_us").alias("last"))
    counts = (
        canaries.join(bounds, "run")
        .groupBy("run")
        .agg(
            F.count_if((F.col("phase") == "start") & (F.col("finished_us") > F.col("first"))).alias("early"),
            F.count_if((F.col("phase") == "end") & (F.col("started_us") < F.col("last"))).alias("late"),
        )
    )
    return each(
        counts,
        [
            (F.col("early") > 0, "canary.phase", message(F.col("early"), " start canary calls hadn't finished when the first item was sent"), "warning"),
            (F.col("late") > 0, "canary.phase", message(F.col("late"), " end canary calls started before the last item call finished"), "warning"),
        ],
        log_id=F.col("run"),
    )


def canary_incomplete(runs: DataFrame, canaries: DataFrame) -> DataFrame:
    planned = runs.where("finished_us IS NOT NULL").select("run", "n_planned_canaries")
    made = canaries.select("run", "phase", "canary").distinct().groupBy("run").agg(F.count("*").alias("n"))
    counts = planned.join(made, "run", "left").select(
        "run", (F.col("n_planned_canaries") - F.coalesce("n", F.lit(0))).alias("missing")
    )
    return finding(
        counts.where("missing > 0"),
        "run.incomplete",
        message(F.col("missing"), " canary calls missing"),
        log_id=F.col("run"),
    )


# --------------------------------------------------------------------------- attestation


def case_drift(calls: DataFrame, cases: DataFrame) -> DataFrame:
    """Items whose vignette, as read, isn't the one their case pins (`pinned_hex`)."""
    drifted = calls.join(cases.select("case_id", "pinned_hex"), "case_id").where(
        ~F.col("vignette_hex").eqNullSafe(F.col("pinned_hex"))
    )
    return finding(
        drifted,
        "case.drift",
        "the vignette read differs from the case's",
        item_name(),
        F.col("run"),
    )


def model_attestation(runs: DataFrame, calls: DataFrame) -> DataFrame:
    """Each other model name an item's calls returned, and a missing name, once per item.

    A call without a response (`has_response`) attests nothing and is no finding here.
    """
    declared = F.col("declared_model")
    wrong = (
        calls.where("has_response").join(runs.select("run", "declared_model"), "run")
        .where(~F.col("returned_model").eqNullSafe(declared))
        .select(*ITEM, "returned_model", "declared_model")
        .distinct()
    )
    return finding(
        wrong,
        "attestation.model",
        F.when(
            F.col("returned_model").isNull(),
            message("engine returned no model name, declared '", declared, "'"),
        ).otherwise(
            message("engine returned model '", F.col("returned_model"), "', declared '", declared, "'")
        ),
        item_name(),
        F.col("run"),
    )


def token_drift(pairs: DataFrame, trials: DataFrame, calls: DataFrame) -> DataFrame:
    """Items two runs share whose prompts the engine read as different tokens.

    A pair is compared only where both trials build prompts alike; otherwise the pair
    itself is reported, with what differs.
    """
    fields = ["skeleton", "engine", "cleanup"]
    a, b = (
        trials.select(F.col("run").alias(side), *[F.col(f).alias(f"{side}_{f}") for f in fields]) for side in "ab"
    )
    gated = (
        pairs.join(a, "a")
        .join(b, "b")
        .withColumn(
            "differ",
            F.array_join(
                F.array_compact(
                    F.array(*[F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), F.lit(f)) for f in fields])
                ),
                ", ",
            ),
        )
    )
    tokens = calls.where("token_hex IS NOT NULL").select(*ITEM, "token_hex")
    theirs = tokens.toDF("b", "case_id", "replicate", "b_hex")
    drifted = (
        tokens.withColumnRenamed("run", "a")
        .join(gated.where("differ = ''").select("a", "b"), "a")
        .join(theirs, ["b", "case_id", "replicate"])
        .where("token_hex <> b_hex")
    )
    pair = message(F.col("a"), " and ", F.col("b"))
    return union(
        finding(
            drifted,
            "attestation.prompt_tokens_drift",
            "the engine read different prompt tokens for the same item",
            item_name(),
            pair,
        ),
        finding(
            gated.where("differ <> ''"),
            "attestation.incomparable",
            message("the runs build their prompts from different ", F.col("differ")),
            log_id=pair,
            level="error",
        ),
    )


def code_name(prefix: str) -> Column:
    name = lambda part: F.col(f"{prefix}_{part}")
    return F.concat_ws(" ", name("distribution"), name("version"), name("revision"))


def ran_pinned() -> Column:
    """Whether the code that ran is the code that was pinned; a revision counts only when pinned."""
    same = lambda part: F.col(f"ran_{part}").eqNullSafe(F.col(f"pinned_{part}"))
    return same("distribution") & same("version") & (F.col("pinned_revision").isNull() | same("revision"))


def tool_code(declared: DataFrame, recorded: DataFrame) -> DataFrame:
    """Declared tools (run, tool, name, pinned_*) against what was recorded (run, tool, ran_*)."""
    both = declared.join(recorded.withColumn("recorded", F.lit(True)), ["run", "tool"], "left")
    unrecorded = F.col("recorded").isNull()
    wrong = both.where(unrecorded | ~ran_pinned())
    return finding(
        wrong,
        "tools.code",
        F.when(unrecorded, message("the code tool '", F.col("name"), "' ran with isn't recorded")).otherwise(
            message(
                "tool '", F.col("name"), "' ran with ", code_name("ran"),
                ", not the code it pins (", code_name("pinned"), ")",
            )
        ),
        F.col("tool"),
        F.col("run"),
    )


# --------------------------------------------------------------------------- tool rounds


def round_mismatches(called: DataFrame, ran: DataFrame, answer_tool: str | Column | None = None) -> DataFrame:
    """Rounds whose tools aren't the calls the response before made: (item, round, id, name) each.

    Calls of the answer tool are the answer: they aren't run.
    """
    keys = ["item", "round", "id", "name"]
    if answer_tool is not None:
        called = called.where(~F.col("name").eqNullSafe(F.lit(answer_tool) if isinstance(answer_tool, str) else answer_tool))
    c = called.select(*keys).distinct().withColumn("was_called", F.lit(1))
    r = ran.select(*keys).distinct().withColumn("was_run", F.lit(1))
    return (
        c.join(r, keys, "full_outer")
        .where("was_called IS NULL OR was_run IS NULL")
        .groupBy("item", "round")
        .agg(
            F.count_if(F.col("was_run").isNull()).alias("not_run"),
            F.count_if(F.col("was_called").isNull()).alias("not_called"),
        )
    )


def unanswered(turns: DataFrame, pending: DataFrame) -> DataFrame:
    """Tools an item's last response still calls; more rounds than allowed is an error.

    `turns` has each response of an item: item, round (from 0, the first one), answer_tool and
    max_rounds of its skeleton; the last one counts, whether it calls tools or not. `pending` has
    the tools a response calls: item, round, name. The answer tool's calls are the answer, not pending.
    """
    last = turns.groupBy("item", "answer_tool", "max_rounds").agg(F.max("round").alias("rounds"))
    names = (
        pending.join(last, "item")
        .where((F.col("round") == F.col("rounds")) & ~F.col("name").eqNullSafe(F.col("answer_tool")))
        .groupBy("item", "rounds", "max_rounds")
        .agg(F.array_join(F.sort_array(F.collect_set("name")), ", ").alias("names"))
    )
    return settled(
        finding(
            names,
            "tools.unanswered",
            message("the last response still calls ", F.col("names"), " after ", F.col("rounds"), " of ", F.col("max_rounds"), " rounds"),
            F.col("item"),
        ),
        finding(
            last.where(F.col("rounds") > F.col("max_rounds")),
            "tools.rounds",
            message("more than ", F.col("max_rounds"), " rounds"),
            F.col("item"),
            level="error",
        ),
    )


# -------------------------------------------------------------------------------- scores


def score_incomplete(scores: DataFrame, run_items: DataFrame, score_items: DataFrame) -> DataFrame:
    """Finished scores lacking (item, view) rows: what is expected less what is there."""
    finished = scores.where("score_finished_us IS NOT NULL").select("score", "run", "n_views")
    items = run_items.select(*ITEM).distinct()
    expected = items.groupBy("run").agg(F.count("*").alias("n_items"))
    scored = (
        score_items.select("score", "case_id", "replicate", "view")
        .distinct()
        .join(finished, "score")
        .where("view < n_views")
        .join(items, ITEM, "left_semi")
        .groupBy("score")
        .agg(F.count("*").alias("n_scored"))
    )
    counts = (
        finished.join(expected, "run")
        .join(scored, "score", "left")
        .select("score", (F.col("n_items") * F.col("n_views") - F.coalesce("n_scored", F.lit(0))).alias("missing"))
    )
    return finding(
        counts.where("missing > 0"),
        "score.incomplete",
        message(F.col("missing"), " items missing"),
        log_id=F.col("score"),
    )


def score_strays(scores: DataFrame, run_items: DataFrame, score_items: DataFrame) -> DataFrame:
    known = score_items.join(scores.select("score", "run", "n_views"), "score")
    out_of_range = known.where("view >= n_views")
    outside = known.join(run_items.select(*ITEM), ITEM, "left_anti")
    doubled = score_items.groupBy("score", "case_id", "replicate", "view").agg(F.count("*").alias("n")).where("n > 1")
    return union(
        finding(out_of_range, "score.view_range", message("score item view ", F.col("view"), " is out of range"), item_name(), F.col("score"), "error"),
        finding(outside, "score.stray", "score item is not in the run", item_name(), F.col("score"), "error"),
        finding(doubled, "score.duplicate", "duplicate score items", item_name(), F.col("score"), "error"),
    )


def score_before_finish(scores: DataFrame, runs: DataFrame) -> DataFrame:
    joined = scores.join(runs.select("run", "finished_us"), "run", "left")
    ended = F.col("finished_us")
    early = joined.where(ended.isNull() | (ended > F.col("score_started_us")))
    return finding(
        early,
        "score.run_unfinished",
        F.when(ended.isNull(), "the run hasn't finished").otherwise("the score started before the run finished"),
        F.col("score"),
        F.col("score"),
    )


def judged(items: DataFrame, judge_calls: DataFrame, n_seeds: int, judge: str) -> DataFrame:
    """Judged values resting on fewer seeds than declared, and calls that can't be."""
    bad = judge_calls.where((F.col("judge") != judge) | (F.col("seed_index") >= n_seeds))
    doubled = judge_calls.groupBy("item", "seed_index").agg(F.count("*").alias("n")).where("n > 1")
    covered = judge_calls.where(
        (F.col("judge") == judge) & (F.col("seed_index") < n_seeds)
    ).select("item", "seed_index").distinct().groupBy("item").agg(F.count("*").alias("n"))
    short = (
        items.where("value IS NOT NULL")
        .join(covered, "item", "left")
        .select("item", F.coalesce("n", F.lit(0)).alias("n"))
        .where(F.col("n") < n_seeds)
    )
    return union(
        finding(short, "judge.incomplete", message("the value rests on ", F.col("n"), f" of {n_seeds} judge seeds"), F.col("item")),
        finding(
            bad,
            "judge.wrong_call",
            F.when(F.col("judge") != judge, message("judge ", F.col("judge"), " is not the view's judge")).otherwise("judge seed index out of range"),
            F.col("item"),
            level="error",
        ),
        finding(doubled, "judge.duplicate", message("duplicate judge calls for seed ", F.col("seed_index")), F.col("item"), level="error"),
    )


# -------------------------------------------------------------------------- shape of logs


def log_shape(stages: DataFrame) -> DataFrame:
    """Logs whose stages aren't one start and then at most one finish, not before it."""
    logs = stages.groupBy("log_id").agg(
        F.count_if(F.col("stage") == "started").alias("starts"),
        F.count_if(F.col("stage") == "finished").alias("ends"),
        F.min(F.when(F.col("stage") == "started", F.col("at_us"))).alias("began"),
        F.max(F.when(F.col("stage") == "finished", F.col("at_us"))).alias("ended"),
    )
    return each(
        logs,
        [
            (F.col("starts") == 0, "log.stages", "finished without started", "error"),
            (F.col("starts") > 1, "log.stages", "started more than once", "error"),
            (F.col("ends") > 1, "log.stages", "finished more than once", "error"),
            (F.col("ended") < F.col("began"), "log.times", "finished before it started", "error"),
        ],
        log_id=F.col("log_id"),
    )


def call_times(calls: DataFrame, version: Column, readable: int) -> DataFrame:
    return each(
        calls,
        [
            (F.col("finished_us") < F.col("started_us"), "call.times", "finished before it started", "error"),
            (version != readable, "record.version", message("v", version, f" is not readable by v{readable}"), "error"),
        ],
        subject=item_name(),
        log_id=F.col("run"),
    )


# --------------------------------------------------------------------------------- seals

SEAL_VERSION = "tree@1"


def seals(rows: DataFrame, started: DataFrame) -> DataFrame:
    """The seal of every log from its canonical rows (log_id, canonical) and started row.

    There is one form, whatever a log's size: row digests are hashed by their first eight hex
    digits, those by the first four, and those into the root. However many rows a log has, no
    node joins more than 65,536 digests but the lowest, whose share is rows / 2^32. Equal rows
    are one leaf and a count. Every level is dealt out by log and prefix, so a large log is
    spread over tasks. The version is kept with the seal.
    """

    def level(nodes: DataFrame, digits: int) -> DataFrame:
        by = nodes.withColumn("prefix", F.substring("node", 1, digits)).repartition("log_id", "prefix")
        return (
            by.groupBy("log_id", "prefix")
            .agg(F.sha2(F.array_join(F.sort_array(F.collect_list("node")), ","), 256).alias("hex"))
            .select("log_id", F.concat("prefix", F.lit(":"), "hex").alias("node"))
        )

    leaves = (
        rows.select("log_id", F.sha2("canonical", 256).alias("leaf"))
        .repartition("log_id", "leaf")
        .groupBy("log_id", "leaf")
        .agg(F.count("*").alias("n"))
        .select("log_id", F.concat("leaf", F.lit(":"), F.col("n").cast("string")).alias("node"))
    )
    roots = level(level(level(leaves, 8), 4), 0)
    tree = roots.select("log_id", F.concat(F.lit('"'), F.regexp_extract("node", "([0-9a-f]{64})$", 1), F.lit('"')).alias("body"))
    document = F.concat(
        F.lit('{"items":['), F.coalesce("body", F.lit("")), F.lit('],"started":'), F.col("started"), F.lit("}")
    )
    return started.join(tree, "log_id", "left").select(
        "log_id", F.lit(SEAL_VERSION).alias("version"), F.concat(F.lit("sha256:"), F.sha2(document, 256)).alias("seal")
    )


def seal_mismatches(finished: DataFrame, sealed: DataFrame) -> DataFrame:
    wrong = finished.withColumnRenamed("seal", "stored").join(sealed, "log_id").where("stored <> seal")
    return finding(
        wrong, "ledger.seal", "rows changed after the log was sealed", F.col("log_id"), F.col("log_id")
    )
