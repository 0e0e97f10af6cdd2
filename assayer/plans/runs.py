"""Queries that check runs and scores: the events, taken as calls of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ledger, seals, windows
from ..session import checkpoint_dir, kept
from ..sources import store
from .registry import query
from .tables import Dialect, Given, register_view

# ------------------------------------------------------------------------- derived views


def _call_raw(d: Dialect) -> str:
    """Calls with some outside their trial's grid and some twice."""
    return """
SELECT * REPLACE (CASE WHEN event_id % 211 = 0 THEN replicate + 8 WHEN event_id % 197 = 1 THEN 0 ELSE replicate END AS replicate) FROM d_call""" if not d.spark else """
SELECT event_id, run, case_id, CASE WHEN event_id % 211 = 0 THEN replicate + 8 WHEN event_id % 197 = 1 THEN 0 ELSE replicate END AS replicate,
  started_us, finished_us, attempts, returned_model, token_hex, vignette_hex FROM d_call"""


def _pin(d: Dialect) -> str:
    return f"SELECT doc_id AS case_id, {d.sha("concat('vignette-', CAST(doc_id AS STRING))")} AS pinned_hex FROM documents"


def _canary(d: Dialect) -> str:
    phases = (
        "inline(array(struct('start' AS phase, 0 AS canary), struct('start' AS phase, 1 AS canary), struct('end' AS phase, 0 AS canary), struct('end' AS phase, 1 AS canary)))"
        if d.spark
        else "unnest([{'phase': 'start', 'canary': 0}, {'phase': 'start', 'canary': 1}, {'phase': 'end', 'canary': 0}, {'phase': 'end', 'canary': 1}], recursive := true)"
    )
    return f"""
SELECT run, phase, canary,
  CASE WHEN phase = 'start' THEN first_us - 9000000 ELSE last_us + (run % 3 - 1 - canary) * 4000000 END AS started_us,
  CASE WHEN phase = 'start' THEN first_us + (run % 3 - 1 + canary) * 4000000 ELSE last_us + 9000000 END AS finished_us
FROM (SELECT run, first_us, last_us, {phases} FROM (SELECT run, min(started_us) AS first_us, max(finished_us) AS last_us FROM d_call GROUP BY run) b) p
WHERE (run + canary) % 6 <> 1"""


def _score_stage(d: Dialect) -> str:
    return """
SELECT run AS score, run, 2 AS n_views,
  (SELECT max(finished_us) FROM d_call) + (run % 4 - 2) * 600000000 AS score_started_us,
  CASE WHEN run % 6 = 5 THEN NULL ELSE 1 END AS score_finished_us FROM d_run"""


def _score_item(d: Dialect) -> str:
    views = "explode(array(0, 1))" if d.spark else "unnest([0, 1])"
    return f"""
SELECT run AS score, case_id, CASE WHEN event_id % 301 = 7 THEN replicate + 8 WHEN event_id % 401 = 9 THEN 0 ELSE replicate END AS replicate,
  CASE WHEN event_id % 251 = 3 THEN view + 1 ELSE view END AS view
FROM (SELECT *, {views} AS view FROM d_call) c WHERE (event_id * 2 + view) % 13 <> 0"""


def _stage(d: Dialect) -> str:
    """Start and finish rows of logs, one log per order, some missing, doubled or backwards."""
    at = d.us("o_orderdate")
    return f"""
SELECT o_orderkey AS log_id, 'started' AS stage, {at} AS at_us FROM orders WHERE o_orderkey % 50 <> 7
UNION ALL SELECT o_orderkey, 'finished', {at} + (o_orderkey % 40 - 1) * 1000000 FROM orders WHERE o_orderkey % 3 <> 0
UNION ALL SELECT o_orderkey, 'started', {at} FROM orders WHERE o_orderkey % 90 = 11
UNION ALL SELECT o_orderkey, 'finished', {at} + 1000000 FROM orders WHERE o_orderkey % 80 = 13"""


def _row(d: Dialect) -> str:
    """The canonical form of each call's row, keys sorted."""
    return """
SELECT run AS log_id, event_id, concat('{"attempts":', CAST(attempts AS STRING), ',"case":"', CAST(case_id AS STRING), '","finished":', CAST(finished_us AS STRING),
  CASE WHEN returned_model IS NULL THEN '' ELSE concat(',"model":"', returned_model, '"') END, ',"replicate":', CAST(replicate AS STRING),
  ',"started":', CAST(started_us AS STRING), ',"v":1}') AS canonical FROM d_call"""


def _started(d: Dialect) -> str:
    return """
SELECT run AS log_id, concat('{"run":"', CAST(run AS STRING), '","stage":"started","v":1}') AS started FROM d_run"""


for _name, _build in {
    "d_call_raw": _call_raw, "d_pin": _pin, "d_canary": _canary, "d_score_stage": _score_stage,
    "d_score_item": _score_item, "d_stage": _stage, "d_row": _row, "d_started": _started,
}.items():
    register_view(_name, _build)

NO_SUBJECT = "CAST(NULL AS VARCHAR) AS subject"
ITEM_SQL = "concat(CAST({0}case_id AS STRING), '/', CAST({0}replicate AS STRING))"


def _item(alias: str = "") -> str:
    return ITEM_SQL.format(alias)


# --------------------------------------------------------------------------------- grids


@query(
    "trial_grid",
    """
SELECT run, c.case_id AS case_id, s.replicate AS replicate FROM d_run, LATERAL (SELECT unnest(range(0, n_cases)) AS case_id) c, LATERAL (SELECT unnest(range(0, n_seeds)) AS replicate) s""",
)
def trial_grid(g: Given) -> DataFrame:
    return ledger.grid(g["d_run"])


_KEYED = f"""
grid AS (SELECT r.*, c.case_id, s.replicate FROM d_run r, LATERAL (SELECT unnest(range(0, n_cases)) AS case_id) c, LATERAL (SELECT unnest(range(0, n_seeds)) AS replicate) s),
placed AS (SELECT run, send_order, case_id, replicate, row_number() OVER (PARTITION BY run ORDER BY
  CASE send_order WHEN 'shuffled@1' THEN sha256(concat(CAST(shuffle_seed AS STRING), ':', CAST(case_id AS STRING), ':', CAST(replicate AS STRING))) ELSE '' END,
  CASE send_order WHEN 'replicate_major@1' THEN replicate * n_cases + case_id ELSE case_id * n_seeds + replicate END) - 1 AS position FROM grid)"""


@query("schedule_position", f"WITH {_KEYED} SELECT run, case_id, replicate, position FROM placed")
def schedule_position(g: Given) -> DataFrame:
    return ledger.schedule(g["d_run"])


@query("schedule_shuffled", f"WITH {_KEYED} SELECT run, case_id, replicate, position FROM placed WHERE send_order = 'shuffled@1'")
def schedule_shuffled(g: Given) -> DataFrame:
    return ledger.shuffled_schedule(g["d_run"].where("send_order = 'shuffled@1'"))


# ------------------------------------------------------------------------------ findings

F_SQL = {
    "run_incomplete": f"""
WITH {_KEYED}
SELECT 'warning' AS level, 'run.incomplete' AS code, concat(CAST(count(*) AS STRING), ' items missing') AS message, {NO_SUBJECT}, CAST(p.run AS STRING) AS log_id
FROM placed p JOIN d_run r ON r.run = p.run AND r.finished_us IS NOT NULL
WHERE NOT EXISTS (SELECT 1 FROM d_made c WHERE c.run = p.run AND c.case_id = p.case_id AND c.replicate = p.replicate) GROUP BY p.run""",
    "order_violations": f"""
WITH {_KEYED},
seen AS (SELECT c.run, c.started_us, max(c.started_us) OVER (PARTITION BY c.run ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest
  FROM d_call c JOIN placed p ON p.run = c.run AND p.case_id = c.case_id AND p.replicate = c.replicate),
n AS (SELECT run, count(*) AS early FROM seen WHERE started_us < latest GROUP BY run)
SELECT 'warning' AS level, 'execution.order' AS code, concat(CAST(early AS STRING), ' items were sent before items scheduled ahead of them') AS message, {NO_SUBJECT}, CAST(run AS STRING) AS log_id FROM n""",
    "concurrency_exceeded": f"""
WITH e AS (SELECT run, started_us AS t, 1 AS step FROM d_call UNION ALL SELECT run, finished_us, -1 FROM d_call),
s AS (SELECT run, sum(step) OVER (PARTITION BY run ORDER BY t, step ROWS UNBOUNDED PRECEDING) AS level FROM e),
p AS (SELECT run, CAST(greatest(max(level), 0) AS BIGINT) AS peak FROM s GROUP BY run)
SELECT 'warning' AS level, 'execution.concurrency' AS code, concat(CAST(peak AS STRING), ' calls were in flight at once, declared ', CAST(concurrency AS STRING)) AS message, {NO_SUBJECT}, CAST(p.run AS STRING) AS log_id
FROM p JOIN d_run r ON r.run = p.run WHERE peak > concurrency""",
    "retries_exceeded": f"""
SELECT 'warning' AS level, 'execution.retries' AS code, concat(CAST(count(*) AS STRING), ' calls took more than the ', CAST(retries + 1 AS STRING), ' attempts allowed') AS message, {NO_SUBJECT}, CAST(c.run AS STRING) AS log_id
FROM d_call c JOIN d_run r ON r.run = c.run WHERE attempts > retries + 1 GROUP BY c.run, retries""",
    "unfingerprinted": f"""
SELECT 'warning' AS level, 'attestation.prompt_tokens' AS code, concat(CAST(count(*) AS STRING), ' items have no prompt token fingerprint') AS message, {NO_SUBJECT}, CAST(run AS STRING) AS log_id
FROM (SELECT DISTINCT run, case_id, replicate FROM d_call WHERE token_hex IS NULL) x GROUP BY run""",
    "case_drift": f"""
SELECT 'warning' AS level, 'case.drift' AS code, 'the vignette read differs from the case''s' AS message, {_item('c.')} AS subject, CAST(run AS STRING) AS log_id
FROM d_call c JOIN d_pin p ON p.case_id = c.case_id WHERE vignette_hex IS DISTINCT FROM pinned_hex""",
    "model_attestation": f"""
SELECT DISTINCT 'warning' AS level, 'attestation.model' AS code, CASE WHEN returned_model IS NULL THEN concat('engine returned no model name, declared ''', declared_model, '''')
  ELSE concat('engine returned model ''', returned_model, ''', declared ''', declared_model, '''') END AS message, {_item('c.')} AS subject, CAST(c.run AS STRING) AS log_id
FROM d_call c JOIN d_run r ON r.run = c.run WHERE has_response AND returned_model IS DISTINCT FROM declared_model""",
    "canary_phase": f"""
WITH b AS (SELECT run, min(started_us) AS first, max(finished_us) AS last FROM d_call GROUP BY run),
n AS (SELECT c.run, count(*) FILTER (phase = 'start' AND finished_us > first) AS early, count(*) FILTER (phase = 'end' AND started_us < last) AS late FROM d_canary c JOIN b ON b.run = c.run GROUP BY c.run)
SELECT 'warning' AS level, 'canary.phase' AS code, concat(CAST(early AS STRING), ' start canary calls hadn''t finished when the first item was sent') AS message, {NO_SUBJECT}, CAST(run AS STRING) AS log_id FROM n WHERE early > 0
UNION ALL SELECT 'warning', 'canary.phase', concat(CAST(late AS STRING), ' end canary calls started before the last item call finished'), NULL, CAST(run AS STRING) FROM n WHERE late > 0""",
    "canary_incomplete": f"""
SELECT 'warning' AS level, 'run.incomplete' AS code, concat(CAST(4 - count(c.run) AS STRING), ' canary calls missing') AS message, {NO_SUBJECT}, CAST(r.run AS STRING) AS log_id
FROM d_run r LEFT JOIN d_canary c ON c.run = r.run WHERE r.finished_us IS NOT NULL GROUP BY r.run HAVING count(c.run) < 4""",
}


def _runs(g: Given) -> DataFrame:
    return g["d_run"].withColumn("n_planned_canaries", F.lit(4))


FINDERS = {
    "run_incomplete": lambda g: ledger.incomplete(g["d_run"], g["d_made"]),
    "order_violations": lambda g: ledger.out_of_order(g["d_run"], g["d_call"]),
    "concurrency_exceeded": lambda g: ledger.over_concurrency(g["d_run"], g["d_call"]),
    "retries_exceeded": lambda g: ledger.over_retries(g["d_run"], g["d_call"]),
    "unfingerprinted": lambda g: ledger.unfingerprinted(g["d_call"]),
    "case_drift": lambda g: ledger.case_drift(g["d_call"], g["d_pin"]),
    "model_attestation": lambda g: ledger.model_attestation(g["d_run"], g["d_call"]),
    "canary_phase": lambda g: ledger.canary_phases(g["d_call"], g["d_canary"]),
    "canary_incomplete": lambda g: ledger.canary_incomplete(_runs(g), g["d_canary"]),
}
for _name, _build in FINDERS.items():
    query(_name, F_SQL[_name])(_build)


@query(
    "stray_items",
    f"""
SELECT 'error' AS level, 'run.stray' AS code, 'run item outside the trial' AS message, {_item('c.')} AS subject, CAST(c.run AS STRING) AS log_id
FROM d_call_raw c JOIN d_run r ON r.run = c.run WHERE NOT (case_id BETWEEN 0 AND n_cases - 1 AND replicate BETWEEN 0 AND n_seeds - 1)
UNION ALL SELECT 'error', 'run.duplicate', 'duplicate run items', {_item()}, CAST(run AS STRING) FROM d_call_raw GROUP BY run, case_id, replicate HAVING count(*) > 1""",
)
def stray_items(g: Given) -> DataFrame:
    return ledger.strays(g["d_run"], g["d_call_raw"])


@query("missing_items", f"WITH {_KEYED} SELECT p.run, p.case_id, p.replicate FROM placed p JOIN d_run r ON r.run = p.run AND r.finished_us IS NOT NULL ANTI JOIN d_made c ON c.run = p.run AND c.case_id = p.case_id AND c.replicate = p.replicate")
def missing_items(g: Given) -> DataFrame:
    return ledger.missing_items(g["d_run"], g["d_made"])


@query(
    "peak_concurrency",
    """
WITH e AS (SELECT run, started_us AS t, 1 AS step FROM d_call UNION ALL SELECT run, finished_us, -1 FROM d_call),
s AS (SELECT run, sum(step) OVER (PARTITION BY run ORDER BY t, step ROWS UNBOUNDED PRECEDING) AS level FROM e)
SELECT run, CAST(greatest(max(level), 0) AS BIGINT) AS peak FROM s GROUP BY run""",
)
def peak_concurrency(g: Given) -> DataFrame:
    return windows.peak(g["d_call"], "run", "started_us", "finished_us")


@query(
    "duplicate_keys",
    """
SELECT run, case_id, replicate, count(*) AS n FROM d_call_raw GROUP BY run, case_id, replicate HAVING count(*) > 1""",
)
def duplicate_keys(g: Given) -> DataFrame:
    return g["d_call_raw"].groupBy(*ledger.ITEM).agg(F.count("*").alias("n")).where("n > 1")


@query(
    "token_drift",
    f"""
WITH t AS (SELECT run, run % 2 AS skeleton, run // 8 AS engine, 'strip@1' AS cleanup FROM d_run),
p AS (SELECT a.run AS a, b.run AS b, CASE WHEN a.engine <> b.engine THEN 'engine' ELSE '' END AS differ FROM t a JOIN t b ON b.run = a.run + 2)
SELECT 'warning' AS level, 'attestation.prompt_tokens_drift' AS code, 'the engine read different prompt tokens for the same item' AS message, {_item('x.')} AS subject, concat(CAST(a AS STRING), ' and ', CAST(b AS STRING)) AS log_id
FROM p JOIN d_call x ON x.run = a JOIN d_call y ON y.run = b AND y.case_id = x.case_id AND y.replicate = x.replicate WHERE differ = '' AND x.token_hex <> y.token_hex
UNION ALL SELECT 'error', 'attestation.incomparable', concat('the runs build their prompts from different ', differ), NULL, concat(CAST(a AS STRING), ' and ', CAST(b AS STRING)) FROM p WHERE differ <> ''""",
)
def token_drift(g: Given) -> DataFrame:
    """Each run against the run two after it: the same trial continued."""
    runs = g["d_run"].select("run")
    trials = runs.select(
        "run", (F.col("run") % 2).alias("skeleton"), F.floor(F.col("run") / 8).alias("engine"), F.lit("strip@1").alias("cleanup")
    )
    pairs = runs.select(F.col("run").alias("a"), (F.col("run") + 2).alias("b"))
    return ledger.token_drift(pairs, trials, g["d_call"])


_TOOLS_SQL = """
SELECT l_orderkey AS run, l_partkey AS tool, p_name AS name, p_brand AS pinned_distribution, CAST(p_size AS STRING) AS pinned_version,
  CASE WHEN p_partkey % 3 = 0 THEN concat('r', CAST(p_partkey % 5 AS STRING)) END AS pinned_revision, l_linenumber, l_returnflag, l_suppkey
FROM lineitem JOIN part ON p_partkey = l_partkey"""


@query(
    "code_mismatch",
    f"""
WITH t AS ({_TOOLS_SQL}),
r AS (SELECT *, CASE WHEN l_linenumber % 5 = 0 THEN concat(pinned_version, '.1') ELSE pinned_version END AS ran_version,
  CASE WHEN l_suppkey % 4 = 0 THEN 'r9' ELSE pinned_revision END AS ran_revision FROM t),
j AS (SELECT DISTINCT run, tool, name, pinned_distribution, pinned_version, pinned_revision FROM t),
k AS (SELECT run, tool, min(ran_version) AS ran_version, min(ran_revision) AS ran_revision FROM r WHERE l_returnflag <> 'R' GROUP BY run, tool),
b AS (SELECT j.*, k.run IS NULL AS unrecorded, ran_version, ran_revision FROM j LEFT JOIN k ON k.run = j.run AND k.tool = j.tool)
SELECT 'warning' AS level, 'tools.code' AS code, CASE WHEN unrecorded THEN concat('the code tool ''', name, ''' ran with isn''t recorded')
  ELSE concat('tool ''', name, ''' ran with ', concat_ws(' ', pinned_distribution, ran_version, ran_revision), ', not the code it pins (', concat_ws(' ', pinned_distribution, pinned_version, pinned_revision), ')') END AS message,
  CAST(tool AS STRING) AS subject, CAST(run AS STRING) AS log_id
FROM b WHERE unrecorded OR ran_version <> pinned_version OR (pinned_revision IS NOT NULL AND ran_revision IS DISTINCT FROM pinned_revision)""",
)
def code_mismatch(g: Given) -> DataFrame:
    tools = kept(g.sql(_TOOLS_SQL))
    pinned = ["name", "pinned_distribution", "pinned_version", "pinned_revision"]
    # Both sides are dealt out once, as the join wants them.
    declared = tools.select("run", "tool", *pinned).repartition("run", "tool").distinct()
    recorded = (
        tools.where("l_returnflag <> 'R'")
        .select(
            "run",
            "tool",
            F.col("pinned_distribution").alias("ran_distribution"),
            F.when(F.col("l_linenumber") % 5 == 0, F.concat("pinned_version", F.lit(".1"))).otherwise(F.col("pinned_version")).alias("ran_version"),
            F.when(F.col("l_suppkey") % 4 == 0, "r9").otherwise(F.col("pinned_revision")).alias("ran_revision"),
        )
        .repartition("run", "tool")
        .groupBy("run", "tool", "ran_distribution")
        .agg(F.min("ran_version").alias("ran_version"), F.min("ran_revision").alias("ran_revision"))
    )
    return ledger.tool_code(declared, recorded)


_CALLED = "SELECT l_orderkey AS item, l_linenumber AS round, l_partkey AS id, l_returnflag AS name FROM lineitem"
_RAN = "SELECT l_orderkey AS item, l_linenumber AS round, CASE WHEN l_partkey % 31 = 0 THEN l_partkey + 1 ELSE l_partkey END AS id, l_returnflag AS name FROM lineitem WHERE l_partkey % 29 <> 0 AND l_returnflag <> 'R'"
# Every fourth item is answered after its last tools; skeletons allow 5 or 4 rounds and have an answer tool or none.
_SKELETON = "CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE 'R' END AS answer_tool, 5 - l_orderkey % 2 AS max_rounds"
_TURNS = f"""
SELECT DISTINCT l_orderkey AS item, l_linenumber AS round, {_SKELETON} FROM lineitem
UNION ALL SELECT l_orderkey, max(l_linenumber) + 1, {_SKELETON} FROM lineitem WHERE l_orderkey % 4 = 0 GROUP BY l_orderkey"""


@query(
    "round_mismatch",
    f"""
WITH c AS (SELECT DISTINCT * FROM ({_CALLED}) x WHERE name <> 'R'), r AS (SELECT DISTINCT * FROM ({_RAN}) x)
SELECT coalesce(c.item, r.item) AS item, coalesce(c.round, r.round) AS round, count(*) FILTER (r.item IS NULL) AS not_run, count(*) FILTER (c.item IS NULL) AS not_called
FROM c FULL JOIN r ON r.item = c.item AND r.round = c.round AND r.id = c.id AND r.name = c.name WHERE c.item IS NULL OR r.item IS NULL GROUP BY 1, 2""",
)
def round_mismatch(g: Given) -> DataFrame:
    return ledger.round_mismatches(g.sql(_CALLED), g.sql(_RAN), "R")


@query(
    "tools_unanswered",
    f"""
WITH p AS ({_CALLED}), t AS ({_TURNS}), l AS (SELECT item, answer_tool, max_rounds, max(round) AS rounds FROM t GROUP BY item, answer_tool, max_rounds)
SELECT 'warning' AS level, 'tools.unanswered' AS code, concat('the last response still calls ', string_agg(DISTINCT name, ', ' ORDER BY name), ' after ', CAST(rounds AS STRING), ' of ', CAST(max_rounds AS STRING), ' rounds') AS message, CAST(p.item AS STRING) AS subject, CAST(NULL AS STRING) AS log_id
FROM p JOIN l ON l.item = p.item AND l.rounds = p.round WHERE name IS DISTINCT FROM answer_tool GROUP BY p.item, rounds, max_rounds
UNION ALL SELECT 'error', 'tools.rounds', concat('more than ', CAST(max_rounds AS STRING), ' rounds'), CAST(item AS STRING), NULL FROM l WHERE rounds > max_rounds""",
)
def tools_unanswered(g: Given) -> DataFrame:
    return ledger.unanswered(g.sql(_TURNS), g.sql(_CALLED))


# -------------------------------------------------------------------------------- scores


@query(
    "score_incomplete",
    f"""
WITH f AS (SELECT * FROM d_score_stage WHERE score_finished_us IS NOT NULL),
e AS (SELECT f.score, c.case_id, c.replicate, v.view FROM f JOIN d_call c ON c.run = f.run JOIN (SELECT unnest([0, 1]) AS view) v ON v.view < f.n_views)
SELECT 'warning' AS level, 'score.incomplete' AS code, concat(CAST(count(*) AS STRING), ' items missing') AS message, {NO_SUBJECT}, CAST(score AS STRING) AS log_id
FROM e WHERE NOT EXISTS (SELECT 1 FROM d_score_item s WHERE s.score = e.score AND s.case_id = e.case_id AND s.replicate = e.replicate AND s.view = e.view) GROUP BY score""",
)
def score_incomplete(g: Given) -> DataFrame:
    return ledger.score_incomplete(g["d_score_stage"], g["d_call"], g["d_score_item"])


@query(
    "score_strays",
    f"""
SELECT 'error' AS level, 'score.view_range' AS code, concat('score item view ', CAST(view AS STRING), ' is out of range') AS message, {_item('i.')} AS subject, CAST(i.score AS STRING) AS log_id
FROM d_score_item i JOIN d_score_stage s ON s.score = i.score WHERE view >= n_views
UNION ALL SELECT 'error', 'score.stray', 'score item is not in the run', {_item('i.')}, CAST(i.score AS STRING) FROM d_score_item i ANTI JOIN d_call c ON c.run = i.score AND c.case_id = i.case_id AND c.replicate = i.replicate
UNION ALL SELECT 'error', 'score.duplicate', 'duplicate score items', {_item()}, CAST(score AS STRING) FROM d_score_item GROUP BY score, case_id, replicate, view HAVING count(*) > 1""",
)
def score_strays(g: Given) -> DataFrame:
    return ledger.score_strays(g["d_score_stage"], g["d_call"], g["d_score_item"])


@query(
    "score_before_finish",
    """
SELECT 'warning' AS level, 'score.run_unfinished' AS code, CASE WHEN finished_us IS NULL THEN 'the run hasn''t finished' ELSE 'the score started before the run finished' END AS message,
  CAST(score AS STRING) AS subject, CAST(score AS STRING) AS log_id FROM d_score_stage s LEFT JOIN d_run r ON r.run = s.run WHERE finished_us IS NULL OR finished_us > score_started_us""",
)
def score_before_finish(g: Given) -> DataFrame:
    return ledger.score_before_finish(g["d_score_stage"], g["d_run"])


_JUDGE = "SELECT l_orderkey AS item, l_linenumber - 1 AS seed_index, CASE WHEN l_partkey % 50 = 0 THEN 'other' ELSE 'judge' END AS judge FROM lineitem"
_JUDGED = "SELECT o_orderkey AS item, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_totalprice END AS value FROM orders"


@query(
    "judge_incomplete",
    f"""
WITH c AS ({_JUDGE}), i AS ({_JUDGED}), n AS (SELECT item, count(DISTINCT seed_index) AS n FROM c WHERE judge = 'judge' AND seed_index < 3 GROUP BY item)
SELECT 'warning' AS level, 'judge.incomplete' AS code, concat('the value rests on ', CAST(coalesce(n, 0) AS STRING), ' of 3 judge seeds') AS message, CAST(i.item AS STRING) AS subject, CAST(NULL AS STRING) AS log_id
FROM i LEFT JOIN n ON n.item = i.item WHERE value IS NOT NULL AND coalesce(n, 0) < 3
UNION ALL SELECT 'error', 'judge.wrong_call', CASE WHEN judge <> 'judge' THEN concat('judge ', judge, ' is not the view''s judge') ELSE 'judge seed index out of range' END, CAST(item AS STRING), NULL FROM c WHERE judge <> 'judge' OR seed_index >= 3
UNION ALL SELECT 'error', 'judge.duplicate', concat('duplicate judge calls for seed ', CAST(seed_index AS STRING)), CAST(item AS STRING), NULL FROM c GROUP BY item, seed_index HAVING count(*) > 1""",
)
def judge_incomplete(g: Given) -> DataFrame:
    return ledger.judged(g.sql(_JUDGED), g.sql(_JUDGE), 3, "judge")


# --------------------------------------------------------------------------- log content


@query(
    "log_shape",
    """
WITH l AS (SELECT log_id, count(*) FILTER (stage = 'started') AS s, count(*) FILTER (stage = 'finished') AS f, min(at_us) FILTER (stage = 'started') AS b, max(at_us) FILTER (stage = 'finished') AS e FROM d_stage GROUP BY log_id),
x AS (SELECT log_id, 'log.stages' AS code, 'finished without started' AS message FROM l WHERE s = 0 UNION ALL SELECT log_id, 'log.stages', 'started more than once' FROM l WHERE s > 1
UNION ALL SELECT log_id, 'log.stages', 'finished more than once' FROM l WHERE f > 1 UNION ALL SELECT log_id, 'log.times', 'finished before it started' FROM l WHERE e < b)
SELECT 'error' AS level, code, message, CAST(NULL AS STRING) AS subject, CAST(log_id AS STRING) AS log_id FROM x""",
)
def log_shape(g: Given) -> DataFrame:
    return ledger.log_shape(g["d_stage"])


@query(
    "call_times",
    f"""
WITH c AS (SELECT *, started_us + (event_id % 37 - 1) * 1000 AS ended_us, CASE WHEN event_id % 83 = 0 THEN 2 ELSE 1 END AS v FROM d_call)
SELECT 'error' AS level, 'call.times' AS code, 'finished before it started' AS message, {_item()} AS subject, CAST(run AS STRING) AS log_id FROM c WHERE ended_us < started_us
UNION ALL SELECT 'error', 'record.version', 'v2 is not readable by v1', {_item()}, CAST(run AS STRING) FROM c WHERE v <> 1""",
)
def call_times(g: Given) -> DataFrame:
    calls = g["d_call"].select(
        *ledger.ITEM,
        "started_us",
        (F.col("started_us") + (F.col("event_id") % 37 - 1) * 1000).alias("finished_us"),
        F.when(F.col("event_id") % 83 == 0, 2).otherwise(1).alias("v"),
    )
    return ledger.call_times(calls, F.col("v"), 1)


_SEAL_SQL = """
WITH n0 AS (SELECT log_id, concat(sha256(canonical), ':', CAST(count(*) AS STRING)) AS node FROM {rows} r GROUP BY log_id, sha256(canonical)),
n1 AS (SELECT log_id, concat(left(node, 8), ':', sha256(string_agg(node, ',' ORDER BY node))) AS node FROM n0 GROUP BY log_id, left(node, 8)),
n2 AS (SELECT log_id, concat(left(node, 4), ':', sha256(string_agg(node, ',' ORDER BY node))) AS node FROM n1 GROUP BY log_id, left(node, 4)),
b AS (SELECT log_id, concat('"', sha256(string_agg(node, ',' ORDER BY node)), '"') AS body FROM n2 GROUP BY log_id)
SELECT s.log_id, 'tree@1' AS version, concat('sha256:', sha256(concat('{"items":[', coalesce(body, ''), '],"started":', started, '}'))) AS seal FROM d_started s LEFT JOIN b ON b.log_id = s.log_id"""


def _seal_sql(rows: str) -> str:
    return _SEAL_SQL.replace("{rows}", rows)


@query("run_seal", _seal_sql("d_row"))
def run_seal(g: Given) -> DataFrame:
    return ledger.seals(g["d_row"], g["d_started"])


@query(
    "seal_mismatch",
    """
SELECT DISTINCT 'warning' AS level, 'ledger.seal' AS code, 'rows changed after the log was sealed' AS message, CAST(run AS STRING) AS subject, CAST(run AS STRING) AS log_id
FROM d_call WHERE event_id % 640 = 9""",
)
def seal_mismatch(g: Given) -> DataFrame:
    """Some rows change after the logs were sealed; those logs no longer match their seals."""
    rows = g["d_row"]
    finished = ledger.seals(rows, g["d_started"]).select("log_id", "seal")
    changed = rows.withColumn(
        "canonical",
        F.when(F.col("event_id") % 640 == 9, F.replace("canonical", F.lit('"v":1'), F.lit('"v": 1'))).otherwise(F.col("canonical")),
    )
    return ledger.seal_mismatches(finished, ledger.seals(changed, g["d_started"]))


def _log_row(d: Dialect) -> str:
    """The canonical form of every row of a log but its started one, in parts."""
    return """
SELECT log_id, 'items' AS part, canonical FROM d_row
UNION ALL SELECT run, 'canaries', concat('{"canary":', CAST(canary AS STRING), ',"finished":', CAST(finished_us AS STRING), ',"phase":"', phase, '","started":', CAST(started_us AS STRING), ',"v":1}') FROM d_canary"""


# Rows as they are after some have been tampered with: items and a canary changed, one row gone, one there twice.
def _log_row_now(d: Dialect) -> str:
    return """
SELECT log_id, part, CASE WHEN part = 'items' AND canonical LIKE '%"case":"11","finished":%' AND log_id % 4 = 1 THEN replace(canonical, '"v":1', '"v": 1')
  WHEN part = 'canaries' AND canonical LIKE '{"canary":0,%"phase":"end"%' AND log_id % 3 = 2 THEN replace(canonical, '"end"', '"END"') ELSE canonical END AS canonical
FROM d_log_row WHERE NOT (part = 'items' AND log_id % 5 = 3 AND canonical LIKE '%"case":"7",%')
UNION ALL SELECT log_id, part, canonical FROM d_log_row WHERE log_id % 5 = 4 AND part = 'items' AND canonical LIKE '%"case":"3",%'"""


register_view("d_log_row", _log_row)
register_view("d_log_row_now", _log_row_now)

_PART_SEAL = """
n0 AS (SELECT log_id, part, concat(sha256(canonical), ':', CAST(count(*) AS STRING)) AS node FROM {rows} r GROUP BY log_id, part, sha256(canonical)),
n1 AS (SELECT log_id, part, concat(left(node, 8), ':', sha256(string_agg(node, ',' ORDER BY node))) AS node FROM n0 GROUP BY log_id, part, left(node, 8)),
n2 AS (SELECT log_id, part, concat(left(node, 4), ':', sha256(string_agg(node, ',' ORDER BY node))) AS node FROM n1 GROUP BY log_id, part, left(node, 4)),
b AS (SELECT log_id, part, concat('"', sha256(string_agg(node, ',' ORDER BY node)), '"') AS body FROM n2 GROUP BY log_id, part)"""


@query(
    "log_seal",
    f"""
WITH {_PART_SEAL.strip().format(rows="d_log_row")}
SELECT s.log_id, 'tree@2' AS version, concat('sha256:', sha256(concat('{{"canaries":[', coalesce(c.body, ''), '],"items":[', coalesce(i.body, ''), '],"started":', started, '}}'))) AS seal
FROM d_started s LEFT JOIN b i ON i.log_id = s.log_id AND i.part = 'items' LEFT JOIN b c ON c.log_id = s.log_id AND c.part = 'canaries'""",
)
def log_seal(g: Given) -> DataFrame:
    """Seals over items, canary calls and the started row."""
    return seals.seals(seals.nodes(g["d_log_row"]), g["d_started"], ["items", "canaries"])


@query(
    "seal_changes",
    """
WITH w AS (SELECT log_id, part, sha256(canonical) AS digest, count(*) AS was FROM d_log_row GROUP BY ALL), n AS (SELECT log_id, part, sha256(canonical) AS digest, count(*) AS now FROM d_log_row_now GROUP BY ALL)
SELECT coalesce(w.log_id, n.log_id) AS log_id, coalesce(w.part, n.part) AS part, coalesce(w.digest, n.digest) AS digest, coalesce(was, 0) AS was, coalesce(now, 0) AS now
FROM w FULL JOIN n ON n.log_id = w.log_id AND n.part = w.part AND n.digest = w.digest WHERE was IS DISTINCT FROM now""",
)
def seal_changes(g: Given) -> DataFrame:
    """Which rows changed since the logs were sealed, found from the trees' roots down."""
    checkpoint_dir(g.spark)
    trees = seals.nodes(g["d_log_row"]).withColumn("bucket", seals.bucket()).checkpoint()
    return seals.changes(trees, g["d_log_row_now"])


@query(
    "log_seal_mismatch",
    """
WITH w AS (SELECT log_id, part, canonical, count(*) AS n FROM d_log_row GROUP BY ALL), n AS (SELECT log_id, part, canonical, count(*) AS n FROM d_log_row_now GROUP BY ALL)
SELECT DISTINCT 'warning' AS level, 'ledger.seal' AS code, 'rows changed after the log was sealed' AS message, CAST(coalesce(w.log_id, n.log_id) AS STRING) AS subject, CAST(coalesce(w.log_id, n.log_id) AS STRING) AS log_id
FROM w FULL JOIN n ON n.log_id = w.log_id AND n.part = w.part AND n.canonical = w.canonical WHERE w.n IS DISTINCT FROM n.n""",
)
def log_seal_mismatch(g: Given) -> DataFrame:
    """Logs that no longer match their seals over items and canary calls."""
    now = seals.seals(seals.nodes(g["d_log_row_now"]), g["d_started"], ["items", "canaries"])
    return ledger.seal_mismatches(kept(log_seal(g).select("log_id", "seal")), now)


@query(
    "run_log",
    """
WITH r AS (SELECT log_id, 0 AS part, concat('started ', started) AS line FROM d_started UNION ALL SELECT log_id, CASE part WHEN 'items' THEN 1 ELSE 2 END, canonical FROM d_log_row)
SELECT log_id, row_number() OVER (PARTITION BY log_id ORDER BY part, line) - 1 AS position, line FROM r""",
)
def run_log(g: Given) -> DataFrame:
    """Logs read back: the started row first, then the item rows and the canary rows in canonical order."""
    rows = g["d_log_row"]
    parts = [rows.where(F.col("part") == p).select("log_id", "canonical") for p in ("items", "canaries")]
    return store.read_log(g["d_started"].select("log_id", "started"), *parts)


# ------------------------------------------------------------------------------ whitespace


_TOKENS = """
SELECT user_id AS call_id, event_id AS seq, event_type IN ('view', 'click') AS blank, 1 + event_id % 3 AS tokens FROM events"""


@query(
    "whitespace_runs",
    f"""
WITH t AS ({_TOKENS}), i AS (SELECT *, sum(CASE WHEN blank THEN 0 ELSE 1 END) OVER (PARTITION BY call_id ORDER BY seq) AS island FROM t),
n AS (SELECT call_id, island, sum(CASE WHEN blank THEN tokens ELSE 0 END) AS run FROM i GROUP BY call_id, island)
SELECT call_id, CAST(max(run) AS BIGINT) AS longest, max(run) >= 15 AS cut FROM n GROUP BY call_id""",
)
def whitespace_runs(g: Given) -> DataFrame:
    return windows.longest_runs(g.sql(_TOKENS), "call_id", "seq", "blank", "tokens", 15).select("call_id", "longest", "cut")
