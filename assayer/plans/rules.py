"""Queries that apply rules to configuration tables and logs' rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, rules
from .components import LEVELS
from .registry import query
from .tables import Dialect, Given, register_view

NONE = "CAST(NULL AS STRING)"

_PIN_MODELS = "SELECT p_partkey AS digest, CASE WHEN p_size % 2 = 0 THEN left(sha1(p_name), 40) ELSE p_brand END AS revision FROM part"
_PIN_ENGINES = "SELECT s_suppkey AS digest, CASE WHEN s_nationkey % 2 = 0 THEN concat('/nix/store/', left(sha1(s_name), 32), '-', 'vllm') ELSE s_name END AS closure FROM supplier"
_PIN_SCORERS = "SELECT c_custkey AS digest, CASE WHEN c_nationkey % 3 <> 0 THEN c_mktsegment END AS revision FROM customer"


@query(
    "lint_pins",
    f"""
SELECT 'warning' AS level, 'model.revision' AS code, concat('revision ''', revision, ''' is not a commit and can move') AS message, CAST(digest AS STRING) AS subject, {NONE} AS log_id FROM ({_PIN_MODELS}) m WHERE NOT regexp_full_match(revision, '[0-9a-f]{{40}}')
UNION ALL SELECT 'warning', 'engine.closure', concat('closure ''', closure, ''' is not a Nix store path'), CAST(digest AS STRING), NULL FROM ({_PIN_ENGINES}) e WHERE NOT closure LIKE '/nix/store/%'
UNION ALL SELECT 'warning', 'scorer.revision', 'scorer code has no revision', CAST(digest AS STRING), NULL FROM ({_PIN_SCORERS}) s WHERE revision IS NULL""",
)
def lint_pins(g: Given) -> DataFrame:
    return rules.lint_pins(g.sql(_PIN_MODELS), g.sql(_PIN_ENGINES), g.sql(_PIN_SCORERS))


def _template(d: Dialect) -> str:
    return f"""
SELECT doc_id AS digest, CASE WHEN doc_id % 9 = 0 THEN {d.sha('lang')} ELSE {d.sha('template')} END AS chat_template, template
FROM (SELECT doc_id, lang, concat(text, CASE doc_id % 13 WHEN 1 THEN ' strftime_now ' WHEN 2 THEN ' {{{{ now () }}}}' WHEN 3 THEN ' nowadays(' ELSE '' END) AS template FROM documents) t"""


register_view("d_template", _template)


@query(
    "lint_templates",
    f"""
SELECT 'warning' AS level, 'engine.chat_template' AS code, 'chat template does not match the declared digest' AS message, CAST(digest AS STRING) AS subject, {NONE} AS log_id FROM d_template WHERE sha256(template) <> chat_template
UNION ALL SELECT 'warning', 'engine.chat_template_date', 'chat template reads the current date', CAST(digest AS STRING), NULL FROM d_template WHERE digest % 13 IN (1, 2)""",
)
def lint_templates(g: Given) -> DataFrame:
    return rules.lint_templates(g["d_template"])


def _pair(d: Dialect) -> str:
    """Pairs of skeleton and engine, one per order."""
    argv = "array({0})" if d.spark else "[{0}]"
    some = argv.format("'serve', '--reasoning_parser=x', '--enable_auto-tool-choice'")
    tools = argv.format("'--enable-auto-tool-choice', '--tool-call-parser', 'y'")
    quiet = argv.format("'--default_chat_template_kwargs', 'z'")
    return f"""
SELECT o_orderkey AS subject, CASE o_orderkey % 3 WHEN 0 THEN 'native' WHEN 1 THEN 'tool' ELSE 'text' END AS contract,
  CASE o_custkey % 4 WHEN 0 THEN CAST(0.001 AS DOUBLE) WHEN 1 THEN CAST(0 AS DOUBLE) WHEN 2 THEN CAST(0.7 AS DOUBLE) END AS temperature,
  o_custkey % 5 = 0 AS has_budget, o_orderkey % 3 = 1 OR o_custkey % 6 = 0 AS has_tools, o_custkey % 6 = 0 AS has_toolset, 'auto' AS tool_choice,
  CASE o_custkey % 7 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS enable_thinking, CASE o_custkey % 8 WHEN 0 THEN 'none' WHEN 1 THEN 'low' END AS effort,
  o_custkey % 9 = 0 AS schema_has_ref, CASE WHEN o_orderkey % 10 = 0 THEN 'other' ELSE 'vllm' END AS server, CASE WHEN o_orderkey % 11 = 0 THEN '0.25.1' ELSE '0.24.0' END AS version,
  CASE o_orderkey % 4 WHEN 0 THEN {some} WHEN 1 THEN {tools} WHEN 2 THEN {quiet} ELSE {argv.format("'serve'")} END AS argv,
  o_orderkey % 4 IN (0, 1) AS auto_choice, o_orderkey % 4 = 1 AS call_parser, o_orderkey % 4 = 0 AS parser, o_orderkey % 4 = 2 AS kwargs_flag,
  CASE o_custkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS by_default FROM orders"""


register_view("d_pair", _pair)


@query(
    "lint_pairs",
    f"""
WITH p AS (SELECT *, server = 'vllm' AND version LIKE '0.24.%' AS k, contract <> 'text' AS c, has_tools AND NOT (auto_choice AND call_parser) AS refused,
  CASE WHEN enable_thinking = false OR effort = 'none' THEN false WHEN enable_thinking = true OR effort IS NOT NULL OR has_budget THEN true WHEN NOT kwargs_flag THEN by_default END AS reasons FROM d_pair),
f AS (SELECT subject, 'schema.ref_unverified' AS code, 'the schema has $ref, which this engine isn''t known to resolve; inline_refs@1 removes them' AS message, 'warning' AS level FROM p WHERE NOT k AND c AND schema_has_ref
UNION ALL SELECT subject, 'vllm.temperature_clamped', 'vLLM 0.24 raises temperature 0.001 to 0.01', 'warning' FROM p WHERE k AND temperature > 0 AND temperature < 0.01
UNION ALL SELECT subject, 'vllm.thinking_budget_refused', 'vLLM 0.24 refuses thinking_token_budget without --reasoning-parser or --reasoning-config', 'warning' FROM p WHERE k AND has_budget AND NOT parser
UNION ALL SELECT subject, 'vllm.tools_refused', 'vLLM 0.24 refuses tool_choice auto without --enable-auto-tool-choice and --tool-call-parser; for harmony and Mistral models it goes out unconstrained instead', 'warning' FROM p WHERE k AND refused
UNION ALL SELECT subject, 'vllm.native_tools_uncallable', 'with tool_choice auto, vLLM 0.24 constrains the whole answer to response_format, so no tool can be called', 'warning' FROM p WHERE k AND contract = 'native' AND has_toolset
UNION ALL SELECT subject, 'vllm.grammar_before_reasoning', 'without --reasoning-parser, vLLM 0.24 constrains the answer from its first token, so a model can''t reason first', CASE WHEN coalesce(reasons, false) THEN 'warning' ELSE 'info' END FROM p WHERE k AND c AND NOT refused AND NOT parser AND coalesce(reasons, true))
SELECT level, code, message, CAST(subject AS STRING) AS subject, {NONE} AS log_id FROM f""",
)
def lint_pairs(g: Given) -> DataFrame:
    return rules.lint_pairs(g.spread("d_pair"))


# --------------------------------------------------------------------------------- facts


def _facts(d: Dialect) -> str:
    make = "map({0})" if d.spark else "MAP {{{0}}}"
    pair = (lambda k, v: f"'{k}', {v}") if d.spark else (lambda k, v: f"'{k}': {v}")
    none = "CAST(NULL AS STRING)" if d.spark else "CAST(NULL AS VARCHAR)"
    refused = make.format(pair("native", f"CASE WHEN p_size % 3 = 0 THEN 'no schemas' ELSE {none} END"))
    note = make.format(", ".join([pair("native", f"CASE WHEN p_size % 2 = 0 THEN 'slow' ELSE {none} END"), pair("tool", f"CASE WHEN p_size % 5 = 0 THEN 'one at a time' ELSE {none} END")]))
    return f"SELECT p_partkey AS model, CASE WHEN p_size % 4 = 0 THEN 'no budget' END AS budget_refused, {refused} AS output_refused, {note} AS output_note FROM part WHERE p_partkey % 6 <> 0"


register_view("d_facts", _facts)

_WRITES = "SELECT p_partkey AS model, CASE WHEN p_size % 2 = 0 THEN 'low' END AS effort, CASE WHEN p_size % 3 = 0 THEN '{\"t\":true}' ELSE '{}' END AS kwargs FROM part WHERE p_partkey % 6 <> 0"
_ASKED = """
SELECT l_orderkey AS subject, l_partkey AS model, CASE WHEN l_linenumber % 3 = 0 THEN 'low' END AS effort, CASE WHEN l_linenumber % 4 = 0 THEN '{"t":true}' END AS kwargs,
  l_suppkey % 5 = 0 AS has_budget, CASE l_returnflag WHEN 'A' THEN 'native' WHEN 'N' THEN 'tool' ELSE 'text' END AS contract FROM lineitem"""


@query(
    "facts_checks",
    f"""
WITH j AS (SELECT a.*, f.model IS NOT NULL AS known, budget_refused, output_refused[contract] AS refused, output_note[contract] AS note, w.model IS NOT NULL AS matched
  FROM ({_ASKED}) a LEFT JOIN d_facts f ON f.model = a.model LEFT JOIN ({_WRITES}) w ON w.model = a.model AND coalesce(w.effort, '') = coalesce(a.effort, '') AND w.kwargs = coalesce(a.kwargs, '{{}}')),
r AS (SELECT subject, 'info' AS level, 'facts.missing' AS code, concat('no facts about ''', CAST(model AS STRING), ''', so model-level checks were skipped') AS message FROM j WHERE NOT known
UNION ALL SELECT subject, 'warning', 'facts.reasoning_unmatched', 'the skeleton''s reasoning settings match none of the model''s reasoning levels' FROM j WHERE known AND (effort IS NOT NULL OR kwargs IS NOT NULL) AND NOT matched
UNION ALL SELECT subject, 'warning', 'facts.budget_refused', budget_refused FROM j WHERE known AND has_budget AND budget_refused IS NOT NULL
UNION ALL SELECT subject, 'warning', 'facts.output_refused', refused FROM j WHERE known AND refused IS NOT NULL
UNION ALL SELECT subject, 'info', 'facts.output_note', note FROM j WHERE known AND refused IS NULL AND note IS NOT NULL)
SELECT level, code, message, CAST(subject AS STRING) AS subject, {NONE} AS log_id FROM r""",
)
def facts_checks(g: Given) -> DataFrame:
    return rules.facts_checks(g.sql(_ASKED), g["d_facts"], g.sql(_WRITES))


_SAMPLED = """
SELECT o_orderkey AS subject, concat('m', CAST(o_custkey % 15 AS STRING)) AS model, CASE WHEN o_custkey % 8 <> 0 THEN concat('{"temperature":0.', CAST(o_custkey % 20 + 1 AS STRING), '}') END AS sampling FROM orders"""
_RECOMMENDED = "SELECT DISTINCT concat('m', CAST(s_suppkey % 12 AS STRING)) AS model, concat('{\"temperature\":0.', CAST(s_nationkey % 20 + 1 AS STRING), '}') AS sampling FROM supplier"


@query(
    "sampling_unmatched",
    f"""
WITH r AS (SELECT sampling, string_agg(DISTINCT model, ', ' ORDER BY model) AS models, list(model) AS ms FROM ({_RECOMMENDED}) x GROUP BY sampling)
SELECT 'warning' AS level, 'facts.sampling_unmatched' AS code, concat('the skeleton''s sampling is what the facts recommend for ', models, ', not for ', p.model) AS message, CAST(subject AS STRING) AS subject, {NONE} AS log_id
FROM ({_SAMPLED}) p JOIN r ON r.sampling = p.sampling WHERE NOT list_contains(ms, p.model)""",
)
def sampling_unmatched(g: Given) -> DataFrame:
    return rules.sampling_unmatched(g.sql(_SAMPLED), g.sql(_RECOMMENDED))


_LEVEL_FACTS = """
SELECT model, level, CASE WHEN model % 5 = 0 THEN NULL ELSE level END AS effort, CASE WHEN model % 7 = 0 THEN 'this level is refused' END AS refused FROM d_level WHERE next IS NULL AND model % 11 <> 0"""
_LEVEL_SAMPLING = "SELECT model, level, concat('{\"top_k\":', CAST(model AS STRING), '}') AS sampling FROM d_level WHERE level IN ('off', 'low', 'high', 'default')"


@query(
    "model_settings",
    f"""
WITH RECURSIVE walk AS (SELECT model, level, level AS landed, 0 AS hops FROM d_level
  UNION ALL SELECT w.model, w.level, l.next, hops + 1 FROM walk w JOIN d_level l ON l.model = w.model AND l.level = w.landed WHERE l.next IS NOT NULL AND hops < 9),
last AS (SELECT model, level, max(hops) AS hops, arg_max(landed, hops) AS landed FROM walk GROUP BY model, level),
j AS (SELECT l.model, l.level, landed, hops = 9 AS round, f.model IS NOT NULL AS has_fact, f.refused, f.effort, s.sampling FROM last l LEFT JOIN ({_LEVEL_FACTS}) f ON hops < 9 AND f.model = l.model AND f.level = landed LEFT JOIN ({_LEVEL_SAMPLING}) s ON hops < 9 AND s.model = l.model AND s.level = landed),
k AS (SELECT *, CASE WHEN round THEN 'the collapses go round' WHEN NOT has_fact THEN concat('nothing is known about reasoning ''', landed, '''') WHEN refused IS NOT NULL THEN refused WHEN sampling IS NULL THEN concat('no sampling is recommended for reasoning ''', landed, '''') END AS why FROM j)
SELECT model, level, why AS refused, CASE WHEN why IS NULL THEN effort END AS effort, CASE WHEN why IS NULL THEN sampling END AS sampling FROM k""",
)
def model_settings(g: Given) -> DataFrame:
    landed = graph.land(g["d_level"], LEVELS)
    return rules.model_settings(landed, g.sql(_LEVEL_FACTS), g.sql(_LEVEL_SAMPLING))


_DEFAULTS = "SELECT p_partkey AS model, CASE WHEN p_partkey % 6 = 0 THEN NULL WHEN p_size % 3 = 0 THEN 'off' WHEN p_size % 3 = 1 THEN 'low' ELSE 'high' END AS level FROM part"


@query(
    "default_settings",
    f"""
WITH RECURSIVE walk AS (SELECT model, level, level AS landed, 0 AS hops FROM d_level
  UNION ALL SELECT w.model, w.level, l.next, hops + 1 FROM walk w JOIN d_level l ON l.model = w.model AND l.level = w.landed WHERE l.next IS NOT NULL AND hops < 9),
last AS (SELECT model, level, max(hops) AS hops, arg_max(landed, hops) AS landed FROM walk GROUP BY model, level),
j AS (SELECT d.model, d.level, landed, hops, f.model IS NOT NULL AS has_fact, f.refused, f.effort, s.sampling FROM ({_DEFAULTS}) d LEFT JOIN last l ON l.model = d.model AND l.level = d.level
  LEFT JOIN ({_LEVEL_FACTS}) f ON hops < 9 AND f.model = d.model AND f.level = landed LEFT JOIN ({_LEVEL_SAMPLING}) s ON hops < 9 AND s.model = d.model AND s.level = landed),
k AS (SELECT *, CASE WHEN level IS NULL THEN 'no default reasoning level is known' WHEN hops = 9 THEN 'the collapses go round' WHEN NOT has_fact THEN concat('nothing is known about reasoning ''', landed, '''') ELSE refused END AS no FROM j),
w AS (SELECT *, CASE WHEN no IS NULL AND sampling IS NULL THEN concat('no sampling is recommended for reasoning ''', landed, '''') ELSE no END AS why FROM k)
SELECT model, level, why AS refused, CASE WHEN why IS NULL THEN effort END AS effort, CASE WHEN why IS NULL THEN sampling END AS sampling, CASE WHEN no IS NULL THEN landed <> 'off' END AS reasons FROM w""",
)
def default_settings(g: Given) -> DataFrame:
    """What models do when no reasoning level is asked for, and whether they reason then."""
    landed = graph.land(g["d_level"], LEVELS)
    return rules.default_settings(rules.resolved(landed, g.sql(_LEVEL_FACTS), g.sql(_LEVEL_SAMPLING)), g.sql(_DEFAULTS))


# ------------------------------------------------------------------------------ clearance

_SENT = """
SELECT run, concat('ep', CAST(run % 4 AS STRING)) AS endpoint, concat('engine', CAST(run % 4 AS STRING)) AS served_engine, concat('engine', CAST(CASE WHEN run % 9 = 8 THEN 7 ELSE run % 4 END AS STRING)) AS engine, run % 6 = 0 AS has_tools FROM d_run"""
_RUN_SOURCES = "SELECT c.run, d.source FROM d_call c JOIN documents d ON d.doc_id = c.case_id"
_SOURCES = "SELECT DISTINCT source, CAST(substr(source, 4) AS INT) % 3 = 0 AS sensitive FROM documents"
_CLEARED = "SELECT DISTINCT source, concat('ep', CAST(CAST(substr(source, 4) AS INT) % 4 AS STRING)) AS endpoint FROM documents"


@query(
    "clearance_audit",
    f"""
WITH r AS ({_SENT}), s AS (SELECT DISTINCT r.*, c.source FROM r JOIN ({_RUN_SOURCES}) c ON c.run = r.run JOIN ({_SOURCES}) x ON x.source = c.source WHERE sensitive)
SELECT 'error' AS level, 'gate.engine' AS code, concat('endpoint ''', endpoint, ''' serves engine ', served_engine, ', the trial''s is ', engine) AS message, {NONE} AS subject, CAST(run AS STRING) AS log_id FROM r WHERE served_engine <> engine
UNION ALL SELECT 'error', 'gate.uncleared', concat('endpoint ''', s.endpoint, ''' isn''t cleared for source ', s.source, ', which is sensitive'), s.source, CAST(run AS STRING) FROM s ANTI JOIN ({_CLEARED}) c ON c.source = s.source AND c.endpoint = s.endpoint
UNION ALL SELECT 'error', 'gate.tools', concat('the skeleton''s tools would get content from source ', source, ', which is sensitive, and tools can''t be cleared yet'), source, CAST(run AS STRING) FROM s WHERE has_tools""",
)
def clearance_audit(g: Given) -> DataFrame:
    # Only which sources a run has matters, so cases are reduced before they meet documents.
    cases = g["d_call"].select("run", "case_id").distinct()
    sources = g["documents"].select(F.col("doc_id").alias("case_id"), "source")
    return rules.clearance(g.sql(_SENT), cases.join(sources, "case_id"), g.sql(_SOURCES), g.sql(_CLEARED))


_SHAPED = """
SELECT o_orderkey, concat('{"pattern":', CASE o_orderkey % 4 WHEN 0 THEN '7' ELSE '"the"' END, CASE WHEN o_custkey % 3 = 0 THEN '' ELSE ',"kind":"ddx"' END,
  CASE WHEN o_custkey % 5 = 0 THEN ',"kind2":1' ELSE '' END, ',"grade":"', CASE WHEN o_custkey % 7 = 0 THEN 'x' ELSE 'a' END, '"}') AS data FROM orders"""


@query(
    "expectation_shape",
    """
SELECT o_orderkey, 'pattern is STRING here, not BIGINT' AS problem FROM orders WHERE o_orderkey % 4 = 0
UNION ALL SELECT o_orderkey, 'kind is required' FROM orders WHERE o_custkey % 3 = 0
UNION ALL SELECT o_orderkey, 'kind2 is not known' FROM orders WHERE o_custkey % 5 = 0
UNION ALL SELECT o_orderkey, 'grade may not be ''x''' FROM orders WHERE o_custkey % 7 = 0""",
)
def expectation_shape(g: Given) -> DataFrame:
    fields = {"pattern": ("STRING", True), "kind": ("STRING", True), "grade": ("STRING", False)}
    rows = g.sql(_SHAPED).withColumn("document", F.parse_json("data"))
    return rules.shape(rows, "document", "data", fields, {"grade": ["a", "b"]}).select("o_orderkey", "problem")


@query(
    "redacted_export",
    """
SELECT 'run_stage' AS row_type, CAST(run AS STRING) AS log_id, concat('{"declared_model":"', declared_model, '","run":', CAST(run AS STRING), ',"started_us":', CAST(started_us AS STRING), '}') AS payload FROM d_run
UNION ALL SELECT 'canary_call', CAST(run AS STRING), concat('{"canary":', CAST(canary AS STRING), ',"phase":"', phase, '","run":', CAST(run AS STRING), ',"started_us":', CAST(started_us AS STRING), '}') FROM d_canary""",
)
def redacted_export(g: Given) -> DataFrame:
    """Items stay; stages and canaries go, without what was derived from cases."""
    return rules.redacted_export(
        {
            "run_stage": (g["d_run"].select("run", "declared_model", "started_us", "n_cases"), "run", ["n_cases"]),
            "run_item": (g["d_call"], "run", []),
            "canary_call": (g["d_canary"], "run", ["finished_us"]),
        }
    )
