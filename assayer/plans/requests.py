"""Queries that lay out configurations and render requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ledger, requests
from .registry import query
from .tables import Given

# ---------------------------------------------------------------------------- configuration

_RECIPES = "SELECT DISTINCT o_custkey AS recipe, concat('part', CAST(o_orderkey % 12 AS STRING)) AS part FROM orders"
_MODELS = "SELECT DISTINCT concat('m', CAST(s_nationkey AS STRING)) AS model, s_nationkey % 4 <> 0 AS served, s_nationkey % 5 <> 0 AS known FROM supplier"
# Parts 6 to 11 have a variant per model, some of them refused; the others are shared.
_OWN = "SELECT concat('part', CAST(s_suppkey % 6 + 6 AS STRING)) AS part, concat('m', CAST(s_nationkey AS STRING)) AS model, max(CASE WHEN s_suppkey % 3 = 0 THEN 'refused' END) AS refused FROM supplier GROUP BY 1, 2"


@query(
    "config_grid",
    f"""
WITH rec AS ({_RECIPES}), mod AS ({_MODELS}), own AS ({_OWN}),
need AS (SELECT recipe, part FROM rec WHERE part IN (SELECT part FROM own)),
pm AS (SELECT DISTINCT n.recipe, o.model FROM need n JOIN own o ON o.part = n.part JOIN mod m ON m.model = o.model AND served AND known),
mi AS (SELECT p.recipe, p.model, string_agg(n.part, ', ' ORDER BY n.part) FILTER (o.part IS NULL) AS missing FROM pm p JOIN need n ON n.recipe = p.recipe LEFT JOIN own o ON o.part = n.part AND o.model = p.model AND o.refused IS NULL GROUP BY p.recipe, p.model)
SELECT recipe, model, CASE WHEN missing IS NOT NULL THEN concat('the facts refuse its ', missing) END AS skipped FROM mi
UNION ALL SELECT recipe, NULL, NULL FROM (SELECT DISTINCT recipe FROM rec) r ANTI JOIN need s ON s.recipe = r.recipe
UNION ALL SELECT NULL, model, CASE WHEN served THEN 'the facts don''t know it' ELSE 'no planned engine serves it' END FROM mod WHERE served <> known""",
)
def config_grid(g: Given) -> DataFrame:
    return requests.config_grid(g.sql(_RECIPES), g.sql(_MODELS), g.sql(_OWN))


# ------------------------------------------------------------------------------- rendering


@query(
    "render_requests",
    """
SELECT run, c.case_id AS case_id, s.replicate AS replicate, CASE WHEN c.case_id % 53 = 9 THEN 'no fill for vignette' END AS problem, CASE WHEN c.case_id % 53 <> 9 THEN concat('{"model":"', declared_model, '","messages":[{"role":"system","content":"Diagnose."},{"role":"user","content":"Case ', d.lang, '/', d.source, '\\nEnd"}],"temperature":', CASE WHEN run % 2 = 0 THEN '0' ELSE '0.7' END,
  CASE WHEN run % 2 = 0 THEN '' ELSE concat(',"seed":', CAST(100 + s.replicate AS STRING)) END, ',"return_token_ids":true}') END AS request
FROM d_run, LATERAL (SELECT unnest(range(0, n_cases)) AS case_id) c, LATERAL (SELECT unnest(range(0, n_seeds)) AS replicate) s JOIN documents d ON d.doc_id = c.case_id""",
)
def render_requests(g: Given) -> DataFrame:
    """The whole trial grid as request bodies, ready for a batch service."""
    cases = g["documents"].select(F.col("doc_id").alias("case_id"), F.when(F.col("doc_id") % 53 != 9, F.concat("lang", F.lit("/"), "source")).alias("vignette"))
    runs = g["d_run"].select("run", "declared_model")
    segment = lambda text=None, slot=None: F.struct(
        F.lit(text).cast("string").alias("text"), F.lit(slot).cast("string").alias("slot")
    )
    messages = F.array(
        F.struct(F.lit("system").alias("role"), F.array(segment("Diagnose.")).alias("segments")),
        F.struct(
            F.lit("user").alias("role"), F.array(segment("Case "), segment(slot="vignette"), segment("\nEnd")).alias("segments")
        ),
    )
    greedy = F.col("run") % 2 == 0
    rows = (
        ledger.grid(g["d_run"])
        .join(runs, "run")
        .join(cases, "case_id")
        .select(
            "run", "case_id", "replicate",
            messages.alias("messages"),
            F.create_map(F.lit("vignette"), F.col("vignette")).alias("fills"),
            F.col("declared_model").alias("model"),
            F.create_map(F.lit("temperature"), F.when(greedy, "0").otherwise("0.7")).alias("body"),
            greedy.alias("greedy"),
            (F.col("replicate") + 100).alias("seed"),
            F.lit(True).alias("return_token_ids"),
        )
    )
    return requests.render(rows).select("run", "case_id", "replicate", "request", "problem")


_SKELETON = """
SELECT o_orderkey AS recipe, CASE WHEN o_custkey % 4 = 0 THEN NULL WHEN o_custkey % 4 = 1 THEN 'Be brief. {output_guidance}' ELSE concat('Be kind to ', o_orderpriority) END AS instructions,
  CASE WHEN o_custkey % 2 = 0 THEN 'developer' ELSE 'system' END AS role, CASE WHEN o_custkey % 3 = 0 THEN 'Case: {vignette} {output_guidance}' ELSE 'Case: {vignette}' END AS prompt,
  CASE WHEN o_custkey % 5 <> 0 THEN 'Answer in JSON.' END AS output_guidance, CASE WHEN o_custkey % 7 = 0 THEN 'Use tools.' END AS tool_guidance FROM orders"""
_SHOTS = "SELECT l_orderkey AS recipe, CAST(l_linenumber AS BIGINT) * 1000000 + l_partkey AS position, CASE WHEN l_linenumber % 2 = 0 THEN 'assistant' ELSE 'user' END AS role, concat('shot ', CAST(l_partkey AS STRING)) AS content FROM lineitem"


@query(
    "assemble_messages",
    f"""
WITH s AS (SELECT *, coalesce(output_guidance, '') AS og, coalesce(tool_guidance, '') AS tg, contains(prompt, '{{output_guidance}}') AS inp, coalesce(contains(instructions, '{{output_guidance}}'), false) AS ini FROM ({_SKELETON}) x),
b AS (SELECT *, coalesce(replace(instructions, '{{output_guidance}}', og), '') AS base FROM s),
o AS (SELECT *, CASE WHEN og <> '' AND NOT inp AND NOT ini THEN CASE WHEN base = '' THEN og ELSE concat(base, chr(10), chr(10), og) END ELSE base END AS one FROM b),
t AS (SELECT *, CASE WHEN tg <> '' THEN CASE WHEN one = '' THEN tg ELSE concat(one, chr(10), chr(10), tg) END ELSE one END AS sys FROM o)
SELECT recipe, CAST(-1 AS BIGINT) AS position, CASE WHEN instructions IS NULL THEN 'system' ELSE role END AS role, sys AS content FROM t WHERE sys <> '' AND NOT (inp AND ini)
UNION ALL SELECT recipe, 2147483648, 'user', replace(prompt, '{{output_guidance}}', og) FROM t WHERE NOT (inp AND ini)
UNION ALL SELECT l.recipe, position, l.role, content FROM ({_SHOTS}) l SEMI JOIN (SELECT recipe FROM t WHERE NOT (inp AND ini)) k ON k.recipe = l.recipe
UNION ALL SELECT recipe, NULL, 'error', 'guidance is inserted in both the instructions and the prompt' FROM t WHERE inp AND ini""",
)
def assemble_messages(g: Given) -> DataFrame:
    return requests.assemble_messages(g.sql(_SKELETON), g.sql(_SHOTS))


_TEXTS = """
SELECT l_orderkey AS recipe, concat('part', CAST(l_linenumber AS STRING)) AS part, CASE WHEN l_partkey % 40 = 0 THEN ' ' ELSE concat('text ', CAST(l_partkey % 300 AS STRING)) END AS text,
  CASE WHEN l_orderkey % 3 <> 0 THEN CAST(l_orderkey % 3 AS STRING) END AS translations FROM lineitem"""
_ENTRIES = """
SELECT DISTINCT CAST(p_size % 2 + 1 AS STRING) AS translations, concat('text ', CAST(p_partkey % 300 AS STRING)) AS text, concat('översatt ', CAST(p_partkey % 300 AS STRING)) AS translation FROM part WHERE p_partkey % 300 < 280"""


@query(
    "missing_translations",
    f"SELECT DISTINCT recipe, t.text FROM ({_TEXTS}) t ANTI JOIN ({_ENTRIES}) e ON e.translations = t.translations AND e.text = t.text WHERE t.translations IS NOT NULL AND trim(t.text) <> ''",
)
def missing_translations(g: Given) -> DataFrame:
    return requests.missing_translations(g.sql(_TEXTS), g.sql(_ENTRIES))


@query(
    "translate_texts",
    f"""
SELECT recipe, part, t.text, CASE WHEN t.translations IS NULL OR trim(t.text) = '' THEN t.text ELSE translation END AS translated,
  t.translations IS NOT NULL AND trim(t.text) <> '' AND translation IS NULL AS missing FROM ({_TEXTS}) t LEFT JOIN ({_ENTRIES}) e ON e.translations = t.translations AND e.text = t.text""",
)
def translate_texts(g: Given) -> DataFrame:
    return requests.translated(g.sql(_TEXTS), g.sql(_ENTRIES))


@query(
    "next_requests",
    """
WITH m AS (SELECT o_orderkey AS item, o_custkey, o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'null' WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 4 = 0 THEN '"not json"' ELSE concat('"{\\"ddx\\": [', CAST(o_custkey AS STRING), ']}"') END ELSE concat('"plain ', CAST(o_custkey AS STRING), '"') END AS content,
  concat('[{"id":"a","function":{"name":"look","arguments":"{}"}},{"id":', CASE WHEN o_orderkey % 2 = 0 THEN '1' ELSE '"b"' END, ',"function":{"name":"answer","arguments":"{\\"n\\":', CAST(o_custkey AS STRING), '}"}}]') AS calls FROM orders)
SELECT item, CASE WHEN NOT (o_orderkey % 2 <> 0 AND o_custkey % 10 = 0) THEN concat('{"model":"m","messages":[{"role":"user","content":"hi"},{"role":"assistant","content":', content, ',"tool_calls":', calls, '},{"role":"tool","tool_call_id":"a","content":"saw ', CAST(o_custkey AS STRING), '"}',
  CASE WHEN o_orderkey % 2 <> 0 THEN concat(',{"role":"tool","tool_call_id":"b","content":"saw ', CAST(o_custkey AS STRING), '"}') ELSE '' END, '],"seed":1}') END AS request,
  CASE WHEN o_orderkey % 2 <> 0 AND o_custkey % 10 = 0 THEN 'no result for 1 tool calls' END AS problem FROM m""",
)
def next_requests(g: Given) -> DataFrame:
    rows = g["d_response"].select(
        F.col("o_orderkey").alias("item"),
        F.lit('{"model":"m",').alias("head"),
        F.array(F.lit('{"role":"user","content":"hi"}')).alias("messages"),
        F.lit(',"seed":1}').alias("tail"),
        "response",
    )
    seen = F.concat(F.lit("saw "), F.col("o_custkey").cast("string"))
    results = g["d_response"].select(
        F.col("o_orderkey").alias("item"),
        F.explode(F.when(F.col("o_custkey") % 10 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))).alias("id"),
        seen.alias("result"),
    )
    return requests.next_requests(rows, results)


@query(
    "greedy_sampling",
    """
WITH s AS (SELECT p_partkey, p_size % 3 AS temperature, p_size / 100 AS top_p, p_size AS top_k, CASE WHEN p_partkey % 2 = 0 THEN 0.05 END AS min_p FROM part)
SELECT p_partkey, CAST(temperature AS DOUBLE) AS temperature, CASE WHEN temperature <> 0 THEN top_p END AS top_p, CASE WHEN temperature <> 0 THEN top_k END AS top_k, CAST(CASE WHEN temperature <> 0 THEN min_p END AS DOUBLE) AS min_p FROM s""",
)
def greedy_sampling(g: Given) -> DataFrame:
    rows = g["part"].select(
        "p_partkey",
        (F.col("p_size") % 3).cast("double").alias("temperature"),
        (F.col("p_size") / 100).alias("top_p"),
        F.col("p_size").alias("top_k"),
        F.when(F.col("p_partkey") % 2 == 0, 0.05).alias("min_p"),
    )
    return requests.greedy_sampling(rows)
