"""Queries that select from JSON answers: the documents' fields as structured answers and the
conversations as model responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import responses, selectors
from .registry import query
from .tables import Dialect, Given, register_view


def _plan(d: Dialect) -> str:
    """An answer per document: lists, nested members, nulls, and members that may be missing."""
    return """
SELECT doc_id, source, concat('{"diagnoses":[{"diagnosis":"', lang, '","critical":', CASE doc_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'null' END, ',"rank":', CAST(doc_id % 4 AS STRING),
  '},{"diagnosis":"', source, '"', CASE WHEN doc_id % 2 = 0 THEN ',"critical":true' ELSE '' END, ',"rank":1}', CASE WHEN doc_id % 5 = 0 THEN ',{"diagnosis":"PE","critical":1}' ELSE '' END,
  '],"acute_warning":', CASE WHEN doc_id % 4 = 0 THEN 'null' ELSE concat('"w', CAST(doc_id % 7 AS STRING), '"') END,
  ',"management":{"z":', CAST(doc_id AS STRING), ',"disposition":"admit', CAST(doc_id % 3 AS STRING), '","a":"', lang, '"}',
  CASE WHEN doc_id % 6 = 0 THEN '' ELSE ',"a/b":[10,[20,30]]' END, '}') AS plan FROM documents"""


register_view("d_plan", _plan)


def _picked(g: Given, chosen: list[str]) -> DataFrame:
    """Each selector's picks in order, one row each, every document parsed once."""
    parsed = g["d_plan"].select("doc_id", "plan", F.parse_json("plan").alias("v"))
    columns = F.array(
        *[F.struct(F.lit(s).alias("selector"), selectors.select(F.col("v"), s, F.col("plan")).alias("items")) for s in chosen]
    )
    rows = parsed.select("doc_id", F.explode(columns).alias("p"))
    return rows.select("doc_id", "p.selector", F.posexplode("p.items").alias("pos", "item")).select(
        "doc_id", "selector", "pos", F.to_json("item").alias("item")
    )


@query(
    "select_pointer",
    """
SELECT doc_id, '/management/disposition' AS selector, 0 AS pos, concat('"admit', CAST(doc_id % 3 AS STRING), '"') AS item FROM documents
UNION ALL SELECT doc_id, '/diagnoses/1/diagnosis', 0, concat('"', source, '"') FROM documents
UNION ALL SELECT doc_id, '/acute_warning', 0, CASE WHEN doc_id % 4 = 0 THEN 'null' ELSE concat('"w', CAST(doc_id % 7 AS STRING), '"') END FROM documents
UNION ALL SELECT doc_id, '/a~1b/1/0', 0, '20' FROM documents WHERE doc_id % 6 <> 0""",
)
def select_pointer(g: Given) -> DataFrame:
    return _picked(g, ["/management/disposition", "/diagnoses/1/diagnosis", "/diagnoses/01", "/acute_warning", "/a~1b/1/0", "/missing/deeper"])


@query(
    "select_index",
    """
SELECT doc_id, '$.diagnoses[-1].diagnosis' AS selector, 0 AS pos, CASE WHEN doc_id % 5 = 0 THEN '"PE"' ELSE concat('"', source, '"') END AS item FROM documents
UNION ALL SELECT doc_id, '$.diagnoses[2].critical', 0, '1' FROM documents WHERE doc_id % 5 = 0
UNION ALL SELECT doc_id, '$[''management'']["a"]', 0, concat('"', lang, '"') FROM documents
UNION ALL SELECT doc_id, '$.diagnoses[-3].rank', 0, CAST(doc_id % 4 AS STRING) FROM documents WHERE doc_id % 5 = 0""",
)
def select_index(g: Given) -> DataFrame:
    return _picked(g, ["$.diagnoses[-1].diagnosis", "$.diagnoses[2].critical", "$['management'][\"a\"]", "$.diagnoses[-3].rank"])


@query(
    "select_wild",
    """
SELECT doc_id, '$.diagnoses[*].diagnosis' AS selector, 0 AS pos, concat('"', lang, '"') AS item FROM documents
UNION ALL SELECT doc_id, '$.diagnoses[*].diagnosis', 1, concat('"', source, '"') FROM documents
UNION ALL SELECT doc_id, '$.diagnoses[*].diagnosis', 2, '"PE"' FROM documents WHERE doc_id % 5 = 0
UNION ALL SELECT doc_id, '$.management.*', 0, CAST(doc_id AS STRING) FROM documents
UNION ALL SELECT doc_id, '$.management.*', 1, concat('"admit', CAST(doc_id % 3 AS STRING), '"') FROM documents
UNION ALL SELECT doc_id, '$.management.*', 2, concat('"', lang, '"') FROM documents""",
)
def select_wild(g: Given) -> DataFrame:
    return _picked(g, ["$.diagnoses[*].diagnosis", "$.management.*"])


@query(
    "select_below_wildcards",
    """
SELECT doc_id, '$.*.*' AS selector, 0 AS pos, concat('{"critical":', CASE doc_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'null' END, ',"diagnosis":"', lang, '","rank":', CAST(doc_id % 4 AS STRING), '}') AS item FROM documents
UNION ALL SELECT doc_id, '$.*.*', 1, concat('{', CASE WHEN doc_id % 2 = 0 THEN '"critical":true,' ELSE '' END, '"diagnosis":"', source, '","rank":1}') FROM documents
UNION ALL SELECT doc_id, '$.*.*', 2, '{"critical":1,"diagnosis":"PE"}' FROM documents WHERE doc_id % 5 = 0
UNION ALL SELECT doc_id, '$.*.*', CASE WHEN doc_id % 5 = 0 THEN 3 ELSE 2 END + k.n, CASE k.n WHEN 0 THEN CAST(doc_id AS STRING) WHEN 1 THEN concat('"admit', CAST(doc_id % 3 AS STRING), '"') ELSE concat('"', lang, '"') END FROM documents CROSS JOIN (SELECT unnest([0, 1, 2]) AS n) k
UNION ALL SELECT doc_id, '$.*.*', CASE WHEN doc_id % 5 = 0 THEN 6 ELSE 5 END + k.n, CASE k.n WHEN 0 THEN '10' ELSE '[20,30]' END FROM documents CROSS JOIN (SELECT unnest([0, 1]) AS n) k WHERE doc_id % 6 <> 0
UNION ALL SELECT doc_id, '$.diagnoses[?@.critical == true].*', p.pos, p.item FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN [concat('"', lang, '"'), 'true', CAST(doc_id % 4 AS STRING)] ELSE [] END || CASE WHEN doc_id % 2 = 0 THEN [concat('"', source, '"'), 'true', '1'] ELSE [] END AS found FROM documents) d,
  LATERAL (SELECT unnest(range(len(d.found))) AS pos, unnest(d.found) AS item) p""",
)
def select_below_wildcards(g: Given) -> DataFrame:
    """Members of what a wildcard or a filter picked, in the document's order."""
    return _picked(g, ["$.*.*", "$.diagnoses[?@.critical == true].*"])


@query(
    "select_exists",
    """
SELECT doc_id, '$.diagnoses[?@.critical].diagnosis' AS selector, 0 AS pos, concat('"', lang, '"') AS item FROM documents
UNION ALL SELECT doc_id, '$.diagnoses[?@.critical].diagnosis', 1, concat('"', source, '"') FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, '$.diagnoses[?@.critical].diagnosis', CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END, '"PE"' FROM documents WHERE doc_id % 5 = 0""",
)
def select_exists(g: Given) -> DataFrame:
    return _picked(g, ["$.diagnoses[?@.critical].diagnosis"])


@query(
    "select_compare",
    """
WITH d AS (SELECT doc_id, unnest([{'n': 0, 'name': lang, 'critical': CASE doc_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'null' END, 'rank': CAST(doc_id % 4 AS STRING), 'here': true},
  {'n': 1, 'name': source, 'critical': CASE WHEN doc_id % 2 = 0 THEN 'true' END, 'rank': '1', 'here': true}, {'n': 2, 'name': 'PE', 'critical': '1', 'rank': NULL, 'here': doc_id % 5 = 0}], recursive := true) FROM documents),
s AS (SELECT doc_id, '$.diagnoses[?@.critical == true].diagnosis' AS selector, n, name FROM d WHERE here AND critical = 'true'
UNION ALL SELECT doc_id, '$.diagnoses[?@.critical != true].diagnosis', n, name FROM d WHERE here AND critical IS DISTINCT FROM 'true'
UNION ALL SELECT doc_id, '$.diagnoses[?@.rank == 1.0].diagnosis', n, name FROM d WHERE here AND rank = '1'
UNION ALL SELECT doc_id, '$.diagnoses[?@.critical == null].diagnosis', n, name FROM d WHERE here AND critical = 'null'
UNION ALL SELECT doc_id, '$.diagnoses[?@.diagnosis == ''PE''].diagnosis', n, name FROM d WHERE here AND name = 'PE')
SELECT doc_id, selector, CAST(row_number() OVER (PARTITION BY doc_id, selector ORDER BY n) - 1 AS INTEGER) AS pos, concat('"', name, '"') AS item FROM s""",
)
def select_compare(g: Given) -> DataFrame:
    return _picked(
        g,
        [
            "$.diagnoses[?@.critical == true].diagnosis", "$.diagnoses[?@.critical != true].diagnosis",
            "$.diagnoses[?@.rank == 1.0].diagnosis", "$.diagnoses[?@.critical == null].diagnosis",
            "$.diagnoses[?@.diagnosis == 'PE'].diagnosis",
        ],
    )


# ----------------------------------------------------------------------------- responses


def _response(d: Dialect) -> str:
    """A model response per order, with calls of which some are malformed."""
    key, cust = "CAST(o_orderkey AS STRING)", "CAST(o_custkey AS STRING)"
    return f"""
SELECT o_orderkey, o_custkey, CASE o_orderkey % 3 WHEN 0 THEN 'native' WHEN 1 THEN 'tool' ELSE 'text' END AS contract,
  concat('{{"id":"r', {key}, '"', CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN ',"model":7' ELSE concat(',"model":"m', CAST(o_custkey % 9 AS STRING), '"') END,
  ',"choices":[{{"index":0,"message":{{"role":"assistant","content":', CASE WHEN o_orderkey % 7 = 0 THEN 'null' WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 4 = 0 THEN '"not json"' ELSE concat('"{{\\"ddx\\": [', {cust}, ']}}"') END ELSE concat('"plain ', {cust}, '"') END,
  ',"tool_calls":[{{"id":"a","function":{{"name":"look","arguments":"{{}}"}}}},{{"id":', CASE WHEN o_orderkey % 2 = 0 THEN '1' ELSE '"b"' END, ',"function":{{"name":"answer","arguments":"{{\\"n\\":', {cust}, '}}"}}}}]}}}}]',
  CASE WHEN o_orderkey % 4 = 1 THEN '' ELSE concat(',"prompt_token_ids":[1, ', {cust}, ',', {key}, ']') END, ',"system_fingerprint":', CASE WHEN o_orderkey % 6 = 0 THEN 'null' ELSE '"fp"' END, '}}') AS response FROM orders"""


def _response_view(d: Dialect) -> str:
    # Spark reads a doubled backslash in a literal as one; DuckDB reads it as written.
    text = _response(d)
    return text.replace("\\", "\\\\") if d.spark else text


register_view("d_response", _response_view)


@query(
    "tool_calls",
    """
SELECT o_orderkey, 0 AS pos, 'a' AS id, 'look' AS name, '{}' AS arguments FROM orders
UNION ALL SELECT o_orderkey, 1, 'b', 'answer', concat('{"n":', CAST(o_custkey AS STRING), '}') FROM orders WHERE o_orderkey % 2 <> 0""",
)
def tool_calls(g: Given) -> DataFrame:
    calls = responses.tool_calls(F.parse_json("response"))
    return g["d_response"].select("o_orderkey", F.posexplode(calls).alias("pos", "c")).select("o_orderkey", "pos", "c.*")


@query(
    "returned_model",
    """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 1 THEN concat('m', CAST(o_custkey % 9 AS STRING)) END AS model, CASE WHEN o_orderkey % 6 <> 0 THEN 'fp' END AS system_fingerprint FROM orders""",
)
def returned_model(g: Given) -> DataFrame:
    parsed = g["d_response"].select("o_orderkey", F.parse_json("response").alias("v"))
    return parsed.select(
        "o_orderkey", responses.returned_model(F.col("v")).alias("model"), responses.system_fingerprint(F.col("v")).alias("system_fingerprint")
    )


@query(
    "parse_answers",
    """
SELECT o_orderkey, CASE o_orderkey % 3
  WHEN 0 THEN CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 4 = 0 THEN NULL ELSE concat('{"ddx":[', CAST(o_custkey AS STRING), ']}') END
  WHEN 1 THEN CASE WHEN o_orderkey % 2 <> 0 THEN concat('{"n":', CAST(o_custkey AS STRING), '}') END
  ELSE CASE WHEN o_orderkey % 7 <> 0 THEN concat('"plain ', CAST(o_custkey AS STRING), '"') END END AS answer FROM orders""",
)
def parse_answers(g: Given) -> DataFrame:
    found = responses.answer(F.parse_json("response"), F.col("contract"), F.lit("answer"))
    return g["d_response"].select("o_orderkey", F.to_json(found).alias("answer"))


@query(
    "token_fingerprint",
    """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 1 THEN sha256(concat('[1,', CAST(o_custkey AS STRING), ',', CAST(o_orderkey AS STRING), ']')) END AS hex, false AS kept FROM orders""",
)
def token_fingerprint(g: Given) -> DataFrame:
    return g["d_response"].select(
        "o_orderkey",
        responses.token_fingerprint(F.col("response")).alias("hex"),
        F.contains(responses.without_tokens(F.parse_json("response")), F.lit("prompt_token_ids")).alias("kept"),
    )


_BODY = """
SELECT o_orderkey, concat('{"model":"m', CAST(o_custkey AS STRING), '","messages":[{"role":"user","content":"é"}],"extra":{"z":1,"a":', CAST(o_orderkey AS STRING), '.50}}') AS body FROM orders"""


@query(
    "request_fingerprint",
    """
SELECT o_orderkey, sha256(concat('{"extra":{"z":1,"a":', CAST(o_orderkey AS STRING), '.5},"messages":[{"role":"user","content":"é"}],"model":"m', CAST(o_custkey AS STRING), '"}')) AS hex FROM orders""",
)
def request_fingerprint(g: Given) -> DataFrame:
    return g.sql(_BODY).select("o_orderkey", responses.request_fingerprint(F.col("body")).alias("hex"))
