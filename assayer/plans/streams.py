"""Queries over streamed answers: the conversations, taken as chunks of calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import chunks, events
from .registry import query
from .tables import Dialect, Given, register_view


@query(
    "assemble_chunks",
    """
SELECT call_id, 'assistant' AS role, string_agg(delta, '' ORDER BY seq) AS content,
  concat('[', concat_ws(',', CASE WHEN count(*) FILTER (seq % 3 = 0) > 0 THEN concat('{"id":"t0","type":"function","function":{"name":"look","arguments":"', string_agg(concat(CAST(seq AS STRING), ';'), '' ORDER BY seq) FILTER (seq % 3 = 0), '"}}') END,
    CASE WHEN count(*) FILTER (seq % 3 = 1) > 0 THEN concat('{"id":"t1","type":"function","function":{"name":"look","arguments":"', string_agg(concat(CAST(seq AS STRING), ';'), '' ORDER BY seq) FILTER (seq % 3 = 1), '"}}') END), ']') AS tool_calls,
  '"stop"' AS finish_reason, concat('{"tokens":', CAST(arg_max(tokens, seq) AS STRING), '}') AS usage
FROM d_chunk GROUP BY call_id""",
)
def assemble_chunks(g: Given) -> DataFrame:
    call = F.struct(
        (F.col("seq") % 3).alias("index"), F.concat(F.lit("t"), (F.col("seq") % 3).cast("string")).alias("id"), F.lit("function").alias("type"),
        F.struct(F.when(F.col("seq") < 3, "look").alias("name"), F.concat(F.col("seq").cast("string"), F.lit(";")).alias("arguments")).alias("function"),
    )
    chunk = F.struct(
        F.concat(F.lit("c"), F.col("call_id").cast("string")).alias("id"),
        F.array(
            F.struct(
                F.lit(0).alias("index"),
                F.struct(
                    F.when(F.col("seq") == 0, "assistant").alias("role"),
                    F.col("delta").alias("content"),
                    F.when(F.col("seq") % 3 < 2, F.array(call)).alias("tool_calls"),
                ).alias("delta"),
                F.when(F.col("last"), "stop").alias("finish_reason"),
            )
        ).alias("choices"),
        F.struct(F.col("tokens").alias("tokens")).alias("usage"),
    )
    rows = g["d_chunk"].select("call_id", "seq", F.to_json(chunk).alias("chunk"))
    return chunks.assemble(rows).drop("response")


_RUNAWAY = "SELECT call_id, seq, role = 'user' AS blank, tokens FROM d_chunk"


@query(
    "runaway_calls",
    f"""
WITH t AS ({_RUNAWAY}), i AS (SELECT *, sum(CASE WHEN blank THEN 0 ELSE 1 END) OVER (PARTITION BY call_id ORDER BY seq) AS island FROM t),
r AS (SELECT *, CASE WHEN blank THEN sum(CASE WHEN blank THEN tokens ELSE 0 END) OVER (PARTITION BY call_id, island ORDER BY seq) ELSE 0 END AS run FROM i)
SELECT call_id, min(seq) AS seq, concat('stopped: nothing but whitespace for ', CAST(arg_min(run, seq) AS STRING), ' tokens') AS error FROM r WHERE run >= 100 GROUP BY call_id""",
)
def runaway_calls(g: Given) -> DataFrame:
    return chunks.runaways(g.sql(_RUNAWAY), 100)


def _sse(d: Dialect) -> str:
    """Each document as a captured stream: sentences as events, two data lines where there was a
    comma, a comment, and for some an end before the last event or an error."""
    c = "char" if d.spark else "chr"
    body = f"replace(replace(replace(replace(text, {c}(10), ' '), {c}(13), ' '), '. ', concat({c}(13), {c}(10), {c}(13), {c}(10), 'data: ')), ', ', concat({c}(10), 'event: x', {c}(10), 'data:'))"
    return f"""
SELECT doc_id, concat(': hello', {c}(10), 'data: ', {body}, {c}(10), {c}(10), CASE WHEN doc_id % 3 = 0 THEN concat('data: [DONE]', {c}(10), {c}(10)) ELSE '' END,
  CASE WHEN doc_id % 5 = 0 THEN 'data: {{"error":{{"message":"overloaded"}}}}' ELSE 'data: {{"ok":1}}' END, {c}(10)) AS stream, {body} AS body FROM documents"""


register_view("d_sse", _sse)


@query(
    "sse_payloads",
    r"""
WITH e AS (SELECT doc_id, list_concat(string_split(body, chr(13) || chr(10) || chr(13) || chr(10) || 'data: '), CASE WHEN doc_id % 3 = 0 THEN CAST([] AS VARCHAR[]) WHEN doc_id % 5 = 0 THEN ['{"error":{"message":"overloaded"}}'] ELSE ['{"ok":1}'] END) AS found FROM d_sse),
p AS (SELECT doc_id, unnest(range(0, len(found))) AS seq, found FROM e),
q AS (SELECT doc_id, seq, replace(found[seq + 1], chr(10) || 'event: x' || chr(10) || 'data:', chr(10)) AS raw FROM p),
l AS (SELECT doc_id, seq, list_transform(string_split(raw, chr(10)), lambda s, i: CASE WHEN i > 1 THEN regexp_replace(s, '^ ', '') ELSE s END) AS ls FROM q)
SELECT doc_id, CAST(seq AS BIGINT) AS seq, array_to_string(ls, chr(10)) AS payload, CASE WHEN array_to_string(ls, chr(10)) LIKE '{"error"%' THEN 'rejected' WHEN array_to_string(ls, chr(10)) = '{"ok":1}' THEN NULL ELSE 'not a JSON object' END AS problem FROM l""",
)
def sse_payloads(g: Given) -> DataFrame:
    rows = events.payload_rows(g.spread("d_sse"), "stream", ["doc_id"])
    return rows.withColumn("seq", F.col("seq").cast("bigint"))
