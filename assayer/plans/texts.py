"""Queries over texts: the documents as vignettes, the pages as search results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing, pages, tape, text
from ..operators import describe, prepare
from ..sources import texts
from .registry import query
from .tables import Dialect, Given, register_view

_SPACES = "concat(" + ", ".join(
    f"chr({c})" for c in [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
) + ")"


def _messy(d: Dialect) -> str:
    """Documents with carriage returns, runs of blank lines, decomposed letters and outer space."""
    c = "char" if d.spark else "chr"
    return f"""
SELECT doc_id, source, concat({c}(12), ' ', {c}(160), replace(replace(replace(text, ', ', concat(',', {c}(13), {c}(10))), '. ', concat('.', {c}(10), ' ', {c}(9), {c}(10), {c}(10))), 'é', concat('e', {'CAST(unhex(%r) AS STRING)' % 'CC81' if d.spark else 'chr(769)'})), {c}(13), '  ') AS text
FROM documents"""


register_view("d_messy", _messy)

_LF = "replace(replace({0}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
_COLLAPSE = r"regexp_replace({0}, '\n[ \t]*\n(?:[ \t]*\n)+', chr(10) || chr(10), 'g')"
_STRIP = "trim({0}, " + _SPACES + ")"
_NFC = "nfc_normalize({0})"
_OPS = {"newlines.lf@1": _LF, "unicode.nfc@1": _NFC, "strip@1": _STRIP, "blank_lines.collapse@1": _COLLAPSE}


def _sql(ops: list[str]) -> str:
    out = "text"
    for op in ops:
        out = _OPS[op].format(out)
    return out


def _one(name: str, op: str) -> None:
    @query(name, f"SELECT doc_id, sha256({_sql([op])}) AS hex, length({_sql([op])}) AS n FROM d_messy")
    def run(g: Given) -> DataFrame:
        cleaned = text.CLEANUP[op](F.col("text"))
        return g.spread("d_messy").select("doc_id", cleaned.alias("t")).select(
            "doc_id", F.sha2("t", 256).alias("hex"), F.length("t").cast("bigint").alias("n")
        )


for _name, _op in {
    "clean_newlines": "newlines.lf@1", "clean_nfc": "unicode.nfc@1", "clean_strip": "strip@1",
    "clean_blank_lines": "blank_lines.collapse@1",
}.items():
    _one(_name, _op)

_LISTS = [
    ["newlines.lf@1", "blank_lines.collapse@1", "strip@1", "unicode.nfc@1"],
    ["unicode.nfc@1", "newlines.lf@1"],
    [],
]


@query(
    "clean_pipeline",
    "SELECT doc_id, sha256(CASE doc_id % 3 " + " ".join(f"WHEN {i} THEN {_sql(ops)}" for i, ops in enumerate(_LISTS)) + " END) AS hex FROM d_messy",
)
def clean_pipeline(g: Given) -> DataFrame:
    """Each trial's own list of ops, in its order."""
    lists = [F.array(*[F.lit(o) for o in ops]).cast("array<string>") for ops in _LISTS]
    ops = F.when(F.col("doc_id") % 3 == 0, lists[0]).when(F.col("doc_id") % 3 == 1, lists[1]).otherwise(lists[2])
    rows = g.spread("d_messy").withColumn("ops", ops)
    return text.clean_by(rows, "text", "ops").select("doc_id", F.sha2("text", 256).alias("hex"))


def _file(d: Dialect) -> str:
    """Documents as bytes: some with a byte-order mark, some that aren't UTF-8."""
    raw = "encode(text, 'UTF-8')" if d.spark else "encode(text)"
    bom, bad = ("X'EFBBBF'", "X'FF'") if d.spark else (r"'\xEF\xBB\xBF'::BLOB", r"'\xFF'::BLOB")
    return f"""
SELECT doc_id, source, concat('v', CAST(doc_id AS STRING)) AS source_id,
  CASE WHEN doc_id % 10 = 3 THEN {bom} || {raw} WHEN doc_id % 50 = 9 THEN {raw} || {bad} ELSE {raw} END AS content FROM documents"""


register_view("d_file", _file)


@query(
    "decode_check",
    "SELECT doc_id, doc_id % 50 <> 9 AS decodes, CASE WHEN doc_id % 50 <> 9 THEN sha256(text) END AS hex FROM documents",
)
def decode_check(g: Given) -> DataFrame:
    read = g["d_file"].select("doc_id", texts.decoded(F.col("content")).alias("t"))
    return read.select("doc_id", F.col("t").isNotNull().alias("decodes"), F.sha2("t", 256).alias("hex"))


@query(
    "source_snapshot",
    "SELECT source, concat('v', CAST(doc_id AS STRING)) AS source_id, sha256(text) AS hex FROM documents",
)
def source_snapshot(g: Given) -> DataFrame:
    files = g["documents"].select(
        "source", F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("source_id"), F.encode("text", "UTF-8").alias("content")
    )
    return files.select("source", "source_id", hashing.fingerprint(F.col("content")).alias("hex"))


@query("doc_fingerprint", "SELECT doc_id, concat('sha256:', sha256(text)) AS digest FROM documents")
def doc_fingerprint(g: Given) -> DataFrame:
    return g["documents"].select("doc_id", hashing.digest(F.col("text")).alias("digest"))


_KEY = b"a key for trying out"
_PADS = ["".join(f"{b ^ pad:02x}" for b in _KEY.ljust(64, b"\0")) for pad in (0x5C, 0x36)]


@query(
    "doc_hmac",
    f"SELECT doc_id, 'k1' AS key_id, sha256(from_hex('{_PADS[0]}') || from_hex(sha256(from_hex('{_PADS[1]}') || encode(text)))) AS hex FROM documents",
)
def doc_hmac(g: Given) -> DataFrame:
    return g["documents"].select(
        "doc_id", F.lit("k1").alias("key_id"), hashing.hmac_fingerprint(F.col("text"), _KEY).alias("hex")
    )


@query(
    "join_appendices",
    """
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN concat(chr(10), chr(10), source) ELSE concat(chr(10), chr(10), source, chr(10), chr(10), lang) END AS joined FROM documents""",
)
def join_appendices(g: Given) -> DataFrame:
    parts = F.slice(F.array("source", "lang"), 1, (F.col("doc_id") % 3).cast("int"))
    return g["documents"].select("doc_id", text.join_appendices(parts).alias("joined"))


_CLEANUP = ["newlines.lf@1", "strip@1", "blank_lines.collapse@1"]


@query(
    "prepare_cases",
    f"""
SELECT c.digest, CASE WHEN c.doc_id % 37 <> 5 THEN sha256({_sql(_CLEANUP)}) END AS vignette_hex,
  CASE WHEN appendix IS NULL THEN '' WHEN c.doc_id % 44 <> 8 THEN concat(chr(10), chr(10), 'note ', d.lang) END AS appendices,
  CASE WHEN c.doc_id % 37 <> 5 THEN sha256(text) <> hex END AS drifted,
  CASE WHEN c.doc_id % 37 = 5 THEN 'its source has no such file' WHEN c.doc_id % 44 = 8 THEN '1 of its appendices are missing' END AS problem
FROM d_case c JOIN documents d ON d.doc_id = c.doc_id""",
)
def prepare_cases(g: Given) -> DataFrame:
    """Some cases' files and appendices are missing, which is what their problems say."""
    docs = g.spread("documents")
    name = lambda kind: F.concat(F.lit(kind), F.col("doc_id").cast("string"))
    files = docs.where("doc_id % 37 <> 5").select("source", name("v").alias("source_id"), F.encode("text", "UTF-8").alias("content"))
    appendices = docs.where("doc_id % 44 <> 8").select(name("appendix:").alias("digest"), F.concat(F.lit("note "), "lang").alias("text"))
    cases = g["d_case"].withColumn("appendices", F.array_compact(F.array("appendix")))
    prepared = prepare.prepare_cases(cases, files, appendices, _CLEANUP)
    return prepared.select("digest", F.sha2("vignette", 256).alias("vignette_hex"), "appendices", "drifted", "problem")


@query(
    "prepare_keyed",
    f"""
WITH c AS (SELECT *, CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'k2' ELSE 'k1' END AS key_id, CASE WHEN doc_id % 10 = 3 THEN concat(text, '~') ELSE text END AS pinned FROM documents)
SELECT doc_id, CASE WHEN key_id IS NOT DISTINCT FROM 'k1' THEN text <> pinned END AS drifted,
  CASE WHEN key_id IS NULL THEN 'the case''s vignette is fingerprinted with key None, not ''k1''' WHEN key_id <> 'k1' THEN concat('the case''s vignette is fingerprinted with key ''', key_id, ''', not ''k1''') END AS problem,
  sha256(from_hex('{_PADS[0]}') || from_hex(sha256(from_hex('{_PADS[1]}') || encode(text)))) AS fingerprint FROM c""",
)
def prepare_keyed(g: Given) -> DataFrame:
    """Cases whose fingerprints are keyed; those of another key, or of none, aren't compared."""
    docs = g.spread("documents").select("doc_id", "source", F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("source_id"), "text")
    pinned = F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("~"))).otherwise(F.col("text"))
    key_id = F.when(F.col("doc_id") % 6 == 0, None).when(F.col("doc_id") % 6 == 1, "k2").otherwise("k1")
    cases = docs.select(
        F.col("doc_id").alias("digest"), "source", "source_id", hashing.hmac_fingerprint(pinned, _KEY).alias("hex"), key_id.alias("key_id"),
        F.array().cast("array<string>").alias("appendices"),
    )
    files = docs.select("source", "source_id", F.encode("text", "UTF-8").alias("content"))
    none = g.spark.createDataFrame([], "digest string, text string")
    prepared = prepare.prepare_cases(cases, files, none, [], key=("k1", _KEY))
    return prepared.select(F.col("digest").alias("doc_id"), "drifted", "problem", "fingerprint")


@query(
    "judge_fills",
    """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN concat(source, chr(10), lang) WHEN 2 THEN concat('{', chr(10), '  "n": ', CAST(doc_id AS STRING), chr(10), '}')
  ELSE concat('[', chr(10), '  "', lang, '",', chr(10), '  ', CAST(doc_id AS STRING), chr(10), ']') END AS fill FROM documents""",
)
def judge_fills(g: Given) -> DataFrame:
    n = F.col("doc_id").cast("string")
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    kind = F.col("doc_id") % 4
    document = (
        F.when(kind == 0, F.concat(F.lit("["), quote("source"), F.lit("]")))
        .when(kind == 1, F.concat(F.lit("["), quote("source"), F.lit(","), quote("lang"), F.lit("]")))
        .when(kind == 2, F.concat(F.lit('[{"n":'), n, F.lit("}]")))
        .otherwise(F.concat(F.lit("["), quote("lang"), F.lit(","), n, F.lit("]")))
    )
    items = g["documents"].select("doc_id", F.parse_json(document).cast("array<variant>").alias("items"))
    return items.select("doc_id", prepare.judge_fill(F.col("items")).alias("fill"))


@query(
    "judge_fills_written",
    """
SELECT doc_id, concat('{', chr(10), '  "n": 1e-7,', chr(10), '  "b": {', chr(10), '    "z": [],', chr(10), '    "a": "', lang, '"', chr(10), '  }', chr(10), '}') AS fill FROM documents""",
)
def judge_fills_written(g: Given) -> DataFrame:
    """Objects for a judge have their members in the answer's order."""
    document = F.concat(F.lit('[{"n":1e-7,"b":{"z":[],"a":"'), "lang", F.lit('"}}]'))
    items = g["documents"].select("doc_id", F.parse_json(document).cast("array<variant>").alias("items"), tape.picks(document, "$[*]").alias("written"))
    return items.select("doc_id", prepare.judge_fill(F.col("items"), F.col("written")).alias("fill"))


@query(
    "snippets",
    rf"""
WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, sha256(text) AS hex FROM documents)
SELECT doc_id, concat('"', CASE WHEN length(t) > 40 THEN concat(CASE WHEN contains(left(t, 41), ' ') THEN regexp_extract(left(t, 41), '^(.*) ', 1) ELSE left(t, 41) END, '…') ELSE t END, '"') AS snippet, left(hex, 6) AS short FROM f""",
)
def snippets(g: Given) -> DataFrame:
    return g["documents"].select(
        "doc_id", text.snippet(F.col("text")).alias("snippet"), text.short(hashing.digest(F.col("text"))).alias("short")
    )


def _described(d: Dialect) -> str:
    """Component documents of many kinds, one per order."""
    digest = f"concat('sha256:', {d.sha('CAST(o_orderkey AS STRING)')})"
    key = "CAST(o_orderkey AS STRING)"
    cust = "CAST(o_custkey AS STRING)"
    docs = [
        ("chunk.instructions", f"concat('{{\"text\":\"Answer case ', {key}, ' of customer ', {cust}, ' in full sentences\"}}')"),
        ("chunk.few_shot", "concat('{\"messages\":[1', CASE WHEN o_custkey % 2 = 0 THEN ',2' ELSE '' END, ']}')"),
        ("chunk.prompt", f"concat('{{\"segments\":[\"Case ', {key}, ': \",{{\"slot\":\"vignette\"}},\" \",{{\"insert\":\"output_guidance\"}}]}}')"),
        ("chunk.sampling", f"concat('{{\"top_k\":', {cust}, CASE WHEN o_custkey % 2 = 0 THEN ',\"temperature\":0' ELSE '' END, '}}')"),
        ("chunk.reasoning", "CASE WHEN o_custkey % 2 = 0 THEN '{}' ELSE '{\"effort\":\"low\",\"chat_template_kwargs\":{\"z\":true,\"a\":\"x\"},\"thinking_token_budget\":100}' END"),
        ("chunk.output", "CASE WHEN o_custkey % 2 = 0 THEN '{\"contract\":{\"kind\":\"text\"}}' ELSE '{\"contract\":{\"kind\":\"tool\",\"name\":\"answer\"},\"json_schema\":{\"properties\":{\"b\":{},\"a\":{}}}}' END"),
        ("chunk.toolset", f"concat('{{\"tools\":[\"t', {cust}, '\",\"search\"]}}')"),
        ("trial", f"concat('{{\"skeleton\":\"s', {cust}, '\",\"engine\":\"e\",\"cases\":[1,2],\"seeds\":[', {key}, ']}}')"),
        ("case", f"concat('{{\"vignette\":{{\"source\":\"reg\",\"id\":\"', {key}, '\"}}', CASE WHEN o_custkey % 2 = 0 THEN ',\"appendices\":[\"a1\",\"a2\"]' ELSE '' END, '}}')"),
        ("engine.remote", f"concat('{{\"model\":\"m', {cust}, '\",\"base_url\":\"https://api.example.org/v1\"}}')"),
        ("skeleton", "'{\"purpose\":\"generation\"}'"),
        ("compilation", "'{}'"),
    ]
    n = len(docs)
    kind = " ".join(f"WHEN {i} THEN '{k}'" for i, (k, _) in enumerate(docs))
    doc = " ".join(f"WHEN {i} THEN {x}" for i, (_, x) in enumerate(docs))
    return f"SELECT o_orderkey, o_custkey, {digest} AS digest, CASE o_orderkey % {n} {kind} END AS kind, CASE o_orderkey % {n} {doc} END AS doc FROM orders"


register_view("d_described", _described)


@query(
    "describe",
    """
SELECT o_orderkey, kind, CASE kind
  WHEN 'chunk.instructions' THEN (SELECT concat('"', CASE WHEN length(t) > 40 THEN concat(regexp_extract(left(t, 41), '^(.*) ', 1), '…') ELSE t END, '"') FROM (SELECT concat('Answer case ', CAST(o_orderkey AS STRING), ' of customer ', CAST(o_custkey AS STRING), ' in full sentences') AS t) q)
  WHEN 'chunk.few_shot' THEN CASE WHEN o_custkey % 2 = 0 THEN 'few-shot, 2 messages' ELSE 'few-shot, 1 message' END
  WHEN 'chunk.prompt' THEN (SELECT concat('"', CASE WHEN length(t) > 40 THEN concat(regexp_extract(left(t, 41), '^(.*) ', 1), '…') ELSE t END, '"') FROM (SELECT concat('Case ', CAST(o_orderkey AS STRING), ': {vignette} {output_guidance}') AS t) q)
  WHEN 'chunk.sampling' THEN concat(CASE WHEN o_custkey % 2 = 0 THEN 'temperature 0, ' ELSE '' END, 'top_k ', CAST(o_custkey AS STRING))
  WHEN 'chunk.reasoning' THEN CASE WHEN o_custkey % 2 = 0 THEN 'default reasoning' ELSE 'effort low, z true, a "x", budget 100' END
  WHEN 'chunk.output' THEN CASE WHEN o_custkey % 2 = 0 THEN 'text output' ELSE 'tool answer output: b, a' END
  WHEN 'chunk.toolset' THEN concat('with t', CAST(o_custkey AS STRING), ', search')
  WHEN 'trial' THEN concat('s', CAST(o_custkey AS STRING), ' on e, 2 cases, 1 seed')
  WHEN 'case' THEN concat('reg/', CAST(o_orderkey AS STRING), CASE WHEN o_custkey % 2 = 0 THEN ' with a1, a2' ELSE '' END)
  WHEN 'engine.remote' THEN concat('m', CAST(o_custkey AS STRING), ' at api.example.org')
  WHEN 'skeleton' THEN concat('generation skeleton ', substr(digest, 8, 6)) ELSE concat(kind, ' ', substr(digest, 8, 6)) END AS description FROM d_described""",
)
def describe_components(g: Given) -> DataFrame:
    rows = g.spread("d_described").withColumn("v", F.parse_json("doc"))
    return rows.select(
        "o_orderkey", "kind", describe.describe(F.col("kind"), F.col("v"), F.col("digest"), F.col("doc")).alias("description")
    )


@query(
    "flag_names",
    """
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '--enable-tool.call_x,--max-len' ELSE concat('--served-model-name,--limit-', CAST(p_size AS STRING)) END AS flags FROM part""",
)
def flag_names(g: Given) -> DataFrame:
    argv = F.when(
        F.col("p_size") % 2 == 0, F.array(F.lit("serve"), F.lit("--enable_tool.call_x=1"), F.lit("--max_len"), F.lit("8"), F.lit("--max-len=9"))
    ).otherwise(F.array(F.lit("--served_model-name=a_b.c"), F.concat(F.lit("--limit_"), F.col("p_size").cast("string")), F.lit("-x")))
    return g["part"].select("p_partkey", F.array_join(text.flag_names(argv), ",").alias("flags"))


def _result_page(d: Dialect) -> str:
    """Each page's links marked up as a results page marks its results."""
    ref = "$" if d.spark else "\\\\"
    ref = "$" if d.spark else "\\"
    flags = "" if d.spark else ", 'g'"
    return rf"""
SELECT page_id, html, regexp_replace(html, '<li><a href="/([^"<>]*)">([^<]*)</a></li>',
  '<a rel="x" class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fsite.example%2F{ref}1&amp;rut=1"><b>{ref}2</b> &amp; co</a><a class="result__snippet" href="#"> About {ref}2 </a>'{flags}) AS results FROM pages"""


register_view("d_result_page", _result_page)


@query(
    "page_links",
    r"""
WITH l AS (SELECT page_id, regexp_extract_all(html, '<li><a href="/([^"<>]*)">[^<]*</a></li>', 1) AS urls, regexp_extract_all(html, '<li><a href="/[^"<>]*">([^<]*)</a></li>', 1) AS names FROM pages),
r AS (SELECT page_id, unnest(range(1, least(len(urls), 5) + 1)) AS rank, urls, names FROM l)
SELECT page_id, rank, concat(names[rank], ' & co') AS title, concat('https://site.example/', urls[rank]) AS url, concat('About ', names[rank]) AS snippet FROM r""",
)
def page_links(g: Given) -> DataFrame:
    found = pages.results(g["d_result_page"], "results", ["page_id"], first=5)
    return found.withColumn("rank", F.col("rank").cast("bigint"))
