"""The given tables and the views derived from them, in Spark's and DuckDB's SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir, dealt, prepare

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


class Dialect:
    """The few spellings in which the two engines' SQL differ."""

    def __init__(self, spark: bool) -> None:
        self.spark = spark

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)" if self.spark else f"sha256({x})"

    def us(self, x: str) -> str:
        return f"unix_micros(CAST({x} AS TIMESTAMP))" if self.spark else f"epoch_us({x})"

    def div(self, a: str, b: str | int) -> str:
        return f"(({a}) div {b})" if self.spark else f"(({a}) // {b})"


# Every third block of eight events goes to run 0, so one run holds a third of all calls;
# the other runs have 40 cases of 8 replicates each, so their number grows with the data.
def _call(d: Dialect) -> str:
    return f"""
SELECT event_id, run, case_id, replicate, started_us,
  started_us + CAST(floor(value * 100) AS BIGINT) * 600000 AS finished_us,
  1 + event_id % 3 AS attempts,
  event_id % 59 <> 7 AS has_response,
  CASE WHEN event_id % 77 = 0 OR event_id % 59 = 7 THEN NULL WHEN event_id % 50 = 0 THEN 'other'
       ELSE concat('model-', CAST(run AS STRING)) END AS returned_model,
  CASE WHEN event_id % 31 = 0 THEN NULL ELSE {d.sha('event_type')} END AS token_hex,
  {d.sha("concat('vignette-', CAST(case_id AS STRING), CASE WHEN event_id % 41 = 0 THEN '!' ELSE '' END)")} AS vignette_hex
FROM (
  SELECT event_id, value, event_type, event_id % 8 AS replicate,
    CASE WHEN block % 3 = 0 THEN 0 ELSE 1 + {d.div('idx', 40)} END AS run,
    CASE WHEN block % 3 = 0 THEN {d.div('block', 3)} ELSE idx % 40 END AS case_id,
    {d.us('ts')} + CASE WHEN event_id % 23 = 0 THEN 3600000000 ELSE 0 END AS started_us
  FROM (
    SELECT *, {d.div('block', 3)} * 2 + block % 3 - 1 AS idx
    FROM (SELECT *, {d.div('event_id', 8)} AS block FROM events) b
  ) i
) c"""


# Calls of which some were lost, for the checks that look for missing items.
def _made(d: Dialect) -> str:
    return "SELECT * FROM d_call WHERE event_id % 17 <> 5"


def _run(d: Dialect) -> str:
    return """
SELECT run, concat('model-', CAST(run AS STRING)) AS declared_model, 2 AS concurrency, 1 AS retries,
  CASE run % 3 WHEN 0 THEN 'case_major@1' WHEN 1 THEN 'replicate_major@1' ELSE 'shuffled@1' END AS send_order,
  CASE WHEN run % 3 = 2 THEN run + 7 END AS shuffle_seed,
  max(case_id) + 1 AS n_cases, max(replicate) + 1 AS n_seeds,
  min(started_us) AS started_us,
  CASE WHEN run % 5 = 4 THEN NULL ELSE max(finished_us) END AS finished_us
FROM d_call GROUP BY run"""


def _answer(d: Dialect) -> str:
    return """
SELECT doc_id AS case_id, source AS condition, lang,
  CASE WHEN doc_id % 19 = 0 THEN NULL ELSE text END AS answer, doc_id % 5 AS pattern_id
FROM documents"""


PATTERNS = {
    0: "the",
    1: "an* & er*",
    2: "(in | on) & the",
    3: "der | die | und",
    4: "in the | la & (le | que)",
}


def _target(d: Dialect) -> str:
    rows = ", ".join(f"({i}, '{p}')" for i, p in PATTERNS.items())
    return f"SELECT * FROM (VALUES {rows}) AS t(pattern_id, pattern)"


def _score(d: Dialect) -> str:
    views = "explode(array(0, 1))" if d.spark else "unnest([0, 1])"
    return f"""
SELECT l.doc_id AS case_id, d.source AS condition, d.lang, l.view_pos,
  CASE WHEN l.doc_id % 9 = 0 THEN NULL WHEN l.view_pos = 0 THEN CAST(l.quality AS DOUBLE)
       ELSE CAST(l.toxic AS DOUBLE) END AS value
FROM (SELECT doc_id, quality, toxic, {views} AS view_pos FROM labels) l JOIN documents d ON d.doc_id = l.doc_id"""


def _listing(d: Dialect) -> str:
    return f"SELECT source, concat('v', CAST(doc_id AS STRING)) AS source_id, {d.sha('text')} AS hex FROM documents"


def _binding(d: Dialect) -> str:
    changed = d.sha("concat(text, '~')")
    gone = d.sha("concat('gone', CAST(doc_id AS STRING))")
    return f"""
SELECT doc_id AS id, doc_id AS family, source, concat('v', CAST(doc_id AS STRING)) AS source_id, {changed} AS hex
FROM documents WHERE doc_id % 11 <> 0
UNION ALL
SELECT 100000000000 + doc_id, doc_id, source,
  CASE WHEN doc_id % 13 = 0 THEN concat('old', CAST(doc_id AS STRING)) ELSE concat('v', CAST(doc_id AS STRING)) END,
  CASE WHEN doc_id % 7 = 0 THEN {changed} ELSE {d.sha('text')} END
FROM documents WHERE doc_id % 11 <> 0
UNION ALL
SELECT 200000000000 + doc_id, 200000000000 + doc_id, source, concat('gone', CAST(doc_id AS STRING)), {gone}
FROM documents WHERE doc_id % 17 = 0"""


# Cases pin a vignette as (source, id, fingerprint): most the current binding, some an older one.
def _case(d: Dialect) -> str:
    return f"""
SELECT concat('case:', CAST(doc_id AS STRING)) AS digest, doc_id, source,
  concat('v', CAST(doc_id AS STRING)) AS source_id,
  CASE WHEN doc_id % 5 = 0 THEN {d.sha("concat(text, '~')")} ELSE {d.sha('text')} END AS hex,
  CASE WHEN doc_id % 4 = 0 THEN concat('appendix:', CAST(doc_id AS STRING)) END AS appendix
FROM documents"""


def _thread(d: Dialect) -> str:
    return f"""
SELECT user_id AS id, CASE WHEN user_id % 2 = 0 THEN 'skeleton' ELSE 'chunk.prompt' END AS kind,
  CASE WHEN user_id % 3 = 1 THEN min(event_id) - 1 - min(event_id) % 5 END AS forked_from, min(event_id) AS first_edit
FROM events GROUP BY user_id"""


def _edit(d: Dialect) -> str:
    return f"""
SELECT event_id AS id, user_id AS thread, CASE WHEN user_id % 2 = 0 THEN 'skeleton' ELSE 'chunk.prompt' END AS kind,
  {d.sha(f"concat(event_type, CAST({d.div('event_id', 20)} AS STRING))")} AS digest,
  CASE WHEN event_id % 9 = 4 THEN event_id - 3 END AS based_on,
  CASE WHEN user_id % 2 = 0 AND event_id % 3 <> 0 THEN {d.sha("concat('compilation', CAST(event_id % 11 AS STRING))")} END AS compilation
FROM events"""


def _entry(d: Dialect) -> str:
    return """
SELECT event_id AS id, user_id AS thread,
  CASE event_type WHEN 'signup' THEN 'name' WHEN 'click' THEN 'tag' WHEN 'view' THEN 'collaborator'
                  WHEN 'purchase' THEN 'owner' ELSE 'deleted' END AS field,
  CASE WHEN event_type = 'signup' AND event_id % 10 <> 0 THEN concat('n', CAST(event_id % 40 AS STRING))
       WHEN event_type = 'click' THEN concat('t', CAST(event_id % 4 AS STRING)) END AS value,
  CASE WHEN event_type IN ('view', 'purchase') THEN event_id % 12 END AS person,
  CASE WHEN event_type = 'purchase' THEN TRUE WHEN event_type = 'signup' THEN event_id % 10 <> 0 ELSE event_id % 3 <> 0 END AS present
FROM events"""


def _component(d: Dialect) -> str:
    return """
SELECT concat('region:', CAST(r_regionkey AS STRING)) AS digest, 'region' AS kind, r_name AS label FROM region
UNION ALL SELECT concat('nation:', CAST(n_nationkey AS STRING)), 'nation', n_name FROM nation
UNION ALL SELECT concat('customer:', CAST(c_custkey AS STRING)), 'customer', c_name FROM customer
UNION ALL SELECT concat('supplier:', CAST(s_suppkey AS STRING)), 'supplier', s_name FROM supplier
UNION ALL SELECT concat('order:', CAST(o_orderkey AS STRING)), 'order', o_orderpriority FROM orders"""


def _ref(d: Dialect) -> str:
    return """
SELECT concat('nation:', CAST(n_nationkey AS STRING)) AS src, '/region' AS path, concat('region:', CAST(n_regionkey AS STRING)) AS dst, 'region' AS kinds FROM nation
UNION ALL SELECT concat('customer:', CAST(c_custkey AS STRING)), '/nation', concat('nation:', CAST(c_nationkey AS STRING)), 'nation' FROM customer
UNION ALL SELECT concat('supplier:', CAST(s_suppkey AS STRING)), '/nation', concat('nation:', CAST(s_nationkey AS STRING)), 'nation' FROM supplier
UNION ALL SELECT concat('order:', CAST(o_orderkey AS STRING)), '/customer', concat('customer:', CAST(CASE WHEN o_orderkey % 500 = 3 THEN -1 ELSE o_custkey END AS STRING)),
  CASE WHEN o_orderkey % 700 = 5 THEN 'supplier' ELSE 'customer' END FROM orders
UNION ALL SELECT concat('order:', CAST(l_orderkey AS STRING)), concat('/items/', CAST(l_linenumber AS STRING)),
  concat('supplier:', CAST(l_suppkey AS STRING)), 'supplier' FROM lineitem"""


def _chunk(d: Dialect) -> str:
    return """
SELECT c.conv_id AS call_id, c.turn AS seq, c.role, c.text AS delta, length(c.text) AS tokens,
  c.turn = l.last_turn AS last
FROM conversations c JOIN (SELECT conv_id, max(turn) AS last_turn FROM conversations GROUP BY conv_id) l
  ON l.conv_id = c.conv_id"""


VIEWS = {
    "d_call": _call,
    "d_made": _made,
    "d_run": _run,
    "d_answer": _answer,
    "d_target": _target,
    "d_score": _score,
    "d_listing": _listing,
    "d_binding": _binding,
    "d_case": _case,
    "d_thread": _thread,
    "d_edit": _edit,
    "d_entry": _entry,
    "d_component": _component,
    "d_ref": _ref,
    "d_chunk": _chunk,
}

_NAME = re.compile(r"\bd_[a-z_]+\b")
_SPARK, _DUCK = Dialect(True), Dialect(False)


class Given:
    """The tables of one folder, read once per session, and the views over them."""

    _opened: dict[tuple[int, str], "Given"] = {}

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self._frames: dict[str, DataFrame] = {}
        self._kept: set[str] = set()

    @classmethod
    def open(cls, spark: SparkSession, sf_dir: str) -> "Given":
        prepare(spark)
        key = (id(spark._jsparkSession), sf_dir)
        return cls._opened.setdefault(key, cls(spark, sf_dir))

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name in VIEWS:
                self._frames[name] = self.sql(VIEWS[name](_SPARK))
            else:
                self._frames[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._frames[name]

    def kept(self, *names: str) -> "Given":
        """The same tables with some views checkpointed: what is derived from them again reads these few rows."""
        checkpoint_dir(self.spark)
        found = Given(self.spark, self.sf_dir)
        for name in names:
            found._frames[name] = found[name].checkpoint()
        found._kept = set(names)
        return found

    def has(self, *names: str) -> bool:
        return self._kept >= set(names)

    def spread(self, name: str) -> DataFrame:
        """A table for work that is heavy per row, dealt out if the session says so."""
        return dealt(self[name])

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over the tables and views it names."""
        words = set(re.findall(r"(?<=FROM )\w+|(?<=JOIN )\w+", text))
        used = [w for w in words if w in VIEWS or w in TABLES]
        text = text.replace("{", "{{").replace("}", "}}")
        for w in used:
            text = re.sub(rf"\b(FROM|JOIN) {w}\b", rf"\1 {{{w}}}", text)
        return self.spark.sql(text, **{w: self[w] for w in used})


def register_view(name: str, build) -> None:
    if name in VIEWS:
        raise ValueError(f"two views named {name}")
    VIEWS[name] = build


def oracle(sql: str) -> str:
    """DuckDB SQL with the derived views it names written out before it."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in _NAME.findall(text):
            if name in VIEWS and name not in needed:
                need(VIEWS[name](_DUCK))
                if name not in needed:
                    needed.append(name)

    need(sql)
    ctes = [f"{n} AS ({VIEWS[n](_DUCK)})" for n in needed]
    body = sql.strip()
    head = "WITH "
    for lead in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(lead):
            head, rest = lead, body[len(lead):]
            return head + ",\n".join([*ctes, rest])
    return (head + ",\n".join(ctes) + "\n" + body) if ctes else body
