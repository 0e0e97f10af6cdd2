"""Queries over components and their references: the star schema, taken as a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import graph
from ..sources import bundle, store
from .registry import query
from .tables import Dialect, Given, register_view


def _stored(d: Dialect) -> str:
    """Components with canonical text under their real digest; some bytes were changed since."""
    canonical = "concat('{\"kind\":\"', kind, '\",\"label\":\"', label, '\",\"name\":\"', digest, '\"}')"
    return f"""
SELECT digest AS name, kind, concat('sha256:', {d.sha(canonical)}) AS digest,
  CASE WHEN kind = 'order' AND name_no % 97 = 5 THEN concat({canonical}, ' ') ELSE {canonical} END AS canonical
FROM (SELECT *, CAST(regexp_extract(digest, ':([0-9]+)', 1) AS BIGINT) AS name_no FROM d_component) c"""


register_view("d_stored", _stored)


def refs(g: Given) -> DataFrame:
    return g["d_ref"].withColumn("kinds", F.array("kinds"))


_ROOTS = "SELECT concat('order:', CAST(o_orderkey AS STRING)) AS digest FROM orders WHERE o_orderpriority LIKE '1%'"
_CLOSURE = f"WITH RECURSIVE roots AS ({_ROOTS}), reach AS (SELECT digest FROM roots UNION SELECT r.dst FROM reach JOIN d_ref r ON r.src = reach.digest)"


@query("closure", f"{_CLOSURE} SELECT digest FROM reach")
def closure(g: Given) -> DataFrame:
    return graph.closure(g.sql(_ROOTS), g["d_ref"])


@query(
    "runs_reaching",
    """
WITH RECURSIVE reach AS (SELECT concat('region:', CAST(r_regionkey AS STRING)) AS digest FROM region WHERE r_name = 'ASIA'
  UNION SELECT r.src FROM reach JOIN d_ref r ON r.dst = reach.digest)
SELECT o_orderkey AS run FROM orders JOIN reach ON digest = concat('order:', CAST(o_orderkey AS STRING))""",
)
def runs_reaching(g: Given) -> DataFrame:
    """Runs (orders) whose trial reaches a component: the closure over reversed references."""
    roots = g.sql("SELECT concat('region:', CAST(r_regionkey AS STRING)) AS digest FROM region WHERE r_name = 'ASIA'")
    reached = graph.closure(roots, g["d_ref"], src="dst", dst="src")
    runs = g["orders"].select(F.col("o_orderkey").alias("run"), F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("digest"))
    return runs.join(reached, "digest", "left_semi").select("run")


@query("compilations", "SELECT dst AS skeleton, src AS compilation FROM d_ref WHERE path = '/customer'")
def compilations(g: Given) -> DataFrame:
    return graph.compilations(g["d_ref"], "/customer")


@query(
    "dangling_refs",
    """
SELECT 'error' AS level, 'ref.missing' AS code, concat(dst, ' is missing') AS message, concat(src, path) AS subject, CAST(NULL AS STRING) AS log_id
FROM d_ref r ANTI JOIN d_component c ON c.digest = r.dst""",
)
def dangling_refs(g: Given) -> DataFrame:
    return graph.dangling(refs(g), g["d_component"])


@query(
    "mistyped_refs",
    """
SELECT 'error' AS level, 'ref.kind' AS code, concat(kind, ' is not one of ', kinds) AS message, concat(src, path) AS subject, CAST(NULL AS STRING) AS log_id
FROM d_ref r JOIN d_component c ON c.digest = r.dst WHERE kind <> kinds""",
)
def mistyped_refs(g: Given) -> DataFrame:
    return graph.mistyped(refs(g), g["d_component"])


_APPENDIX = """
SELECT concat('appendix:', CAST(doc_id AS STRING)) AS digest, source, source_id, CASE WHEN doc_id % 12 = 0 THEN 'changed' ELSE hex END AS hex FROM d_case WHERE appendix IS NOT NULL"""
_USERS = """
SELECT concat('user:', CAST(o_orderkey AS STRING)) AS digest, CASE WHEN o_orderkey % 4 = 0 THEN 'judge' ELSE 'trial' END AS kind, o_custkey AS skeleton FROM orders"""
_SKELETONS = "SELECT c_custkey AS digest, CASE WHEN c_nationkey % 5 = 0 THEN 'judge' ELSE 'generation' END AS purpose FROM customer"
_TOOLSETS = "SELECT l_orderkey AS digest, concat('tool', CAST(l_suppkey % 20 AS STRING)) AS name FROM lineitem"


@query(
    "cross_checks",
    f"""
SELECT 'error' AS level, 'case.appendix' AS code, concat('appendix ', c.appendix, ' is bound to another vignette') AS message, c.digest AS subject, CAST(NULL AS STRING) AS log_id
FROM d_case c JOIN ({_APPENDIX}) a ON a.digest = c.appendix WHERE (a.source, a.source_id, a.hex) <> (c.source, c.source_id, c.hex)
UNION ALL SELECT 'error', 'skeleton.purpose', concat(kind, ' uses a ', purpose, ' skeleton'), u.digest, NULL FROM ({_USERS}) u JOIN ({_SKELETONS}) s ON s.digest = u.skeleton WHERE purpose <> CASE kind WHEN 'trial' THEN 'generation' ELSE 'judge' END
UNION ALL SELECT 'error', 'toolset.names', concat('tools named more than once: ', name), CAST(digest AS STRING), NULL FROM ({_TOOLSETS}) t GROUP BY digest, name HAVING count(*) > 1""",
)
def cross_checks(g: Given) -> DataFrame:
    return graph.cross_checks(
        graph.appendix_elsewhere(g["d_case"], g.sql(_APPENDIX)),
        graph.wrong_purpose(g.sql(_USERS), g.sql(_SKELETONS)),
        graph.doubled_tools(g.sql(_TOOLSETS)),
    )


LEVELS = ["default", "off", "on", "minimal", "low", "medium", "high", "xhigh"]
_LEVEL_LIST = ", ".join(f"'{x}'" for x in LEVELS)


def _level(d: Dialect) -> str:
    """Reasoning levels of every model: some stand for themselves, some collapse to another."""
    rows = "posexplode(array({0})) AS (nth, level)" if d.spark else "unnest(range(0, 8)) AS nth, unnest([{0}]) AS level"
    pick = "element_at(array({0}), CAST((nth * 3 + p_size) % 8 AS INT) + 1)" if d.spark else "([{0}])[CAST((nth * 3 + p_size) % 8 AS INT) + 1]"
    return f"""
SELECT model, level, CASE WHEN (p_partkey + nth) % 4 < 2 THEN {pick.format(_LEVEL_LIST)} END AS next
FROM (SELECT p_name AS model_name, p_partkey AS model, p_partkey, p_size, {rows.format(_LEVEL_LIST)} FROM part) p"""


register_view("d_level", _level)


@query(
    "reasoning_resolve",
    """
WITH RECURSIVE walk AS (SELECT model, level, level AS landed, 0 AS hops FROM d_level
  UNION ALL SELECT w.model, w.level, l.next, hops + 1 FROM walk w JOIN d_level l ON l.model = w.model AND l.level = w.landed WHERE l.next IS NOT NULL AND hops < 9),
last AS (SELECT model, level, max(hops) AS hops, arg_max(landed, hops) AS landed FROM walk GROUP BY model, level)
SELECT model, level, CASE WHEN hops < 9 THEN landed END AS landed, hops = 9 AS goes_round FROM last""",
)
def reasoning_resolve(g: Given) -> DataFrame:
    return graph.land(g["d_level"], LEVELS)


# ----------------------------------------------------------------------------- the store


_HELD = "SELECT * FROM d_component WHERE kind <> 'order' OR label <> '1-URGENT'"


@query("component_add", "SELECT DISTINCT digest, kind FROM d_component c WHERE kind = 'order' AND label = '1-URGENT'")
def component_add(g: Given) -> DataFrame:
    """The batch is everything twice; the store holds all but the urgent orders."""
    batch = g["d_component"].unionByName(g["d_component"])
    return store.to_add(batch, g.sql(_HELD)).select("digest", "kind")


@query(
    "append_conflicts",
    """
WITH b AS (SELECT run, case_id, replicate, count(*) AS n FROM d_call_raw GROUP BY run, case_id, replicate)
SELECT run, case_id, replicate, 'twice in the batch' AS reason FROM b WHERE n > 1
UNION ALL SELECT b.run, b.case_id, b.replicate, 'already stored' FROM b SEMI JOIN (SELECT * FROM d_call WHERE attempts = 3) s ON s.run = b.run AND s.case_id = b.case_id AND s.replicate = b.replicate""",
)
def append_conflicts(g: Given) -> DataFrame:
    return store.conflicts(g["d_call_raw"], g["d_call"].where("attempts = 3"), ["run", "case_id", "replicate"])


@query("digest_verify", "SELECT digest, name FROM d_stored WHERE digest <> concat('sha256:', sha256(canonical))")
def digest_verify(g: Given) -> DataFrame:
    return store.corrupt(g["d_stored"]).select("digest", "name")


@query(
    "bundle_export",
    f"{_CLOSURE} SELECT c.digest, c.kind, c.label, r.digest IS NOT NULL AS is_root FROM d_component c JOIN reach ON reach.digest = c.digest LEFT JOIN roots r ON r.digest = c.digest",
)
def bundle_export(g: Given) -> DataFrame:
    return bundle.export(g.sql(_ROOTS), g["d_component"], g["d_ref"])


_BUNDLE = "SELECT name AS digest, kind, canonical, digest AS hashed FROM d_stored WHERE kind IN ('order', 'customer', 'nation')"


@query(
    "bundle_verify",
    f"""
WITH b AS ({_BUNDLE}), roots AS ({_ROOTS}),
o AS (SELECT r.* FROM d_ref r SEMI JOIN b ON b.digest = r.src)
SELECT 'error' AS level, 'bundle.root' AS code, 'root missing from bundle' AS message, r.digest AS subject, CAST(NULL AS STRING) AS log_id FROM (SELECT digest FROM roots UNION SELECT 'order:none') r ANTI JOIN b ON b.digest = r.digest
UNION ALL SELECT 'error', 'ref.missing', concat(dst, ' is missing'), concat(src, path), NULL FROM o ANTI JOIN b ON b.digest = o.dst
UNION ALL SELECT 'error', 'ref.kind', concat(kind, ' is not one of ', kinds), concat(src, path), NULL FROM o JOIN b ON b.digest = o.dst WHERE kind <> kinds
UNION ALL SELECT 'error', 'bundle.digest', concat(digest, ' does not match its bytes'), digest, NULL FROM b WHERE digest <> concat('sha256:', sha256(canonical))""",
)
def bundle_verify(g: Given) -> DataFrame:
    """A bundle under names that aren't digests, without the suppliers and regions it refers to."""
    roots = g.sql(_ROOTS).unionByName(g.spark.range(1).select(F.lit("order:none").alias("digest")))
    return bundle.verify(g.sql(_BUNDLE), roots, refs(g))


@query(
    "canonical_json",
    """
SELECT o_orderkey, concat('{"customer":', CAST(o_custkey AS STRING), ',"kind":"order"', CASE WHEN o_orderpriority <> '5-LOW' THEN concat(',"priority":"', o_orderpriority, '"') ELSE '' END,
  ',"status":["', o_orderstatus, '"],"v":1}') AS canonical FROM orders""",
)
def canonical_json(g: Given) -> DataFrame:
    fields = {
        "kind": F.lit("order"),
        "v": F.lit(1),
        "customer": F.col("o_custkey"),
        "priority": F.col("o_orderpriority"),
        "status": F.array("o_orderstatus"),
    }
    return g["orders"].select("o_orderkey", hashing.canonical(fields, {"priority": "5-LOW"}).alias("canonical"))


_DIGESTS = """
WITH r AS (SELECT r_regionkey, concat('sha256:', sha256(concat('{"kind":"region","name":"', r_name, '"}'))) AS digest FROM region),
n AS (SELECT n_nationkey, concat('sha256:', sha256(concat('{"kind":"nation","name":"', n_name, '","region":"', digest, '"}'))) AS digest FROM nation JOIN r ON r_regionkey = n_regionkey),
c AS (SELECT c_custkey, concat('sha256:', sha256(concat('{"kind":"customer","name":"', c_name, '","nation":"', digest, '"}'))) AS digest FROM customer JOIN n ON n_nationkey = c_nationkey)
SELECT o_orderkey, concat('sha256:', sha256(concat('{"customer":"', digest, '","kind":"order","status":"', o_orderstatus, '"}'))) AS digest FROM orders JOIN c ON c_custkey = o_custkey"""


@query("component_digest", _DIGESTS)
def component_digest(g: Given) -> DataFrame:
    """Digests from the leaves up: each component's canonical form holds its children's digests."""

    def level(rows: DataFrame, key: str, kind: str, fields: dict, children: DataFrame | None = None, child: str = "", by: str = "") -> DataFrame:
        if children is not None:
            rows = rows.join(children.select(F.col("key").alias(by), F.col("digest").alias(child)), by)
            fields = {**fields, child: F.col(child)}
        text = hashing.canonical({"kind": F.lit(kind), **fields})
        return rows.select(F.col(key).alias("key"), hashing.digest(text).alias("digest"))

    regions = level(g["region"], "r_regionkey", "region", {"name": F.col("r_name")})
    nations = level(g["nation"], "n_nationkey", "nation", {"name": F.col("n_name")}, regions, "region", "n_regionkey")
    customers = level(g["customer"], "c_custkey", "customer", {"name": F.col("c_name")}, nations, "nation", "c_nationkey")
    orders = level(g["orders"], "o_orderkey", "order", {"status": F.col("o_orderstatus")}, customers, "customer", "o_custkey")
    return orders.withColumnRenamed("key", "o_orderkey")


_PAYLOAD = """
SELECT o_orderkey, o_custkey, o_orderstatus, concat('{"key":', CAST(CASE WHEN o_orderkey % 41 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS STRING), ',"customer":', CAST(o_custkey AS STRING),
  CASE WHEN o_orderkey % 53 = 0 THEN '' ELSE concat(',"status":"', o_orderstatus, '"') END, '}') AS payload FROM orders"""


@query(
    "payload_consistency",
    """
SELECT o_orderkey, 'o_orderkey' AS "column" FROM orders WHERE o_orderkey % 41 = 0 UNION ALL SELECT o_orderkey, 'o_orderstatus' FROM orders WHERE o_orderkey % 53 = 0""",
)
def payload_consistency(g: Given) -> DataFrame:
    columns = {"o_orderkey": "$.key", "o_custkey": "$.customer", "o_orderstatus": "$.status"}
    return store.inconsistent(g.sql(_PAYLOAD), "payload", columns).select("o_orderkey", "column")
