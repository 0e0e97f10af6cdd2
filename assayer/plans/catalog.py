"""Queries over the catalogue: the events, taken as edits and entries of threads, and the
documents, taken as bound vignettes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import catalog, families, titles
from .registry import query
from .tables import Dialect, Given, register_view

# --------------------------------------------------------------- oracle building blocks

_LAST = "SELECT thread, arg_max(id, id) AS id, arg_max(digest, id) AS digest, arg_max(kind, id) AS kind FROM d_edit GROUP BY thread"
_ABOUT = """
about AS (
  SELECT e.thread, max(e.value) FILTER (field = 'name') AS name, max(person) FILTER (field = 'owner') AS owner, coalesce(bool_or(present) FILTER (field = 'deleted'), false) AS deleted,
    coalesce(string_agg(value, ',' ORDER BY value) FILTER (field = 'tag' AND present), '') AS tags,
    coalesce(string_agg(CAST(person AS VARCHAR), ',' ORDER BY person) FILTER (field = 'collaborator' AND present), '') AS collaborators
  FROM (SELECT * FROM d_entry QUALIFY row_number() OVER (PARTITION BY thread, field, CASE field WHEN 'tag' THEN value WHEN 'collaborator' THEN CAST(person AS VARCHAR) END ORDER BY id DESC) = 1) e GROUP BY e.thread)"""
_NOW = "now AS (SELECT family, max(id) AS id, arg_max(source, id) AS source, arg_max(source_id, id) AS source_id, arg_max(hex, id) AS hex FROM d_binding GROUP BY family)"
_FAMILY = "fam AS (SELECT c.*, b.family FROM d_case c JOIN (SELECT source, source_id, hex, arg_max(family, id) AS family FROM d_binding GROUP BY source, source_id, hex) b ON b.source = c.source AND b.source_id = c.source_id AND b.hex = c.hex)"


# ------------------------------------------------------------------------------- threads


@query("thread_heads", f"SELECT thread, id, digest, kind FROM ({_LAST}) h")
def thread_heads(g: Given) -> DataFrame:
    return catalog.heads(g["d_edit"]).select("thread", "id", "digest", "kind")


def _joined(known: DataFrame) -> DataFrame:
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return known.withColumn("tags", listed("tags")).withColumn("collaborators", listed("collaborators"))


@query("about", f"WITH {_ABOUT} SELECT * FROM about")
def about(g: Given) -> DataFrame:
    return _joined(catalog.about(g["d_entry"])).drop("description", "language")


@query("thread_history", "SELECT thread, id, digest, row_number() OVER (PARTITION BY thread ORDER BY id) - 1 AS position FROM d_edit")
def thread_history(g: Given) -> DataFrame:
    # Small chunks here, so that the given tables span several.
    return catalog.history(g["d_edit"], width=4096).select("thread", "id", "digest", "position")


@query(
    "live_heads",
    f"WITH {_ABOUT}, h AS ({_LAST}) SELECT h.thread, h.id, h.digest FROM h LEFT JOIN about a ON a.thread = h.thread WHERE kind = 'skeleton' AND NOT coalesce(deleted, false)",
)
def live_heads(g: Given) -> DataFrame:
    return catalog.live_heads(g["d_edit"], g["d_entry"], "skeleton").select("thread", "id", "digest")


@query(
    "find_threads",
    f"WITH {_ABOUT} SELECT t.id AS thread, name, owner FROM d_thread t JOIN about a ON a.thread = t.id WHERE kind = 'skeleton' AND name = 'n12' AND NOT deleted",
)
def find_threads(g: Given) -> DataFrame:
    return catalog.find(g["d_thread"], g["d_entry"], "skeleton", "n12").select("thread", "name", "owner")


@query("forks", "SELECT e.thread AS origin, t.id AS fork FROM d_thread t JOIN d_edit e ON e.id = t.forked_from")
def forks(g: Given) -> DataFrame:
    return catalog.forks(g["d_thread"], g["d_edit"])


_DIGESTS = "SELECT DISTINCT digest FROM d_edit WHERE kind = 'skeleton'"


@query("heads_holding", f"WITH h AS ({_LAST}) SELECT h.thread, h.digest FROM h SEMI JOIN ({_DIGESTS}) d ON d.digest = h.digest")
def heads_holding(g: Given) -> DataFrame:
    return catalog.heads_holding(g["d_edit"], g.sql(_DIGESTS)).select("thread", "digest")


@query("subjects_naming", "SELECT DISTINCT thread FROM d_entry WHERE person = 7")
def subjects_naming(g: Given) -> DataFrame:
    return catalog.subjects_naming(g["d_entry"], 7)


# References from components to digests edits have held: one per order.
def _edit_ref(d: Dialect) -> str:
    kind = "CASE o_custkey % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'signup' WHEN 3 THEN 'purchase' ELSE 'error' END"
    digest = d.sha(f"concat({kind}, CAST({d.div('o_orderkey', 20)} AS STRING))")
    return f"SELECT concat('order:', CAST(o_orderkey AS STRING)) AS src, '/skeleton' AS path, {digest} AS digest FROM orders"


register_view("d_edit_ref", _edit_ref)


@query(
    "behind",
    f"""
WITH {_ABOUT}, h AS ({_LAST}), held AS (SELECT DISTINCT digest, thread FROM d_edit)
SELECT r.src, r.path, r.digest, held.thread, h.id AS head, h.digest AS head_digest
FROM d_edit_ref r JOIN held ON held.digest = r.digest JOIN h ON h.thread = held.thread LEFT JOIN about a ON a.thread = h.thread WHERE h.digest <> r.digest AND NOT coalesce(a.deleted, false)""",
)
def behind(g: Given) -> DataFrame:
    return catalog.behind(g["d_edit_ref"], g["d_edit"], g["d_entry"])


# ------------------------------------------------------------------------ forks and bases


def _field(d: Dialect) -> str:
    """The top-level fields of every digest's document."""
    rows = "inline(array(struct('/a' AS path, substring(digest, 1, 1) AS value), struct('/b' AS path, substring(digest, 2, 1) AS value), struct('/c' AS path, 'same' AS value), struct('/d' AS path, CASE WHEN substring(digest, 3, 1) < '8' THEN substring(digest, 3, 1) END AS value)))"
    duck = "unnest([{'path': '/a', 'value': substring(digest, 1, 1)}, {'path': '/b', 'value': substring(digest, 2, 1)}, {'path': '/c', 'value': 'same'}, {'path': '/d', 'value': CASE WHEN substring(digest, 3, 1) < '8' THEN substring(digest, 3, 1) END}], recursive := true)"
    return f"SELECT * FROM (SELECT digest, {rows if d.spark else duck} FROM (SELECT DISTINCT digest FROM d_edit) e) f WHERE value IS NOT NULL"


register_view("d_field", _field)

_BASES = f"""
h AS ({_LAST}),
forked AS (SELECT t.id AS thread, coalesce(b.based_on, t.forked_from) AS base, o.thread AS origin, o.digest AS base_digest, own.digest AS fork_digest, oh.id AS origin_head, oh.digest AS origin_digest
  FROM d_thread t LEFT JOIN (SELECT thread, arg_max(based_on, id) AS based_on FROM d_edit WHERE based_on IS NOT NULL GROUP BY thread) b ON b.thread = t.id
  JOIN d_edit o ON o.id = coalesce(b.based_on, t.forked_from) JOIN h own ON own.thread = t.id JOIN h oh ON oh.thread = o.thread WHERE t.forked_from IS NOT NULL),
varied AS (SELECT coalesce(b.thread, a.thread) AS thread, coalesce(b.path, a.path) AS path, b.value AS before, a.value AS after
  FROM (SELECT thread, path, value FROM forked JOIN d_field f ON f.digest = base_digest) b FULL JOIN (SELECT thread, path, value FROM forked JOIN d_field f ON f.digest = fork_digest) a ON a.thread = b.thread AND a.path = b.path
  WHERE b.value IS DISTINCT FROM a.value)"""


@query("variation", f"WITH {_BASES} SELECT v.*, f.origin_head <> f.base AS moved FROM varied v JOIN forked f ON f.thread = v.thread")
def variation(g: Given) -> DataFrame:
    forked = catalog.bases(g["d_thread"], g["d_edit"])
    return catalog.variation(forked, g["d_field"]).join(forked.select("thread", "moved"), "thread")


@query(
    "proposal",
    f"""
WITH {_BASES}, head AS (SELECT thread, path, value FROM forked JOIN d_field f ON f.digest = origin_digest WHERE origin_head <> base),
v AS (SELECT v.* FROM varied v JOIN forked f ON f.thread = v.thread WHERE origin_head <> base)
SELECT coalesce(head.thread, v.thread) AS thread, coalesce(head.path, v.path) AS path, CASE WHEN v.thread IS NOT NULL THEN v.after ELSE head.value END AS value
FROM head FULL JOIN v ON v.thread = head.thread AND v.path = head.path WHERE CASE WHEN v.thread IS NOT NULL THEN v.after ELSE head.value END IS NOT NULL""",
)
def proposal(g: Given) -> DataFrame:
    forked = catalog.bases(g["d_thread"], g["d_edit"])
    return catalog.proposal(forked, catalog.variation(forked, g["d_field"]), g["d_field"])


@query(
    "based_on_violations",
    """
SELECT 'error' AS level, 'edit.based_on' AS code, concat('edit ', CAST(e.based_on AS STRING), ' is not in the origin of thread ', CAST(e.thread AS STRING)) AS message, CAST(e.id AS STRING) AS subject, CAST(NULL AS STRING) AS log_id
FROM d_edit e JOIN d_thread t ON t.id = e.thread LEFT JOIN d_edit o ON o.id = t.forked_from LEFT JOIN d_edit b ON b.id = e.based_on
WHERE e.based_on IS NOT NULL AND NOT coalesce(b.thread = o.thread AND e.based_on >= t.forked_from, false)""",
)
def based_on_violations(g: Given) -> DataFrame:
    return catalog.based_on_violations(g["d_thread"], g["d_edit"])


@query(
    "display_names",
    f"""
WITH {_ABOUT}, h AS ({_LAST}), described AS (SELECT digest, concat('component ', left(digest, 6)) AS description FROM (SELECT DISTINCT digest FROM d_edit) e),
c AS (SELECT e.digest, e.thread, a.name, h.digest = e.digest AS is_head, CASE WHEN coalesce(a.deleted, false) THEN 3 ELSE 0 END AS base FROM (SELECT DISTINCT digest, thread FROM d_edit) e JOIN h ON h.thread = e.thread LEFT JOIN about a ON a.thread = e.thread),
r AS (SELECT digest, thread, base + CASE WHEN is_head AND name IS NOT NULL THEN 0 WHEN is_head THEN 1 ELSE 2 END AS rank, CASE WHEN is_head THEN name ELSE concat(name, ' (earlier)') END AS label FROM c WHERE is_head OR name IS NOT NULL),
best AS (SELECT digest, label FROM r QUALIFY row_number() OVER (PARTITION BY digest ORDER BY rank, thread) = 1)
SELECT d.digest, coalesce(label, description) AS title FROM described d LEFT JOIN best b ON b.digest = d.digest""",
)
def display_names(g: Given) -> DataFrame:
    described = g["d_edit"].select("digest").distinct().withColumn(
        "description", F.concat(F.lit("component "), F.substring("digest", 1, 6))
    )
    return catalog.display_names(g["d_edit"], g["d_entry"], described)


def _compilation(d: Dialect) -> str:
    return f"SELECT DISTINCT {d.sha("concat('compilation', CAST(event_id % 11 AS STRING))")} AS compilation, concat('recipe ', CAST(event_id % 11 AS STRING)) AS recipe FROM events WHERE event_id % 11 <> 6"


register_view("d_compilation", _compilation)


@query(
    "head_recipes",
    "SELECT h.thread, h.id AS head, c.recipe FROM (SELECT thread, arg_max(id, id) AS id, arg_max(coalesce(compilation, ''), id) AS compilation FROM d_edit GROUP BY thread) h JOIN d_compilation c ON c.compilation = h.compilation",
)
def head_recipes(g: Given) -> DataFrame:
    return catalog.head_recipes(g["d_edit"], g["d_compilation"])


# ------------------------------------------------------- recipes: variations, proposals, titles

# What a recipe's parts are, by its number: instructions, prompt and sampling, some missing.
_PARTS_OF = {"instructions": "CASE WHEN k % 3 <> 0 THEN k % 4 END", "prompt": "4 + k % 2", "sampling": "CASE WHEN k % 2 = 0 THEN 6 END"}


def _recipe_number(d: Dialect) -> str:
    return f"SELECT DISTINCT event_id % 11 AS k, {d.sha("concat('compilation', CAST(event_id % 11 AS STRING))")} AS compilation FROM events WHERE event_id % 11 <> 6"


def _recipe_part(d: Dialect) -> str:
    """(compilation, purpose, pos, field, digest), no row for a missing part."""
    purpose = "CASE WHEN k % 5 = 0 THEN 'judge' ELSE 'generation' END AS purpose"
    rows = " UNION ALL ".join(f"SELECT compilation, {purpose}, {pos} AS pos, '{field}' AS field, {part} AS part FROM d_recipe_number" for pos, (field, part) in enumerate(_PARTS_OF.items()))
    return f"SELECT compilation, purpose, pos, field, concat('sha256:', {d.sha("concat('part', CAST(part AS STRING))")}) AS digest FROM ({rows}) r WHERE part IS NOT NULL"


def _recipe_doc(d: Dialect) -> str:
    part = lambda p: f"coalesce(concat('\"sha256:', {d.sha(f"concat('part', CAST({p} AS STRING))")}, '\"'), 'null')"
    members = "".join(f", ',\"{field}\":', {part(p) if field == 'prompt' else f'CASE WHEN ({p}) IS NULL THEN {chr(39)}null{chr(39)} ELSE {part(p)} END'}" for field, p in _PARTS_OF.items())
    return f"SELECT compilation, concat('{{\"purpose\":\"', CASE WHEN k % 5 = 0 THEN 'judge' ELSE 'generation' END, '\"'{members}, ',\"layout\":{{\"z\":', CAST(k % 3 AS STRING), '}}}}') AS recipe FROM d_recipe_number"


def _json_field(d: Dialect) -> str:
    return "SELECT digest, path, concat('\"', value, '\"') AS value FROM d_field"


for _name, _build in {"d_recipe_number": _recipe_number, "d_recipe_part": _recipe_part, "d_recipe_doc": _recipe_doc, "d_json_field": _json_field}.items():
    register_view(_name, _build)

_RECIPE_FIELDS = """
SELECT n.compilation, '/recipe/purpose' AS path, CASE WHEN k % 5 = 0 THEN '"judge"' ELSE '"generation"' END AS value FROM d_recipe_number n
UNION ALL SELECT compilation, '/recipe/layout', concat('{"z":', CAST(k % 3 AS STRING), '}') FROM d_recipe_number
UNION ALL SELECT n.compilation, concat('/recipe/', f.field), CASE WHEN p.digest IS NULL THEN 'null' ELSE concat('"', p.digest, '"') END FROM d_recipe_number n CROSS JOIN (SELECT unnest(['instructions', 'prompt', 'sampling']) AS field) f LEFT JOIN d_recipe_part p ON p.compilation = n.compilation AND p.field = f.field"""

_SHAPED_BASES = f"""
h AS (SELECT thread, max(id) AS id, arg_max(digest, id) AS digest, nullif(arg_max(coalesce(compilation, ''), id), '') AS compilation FROM d_edit GROUP BY thread),
forked AS (SELECT t.id AS thread, coalesce(b.based_on, t.forked_from) AS base, o.thread AS origin, o.digest AS base_digest, o.compilation AS base_compilation, own.digest AS fork_digest, own.compilation AS fork_compilation,
    oh.id AS origin_head, oh.digest AS origin_digest, oh.compilation AS origin_compilation, o.compilation IS NOT NULL AND own.compilation IS NOT NULL AS made
  FROM d_thread t LEFT JOIN (SELECT thread, arg_max(based_on, id) AS based_on FROM d_edit WHERE based_on IS NOT NULL GROUP BY thread) b ON b.thread = t.id
  JOIN d_edit o ON o.id = coalesce(b.based_on, t.forked_from) JOIN h own ON own.thread = t.id JOIN h oh ON oh.thread = o.thread WHERE t.forked_from IS NOT NULL),
rf AS ({_RECIPE_FIELDS.strip()}),
was AS (SELECT thread, path, value FROM forked JOIN d_json_field f ON f.digest = base_digest WHERE NOT made UNION ALL SELECT thread, path, value FROM forked JOIN rf ON rf.compilation = base_compilation WHERE made),
own AS (SELECT thread, path, value FROM forked JOIN d_json_field f ON f.digest = fork_digest WHERE NOT made UNION ALL SELECT thread, path, value FROM forked JOIN rf ON rf.compilation = fork_compilation WHERE made),
varied AS (SELECT coalesce(w.thread, o.thread) AS thread, coalesce(w.path, o.path) AS path, w.value AS before, o.value AS after FROM was w FULL JOIN own o ON o.thread = w.thread AND o.path = w.path WHERE w.value IS DISTINCT FROM o.value)"""


def _shapes(g: Given):
    return catalog.bases(g["d_thread"], g["d_edit"]), g["d_json_field"], catalog.recipe_fields(g["d_recipe_doc"])


@query("variation_in_shape", f"WITH {_SHAPED_BASES.strip()} SELECT * FROM varied")
def variation_in_shape(g: Given) -> DataFrame:
    """What forks change, by recipe where both are compiled."""
    return catalog.variation_in_shape(*_shapes(g))


@query(
    "proposal_in_shape",
    f"""
WITH {_SHAPED_BASES.strip()}, m AS (SELECT * FROM forked WHERE origin_head <> base AND (NOT made OR origin_compilation IS NOT NULL)),
head AS (SELECT thread, path, value FROM m JOIN d_json_field f ON f.digest = origin_digest WHERE NOT made UNION ALL SELECT thread, path, value FROM m JOIN rf ON rf.compilation = origin_compilation WHERE made),
v AS (SELECT v.*, made FROM varied v JOIN m ON m.thread = v.thread),
merged AS (SELECT coalesce(head.thread, v.thread) AS thread, coalesce(head.path, v.path) AS path, CASE WHEN v.thread IS NULL THEN head.value WHEN made THEN coalesce(v.after, 'null') ELSE v.after END AS value FROM head FULL JOIN v ON v.thread = head.thread AND v.path = head.path)
SELECT * FROM merged WHERE value IS NOT NULL""",
)
def proposal_in_shape(g: Given) -> DataFrame:
    """Where the origin moved: its recipe or document with the fork's changes on top."""
    forked, fields, recipes = _shapes(g)
    return catalog.proposal_in_shape(forked, catalog.variation_in_shape(forked, fields, recipes), fields, recipes)


_ROOT = "SELECT digest, concat(source, '/', source_id) AS root, appendix FROM d_case"


@query(
    "composed_titles",
    f"""
WITH RECURSIVE {_ABOUT.strip()}, {_SHAPED_BASES.strip()},
part AS (SELECT DISTINCT digest, concat('component ', substr(digest, 8, 6)) AS title FROM d_recipe_part),
rt AS (SELECT compilation, concat(CASE WHEN any_value(purpose) = 'judge' THEN 'judge: ' ELSE '' END, string_agg(title, ' · ' ORDER BY pos)) AS title FROM d_recipe_part r JOIN part p ON p.digest = r.digest GROUP BY compilation),
first AS (SELECT digest, min(compilation) AS compilation FROM (SELECT e.digest, e.compilation FROM d_edit e JOIN rt ON rt.compilation = e.compilation) c GROUP BY digest),
own_title AS (SELECT d.digest, coalesce(rt.title, concat('component ', left(d.digest, 6))) AS title FROM (SELECT DISTINCT digest FROM d_edit) d LEFT JOIN first f ON f.digest = d.digest LEFT JOIN rt ON rt.compilation = f.compilation),
ch AS (SELECT thread, string_agg(concat(', ', CASE WHEN after IS NULL OR after = 'null' THEN concat('no ', key) WHEN p.digest IS NOT NULL THEN concat(key, ': ', p.title) WHEN after LIKE '"%' THEN concat(key, ': ', after) ELSE concat(key, ': ', replace(after, ':', ': ')) END), '' ORDER BY path) AS changes
  FROM (SELECT *, replace(replace(path, '/recipe/', ''), '/', '') AS key FROM varied) v LEFT JOIN part p ON concat('"', p.digest, '"') = v.after GROUP BY thread),
state AS (SELECT h.*, a.name, coalesce(a.deleted, false) AS deleted, f.origin FROM h LEFT JOIN about a ON a.thread = h.thread LEFT JOIN forked f ON f.thread = h.thread),
t AS (SELECT s.thread, coalesce(name, rt.title, o.title) AS title FROM state s LEFT JOIN rt ON rt.compilation = s.compilation LEFT JOIN own_title o ON o.digest = s.digest WHERE name IS NOT NULL OR origin IS NULL
  UNION ALL SELECT s.thread, CASE WHEN ch.changes IS NULL THEN concat('a fork of ', t.title) ELSE concat(t.title, ch.changes) END FROM t JOIN state s ON s.origin = t.thread AND s.name IS NULL LEFT JOIN ch ON ch.thread = s.thread),
c AS (SELECT e.digest, e.thread, s.name, s.digest = e.digest AS is_head, CASE WHEN s.deleted THEN 3 ELSE 0 END AS base FROM (SELECT DISTINCT digest, thread FROM d_edit) e JOIN state s ON s.thread = e.thread),
r AS (SELECT digest, thread, base + CASE WHEN is_head AND name IS NOT NULL THEN 0 WHEN is_head THEN 1 ELSE 2 END AS rank, CASE WHEN is_head AND name IS NULL THEN t.title WHEN is_head THEN name ELSE concat(name, ' (earlier)') END AS label FROM (SELECT c.*, t.title FROM c JOIN t ON t.thread = c.thread) t WHERE is_head OR name IS NOT NULL),
best AS (SELECT digest, label FROM r QUALIFY row_number() OVER (PARTITION BY digest ORDER BY rank, thread) = 1)
SELECT concat('t:', CAST(thread AS STRING)) AS key, title FROM t
UNION ALL SELECT concat('d:', o.digest), coalesce(b.label, o.title) FROM own_title o LEFT JOIN best b ON b.digest = o.digest
UNION ALL SELECT concat('d:', digest), concat(root, CASE WHEN appendix IS NULL THEN '' ELSE concat(' with "note ', substr(appendix, 10), '"') END) FROM ({_ROOT}) x
UNION ALL SELECT concat('d:', appendix), concat('"note ', substr(appendix, 10), '"') FROM d_case WHERE appendix IS NOT NULL
UNION ALL SELECT concat('d:', digest), title FROM part""",
)
def composed_titles(g: Given) -> DataFrame:
    """Titles of all threads and digests: names, forks by their changes, recipes by their parts, cases with appendices."""
    g = g.kept("d_thread", "d_recipe_doc", "d_recipe_part")
    forked, fields, recipes = _shapes(g)
    forked = forked.checkpoint()
    varied = catalog.variation_in_shape(forked, fields, recipes).checkpoint()
    short = F.concat(F.lit("component "), F.substring(F.regexp_replace("digest", "^sha256:", ""), 1, 6))
    notes = _appendices(g).select("digest", text.snippet(F.col("text")).alias("description"))
    edited, used = g["d_edit"].select("digest").distinct(), g["d_recipe_part"].select("digest").distinct()
    described = edited.unionByName(used).withColumn("description", short).unionByName(notes)
    compilations = g["d_edit"].where("compilation IS NOT NULL").select(F.col("digest").alias("skeleton"), "compilation").distinct()
    cases = g.sql(_ROOT).select("digest", "root", F.array_compact(F.array("appendix")).alias("appendices"))
    parts = titles.title_parts(g["d_edit"], g["d_entry"], forked, varied, described, g["d_recipe_part"], compilations, cases)
    return titles.fold(parts).where("key NOT LIKE 'o:%'")


# ----------------------------------------------------------------------------- languages

# Recipes are orders, their text parts lineitems' parts, five of which share a text; skeletons are customers.
_PARTS = "SELECT l_orderkey AS recipe, l_partkey - l_partkey % 5 AS digest FROM lineitem"
_COMPILED = "SELECT o_custkey AS skeleton, o_orderkey AS recipe FROM orders"
_LANGUAGES = """
SELECT p_partkey AS id, p_partkey - p_partkey % 5 AS digest, CASE WHEN p_partkey % 10 < 7 THEN 'sv' WHEN p_size % 2 = 0 THEN 'en' ELSE 'de' END AS value FROM part WHERE p_partkey % 400 < 390"""


@query(
    "language_vote",
    f"""
WITH own AS (SELECT digest, arg_max(value, id) AS language FROM ({_LANGUAGES}) l GROUP BY digest),
r AS (SELECT recipe, CASE WHEN count(*) = count(language) AND min(language) = max(language) THEN max(language) END AS language FROM ({_PARTS}) p LEFT JOIN own ON own.digest = p.digest GROUP BY recipe)
SELECT skeleton, CASE WHEN min(language) = max(language) THEN max(language) END AS language FROM ({_COMPILED}) c LEFT JOIN r ON r.recipe = c.recipe GROUP BY skeleton""",
)
def language_vote(g: Given) -> DataFrame:
    return catalog.language_vote(g.sql(_PARTS), g.sql(_COMPILED), g.sql(_LANGUAGES))


# Recipes with translations, skeletons of which some aren't compiled, and what takes its language from others.
_RECIPES = "SELECT o_orderkey AS recipe, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey - o_custkey % 5 END AS translations FROM orders"
_SOME_COMPILED = f"SELECT * FROM ({_COMPILED}) c WHERE skeleton % 3 <> 0"
_SPEAKING = """
SELECT concat('skeleton:', CAST(c_custkey AS STRING)) AS digest, 'skeleton' AS kind, CAST(NULL AS STRING) AS of FROM customer
UNION ALL SELECT concat('trial:', CAST(c_custkey AS STRING)), CASE WHEN c_custkey % 2 = 0 THEN 'trial' ELSE 'judge' END, concat('skeleton:', CAST(c_custkey + 1 AS STRING)) FROM customer
UNION ALL SELECT digest, 'case', NULL FROM d_case UNION ALL SELECT concat('expectation:', CAST(doc_id AS STRING)), 'expectation', digest FROM d_case
UNION ALL SELECT DISTINCT concat('part:', CAST(p_partkey - p_partkey % 5 AS STRING)), 'chunk.prompt', CAST(NULL AS STRING) FROM part"""
_CASE_FAMILY = "SELECT digest, CASE WHEN doc_id % 6 <> 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'sv' ELSE 'en' END END AS language FROM d_case"
_ALL_LANGUAGES = f"""
SELECT id, concat('part:', CAST(digest AS STRING)) AS digest, value FROM ({_LANGUAGES}) l UNION ALL SELECT c_custkey, concat('skeleton:', CAST(c_custkey AS STRING)), 'fr' FROM customer WHERE c_custkey % 2 = 0"""


@query(
    "languages_of",
    f"""
WITH own AS (SELECT digest, arg_max(value, id) AS language FROM ({_ALL_LANGUAGES}) l GROUP BY digest),
a AS (SELECT recipe, CASE WHEN count(*) = count(language) AND min(language) = max(language) THEN max(language) END AS agreed FROM ({_PARTS}) p LEFT JOIN own ON own.digest = concat('part:', CAST(p.digest AS STRING)) GROUP BY recipe),
r AS (SELECT r.recipe, CASE WHEN translations IS NOT NULL THEN own.language ELSE agreed END AS language FROM ({_RECIPES}) r LEFT JOIN own ON own.digest = concat('part:', CAST(translations AS STRING)) LEFT JOIN a ON a.recipe = r.recipe),
v AS (SELECT concat('skeleton:', CAST(skeleton AS STRING)) AS digest, CASE WHEN min(language) = max(language) THEN max(language) END AS vote FROM ({_SOME_COMPILED}) c LEFT JOIN r ON r.recipe = c.recipe GROUP BY skeleton),
t AS (SELECT s.digest, s.kind, s.of, CASE WHEN kind = 'case' THEN f.language WHEN kind = 'skeleton' AND v.digest IS NOT NULL THEN v.vote ELSE own.language END AS language
  FROM ({_SPEAKING}) s LEFT JOIN own ON own.digest = s.digest LEFT JOIN v ON v.digest = s.digest LEFT JOIN ({_CASE_FAMILY}) f ON f.digest = s.digest)
SELECT digest, language FROM t WHERE kind IN ('case', 'skeleton', 'chunk.prompt') UNION ALL SELECT t.digest, o.language FROM t LEFT JOIN t o ON o.digest = t.of WHERE t.kind IN ('trial', 'judge', 'expectation')""",
)
def languages_of(g: Given) -> DataFrame:
    """Languages of components of every kind: families', recipes' votes, own ones, and those taken from others."""
    languages = g.sql(_ALL_LANGUAGES)
    part = lambda c: F.concat(F.lit("part:"), F.col(c).cast("string"))
    parts = g.sql(_PARTS).select("recipe", part("digest").alias("digest"))
    recipes = g.sql(_RECIPES).select("recipe", part("translations").alias("translations"))
    compiled = g.sql(_SOME_COMPILED).select(F.concat(F.lit("skeleton:"), F.col("skeleton").cast("string")).alias("skeleton"), "recipe")
    return catalog.languages_of(g.sql(_SPEAKING), compiled, catalog.recipe_languages(recipes, parts, languages), languages, g.sql(_CASE_FAMILY))


_TRIAL_LANG = "SELECT run AS trial, CASE run % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'sv' END AS language FROM d_run"
_CASE_LANG = "SELECT c.run AS trial, CASE WHEN doc_id % 10 <> 0 THEN lang END AS language FROM (SELECT DISTINCT run, case_id FROM d_call) c JOIN documents d ON d.doc_id = c.case_id"


@query(
    "language_mixed",
    f"""
WITH t AS ({_TRIAL_LANG}), c AS ({_CASE_LANG}),
n AS (SELECT t.trial, t.language, count(*) AS n, count(*) FILTER (c.language IS NULL) AS unknown, count(*) FILTER (c.language <> t.language) AS other, string_agg(DISTINCT c.language, ', ' ORDER BY c.language) FILTER (c.language <> t.language) AS others FROM t JOIN c ON c.trial = t.trial GROUP BY t.trial, t.language),
f AS (SELECT 'info' AS level, 'language.unknown' AS code, 'the request''s language is unknown' AS message, trial FROM n WHERE language IS NULL
UNION ALL SELECT 'info', 'language.unknown', concat('the language of ', CAST(unknown AS STRING), ' of ', CAST(n AS STRING), ' cases is unknown'), trial FROM n WHERE language IS NOT NULL AND unknown > 0
UNION ALL SELECT 'warning', 'language.mixed', concat('the request is ', language, ', but ', CAST(other AS STRING), ' of ', CAST(n AS STRING), ' cases ', CASE WHEN other = 1 THEN 'is' ELSE 'are' END, ' ', others), trial FROM n WHERE language IS NOT NULL AND other > 0)
SELECT level, code, message, CAST(trial AS STRING) AS subject, CAST(NULL AS STRING) AS log_id FROM f""",
)
def language_mixed(g: Given) -> DataFrame:
    return catalog.language_mixed(g.sql(_TRIAL_LANG), g.sql(_CASE_LANG))


_KINDS = "SELECT c_custkey AS digest, CASE c_nationkey % 4 WHEN 0 THEN 'skeleton' WHEN 1 THEN 'chunk.prompt' WHEN 2 THEN 'trial' ELSE 'chunk.output' END AS kind FROM customer"
_GIVEN = "SELECT o_custkey + o_orderkey % 2 * 40 AS digest, CASE WHEN o_orderkey % 9 = 0 THEN 'Swedish' ELSE 'sv' END AS value FROM orders"
_HAS = "SELECT o_custkey AS skeleton FROM orders WHERE o_orderpriority LIKE '1%'"


@query(
    "language_rules",
    f"""
WITH r AS (SELECT g.*, k.kind, h.skeleton IS NOT NULL AS compiled FROM ({_GIVEN}) g LEFT JOIN ({_KINDS}) k ON k.digest = g.digest LEFT JOIN (SELECT DISTINCT skeleton FROM ({_HAS}) x) h ON h.skeleton = g.digest),
f AS (SELECT 'language.subject' AS code, 'not in the store' AS message, digest FROM r WHERE kind IS NULL
UNION ALL SELECT 'language.kind', concat(kind, ' components have no language of their own'), digest FROM r WHERE kind = 'trial'
UNION ALL SELECT 'language.compiled', 'a compiled skeleton''s language comes from its recipe', digest FROM r WHERE kind = 'skeleton' AND compiled
UNION ALL SELECT 'language.tag', concat('''', value, ''' is not a language tag'), digest FROM r WHERE value = 'Swedish')
SELECT 'error' AS level, code, message, CAST(digest AS STRING) AS subject, CAST(NULL AS STRING) AS log_id FROM f""",
)
def language_rules(g: Given) -> DataFrame:
    return catalog.language_rules(g.sql(_GIVEN), g.sql(_KINDS), g.sql(_HAS))


# --------------------------------------------------------------------------------- plans


@query(
    "owner_sweep",
    f"""
WITH {_ABOUT}
SELECT thread, 'deleted' AS field, CAST(NULL AS BIGINT) AS person, true AS present FROM about WHERE owner = 5 AND NOT deleted
UNION ALL SELECT thread, 'collaborator', 5, false FROM about WHERE list_contains(string_split(collaborators, ','), '5')""",
)
def owner_sweep(g: Given) -> DataFrame:
    return catalog.owner_sweep(g["d_entry"], 5)


_RECORDS = "SELECT user_id * 2 AS thread, max(digest) AS digest FROM (SELECT thread AS user_id, digest FROM d_edit) e GROUP BY user_id"


@query(
    "sync_plan",
    f"""
WITH h AS ({_LAST}) SELECT r.thread, r.digest, CASE WHEN h.digest IS NULL THEN 'created' WHEN h.digest = r.digest THEN 'validated' ELSE 'updated' END AS status FROM ({_RECORDS}) r LEFT JOIN h ON h.thread = r.thread""",
)
def sync_plan(g: Given) -> DataFrame:
    return catalog.sync_plan(g.sql(_RECORDS), g["d_edit"])


@query(
    "share_plan",
    f"WITH {_ABOUT} SELECT t.id AS thread FROM d_thread t LEFT JOIN about a ON a.thread = t.id WHERE NOT coalesce(list_contains(string_split(collaborators, ','), '4'), false)",
)
def share_plan(g: Given) -> DataFrame:
    return catalog.share_plan(g["d_thread"], g["d_entry"], 4)


@query(
    "gift_plan",
    f"""
WITH {_ABOUT}, m AS (SELECT e.thread AS origin, bool_or(NOT deleted) AS live, max(t.id) AS newest FROM d_thread t JOIN d_edit e ON e.id = t.forked_from JOIN about a ON a.thread = t.id WHERE a.owner = 5 GROUP BY e.thread)
SELECT t.id AS origin, CASE WHEN live THEN 'kept' WHEN newest IS NOT NULL THEN 'restored' ELSE 'forked' END AS action, CASE WHEN NOT live THEN newest END AS fork FROM d_thread t LEFT JOIN m ON m.origin = t.id""",
)
def gift_plan(g: Given) -> DataFrame:
    return catalog.gift_plan(g["d_thread"], g["d_edit"], g["d_entry"], 5)


_SHAPED = """
SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN 'name' WHEN 1 THEN 'description' WHEN 2 THEN 'tag' WHEN 3 THEN 'owner' WHEN 4 THEN 'collaborator' WHEN 5 THEN 'deleted' ELSE 'language' END AS field,
  CASE WHEN o_custkey % 5 = 0 THEN NULL WHEN o_custkey % 11 = 0 THEN '' ELSE 'pt-BR' END AS value, CASE WHEN o_custkey % 3 = 0 THEN o_custkey END AS person, o_custkey % 4 <> 0 AS present FROM orders"""


@query(
    "entry_shape",
    f"""
WITH e AS (SELECT *, field IN ('description', 'tag', 'language') OR (field = 'name' AND present) AS texty, field IN ('owner', 'collaborator') AS persony FROM ({_SHAPED}) s),
f AS (SELECT id, 'entry.shape' AS code, concat('wrong value or person for ', field) AS message FROM e WHERE (value IS NOT NULL) <> texty OR (person IS NOT NULL) <> persony
UNION ALL SELECT id, 'entry.removed', concat(field, ' can''t be removed, only replaced') FROM e WHERE NOT present AND field IN ('description', 'owner', 'language')
UNION ALL SELECT id, 'entry.empty', concat(field, ' can''t be empty') FROM e WHERE field IN ('name', 'tag') AND value = ''
UNION ALL SELECT id, 'entry.language', concat('''', value, ''' is not a language tag such as ''sv'' or ''pt-BR''') FROM e WHERE field = 'language' AND value = '')
SELECT 'error' AS level, code, message, CAST(id AS STRING) AS subject, CAST(NULL AS STRING) AS log_id FROM f""",
)
def entry_shape(g: Given) -> DataFrame:
    return catalog.entry_shape(g.sql(_SHAPED))


_LABELS = "SELECT l_partkey AS scorer, CASE WHEN l_returnflag = 'R' THEN 'view' ELSE 'resource' END AS part, l_linenumber - 1 AS position FROM lineitem"


@query(
    "label_positions",
    f"""
SELECT 'error' AS level, 'label.position' AS code, concat('no ', part, ' at position ', CAST(position AS STRING)) AS message, CAST(scorer AS STRING) AS subject, CAST(NULL AS STRING) AS log_id
FROM ({_LABELS}) l JOIN part ON p_partkey = scorer WHERE NOT position BETWEEN 0 AND CASE part WHEN 'view' THEN p_size % 5 + 1 ELSE 2 END - 1""",
)
def label_positions(g: Given) -> DataFrame:
    scorers = g["part"].select(
        F.col("p_partkey").alias("scorer"), (F.col("p_size") % 5 + 1).alias("n_views"), F.lit(2).alias("n_resources")
    )
    return catalog.label_positions(g.sql(_LABELS), scorers)


# ------------------------------------------------------------------------------ families


@query(
    "source_survey",
    f"""
WITH {_NOW},
byid AS (SELECT source, source_id, arg_max(family, family) AS family, arg_max(hex, family) AS hex FROM now GROUP BY source, source_id),
l AS (SELECT d.source, d.source_id, d.hex, b.family, b.hex AS bound FROM d_listing d LEFT JOIN byid b ON b.source = d.source AND b.source_id = d.source_id),
known AS (SELECT source, source_id, family, CASE WHEN bound = hex THEN 'unchanged' ELSE 'changed' END AS status FROM l WHERE family IS NOT NULL),
cand AS (SELECT n.source, n.hex, count(*) AS n, max(family) AS family FROM now n ANTI JOIN d_listing d ON d.source = n.source AND d.source_id = n.source_id GROUP BY n.source, n.hex),
fresh AS (SELECT l.source, l.source_id, c.family, CASE WHEN c.family IS NOT NULL THEN 'renamed' ELSE 'new' END AS status FROM l LEFT JOIN cand c ON c.source = l.source AND c.hex = l.hex AND c.n = 1 WHERE l.family IS NULL),
found AS (SELECT * FROM known UNION ALL SELECT * FROM fresh)
SELECT * FROM found UNION ALL SELECT source, source_id, family, 'gone' FROM now n ANTI JOIN (SELECT family FROM found WHERE family IS NOT NULL) f ON f.family = n.family""",
)
def source_survey(g: Given) -> DataFrame:
    return families.survey(g["d_binding"], g["d_listing"])


@query("family_of_case", f"WITH {_FAMILY} SELECT digest, family FROM fam")
def family_of_case(g: Given) -> DataFrame:
    return families.family_of(g["d_case"], g["d_binding"]).select("digest", "family")


@query(
    "holder_conflicts",
    f"""
WITH {_NOW}, w AS (SELECT doc_id AS key, source, source_id, hex, CASE WHEN doc_id % 2 = 0 THEN doc_id END AS but FROM d_case),
m AS (SELECT w.key, n.family, n.source_id = w.source_id AS same_id FROM w JOIN now n ON n.source = w.source AND n.source_id = w.source_id WHERE n.family IS DISTINCT FROM w.but
  UNION SELECT w.key, n.family, n.source_id = w.source_id FROM w JOIN now n ON n.source = w.source AND n.hex = w.hex WHERE n.family IS DISTINCT FROM w.but)
SELECT key, min(family) AS family, arg_min(same_id, family) AS same_id FROM m GROUP BY key""",
)
def holder_conflicts(g: Given) -> DataFrame:
    wanted = g["d_case"].select(
        F.col("doc_id").alias("key"), "source", "source_id", "hex", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("but")
    )
    return families.holders(g["d_binding"], wanted)


def _repair(d: Dialect) -> str:
    """Families to move: a third to a new id, a third to new content, the rest (refused) to both."""
    changed = d.sha("concat(hex, '!')")
    return f"""
SELECT family, source, source_id, hex, CASE WHEN family % 3 <> 1 THEN concat(source_id, '-moved') ELSE source_id END AS new_source_id,
  CASE WHEN family % 3 <> 0 THEN {changed} ELSE hex END AS new_hex
FROM (SELECT family, {'max_by(source, id)' if d.spark else 'arg_max(source, id)'} AS source, {'max_by(source_id, id)' if d.spark else 'arg_max(source_id, id)'} AS source_id, {'max_by(hex, id)' if d.spark else 'arg_max(hex, id)'} AS hex FROM d_binding GROUP BY family) n"""


register_view("d_repair", _repair)

_VIGNETTE_JSON = """'"vignette":{"fingerprint":{"hex":"', r.new_hex, '"},"id":"', r.new_source_id, '","source":"', r.source, '"}}'"""


@query(
    "repair_plan",
    f"""
WITH b AS (SELECT r.*, c.digest, c.appendix, c.doc_id FROM d_repair r JOIN d_case c ON c.source = r.source AND c.source_id = r.source_id AND c.hex = r.hex WHERE (r.source_id <> r.new_source_id) <> (r.hex <> r.new_hex)),
a AS (SELECT r.*, CASE WHEN appendix IS NULL THEN '' ELSE concat('sha256:', sha256(concat('{{"kind":"appendix","text":"note ', CAST(doc_id AS STRING), '","v":1,', {_VIGNETTE_JSON}))) END AS new_appendices FROM b r)
SELECT family, digest, new_appendices, concat('sha256:', sha256(concat('{{', CASE WHEN appendix IS NULL THEN '' ELSE concat('"appendices":["', new_appendices, '"],') END, '"kind":"case","v":1,', {_VIGNETTE_JSON}))) AS new_digest FROM a r""",
)
def repair_plan(g: Given) -> DataFrame:
    appendices = g["d_case"].where("appendix IS NOT NULL").select(
        F.col("appendix").alias("digest"), F.concat(F.lit("note "), F.col("doc_id").cast("string")).alias("text")
    )
    cases = g["d_case"].select("digest", *families.VIGNETTE, F.array_compact(F.array("appendix")).alias("appendices"))
    plan = families.repair_plan(g["d_repair"], cases, appendices)
    return plan.withColumn("new_appendices", F.array_join("new_appendices", ","))


# ------------------------------------------------------------- repairs in full, what is behind


def _repair_wish(d: Dialect) -> str:
    """As d_repair, some wanting another family's id or content."""
    gone = d.sha("concat('gone', CAST(family AS STRING))")
    return f"""
SELECT family, source, source_id, hex, CASE WHEN family % 6 = 0 AND family < 100000000000 THEN concat('v', CAST(family + 20 AS STRING)) ELSE new_source_id END AS new_source_id,
  CASE WHEN family % 51 = 34 AND family < 100000000000 THEN {gone} ELSE new_hex END AS new_hex FROM d_repair"""


def _expectation(d: Dialect) -> str:
    return """
SELECT concat('expectation:', CAST(doc_id AS STRING)) AS digest, concat('case:', CAST(doc_id AS STRING)) AS case_digest,
  concat('{"case":"case:', CAST(doc_id AS STRING), '","data":', CAST(quality AS STRING), ',"expectation_schema":"schema:1","kind":"expectation","v":1}') AS canonical FROM labels"""


def _case_head(d: Dialect) -> str:
    """Threads of appendices and expectations by what heads them: every other one."""
    return """
SELECT doc_id AS thread, appendix AS digest FROM d_case WHERE appendix IS NOT NULL AND doc_id % 8 = 0
UNION ALL SELECT 1000000 + doc_id, concat('expectation:', CAST(doc_id AS STRING)) FROM labels WHERE doc_id % 2 = 0"""


def _case_ref(d: Dialect) -> str:
    """What components refer to: edits' documents to each other's and to cases, cases to appendices and a document."""
    return f"""
SELECT a.digest AS src, '/prompt' AS path, b.digest AS dst FROM (SELECT digest, min(id) AS id FROM d_edit GROUP BY digest) a JOIN d_edit b ON b.id = a.id + 7
UNION ALL SELECT digest, '/cases/0', concat('case:', CAST({d.div('min(id)', 20)} AS STRING)) FROM d_edit GROUP BY digest
UNION ALL SELECT digest, '/appendices/0', appendix FROM d_case WHERE appendix IS NOT NULL
UNION ALL SELECT c.digest, '/appendices/1', e.digest FROM d_case c JOIN d_edit e ON e.id = c.doc_id WHERE c.doc_id % 3 = 0"""


def _recipe_ref(d: Dialect) -> str:
    return """
SELECT c.compilation, '/prompt' AS path, e.digest AS dst FROM d_compilation c JOIN d_edit e ON e.id = length(c.recipe) * 13
UNION ALL SELECT compilation, '/few_shot', concat('case:', CAST(length(recipe) * 10 AS STRING)) FROM d_compilation"""


for _name, _build in {"d_repair_wish": _repair_wish, "d_case_expectation": _expectation, "d_case_head": _case_head, "d_case_ref": _case_ref, "d_recipe_ref": _recipe_ref}.items():
    register_view(_name, _build)


def _cases(g: Given) -> DataFrame:
    return g["d_case"].select("digest", *families.VIGNETTE, F.array_compact(F.array("appendix")).alias("appendices"))


def _appendices(g: Given) -> DataFrame:
    return g["d_case"].where("appendix IS NOT NULL").select(
        F.col("appendix").alias("digest"), *families.VIGNETTE, F.concat(F.lit("note "), F.col("doc_id").cast("string")).alias("text")
    )


def _case_sql(rows: str, source_id: str, hex_: str) -> str:
    """Rows with their case's and appendix's digests on the vignette named."""
    vignette = f"""'"vignette":{{"fingerprint":{{"hex":"', {hex_}, '"}},"id":"', {source_id}, '","source":"', source, '"}}}}'"""
    return f"""
SELECT *, concat('sha256:', sha256(concat('{{', CASE WHEN appendix IS NULL THEN '' ELSE concat('"appendices":["', new_appendix, '"],') END, '"kind":"case","v":1,', {vignette}))) AS new_digest
FROM (SELECT *, CASE WHEN appendix IS NOT NULL THEN concat('sha256:', sha256(concat('{{"kind":"appendix","text":"note ', CAST(doc_id AS STRING), '","v":1,', {vignette}))) END AS new_appendix FROM {rows} x) y"""


@query(
    "repairs_in_full",
    f"""
WITH {_NOW}, one AS (SELECT *, (source_id <> new_source_id) <> (hex <> new_hex) AS fits FROM d_repair_wish),
m AS (SELECT o.family, o.new_source_id, n.family AS other, n.source_id = o.new_source_id AS same_id FROM one o JOIN now n ON n.source = o.source AND n.family <> o.family AND (n.source_id = o.new_source_id OR n.hex = o.new_hex) WHERE fits),
no AS (SELECT family, 'a repair changes exactly one of the id or the fingerprint' AS reason FROM one WHERE NOT fits
  UNION ALL SELECT family, concat('family ', CAST(min(other) AS STRING), ' already has ', CASE WHEN arg_min(same_id, other) THEN concat('the id ''', any_value(new_source_id), '''') ELSE 'that content' END) FROM m GROUP BY family),
b AS (SELECT r.family, r.new_source_id, r.new_hex, r.source_id <> r.new_source_id AS renamed, c.* FROM one r JOIN d_case c ON c.source = r.source AND c.source_id = r.source_id AND c.hex = r.hex WHERE r.family NOT IN (SELECT family FROM no)),
made AS ({_case_sql("b", "new_source_id", "new_hex").strip()}),
e AS (SELECT m.family, e.digest, concat('sha256:', sha256(replace(e.canonical, concat('"', e.case_digest, '"'), concat('"', m.new_digest, '"')))) AS new_digest, h.thread FROM made m JOIN d_case_expectation e ON e.case_digest = m.digest JOIN d_case_head h ON h.digest = e.digest WHERE renamed)
SELECT family, 'case' AS kind, digest, new_digest, CAST(NULL AS STRING) AS thread, CAST(NULL AS STRING) AS reason FROM made
UNION ALL SELECT family, 'appendix', appendix, new_appendix, NULL, NULL FROM made WHERE appendix IS NOT NULL
UNION ALL SELECT family, 'expectation', digest, new_digest, NULL, NULL FROM e UNION ALL SELECT family, 'move', digest, new_digest, CAST(thread AS STRING), NULL FROM e
UNION ALL SELECT family, 'move', appendix, new_appendix, CAST(h.thread AS STRING), NULL FROM made m JOIN d_case_head h ON h.digest = m.appendix
UNION ALL SELECT family, 'refused', NULL, NULL, NULL, reason FROM no""",
)
def repairs_in_full(g: Given) -> DataFrame:
    """All that follows from moving families: appendices, cases, expectations, heads; or why not."""
    expectations = g["d_case_expectation"].withColumnRenamed("case_digest", "case")
    return families.repairs_in_full(g["d_repair_wish"], g["d_binding"], _cases(g), _appendices(g), expectations, g["d_case_head"])


_DELETED = "SELECT DISTINCT family FROM d_binding WHERE family % 29 = 0"
_STALE_CASES = _case_sql("stale", "now_source_id", "now_hex").strip()


@query(
    "behind_of",
    f"""
WITH {_ABOUT}, {_NOW}, {_FAMILY}, h AS (SELECT thread, max(id) AS id, arg_max(digest, id) AS digest, arg_max(coalesce(compilation, ''), id) AS compilation FROM d_edit GROUP BY thread),
base AS (SELECT h.thread AS root, r.path, r.dst AS digest FROM h JOIN d_case_ref r ON r.src = h.digest UNION ALL SELECT h.thread, concat('/recipe', r.path), r.dst FROM h JOIN d_recipe_ref r ON r.compilation = h.compilation),
held AS (SELECT * FROM base UNION ALL SELECT root, concat(b.path, r.path), r.dst FROM base b JOIN d_case c ON c.digest = b.digest JOIN d_case_ref r ON r.src = b.digest),
holds AS (SELECT DISTINCT digest, thread FROM d_edit),
stale AS (SELECT f.*, n.id AS binding, n.source_id AS now_source_id, n.hex AS now_hex FROM fam f JOIN now n ON n.family = f.family WHERE f.family % 29 <> 0 AND (f.source, f.source_id, f.hex) <> (n.source, n.source_id, n.hex)),
anew AS ({_STALE_CASES})
SELECT r.root, r.path, r.digest, x.thread, h.id AS head, h.digest AS head_digest, CAST(NULL AS BIGINT) AS binding, CAST(NULL AS STRING) AS replacement
FROM held r JOIN holds x ON x.digest = r.digest JOIN h ON h.thread = x.thread LEFT JOIN about a ON a.thread = h.thread WHERE h.digest <> r.digest AND NOT coalesce(a.deleted, false)
UNION ALL SELECT r.root, r.path, r.digest, NULL, NULL, NULL, s.binding, s.new_digest FROM held r JOIN anew s ON s.digest = r.digest""",
)
def behind_of(g: Given) -> DataFrame:
    """What heads hold that has moved on, through recipes and cases, and cases of an earlier vignette."""
    return families.behind_of(g["d_edit"], g["d_entry"], g["d_case_ref"], g["d_recipe_ref"], _cases(g), _appendices(g), g["d_binding"], g.sql(_DELETED))


_CASE_REFS = "SELECT concat('/cases/', CAST(l_orderkey AS STRING), '/', CAST(l_linenumber AS STRING)) AS path, concat('case:', CAST(l_partkey AS STRING)) AS digest FROM lineitem"


@query(
    "stale_cases",
    f"""
WITH {_NOW}, {_FAMILY}
SELECT r.path, r.digest, f.family, n.id AS binding, n.source_id AS now_source_id, n.hex AS now_hex FROM ({_CASE_REFS}) r JOIN fam f ON f.digest = r.digest JOIN now n ON n.family = f.family
WHERE f.family % 29 <> 0 AND (f.source, f.source_id, f.hex) <> (n.source, n.source_id, n.hex)""",
)
def stale_cases(g: Given) -> DataFrame:
    return families.stale_cases(g.sql(_CASE_REFS), g["d_case"], g["d_binding"], g.sql(_DELETED))


_NAMED = "SELECT DISTINCT family, concat('family ', CAST(family AS STRING)) AS name FROM d_binding WHERE family % 4 = 1"


@query(
    "case_titles",
    f"""
WITH {_NOW}, {_FAMILY}
SELECT c.digest, CASE WHEN f.family IS NULL THEN concat(c.source, '/', c.source_id)
  ELSE concat(CASE WHEN f.family % 4 = 1 THEN concat('family ', CAST(f.family AS STRING)) ELSE concat(n.source, '/', n.source_id) END, CASE WHEN (c.source, c.source_id, c.hex) = (n.source, n.source_id, n.hex) THEN '' ELSE ' (earlier)' END) END AS title
FROM d_case c LEFT JOIN fam f ON f.digest = c.digest LEFT JOIN now n ON n.family = f.family""",
)
def case_titles(g: Given) -> DataFrame:
    return families.case_titles(g["d_case"], g["d_binding"], g.sql(_NAMED))


@query(
    "binding_violations",
    """
WITH b AS (SELECT *, lag(id) OVER w AS pid, lag(source) OVER w AS psource, lag(source_id) OVER w AS psource_id, lag(hex) OVER w AS phex FROM d_binding WINDOW w AS (PARTITION BY family ORDER BY id))
SELECT 'error' AS level, 'binding.jump' AS code, concat('binding ', CAST(id AS STRING), ' keeps neither the id nor the content of binding ', CAST(pid AS STRING)) AS message, CAST(family AS STRING) AS subject, CAST(NULL AS STRING) AS log_id
FROM b WHERE pid IS NOT NULL AND NOT (source = psource AND (source_id = psource_id OR hex = phex))""",
)
def binding_violations(g: Given) -> DataFrame:
    return families.binding_violations(g["d_binding"])


_NOW_VIGNETTES = "SELECT DISTINCT source, source_id, hex FROM d_listing"


@query("bound_to", "SELECT digest FROM d_case c SEMI JOIN d_listing l ON l.source = c.source AND l.source_id = c.source_id AND l.hex = c.hex")
def bound_to(g: Given) -> DataFrame:
    """Cases bound to exactly the vignette their source lists now."""
    documents = g["d_case"].withColumn("kind", F.lit("case"))
    return families.bound_to(documents, "case", g.sql(_NOW_VIGNETTES)).select("digest")


@query(
    "expectations_of_cases",
    "SELECT l.doc_id AS expectation FROM labels l WHERE concat('case:', CAST(l.doc_id AS STRING)) IN (SELECT digest FROM d_case WHERE appendix IS NOT NULL)",
)
def expectations_of_cases(g: Given) -> DataFrame:
    expectations = g["labels"].select(
        F.col("doc_id").alias("expectation"), F.concat(F.lit("case:"), F.col("doc_id").cast("string")).alias("digest")
    )
    wanted = g["d_case"].where("appendix IS NOT NULL").select("digest")
    return expectations.join(wanted, "digest", "left_semi").select("expectation")
