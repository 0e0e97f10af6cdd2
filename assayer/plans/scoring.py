"""Queries that score the documents, taken as free-text answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import ENGINE_VERSION
from ..functions import patterns, selectors, tape, text
from ..operators import scoring
from .registry import query
from .tables import PATTERNS, Dialect, Given, register_view

# ---------------------------------------------------------------- oracle building blocks

_W = r"[\p{L}\p{N}_]"
_NW = r"[^\p{L}\p{N}_]"
_LINES = (
    r"list_filter(list_transform(string_split_regex({0}, '\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), "
    r"lambda s: trim(regexp_replace(s, '^\s*(?:[-*•]|[0-9]+[.)])\s+', ''), ' ' || chr(9) || chr(160) || chr(12288))), lambda s: s <> '')"
)


def _line(x: str) -> str:
    folded = f"replace(lower({x}), 'ß', 'ss')"
    return rf"(' ' || ltrim(regexp_replace({folded} || ' ', '{_NW}+', ' ', 'g')))"


def _hit(line: str) -> str:
    """Whether a words line satisfies its pattern, written out for each pattern by hand."""
    c = lambda w: f"contains({line}, '{w}')"
    return f"""CASE pattern_id
 WHEN 0 THEN {c(' the ')}
 WHEN 1 THEN {c(' an')} AND {c(' er')}
 WHEN 2 THEN ({c(' in ')} OR {c(' on ')}) AND {c(' the ')}
 WHEN 3 THEN {c(' der ')} OR {c(' die ')} OR {c(' und ')}
 ELSE {c(' in the ')} OR ({c(' la ')} AND ({c(' le ')} OR {c(' que ')})) END"""


def _at(regex: str, x: str = "padded") -> str:
    """The code-point offset of a phrase in a text, given lower-cased with a space on each side."""
    head = rf"regexp_extract({x}, '^((?s:.)*?){_NW}{regex}', 1)"
    return rf"CASE WHEN regexp_matches({x}, '{_NW}{regex}') THEN length({head}) END"


def _first_at() -> str:
    end = _NW
    word = lambda w: _at(w + end)
    both = lambda a, b: f"CASE WHEN ({a}) IS NOT NULL AND ({b}) IS NOT NULL THEN least({a}, {b}) END"
    return f"""CASE pattern_id
 WHEN 0 THEN {word('the')}
 WHEN 1 THEN {both(_at('an'), _at('er'))}
 WHEN 2 THEN {both(f"least({word('in')}, {word('on')})", word('the'))}
 WHEN 3 THEN least({word('der')}, {word('die')}, {word('und')})
 ELSE least({_at('in' + _NW + '+the' + end)}, {both(word('la'), f"least({word('le')}, {word('que')})")}) END"""


_PADDED = "' ' || lower({0}) || ' '"
_UNIT = r"[^\n]*?(?:\n+|[.!?](?:\n+|[^\S\n]\s*)|$)"


# ------------------------------------------------------------------------------- helpers


def answers(g: Given) -> DataFrame:
    """Answers with the compiled pattern of their case.

    The target table is small by construction and left to the optimizer to broadcast: no
    hint forces it, so a large one is shuffled instead.
    """
    targets = patterns.with_compiled(g["d_target"]).select(
        "pattern_id",
        F.struct(
            F.col("pattern"),
            F.lit(False).alias("nothing"),
            F.col("compiled.problem").alias("reason"),
            F.col("compiled"),
        ).alias("target"),
    )
    return g.spread("d_answer").join(targets, "pattern_id")


# ------------------------------------------------------------------------------- queries


@query(
    "score_summary",
    f"""
WITH a AS (SELECT condition, pattern_id, {_LINES.format('answer')} AS items FROM d_answer),
h AS (SELECT condition, items IS NULL AS none, coalesce(list_position(list_transform(items, lambda i: {_hit(_line('i'))}), true), 0) AS rank FROM a),
v AS (SELECT condition, 'reciprocal_rank' AS metric, CASE WHEN rank > 0 THEN 1.0 / rank ELSE 0.0 END AS value FROM h
  UNION ALL SELECT condition, 'mentions', CASE WHEN rank > 0 THEN 1.0 ELSE 0.0 END FROM h)
SELECT condition, metric, round(avg(value), 6) AS mean, round(CASE WHEN count(*) > 1 THEN stddev_samp(value) / sqrt(count(*)) ELSE 0 END, 6) AS stderr,
  round(coalesce(stddev_samp(value), 0), 6) AS std, round(coalesce(var_samp(value), 0), 6) AS var, count(value) AS n,
  count(*) - count(value) AS n_unscored
FROM v GROUP BY condition, metric""",
)
def score_summary(g: Given) -> DataFrame:
    expected = scoring.expected_of(F.col("target"))

    def values(rank):
        found = rank > 0
        return F.array(
            F.struct(
                F.lit("reciprocal_rank").alias("metric"),
                F.when(found, F.lit(1.0) / rank).otherwise(F.lit(0.0)).alias("value"),
            ),
            # An answer with a ranked item is one that mentions the target.
            F.struct(
                F.lit("mentions").alias("metric"),
                F.when(found, F.lit(1.0)).otherwise(F.lit(0.0)).alias("value"),
            ),
        )

    ranks = scoring.first_rank(text.lines(F.col("answer")), expected)
    scores = answers(g).select("condition", F.inline(text.let(ranks, values)))
    return scoring.summarise(scores, ["condition", "metric"], digits=6)


@query(
    "score_label_summary",
    """
SELECT condition, view_pos, round(coalesce(avg(value), 0), 6) AS mean,
  round(CASE WHEN count(value) > 1 THEN stddev_samp(value) / sqrt(count(value)) ELSE 0 END, 6) AS stderr,
  round(coalesce(stddev_samp(value), 0), 6) AS std, round(coalesce(var_samp(value), 0), 6) AS var,
  count(value) AS n, count(*) - count(value) AS n_unscored
FROM d_score GROUP BY condition, view_pos""",
)
def score_label_summary(g: Given) -> DataFrame:
    return scoring.summarise(g["d_score"], ["condition", "view_pos"], digits=6)


@query(
    "stamped_scores",
    f"""
SELECT case_id, CASE view_pos WHEN 0 THEN 'reciprocal_rank' ELSE 'mentions' END AS metric, value, '{ENGINE_VERSION}' AS engine_version, '1' AS metric_version FROM d_score""",
)
def stamped_scores(g: Given) -> DataFrame:
    metric = F.when(F.col("view_pos") == 0, "reciprocal_rank").otherwise("mentions")
    return scoring.stamped(g["d_score"].select("case_id", metric.alias("metric"), "value"))


@query(
    "pattern_match",
    f"""
WITH a AS (SELECT case_id, pattern_id, {_PADDED.format('answer')} AS padded FROM d_answer WHERE answer IS NOT NULL)
SELECT case_id, pattern_id, CAST({_first_at()} AS BIGINT) AS at FROM a""",
)
def pattern_match(g: Given) -> DataFrame:
    found = answers(g).where("answer IS NOT NULL").withColumn(
        "word",
        text.let(
            text.words_line(F.col("answer")), lambda line: patterns.find_word(line, F.col("target.compiled"))
        ),
    )
    return found.select(
        "case_id",
        "pattern_id",
        F.when(F.col("word") != patterns.NOWHERE, text.word_offset(F.col("answer"), F.col("word")))
        .cast("bigint")
        .alias("at"),
    )


_ITEMS = f"SELECT case_id, pattern_id, {_LINES.format('answer')} AS items FROM d_answer"
_RANKED = f"""
WITH a AS ({_ITEMS}),
r AS (SELECT case_id, items, coalesce(list_position(list_transform(items, lambda i: {_hit(_line('i'))}), true), 0) AS rank FROM a)"""


@query(
    "reciprocal_rank",
    _RANKED
    + """
SELECT case_id, CASE WHEN rank > 0 THEN round(1.0 / rank, 9) ELSE 0.0 END AS value,
  CASE WHEN rank > 0 THEN concat(CAST(rank AS STRING), '. ', items[rank]) END AS answer,
  CASE WHEN items IS NULL THEN 'no answer' WHEN rank = 0 THEN 'not listed' END AS reason FROM r""",
)
def reciprocal_rank(g: Given) -> DataFrame:
    return _metric(g, "reciprocal_rank").withColumn("value", F.round("value", 9))


def _metric(g: Given, metric: str) -> DataFrame:
    items = answers(g).withColumn("items", text.lines(F.col("answer")))
    return items.select(
        "case_id", scoring.score(metric, F.col("items"), F.col("target")).alias("scored")
    ).select("case_id", "scored.*")


@query(
    "mentions",
    _RANKED
    + """
SELECT case_id, CAST(rank > 0 AS DOUBLE) AS value, CASE WHEN rank > 0 THEN items[rank] END AS answer,
  CASE WHEN items IS NULL THEN 'no answer' WHEN rank = 0 THEN 'not named' END AS reason FROM r""",
)
def mentions(g: Given) -> DataFrame:
    return _metric(g, "mentions")


@query(
    "first_mention",
    f"""
WITH a AS (SELECT case_id, pattern_id, answer, regexp_extract_all(answer, '{_UNIT}') AS units FROM d_answer),
p AS (SELECT case_id, pattern_id, unnest(list_transform(range(1, len(units) + 1), lambda i: struct_pack(
    nth := i, start := coalesce(list_sum(list_transform(units[1:i-1], lambda u: length(u))), 0), unit := units[i])), recursive := true) FROM a),
f AS (SELECT case_id, nth, start + ({_first_at()}) AS found FROM (SELECT *, {_PADDED.format('unit')} AS padded FROM p) q),
m AS (SELECT case_id, arg_min(found, nth) AS found FROM f WHERE found IS NOT NULL GROUP BY case_id)
SELECT a.case_id, CAST(m.found AS DOUBLE) AS value, CASE WHEN answer IS NULL THEN 'no answer' WHEN m.found IS NULL THEN 'never named' END AS reason
FROM a LEFT JOIN m ON m.case_id = a.case_id""",
)
def first_mention(g: Given) -> DataFrame:
    whole = answers(g).withColumn("items", F.when(F.col("answer").isNotNull(), F.array("answer")))
    return whole.select(
        "case_id", scoring.score("first_mention", F.col("items"), F.col("target")).alias("scored")
    ).select("case_id", "scored.value", "scored.reason")


@query(
    "split_lines",
    f"""
WITH a AS (SELECT doc_id, {_LINES.format('text')} AS items FROM documents)
SELECT doc_id, i.pos AS pos, i.item AS item FROM (
  SELECT doc_id, unnest(list_transform(range(0, len(items)), lambda n: struct_pack(pos := n, item := items[n + 1]))) AS i FROM a) x""",
)
def split_lines(g: Given) -> DataFrame:
    return g.spread("documents").select(
        "doc_id", F.posexplode(text.lines(F.col("text"))).alias("pos", "item")
    ).withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "word_tokens",
    rf"""
WITH a AS (SELECT doc_id, regexp_extract_all(text, '{_W}+|{_NW}+') AS pieces FROM documents),
p AS (SELECT doc_id, unnest(list_transform(range(1, len(pieces) + 1), lambda i: struct_pack(nth := i, piece := pieces[i])), recursive := true) FROM a),
s AS (SELECT doc_id, piece, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY nth) - length(piece) AS start FROM p)
SELECT doc_id, CAST(start AS BIGINT) AS start, replace(lower(piece), 'ß', 'ss') AS word FROM s WHERE regexp_matches(piece, '^{_W}')""",
)
def word_tokens(g: Given) -> DataFrame:
    return g.spread("documents").select("doc_id", F.inline(text.words_at(F.col("text")))).withColumn(
        "start", F.col("start").cast("bigint")
    )


@query(
    "text_units",
    rf"""
WITH a AS (SELECT doc_id, regexp_extract_all(text, '{_UNIT}') AS pieces FROM documents),
p AS (SELECT doc_id, unnest(list_transform(range(1, len(pieces) + 1), lambda i: struct_pack(nth := i, piece := pieces[i])), recursive := true) FROM a),
s AS (SELECT doc_id, piece, nth, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY nth) - length(piece) AS start FROM p),
u AS (SELECT doc_id, CAST(start AS BIGINT) AS start, regexp_replace(piece, '(?:\n+|([.!?])(?:\n+|[^\S\n]\s*))$', '\1') AS unit FROM s)
SELECT * FROM u WHERE unit <> ''""",
)
def text_units(g: Given) -> DataFrame:
    return (
        g.spread("documents")
        .select("doc_id", F.inline(text.units(F.col("text"))))
        .where("unit <> ''")
        .withColumn("start", F.col("start").cast("bigint"))
    )


@query(
    "match_expectations",
    """
SELECT run, count(*) AS n_items, count(l.doc_id) AS n_matched, count(*) - count(l.doc_id) AS n_unscored
FROM d_call c LEFT JOIN labels l ON l.doc_id = c.case_id GROUP BY run""",
)
def match_expectations(g: Given) -> DataFrame:
    expectations = g["labels"].select(F.col("doc_id").alias("case_id"), F.lit(1).alias("matched"))
    # Items of one case are counted before the join, so a case with many replicates and
    # runs crosses it as one row per run.
    items = g["d_call"].groupBy("run", "case_id").agg(F.count("*").alias("n"))
    return (
        items.join(expectations, "case_id", "left")
        .groupBy("run")
        .agg(
            F.sum("n").alias("n_items"),
            F.coalesce(F.sum(F.when(F.col("matched").isNotNull(), F.col("n"))), F.lit(0)).alias("n_matched"),
            F.coalesce(F.sum(F.when(F.col("matched").isNull(), F.col("n"))), F.lit(0)).alias("n_unscored"),
        )
    )


@query(
    "scoring_conflicts",
    """
WITH e AS (SELECT doc_id AS digest, doc_id % 6 AS scoring, doc_id // 12 AS case_id, CASE WHEN doc_id % 25 = 0 THEN 'other' ELSE 'targets' END AS expectation_schema FROM labels)
SELECT scoring, 'case ' || CAST(case_id AS STRING) || ' has more than one expectation' AS problem, count(*) AS n FROM e GROUP BY scoring, case_id HAVING count(*) > 1
UNION ALL SELECT scoring, 'expectation ' || CAST(digest AS STRING) || ' is not in the scorer''s schema', 1 FROM e WHERE expectation_schema <> 'targets'""",
)
def scoring_conflicts(g: Given) -> DataFrame:
    expectations = g["labels"].select(
        F.col("doc_id").alias("digest"),
        (F.col("doc_id") % 6).alias("scoring"),
        F.floor(F.col("doc_id") / 12).alias("case_id"),
        F.when(F.col("doc_id") % 25 == 0, "other").otherwise("targets").alias("expectation_schema"),
    )
    return scoring.conflicts(expectations, F.lit("targets"))


# ---------------------------------------------------------------- structured answers


def _expectation(d) -> str:
    """Expectation documents of several shapes: a pattern, a target holding one, words only,
    nothing expected, something else, none, several, and one that doesn't read."""
    return """
SELECT doc_id, CASE doc_id % 8
  WHEN 0 THEN '{"t":["the"]}' WHEN 1 THEN '{"t":[{"pattern":"an* & er*"}]}' WHEN 2 THEN '{"t":[{"text":"words"}]}'
  WHEN 3 THEN '{"t":[false]}' WHEN 4 THEN concat('{"t":[', CAST(doc_id AS STRING), ']}') WHEN 5 THEN '{"t":[]}'
  WHEN 6 THEN '{"t":["the","an"]}' ELSE '{"t":["the & "]}' END AS data
FROM documents"""


register_view("d_expectation", _expectation)

_STATUS = """CASE doc_id % 8 WHEN 2 THEN 'the target has words, for a judge, but no pattern'
  WHEN 4 THEN 'the target has no pattern' WHEN 5 THEN 'no target' WHEN 6 THEN '2 targets, not one'
  WHEN 7 THEN 'the pattern doesn''t read: a word is missing in ''the & ''' END"""


@query(
    "target_status",
    f"""
SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'the' WHEN 1 THEN 'an* & er*' WHEN 7 THEN 'the & ' END AS pattern,
  doc_id % 8 = 3 AS nothing, {_STATUS} AS reason FROM d_expectation""",
)
def target_status(g: Given) -> DataFrame:
    picked = g["d_expectation"].select(
        "doc_id", selectors.select(F.parse_json("data"), "$.t[*]").alias("picked")
    )
    return scoring.decode_targets(picked, "picked").select(
        "doc_id", "target.pattern", "target.nothing", "target.reason"
    )


VIEWS = [
    scoring.View("reciprocal_rank", "$.diagnoses[*].diagnosis", "$.t[*]"),
    scoring.View("mentions", "/warning", "$.t[*]", params={"strict": "yes"}),
    scoring.View("first_mention", "/free", "$.t[*]"),
    scoring.View("mentions", "/free", "$.t[*]", split="lines@1"),
]


@query(
    "score_views",
    rf"""
WITH a AS (
  SELECT d.doc_id, CASE WHEN d.doc_id % 19 = 0 THEN NULL ELSE text END AS free, {_LINES.format("CASE WHEN d.doc_id % 19 = 0 THEN NULL ELSE text END")} AS items,
    lang, source, {_STATUS.replace('doc_id', 'd.doc_id')} AS why, d.doc_id % 8 = 3 AS nothing, CASE d.doc_id % 8 WHEN 1 THEN 1 ELSE 0 END AS pattern_id
  FROM documents d),
u AS (SELECT doc_id, pattern_id, regexp_extract_all(free, '{_UNIT}') AS units FROM a WHERE free IS NOT NULL),
p AS (SELECT doc_id, pattern_id, unnest(list_transform(range(1, len(units) + 1), lambda i: struct_pack(
    nth := i, start := coalesce(list_sum(list_transform(units[1:i-1], lambda u: length(u))), 0), unit := units[i])), recursive := true) FROM u),
f AS (SELECT doc_id, nth, start + ({_first_at()}) AS found FROM (SELECT *, {_PADDED.format('unit')} AS padded FROM p) q),
m AS (SELECT doc_id, arg_min(found, nth) AS found FROM f WHERE found IS NOT NULL GROUP BY doc_id),
l AS (SELECT *, list_transform(items, lambda i: {_hit(_line('i'))}) AS hits,
  CASE WHEN items IS NULL THEN NULL WHEN doc_id % 3 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['the ' || lang] END AS warning FROM a),
v AS (
  SELECT doc_id, 0 AS view, 'reciprocal_rank' AS metric, '{{"level":"base"}}' AS params,
    CASE WHEN why IS NOT NULL OR nothing THEN NULL WHEN items IS NULL THEN 0.0
         WHEN list_contains(hits, true) THEN round(1.0 / list_position(hits, true), 9) ELSE 0.0 END AS value,
    CASE WHEN why IS NOT NULL THEN why WHEN nothing THEN 'nothing is expected to be found' WHEN items IS NULL THEN 'no answer'
         WHEN list_contains(hits, true) THEN NULL ELSE 'not listed' END AS reason FROM l
  UNION ALL
  SELECT doc_id, 1, 'mentions', '{{"level":"base","strict":"yes"}}',
    CASE WHEN why IS NOT NULL THEN NULL WHEN warning IS NULL THEN 0.0 WHEN nothing THEN CASE WHEN len(warning) > 0 THEN 0.0 ELSE 1.0 END
         WHEN len(warning) > 0 AND pattern_id = 0 THEN 1.0 ELSE 0.0 END,
    CASE WHEN why IS NOT NULL THEN why WHEN warning IS NULL THEN 'no answer'
         WHEN nothing THEN CASE WHEN len(warning) > 0 THEN 'none expected' ELSE 'none named, as expected' END
         WHEN len(warning) > 0 AND pattern_id = 0 THEN NULL ELSE 'not named' END FROM l
  UNION ALL
  SELECT l.doc_id, 2, 'first_mention', '{{"level":"base"}}', CASE WHEN why IS NULL AND NOT nothing THEN CAST(m.found AS DOUBLE) END,
    CASE WHEN why IS NOT NULL THEN why WHEN nothing THEN 'nothing is expected to be found' WHEN items IS NULL THEN 'no answer' WHEN m.found IS NULL THEN 'never named' END FROM l LEFT JOIN m ON m.doc_id = l.doc_id
  UNION ALL
  SELECT doc_id, 3, 'mentions', '{{"level":"base"}}',
    CASE WHEN why IS NOT NULL THEN NULL WHEN items IS NULL THEN 0.0 WHEN nothing THEN CASE WHEN len(items) > 0 THEN 0.0 ELSE 1.0 END
         WHEN list_contains(hits, true) THEN 1.0 ELSE 0.0 END,
    CASE WHEN why IS NOT NULL THEN why WHEN items IS NULL THEN 'no answer'
         WHEN nothing THEN CASE WHEN len(items) > 0 THEN 'none expected' ELSE 'none named, as expected' END
         WHEN list_contains(hits, true) THEN NULL ELSE 'not named' END FROM l)
SELECT * FROM v""",
)
def score_views(g: Given) -> DataFrame:
    """Views over answers as JSON documents."""
    answer = F.to_json(
        F.struct(
            F.transform(
                text.lines(F.col("text")), lambda line: F.struct(line.alias("diagnosis"))
            ).alias("diagnoses"),
            F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("the "), F.col("lang"))).alias("warning"),
            F.col("text").alias("free"),
        ),
        {"ignoreNullFields": "false"},
    )
    pairs = g.spread("documents").join(g["d_expectation"], "doc_id").select(
        "doc_id",
        F.parse_json(F.when(F.col("doc_id") % 19 != 0, answer)).alias("answer"),
        F.parse_json("data").alias("expected"),
    )
    rows = scoring.score_views(pairs, VIEWS, "answer", "expected", params={"level": "base"})
    return rows.select(
        "doc_id", "view", "metric", "params", F.round("value", 9).alias("value"), "reason"
    )


@query(
    "view_hit_rate",
    """
SELECT source, 'mentions' AS metric, '/warning' AS selector, round(avg(CASE WHEN doc_id % 3 <> 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, count(*) AS n FROM documents GROUP BY source
UNION ALL SELECT source, 'reciprocal_rank', '$.diagnoses[*]', round(avg(CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.0 END), 6), count(*) FROM documents GROUP BY source
UNION ALL SELECT source, 'mentions', '$.other', 0.0, count(*) FROM documents GROUP BY source""",
)
def view_hit_rate(g: Given) -> DataFrame:
    answer = F.to_json(
        F.struct(
            F.when(F.col("doc_id") % 2 == 0, F.array("lang", "source")).otherwise(F.array().cast("array<string>")).alias("diagnoses"),
            F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("warning"),
        )
    )
    views = [
        scoring.View("mentions", "/warning"),
        scoring.View("reciprocal_rank", "$.diagnoses[*]"),
        scoring.View("mentions", "$.other"),
    ]
    docs = g["documents"].select("source", F.parse_json(answer).alias("answer"))
    return scoring.hit_rates(docs, views, "answer", ["source"], digits=6)


@query(
    "items_as_written",
    """
SELECT doc_id, 0 AS pos, concat('{"b": "', source, '", "a": [1, "x,y:z", {"d": 1e-7, "c": ', CAST(doc_id AS STRING), '.50}]}') AS item FROM documents
UNION ALL SELECT doc_id, 1, lang FROM documents UNION ALL SELECT doc_id, 2, '1e-7' FROM documents""",
)
def items_as_written(g: Given) -> DataFrame:
    """Picked items as text with their members and numbers as the document has them."""
    document = F.concat(
        F.lit('{"t": [ {"b" :"'), "source", F.lit('", "a":[1, "x,y:z",{"d":1e-7,"c":'), F.col("doc_id").cast("string"), F.lit('.50}]}, null,"'), "lang", F.lit('", 1e-7]}')
    )
    rows = g["documents"].select("doc_id", tape.picks(document, "$.t[*]").alias("picked"))
    return rows.select("doc_id", F.posexplode(scoring.written_texts(F.col("picked"))).alias("pos", "item"))


@query(
    "items_as_text",
    """
SELECT doc_id, 0 AS pos, lang AS item FROM documents
UNION ALL SELECT doc_id, 1, CAST(doc_id AS STRING) FROM documents
UNION ALL SELECT doc_id, 2, CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END FROM documents
UNION ALL SELECT doc_id, 3, '{"a": [1, "x,y:z"], "b": "' || source || '"}' FROM documents
UNION ALL SELECT doc_id, 4, source FROM documents WHERE doc_id % 5 <> 0""",
)
def items_as_text(g: Given) -> DataFrame:
    """Picked items as text: nulls are dropped before items are numbered."""
    document = F.concat(
        F.lit('[null,"'), F.col("lang"), F.lit('",'), F.col("doc_id").cast("string"), F.lit(","),
        F.when(F.col("doc_id") % 2 == 0, "true").otherwise("false"),
        F.lit(',{"a":[1,"x,y:z"],"b":"'), F.col("source"), F.lit('"},'),
        F.when(F.col("doc_id") % 5 == 0, F.lit("null")).otherwise(F.concat(F.lit('"'), F.col("source"), F.lit('"'))),
        F.lit("]"),
    )
    picked = selectors.select(F.parse_json(document), "$[*]")
    return g["documents"].select(
        "doc_id", F.posexplode(scoring.item_texts(picked)).alias("pos", "item")
    )


@query(
    "unknown_metrics",
    """
SELECT p_partkey AS scorer, p_size AS view_pos, p_type AS metric FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, p_size, 'accuracy' FROM part WHERE p_partkey % 3 = 1 AND p_size % 4 = 0""",
)
def unknown_metrics(g: Given) -> DataFrame:
    known = F.element_at(F.array(*[F.lit(m) for m in sorted(scoring.METRICS)]), (F.col("p_size") % 3 + 1).cast("int"))
    views = g["part"].select(
        F.col("p_partkey").alias("scorer"),
        F.col("p_size").alias("view_pos"),
        F.when(F.col("p_partkey") % 3 == 0, F.col("p_type"))
        .when((F.col("p_partkey") % 3 == 1) & (F.col("p_size") % 4 == 0), "accuracy")
        .otherwise(known)
        .alias("metric"),
    )
    return scoring.unknown_metrics(views)


@query(
    "poolable_groups",
    """
WITH s AS (SELECT c.run AS log_id, r.declared_model, r.send_order, CAST(c.attempts AS DOUBLE) AS value FROM d_call c JOIN d_run r ON r.run = c.run WHERE r.finished_us IS NOT NULL)
SELECT send_order, round(avg(value), 6) AS mean, round(stddev_samp(value) / sqrt(count(*)), 6) AS stderr, round(stddev_samp(value), 6) AS std,
  round(var_samp(value), 6) AS var, count(*) AS n, CAST(0 AS BIGINT) AS n_unscored FROM s GROUP BY send_order""",
)
def poolable_groups(g: Given) -> DataFrame:
    runs = g["d_run"]
    flagged = runs.where("finished_us IS NULL").select(F.col("run").alias("log_id"))
    scores = g["d_call"].join(runs.select("run", "send_order"), "run").select(
        F.col("run").alias("log_id"), "send_order", F.col("attempts").cast("double").alias("value")
    )
    return scoring.poolable(scores, flagged, ["send_order"], digits=6)


assert list(PATTERNS) == [0, 1, 2, 3, 4]


# ------------------------------------------------------------------------- runs to scores


def _response(d: Dialect) -> str:
    """What the calls answered: two lines, or nothing where the call failed."""
    return """
SELECT c.run, c.case_id, c.replicate, e.event_type AS line1,
  CASE c.event_id % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'view' ELSE 'signup' END AS line2, 'text' AS contract,
  CAST(NULL AS STRING) AS answer_tool,
  CASE WHEN c.has_response THEN concat('{"choices":[{"message":{"content":"', e.event_type, chr(92), 'n',
    CASE c.event_id % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'view' ELSE 'signup' END, '"}}]}') END AS response
FROM d_call c JOIN events e ON e.event_id = c.event_id WHERE c.run % 6 <> 5"""


def _run_expectation(d: Dialect) -> str:
    return """
SELECT DISTINCT case_id, CASE case_id % 4 WHEN 0 THEN '"click"' WHEN 1 THEN '"view | signup"' WHEN 2 THEN 'false' ELSE '{"pattern":"purchase"}' END AS expectation
FROM d_call WHERE case_id % 7 <> 3"""


register_view("d_run_response", _response)
register_view("d_run_expectation", _run_expectation)

RUN_VIEWS = [scoring.View("reciprocal_rank", "$", "$", "lines@1"), scoring.View("mentions", "$", "$", "lines@1")]


def _hits(line: str) -> str:
    return f"CASE r.case_id % 4 WHEN 0 THEN {line} = 'click' WHEN 1 THEN {line} IN ('view', 'signup') WHEN 3 THEN {line} = 'purchase' ELSE FALSE END"


_RUN_SCORES = f"""
SELECT run, case_id, replicate, 0 AS view, 'reciprocal_rank' AS metric,
  CAST(CASE WHEN expectation IS NULL OR expectation = 'false' THEN NULL WHEN NOT has THEN 0.0 WHEN h1 THEN 1.0 WHEN h2 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS value,
  CASE WHEN expectation IS NULL OR NOT has THEN NULL WHEN h1 THEN concat('1. ', line1) WHEN h2 THEN concat('2. ', line2) END AS answer,
  CASE WHEN expectation IS NULL THEN 'no target' WHEN expectation = 'false' THEN 'nothing is expected to be found' WHEN NOT has THEN 'no answer' WHEN NOT h1 AND NOT h2 THEN 'not listed' END AS reason
FROM (SELECT r.*, e.expectation, r.response IS NOT NULL AS has, {_hits('r.line1')} AS h1, {_hits('r.line2')} AS h2 FROM d_run_response r LEFT JOIN d_run_expectation e ON e.case_id = r.case_id) i
UNION ALL SELECT run, case_id, replicate, 1, 'mentions',
  CAST(CASE WHEN expectation IS NULL THEN NULL WHEN expectation <> 'false' AND has AND (h1 OR h2) THEN 1.0 ELSE 0.0 END AS DOUBLE),
  CASE WHEN expectation IS NULL OR NOT has THEN NULL WHEN expectation = 'false' OR h1 THEN line1 WHEN h2 THEN line2 END,
  CASE WHEN expectation IS NULL THEN 'no target' WHEN NOT has THEN 'no answer' WHEN expectation = 'false' THEN 'none expected' WHEN NOT h1 AND NOT h2 THEN 'not named' END
FROM (SELECT r.*, e.expectation, r.response IS NOT NULL AS has, {_hits('r.line1')} AS h1, {_hits('r.line2')} AS h2 FROM d_run_response r LEFT JOIN d_run_expectation e ON e.case_id = r.case_id) i"""


@query("score_runs", f"SELECT *, '{{}}' AS params, '0.1.0' AS engine_version, '1' AS metric_version FROM ({_RUN_SCORES}) s")
def score_runs(g: Given) -> DataFrame:
    """Runs to scores: response, answer, expectation, views, score items."""
    items = g.spread("d_run_response").select("run", "case_id", "replicate", "response", "contract", "answer_tool")
    return scoring.score_runs(items, g["d_run_expectation"], RUN_VIEWS)


@query(
    "score_run_summary",
    f"""
WITH s AS (SELECT run, view, round(avg(value), 6) AS mean, round(CASE WHEN count(value) > 1 THEN stddev_samp(value) / sqrt(count(value)) ELSE 0 END, 6) AS stderr,
  round(coalesce(stddev_samp(value), 0), 6) AS std, round(coalesce(var_samp(value), 0), 6) AS var, count(value) AS n, count(*) - count(value) AS n_unscored
  FROM ({_RUN_SCORES}) x GROUP BY run, view)
SELECT r.run, v.view, v.metric, coalesce(mean, 0) AS mean, coalesce(stderr, 0) AS stderr, coalesce(std, 0) AS std, coalesce(var, 0) AS var,
  coalesce(n, 0) AS n, coalesce(n_unscored, 0) AS n_unscored
FROM d_run r CROSS JOIN (SELECT 0 AS view, 'reciprocal_rank' AS metric UNION ALL SELECT 1, 'mentions') v LEFT JOIN s ON s.run = r.run AND s.view = v.view""",
)
def score_run_summary(g: Given) -> DataFrame:
    """The same, summed up by run and view; runs without scores have a row for each view."""
    return scoring.summarise_runs(score_runs(g), g["d_run"], RUN_VIEWS, digits=6)
