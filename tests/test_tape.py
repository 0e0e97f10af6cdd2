import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayer.functions import selectors, tape
from assayer.operators import scoring


def some_json(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.3:
        return rng.choice(["1e-7", "2.50", "0", "-3", "true", "false", "null", '"a b"', '"\\u00e9\\""', '"[x]"', '""'])
    space = rng.choice(["", " ", "\n\t"])
    inner = [some_json(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    if kind < 0.6:
        return f"[{space}" + f"{space},".join(inner) + "]"
    return "{" + space + f",{space}".join(f'"{rng.choice("zyxb")}{i}"{space}:{space}{v}' for i, v in enumerate(inner)) + "}"


def test_spans_are_the_values_in_their_order():
    rng = random.Random(4)
    for _ in range(500):
        text = some_json(rng, 4)
        document = json.loads(text)
        below = lambda v: list(v.values()) if isinstance(v, dict) else v if isinstance(v, list) else []
        wanted = {
            "$": [document],
            "$.*": below(document),
            "$.*.*": [w for v in below(document) for w in below(v)],
            "$[?@ == 0].*": [],
            "$[?@ != null]": [v for v in below(document) if v is not None],
            "$.*[-1]": [v[-1] for v in below(document) if isinstance(v, list) and v],
            "$[?@[0]].*": [w for v in below(document) if isinstance(v, list) and v for w in v],
        }
        for selector, want in wanted.items():
            found = [text[a:b] for a, b in tape.spans(text, selectors.parse(selector))]
            assert [json.loads(t) for t in found] == want, (selector, text)
        assert json.loads(tape.compact(text)) == json.loads(tape.pretty(text)) == document
        plain = text.replace("1e-7", "7").replace("2.50", "2").replace("\\u00e9", "é")
        assert tape.pretty(plain) == json.dumps(json.loads(plain), indent=2, ensure_ascii=False)
        assert tape.compact(plain) == json.dumps(json.loads(plain), separators=(",", ":"), ensure_ascii=False)


def test_odd_documents():
    names = selectors.parse("$.a")
    assert [tape.spans(t, names) for t in ("", "not json", "[1]", "3", '{"b":1}')] == [[]] * 5
    twice = '{"a":1,"b":2,"a":3}'
    assert [twice[a:b] for a, b in tape.spans(twice, names)] == ["3"]
    assert [twice[a:b] for a, b in tape.spans(twice, selectors.parse("$.*"))] == ["3", "2"]


def test_written_as_the_document_has_it(spark):
    document = '[{"b":1,"a":1e-7}, {"z":{"y":1,"x":[2.50]}}]'
    df = spark.createDataFrame([(document,), (None,)], "t string").withColumn("v", F.parse_json("t"))
    rows = df.select(scoring.written_texts(tape.picks(F.col("t"), "$[*]")).alias("w"), selectors.select(F.col("v"), "$[*].*", F.col("t")).alias("s")).collect()
    assert rows[0].w == ['{"b": 1, "a": 1e-7}', '{"z": {"y": 1, "x": [2.50]}}'] and rows[1].w is None and rows[1].s is None
    assert len(rows[0].s) == 3


def test_a_metric_is_registered_while_running(spark):
    def longest_of(items: pd.Series, patterns: pd.Series, nothing: pd.Series) -> pd.DataFrame:
        found = [max(i, key=len) if i is not None and len(i) else None for i in items]
        return pd.DataFrame({"value": [None if f is None else float(len(f)) for f in found], "answer": found, "reason": patterns})

    longest = F.pandas_udf(longest_of, "struct<value double, answer string, reason string>")
    scoring.register_metric("longest", longest, "3")
    try:
        with pytest.raises(ValueError, match="there already"):
            scoring.register_metric("longest", longest, "3")
        with pytest.raises(ValueError, match="there already"):
            scoring.register_metric("mentions", longest, "9")
        with pytest.raises(ValueError, match="returns struct"):
            scoring.register_metric("other", F.pandas_udf(lambda s: s, "double"), "1")
        message = {"choices": [{"message": {"content": '{"d": ["flu", {"b": 2, "a": 1}]}'}}]}
        items = spark.createDataFrame(
            [(1, 1, 0, json.dumps(message), "native", None), (1, 2, 0, None, "native", None), (1, 3, 0, json.dumps(message), "native", None)],
            "run int, case_id int, replicate int, response string, contract string, answer_tool string",
        )
        expectations = spark.createDataFrame([(1, '"flu"'), (2, '"flu"')], "case_id int, expectation string")
        views = [scoring.View("longest", "$.d[*]", "$"), scoring.View("mentions", "$.d[*]", "$")]
        rows = {(r.case_id, r.metric): r for r in scoring.score_runs(items, expectations, views).collect()}
        got = rows[1, "longest"]
        assert (got.value, got.answer, got.reason, got.metric_version) == (16.0, '{"b": 2, "a": 1}', "flu", "3")
        assert rows[2, "longest"].value is None and rows[3, "longest"].reason == "no target"
        assert (rows[1, "mentions"].value, rows[1, "mentions"].metric_version) == (1.0, "1")
        assert scoring.unknown_metrics(spark.sql("SELECT 'longest' AS metric UNION ALL SELECT 'none'")).count() == 1
    finally:
        del scoring.REGISTERED["longest"], scoring.METRIC_VERSIONS["longest"]
