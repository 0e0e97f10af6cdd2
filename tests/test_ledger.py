import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from assayer.operators import catalog, families, graph, ledger, windows

RUN = "run int, n_cases bigint, n_seeds bigint, send_order string, shuffle_seed bigint, concurrency int, retries int, started_us bigint, finished_us bigint"
CALL = "run int, case_id bigint, replicate bigint, started_us bigint, finished_us bigint, attempts int"


def run_of(spark, order="case_major@1", seed=None, cases=1, seeds=2, retries=0, concurrency=1, finished=100):
    return spark.createDataFrame([(1, cases, seeds, order, seed, concurrency, retries, 0, finished)], RUN)


def calls_of(spark, *spans, attempts=1):
    return spark.createDataFrame([(1, 0, r, a, b, attempts) for r, (a, b) in enumerate(spans)], CALL)


def messages(frame):
    return [(r.code, r.message) for r in frame.collect()]


def test_execution_goldens(spark):
    run = run_of(spark)
    fine = calls_of(spark, (0, 5), (5, 9))
    assert messages(ledger.out_of_order(run, fine)) == messages(ledger.over_concurrency(run, fine, 4)) == []
    late = calls_of(spark, (5, 9), (0, 5))
    assert messages(ledger.out_of_order(run, late)) == [
        ("execution.order", "1 items were sent before items scheduled ahead of them")
    ]
    both = calls_of(spark, (0, 6), (5, 9))
    assert messages(ledger.over_concurrency(run, both, 4)) == [
        ("execution.concurrency", "2 calls were in flight at once, declared 1")
    ]
    assert messages(ledger.over_retries(run, calls_of(spark, (0, 5), attempts=2))) == [
        ("execution.retries", "1 calls took more than the 1 attempts allowed")
    ]


def test_canaries_bracket_the_items(spark):
    canaries = spark.createDataFrame(
        [(1, "start", 0, 0, 15), (1, "end", 0, 15, 30)], "run int, phase string, canary int, started_us bigint, finished_us bigint"
    )
    found = messages(ledger.canary_phases(calls_of(spark, (10, 20)), canaries))
    assert [code for code, _ in found] == ["canary.phase"] * 2


def test_schedules(spark):
    def order(name, seed=None):
        rows = ledger.schedule(run_of(spark, name, seed, cases=2)).orderBy("position").collect()
        assert [r.position for r in rows] == list(range(4))
        return [(r.case_id, r.replicate) for r in rows]

    assert order("case_major@1") == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert order("replicate_major@1") == [(0, 0), (1, 0), (0, 1), (1, 1)]
    hashed = sorted(order("case_major@1"), key=lambda cr: hashlib.sha256(f"7:{cr[0]}:{cr[1]}".encode()).digest())
    assert order("shuffled@1", 7) == hashed


def test_incomplete_counts_without_the_grid(spark):
    run = run_of(spark, cases=3)
    assert messages(ledger.incomplete(run, calls_of(spark, (0, 1), (1, 2)))) == [("run.incomplete", "4 items missing")]
    assert ledger.missing_items(run, calls_of(spark, (0, 1), (1, 2))).count() == 4
    assert messages(ledger.incomplete(run_of(spark, finished=None), calls_of(spark, (0, 1)))) == []


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_peak_is_that_of_a_sweep(spark, partitions, width):
    rng = random.Random(width)
    spans = [(k, s, s + rng.randint(0, 12)) for k in "ab" for s in (rng.randint(0, 40) for _ in range(40))]

    def brute(key):
        events = sorted([(s, 1) for k, s, _ in spans if k == key] + [(e, -1) for k, _, e in spans if k == key])
        level = top = 0
        for _, step in events:
            level += step
            top = max(top, level)
        return top

    df = spark.createDataFrame(spans, "k string, s bigint, e bigint")
    assert {r.k: r.peak for r in windows.peak(df, "k", "s", "e", width).collect()} == {k: brute(k) for k in "ab"}


@pytest.mark.parametrize("width", [1, 5, 1000])
def test_running_values_cross_chunks(spark, partitions, width):
    rng = random.Random(width)
    rows = [(k, i, rng.randint(-9, 9)) for k in "ab" for i in range(30)]
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint")
    chunk = F.floor(F.col("i") / width)
    got = windows.running(df, ["k"], chunk, ["i"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))})
    for r in got.collect():
        before = [v for k, i, v in rows if k == r.k and i < r.i]
        assert (r.s, r.m) == ((sum(before), max(before)) if before else (None, None))
    last = windows.previous(df, ["k"], chunk, "i", ["v"]).where("i > 0").collect()
    assert all(r.prev_i == r.i - 1 and r.prev_v == rows[(r.k == "b") * 30 + r.i - 1][2] for r in last)


def test_longest_blank_stretch(spark):
    rows = [("a", i, b, 2) for i, b in enumerate([1, 1, 0, 1, 1, 1, 0])] + [("b", 0, 0, 5)]
    df = spark.createDataFrame(rows, "k string, i bigint, blank int, n int").withColumn("blank", F.col("blank") == 1)
    got = {r.k: r for r in windows.longest_runs(df, "k", "i", "blank", "n", 4, width=2).collect()}
    assert (got["a"].longest, got["a"].cut, got["a"].cut_at, got["a"].cut_tokens) == (6, True, 1, 4)
    assert (got["b"].longest, got["b"].cut) == (0, False)


# --------------------------------------------------------------------------------- seals


def seal(spark, rows):
    df = spark.createDataFrame([(1, r) for r in rows], "log_id int, canonical string")
    started = spark.createDataFrame([(1, '{"s":1}')], "log_id int, started string")
    return ledger.seals(df.repartition(3), started).first()


def tree(rows):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    nodes = sorted(f"{sha(r)}:{rows.count(r)}" for r in set(rows))
    for digits in (8, 4, 0):
        prefixes = sorted({n[:digits] for n in nodes})
        nodes = sorted(p + ":" + sha(",".join(n for n in nodes if n[:digits] == p)) for p in prefixes)
    return nodes[0][1:]


@pytest.mark.parametrize("n", [0, 1, 40, 400])
def test_seals_of_every_size_are_trees(spark, n):
    rows = [json.dumps({"n": i % 300, "t": "å" if i % 2 else "z"}, ensure_ascii=False) for i in range(n)]
    body = f'"{tree(rows)}"' if rows else ""
    document = '{"items":[' + body + '],"started":{"s":1}}'
    found = seal(spark, rows)
    assert (found.version, found.seal) == ("tree@1", "sha256:" + hashlib.sha256(document.encode()).hexdigest())
    if rows:
        assert seal(spark, list(reversed(rows))).seal == found.seal
        assert seal(spark, [*rows, rows[0]]).seal != found.seal
        assert seal(spark, [*rows[1:], rows[0] + " "]).seal != found.seal


def test_a_changed_row_is_found_from_the_root_down(spark, tmp_path):
    from assayer.operators import seals

    rows = [(log, part, f'{{"log":{log},"n":{n}}}') for log in range(30) for part, size in (("items", 40), ("canaries", 4)) for n in range(size)]
    schema = "log_id int, part string, canonical string"
    before = spark.createDataFrame(rows, schema)
    path = str(tmp_path / "trees")
    seals.store(seals.nodes(before), path)
    started = spark.createDataFrame([(log, "{}") for log in range(31)], "log_id int, started string")
    sealed = {r.log_id: r.seal for r in seals.seals(seals.stored(spark, path), started, ["items", "canaries"]).collect()}
    assert len(sealed) == 31
    changed = [(7, "canaries", "changed") if r == (7, "canaries", '{"log":7,"n":2}') else r for r in rows if r != (9, "items", '{"log":9,"n":0}')]
    changed += [(11, "items", '{"log":11,"n":5}'), (40, "items", "new")]
    now = spark.createDataFrame(changed, schema)
    again = {r.log_id: r.seal for r in seals.seals(seals.nodes(now), started, ["items", "canaries"]).collect()}
    assert {log for log in sealed if sealed[log] != again[log]} == {7, 9, 11}
    trees = seals.stored(spark, path)
    found = seals.changes(trees, now)
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert sorted(map(tuple, found.collect())) == sorted([
        (7, "canaries", digest('{"log":7,"n":2}'), 1, 0), (7, "canaries", digest("changed"), 0, 1), (9, "items", digest('{"log":9,"n":0}'), 1, 0),
        (11, "items", digest('{"log":11,"n":5}'), 1, 2), (40, "items", digest("new"), 0, 1),
    ])
    texts = {(r.log_id, r.message, r.subject) for r in seals.named(found, now).collect()}
    assert ("7", "a row came after the log was sealed", "canaries changed") in texts
    assert ("11", "a row is there 2 times, 1 when the log was sealed", 'items {"log":11,"n":5}') in texts
    assert seals.changes(trees, before).count() == 0


def test_only_subtrees_that_differ_are_read(spark, tmp_path, monkeypatch):
    from assayer.operators import seals

    rows = [(log, "items", f"{log}:{n}") for log in range(200) for n in range(5)]
    before = spark.createDataFrame(rows, "log_id int, part string, canonical string")
    path = str(tmp_path / "trees")
    seals.store(seals.nodes(before), path)
    read = []
    whole = seals._differing

    def watched(was, now):
        read.append(was.select(F.col("*"), F.lit(1)).inputFiles() if not read else plan_of(was))
        return whole(was, now)

    monkeypatch.setattr(seals, "_differing", watched)
    now = before.withColumn("canonical", F.when(F.col("canonical") == "3:2", "3:two").otherwise(F.col("canonical")))
    assert seals.changes(seals.stored(spark, path), now).count() == 2
    assert len(read) == 4
    for plan, digits in zip(read[1:], (4, 8, 64), strict=True):
        filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan, re.S)[1]
        # The level and the one bucket of the log that differs.
        assert f"(digits#" in filters and f"= {digits})" in filters and re.search(r"\(bucket#\d+ = \d+\)", filters)


# ---------------------------------------------------------------------- plans of hot runs


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_a_large_run_is_spread_over_tasks(spark):
    """With no table broadcast, every window over a run's chunks has rows dealt out by run and chunk."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        run = run_of(spark, "shuffled@1", 3, cases=9)
        calls = calls_of(spark, *[(i, i + 3) for i in range(2)])
        for frame, key in (
            (ledger.out_of_order(run, calls), r"hashpartitioning\(run#\d+, _chunk#\d+"),
            (ledger.schedule(run), r"hashpartitioning\(run#\d+, _chunk#\d+"),
            (ledger.over_concurrency(run, calls), r"hashpartitioning\(run#\d+, chunk#\d+"),
        ):
            assert re.search(key, plan_of(frame)), plan_of(frame)
        rows = spark.createDataFrame([(1, "a"), (1, "b")], "log_id int, canonical string")
        started = spark.createDataFrame([(1, "{}")], "log_id int, started string")
        assert len(re.findall(r"hashpartitioning\(log_id#\d+, (?:prefix|leaf)#\d+", plan_of(ledger.seals(rows, started)))) == 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_logs_read_back_in_order(spark, partitions):
    from assayer.sources import store

    items = [(k, f"row {i:03d}") for k in "ab" for i in range(50 if k == "a" else 3)] * 2
    found = store.read_log(
        spark.createDataFrame([("a", "A"), ("b", "B")], "log_id string, started string"),
        spark.createDataFrame(items, "log_id string, canonical string").repartition(5),
    ).orderBy("log_id", "position").collect()
    for log in "ab":
        lines = [r.line for r in found if r.log_id == log]
        assert lines == [f"started {log.upper()}", *sorted(t for k, t in items if k == log)]
        assert [r.position for r in found if r.log_id == log] == list(range(len(lines)))


# ------------------------------------------------------------------------- rounds, models


def test_last_turns_decide_what_is_unanswered(spark):
    turns = spark.createDataFrame(
        [("answered", 0, "done", 2), ("answered", 1, "done", 2), ("open", 0, "done", 2), ("open", 1, "done", 2), ("long", 3, None, 2)],
        "item string, round int, answer_tool string, max_rounds int",
    )
    pending = spark.createDataFrame(
        [("answered", 0, "look"), ("open", 1, "look"), ("open", 1, "ask"), ("open", 1, "done"), ("long", 3, "done")],
        "item string, round int, name string",
    )
    found = sorted((r.subject, r.code, r.message) for r in ledger.unanswered(turns, pending).collect())
    assert found == [
        ("long", "tools.rounds", "more than 2 rounds"),
        ("long", "tools.unanswered", "the last response still calls done after 3 of 2 rounds"),
        ("open", "tools.unanswered", "the last response still calls ask, look after 1 of 2 rounds"),
    ]


def test_the_answer_is_not_a_tool_to_run(spark):
    called = spark.createDataFrame([("x", 0, "1", "look"), ("x", 0, "2", "done"), ("y", 0, "3", "look")], "item string, round int, id string, name string")
    ran = called.where("id = '1'")
    found = ledger.round_mismatches(called, ran, "done").collect()
    assert [(r.item, r.not_run, r.not_called) for r in found] == [("y", 1, 0)]


def test_failed_calls_attest_no_model(spark):
    runs = spark.createDataFrame([(1, "m")], "run int, declared_model string")
    calls = spark.createDataFrame(
        [(1, 0, 0, "m", True), (1, 0, 1, None, False), (1, 0, 2, None, True), (1, 0, 3, "n", True)],
        "run int, case_id bigint, replicate bigint, returned_model string, has_response boolean",
    )
    assert sorted(messages(ledger.model_attestation(runs, calls))) == [
        ("attestation.model", "engine returned model 'n', declared 'm'"),
        ("attestation.model", "engine returned no model name, declared 'm'"),
    ]


# --------------------------------------------------------------------------------- graph


def test_closure_reaches_each_once_and_ends_on_cycles(spark):
    refs = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("x", "y")], "src string, dst string")
    roots = spark.createDataFrame([("a",), ("a",)], "digest string")
    assert sorted(r.digest for r in graph.closure(roots, refs).collect()) == ["a", "b", "c", "d"]


def test_collapses_land_or_go_round(spark):
    facts = spark.createDataFrame(
        [(1, "low", "high"), (1, "high", None), (1, "on", "off"), (1, "off", "on"), (2, "low", "none known")],
        "model int, level string, next string",
    )
    got = {(r.model, r.level): (r.landed, r.goes_round) for r in graph.land(facts, ["low", "high", "on", "off"]).collect()}
    assert got[1, "low"] == got[1, "high"] == ("high", False)
    assert got[1, "on"] == got[1, "off"] == (None, True)
    assert got[2, "low"] == ("none known", False)


# ------------------------------------------------------------------------------ families

BINDING = "id bigint, family bigint, source string, source_id string, hex string"


@pytest.mark.parametrize(
    "listing, expected",
    [
        ({"c1": "same"}, [("c1", 1, "unchanged")]),
        ({"c1-renamed": "same"}, [("c1-renamed", 1, "renamed")]),
        ({"c1": "other"}, [("c1", 1, "changed")]),
        ({}, [("c1", 1, "gone")]),
        ({"c2": "other"}, [("c1", 1, "gone"), ("c2", None, "new")]),
    ],
)
def test_survey(spark, listing, expected):
    bindings = spark.createDataFrame([(1, 1, "r", "old", "old"), (2, 1, "r", "c1", "same")], BINDING)
    listed = spark.createDataFrame([("r", i, h) for i, h in listing.items()], "source string, source_id string, hex string")
    rows = families.survey(bindings, listed).collect()
    assert sorted((r.source_id, r.family, r.status) for r in rows) == sorted(expected)


def test_a_rename_needs_exactly_one_candidate(spark):
    bindings = spark.createDataFrame([(1, 1, "r", "a", "same"), (2, 2, "r", "b", "same")], BINDING)
    listed = spark.createDataFrame([("r", "c", "same")], "source string, source_id string, hex string")
    rows = families.survey(bindings, listed).collect()
    assert sorted((r.source_id, r.status) for r in rows) == [("a", "gone"), ("b", "gone"), ("c", "new")]


def test_the_lowest_other_family_holds(spark):
    bindings = spark.createDataFrame(
        [(1, 1, "r", "a", "x"), (2, 2, "r", "b", "x"), (3, 3, "r", "c", "y"), (4, 3, "r", "d", "y")], BINDING
    )
    wanted = spark.createDataFrame(
        [(1, "r", "b", "x", None), (2, "r", "b", "z", None), (3, "r", "n", "x", 1), (4, "r", "c", "q", None), (5, "r", "d", "q", 3)],
        "key int, source string, source_id string, hex string, but bigint",
    )
    got = {r.key: (r.family, r.same_id) for r in families.holders(bindings, wanted).collect()}
    assert got == {1: (1, False), 2: (2, True), 3: (2, False)}


def test_entries_fold_by_their_order(spark):
    entries = spark.createDataFrame(
        [
            (1, 1, "name", "a", None, True), (5, 1, "name", None, None, False), (2, 1, "tag", "x", None, True), (3, 1, "tag", "y", None, True),
            (4, 1, "tag", "x", None, False), (6, 1, "owner", None, 7, True), (8, 1, "deleted", None, None, False), (7, 1, "deleted", None, None, True),
        ],
        "id int, thread int, field string, value string, person bigint, present boolean",
    )
    a = catalog.about(entries).first()
    assert (a["name"], a.tags, a.owner, a.deleted, a.collaborators) == (None, ["y"], 7, False, [])
