"""What must hold for tables that are larger than one machine: plans and steps, not only rows."""

import datetime

from pyspark.sql import functions as F

from assayer.functions import tape, text
from assayer.operators import ledger, requests, rules, seals
from assayer.operators.findings import summary
from assayer.plans import QUERIES
from assayer.plans.tables import Given
from assayer.sources import bundle


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_levels_of_models_are_not_gathered_on_the_driver(spark, tmp_path):
    """Eight levels spread from a model's row look as small as the row."""
    spark.range(1000).withColumnRenamed("id", "model").write.parquet(str(tmp_path / "models"))
    levels = spark.read.parquet(str(tmp_path / "models")).select("model", F.explode(F.array(*[F.lit(f"l{i}") for i in range(8)])).alias("level"))
    landed = levels.select("model", "level", F.col("level").alias("landed"), F.lit(False).alias("goes_round"))
    writes = levels.where("level <> 'l7'").select("model", "level", F.lit("e").alias("effort"), F.when(F.col("level") == "l6", "no").alias("refused"))
    recommended = levels.where("level <> 'l5'").withColumn("sampling", F.lit("{}"))
    defaults = levels.where("level IN ('l0', 'l6')")
    settings = rules.model_settings(landed, writes, recommended)
    chosen = rules.default_settings(rules.resolved(landed, writes, recommended), defaults)
    for found in (settings, chosen):
        assert "Broadcast" not in plan(found)
    assert settings.where("refused IS NULL").count() == 5000
    assert sorted((r.level, r.refused, r.reasons) for r in chosen.where("model = 3").collect()) == [("l0", None, True), ("l6", "no", None)]


def test_what_is_referred_to_is_looked_up_once(spark):
    """Odd references: a null end, no kinds, a component there twice, references of nobody."""
    components = spark.createDataFrame([("a", "x", "{}"), ("b", "y", "{}"), ("b", "y", "{}"), ("n", None, "{}")], "digest string, kind string, canonical string")
    refs = spark.createDataFrame(
        [("a", "/1", "b", ["x", "z"]), ("a", "/2", "b", ["y"]), ("a", "/3", "gone", ["y"]), ("a", "/3", "gone", ["y"]), ("a", "/4", None, ["y"]), ("a", "/5", "b", None), ("a", "/6", "n", ["x"]), ("other", "/7", "gone", ["y"])],
        "src string, path string, dst string, kinds array<string>",
    )
    roots = components.where("digest = 'a'").select("digest")
    found = bundle.verify(components, roots, refs)
    got = sorted((r.code, r.subject, r.message or "") for r in found.where("code <> 'bundle.digest'").collect())
    assert got == [("ref.kind", "a/1", "y is not one of x, z")] * 2 + [("ref.missing", "a/3", "gone is missing")] * 2 + [("ref.missing", "a/4", "")]
    # One look at the references for their ends, one for those that are wrong.
    for setting, value in (("spark.sql.autoBroadcastJoinThreshold", "-1"),):
        before = spark.conf.get(setting)
        spark.conf.set(setting, value)
        shuffled = [line for line in plan(bundle.verify(components, roots, refs)).splitlines() if "Exchange hashpartitioning(src" in line]
        spark.conf.set(setting, before)
    assert len(shuffled) == 2  # references and components, each once


def test_a_response_is_read_once_for_all_its_members(spark):
    response = '{"a":1, "choices":[{"message":{"tool_calls": [1.50, {"z":1,"a":"x  y"}],"content":"q","content":"r"}}]}'
    rows = spark.createDataFrame([(1, response), (2, "no json"), (3, None), (4, '{"choices":[{"message":[1]}]}')], "item int, response string")
    got = {r.item: r.m for r in rows.select("item", tape.members(F.col("response"), "$.choices[0].message", ["content", "tool_calls", "none"]).alias("m")).collect()}
    assert got == {1: ['"r"', '[1.50,{"z":1,"a":"x  y"}]', None], 2: [None] * 3, 3: None, 4: [None] * 3}
    rounds = rows.select("item", F.lit("{").alias("head"), F.array().cast("array<string>").alias("messages"), F.lit("}").alias("tail"), "response")
    results = spark.createDataFrame([], "item int, id string, result string")
    made = requests.next_requests(rounds, results)
    assert plan(made).count("picked(") == 1 or plan(made).count("ArrowEvalPython [") == 1
    assert made.where("item = 1").first().request.startswith('{"messages":[{"role":"assistant","content":"r","tool_calls":[1.50')


def test_rows_are_hashed_once_to_find_what_changed(spark, monkeypatch):
    calls, made = [], seals.nodes
    monkeypatch.setattr(seals, "nodes", lambda rows: calls.append(1) or made(rows))
    was = spark.createDataFrame([(1, "items", f"r{i}") for i in range(9)] + [(2, "items", "x")], "log_id long, part string, canonical string")
    now = was.where("canonical <> 'r3'").unionByName(was.where("canonical = 'r4'"))
    found = seals.changes(made(was).withColumn("bucket", seals.bucket()).checkpoint(), now)
    assert sorted((r.log_id, r.was, r.now) for r in found.collect()) == [(1, 1, 0), (1, 1, 2)]
    assert len(calls) == 1


def test_kept_views_are_read_back(spark, tmp_path):
    g = Given(spark, "/root/testdata/sf0.001")
    made = g.kept("d_run")
    assert made.has("d_run") and not g.has("d_run")
    assert "parquet" not in plan(made["d_run"]) and sorted(made["d_run"].collect()) == sorted(g["d_run"].collect())


def test_words_of_odd_texts(spark):
    texts = ["", " ", "a", " a", "a ", "Straße, ÉÅ x1", "..İ ﬁ\U0001f600b", None, "x " * 3000 + "y"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", "t", text.words_at(F.col("t")).alias("w")).collect()
    import re

    for r in rows:
        if r.t is None:
            assert r.w is None
        else:
            assert [(w.start, w.word) for w in r.w] == [(m.start(), m.group().casefold()) for m in re.finditer(r"\w+", r.t)], r.t


def shuffled(spark):
    """Files of shuffles on disk."""
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {str(files.apply(i).getName()) for i in range(files.size()) if str(files.apply(i).getName()).startswith("shuffle_")}


def test_a_logs_rows_are_dealt_out_twice_for_its_seal(spark):
    """Once with all levels of the tree under a prefix, once for the root."""
    parts = F.when(F.col("id") % 9 == 0, "canaries").otherwise("items").alias("part")
    rows = spark.range(2000).select((F.col("id") % 3).alias("log_id"), parts, F.concat(F.lit("r"), F.col("id") % 1500).alias("canonical"))
    roots = seals.nodes(rows).where("digits = 0")
    assert plan(roots).count("Exchange hashpartitioning") == 2 and roots.count() == 4


def test_code_of_tools_is_dealt_out_once_a_side(spark, tmp_path):
    tables(spark, tmp_path)
    found = QUERIES["code_mismatch"](Given(spark, str(tmp_path)))
    assert plan(found).count("Exchange hashpartitioning") == 2
    assert {r.code for r in found.collect()} == {"tools.code"}


def tables(spark, path):
    """Some rows of each table that the findings read."""
    day = datetime.datetime(2024, 1, 1)
    frames = {
        "events": ([(i, day + datetime.timedelta(seconds=i), i % 5, "view" if i % 3 else "click", i / 9) for i in range(600)], "event_id long, ts timestamp, user_id long, event_type string, value double"),
        "orders": ([(i, day) for i in range(200)], "o_orderkey long, o_orderdate timestamp"),
        "lineitem": ([(i // 3, i % 40, i % 7, i % 3, "RAN"[i % 3]) for i in range(600)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string"),
        "part": ([(i, f"p{i}", "b", i % 9) for i in range(40)], "p_partkey long, p_name string, p_brand string, p_size int"),
        "documents": ([(i, "text") for i in range(50)], "doc_id long, text string"),
    }
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).write.parquet(str(path / f"{name}.parquet"))


def test_findings_are_written_part_by_part(spark, tmp_path):
    """What one part shuffles is gone before the next begins."""
    tables(spark, tmp_path)
    g = Given(spark, str(tmp_path))
    before = shuffled(spark)
    found = QUERIES["all_findings"](g)
    assert "Exchange" not in plan(found)
    # What is left are the shuffles of the few rows of runs and canaries.
    assert len(shuffled(spark) - before) <= 2 * 2 * 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert plan(summary(found)).count("Exchange") <= 3 and found.count() > 600


def test_unanswered_calls_are_written_part_by_part(spark):
    turns = spark.createDataFrame([(1, 0, "done", 2), (1, 1, "done", 2), (2, 3, "done", 2)], "item int, round int, answer_tool string, max_rounds int")
    pending = spark.createDataFrame([(1, 1, "ask"), (2, 3, "done")], "item int, round int, name string")
    before = shuffled(spark)
    found = ledger.unanswered(turns, pending)
    assert "Exchange" not in plan(found) and not shuffled(spark) - before
    assert sorted(r.code for r in found.collect()) == ["tools.rounds", "tools.unanswered"]
