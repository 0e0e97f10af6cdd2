import json

import pytest
from pyspark.sql import functions as F

from assayer.sources import bundle, store, texts
from assayer.sources.ledger import Conflict, Ledger
from assayer.streaming import chunks, events, ingest


def assembled(spark, *stream):
    df = spark.createDataFrame([(1, n, json.dumps(c)) for n, c in enumerate(stream)], "call_id int, seq bigint, chunk string")
    return json.loads(chunks.assemble(df).first().response)


def test_a_stream_cut_short_adds_up_to_what_came(spark):
    opening = {"id": "c-1", "model": "m", "prompt_token_ids": [1, 2], "choices": [{"index": 0, "delta": {"role": "assistant", "content": ""}}]}
    later = {"id": "c-1", "prompt_token_ids": [9], "choices": [{"index": 0, "delta": {"content": "Fake"}, "token_ids": [5]}]}
    got = assembled(spark, opening, later)
    assert got == {
        "id": "c-1", "object": "chat.completion", "model": "m", "prompt_token_ids": [1, 2],
        "choices": [{"index": 0, "message": {"role": "assistant", "content": "Fake"}, "finish_reason": None, "token_ids": [5]}],
    }
    assert list(got) == ["id", "object", "model", "choices", "prompt_token_ids"]


def test_fragments_of_calls_are_merged_by_index(spark):
    def delta(**d):
        return {"choices": [{"index": 0, "delta": d}]}

    got = assembled(
        spark,
        delta(reasoning="Hm", tool_calls=[{"index": 1, "id": "b", "type": "function", "function": {"name": "g", "arguments": "{"}}]),
        delta(content="a\n\"", tool_calls=[{"index": 0, "id": "a", "function": {"name": "f"}}]),
        delta(content="b", tool_calls=[{"index": 1, "function": {"arguments": "}"}}]),
        {"choices": [{"index": 1, "delta": {"content": "no"}}, {"index": 0, "delta": {}, "finish_reason": "stop", "stop_reason": 7}]},
        {"choices": [], "usage": {"n": 1}, "system_fingerprint": "fp"},
    )
    message = got["choices"][0]["message"]
    assert (message["content"], message["reasoning"]) == ('a\n"b', "Hm")
    assert message["tool_calls"] == [
        {"id": "a", "function": {"name": "f", "arguments": ""}},
        {"id": "b", "type": "function", "function": {"name": "g", "arguments": "{}"}},
    ]
    assert (got["choices"][0]["finish_reason"], got["choices"][0]["stop_reason"], got["usage"]) == ("stop", 7, {"n": 1})


def test_server_sent_events(spark):
    stream = ': a comment\ndata: {"a":\ndata: 1}\r\n\nevent: ignored\ndata:{}\n\ndata: [DONE]\n\ndata: {"after": "done"}\n'
    bad = 'data: {"error": {"message": "overloaded"}}\n\ndata: [1]\n\n'
    df = spark.createDataFrame([(1, stream), (2, bad)], "call int, stream string")
    rows = events.payload_rows(df, "stream", ["call"]).orderBy("call", "seq").collect()
    assert [(r.payload, r.problem) for r in rows] == [
        ('{"a":\n1}', None), ("{}", None), ('{"error": {"message": "overloaded"}}', "rejected"), ("[1]", "not a JSON object"),
    ]


def chunk(text, finish=None, ids=1):
    return json.dumps({"model": "m", "choices": [{"delta": {"content": text}, "finish_reason": finish, "token_ids": [0] * ids}]})


def test_calls_are_assembled_as_they_stream(spark, tmp_path):
    source = tmp_path / "in"
    schema = "call_id string, seq bigint, chunk string, at timestamp"

    def batch(*rows, hour=0):
        df = spark.createDataFrame(rows, "call_id string, seq bigint, chunk string")
        at = F.to_timestamp(F.lit(f"2024-01-01 {hour:02}:00:00"))
        df.withColumn("at", at).coalesce(1).write.mode("append").json(str(source))

    def step():
        stream = spark.readStream.schema(schema).json(str(source))
        query = (
            chunks.assemble_stream(stream, whitespace_limit=10)
            .writeStream.format("json").outputMode("append")
            .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return {r.call_id: r for r in spark.read.schema(chunks.ASSEMBLED).json(str(tmp_path / "out")).collect()}

    batch(("a", 1, chunk("lo")), ("b", 0, chunk("x", "stop")), ("w", 0, chunk(" \n", ids=6)))
    assert sorted(step()) == ["b"]
    batch(("a", 2, chunk("!", "stop")), ("a", 0, chunk("hel")), ("w", 1, chunk(" ", ids=5)))
    got = step()
    assert (got["a"].content, got["a"].finish_reason, got["a"].n_chunks) == ("hello!", '"stop"', 3)
    assert got["w"].error == "stopped: nothing but whitespace for 11 tokens"
    batch(("lost", 0, chunk("half")))
    step()
    batch(("late", 0, chunk("z", "stop")), hour=9)
    got = step()
    assert (got["lost"].content, got["lost"].error) == ("half", "stopped: no more chunks came")
    assert sorted(got) == ["a", "b", "late", "lost", "w"]


def odd_calls(rng, calls):
    """Calls with whatever chunks can hold, and the chunks a server may send."""
    found = {}
    for call in range(calls):
        some = [{"id": f"c{call}", "created": 1700000000 + call, "model": "m", "prompt_token_ids": [1, call], "choices": [{"index": 0, "delta": {"role": "assistant", "content": ""}}]}]
        for n in range(rng.randint(0, 12)):
            delta = {}
            if rng.random() < 0.8:
                delta["content"] = rng.choice(["a ", 'q"\\', "é\n", ""])
            if rng.random() < 0.3:
                delta["reasoning"] = f"r{n}"
            if rng.random() < 0.4:
                function = {"name": f"f{n}", "arguments": "{"} if rng.random() < 0.5 else {"arguments": f"{n}}}"}
                delta["tool_calls"] = [{"index": rng.randint(0, 2), "function": function, **({"id": f"t{n}", "type": "function"} if rng.random() < 0.5 else {})}]
            part = {"index": 0, "delta": delta, **({"token_ids": [n] * rng.randint(0, 2)} if rng.random() < 0.5 else {})}
            some.append({"id": "other", "model": None, "choices": [{"index": 1, "delta": {"content": "not ours"}}, part]})
        some.append({"choices": [{"index": 0, "delta": {}, "finish_reason": "stop", "stop_reason": 7}], "system_fingerprint": "fp"})
        some.append({"choices": [], "usage": {"z": 1, "a": {"y": 1e-7, "x": None}}})
        found[f"call{call}"] = [json.dumps(c) for c in some] + [chunks.END]
    return found


def test_batch_and_stream_agree_and_nothing_stays(spark, tmp_path):
    import random

    rng = random.Random(3)
    calls = odd_calls(rng, 12)
    rows = [(call, seq, text) for call, texts in calls.items() for seq, text in enumerate(texts)]
    rng.shuffle(rows)
    schema = "call_id string, seq bigint, chunk string"
    want = {r.call_id: r.asDict() for r in chunks.assemble(spark.createDataFrame(rows, schema)).collect()}
    assert '"usage":{"z": 1, "a": {"y": 1e-07, "x": null}}' in want["call0"]["response"]
    source = str(tmp_path / "in")

    def step(some, hour):
        at = F.to_timestamp(F.lit(f"2024-01-01 {hour:02}:00:00"))
        spark.createDataFrame(some, schema).withColumn("at", at).coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema(f"{schema}, at timestamp").json(source)
        query = chunks.assemble_stream(stream, until_end=True).writeStream.format("json").outputMode("append").option("path", str(tmp_path / "out"))
        query = query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        return query.lastProgress["stateOperators"][0]["numRowsTotal"]

    third = len(rows) // 3
    step(rows[:third], 0)
    step(rows[third : 2 * third], 0)
    # Repeats of what has come change nothing.
    held = step(rows[2 * third :] + rows[:5], 0)
    got = {r.call_id: r.asDict() for r in spark.read.schema(chunks.ASSEMBLED).json(str(tmp_path / "out")).collect()}
    assert {k: v.pop("n_chunks") for k, v in got.items()} == {call: len(texts) for call, texts in calls.items()}
    assert {v.pop("error") for v in got.values()} == {None}
    assert got == want
    # Only that each call is done is known, and its timer; later that is forgotten too.
    assert 0 < held <= 4 * len(calls)
    step([("other", 0, "{}")], 5)
    assert step([("other", 0, "{}")], 10) < 12


def test_members_as_written():
    from assayer.functions.jsontext import members

    assert members(' {"b": 1e-7 , "a" :{"z": [1, "}"]},"é\\n":null,"b":2} ') == {"b": "2", "a": '{"z": [1, "}"]}', "é\n": "null"}
    assert members("{}") == members("[1]") == members(chunks.END) == {}


def test_rows_land_once(spark, tmp_path):
    schema = "run int, item int, at timestamp, event string"
    source, target = str(tmp_path / "in"), str(tmp_path / "ledger")

    def batch(*rows):
        spark.createDataFrame(rows, "run int, item int, at string, event string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(source)

    def step(checkpoint):
        stream = spark.readStream.schema(schema).parquet(source)
        ingest.append_once(stream, target, str(tmp_path / checkpoint), ["run", "item"]).awaitTermination()
        return sorted((r.run, r.item) for r in spark.read.parquet(target).collect())

    at = "2024-01-01 00:00:00"
    batch((1, 1, at, "started"), (1, 1, at, "started"), (2, 1, at, "ended"))
    assert step("cp") == [(1, 1), (2, 1)]
    batch((1, 1, at, "ended"), (1, 2, at, "started"))
    assert step("cp") == [(1, 1), (1, 2), (2, 1)]
    # A rerun from nothing finds every key written.
    assert step("other") == [(1, 1), (1, 2), (2, 1)]
    # However far behind the newest row, a new key lands.
    batch((3, 1, "2024-01-02 00:00:00", "started"))
    step("cp")
    batch((3, 2, "2023-06-01 00:00:00", "started"))
    assert step("cp") == [(1, 1), (1, 2), (2, 1), (3, 1), (3, 2)]

    progress = ingest.progress(spark.readStream.schema(schema).parquet(source))
    query = progress.writeStream.format("memory").queryName("progress").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("progress").collect()) == [(1, 3, 1, 0), (2, 0, 1, 0), (3, 2, 0, 0)]


# ------------------------------------------------------------------------ sources, stores


def test_folders_are_listed_and_snapshot(spark, tmp_path):
    import hashlib

    (tmp_path / "b c.txt").write_bytes(b"\xef\xbb\xbftext")
    (tmp_path / "a.txt").write_bytes(b"\xff")
    (tmp_path / "no.md").write_bytes(b"x")
    files = texts.folder(spark, str(tmp_path))
    assert sorted(r.source_id for r in texts.listing(spark, str(tmp_path)).collect()) == ["a", "b c"]
    found = {r.source_id: r.hex for r in texts.snapshot(files, "s").collect()}
    assert found["b c"] == hashlib.sha256(b"\xef\xbb\xbftext").hexdigest()
    assert {r.source_id: r.t for r in files.select("source_id", texts.decoded(F.col("content")).alias("t")).collect()} == {"a": None, "b c": "text"}


def test_components_are_added_once_and_rows_never_overwritten(spark, tmp_path):
    path = str(tmp_path / "components")
    first = spark.createDataFrame([("d1", "k"), ("d1", "k"), ("d2", "k")], "digest string, kind string")
    store.add(first, path)
    store.add(first.unionByName(spark.createDataFrame([("d3", "j")], first.schema)), path)
    assert sorted(r.digest for r in spark.read.parquet(path).collect()) == ["d1", "d2", "d3"]

    log = str(tmp_path / "log")
    rows = spark.createDataFrame([(1, 1, "item"), (1, 2, "item")], "run int, key int, row_type string")
    store.append(rows, log, ["run", "key"])
    with pytest.raises(store.Conflict, match="already stored"):
        store.append(rows.limit(1), log, ["run", "key"])
    with pytest.raises(store.Conflict, match="twice"):
        store.append(rows.withColumn("key", F.lit(9)), log, ["run", "key"])
    assert spark.read.parquet(log).count() == 2


def test_an_append_reads_the_buckets_it_touches(spark, tmp_path):
    path = str(tmp_path / "ledger")
    ledger = Ledger(path, ("run", "item"), logs=8, parts=4)
    rows = spark.range(400).selectExpr("id % 20 AS run", "id AS item", "concat('v', id) AS value")
    assert ledger.append_new(rows, "stream", 1) > 8
    batch = rows.where("run = 3 AND item < 100").unionByName(spark.sql("SELECT 3L AS run, 1000L AS item, 'new' AS value"))
    plan = ledger.held(batch)._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.split(", PushedFilters")[0].split("PartitionFilters: ")[1:]]
    assert len(filters) == 1 and "bucket" in filters[0] and "IN" in filters[0]
    # A log is in 4 of 32 buckets, and only these files are read.
    assert ledger.held(batch).select(F.col("_metadata.file_path")).distinct().count() <= 4
    assert ledger.append_new(batch, "stream", 2) <= 4
    assert spark.read.parquet(path).count() == 401
    # A replay is known by its number without a look at the rows, and by its keys where the note is missing.
    assert ledger.append_new(batch, "stream", 2) == 0
    assert ledger.append_new(batch, "other", 2) > 0
    assert spark.read.parquet(path).count() == 401
    # The same keys in another type are the same.
    assert ledger.append_new(batch.withColumn("run", F.col("run").cast("int"))) > 0
    assert ledger.rows(spark).count() == 401 and ledger.rows(spark).columns == ["run", "item", "value"]
    with pytest.raises(ValueError, match="laid out"):
        Ledger(path, ("run", "item"), logs=8, parts=2).append(batch)
    with pytest.raises(Conflict, match="already stored"):
        ledger.append(batch)


def test_one_log_is_spread_and_nulls_have_a_place(spark, tmp_path):
    path = str(tmp_path / "ledger")
    ledger = Ledger(path, ("run", "item"), logs=4, parts=8)
    ledger.append(spark.range(1000).selectExpr("1L AS run", "id AS item"))
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy("bucket").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 250
    odd = spark.sql("SELECT CAST(NULL AS BIGINT) AS run, 1L AS item UNION ALL SELECT 2L, CAST(NULL AS BIGINT)")
    ledger.append_new(odd)
    ledger.append_new(odd)
    ledger.append_new(odd.limit(0))
    assert spark.read.parquet(path).count() == 1002


def test_a_bundle_goes_out_and_comes_back(spark, tmp_path):
    import hashlib

    digest = lambda t: "sha256:" + hashlib.sha256(t.encode()).hexdigest()
    parts = [(digest(t), "k", t) for t in ("a", "b", "c")]
    components = spark.createDataFrame(parts, "digest string, kind string, canonical string")
    refs = spark.createDataFrame([(parts[0][0], "/x", parts[1][0], ["k"])], "src string, path string, dst string, kinds array<string>")
    roots = components.limit(1).select("digest")
    path = str(tmp_path / "bundle")
    bundle.write(bundle.export(roots, components, refs), path)
    back = bundle.read(spark, path)
    assert {r.canonical: r.is_root for r in back.collect()} == {"a": True, "b": False}
    assert bundle.verify(back, roots, refs).count() == 0
    broken = back.withColumn("canonical", F.when(F.col("is_root"), "changed").otherwise(F.col("canonical"))).where("canonical <> 'b'")
    assert sorted(r.code for r in bundle.verify(broken, roots, refs).collect()) == ["bundle.digest", "ref.missing"]
