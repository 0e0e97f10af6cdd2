"""Streamed answers: chunks of deltas put together into completions, in batch and live."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import jsontext
from ..functions.jsontext import members
from ..operators import windows
from ..operators.findings import message
from ..operators.requests import object_of

# Rows of one call put together at a time before the call's parts are.
BLOCK = 4096


# Members of a chunk of which the first, and those of which the last one given is kept.
FIRST, LAST = ("id", "created", "model", "prompt_token_ids"), ("usage", "system_fingerprint")


@F.pandas_udf(T.StructType([T.StructField(k, T.StringType()) for k in (*FIRST, *LAST)]))
def _given(texts: pd.DataFrame) -> pd.DataFrame:
    """Each of these members, as written in the chunk that gives it."""
    return pd.DataFrame({k: [None if t is None else members(t)[k] for t in texts[k]] for k in (*FIRST, *LAST)}, dtype=object)


def _pieces(chunks: DataFrame, call: str) -> DataFrame:
    """What chunks hold, one row a piece: (call, _seq, _pos, kind, slot, key, value).

    Kinds: `top` (a chunk's members, the value being the chunk), `end` (role and reasons), `text` (strings of a
    delta), `ids`, `name` and `arguments` of the tool call in `slot`. A chunk is parsed once.
    """
    parsed = chunks.select(F.col(call), F.col("seq").alias("_seq"), "chunk", F.try_parse_json("chunk").alias("v"))
    choices = F.coalesce(F.try_variant_get("v", "$.choices", "array<variant>"), F.array().cast("array<variant>"))
    parts = parsed.select(call, "_seq", "chunk", F.posexplode(F.concat(F.array("v"), choices)).alias("_pos", "part"))
    parts = parts.where((F.col("_pos") == 0) | (F.coalesce(F.try_variant_get("part", "$.index", "int"), F.lit(0)) == 0))

    def piece(kind: str, key: str | Column, value: Column, slot: Column | None = None) -> Column:
        slot = F.lit(-1) if slot is None else slot
        return F.struct(F.lit(kind).alias("kind"), slot.alias("slot"), (F.lit(key) if isinstance(key, str) else key).alias("key"), value.alias("value"))

    def written(path: str) -> Column:
        found = F.try_variant_get("part", path, "variant")
        return F.when(~F.is_variant_null(found), F.to_json(found))

    tops = [piece("top", k, F.when(written(f"$.{k}").isNotNull(), F.col("chunk"))) for k in (*FIRST, *LAST)]
    delta = F.try_variant_get("part", "$.delta", "map<string,variant>")
    role = F.try_element_at(delta, F.lit("role"))
    ids = F.try_variant_get("part", "$.token_ids", "array<variant>")
    ends = [
        piece("end", "role", F.when(F.schema_of_variant(role) == "STRING", role.try_cast("string"))),
        piece("end", "finish_reason", written("$.finish_reason")),
        piece("end", "stop_reason", written("$.stop_reason")),
        piece("ids", "", F.when(ids.isNotNull(), F.array_join(F.transform(ids, lambda i: F.to_json(i)), ","))),
    ]
    strings = F.filter(F.map_entries(delta), lambda e: (e["key"] != "role") & (F.schema_of_variant(e["value"]) == "STRING"))
    texts = F.transform(strings, lambda e: piece("text", e["key"], e["value"].try_cast("string")))

    def of_call(c: Column) -> Column:
        at, string = F.coalesce(F.try_variant_get(c, "$.index", "int"), F.lit(0)), lambda path: F.try_variant_get(c, path, "string")
        named = [piece("name", k, string(path), at) for k, path in (("id", "$.id"), ("type", "$.type"), ("name", "$.function.name"))]
        return F.array(*named, piece("arguments", "arguments", string("$.function.arguments"), at))

    tools = F.flatten(F.transform(F.try_element_at(delta, F.lit("tool_calls")).try_cast("array<variant>"), of_call))
    none = F.array().cast("array<struct<kind:string,slot:int,key:string,value:string>>")
    found = F.when(F.col("_pos") == 0, F.array(*tops)).otherwise(F.concat(F.array(*ends), F.coalesce(texts, none), F.coalesce(tools, none)))
    return parts.select(call, "_seq", "_pos", F.inline(found)).where("value IS NOT NULL OR kind IN ('name', 'top')")


def assemble(chunks: DataFrame, call: str = "call_id") -> DataFrame:
    """Completions from chunks (call, seq, chunk as JSON text), one row per call.

    The first non-null id, created, model and prompt_token_ids and the last non-null usage and
    system_fingerprint are kept, as written; the first choice's delta strings are concatenated per key,
    tool-call fragments merged by index, and finish and stop reasons the last ones given.

    Pieces are joined block by block of a call, however many blocks it has, and the blocks' results, a row
    for each member, are dealt out by call once for all that follows.
    """
    place = F.struct("_seq", "_pos")
    some = F.when(F.col("value").isNotNull(), place)
    joins = F.col("kind").isin("text", "ids", "arguments")

    def joined(order: Column, text: Column) -> Column:
        pairs = F.sort_array(F.collect_list(F.when(joins & (text != ""), F.struct(order.alias("o"), text.alias("t")))))
        return F.call_function("concat_ws", F.when(F.col("kind") == "ids", ",").otherwise(""), F.transform(pairs, lambda p: p["t"]))

    member = [call, "kind", "slot", "key"]
    blocks = _pieces(chunks, call).groupBy(*member, F.floor(F.col("_seq") / BLOCK).alias("_block")).agg(
        joined(place, F.col("value")).alias("text"), F.min(place).alias("at"),
        F.min_by("value", some).alias("first"), F.min(some).alias("first_at"), F.max_by("value", some).alias("last"), F.max(some).alias("last_at"),
    )
    whole = blocks.repartition(call).groupBy(*member).agg(
        joined(F.col("_block"), F.col("text")).alias("text"), F.min("at").alias("at"), F.min_by("first", "first_at").alias("first"), F.max_by("last", "last_at").alias("last"),
    )

    def of(kind: str, key: str, value: str) -> Column:
        return F.max(F.when((F.col("kind") == kind) & (F.col("key") == key), F.col(value))).alias(key)

    quoted = jsontext.quoted
    text = F.when(F.col("kind") == "text", F.struct("at", "key", "text"))
    slots = whole.groupBy(call, "slot").agg(
        *[of("top", k, "first") for k in FIRST], *[of("top", k, "last") for k in LAST],
        *[of("end", k, "last") for k in ("role", "finish_reason", "stop_reason")],
        F.max(F.when(F.col("kind") == "ids", F.col("text"))).alias("token_ids"), F.collect_list(text).alias("texts"),
        of("text", "content", "text"), *[F.max(F.when((F.col("kind") == "name") & (F.col("key") == k), F.col("last"))).alias(f"_{k}") for k in ("id", "type", "name")],
        of("arguments", "arguments", "text"),
    )
    tool = object_of([
        ("id", F.when(F.col("_id").isNotNull(), quoted(F.col("_id")))),
        ("type", F.when(F.col("_type").isNotNull(), quoted(F.col("_type")))),
        (
            "function",
            object_of([
                ("name", F.when(F.col("_name").isNull(), F.lit("null")).otherwise(quoted(F.col("_name")))),
                ("arguments", quoted(F.coalesce("arguments", F.lit("")))),
            ]),
        ),
    ])
    own = [*FIRST, *LAST, "role", "finish_reason", "stop_reason", "token_ids", "content"]
    tools = F.collect_list(F.when(F.col("slot") >= 0, F.struct("slot", F.col("tool").alias("text"))))
    calls = slots.withColumn("tool", tool).groupBy(call).agg(
        *[F.max(F.when(F.col("slot") < 0, F.col(k))).alias(k) for k in own],
        F.max(F.when(F.col("slot") < 0, F.sort_array("texts"))).alias("texts"),
        F.array_join(F.transform(F.sort_array(tools), lambda t: t["text"]), ",").alias("tool_calls"),
    )
    calls = calls.withColumn("_given", _given(F.struct(*[F.col(k) for k in (*FIRST, *LAST)])))
    given = lambda k: F.col(f"_given.{k}")
    listed = lambda c: F.when(F.col(c) != "", F.concat(F.lit("["), F.col(c), F.lit("]")))
    speaker = F.coalesce("role", F.lit("assistant"))
    spoken = F.transform("texts", lambda m: F.concat(quoted(m["key"]), F.lit(":"), quoted(m["text"])))
    body = F.concat(
        F.array(F.concat(F.lit('"role":'), quoted(speaker))),
        F.coalesce(spoken, F.array().cast("array<string>")),
        F.array_compact(F.array(F.concat(F.lit('"tool_calls":'), listed("tool_calls")))),
    )
    choice = object_of([
        ("index", F.lit("0")),
        ("message", F.concat(F.lit("{"), F.array_join(body, ","), F.lit("}"))),
        ("finish_reason", F.coalesce("finish_reason", F.lit("null"))),
        ("stop_reason", F.col("stop_reason")),
        ("token_ids", F.when(F.col("token_ids").isNotNull(), F.concat(F.lit("["), F.col("token_ids"), F.lit("]")))),
    ])
    response = object_of([
        ("id", given("id")), ("object", F.lit('"chat.completion"')), ("created", given("created")), ("model", given("model")),
        ("choices", F.concat(F.lit("["), choice, F.lit("]"))), ("usage", given("usage")),
        ("system_fingerprint", given("system_fingerprint")), ("prompt_token_ids", given("prompt_token_ids")),
    ])
    return calls.select(call, speaker.alias("role"), "content", listed("tool_calls").alias("tool_calls"), "finish_reason", given("usage").alias("usage"), response.alias("response"))


def runaways(tokens: DataFrame, limit: int) -> DataFrame:
    """Calls cut short for whitespace: where, and after how many blank tokens in a row."""
    runs = windows.longest_runs(tokens, "call_id", "seq", "blank", "tokens", limit)
    return runs.where("cut").select(
        "call_id", F.col("cut_at").alias("seq"),
        message("stopped: nothing but whitespace for ", F.col("cut_tokens"), " tokens").alias("error"),
    )


# ------------------------------------------------------------------------------ streaming

ASSEMBLED = T.StructType(
    [
        *[T.StructField(name, T.StringType()) for name in ("call_id", "role", "content", "tool_calls", "finish_reason", "usage", "response")],
        T.StructField("n_chunks", T.LongType()),
        T.StructField("error", T.StringType()),
    ]
)
# What a stream says after a call's last chunk.
END = "[DONE]"


def _compact(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _string(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else _compact(value)


def _object(pairs: Iterable[tuple[str, str | None]]) -> str:
    return "{" + ",".join(f"{_compact(k)}:{v}" for k, v in pairs if v is not None) + "}"


class Running:
    """What the chunks of a call, read in order, add up to since the last batch."""

    def __init__(self, head: dict) -> None:
        self.head = head
        self.tops: dict[str, str] = {}
        self.texts: dict[str, list[str]] = {}
        self.ids: list[str] = []
        self.names: dict[int, dict[str, str]] = {}
        self.arguments: dict[int, list[str]] = {}

    def add(self, text: str, limit: int | None) -> None:
        head = self.head
        head["n"] += 1
        if text.strip() == END:
            head["over"] = True
            return
        chunk = json.loads(text)
        if not isinstance(chunk, dict):
            return
        for key, raw in members(text).items():
            if raw != "null" and (key in LAST or key in FIRST and key not in head["first"]):
                self.tops[key] = raw
                head["first"] += [key] if key in FIRST else []
        choices = chunk.get("choices")
        for part in choices if isinstance(choices, list) else []:
            part = part if isinstance(part, dict) else {}
            if (part.get("index") or 0) == 0:
                self._part(part)
                if limit is not None and head["blank"] >= limit:
                    head["error"] = f"stopped: nothing but whitespace for {head['blank']} tokens"
                    return

    def _part(self, part: dict) -> None:
        head = self.head
        for key in ("finish_reason", "stop_reason"):
            if part.get(key) is not None:
                head[key] = _compact(part[key])
        ids = part.get("token_ids")
        if isinstance(ids, list):
            self.ids += [",".join(map(_compact, ids))] if ids else []
            head["ids"] = True
        delta = part.get("delta")
        delta = delta if isinstance(delta, dict) else {}
        for key in sorted(delta):
            if isinstance(delta[key], str) and key == "role":
                head["role"] = delta[key]
            elif isinstance(delta[key], str):
                self.texts.setdefault(key, []).append(delta[key])
                head["order"] += [] if key in head["order"] else [key]
        if isinstance(delta.get("content"), str):
            count = len(ids) if isinstance(ids, list) else 1
            head["blank"] = 0 if delta["content"].strip() else head["blank"] + count
        called = delta.get("tool_calls")
        for fragment in called if isinstance(called, list) else []:
            fragment = fragment if isinstance(fragment, dict) else {}
            index = fragment.get("index")
            function = fragment.get("function")
            function = function if isinstance(function, dict) else {}
            names = self.names.setdefault(index if isinstance(index, int) else 0, {})
            given = {"id": fragment.get("id"), "type": fragment.get("type"), "name": function.get("name")}
            names |= {k: _string(v) for k, v in given.items() if v is not None}
            if function.get("arguments") is not None:
                self.arguments.setdefault(index if isinstance(index, int) else 0, []).append(_string(function["arguments"]))


class AssembleCalls(StatefulProcessor):
    """Adds up a call's chunks as they come; those ahead of their turn wait for it.

    State holds what the chunks add up to: a head of a few values, members, and lists of texts, token ids and
    arguments that a batch appends to and nobody reads before the call is whole. So a call costs what its chunks
    do, however many batches bring them. A whole call is emitted once, in order of `seq`. It is emitted with an error
    when its blank tokens reach the limit or no chunk of it has come in the timeout. For as long again its key
    is remembered, so that repeated chunks begin nothing; then nothing of it is held.
    """

    def __init__(self, whitespace_limit: int | None = 100, timeout_ms: int = 3_600_000, until_end: bool = False) -> None:
        self.limit, self.timeout_ms, self.until_end = whitespace_limit, timeout_ms, until_end

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "head STRING")
        self.tops = handle.getMapState("tops", "key STRING", "raw STRING")
        self.names = handle.getMapState("names", "slot INT", "names STRING")
        self.texts = handle.getListState("texts", "key STRING, text STRING")
        self.ids = handle.getListState("ids", "text STRING")
        self.arguments = handle.getListState("arguments", "slot INT, text STRING")
        self.pending = handle.getMapState("pending", "seq LONG", "chunk STRING")
        self.done = handle.getValueState("done", "done BOOLEAN")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.done.exists():
            for _ in rows:
                pass
            return
        head = self._head()
        latest, came = 0, {}
        for frame in rows:
            came |= {int(seq): chunk for seq, chunk in zip(frame["seq"], frame["chunk"], strict=True) if chunk is not None}
            latest = max(latest, int(frame["at"].max().timestamp() * 1000))
        running = Running(head)
        while head["error"] is None:
            chunk, seq = came.pop(head["n"], None), (head["n"],)
            if head["waiting"] and self.pending.containsKey(seq):
                chunk = self.pending.getValue(seq)[0]
                self.pending.removeKey(seq)
                head["waiting"] -= 1
            if chunk is None:
                break
            running.add(chunk, self.limit)
        for seq, chunk in came.items():
            if seq > head["n"] and not self.pending.containsKey((seq,)):
                self.pending.updateValue((seq,), (chunk,))
                head["waiting"] += 1
        self._keep(running)
        for timer in list(self.handle.listTimers()):
            latest = max(latest, timer - self.timeout_ms)
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(latest + self.timeout_ms)
        whole = head["over"] or (not self.until_end and "finish_reason" in head)
        if head["error"] is not None or (whole and not head["waiting"]):
            yield self._emit(key[0], head)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.done.exists():
            self.done.clear()
            return
        head = self._head()
        if "finish_reason" not in head or head["waiting"]:
            head["error"] = "stopped: no more chunks came"
        yield self._emit(key[0], head)
        self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + self.timeout_ms)

    def _head(self) -> dict:
        if self.head.exists():
            return json.loads(self.head.get()[0])
        return {"n": 0, "waiting": 0, "blank": 0, "first": [], "order": [], "ids": False, "over": False, "error": None}

    def _keep(self, running: Running) -> None:
        self.head.update((json.dumps(running.head),))
        for key, raw in running.tops.items():
            self.tops.updateValue((key,), (raw,))
        for slot, names in running.names.items():
            held = self.names.getValue((slot,))
            self.names.updateValue((slot,), (json.dumps((json.loads(held[0]) if held else {}) | names),))
        if running.texts:
            self.texts.appendList([(key, "".join(parts)) for key, parts in running.texts.items()])
        if running.ids:
            self.ids.appendList([(",".join(running.ids),)])
        if running.arguments:
            self.arguments.appendList([(slot, "".join(parts)) for slot, parts in running.arguments.items()])

    def _emit(self, call: str, head: dict) -> pd.DataFrame:
        tops = {k[0]: v[0] for k, v in self.tops.iterator()}
        texts: dict[str, list[str]] = {}
        for key, text in self.texts.get():
            texts.setdefault(key, []).append(text)
        arguments: dict[int, list[str]] = {}
        for slot, text in self.arguments.get():
            arguments.setdefault(slot, []).append(text)
        names = {k[0]: json.loads(v[0]) for k, v in self.names.iterator()}
        tools = []
        for slot in sorted(names):
            own = names[slot]
            function = _object([("name", _compact(own.get("name"))), ("arguments", _compact("".join(arguments.get(slot, []))))])
            tools.append(_object([*((k, _compact(own[k])) for k in ("id", "type") if k in own), ("function", function)]))
        called = "[" + ",".join(tools) + "]" if tools else None
        role = head.get("role", "assistant")
        message = _object([("role", _compact(role)), *((k, _compact("".join(texts[k]))) for k in head["order"]), ("tool_calls", called)])
        ids = "[" + ",".join(t for (t,) in self.ids.get()) + "]" if head["ids"] else None
        choice = _object([("index", "0"), ("message", message), ("finish_reason", head.get("finish_reason", "null")), ("stop_reason", head.get("stop_reason")), ("token_ids", ids)])
        response = _object([
            ("id", tops.get("id")), ("object", '"chat.completion"'), ("created", tops.get("created")), ("model", tops.get("model")), ("choices", f"[{choice}]"),
            *((k, tops.get(k)) for k in ("usage", "system_fingerprint", "prompt_token_ids")),
        ])
        content = "".join(texts["content"]) if "content" in texts else None
        for state in (self.head, self.tops, self.names, self.texts, self.ids, self.arguments, self.pending):
            state.clear()
        self.done.update((True,))
        row = call, role, content, called, head.get("finish_reason"), tops.get("usage"), response, head["n"] + head["waiting"], head["error"]
        return pd.DataFrame([row], columns=ASSEMBLED.names)

    def close(self) -> None:
        pass


def assemble_stream(
    chunks: DataFrame, whitespace_limit: int | None = 100, timeout_ms: int = 3_600_000, delay: str = "1 hour", until_end: bool = False
) -> DataFrame:
    """The live form of `assemble`: call_id, seq (from 0), chunk, at in; finished calls out, with the same columns.

    A call is whole when its finish reason and all before it have come, or, with `until_end`, when the chunk
    "[DONE]" has, for servers that say the usage after the reason. Time is the chunks' own: a call none of whose
    chunks is within the timeout of the watermark is given up, so what is held is bounded by the calls under way
    and those ended within the timeout.
    """
    return chunks.withWatermark("at", delay).groupBy("call_id").transformWithStateInPandas(
        statefulProcessor=AssembleCalls(whitespace_limit, timeout_ms, until_end),
        outputStructType=ASSEMBLED,
        outputMode="Append",
        timeMode="EventTime",
    )
