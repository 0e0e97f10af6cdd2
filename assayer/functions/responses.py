"""Model responses: tool calls, names, answers and token fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import jsontext


def message_path(rest: str) -> str:
    return f"$.choices[0].message{rest}"


def string_at(v: Column, path: str) -> Column:
    """A member that is a string; anything else is null rather than converted."""
    found = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", found.try_cast("string"))


def tool_calls(response: Column) -> Column:
    """The well-formed tool calls of a response: array<struct<id,name,arguments>>."""
    calls = F.try_variant_get(response, message_path(".tool_calls"), "array<variant>")
    read = F.transform(
        F.coalesce(calls, F.array().cast("array<variant>")),
        lambda c: F.struct(
            string_at(c, "$.id").alias("id"),
            string_at(c, "$.function.name").alias("name"),
            string_at(c, "$.function.arguments").alias("arguments"),
        ),
    )
    return F.filter(
        read, lambda c: c["id"].isNotNull() & c["name"].isNotNull() & c["arguments"].isNotNull()
    )


def returned_model(response: Column) -> Column:
    return string_at(response, "$.model")


def system_fingerprint(response: Column) -> Column:
    return string_at(response, "$.system_fingerprint")


def answer(response: Column, contract: Column, answer_tool: Column) -> Column:
    """The answer (VARIANT) by the request's contract: a native answer is the content read as JSON,
    a tool's is its arguments, a text's the content itself. Null where there is none."""
    content = string_at(response, message_path(".content"))
    called = F.get(F.filter(tool_calls(response), lambda c: c["name"] == answer_tool), F.lit(0))
    return (
        F.when(contract == "native", F.try_parse_json(content))
        .when(contract == "tool", F.try_parse_json(called["arguments"]))
        .when(contract == "text", F.parse_json(jsontext.quoted(content)))
    )


def answer_text(response: Column, contract: Column, answer_tool: Column) -> Column:
    """The answer as it is written, where it is JSON: a native answer's content, a tool's arguments."""
    called = F.get(F.filter(tool_calls(response), lambda c: c["name"] == answer_tool), F.lit(0))
    return F.when(contract == "native", string_at(response, message_path(".content"))).when(contract == "tool", called["arguments"])


def token_fingerprint(response_text: Column) -> Column:
    """The fingerprint of a response's prompt token ids, from its text; null where there is no list."""
    ids = F.get_json_object(response_text, "$.prompt_token_ids")
    return F.when(ids.startswith("["), F.sha2(ids, 256))


def without_tokens(response: Column) -> Column:
    """The response without its prompt token ids, which encode the case."""
    members = response.try_cast("map<string,variant>")
    kept = F.map_filter(members, lambda k, _: k != "prompt_token_ids")
    return F.to_json(kept)


def request_fingerprint(body: Column) -> Column:
    """A request body's fingerprint: its top-level keys sorted, what they hold left in order."""
    return F.sha2(jsontext.sorted_top_level(body), 256)
