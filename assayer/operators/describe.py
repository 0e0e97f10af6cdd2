"""One-line descriptions of components, by kind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import jsontext, text

# The sampling fields a description lists, in order.
SAMPLED = [
    "temperature", "top_p", "top_k", "min_p", "presence_penalty", "frequency_penalty",
    "repetition_penalty", "max_output_tokens",
]


def describe(kind: Column, doc: Column, digest: Column, json: Column, title=lambda ref: ref, language: Column | None = None) -> Column:
    """A component's description from its document (VARIANT, with its text as `json`).

    `title` turns a reference into the text shown for it; by default the reference itself.
    """
    get = lambda path: F.try_variant_get(doc, path, "string")
    array = lambda path: F.try_variant_get(doc, path, "array<variant>")
    n_of = lambda path: F.coalesce(F.size(array(path)), F.lit(0))
    keys = lambda path: F.array_join(F.json_object_keys(F.get_json_object(json, path)), ", ")

    def parts(path: str) -> Column:
        """Text as it is, or segments with their slots and inserts in braces."""
        segments = F.transform(
            array(path),
            lambda s: F.when(F.schema_of_variant(s) == "STRING", s.cast("string")).otherwise(
                F.concat(
                    F.lit("{"),
                    F.coalesce(F.try_variant_get(s, "$.slot", "string"), F.try_variant_get(s, "$.insert", "string")),
                    F.lit("}"),
                )
            ),
        )
        return F.coalesce(F.array_join(segments, ""), get(path))

    def value(path: str) -> Column:
        return jsontext.spaced(F.to_json(F.try_variant_get(doc, path, "variant")))

    def schema(path: str) -> Column:
        return F.coalesce(get(f"{path}.title"), F.nullif(keys(f"{path}.properties"), F.lit("")))

    sampled = F.array_join(
        F.array_compact(
            F.array(*[F.when(get(f"$.{k}").isNotNull(), F.concat(F.lit(f"{k} "), value(f"$.{k}"))) for k in SAMPLED])
        ),
        ", ",
    )
    kwargs = F.transform(
        F.coalesce(F.json_object_keys(F.get_json_object(json, "$.chat_template_kwargs")), F.array().cast("array<string>")),
        lambda k: F.concat(
            k, F.lit(" "),
            jsontext.spaced(F.to_json(F.element_at(F.try_variant_get(doc, "$.chat_template_kwargs", "map<string,variant>"), k))),
        ),
    )
    reasoning = F.array_join(
        F.concat(
            F.array_compact(F.array(F.concat(F.lit("effort "), get("$.effort")))),
            kwargs,
            F.array_compact(F.array(F.concat(F.lit("budget "), get("$.thinking_token_budget")))),
        ),
        ", ",
    )
    contract = F.when(get("$.contract.kind") == "tool", F.concat(F.lit("tool "), get("$.contract.name"))).otherwise(get("$.contract.kind"))
    refs = lambda path: F.array_join(F.transform(array(path), lambda r: title(r.cast("string"))), ", ")
    plural = lambda path, one, many=None: text.count_of(n_of(path), one, many)
    join = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    into = F.lit("") if language is None else F.coalesce(F.concat(language, F.lit(" ")), F.lit(""))
    vignette = join(get("$.vignette.source"), "/", get("$.vignette.id"))
    output_schema = schema("$.json_schema")
    cases = {
        "chunk.instructions": text.snippet(parts("$.text")),
        "chunk.few_shot": join("few-shot, ", plural("$.messages", "message")),
        "chunk.prompt": text.snippet(parts("$.segments")),
        "chunk.output": join(contract, " output", F.coalesce(join(": ", output_schema), F.lit(""))),
        "chunk.sampling": F.when(sampled == "", "default sampling").otherwise(sampled),
        "chunk.reasoning": F.when(reasoning == "", "default reasoning").otherwise(reasoning),
        "tool": get("$.name"),
        "chunk.toolset": join("with ", refs("$.tools")),
        "chunk.translations": join(
            into, "translations, ",
            text.count_of(F.coalesce(F.size(F.json_object_keys(F.get_json_object(json, "$.entries"))), F.lit(0)), "text"),
        ),
        "chunk.passthrough": join("passthrough: ", keys("$.body")),
        "skeleton": join(get("$.purpose"), " skeleton ", text.short(digest)),
        "trial": join(
            title(get("$.skeleton")), " on ", title(get("$.engine")), ", ", plural("$.cases", "case"), ", ", plural("$.seeds", "seed")
        ),
        "judge": join("judge ", title(get("$.skeleton")), " on ", title(get("$.engine"))),
        "scorer": join("scorer ", get("$.code.distribution"), " ", get("$.code.version")),
        "scoring": join(title(get("$.scorer")), " against ", plural("$.expectations", "expectation")),
        "appendix": text.snippet(get("$.text")),
        "expectation": join("expectation for ", title(get("$.case"))),
        "case": F.when(n_of("$.appendices") > 0, join(vignette, " with ", refs("$.appendices"))).otherwise(vignette),
        "model": get("$.repo"),
        "engine.local": join(
            title(get("$.model")), " on ", get("$.runtime.server"), " ", get("$.runtime.version"), " (", get("$.hardware.gpu"), ")"
        ),
        "engine.remote": join(get("$.model"), " at ", F.try_parse_url(get("$.base_url"), F.lit("HOST"))),
        "expectation_schema": F.coalesce(output_schema, join("expectation schema ", text.short(digest))),
        "canary_set": plural("$.canaries", "canary", "canaries"),
    }
    described = F.when(kind.isNull(), F.lit(None).cast("string"))
    for name, made in cases.items():
        described = described.when(kind == name, made)
    return described.otherwise(join(kind, " ", text.short(digest)))
