"""Rendering requests: grids of configurations, messages, translations, bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsontext, responses, tape
from .findings import message


def object_of(pairs: list[tuple[str, Column | None]]) -> Column:
    """Compact JSON from (name, JSON text) in order; null values are left out."""
    members = F.array_compact(
        F.array(*[F.concat(F.lit(f'"{name}":'), value) for name, value in pairs if value is not None])
    )
    return F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))


def fill(segments: Column, fills: Column) -> Column:
    """Text from segments (array<struct<text,slot>>) with the slots' fills (map) in their place."""
    return F.array_join(
        F.transform(segments, lambda s: F.coalesce(s["text"], F.element_at(fills, s["slot"]))), ""
    )


def unfilled(messages: Column, fills: Column) -> Column:
    """The slots of messages that have no fill, by name."""
    slots = F.flatten(F.transform(messages, lambda m: F.transform(F.filter(m["segments"], lambda s: s["text"].isNull()), lambda s: s["slot"])))
    return F.sort_array(F.array_distinct(F.filter(slots, lambda s: F.try_element_at(fills, s).isNull())))


def render(rows: DataFrame) -> DataFrame:
    """The request body of every row, and `problem` instead where a slot has no fill.

    Rows have `messages` (array<struct<role,segments>>), `fills`, `model`, `body` (map of name to
    JSON text), `greedy`, `seed` and `return_token_ids`. The skeleton's own settings come after
    model and messages, and a seed is only sent where it does something.
    """
    messages = F.transform(
        "messages",
        lambda m: F.concat(
            F.lit('{"role":'), jsontext.quoted(m["role"]),
            F.lit(',"content":'), jsontext.quoted(fill(m["segments"], F.col("fills"))), F.lit("}"),
        ),
    )
    settings = F.transform(
        F.map_entries("body"), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])
    )
    members = F.concat(
        F.array(
            F.concat(F.lit('"model":'), jsontext.quoted(F.col("model"))),
            F.concat(F.lit('"messages":['), F.array_join(messages, ","), F.lit("]")),
        ),
        settings,
        F.array_compact(
            F.array(
                F.when(F.col("seed").isNotNull() & ~F.col("greedy"), F.concat(F.lit('"seed":'), F.col("seed").cast("string"))),
                F.when(F.col("return_token_ids"), F.lit('"return_token_ids":true')),
            )
        ),
    )
    keep = [c for c in rows.columns if c not in ("messages", "fills", "body")]
    lacking = unfilled(F.col("messages"), F.col("fills"))
    problem = F.when(F.size(lacking) > 0, F.concat(F.lit("no fill for "), F.array_join(lacking, ", ")))
    body = F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))
    return rows.select(*keep, F.when(problem.isNull(), body).alias("request"), problem.alias("problem"))


# Settings greedy sampling leaves out.
GREEDY_DROPS = ["top_p", "top_k", "min_p"]


def greedy_sampling(rows: DataFrame) -> DataFrame:
    """With temperature 0, what only shapes random draws is no setting."""
    greedy = F.coalesce(F.col("temperature") == 0, F.lit(False))
    return rows.withColumns({c: F.when(~greedy, F.col(c)) for c in GREEDY_DROPS if c in rows.columns})


def assemble_messages(recipes: DataFrame, shots: DataFrame) -> DataFrame:
    """Each recipe's messages in order: system, few-shot, user.

    Guidance goes where its insert is, in the instructions or the prompt, or else after the
    instructions, each after a blank line, output before tools. A guidance inserted in both is
    refused. `recipes`: recipe, instructions, role, prompt, output_guidance, tool_guidance,
    with inserts written `{output_guidance}`; `shots`: recipe, position, role, content. Messages
    come out as rows, so a recipe with very many shots is no single value.
    """
    names = ["output_guidance", "tool_guidance"]
    slot = lambda n: F.lit("{" + n + "}")
    guide = lambda n: F.coalesce(F.col(n), F.lit(""))

    def filled(text: Column) -> Column:
        for n in names:
            text = F.replace(text, slot(n), guide(n))
        return text

    system = F.coalesce(filled(F.col("instructions")), F.lit(""))
    doubled = F.lit(False)
    for n in names:
        in_prompt = F.contains(F.col("prompt"), slot(n))
        in_instructions = F.coalesce(F.contains(F.col("instructions"), slot(n)), F.lit(False))
        doubled = doubled | (in_prompt & in_instructions)
        appended = F.when(system == "", guide(n)).otherwise(F.concat(system, F.lit("\n\n"), guide(n)))
        system = F.when((guide(n) != "") & ~in_prompt & ~in_instructions, appended).otherwise(system)
    checked = recipes.withColumn("doubled", doubled)
    role = F.when(F.col("instructions").isNotNull(), F.col("role")).otherwise(F.lit("system"))
    ends = F.array_compact(
        F.array(
            F.when(system != "", F.struct(F.lit(-1).cast("bigint").alias("position"), role.alias("role"), system.alias("content"))),
            F.struct(F.lit(2**31).cast("bigint").alias("position"), F.lit("user").alias("role"), filled(F.col("prompt")).alias("content")),
        )
    )
    own = checked.where("NOT doubled").select("recipe", F.inline(ends))
    few = shots.join(checked.where("NOT doubled").select("recipe"), "recipe", "left_semi")
    refused = checked.where("doubled").select(
        "recipe", F.lit(None).cast("bigint").alias("position"), F.lit("error").alias("role"),
        F.lit("guidance is inserted in both the instructions and the prompt").alias("content"),
    )
    return own.unionByName(few.select("recipe", F.col("position").cast("bigint"), "role", "content")).unionByName(refused)


def translated(texts: DataFrame, translations: DataFrame) -> DataFrame:
    """Recipes' texts (recipe, part, text) in their translation (translations, text, translation).

    A recipe without translations (null) keeps its texts; a text without one is marked missing.
    """
    joined = texts.join(translations, ["translations", "text"], "left")
    keeps = F.col("translations").isNull() | (F.trim("text") == "")
    return joined.select(
        "recipe", "part", "text",
        F.when(keeps, F.col("text")).otherwise(F.col("translation")).alias("translated"),
        (~keeps & F.col("translation").isNull()).alias("missing"),
    )


def missing_translations(texts: DataFrame, translations: DataFrame) -> DataFrame:
    """What recipes' translations lack, each text once per recipe; whitespace isn't translated."""
    wanted = texts.where(F.col("translations").isNotNull() & (F.trim("text") != "")).select("recipe", "translations", "text").distinct()
    return wanted.join(translations.select("translations", "text"), ["translations", "text"], "left_anti").select("recipe", "text")


def next_requests(rounds: DataFrame, results: DataFrame) -> DataFrame:
    """The request after a tool round: the same body with the assistant's message and one tool
    message per call, in the calls' order.

    `rounds`: item, head (the body up to its messages, open), messages (JSON texts), tail, response
    (JSON text); `results`: item, id, result. A response makes few calls; each is joined to its
    result by id and put back in order. A call without a result makes the round an error.
    """
    # Dealt out by item first, as its calls and the join need it, so that responses are read after that, once.
    rounds = rounds.repartition("item")
    parsed = rounds.select("item", F.try_parse_json("response").alias("response"))
    response = F.col("response")
    calls = parsed.select("item", F.posexplode(responses.tool_calls(response)).alias("pos", "call"))
    answered = (
        calls.select("item", "pos", F.col("call.id").alias("id"))
        .join(results, ["item", "id"], "left")
        .groupBy("item")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "pos",
                        F.concat(
                            F.lit('{"role":"tool","tool_call_id":'), jsontext.quoted(F.col("id")),
                            F.lit(',"content":'), jsontext.quoted(F.col("result")), F.lit("}"),
                        ).alias("text"),
                    )
                )
            ).alias("tools"),
            F.count_if(F.col("result").isNull()).alias("unresolved"),
        )
    )
    # As the model wrote them: the order of their members counts for the request's fingerprint.
    sent = lambda place: F.coalesce(F.get("_sent", F.lit(place)), F.lit("null"))
    assistant = F.concat(
        F.lit('{"role":"assistant","content":'), sent(0), F.lit(',"tool_calls":'), sent(1), F.lit("}")
    )
    tools = F.transform(F.coalesce("tools", F.array().cast("array<struct<pos:int,text:string>>")), lambda t: t["text"])
    body = F.concat(
        "head", F.lit('"messages":['),
        F.array_join(F.concat("messages", F.array(assistant), tools), ","), F.lit("]"), "tail",
    )
    unresolved = F.coalesce("unresolved", F.lit(0))
    read = tape.members(F.col("response"), responses.message_path(""), ["content", "tool_calls"])
    return rounds.join(answered, "item", "left").withColumn("_sent", read).select(
        "item",
        F.when(unresolved == 0, body).alias("request"),
        F.when(unresolved > 0, message("no result for ", unresolved, " tool calls")).alias("problem"),
    )


def config_grid(recipes: DataFrame, models: DataFrame, parts: DataFrame) -> DataFrame:
    """Which recipe goes with which served model, and why the others are skipped.

    `recipes`: recipe, part (a name, one row per part); `models`: model, served, known;
    `parts`: part, model (null for a part all models share), refused (a reason or null). A recipe
    whose parts are all shared has one variant; one with a part per model has a variant for each
    model that has all its parts.
    """
    own = parts.where("model IS NOT NULL").select("part").distinct()
    # What a recipe needs per model: a handful of named parts, whatever the number of models.
    needs = recipes.join(own, "part", "left_semi").groupBy("recipe").agg(F.collect_set("part").alias("needed"))
    variants = parts.where("model IS NOT NULL").join(models.where("served AND known").select("model"), "model")
    per_model = (
        recipes.join(variants.select("part", "model", "refused"), "part")
        .groupBy("recipe", "model")
        .agg(F.collect_set(F.when(F.col("refused").isNull(), F.col("part"))).alias("had"))
        .join(needs, "recipe")
        .withColumn("missing", F.array_join(F.sort_array(F.array_except("needed", "had")), ", "))
        .select("recipe", "model", F.when(F.col("missing") != "", message("the facts refuse its ", F.col("missing"))).alias("skipped"))
    )
    shared = (
        recipes.select("recipe").distinct()
        .join(recipes.join(own, "part", "left_semi").select("recipe"), "recipe", "left_anti")
        .select("recipe", F.lit(None).cast("string").alias("model"), F.lit(None).cast("string").alias("skipped"))
    )
    unmatched = models.where("served <> known").select(
        F.lit(None).cast("string").alias("recipe"),
        "model",
        F.when(F.col("served"), "the facts don't know it").otherwise("no planned engine serves it").alias("skipped"),
    )
    return per_model.unionByName(shared).unionByName(unmatched)
