"""Tool calls out of chat markup, provider replies and message histories; result files of benchmark folders; reports written out."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shipping import shipped_udf

CALLS = "array<struct<name: string, args: string>>"
#: How many responses of a sample count, and how a folder's name gives a temperature.
MOST_RESPONSES, TEMPERATURE = 10, r"temp_(\d+)_(\d+)"


def _none() -> Column:
    return F.expr(f"cast(array() as {CALLS})")


def _json_or(text: Column, other: Column) -> Column:
    v = F.try_parse_json(text)
    return F.when(v.isNull(), other).otherwise(F.to_json(v))


def blocks(text: Column, tag: str) -> Column:
    """The contents of <tag>…</tag>, trimmed, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?s)<{tag}>\s*(.*?)\s*</{tag}>"), F.lit(1))


def _literal(text: str | None) -> str | None:
    try:
        return json.dumps(ast.literal_eval(text.strip()))
    except (ValueError, SyntaxError, TypeError, AttributeError, MemoryError, RecursionError):
        try:
            return json.dumps(json.loads(text.strip().replace("'", '"')))
        except (ValueError, AttributeError, RecursionError):
            return None


@shipped_udf(T.ArrayType(T.StringType()))
def _as_json(texts: pd.Series) -> pd.Series:
    return texts.map(lambda xs: None if xs is None else [_literal(x) for x in xs])


def marked_calls(df: DataFrame, text: str, name: str = "calls") -> DataFrame:
    """df with the tool calls of a message: JSON blocks are read as expressions; only rows with other blocks (Python literals) go to Python. Blocks that
    cannot be read are left out, argument texts are read if they are JSON."""
    raw = df.withColumn("__raw", blocks(F.col(text), "tool_call"))
    odd = F.filter("__raw", lambda b: F.try_parse_json(b).isNull())
    read = raw.withColumn("__odd", odd).withColumn("__fixed", _as_json("__odd"))
    both = F.transform("__raw", lambda b: F.coalesce(F.try_parse_json(b), F.try_parse_json(F.get("__fixed", F.array_position("__odd", b).cast("int") - 1))))
    found = F.filter(F.transform(both, lambda v: F.struct(F.try_variant_get(v, "$.name", "string").alias("name"), _json_or(F.try_variant_get(v, "$.arguments", "string"), F.try_variant_get(v, "$.arguments", "string")).alias("args"))), lambda c: c["name"].isNotNull())
    return read.withColumn(name, found).drop("__raw", "__odd", "__fixed")


def call_turns(messages: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """conversation, turn, calls, responses: every assistant message with calls, and the responses in a user's message right after it."""
    own = marked_calls(messages.select(conversation, turn, role, text), text)
    w = Window.partitionBy(conversation).orderBy(turn)
    after = F.when(F.lead(role).over(w) == "user", blocks(F.lead(text).over(w), "tool_response"))
    each = own.withColumn("responses", F.coalesce(after, F.expr("cast(array() as array<string>)")))
    return each.where((F.col(role) == "assistant") & (F.size("calls") > 0)).select(conversation, turn, "calls", "responses")


def provider_calls(reply: Column) -> Column:
    """The calls of a provider's reply as JSON text, whether as parts of its content or as its first choice's calls; unreadable arguments are {}."""
    v = F.try_parse_json(reply)
    parts = F.coalesce(F.try_variant_get(v, "$.output.message.content", "array<variant>"), F.try_variant_get(v, "$.content", "array<variant>"))
    used = F.filter(parts, lambda p: F.try_variant_get(p, "$.toolUse.name", "string").isNotNull())
    first = F.transform(used, lambda p: F.struct(F.try_variant_get(p, "$.toolUse.name", "string").alias("name"), F.coalesce(F.try_variant_get(p, "$.toolUse.input", "string"), F.lit("{}")).alias("args")))
    made = F.try_variant_get(v, "$.choices[0].message.tool_calls", "array<variant>")
    second = F.transform(made, lambda c: F.struct(F.try_variant_get(c, "$.function.name", "string").alias("name"), _json_or(F.try_variant_get(c, "$.function.arguments", "string"), F.lit("{}")).alias("args")))
    return F.coalesce(first, second, _none())


def history_calls(state: Column) -> Column:
    """The calls of a message history ({"messages": […]}), those of assistants' messages, in order; calls without a name are left out."""
    messages = F.try_variant_get(F.try_parse_json(state), "$.messages", "array<variant>")
    own = F.filter(messages, lambda m: F.coalesce(F.try_variant_get(m, "$.type", "string"), F.try_variant_get(m, "$.role", "string")).isin("ai", "assistant"))
    calls = F.flatten(F.transform(own, lambda m: F.coalesce(F.try_variant_get(m, "$.tool_calls", "array<variant>"), F.array().cast("array<variant>"))))
    each = F.transform(calls, lambda c: F.struct(F.try_variant_get(c, "$.name", "string").alias("name"), F.coalesce(F.try_variant_get(c, "$.args", "string"), F.lit("{}")).alias("args")))
    return F.coalesce(F.filter(each, lambda c: c["name"].isNotNull()), _none())


def temperature_of(path: Column) -> Column:
    whole, part = F.regexp_extract(path, TEMPERATURE, 1), F.regexp_extract(path, TEMPERATURE, 2)
    return F.when(whole != "", F.concat(whole, F.lit("."), part).cast("double"))


def read_benchmarks(spark: SparkSession, path: str, name: str = "all_results.json") -> DataFrame:
    """folder, temperature, sample (its place), ground_truth, responses (ten at most, as JSON text) of every result file under a path, at any depth. The
    temperature is the file's own or the path's. A file must fit in a task."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=name).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"))
    temperature = F.coalesce(F.try_variant_get("v", "$.metadata.temperature", "double"), temperature_of(F.col("file")))
    each = files.select(F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("folder"), temperature.alias("temperature"), F.posexplode(F.try_variant_get("v", "$.results", "array<variant>")).alias("sample", "r"))
    responses = F.coalesce(F.try_variant_get("r", "$.responses", "array<variant>"), F.try_variant_get("r", "$.generated_runs", "array<variant>"))
    return each.select("folder", "temperature", "sample", F.try_variant_get("r", "$.ground_truth", "string").alias("ground_truth"), F.transform(F.slice(responses, 1, MOST_RESPONSES), lambda x: x.cast("string")).alias("responses"))


def write_report(df: DataFrame, path: str, text: bool = False) -> None:
    """A table of results as JSON lines, or as lines of `name: value` pairs."""
    if not text:
        df.write.mode("overwrite").json(path)
        return
    line = F.concat_ws(", ", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null"))) for c in df.columns])
    df.select(line.alias("value")).write.mode("overwrite").text(path)
