"""Trajectories of tool calls from trace records and session transcripts: JSON lines to ordered steps. All is VARIANT expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import fenced

#: Where records keep what a step needs; the first key that is set counts.
NAMES = ("event.name", "event_name", "name")
TOOLS = ("tool_name", "gen_ai.tool.name", "tool.name")
INPUTS = ("tool_input", "gen_ai.tool.call.arguments", "tool_parameters")
PROMPTS, SESSIONS = ("prompt.id", "session.id", "trace_id", "trace.id"), ("session.id", "prompt.id", "trace_id", "trace.id")
EVENTS = ("claude_code.tool_result", "tool_result", "gen_ai.tool.message")
SEQUENCE = ("event.sequence", "timestamp", "event.timestamp")
ANY_VALUE = ("stringValue", "intValue", "boolValue", "doubleValue", "arrayValue", "kvlistValue")


def _member(value: Column, key: str) -> Column:
    """An object's member, null where it is absent or JSON null."""
    v = F.try_variant_get(value, f"$['{key}']", "variant")
    return F.when(~F.is_variant_null(v), v)


def _typed(value: Column) -> Column:
    """What a typed value holds, or the value itself."""
    return F.coalesce(*[_member(value, k) for k in ANY_VALUE], value)


def _parts(record: Column) -> dict[str, Column]:
    """What attribute() looks into: to be made once for a record, not once for each key."""
    pairs = F.try_variant_get(record, "$.attributes", "array<struct<key: string, value: variant>>")
    return {"attributes": F.try_variant_get(record, "$.attributes", "variant"), "pairs": pairs, "body": F.try_variant_get(record, "$.body", "variant"), "own": record}


def attribute(record: Column | dict[str, Column], key: str) -> Column:
    """A record's attribute: from attributes (an object, or pairs of key and typed value, the last of a key), else its body, else the record itself."""
    x = record if isinstance(record, dict) else _parts(record)
    own = F.when(x["pairs"].isNotNull(), _typed(F.try_element_at(F.filter(x["pairs"], lambda p: p["key"] == key), F.lit(-1))["value"]))
    return F.coalesce(_member(x["attributes"], key), own, _member(x["body"], key), _member(x["own"], key))


def _first(record: Column | dict[str, Column], keys: tuple[str, ...]) -> Column:
    return F.coalesce(*[attribute(record, k) for k in keys])


def steps_of(lines: DataFrame, text: str) -> DataFrame:
    """prompt, session, order_text, order_number, name, args, success, duration_ms, result_size_bytes of every line that records a step: a tool result by
    its event's name, or any record with a tool and its input. Values are as text, arguments as JSON text; lines that cannot be read are left out."""
    each = fenced(lines.select(F.try_parse_json(text).alias("r"))).where("r is not null")
    each = fenced(each.select(*[x.alias(name) for name, x in _parts(F.col("r")).items()]))
    parts = {name: F.col(name) for name in each.columns}
    found = {"event": NAMES, "tool": TOOLS, "given": INPUTS, "prompt": PROMPTS, "session": SESSIONS, "place": SEQUENCE, "success": ("success",), "duration_ms": ("duration_ms",), "result_size_bytes": ("tool_result_size_bytes",)}
    own = fenced(each.select(*[_first(parts, keys).alias(name) for name, keys in found.items()]))
    own = own.where(F.col("tool").isNotNull() & (F.col("event").cast("string").isin(*EVENTS) | F.col("given").isNotNull()))
    inner = F.when(F.schema_of_variant("given") == "STRING", F.try_parse_json(F.col("given").cast("string")))
    args = F.when(inner.isNull(), F.col("given").cast("string")).otherwise(inner.cast("string"))
    number = F.when(F.schema_of_variant("place").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.col("place").cast("double"))
    texts = [F.col(c).cast("string").alias(c) for c in ("prompt", "session", "success", "duration_ms", "result_size_bytes")]
    return own.select(*texts, F.col("place").cast("string").alias("order_text"), number.alias("order_number"), F.col("tool").cast("string").alias("name"), args.alias("args"))


def trajectories(lines: DataFrame, text: str = "value", by: str = "prompt") -> DataFrame:
    """group_id, steps (array of name, args, success, duration_ms, result_size_bytes) in order of sequence, from lines of records; by prompt, session or single.

    Blank and unreadable lines and records of no tool are left out; steps without a group gather as "ungrouped". A group's steps meet in one task.
    """
    own = steps_of(lines, text)
    group = F.lit("all") if by == "single" else F.coalesce(by, F.lit("ungrouped"))
    order = F.struct("order_number", "order_text", F.struct("name", "args", "success", "duration_ms", "result_size_bytes").alias("step"))
    gathered = own.groupBy(group.alias("group_id")).agg(F.sort_array(F.collect_list(order)).alias("ordered"))
    return gathered.select("group_id", F.transform("ordered", lambda x: x["step"]).alias("steps"))


def transcript_steps(text: Column) -> Column:
    """The tool calls of a transcript line, in order: array of name, args (JSON text); none unless it is an assistant's message."""
    shape = "type string, message struct<content: array<struct<type: string, name: string, input: string>>>"
    line = F.from_json(text, shape)
    calls = F.filter(line["message"]["content"], lambda c: c["type"] == "tool_use")
    steps = F.transform(calls, lambda c: F.struct(c["name"].alias("name"), c["input"].alias("args")))
    none = F.expr("cast(array() as array<struct<name: string, args: string>>)")
    return F.when(line["type"] == "assistant", F.coalesce(steps, none)).otherwise(none)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """file, steps of every transcript under a path; files without steps are left out."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), transcript_steps(F.col("value")).alias("steps")).where(F.size("steps") > 0)
    gathered = lines.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("block", "line", "steps"))).alias("all"))
    return gathered.select("file", F.flatten(F.transform("all", lambda x: x["steps"])).alias("steps"))
