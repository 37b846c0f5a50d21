"""JSON text to documents: parsing, validity, flattening to typed paths, reading of run files."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.leaves import PARSED_DOCUMENT, enriched, leaf
from ..functions.paths import printed
from ..functions.shipping import shipped_udf


def parse(text: str | None) -> tuple[bool, object]:
    """(readable, value); constants beyond JSON (NaN) are read, the last of repeated keys holds."""
    if text is None:
        return False, None
    try:
        return True, json.loads(text)
    except (ValueError, RecursionError):
        return False, None


def terminals(value: object, path: tuple = ()) -> Iterator[tuple[tuple, dict]]:
    """Every terminal with its path: scalars, and empty objects and arrays."""
    stack = [(path, value)]
    while stack:
        at, v = stack.pop()
        if isinstance(v, dict) and v:
            stack += [((*at, k), x) for k, x in reversed(v.items())]
        elif isinstance(v, list) and v:
            stack += [((*at, i), x) for i, x in reversed([*enumerate(v)])]
        else:
            kind = "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "empty_object" if isinstance(v, dict) else "empty_array"
            yield at, {"vtype": kind, "sval": v if kind == "string" else None, "nval": float(v) if kind == "number" else None, "bval": v if kind == "boolean" else None}


def document_of(value: object) -> dict[str, dict]:
    return {printed(p): leaf for p, leaf in terminals(value)}


def valid(value: object, strict: bool = True) -> bool:
    """Whether an output counts: numbers and booleans do, null and empty objects do not, a list does if any element does, and text does if what it
    parses to does, or, not strict, if it is not blank."""
    if value is None or value == {} and isinstance(value, dict):
        return False
    if isinstance(value, list):
        return any(valid(v, strict) for v in value)
    if isinstance(value, str):
        if not value.strip():
            return False
        ok, inner = parse(value)
        return valid(inner, strict) if ok and not isinstance(inner, str) else not strict
    return True


#: Texts whose documents a Python worker holds at a time. A document takes many times its text's size there.
PIECE = 256


def in_pieces(batch: pd.Series | pd.DataFrame) -> Iterator[pd.Series | pd.DataFrame]:
    """A batch of rows in pieces, so that what is made of them is sent off before more is made."""
    return (batch.iloc[i : i + PIECE] for i in range(0, len(batch), PIECE))


@shipped_udf(PARSED_DOCUMENT)
def _parsed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def one(t: str | None) -> dict | None:
        ok, value = parse(t)
        return document_of(value) if ok else None

    for text in batches:
        for piece in in_pieces(text):
            yield pd.Series([one(t) for t in piece], dtype=object)


def flatten_json(text: Column) -> Column:
    """A document from JSON text; null where it cannot be read."""
    return enriched(_parsed(text))


def prepared(text: Column) -> Column:
    """A document from an output's text: what its JSON says, or the text itself as the one value of a document where it is no JSON. Null stays null."""
    return F.when(text.isNotNull(), F.coalesce(flatten_json(text), F.create_map(F.lit("$"), leaf("string", sval=text))))


def responses(text: Column) -> Column:
    """Outputs in one shape, as JSON text: objects as they are, arrays of objects as {"responses": [...]}, arrays of JSON texts of objects likewise; null where
    there is no object at all. Elements that are no objects are left out."""
    v = F.try_parse_json(text)
    items = F.try_variant_get(v, "$", "array<variant>")
    read = F.filter(F.transform(items, lambda x: F.coalesce(F.when(F.schema_of_variant(x).startswith("OBJECT"), x), F.try_parse_json(F.try_variant_get(x, "$", "string")))), lambda x: F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False)))
    whole = F.schema_of_variant(v)
    return F.when(whole.startswith("OBJECT"), F.to_json(v)).when(whole.startswith("ARRAY") & (F.size(read) > 0), F.concat(F.lit('{"responses":['), F.array_join(F.transform(read, lambda x: F.to_json(x)), ","), F.lit("]}")))


def is_valid(text: Column, strict: bool = True) -> Column:
    """valid() of an output's text. Objects, numbers, booleans and texts are judged by expressions; only arrays, whose elements are judged in turn, and
    what Python reads beyond JSON (NaN, repeated keys) are sent to Python."""
    v = F.try_parse_json(text)
    kind = F.schema_of_variant(v)
    deep = kind.startswith("ARRAY") | (v.isNull() & text.rlike(r"^\s*([{\[]|-?(NaN|Infinity)\s*$)"))
    blank = F.trim(F.regexp_replace(text, r"\s+", " ")) == ""
    plain = F.when(text.isNull() | blank, False).when(v.isNull() | (kind == "STRING"), not strict).otherwise(~kind.isin("VOID", "OBJECT<>"))

    @shipped_udf("boolean")
    def checked(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else valid(t, strict))

    return F.coalesce(checked(F.when(deep, text)), plain)


def is_truthy(text: Column) -> Column:
    """Whether an output parses to anything but null, false, 0, and empty texts, objects and arrays."""
    shown = F.to_json(F.try_parse_json(text))
    return F.coalesce(~shown.isin("null", "false", '""', "{}", "[]") & ~shown.rlike(r"^-?0(\.0+)?([eE][-+]?[0-9]+)?$"), F.lit(False))


def flatten_flat_json(text: Column, keys: list[str]) -> Column:
    """Documents of flat objects with known keys without leaving the JVM: a fast path through VARIANT."""
    v = F.try_parse_json(text)
    kind = lambda k: F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))
    def entry(k: str) -> Column:
        s = F.try_variant_get(v, f"$.{k}", "string")
        made = F.when(kind(k) == "VOID", leaf("null")).when(kind(k) == "BOOLEAN", leaf("boolean", bval=F.try_variant_get(v, f"$.{k}", "boolean"))).when(kind(k) == "STRING", leaf("string", sval=s)).otherwise(leaf("number", nval=F.try_variant_get(v, f"$.{k}", "double")))
        return F.when(kind(k).isNotNull(), F.struct(F.lit(f"$.{k}").alias("key"), made.alias("value")))

    entries = F.filter(F.array(*map(entry, keys)), lambda e: e.isNotNull())
    return F.when(v.isNotNull(), F.map_from_entries(entries))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """A file of outputs or of {prompt, outputs}, as JSON lines, read in splits, or as one JSON array, which must fit in a task: prompt_id, run_id, raw.

    If every row is an object with outputs, rows are prompts, those of one prompt together, unnamed ones as "row i"; else every row is an output of the
    prompt "". Lines that cannot be read stay as text: invalid outputs. run_id rises with the place in the file and is unique.
    """
    text = F.ltrim("value")
    first = spark.read.text(path).where(text != "").select(F.startswith(text, F.lit("[")).alias("opens"), F.try_parse_json(text).isNotNull().alias("closes")).take(2)
    # An array that ends on its own line is an output if other lines follow; only another is read whole, which its format asks for.
    items = None
    if first and first[0]["opens"] and not (first[0]["closes"] and len(first) > 1):
        whole = spark.read.text(path, wholetext=True).select(F.ltrim("value").alias("value")).where(F.startswith("value", F.lit("[")))
        array = F.from_json("value", "array<variant>")
        items = whole.where(F.try_parse_json("value").isNotNull()).select(F.posexplode(array).alias("line", "v")).select(F.col("line").cast("long").alias("line"), F.to_json("v").alias("value"))
    if items is None or items.isEmpty():
        lines = spark.read.text(path).where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("at"), "value")
        # Numbers within partitions rise with the place in the file; how many rows each partition has makes them consecutive.
        part = F.shiftright("at", 33)
        sizes = lines.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
        items = lines.withColumn("part", part).join(F.broadcast(sizes.select("part", before.alias("before"))), "part").select((F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("line"), "value")
    group = F.from_json("value", "prompt string, outputs array<string>")
    rows = items.select("line", "value", group.alias("g"))
    if rows.where(F.col("g.outputs").isNull()).isEmpty():
        name = F.coalesce("g.prompt", F.concat(F.lit("row "), "line"))
        return rows.select(name.alias("prompt_id"), "line", F.posexplode("g.outputs").alias("pos", "raw")).select("prompt_id", (F.shiftleft("line", 24) + F.col("pos")).alias("run_id"), "raw")
    return rows.select(F.lit("").alias("prompt_id"), F.shiftleft("line", 24).alias("run_id"), F.col("value").alias("raw"))
