"""Leaves: the typed terminal values of a document, and documents as maps from path to leaf."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels

#: One terminal of a document as parsed. vtype: null boolean number string empty_object empty_array.
PARSED = T.StructType([T.StructField("vtype", T.StringType()), T.StructField("sval", T.StringType()), T.StructField("nval", T.DoubleType()), T.StructField("bval", T.BooleanType())])
PARSED_DOCUMENT = T.MapType(T.StringType(), PARSED)


def leaf(vtype: str | Column, sval: Column | None = None, nval: Column | None = None, bval: Column | None = None) -> Column:
    """A leaf with what comparing it needs, made once for each leaf rather than for each pair: its literal class and the numbers it denotes."""
    none = F.lit(None)
    kind = F.lit(vtype) if isinstance(vtype, str) else vtype
    s, n, b = (none if sval is None else sval).cast("string"), (none if nval is None else nval).cast("double"), (none if bval is None else bval).cast("boolean")
    made = lambda cls, nums: F.struct(kind.alias("vtype"), s.alias("sval"), n.alias("nval"), b.alias("bval"), cls.alias("cls"), nums.alias("nums"))
    nums = F.when(kind == "number", F.array(n))
    if sval is None:
        return made(F.when(kind == "number", "number"), nums)
    cls = F.when(kind == "number", "number").when(kind == "string", kernels.literal_class(s))
    return kernels.bound(cls, lambda c: made(c, nums.when(kind == "string", kernels.numeric_values(s, c))))


def enriched(doc: Column) -> Column:
    """A parsed document with full leaves."""
    return F.transform_values(doc, lambda _, x: leaf(x["vtype"], x["sval"], x["nval"], x["bval"]))


def text_leaf(value: Column) -> Column:
    """A string, or JSON null where the value is null."""
    return leaf(F.when(value.isNull(), "null").otherwise("string"), sval=value)


def number_leaf(value: Column) -> Column:
    return leaf(F.when(value.isNull(), "null").otherwise("number"), nval=value)


def boolean_leaf(value: Column) -> Column:
    return leaf(F.when(value.isNull(), "null").otherwise("boolean"), bval=value)


def document(fields: dict[str, Column]) -> Column:
    """A document from leaves by top-level key; a null leaf is an absent key."""
    # The entries are never null, so Spark knows that the document is not, and does not make it only to look.
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in fields.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def shown(x: Column) -> Column:
    """A leaf's value as text, as differences and value counts show it."""
    number = F.when(x["nval"] == F.floor(x["nval"]), x["nval"].cast("decimal(38,0)").cast("string")).otherwise(x["nval"].cast("string"))
    return F.when(x["vtype"] == "string", x["sval"]).when(x["vtype"] == "number", number).when(x["vtype"] == "boolean", x["bval"].cast("string")).when(x["vtype"] == "null", "null").when(x["vtype"] == "empty_object", "{}").when(x["vtype"] == "empty_array", "[]")


def canonical(doc: Column) -> Column:
    """Equal for equal documents whatever the order of keys."""
    entries = F.transform(F.map_entries(doc), lambda e: F.struct(e["key"].alias("key"), e["value"]["vtype"].alias("vtype"), e["value"]["sval"].alias("sval"), e["value"]["nval"].alias("nval"), e["value"]["bval"].alias("bval")))
    return F.to_json(F.sort_array(entries))
