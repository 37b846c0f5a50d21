"""Tool schemas: what their parameters are, how risky they make a prompt, which factors say so; schemas inferred from documents. Schemas come as documents
(flattened JSON), so all is expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import bound
from ..functions.leaves import shown
from ..functions.positions import key_of, nodes, prefixes, steps
from .risk import THRESHOLDS, complexity, description_score

_KEY = r'(?:\.[A-Za-z_][A-Za-z0-9_-]*|\["(?:[^"\\]|\\.)*"\])'
PARAMETER = rf"^\$(?:\.properties{_KEY}(?:\.items)?)*\.properties{_KEY}$"


def _kind(doc: Column, path: Column) -> Column:
    return F.try_element_at(doc, F.concat(path, F.lit(".type")))["sval"]


def parameters(schema: Column) -> Column:
    """The paths of all parameters: properties, and those of properties that are objects or arrays of objects."""

    def open_to(q: Column, path: Column) -> Column:
        items = F.concat(q, F.lit(".items"))
        within = path.startswith(F.concat(items, F.lit(".")))
        return F.when(within, (_kind(schema, q) == "array") & (_kind(schema, items) == "object")).otherwise(_kind(schema, q) == "object")

    def kept(own: Column) -> Column:
        above = lambda p: F.filter(prefixes(p), lambda q: F.array_contains(own, q) & (q != p))
        return F.filter(own, lambda p: F.forall(above(p), lambda q: F.coalesce(open_to(q, p), F.lit(False))))

    # Every step on the way to a node is a node, so what is a parameter above one is among them.
    return bound(F.filter(nodes(schema), lambda p: p.rlike(PARAMETER)), kept)


def schema_metrics(schema: Column) -> Column:
    """depth, params, optional, types, string_params, free_strings (strings without an enum), described (sum of description scores), top (own parameters)."""
    level = lambda p: F.size(F.filter(prefixes(p), lambda q: q.rlike(PARAMETER)))
    each = F.transform(parameters(schema), lambda p: F.struct(p.alias("path"), level(p).alias("level"), _kind(schema, p).alias("kind")))
    return bound(each, lambda found: bound(F.filter(found, lambda p: p["level"] == 1), lambda top: _measured(schema, found, top)))


def _measured(schema: Column, found: Column, top: Column) -> Column:
    deep = F.transform(found, lambda p: p["level"] - 1 + F.coalesce(p["kind"].isin("object", "array"), F.lit(False)).cast("int"))
    required = F.transform(F.filter(F.map_entries(schema), lambda e: e["key"].rlike(r"^\$\.required\[[0-9]+\]$")), lambda e: e["value"]["sval"])
    named = lambda r: F.size(F.filter(top, lambda p: ~F.array_contains(r, key_of(F.element_at(steps(p["path"]), -1)))))
    kinds = F.array_distinct(F.transform(top, lambda p: F.coalesce(p["kind"], F.lit("unknown"))))
    strings = F.filter(top, lambda p: p["kind"] == "string")
    free = lambda own: F.size(F.filter(own, lambda p: ~F.exists(F.map_keys(schema), lambda k: (k == F.concat(p["path"], F.lit(".enum"))) | k.startswith(F.concat(p["path"], F.lit(".enum["))))))
    described = F.aggregate(top, F.lit(0.0), lambda s, p: s + description_score(F.try_element_at(schema, F.concat(p["path"], F.lit(".description")))["sval"]))
    values = {"depth": F.coalesce(F.array_max(deep), F.lit(0)), "params": F.size(found), "optional": bound(required, named), "types": F.size(kinds), "string_params": F.size(strings), "free_strings": free(strings), "top": F.size(top)}
    return F.struct(*[v.cast("long").alias(k) for k, v in values.items()], described.alias("described"))


def prompt_metrics(tools: DataFrame, by: str, schema: str) -> DataFrame:
    """Of each prompt's tools: num_tools, total_params, total_optional, schema_depth, types, schema_complexity, optional_param_ratio, enum_gap,
    description_quality. Types are counted for the tool that has most."""
    m = tools.select(by, schema_metrics(F.col(schema)).alias("m"))
    s = lambda c: F.sum(f"m.{c}")
    g = m.groupBy(by).agg(F.count("*").alias("num_tools"), s("params").alias("total_params"), s("optional").alias("total_optional"), F.max("m.depth").alias("schema_depth"), F.max("m.types").alias("types"), s("string_params").alias("string_params"), s("free_strings").alias("free"), s("top").alias("top"), s("described").alias("described"))
    share = lambda a, b, none=0.0: F.coalesce(F.try_divide(a, b), F.lit(none))
    out = g.withColumn("schema_complexity", complexity(F.col("schema_depth"), F.col("total_params"), F.col("types")))
    out = out.withColumn("optional_param_ratio", share("total_optional", "top")).withColumn("enum_gap", share("free", "string_params")).withColumn("description_quality", share("described", "top", 1.0))
    return out.drop("free", "described", "top")


#: What a factor of risk asks for. The names are fixed values.
ADVICE = {
    "total_params": ("high_total_params", "moderate_total_params", "split the tool or drop parameters"),
    "schema_complexity": ("high_schema_complexity", "moderate_schema_complexity", "make the schema simpler"),
    "schema_depth": ("deep_nesting", "moderate_nesting", "use fewer levels"),
    "optional_param_ratio": ("many_optional_params", "some_optional_params", "make parameters required or give defaults"),
    "num_tools": ("many_tools", "moderate_tool_count", "offer only the tools a prompt needs"),
    "tool_name_ambiguity": ("ambiguous_tool_names", "moderate_name_ambiguity", "give tools names that share no words"),
    "query_length": ("long_prompt", "moderate_prompt_length", "shorten the prompt"),
    "param_type_diversity": ("high_type_diversity", "moderate_type_diversity", "use fewer types"),
    "enum_gap": ("low_enum_coverage", "moderate_enum_coverage", "list the values of string parameters"),
    "description_quality": ("poor_descriptions", "sparse_descriptions", "describe each parameter"),
}
#: Metrics whose factors are of one level less, and the least of another metric that lets a factor (high, medium) count.
MILD = ("query_length", "param_type_diversity", "enum_gap", "description_quality")
NEEDS = {"optional_param_ratio": ("total_optional", 3, 2), "enum_gap": ("string_params", 2, 2), "description_quality": ("total_params", 2, 2)}


def risk_factors(metrics: dict[str, Column]) -> Column:
    """Array of (name, severity, advice) of the metrics given, in order of ADVICE; description quality counts the other way round. vague_terms and
    constraints with words add theirs."""
    found = []
    for name, (high, medium, advice) in ADVICE.items():
        if name not in metrics:
            continue
        at_medium, at_high = THRESHOLDS[name]
        reach = (lambda c, t: c <= t) if name == "description_quality" else (lambda c, t: c >= t)
        other, h, m = NEEDS.get(name, (None, 0, 0))
        enough = (lambda k, o=other: metrics[o] >= k) if other else (lambda k: F.lit(True))
        mark = lambda n, s, a=advice: F.struct(F.lit(n).alias("name"), F.lit(s).alias("severity"), F.lit(a).alias("advice"))
        levels = ("medium", "low") if name in MILD else ("high", "medium")
        found.append(F.when(reach(metrics[name], at_high) & enough(h), mark(high, levels[0])).when(reach(metrics[name], at_medium) & enough(m), mark(medium, levels[1])))
    mark = lambda n, s, a: F.struct(F.lit(n).alias("name"), F.lit(s).alias("severity"), F.lit(a).alias("advice"))
    if "vague_terms" in metrics:
        vague = "say what is meant in figures or names"
        found.append(F.when(metrics["vague_terms"] >= 3, mark("vague_language", "medium", vague)).when(metrics["vague_terms"] >= 1, mark("minor_vagueness", "low", vague)))
    if "constraints" in metrics:
        found.append(F.when((metrics["constraints"] == 0) & (metrics["words"] > 20), mark("no_explicit_constraints", "low", "state what must hold of the output")))
    return F.filter(F.array(*found), lambda f: f.isNotNull())


def inferred_schema(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """path, types, n (documents that have it), required (all of them): a schema by leaf path over documents, indices written [*]. One aggregate; booleans
    are booleans."""
    n = docs.agg(F.count("*").alias("total"))
    entries = F.array_distinct(F.transform(F.map_entries(doc), lambda e: F.struct(F.regexp_replace(e["key"], r"\[[0-9]+\]", "[*]").alias("path"), e["value"]["vtype"].alias("vtype"))))
    each = docs.select(F.monotonically_increasing_id().alias("__d"), F.inline(entries))
    g = each.groupBy("path").agg(F.sort_array(F.collect_set("vtype")).alias("types"), F.count_distinct("__d").alias("n"))
    return g.crossJoin(n).select("path", "types", "n", (F.col("n") == F.col("total")).alias("required"))


def enum_values(docs: DataFrame, path: str, doc: str = "doc", most: int = 20) -> DataFrame:
    """The values of a path with their counts, if they are at most so many; else no rows. A candidate list of an enum."""
    v = docs.select(shown(F.try_element_at(F.col(doc), F.lit(path))).alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    kinds = v.agg(F.count("*").alias("k"))
    return v.crossJoin(kinds).where(F.col("k") <= most).drop("k")
