"""Scalar kernels: how alike two values at the same path are. All are expressions; none leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The forms of literal strings, tried in this order after code, and the words and marks of code and of prose.
# [0-9] and not \d throughout: DuckDB and Java differ in what the latter takes beyond ASCII.
NUMBER = r"^[-+]?([0-9][0-9,]*)?(\.[0-9]+)?([eE][-+]?[0-9]+)?$"
DATETIME = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[-+][0-9]{2}:?[0-9]{2})?)?|[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}|[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?)$"
NUMBER_LIST = r"^[-+]?[0-9]+(\.[0-9]+)?((\s*[,;/]\s*|\s+)[-+]?[0-9]+(\.[0-9]+)?)+$"
AMOUNT = r"^[$€£¥]?\s*[-+]?[0-9][0-9,]*(\.[0-9]+)?\s*(%|[A-Za-z]{1,3})?$"
IDENTIFIER = r"^[A-Za-z]{0,3}[-_#]?[0-9][0-9A-Za-z_.:-]*$"
WORD = r"[A-Za-z]{4,}"
CODE = r"(\blambda\s+\w*\s*:|\bdef\s+\w+\s*\(|\breturn\s+[\w(\[]|\bfunction\s*\w*\s*\(|=>|\w\*\*\w|==|!=|<=|>=|\+=|-=|::|^\s*(import|from)\s+\w|^\s*(SELECT|INSERT|UPDATE|DELETE)\b|[)\]}];\s*($|\n))"
CODE_LINE = r"(?i)(^\s*(import|from|def|class|return|lambda|if|elif|else|for|while|try|except|with)\b.*$|^\s*[\w.\[\]'\"]+\s*(=|\+=|-=|\*=|/=)\s*.+$|^\s*[\w.]+\(.*\)\s*;?\s*$|^.*[;{}]\s*$|^\s*(SELECT|INSERT|UPDATE|DELETE|FROM|WHERE)\b.*$)"
PROSE = r"[.!?]\s+[A-Z]|[.!?]$"
LONGEST_LITERAL, PROSE_WORDS, CODE_SHARE = 64, 8, 0.6
RELATIVE, AT_ZERO = 1e-9, 1e-12
MISS_SLOPE, MISS_CAP, CASE_ONLY, LONGEST_TOKEN = 10.0, 0.9, 0.95, 128
#: What a change between two types costs, in either direction; pairs not named cost 1.
TYPE_COST = {
    ("string", "number"): 0.1,
    ("boolean", "string"): 0.1,
    ("number", "boolean"): 0.1,
    ("null", "string"): 0.1,
    ("null", "number"): 0.1,
    ("object", "array"): 0.5,
    ("object", "string"): 0.5,
    ("object", "number"): 0.5,
    ("array", "string"): 0.5,
}


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value made once, however often body reads it. Spark shares no common parts inside lambdas and conditions, where kernels run."""
    return F.get(F.transform(F.array(value), body), 0)


def trimmed(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def looks_like_code(t: Column) -> Column:
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")
    return F.coalesce(F.try_divide(F.size(F.filter(lines, lambda x: x.rlike(CODE_LINE))), F.size(lines)) >= CODE_SHARE, F.lit(False))


def literal_class(s: Column) -> Column:
    """code, number, datetime, number_list, amount or identifier: what a consumer parses rather than reads; null for ordinary text."""

    def of(t: Column) -> Column:
        prose = (F.size(F.split(t, r"\s+")) >= PROSE_WORDS) & t.rlike(PROSE)
        text = (F.length(t) > LONGEST_LITERAL) | t.rlike(WORD)
        out = F.when(t == "", None).when(t.rlike(CODE) & ~(prose & ~looks_like_code(t)), "code").when(text, None)
        out = out.when(t.rlike(NUMBER) & t.rlike("[0-9]"), "number")
        for name, pattern in (("datetime", DATETIME), ("number_list", NUMBER_LIST), ("amount", AMOUNT), ("identifier", IDENTIFIER)):
            out = out.when(t.rlike(pattern), name)
        return out

    return bound(trimmed(s), of)


def numbers_close(a: Column, b: Column) -> Column:
    """Equal up to float noise: relative, and absolute only against an exact zero."""
    return F.when((a == 0) | (b == 0), F.abs(a - b) <= AT_ZERO).otherwise(F.abs(a - b) <= RELATIVE * F.greatest(F.abs(a), F.abs(b)))


def numbers_within(a: Column, b: Column, absolute: float, relative: float) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(float(absolute)), F.lit(float(relative)) * F.greatest(F.abs(a), F.abs(b)))


def numeric_value(s: Column) -> Column:
    """The number that a string denotes, or null."""
    return bound(F.replace(trimmed(s), F.lit(","), F.lit("")), lambda t: F.when(t.rlike(NUMBER) & t.rlike("[0-9]"), t.try_cast("double")))


def _list(t: Column) -> Column:
    parts = F.filter(F.split(trimmed(t), r"\s*[;/ ]\s*|\s*,\s*(?=[-+]?[0-9])"), lambda x: x != "")
    return F.transform(parts, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))


def numeric_values(s: Column, kind: Column | None = None) -> Column:
    """All numbers of a number, amount or number list, or null. kind: its literal class, where that is known."""
    if kind is None:
        return bound(literal_class(s), lambda k: numeric_values(s, k))
    amount = bound(_list(F.regexp_replace(s, r"[^0-9.,+\- ]", "")), lambda x: F.when(F.size(x) == 1, x))
    return F.when(kind == "number", F.array(numeric_value(s))).when(kind == "number_list", _list(s)).when(kind == "amount", amount)


def char_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance's share of the longer text, over code points; 1 only for equal texts."""
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))))


def literal_equal(a: Column, b: Column) -> Column:
    """Two literals by value: numbers as numbers, number lists element by element, others verbatim."""
    ca, cb = literal_class(a), literal_class(b)
    x, y = _list(a), _list(b)
    same = (F.size(x) == F.size(y)) & F.forall(F.zip_with(x, y, lambda p, q: F.struct(p.alias("p"), q.alias("q"))), lambda z: F.coalesce(numbers_close(z["p"], z["q"]), F.lit(False)))
    return F.when(ca.isNull() | cb.isNull(), a == b).when((ca == "number") & (cb == "number"), F.coalesce(numbers_close(numeric_value(a), numeric_value(b)), trimmed(a) == trimmed(b))).when((ca == "number_list") & (cb == "number_list"), same).otherwise(trimmed(a) == trimmed(b))


def near_miss(x: Column, y: Column) -> Column:
    """How near two unequal number lists are: the least over the elements, 0 from a tenth off, never as much as equality."""
    scale = lambda p, q: F.greatest(F.abs(p), F.abs(q))
    each = F.zip_with(x, y, lambda p, q: F.when(scale(p, q) == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - MISS_SLOPE * F.abs(p - q) / scale(p, q))))
    return F.when(x.isNull() | y.isNull() | (F.size(x) != F.size(y)) | (F.size(x) == 0), 0.0).otherwise(MISS_CAP * F.array_min(each))


def string_kernel(a: Column, b: Column, near: bool = False, literals: bool = True) -> Column:
    """Equal 1; with near, 0.95 if only case differs; two literals exactly (or by near miss); others by characters."""
    out = F.when(a == b, 1.0)
    if near:
        out = out.when(F.lower(a) == F.lower(b), CASE_ONLY)
    if literals:
        both = literal_class(a).isNotNull() & literal_class(b).isNotNull()
        exact = literal_equal(a, b).cast("double")
        if near:
            short = (F.length(a) <= LONGEST_TOKEN) & (F.length(b) <= LONGEST_TOKEN)
            exact = F.when(exact == 1, 1.0).when(short, near_miss(numeric_values(a), numeric_values(b))).otherwise(0.0)
        out = out.when(both, exact)
    return out.otherwise(char_similarity(a, b))


def python_text(x: Column) -> Column:
    """A leaf as the texts that cross-type comparison uses: True, None, 410.0."""
    number = F.when(x["nval"] == F.floor(x["nval"]), F.format_string("%.1f", x["nval"])).otherwise(x["nval"].cast("string"))
    return F.when(x["vtype"] == "string", x["sval"]).when(x["vtype"] == "number", number).when(x["vtype"] == "boolean", F.initcap(x["bval"].cast("string"))).when(x["vtype"] == "null", "None").otherwise("")


def type_cost(a: Column, b: Column) -> Column:
    short = lambda v: F.replace(v, F.lit("empty_"), F.lit(""))
    a, b = short(a), short(b)
    out = F.when(a == b, 0.0)
    for (x, y), cost in TYPE_COST.items():
        out = out.when(((a == x) & (b == y)) | ((a == y) & (b == x)), cost)
    return out.otherwise(1.0)


def _same_numbers(x: Column, y: Column, close) -> Column:
    return (F.size(x) == F.size(y)) & F.forall(F.zip_with(x, y, close), lambda ok: F.coalesce(ok, F.lit(False)))


def value_kernel(a: Column, b: Column, near: bool = False, literals: bool = True) -> Column:
    """string_kernel on two leaves, whose classes and numbers are known; leaves that are no strings count as their texts."""
    return bound(F.struct(python_text(a).alias("x"), python_text(b).alias("y")), lambda t: _texts_kernel(a, b, t["x"], t["y"], near, literals))


def _texts_kernel(a: Column, b: Column, x: Column, y: Column, near: bool, literals: bool) -> Column:
    out = F.when(x == y, 1.0)
    if near:
        out = out.when(F.lower(x) == F.lower(y), CASE_ONLY)
    if literals:
        numeric = (a["cls"] == b["cls"]) & a["cls"].isin("number", "number_list") & a["nums"].isNotNull() & b["nums"].isNotNull()
        exact = F.when(numeric, _same_numbers(a["nums"], b["nums"], numbers_close)).otherwise(trimmed(x) == trimmed(y)).cast("double")
        if near:
            short = (F.length(x) <= LONGEST_TOKEN) & (F.length(y) <= LONGEST_TOKEN)
            exact = F.when(exact == 1, 1.0).when(short, near_miss(a["nums"], b["nums"])).otherwise(0.0)
        out = out.when(a["cls"].isNotNull() & b["cls"].isNotNull(), exact)
    return out.otherwise(F.greatest(F.lit(0.0), 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))))


def _number_of(x: Column) -> Column:
    return F.when(x["cls"] == "number", F.get(x["nums"], 0))


def leaf_kernel(a: Column, b: Column, tolerance: Column | None = None, literals: bool = True, numeric_text: bool = True) -> Column:
    """Content similarity of two leaves at one path. tolerance: struct of abs and rel, null where none holds."""
    close = numbers_close
    if tolerance is not None:
        close = lambda x, y: F.when(tolerance.isNull(), numbers_close(x, y)).otherwise(F.abs(x - y) <= F.greatest(tolerance["abs"], tolerance["rel"] * F.greatest(F.abs(x), F.abs(y))))
    both = lambda v: (a["vtype"] == v) & (b["vtype"] == v)
    out = F.when(a.isNull() | b.isNull(), 0.0).when(both("string") & (a["sval"] == b["sval"]), 1.0).when(both("number"), close(a["nval"], b["nval"]).cast("double")).when(both("boolean"), (a["bval"] == b["bval"]).cast("double"))
    out = out.when((a["vtype"] == b["vtype"]) & (a["vtype"] != "string"), 1.0)
    if numeric_text:
        mixed = ((a["vtype"] == "number") & (b["vtype"] == "string")) | ((a["vtype"] == "string") & (b["vtype"] == "number"))
        out = out.when(mixed & _number_of(a).isNotNull() & _number_of(b).isNotNull(), close(_number_of(a), _number_of(b)).cast("double"))
    return out.otherwise(F.greatest(F.lit(0.0), value_kernel(a, b, literals=literals) - type_cost(a["vtype"], b["vtype"])))


def field_score(a: Column, b: Column, tolerance: Column | None = None, weight: float = 0.5, **how) -> Column:
    """The product profile's score of a field: the structural channel is 1 at a shared path, so the kernel to the power 1 - weight."""
    return F.pow(leaf_kernel(a, b, tolerance, **how), F.lit(1 - weight))


def path_kernel(a: Column, b: Column) -> Column:
    """The leaf kernel of path_f1: no square root, no tolerance, no cross-type credit but for numeric text; near misses are graded."""
    both = lambda v: (a["vtype"] == v) & (b["vtype"] == v)
    numbers = F.when(numbers_close(a["nval"], b["nval"]), 1.0).otherwise(near_miss(a["nums"], b["nums"]))
    mixed = F.coalesce(numbers_close(_number_of(a), _number_of(b)).cast("double"), F.lit(0.0))
    out = F.when(a.isNull() | b.isNull(), 0.0).when(both("string"), value_kernel(a, b, near=True)).when(both("number"), numbers)
    out = out.when(both("boolean"), (a["bval"] == b["bval"]).cast("double")).when(a["vtype"] == b["vtype"], 1.0)
    return out.when(a["vtype"].isin("number", "string") & b["vtype"].isin("number", "string"), mixed).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, cut off at 0; 0 for a zero or missing vector or unequal lengths."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(a.isNull() | b.isNull() | (F.size(a) != F.size(b)) | (size == 0), 0.0).otherwise(F.greatest(F.lit(0.0), dot(a, b) / size))
