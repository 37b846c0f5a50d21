"""The mean readout of nested documents, other profiles and their intervals, and counts by status as a baseline. All are expressions over two documents."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.positions import STEP, element_count, prefixes, steps
from ..functions.leaves import shown


def child_counts(doc: Column) -> Column:
    """Inner node → number of its children; made once for each document. Quadratic in one document's inner nodes."""
    inner = F.array_distinct(F.flatten(F.transform(F.map_keys(doc), lambda k: F.transform(F.filter(prefixes(k), lambda p: p != "$"), lambda p: F.struct(F.regexp_replace(p, f"{STEP}$", "").alias("of"), p.alias("child"))))))
    parents = F.array_distinct(F.transform(inner, lambda e: e["of"]))
    return F.map_from_arrays(parents, F.transform(parents, lambda p: F.size(F.filter(inner, lambda e: e["of"] == p))))


def mean_readout(scores: Column, counts_a: Column, counts_b: Column) -> Column:
    """The mean, taken level by level: a leaf counts its score, a node the sum over common children by the larger number of children. scores as of
    field_scores(), counts as of child_counts(). Arrays are matched by position, which is right where both have one length; trees.with_readouts() aligns others."""

    def share(path: Column) -> Column:
        above = F.filter(prefixes(path), lambda p: p != path)
        wide = lambda c, p: F.coalesce(F.try_element_at(c, p), F.lit(1))
        return F.aggregate(above, F.lit(1.0), lambda w, p: w / F.greatest(wide(counts_a, p), wide(counts_b, p)))

    total = F.aggregate(F.map_entries(scores), F.lit(0.0), lambda s, e: s + F.when(e["value"]["status"].isin("missing", "extra"), 0.0).otherwise(e["value"]["score"] * share(e["key"])))
    return F.when(F.size(scores) == 0, 1.0).otherwise(total)


def certified(scores: Column) -> Column:
    """The least score over the reference's fields; 0 where the candidate has more."""
    values = F.map_values(scores)
    least = F.coalesce(F.array_min(F.transform(values, lambda s: s["score"])), F.lit(1.0))
    return F.when(F.exists(values, lambda s: s["status"] == "extra"), 0.0).otherwise(least)


def combined(structure: Column, content: Column, weight: float = 0.5, product: bool = True) -> Column:
    """Two costs as one: 1 less the weighted product of their complements, or the weighted sum."""
    if product:
        return 1 - F.pow(1 - structure, F.lit(weight)) * F.pow(1 - content, F.lit(1 - weight))
    return weight * structure + (1 - weight) * content


def structural_cost(key_similarity: Column, path_a: Column, path_b: Column) -> Column:
    """Of two fields: 1 less the mean of their keys' likeness and whether their paths agree but for indices."""
    bare = lambda p: F.regexp_replace(p, r"\[[0-9]+\]", "")
    return 1 - (key_similarity + (bare(path_a) == bare(path_b)).cast("double")) / 2


def projections(a: Column, b: Column, scores: Column, counts_a: Column, counts_b: Column) -> Column:
    """(combined, structural, content) mean readouts: structural scores every common field 1, content takes the square of the product's field score."""
    remade = lambda f: F.transform_values(scores, lambda _, s: s.withField("score", f(s)))
    one = remade(lambda s: F.when(s["status"].isin("missing", "extra"), 0.0).otherwise(1.0))
    raw = remade(lambda s: F.pow(s["score"], F.lit(2)))
    m = lambda x: mean_readout(x, counts_a, counts_b)
    return F.struct(m(scores).alias("combined"), m(one).alias("structural"), m(raw).alias("content"))


def interval(low: Column, high: Column) -> Column:
    """A score under both ends of a setting, as (low, high) whichever is which."""
    return F.struct(F.least(low, high).alias("low"), F.greatest(low, high).alias("high"))


def exponent_interval(scores: Column, counts_a: Column, counts_b: Column) -> Column:
    """Between the least field score and the mean readout, for documents whose arrays have one length on both sides (others: trees.exponent_interval()): every
    exponent of child aggregation lies between."""
    least = F.coalesce(F.array_min(F.transform(F.map_values(scores), lambda s: s["score"])), F.lit(1.0))
    return interval(least, mean_readout(scores, counts_a, counts_b))


def order_ambiguous(counts_a: Column, counts_b: Column, doc: Column) -> Column:
    """The arrays of more than one element that two documents have in one length, so that their order may matter."""
    arrays = F.array_distinct(F.flatten(F.transform(F.map_keys(doc), lambda k: F.transform(F.filter(prefixes(k), lambda p: p.endswith("]") & ~p.endswith('"]')), lambda p: F.regexp_replace(p, r"\[[0-9]+\]$", "")))))
    return F.filter(arrays, lambda p: (F.try_element_at(counts_a, p) > 1) & (F.try_element_at(counts_a, p) == F.try_element_at(counts_b, p)))


def auto_order(counts_a: Column, counts_b: Column, doc: Column) -> Column:
    """The weight of order that a pair asks for: 1 where such an array exists, else 0."""
    return (F.size(order_ambiguous(counts_a, counts_b, doc)) > 0).cast("double")


def counted_changes(a: Column, b: Column, scores: Column) -> Column:
    """A baseline of counts: structure is 1 less added and missing fields over the larger element count, content the mean likeness of values in common
    (0 where structure is under a half), score their mean."""
    values = F.map_values(scores)
    changed = F.size(F.filter(values, lambda s: s["status"].isin("missing", "extra")))
    structure = F.greatest(F.lit(0.0), 1 - changed / F.greatest(element_count(a), element_count(b), F.lit(1)))
    common = F.filter(values, lambda s: ~s["status"].isin("missing", "extra"))
    alike = F.when(F.size(common) == 0, 0.0).otherwise(F.aggregate(common, F.lit(0.0), lambda t, s: t + F.pow(s["score"], F.lit(2))) / F.size(common))
    content = F.when(structure < 0.5, 0.0).otherwise(alike)
    return F.struct(structure.alias("structure"), content.alias("content"), ((structure + content) / 2).alias("score"))


def renamed(doc: Column, names: dict[str, str]) -> Column:
    """A document with keys renamed by dotted path (indices left out, * for any key); what lies below moves along."""
    for old in sorted(names, key=lambda k: -k.count(".")):
        *above, last = old.split(".")
        head = "".join(rf"\.{'[A-Za-z_][A-Za-z0-9_-]*' if k == '*' else re.escape(k)}(?:\[[0-9]+\])*" for k in above)
        doc = _moved(doc, rf"^(\$(?:\[[0-9]+\])*{head})\.{last}(?=[.\[]|$)", f"$1.{names[old]}")
    return doc


def _moved(doc: Column, pattern: str, to: str) -> Column:
    return F.transform_keys(doc, lambda k, _: F.regexp_replace(k, pattern, to))


def flattened(doc: Column, sep: str = "_") -> Column:
    """A document of one level: keys and indices of each path joined."""
    name = lambda k: F.array_join(F.transform(steps(k), lambda s: F.regexp_replace(s, r'^[.\["]+|["\]]+$', "")), sep)
    return F.transform_keys(doc, lambda k, _: F.concat(F.lit("$."), name(k)))


def wrapped(doc: Column, ratio: float) -> Column:
    """A document inside none, one or two more objects."""
    inside = "" if ratio < 0.4 else ".wrapper" if ratio < 0.7 else ".data.content"
    return F.transform_keys(doc, lambda k, _: F.concat(F.lit(f"${inside}"), F.substring(k, 2, 1 << 20)))


def fields(doc: Column) -> Column:
    """path and value as text of every leaf."""
    return F.transform(F.map_entries(doc), lambda e: F.struct(e["key"].alias("path"), shown(e["value"]).alias("value")))


def replaced(doc: Column, path: str, leaf: Column) -> Column:
    """A document with another leaf at a path that it has."""
    return F.transform_values(doc, lambda k, v: F.when(k == path, leaf).otherwise(v))


def varied_numbers(doc: Column, as_text: bool = True, digits: int = 1) -> Column:
    """A variation of format: numbers as their texts, or rounded."""

    def one(_: Column, v: Column) -> Column:
        text = v.withField("vtype", F.lit("string")).withField("sval", shown(v)).withField("nval", F.lit(None).cast("double"))
        return F.when(v["vtype"] == "number", text if as_text else v.withField("nval", F.round(v["nval"], digits)).withField("nums", F.array(F.round(v["nval"], digits)))).otherwise(v)

    return F.transform_values(doc, one)


def greedy_total(cost: Column) -> Column:
    """Of a square matrix of costs: each row in turn takes the cheapest column left. Rows are few (children of one node)."""
    n = F.size(cost)

    def take(state: Column, row: Column) -> Column:
        free = F.filter(F.transform(row, lambda c, j: F.struct(c.alias("c"), j.alias("j"))), lambda x: ~F.array_contains(state["used"], x["j"]))
        best = F.array_min(free)
        return F.struct((state["total"] + F.coalesce(best["c"], F.lit(1.0))).alias("total"), F.when(best.isNull(), state["used"]).otherwise(F.array_append(state["used"], best["j"])).alias("used"))

    start = F.struct(F.lit(0.0).alias("total"), F.array().cast("array<int>").alias("used"))
    return F.when(n == 0, 0.0).otherwise(F.aggregate(cost, start, take)["total"])


def certificate_score(a: Column, b: Column) -> Column:
    """The certificate profile's field score: literals by characters, numbers and numeric texts not equated."""
    return kernels.field_score(a, b, literals=False, numeric_text=False)


def sequence_cost(a: Column, b: Column, cost=lambda x, y: (x != y).cast("double")) -> Column:
    """Least cost of turning one array into another in order: a change costs as given, an element more or less 1. A row of the table at a time; arrays are
    short (children of one node)."""
    first = F.transform(F.sequence(F.lit(0), F.size(b)), lambda j: j.cast("double"))

    def row(above: Column, x: Column) -> Column:
        def cell(left: Column, at: Column) -> Column:
            best = F.least(F.element_at(left, -1) + 1, F.get(above, at["i"]) + cost(x, at["y"]), F.get(above, at["i"] + 1) + 1)
            return F.array_append(left, best)

        return F.aggregate(F.transform(b, lambda y, i: F.struct(y.alias("y"), i.alias("i"))), F.array(F.get(above, 0) + 1), cell)

    return F.element_at(F.aggregate(a, first, row), -1)


def aligned_order(names: Column, others: Column) -> Column:
    """For calls by name: which of the other side's calls stands opposite each of ours, by identity first (the same place if it can be, else the first left),
    then in order for what is left; null where nothing is, and what is over follows behind."""
    places = F.transform(others, lambda n, j: F.struct(n.alias("name"), j.alias("j")))

    def take(state: Column, own: Column) -> Column:
        free = F.filter(places, lambda p: p["name"].eqNullSafe(own["name"]) & ~F.array_contains(state["used"], p["j"]))
        j = F.coalesce(F.get(F.filter(free, lambda p: p["j"] == own["j"]), 0)["j"], F.get(free, 0)["j"])
        return F.struct(F.array_append(state["out"], j).alias("out"), F.when(j.isNull(), state["used"]).otherwise(F.array_append(state["used"], j)).alias("used"))

    none = F.array().cast("array<int>")
    found = F.aggregate(F.transform(names, lambda n, j: F.struct(n.alias("name"), j.alias("j"))), F.struct(none.alias("out"), none.alias("used")), take)
    rest = F.filter(F.transform(places, lambda p: p["j"]), lambda j: ~F.array_contains(found["used"], j))
    holes = lambda upto: F.size(F.filter(F.slice(found["out"], F.lit(1), upto), lambda x: x.isNull()))
    filled = F.transform(found["out"], lambda j, i: F.coalesce(j, F.get(rest, holes(i))))
    n_holes = holes(F.size(found["out"]))
    over = F.when(F.size(rest) > n_holes, F.slice(rest, n_holes + 1, F.greatest(F.size(rest) - n_holes, F.lit(0)))).otherwise(none)
    return F.struct(F.concat(filled, over).alias("order"), F.size(found["used"]).alias("n_named"))


def reordered(doc: Column, array: str, order: Column) -> Column:
    """A document whose elements of an array stand at the places that `order` gives them (as of aligned_order)."""
    head = re.escape(array)

    def moved(k: Column, _: Column) -> Column:
        own = F.regexp_extract(k, rf"^{head}\[([0-9]+)\]", 1).try_cast("int")
        to = F.array_position(order, own) - 1
        return F.when(own.isNull(), k).otherwise(F.concat(F.lit(f"{array}["), to.cast("string"), F.lit("]"), F.regexp_replace(k, rf"^{head}\[[0-9]+\]", "")))

    return F.transform_keys(doc, moved)
