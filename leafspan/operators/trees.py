"""Readouts of nested documents under every reading of order, keys and aggregation, and the intervals between readings.

Leaves' likeness, and that of their keys, are expressions over the two documents; what is left is matching children from the leaves up, node by node, which
a small solver does in Arrow batches. Documents are small, but their number is not: equal pairs should be compacted first, as consistency.pairs() does,
so that each distinct pair is solved once. Nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels
from ..functions.paths import FieldRules, compiled
from ..functions.positions import STEP, is_callee, key_of, steps
from ..functions.shipping import shipped_udf
from . import assign

LEAST = float("-inf")


class Reading(NamedTuple):
    """How documents are read. order: 1 arrays are sequences, 0 bags, between a blend, "auto" by sibling arrays of one length. keys: 1 names that must be
    equal, 0 labels that may be alike, None labels of which only leaves' count. exponent: of the power mean over children, LEAST for the worst.
    additive: structure and content are added, not multiplied."""

    order: float | str = 1.0
    keys: float | None = 1.0
    exponent: float = 1.0
    additive: bool = False


#: Readings of the named profiles, and how their leaves are compared (literals exactly, numbers in texts as numbers, names of callees exactly).
PROFILES = {
    "typed": (Reading(1.0, 1.0, LEAST), True, True, True),
    "typed_mean": (Reading(1.0, 1.0, 1.0), True, True, True),
    "rank": (Reading("auto", 1.0, LEAST), False, False, False),
    "certificate": (Reading(1.0, 1.0, LEAST), False, False, False),
    "legacy": (Reading(0.0, None, 1.0, True), False, False, False),
}


def _leaves(doc: Column, callees: bool) -> Column:
    """path, bare (indices left out), key, word (the key as text), leaf and whether it names what is called."""

    def one(e: Column) -> Column:
        bare = F.regexp_replace(e["key"], r"\[[0-9]+\]", "[*]")
        key = F.coalesce(key_of(F.element_at(F.concat(F.array(F.lit(".root")), steps(F.regexp_replace(e["key"], r"\[[0-9]+\]", ""))), -1)), F.lit("root"))
        called = is_callee(e["key"], doc) if callees else F.lit(False)
        return F.struct(e["key"].alias("path"), bare.alias("bare"), key.alias("key"), F.regexp_replace(key, "[^a-zA-Z0-9]", " ").alias("word"), e["value"].alias("leaf"), called.alias("called"))

    return F.transform(F.map_entries(doc), one)


def _candidates(a: Column, b: Column, exact: bool, literals: bool, numeric_text: bool, rules: FieldRules) -> Column:
    """Pairs of leaves that may be matched: places i and j, content similarity, and structural similarity with keys as labels and as names. With exact keys
    only leaves at one path but for indices, as no others can be matched for anything."""
    numbered = F.transform(b, lambda y, j: F.struct(y.alias("y"), j.alias("j")))

    def pair(x: Column, i: Column, e: Column) -> Column:
        y = e["y"]
        content = kernels.leaf_kernel(x["leaf"], y["leaf"], rules.tolerance_at(x["path"]), literals=literals, numeric_text=numeric_text)
        content = F.when(x["called"] & y["called"] & ~x["leaf"]["sval"].eqNullSafe(y["leaf"]["sval"]), 0.0).otherwise(content)
        path = (x["bare"] == y["bare"]).cast("double")
        label, name = ((kernels.char_similarity(x["word"], y["word"]), (x["key"] == y["key"]).cast("double")) if not exact else (F.lit(1.0), F.lit(1.0)))
        return F.struct(i.alias("i"), e["j"].alias("j"), content.alias("content"), ((label + path) / 2).alias("label"), ((name + path) / 2).alias("name"))

    among = lambda x: F.filter(numbered, lambda e: e["y"]["bare"] == x["bare"]) if exact else numbered
    return F.flatten(F.transform(a, lambda x, i: F.transform(among(x), lambda e: pair(x, i, e))))


class _Node:
    __slots__ = ("array", "bare", "children", "key", "leaf", "path")

    def __init__(self, path: str, bare: str, key: str) -> None:
        self.children: dict = {}
        self.leaf, self.array, self.path, self.bare, self.key = -1, False, path, bare, key


def _tree(paths) -> _Node:
    root = _Node("$", "$", "root")
    for n, path in enumerate(paths):
        node = root
        for step in re.findall(STEP, path):
            if re.fullmatch(r"\[[0-9]+\]", step):
                node.array = True
                place, bare, key = int(step[1:-1]), node.bare + "[*]", node.key
            else:
                place, bare, key = step, node.bare + step, step.strip('.[]"')
            if place not in node.children:
                node.children[place] = _Node(node.path + step, bare, key)
            node = node.children[place]
        node.leaf = n
    return _settled(root)


def _settled(node: _Node) -> _Node:
    """Children as lists, elements of arrays in order."""
    node.children = [_settled(c) for _, c in (sorted(node.children.items()) if node.array else node.children.items())]
    return node


@lru_cache(100_000)
def _alike(a: str, b: str) -> float:
    a, b = (re.sub("[^a-zA-Z0-9]", " ", x) for x in (a, b))
    return 1.0 if a == b else 1 - assign.edit_distance(a, b) / max(len(a), len(b), 1)


def power_mean(costs: list[float], p: float) -> float:
    """1 less the power mean of similarities."""
    if not costs:
        return 0.0
    alike = [min(1.0, max(0.0, 1 - c)) for c in costs]
    if p == LEAST:
        return 1 - min(alike)
    if p <= 0 and min(alike) == 0:
        return 1.0
    mean = math.exp(math.fsum(map(math.log, alike)) / len(alike)) if p == 0 else (math.fsum(x**p for x in alike) / len(alike)) ** (1 / p)
    return min(1.0, max(0.0, 1 - mean))


def _siblings(node: _Node, others: list[_Node]) -> bool:
    return node.array and len(node.children) > 1 and any(o is not node and o.array and len(o.children) == len(node.children) for o in others)


def tree_cost(a: _Node, b: _Node, pairs: dict, reading: Reading, bags=None) -> float:
    """Cost of the best matching of two trees. pairs: (leaf of a, leaf of b) → content, label and name similarity; leaves without a pair cost 1.
    bags: whether an array's path is read as a bag whatever the reading says."""
    order, mu, p, additive = reading
    seen: dict = {}

    def structure(label: float, name: float) -> float:
        return (1 - (mu or 0.0)) * label + (mu or 0.0) * name

    def leaf(x: _Node, y: _Node) -> float:
        found = pairs.get((x.leaf, y.leaf))
        if found is None:
            return 1.0
        content, *keys = found
        s = structure(*keys)
        return 1 - (s + content) / 2 if additive else 1 - math.sqrt(max(0.0, s) * max(0.0, content))

    def weight(x: _Node, y: _Node, beside_x: list[_Node], beside_y: list[_Node]) -> float:
        if not (x.array and y.array) or bags and (bags(x.path) or bags(y.path)):
            return 0.0
        return float(_siblings(x, beside_x) or _siblings(y, beside_y)) if order == "auto" else float(order)

    def children(x: _Node, y: _Node, lam: float) -> float:
        one, other = (x, y) if len(x.children) <= len(y.children) else (y, x)
        flip = one is y and x is not y
        n, m = len(one.children), len(other.children)
        cost = lambda i, j: at(other.children[j], one.children[i], other.children, one.children) if flip else at(one.children[i], other.children[j], one.children, other.children)
        unmatched = [1.0] * (m - n)
        out = 0.0
        if lam < 1:
            if mu == 1 and not x.array and not y.array:  # only equal keys can match
                places = {c.key: j for j, c in enumerate(other.children)}
                charged = [cost(i, places[c.key]) if c.key in places else 1.0 for i, c in enumerate(one.children)]
            else:
                matrix = [[cost(i, j) for j in range(m)] for i in range(n)]
                found = assign.least_greatest(matrix) if p == LEAST else assign.least_total(matrix)
                charged = [matrix[i][j] for i, j in found]
            out = (1 - lam) * power_mean(charged + unmatched, p)
        if lam > 0:
            banded = [[cost(i, j) if 0 <= j - i <= m - n else 1.0 for j in range(m)] for i in range(n)]
            charged = assign.in_order(banded, max if p == LEAST else None)
            out += lam * power_mean(charged + unmatched, p)
        return out

    def at(x: _Node, y: _Node, beside_x: list[_Node], beside_y: list[_Node]) -> float:
        known = seen.get((id(x), id(y)))
        if known is not None:
            return known
        if not x.children and not y.children:
            out = leaf(x, y)
        elif not x.children or not y.children:
            out = 1.0
        else:
            out = children(x, y, weight(x, y, beside_x, beside_y))
            if mu:  # a key that differs voids what lies below it
                path = float(x.bare == y.bare)
                s = 1 - structure((_alike(x.key, y.key) + path) / 2, (float(x.key == y.key) + path) / 2)
                out = max(out, min(1.0, mu * s))
        seen[id(x), id(y)] = out
        return out

    return at(a, b, [], [])


def with_readouts(df: DataFrame, a: str, b: str, readings: dict[str, Reading], literals: bool = True, numeric_text: bool = True, callees: bool = False, rules: FieldRules | None = None) -> DataFrame:
    """df with a column for each named reading of the documents in columns a and b: their similarity under it, 1 for two empty documents.

    Null documents give null. Costs are solved once a row for all readings; leaves are compared by expressions. Rules hold as elsewhere: ignored fields are
    dropped, unordered arrays are bags under every reading, tolerances apply to numbers.
    """
    settings = list(readings.values())
    rules = rules or FieldRules()
    patterns = "|".join(f"(?:{compiled(p)})" for p in rules.unordered)
    exact = all(r.keys == 1 for r in settings)

    @shipped_udf(T.ArrayType(T.DoubleType()))
    def solved(x: pd.Series, y: pd.Series, i: pd.Series, j: pd.Series, content: pd.Series, label: pd.Series, name: pd.Series) -> pd.Series:
        bags = re.compile(patterns).match if patterns else None

        def one(p, q, *columns) -> list[float]:
            if not len(p) and not len(q):
                return [1.0] * len(settings)
            left, right = _tree(p), _tree(q)
            i, j, *rest = (c.tolist() for c in columns)
            pairs = dict(zip(zip(i, j), zip(*rest)))
            return [1 - tree_cost(left, right, pairs, r, bags) for r in settings]

        return pd.Series([one(*row) for row in zip(x, y, i, j, content, label, name)])

    own = df.withColumn("__a", _leaves(rules.strip(F.col(a)), callees)).withColumn("__b", _leaves(rules.strip(F.col(b)), callees))
    own = fenced(own).withColumn("__pairs", _candidates(F.col("__a"), F.col("__b"), exact, literals, numeric_text, rules))
    columns = [F.col("__a")["path"], F.col("__b")["path"], *[F.col("__pairs")[c] for c in ("i", "j", "content", "label", "name")]]
    # Null documents go as empty ones and get null afterwards: writing a null list costs Arrow time that grows with the batch.
    own = fenced(own).withColumn("__read", solved(*[F.coalesce(c, F.array()) for c in columns]))
    there = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    own = own.select(*[F.col(f"`{c}`") for c in df.columns], *[F.when(there, F.col("__read")[k]).alias(n) for k, n in enumerate(readings)])
    return fenced(own)


def fenced(df: DataFrame) -> DataFrame:
    """The same rows behind a generator of one row each, so that what is made once a row is not written out again wherever it is used."""
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def profile_scores(df: DataFrame, a: str, b: str, profile: str, name: str = "score", rules: FieldRules | None = None) -> DataFrame:
    """df with the score of a named profile."""
    reading, literals, numeric_text, callees = PROFILES[profile]
    return with_readouts(df, a, b, {name: reading}, literals, numeric_text, callees, rules)


def _intervals(df: DataFrame, a: str, b: str, name: str, low: Reading, high: Reading, **how) -> DataFrame:
    out = with_readouts(df, a, b, {"__low": low, "__high": high}, **how)
    return out.withColumn(name, F.struct(F.least("__low", "__high").alias("low"), F.greatest("__low", "__high").alias("high"))).drop("__low", "__high")


def order_interval(df: DataFrame, a: str, b: str, reading: Reading = Reading(), name: str = "interval", **how) -> DataFrame:
    """df with (low, high) between arrays as sequences and as bags: every weight of order lies between."""
    return _intervals(df, a, b, name, reading._replace(order=1.0), reading._replace(order=0.0), **how)


def key_interval(df: DataFrame, a: str, b: str, reading: Reading = Reading(), name: str = "interval", **how) -> DataFrame:
    """df with (low, high) between keys as names and as labels."""
    return _intervals(df, a, b, name, reading._replace(keys=1.0), reading._replace(keys=0.0), **how)


def exponent_interval(df: DataFrame, a: str, b: str, reading: Reading = Reading(), least: float = LEAST, name: str = "interval", **how) -> DataFrame:
    """df with (low, high) between children as requirements and as an average: every exponent from `least` to 1 lies between."""
    return _intervals(df, a, b, name, reading._replace(exponent=least), reading._replace(exponent=1.0), **how)


def assumption_interval(df: DataFrame, a: str, b: str, least: float = LEAST, name: str = "interval", **how) -> DataFrame:
    """df with (low, high) over order, keys and exponent at once: the score falls with the first two and rises with the third, so two corners bound all."""
    return _intervals(df, a, b, name, Reading(1.0, 1.0, least), Reading(0.0, 0.0, 1.0), **how)


def literalism_interval(df: DataFrame, a: str, b: str, reading: Reading = Reading(), name: str = "interval") -> DataFrame:
    """df with (low, high) between leaves whose literals count exactly and leaves compared by characters throughout. Neither is always the lower."""
    out = with_readouts(df, a, b, {"__exact": reading}, True, True)
    out = with_readouts(out, a, b, {"__text": reading}, False, False)
    return out.withColumn(name, F.struct(F.least("__exact", "__text").alias("low"), F.greatest("__exact", "__text").alias("high"))).drop("__exact", "__text")


def edit_distance_trees(a: _Node, b: _Node) -> tuple[int, int]:
    """(unit-cost edit distance, nodes of both) of two ordered trees whose labels are paths, by key roots over post-order arrays."""

    def listed(root: _Node) -> tuple[list[str], list[int], list[int]]:
        labels, first = [], []

        def walk(node: _Node, label: str) -> int:
            leftmost = None
            for n, c in enumerate(node.children):
                own = walk(c, f"{label}[{n}]" if node.array else f"{label}.{c.key}")
                leftmost = own if leftmost is None else leftmost
            labels.append(label)
            first.append(len(labels) - 1 if leftmost is None else leftmost)
            return first[-1]

        walk(root, "$")
        roots = sorted({leftmost: i for i, leftmost in enumerate(first)}.values())
        return labels, first, roots

    x, left_x, roots_x = listed(a)
    y, left_y, roots_y = listed(b)
    whole = [[0] * len(y) for _ in x]
    for i in roots_x:
        for j in roots_y:
            p, q = left_x[i], left_y[j]
            rows = [[m + n if not m or not n else 0 for n in range(j - q + 2)] for m in range(i - p + 2)]
            for s in range(p, i + 1):
                m = s - p + 1
                for t in range(q, j + 1):
                    n = t - q + 1
                    best = min(rows[m - 1][n], rows[m][n - 1]) + 1
                    if left_x[s] == p and left_y[t] == q:
                        rows[m][n] = whole[s][t] = min(best, rows[m - 1][n - 1] + (x[s] != y[t]))
                    else:
                        rows[m][n] = min(best, rows[left_x[s] - p][left_y[t] - q] + whole[s][t])
    return whole[-1][-1], len(x) + len(y)


EDITS = T.StructType([T.StructField("distance", T.LongType()), T.StructField("nodes", T.LongType())])


@shipped_udf(EDITS)
def _edits(x: pd.Series, y: pd.Series) -> pd.DataFrame:
    out = [(None, None) if p is None or q is None else edit_distance_trees(_tree(p), _tree(q)) for p, q in zip(x, y)]
    return pd.DataFrame(out, columns=["distance", "nodes"]).astype("Int64")


def tree_edit_distance(a: Column, b: Column) -> Column:
    """(distance, nodes, score) of two documents as ordered trees of paths, keys in order, arrays as they are: insertions, deletions and renamings cost 1, and
    the score is 1 less the distance's share of all nodes. Values do not count."""
    edits = _edits(F.array_sort(F.map_keys(a)), F.array_sort(F.map_keys(b)))
    return F.struct(edits["distance"].alias("distance"), edits["nodes"].alias("nodes"), (1 - edits["distance"] / edits["nodes"]).alias("score"))
