"""Readouts of trees against plain recursions that try every matching."""

import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from leafspan.operators import trees
from leafspan.operators.trees import LEAST, Reading
from leafspan.sources import flatten


def frame(spark, pairs):
    rows = [(n, json.dumps(a), json.dumps(b)) for n, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, "n int, x string, y string").select("n", flatten.flatten_json(F.col("x")).alias("a"), flatten.flatten_json(F.col("y")).alias("b"))


def mean(costs, p):
    s = [1 - c for c in costs]
    return 1 - (min(s) if p == LEAST else sum(s) / len(s))


def plain(a, b, reading, beside=((), ())):
    """Cost of two documents whose leaves are equal or not, over all matchings; keys must be equal."""
    children = lambda d: [(str(k), v) for k, v in sorted(d.items())] if isinstance(d, dict) else [(None, v) for v in d] if isinstance(d, list) else []
    x, y = children(a), children(b)
    if not x and not y:
        empty = {type(a), type(b)} == {list, dict}  # alike in part
        return 1 - math.sqrt(0.5) if empty else 0.0 if type(a) is type(b) and a == b else 1.0
    if not x or not y:
        return 1.0
    arrays = isinstance(a, list) and isinstance(b, list)
    lone = lambda d, others: isinstance(d, list) and len(d) > 1 and any(o is not d and isinstance(o, list) and len(o) == len(d) for o in others)
    lam = (float(lone(a, beside[0]) or lone(b, beside[1])) if reading.order == "auto" else reading.order) if arrays else 0.0
    cost = lambda i, j: 1.0 if x[i][0] != y[j][0] else plain(x[i][1], y[j][1], reading, ([v for _, v in x], [v for _, v in y]))
    n, m = len(x), len(y)
    matrix = [[cost(i, j) for j in range(m)] for i in range(n)]
    if n > m:
        matrix = [list(r) for r in zip(*matrix)]
        n, m = m, n
    out = 0.0
    for part, ways in ((1 - lam, itertools.permutations), (lam, itertools.combinations)):
        if part:
            # The best by total (by the worst for LEAST), as a level is aggregated.
            each = [[matrix[i][j] for i, j in enumerate(js)] + [1.0] * (m - n) for js in ways(range(m), n)]
            out += part * min(mean(c, reading.exponent) for c in each)
    return out


def grown(rng, depth=3):
    kind = rng.random()
    if depth == 0 or kind < 0.3:
        return rng.choice([1, 2, True, None, "x9", "y8"])
    if kind < 0.65:
        return {k: grown(rng, depth - 1) for k in rng.sample("abc", rng.randrange(4))}
    return [grown(rng, depth - 1) for _ in range(rng.randrange(4))]


def changed(rng, d):
    if isinstance(d, dict):
        return {k: changed(rng, v) for k, v in d.items() if rng.random() > 0.1}
    if isinstance(d, list):
        out = [changed(rng, v) for v in d if rng.random() > 0.15]
        return rng.sample(out, len(out)) if rng.random() < 0.2 else out
    return d if rng.random() < 0.8 else rng.choice([1, 2, True, "x9"])


CASES = [({"a": [1, 2, 3]}, {"a": [0, 1, 2, 3]}), ({"a": [1]}, {"a": {"b": 1}}), ({}, {}), ({}, {"a": 1}), ({"a": []}, {"a": [1]}), ({"a": [1, 2], "b": [3, 4]}, {"a": [2, 1], "b": [3, 4]}), ([[1, 2], [3]], [[3], [1, 2]]), (1, 1), (1, "x"), ([], {})]


def many():
    rng = random.Random(11)
    out = list(CASES)
    for _ in range(150):
        a = {"r": grown(rng), "s": grown(rng)}
        out.append((a, changed(rng, a)))
    return out


@pytest.mark.parametrize("reading", [Reading(1.0), Reading(0.0), Reading(0.4), Reading("auto"), Reading(1.0, exponent=LEAST), Reading(0.0, exponent=LEAST), Reading("auto", exponent=LEAST)])
def test_readings_against_all_matchings(spark, reading):
    pairs = many()
    # true against 1 and numbers against texts are other kernels' business: those leaves are alike only in part.
    pairs = [p for p in pairs if not any(k in json.dumps(p) for k in ("true", "null"))]
    rows = trees.with_readouts(frame(spark, pairs), "a", "b", {"s": reading}, literals=True, numeric_text=False).collect()
    assert len(rows) == len(pairs) > 40
    for r in rows:
        a, b = pairs[r.n]
        if all(type(v) in (int, dict, list) for v in walk(a) + walk(b)):
            want = 1.0 if not a and not b and type(a) is type(b) else 1 - plain(a, b, reading)
            assert math.isclose(r.s, want, abs_tol=1e-9), (a, b, r.s, want)


def walk(d):
    return [d, *[w for v in (d.values() if isinstance(d, dict) else d if isinstance(d, list) else []) for w in walk(v)]]


def test_unequal_arrays_align_in_order(spark):
    d = trees.profile_scores(frame(spark, CASES[:1]), "a", "b", "typed_mean")
    assert d.first().score == 0.75
    calls = [{"name": "get_user", "arguments": {"id": 5}}, {"name": "get_users", "arguments": {"id": 5}}]
    d = trees.profile_scores(frame(spark, [([calls[0]], [calls[1]]), ([calls[0]], [calls[1], calls[0]])]), "a", "b", "typed_mean").orderBy("n")
    assert [round(r.score, 6) for r in d.collect()] == [0.5, 0.5]  # a callee's name counts wholly or not at all


def test_every_setting_lies_inside(spark):
    rng = random.Random(5)
    pairs = many()
    pairs += [({"first_name": {"v": [1, 2]}, "b": 1}, {"firstname": {"v": [2, 1]}, "b": 1}), ({"alpha": 1}, {"alpah": 1})]
    df = frame(spark, pairs)
    for make, vary in (
        (trees.order_interval, lambda: Reading(order=rng.random())),
        (trees.key_interval, lambda: Reading(keys=rng.random())),
        (trees.exponent_interval, lambda: Reading(exponent=rng.choice([LEAST, -3.0, -1.0, 0.0, 0.5, 1.0]))),
        (trees.assumption_interval, lambda: Reading(rng.random(), rng.random(), rng.choice([LEAST, -2.0, 0.0, 1.0]))),
    ):
        inside = {f"s{k}": vary() for k in range(6)}
        rows = trees.with_readouts(make(df, "a", "b"), "a", "b", inside).collect()
        assert all(r.interval.low - 1e-9 <= r[k] <= r.interval.high + 1e-9 for r in rows for k in inside), make.__name__
        assert any(r.interval.high - r.interval.low > 0.01 for r in rows)
    r = trees.literalism_interval(frame(spark, [({"a": "410.0"}, {"a": "410"})]), "a", "b").first()
    assert r.interval.high == 1.0 and r.interval.low < 1.0


def test_legacy_matches_renamed_keys(spark):
    pairs = [({"user_name": "Ann Lee", "age": 5}, {"username": "Ann Lee", "age": 5}), ({"x": 1}, {"x": 1})]
    got = [r.score for r in trees.profile_scores(frame(spark, pairs), "a", "b", "legacy").orderBy("n").collect()]
    structure = (1 - 1 / 9) / 2
    assert math.isclose(got[0], ((structure + 1) / 2 + 1) / 2) and got[1] == 1.0
    typed = trees.profile_scores(frame(spark, pairs), "a", "b", "typed_mean").orderBy("n").first().score
    assert typed == 0.5


def plain_edits(x, y):
    """Edit distance of ordered forests by the textbook recursion; a node is (label, children)."""
    from functools import lru_cache

    size = lambda f: sum(1 + size(c) for _, c in f)

    @lru_cache(None)
    def go(f, g):
        if not f or not g:
            return size(f) + size(g)
        (a, c), (b, d) = f[-1], g[-1]
        return min(go(f[:-1] + c, g) + 1, go(f, g[:-1] + d) + 1, go(f[:-1], g[:-1]) + go(c, d) + (a != b))

    return go(x, y), size(x) + size(y)


def as_tree(d, label="$"):
    if isinstance(d, dict):
        return label, tuple(as_tree(v, f"{label}.{k}") for k, v in sorted(d.items()))
    if isinstance(d, list):
        return label, tuple(as_tree(v, f"{label}[{k}]") for k, v in enumerate(d))
    return label, ()


def test_tree_edit_distance(spark):
    pairs = many()[:90]
    rows = frame(spark, pairs).select("n", trees.tree_edit_distance(F.col("a"), F.col("b")).alias("e")).select("n", "e.*").collect()
    for r in rows:
        distance, nodes = plain_edits(*[(as_tree(d),) for d in pairs[r.n]])
        assert (r.distance, r.nodes) == (distance, nodes) and math.isclose(r.score, 1 - distance / nodes), pairs[r.n]
    assert max(r.distance for r in rows) > 3


def test_null_documents(spark):
    df = frame(spark, [({"a": 1}, {"a": 1})]).withColumn("b", F.when(F.lit(False), F.col("b")))
    assert trees.profile_scores(df, "a", "b", "typed_mean").first().score is None
    assert df.select(trees.tree_edit_distance(F.col("a"), F.col("b")).alias("e")).first().e.distance is None
