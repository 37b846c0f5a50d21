"""Coverage over many positions and trees over sparse ones, against plain Python."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from leafspan.operators import information


def entropy(counts):
    n, k = sum(counts), len(counts)
    whole = n + 0.5 * (k + 1)
    h = math.log(whole) - (sum((c + 0.5) * math.log(c + 0.5) for c in counts) + 0.5 * math.log(0.5)) / whole + k / (2 * max(whole, 1))
    return max(h, 0.0)


def test_coverage_of_forty_positions(spark):
    rng = random.Random(3)
    names = [f"p {i}" for i in range(40)]
    records = [tuple(rng.choice(["x", "y", None, str(rng.randrange(6))]) for _ in names) for _ in range(120)]
    pairs = [(k, *(rng.choice([0.0, 0.5, 1.0]) for _ in names)) for k in range(25)] + [(99, *[0.0] * 40), (100, *[1.0] * 40)]
    df = spark.createDataFrame(pairs, ["id", *[f"s{i}" for i in range(40)]])
    rec = spark.createDataFrame(records, [f"`{n}`".strip("`") for n in names])
    got = {r.id: r for r in information.prefix_coverage(df, ["id"], rec, {n: F.col(f"s{i}") for i, n in enumerate(names)}).collect()}
    h = lambda s: entropy([*Counter(tuple(r[i] for i in s) for r in records).values()])
    for k, *sigma in pairs:
        order = sorted(range(40), key=lambda i: (-sigma[i], i))
        want = sum((sigma[i] - (sigma[order[n + 1]] if n < 39 else 0)) * h(sorted(order[: n + 1])) for n, i in enumerate(order) if sigma[i] - (sigma[order[n + 1]] if n < 39 else 0) > 0)
        assert math.isclose(got[k].h_agreed, want, abs_tol=1e-9) and math.isclose(got[k].h_all, h(range(40)))
    assert got[99].coverage == 0.0 and got[100].coverage == 1.0


def test_coverage_is_added_up_once_for_each_likeness(spark, monkeypatch):
    sizes = {}
    monkeypatch.setattr(information, "saved", lambda df, name, own=information.saved: sizes.setdefault(name, own(df, name)))
    pairs = spark.range(500).selectExpr("id", "id % 7 as same", "if(id % 2 = 0, 1.0D, 0.0D) as s0", "if(id % 4 = 0, 1.0D, 0.0D) as s1")
    rec = spark.createDataFrame([("x", "y"), ("x", "z"), ("w", "z")], "a string, b string")
    got = information.prefix_coverage(pairs, ["same"], rec, {"a": F.col("s0"), "b": F.col("s1")})  # a key that many pairs share
    assert sorted((round(r.coverage, 3) == 1, r["count"]) for r in got.groupBy("coverage").count().collect()) == [(False, 125), (False, 250), (True, 125)]
    assert sizes["kinds"].count() == 3


def cells(rng, n_runs, n_positions):
    out = []
    for run in range(n_runs):
        kind = rng.randrange(3)
        for p in range(n_positions):
            if rng.random() < 0.4:
                out.append((run, f"p{p:03d}", str(kind) if p % 3 == 0 and rng.random() < 0.9 else rng.choice("ab")))
    return out


def test_sparse_pairs_and_tree(spark):
    rows = cells(random.Random(4), 60, 9)
    df = spark.createDataFrame(rows + rows[:5], "run int, position string, value string")
    value = {(r, p): v for r, p, v in rows}
    runs, names = sorted({r for r, _, _ in rows}), sorted({p for _, p, _ in rows})
    h = {frozenset(s): entropy([*Counter(tuple(value.get((r, p)) for p in s) for r in runs).values()]) for a in names for b in names for s in [sorted({a, b})]}
    got = {(r.a, r.b): r for r in information.sparse_pairs(df, "run", "position", "value").collect()}
    assert len(got) == 36
    mutual = {}
    for a, b in got:
        mutual[a, b] = max(0.0, h[frozenset([a])] + h[frozenset([b])] - h[frozenset([a, b])])
        assert math.isclose(got[a, b].joint, h[frozenset([a, b])], abs_tol=1e-9) and math.isclose(got[a, b].mutual, mutual[a, b], abs_tol=1e-9)
    tree = information.sparse_tree_weights(df).collect()
    root = min(names, key=lambda p: (-h[frozenset([p])], p))
    parents = {r.position: r.parent for r in tree}
    assert set(parents) == set(names) and [p for p in parents if parents[p] is None] == [root]
    # A spanning tree of most weight: as heavy as Prim's.
    inside, weight = [root], 0.0
    while len(inside) < len(names):
        m, c = max((mutual[tuple(sorted((p, c)))], c) for p in inside for c in names if c not in inside)
        weight += m
        inside.append(c)
    assert math.isclose(sum(mutual[tuple(sorted((r.position, r.parent)))] for r in tree if r.parent), weight, abs_tol=1e-9)
    for r in tree:
        want = h[frozenset([r.position])] if r.parent is None else max(h[frozenset([r.position, r.parent])] - h[frozenset([r.parent])], information._constant_entropy(len(runs)))
        assert math.isclose(r.weight, want, abs_tol=1e-9)


def test_runs_with_the_same_cells_are_counted_first(spark):
    rows = [(i, p, v) for i in range(300) for p, v in (("a", str(i % 2)), ("b", "x"))] + [(0, "a", None), (1, "a", "0"), (300, "a", None), (301, "b", "x")]
    kinds = information.run_kinds(spark.createDataFrame(rows, "run int, position string, value string"), "run", "position", "value").collect()
    assert sorted((r.c, len(r.cells)) for r in kinds) == [(1, 1), (1, 1), (149, 2), (151, 2)]  # of run 1, "0" counts; of run 0, no null does


def test_tree_of_one_position(spark):
    df = spark.createDataFrame([(1, "p", "x"), (2, "p", "y")], "run int, position string, value string")
    assert [(r.position, r.parent) for r in information.sparse_tree_weights(df).collect()] == [("p", None)]


def test_spanning_tree_of_a_thousand_nodes(spark):
    rng = random.Random(6)
    edges = {tuple(sorted(rng.sample(range(1000), 2))): rng.randrange(50) for _ in range(6000)} | {(i, i + 1): rng.randrange(50) for i in range(999)}
    got = information.spanning_tree(spark.createDataFrame([(a, b, float(w)) for (a, b), w in edges.items()], "a long, b long, mutual double")).collect()
    parent = list(range(1000))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    want = set()
    for (a, b), w in sorted(edges.items(), key=lambda e: (-e[1], e[0])):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            want.add((a, b))
    assert {(r.a, r.b) for r in got} == want
