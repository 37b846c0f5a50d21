"""The Jaccard join against brute force, and its parts."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafspan.llm import jaccard
from leafspan.llm.components import components
from tests.llm.same import differ


def brute(rows):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        n = {}
        for x in s:
            for j in by[x]:
                n[j] = n.get(j, 0) + 1
        for j, k in n.items():
            if j < i and 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(s), least.get(root(i), d)) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def variants():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = [(None, "one two"), (7, None), (8, ""), (9, " \t"), (10, "One  two"), (11, "one two"), (12, "a b c d"), (12, "a b c d"), (13, "a b c d e"), (14, "A b c d e f"), (15, "w " * 50), (16, "w " * 7)]
    at = 100
    for size in (6, 9, 12, 30, 60, 200, 400):
        base = [word() for _ in range(size)]
        for k in range(40):
            own = list(base)
            for _ in range(rng.randrange(1 + size // 12)):
                i = rng.randrange(len(own))
                own[i : i + rng.randrange(2)] = [word()] * rng.randrange(3)
            if k % 5 == 0:
                own = own[: int(size * rng.uniform(0.7, 1))]
            rows.append((at + rng.randrange(9) * 1000, " ".join(own)))
            at += 1
    return rows


@pytest.mark.parametrize("block", [10**9, 3000])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", block)
    rows = variants()
    if block == 10**9:
        rows += [(r[0] + 10**6, r[1]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sig", F.lit(1)).repartition(5)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want = sorted(brute(rows), key=key)
    got = sorted((tuple(r) for r in jaccard.link_documents(df).collect()), key=key)
    assert not differ(got, want)
    assert sum(r[2] != r[0] for r in want) > 50
    if block != 10**9:
        kept = jaccard.keep_one(df)
        assert kept.columns == df.columns and kept.count() == sum(r[0] == r[2] or r[0] is None for r in want)  # a row without an id stays
        assert jaccard.link_documents(df.limit(0)).count() == 0


def test_prefix_bound():
    rng = np.random.default_rng(1)
    for _ in range(400):
        n = int(rng.integers(1, 40))
        a = rng.choice(10**6, n, replace=False)
        b = np.union1d(a[rng.random(n) < rng.uniform(0.8, 1)], rng.choice(10**6, int(rng.integers(0, n // 4 + 1))))
        a = np.sort(a)
        k = len(np.intersect1d(a, b))
        if len(b) and 100 * k >= 80 * (n + len(b) - k):
            common = np.intersect1d(a[: jaccard.prefix(n)], b[: jaccard.prefix(len(b))])
            assert len(common) >= max(jaccard.needed(n), jaccard.needed(len(b)))
            assert len(np.intersect1d(a[: jaccard.missing(n) + 1], b[: jaccard.missing(len(b)) + 1]))


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (200, 100), (300, None)] + [(1000, 1000 + i) for i in range(50)]
    got = sorted((r.node, r.label) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = sorted([(i, 0) for i in range(61)] + [(i, 100) for i in (100, 101, 200)] + [(1000 + i, 1000) for i in range(50)])
    assert not differ(got, want)


def test_blocks_skip_lists():
    lists, start = np.array([0, 1, 7, 8, 3, 2, 5, 9, 0, 9]), np.array([0, 4, 5, 8, 10])
    keys = np.repeat(np.arange(4), np.diff(start)) * jaccard.STEP + lists
    found = lambda tokens, low, high: jaccard._blocks(lists, start, keys, np.array(tokens), low, high).tolist()
    assert found([0, 1, 2, 3], 2, 8) == [7, 2, 5] and found([0, 3], 0, 2) == [0, 1, 0] and found([0, 2], 10, 12) == []


def test_forest_over_many_sizes():
    rng = np.random.default_rng(5)
    for _ in range(60):
        sets = [np.arange(rng.integers(1, 40), dtype=np.uint64)]
        for _ in range(rng.integers(1, 60)):  # each grows, shrinks or changes from an earlier one, so that blocks of sizes shift along a chain
            s = sets[rng.integers(len(sets))]
            s = np.union1d(s[rng.random(len(s)) > rng.choice([0, 0.05, 0.2])], rng.integers(0, 150, rng.integers(0, 8)).astype(np.uint64))
            sets.append(s if len(s) else np.array([1], np.uint64))
        sigs = [b"%d" % i for i in range(len(sets))]
        edges = {frozenset(e) for e in jaccard._forest(sigs, sets)}
        links = {frozenset((sigs[i], sigs[j])) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}

        def groups(pairs):
            of = {x: {x} for x in sigs}
            for a, b in map(tuple, pairs):
                of[a] |= of[b]
                for x in of[a]:
                    of[x] = of[a]
            return {frozenset(g) for g in of.values()}

        assert edges <= links and groups(edges) == groups(links)


def test_copies_cost_one_pivot():
    """20,000 near copies of one set are linked in a time that grows with their number, not with its square."""
    import time

    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, np.int64).astype(np.uint64)
    sets = []
    for _ in range(20_000):
        own = base.copy()
        own[rng.choice(40, 2, False)] = rng.integers(0, 2**63, 2, np.int64).astype(np.uint64)
        sets.append(np.unique(own))
    began = time.time()
    assert len(jaccard._forest([k.to_bytes(4) for k in range(len(sets))], sets)) == len(sets) - 1
    assert time.time() - began < 30
