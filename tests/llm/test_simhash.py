"""SimHash links against brute force over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from leafspan.llm import simhash
from tests.llm.same import differ


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def labels(fps):
    """fingerprint → least fingerprint of its component, by all pairs."""
    distinct = sorted(set(fps))
    parent = {f: f for f in distinct}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 4:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {f: root(f) for f in distinct}


def brute(rows):
    fps = [plain(t) for _, t in rows]
    label = labels(fps)
    least = {}
    for (d, _), f in zip(rows, fps):
        if d is not None:
            least[label[f]] = min(least.get(label[f], d), d)
    return [(d, f"{f:016x}", least.get(label[f], d)) for (d, _), f in zip(rows, fps)]


def variants():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = [(None, "one two"), (7, None), (8, ""), (9, " \t\x0b"), (10, "One  two"), (11, "one\ntwo"), (12, "a b c d"), (12, "a b c d"), (13, "É é ÀA z"), (14, "w " * 900), (15, "w " * 7), (None, None)]
    at = 100
    for size in (5, 40, 200, 600):
        base = [word() for _ in range(size)]
        for _ in range(25):
            own = list(base)
            for _ in range(rng.randrange(1 + size // 25)):
                own[rng.randrange(size)] = word()
            rows.append((at + rng.randrange(9) * 1000, " ".join(own)))
            at += 1
    return rows


@pytest.mark.parametrize("part", [8192, 7])
def test_against_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(simhash, "PART", part)
    rows = variants()
    if part == 8192:
        rows += [(r[0] + 10**6, r[1]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("component_id", F.lit("x")).repartition(5)
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    want = sorted(brute(rows), key=key)
    got = sorted((tuple(r) for r in simhash.link_documents(df).collect()), key=key)
    assert not differ(got, want)
    assert sum(r[2] != r[0] for r in want) > 20
    if part == 7:
        kept = simhash.keep_one(df)
        assert kept.columns == df.columns and kept.count() == sum(r[0] is None or r[0] == r[2] for r in want)
        assert simhash.link_documents(df.limit(0)).count() == 0


def test_long_text(monkeypatch):
    text = " ".join(random.Random(1).choices(["ab", "cd", "ef", "gh", "ij"], k=2000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "WORDS", 64)
    assert simhash.fingerprint(text) == whole == plain(text)


def test_keys_share(spark):
    """Every two fingerprints within the radius share a key."""
    rng = random.Random(2)
    pairs = []
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randrange(5)):
            b ^= 1 << bit
        pairs.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    df = spark.createDataFrame(pairs, "a long, b long")
    assert df.where(~F.arrays_overlap(simhash.keys(F.col("a")), simhash.keys(F.col("b")))).count() == 0
    masks = simhash.block_masks(4)
    assert sum(masks) == 2**64 - 1 and len(masks) == 6


def hot(n, centres):
    """Many fingerprints near few centres, so that keys are shared by many."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, centres, np.int64).astype(np.uint64)[rng.integers(0, centres, n)]
    flips = np.zeros(n, np.uint64)
    for _ in range(5):
        flips ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    return np.unique(base ^ flips)


def test_tiles_against_all_pairs():
    fps = hot(900, 3)
    order = np.lexsort((np.bitwise_count(fps),))
    fps = fps[order]
    edges = simhash.tile_links(fps, np.zeros(len(fps), np.int64), np.zeros(len(fps), np.int32), 4)
    assert all((int(fps[i]) ^ int(fps[j])).bit_count() <= 4 for i, j in edges)
    want = labels(fps.tolist())
    assert len(edges) == len(fps) - len(set(want.values()))


def test_hot_keys_are_cut(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 50)
    fps = hot(1500, 4)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    edges = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(df).collect()]
    want = labels(fps.tolist())
    assert all((a ^ b).bit_count() <= 4 for a, b in edges)
    parent = {int(f): int(f) for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {f: root(f) for f in parent} == want
