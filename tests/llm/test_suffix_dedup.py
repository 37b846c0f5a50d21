"""Suffix dedup against brute force, and the loser tree against sorting."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafspan.llm import suffix_dedup
from tests.llm.same import differ


def brute(rows):
    first = {}
    big = 2**63
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            s = b[i : i + 50]
            first[s] = min(first.get(s, big), big - 1 if d is None else d)
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < (big - 1 if d is None else d):
                gone[i : i + 50] = b"\1" * 50
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        yield d, len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()


def variants():
    rng = random.Random(4)
    prose = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    a, b = prose(300), prose(120)
    rows = [(0, None), (1, ""), (2, a), (3, a), (3, a), (None, a), (4, a[:49]), (5, a[:50]), (6, a[10:60]), (7, "x" * 49), (8, "x" * 200), (9, "y" + "x" * 49), (10, "ab" * 100), (11, "ba" * 60), (12, "\0" * 80), (13, "\0" * 90 + "q"), (None, prose(60)), (-5, a[100:200])]
    for k in range(80):
        t = prose(rng.randrange(200))
        for _ in range(rng.randrange(3)):
            i, n = rng.randrange(250), rng.randrange(40, 130)
            t += rng.choice((a, b))[i : i + n] + prose(rng.randrange(30))
        rows.append((rng.randrange(1000), t))
    return rows


@pytest.mark.parametrize("small", [True, False])
def test_against_brute_force(spark, monkeypatch, small):
    rows = variants()
    if small:
        monkeypatch.setattr(suffix_dedup, "SUFFIXES_A_PART", 50)
    else:
        rows += [(r[0] + 10**6, r[1]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sig", F.lit(1)).repartition(6)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want = sorted(brute(rows), key=key)
    got = sorted((tuple(r) for r in suffix_dedup.remove_repeats(df).collect()), key=key)
    assert not differ(got, want)
    assert sum(r[2] > 0 for r in want) > 30
    if small:
        assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def shared(a, b):
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))


def test_loser_tree(monkeypatch):
    told, real = [], suffix_dedup._differ

    def told_of(p, q, known):
        assert p[:known] == q[:known]
        told.append((known, real(p, q, known)))
        return told[-1][1]

    monkeypatch.setattr(suffix_dedup, "_differ", told_of)
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 5, 8, 13):
        keys = rng.integers(97, 99, (n, 30, suffix_dedup.KEY), np.uint8)
        keys[:, :, 12:] = 97
        runs, want = [], []
        for own in keys:
            own = np.unique(own, axis=0)[: rng.integers(0, 30)]
            want += [k.tobytes() for k in own]
            runs.append(suffix_dedup.Run(*suffix_dedup.front_coded(own), np.arange(len(own))))
        got, last = [], b""
        for number, share in suffix_dedup.merged(runs):
            key = runs[number].key
            if got:
                assert share == shared(last, key)
            got.append(last := key)
        assert got == sorted(want)
        # No byte is matched twice: what a suffix is found to share only grows, up to what it shares with the one before it.
        assert sum(n - known for known, n in told) <= sum(map(shared, got, got[1:]))
        told.clear()


def test_looks_at_nothing_known():
    p, q = b"?" * 30 + b"a" * 52, b"!" * 30 + b"a" * 51 + b"b"
    assert suffix_dedup._differ(p, q, 30) == suffix_dedup.KEY - 1 and suffix_dedup._differ(p, p[:-1] + b"c", 81) == 81 and suffix_dedup._differ(p, p, 3) == suffix_dedup.KEY


def test_anchors_block_by_block(monkeypatch):
    data = np.random.default_rng(1).integers(97, 100, 5000).astype(np.uint8)
    whole = suffix_dedup.anchors(data)
    for block in (64, 333, 4999):
        monkeypatch.setattr(suffix_dedup, "BLOCK", block)
        assert all((a == b).all() for a, b in zip(suffix_dedup.anchors(data), whole))


def test_ids_of_any_ordered_type(spark):
    text = "It was a long and winding road that went on and on for many miles. "
    rows = [("b", text + "x"), ("a", "y" + text), (None, text), ("c", None), ("a", "y" + text)]
    got = {(r[0], r[1]): r[2] for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {("b", 68): 67, ("a", 68): 0, (None, 67): 67, ("c", 0): 0}
