"""The nearest vectors against all pairs, in blocks far smaller than the table."""

import math
import random

from leafspan.operators import nearest


def cosine(x, y):
    if x is None or y is None or len(x) != len(y):
        return 0.0
    size = math.sqrt(sum(v * v for v in x)) * math.sqrt(sum(v * v for v in y))
    return max(0.0, sum(p * q for p, q in zip(x, y)) / size) if size else 0.0


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(nearest, "QUERIES", 7)
    monkeypatch.setattr(nearest, "ROWS", 20)
    monkeypatch.setattr(nearest, "AT_ONCE", 6)
    rng = random.Random(4)
    rows = [(i, rng.randrange(3), [float(rng.randrange(-2, 3)) for _ in range(3)]) for i in range(120)]
    rows += [(200 + i, 0, [1.0, 1.0, 1.0]) for i in range(30)] + [(300, 0, None), (301, 0, []), (302, 1, [0.0, 0.0, 0.0]), (303, 1, [1.0, 2.0]), (304, 7, [1.0, 2.0, 3.0])]
    t = spark.createDataFrame(rows, "id long, label int, v array<float>")
    for within in (None, "label"):
        found = nearest.most_alike(t.where("id % 4 = 0").selectExpr("id as a", "v as x", "label"), t.selectExpr("id as b", "v as y", "label"), 3, within)
        got = sorted((r.a, r.b, round(r.similarity, 6)) for r in found.collect())
        want = []
        for a, own, x in rows:
            if a % 4 == 0:
                each = sorted((-round(cosine(x, y), 6), b) for b, label, y in rows if b != a and (within is None or label == own))
                want += [(a, b, -s) for s, b in each[:3]]
        assert got == sorted(want)
