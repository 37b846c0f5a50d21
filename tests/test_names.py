"""The greatest overlap of names, against all pairs."""

import itertools
import random
import re

from leafspan.operators import prompts


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(prompts, "MOST_WORDS", 4)
    rng = random.Random(8)
    rows = [(g, rng.choice([" ", "_", "-"]).join(rng.choices("abcdefghijklm", k=rng.randrange(1, 8)))) for g in range(12) for _ in range(rng.randrange(1, 9))]
    rows += [(99, "one"), (99, "one"), (98, "a"), (98, "b"), (97, "A b"), (97, "b a"), (None, "x"), (96, None)]
    got = {r.g: r.ambiguity for r in prompts.name_ambiguity(spark.createDataFrame(rows, "g int, name string"), "g", "name").collect()}
    want = {}
    for g in {g for g, n in rows if g is not None}:
        names = sorted({n for h, n in rows if h == g and n is not None})
        words = [set(re.split(r"[\s_.-]+", n.lower())) for n in names]
        if len(names) > 1:
            want[g] = max(len(a & b) / len(a | b) for a, b in itertools.combinations(words, 2))
    assert got == want and got[98] == 0 and got[97] == 1 and 99 not in got


def test_medians_of_groups(spark):
    import statistics

    from leafspan.operators import reports, stats

    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.random(), 0.5, None])) for _ in range(300)] + [("one", 2.0), ("two", 1.0), ("two", 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = {g: statistics.median(own) for g in {g for g, _ in rows} if (own := [v for h, v in rows if h == g and v is not None])}
    assert {r.g: r.median for r in stats.medians(df, "v", "g").collect()} == want
    got = {r.g: r.median for r in reports.summary(df, "v", "g").collect()}
    assert got == want | {"none": None} and reports.summary(df, "v").first().median == statistics.median([v for _, v in rows if v is not None])
