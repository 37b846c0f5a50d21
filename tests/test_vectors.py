"""The vector cache, Ward's clustering and structured texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafspan.operators import references
from leafspan.sources import converters
from leafspan.sources.vectors import VectorCache


def test_a_second_run_computes_nothing(spark, tmp_path):
    cache = VectorCache(spark, str(tmp_path), "letters", 2)
    seen = []

    def compute(missing):
        seen.append(sorted(r.text for r in missing.collect()))
        return missing.select("text", F.array(F.length("text").cast("double"), F.lit(1.0)).alias("vector"))

    texts = spark.createDataFrame([("a",), ("bb",), ("bb",), (None,), ("",)], "text string")
    got = cache.vectors(texts, compute).collect()
    assert sorted(((r.text, r.vector) for r in got), key=str) == sorted([("a", [1.0, 1.0]), ("bb", [2.0, 1.0]), ("bb", [2.0, 1.0]), (None, None), ("", [0.0, 1.0])], key=str)
    assert cache.vectors(texts, compute).count() == 5 and seen == [["", "a", "bb"]]
    cache.vectors(texts.union(spark.createDataFrame([("ccc",)], "text string")), compute)
    assert seen == [["", "a", "bb"], ["ccc"]] and len(cache.versions()) == 2
    with pytest.raises(ValueError, match="dimension"):
        cache.add(spark.createDataFrame([("dd", [1.0])], "text string, vector array<double>"))
    # What was refused is not there, nor is anything of another model or dimension.
    assert cache.missing(spark.createDataFrame([("dd",)], "text string")).count() == 1
    assert VectorCache(spark, str(tmp_path), "letters", 3).missing(texts).count() == 3 and cache.add(texts.where("false").withColumn("vector", F.array(F.lit(0.0)))) == 0


def plain_ward(points, k):
    clusters = [[i] for i in range(len(points))]
    while len(clusters) > k:
        def cost(a, b):
            x, y = points[a], points[b]
            return len(a) * len(b) / (len(a) + len(b)) * ((x.mean(0) - y.mean(0)) ** 2).sum()

        _, i, j = min((cost(a, b), i, j) for i, a in enumerate(clusters) for j, b in enumerate(clusters) if i < j)
        clusters[i] += clusters.pop(j)
    return {frozenset(c) for c in clusters}


def test_ward_equals_plain_ward(spark):
    rng = np.random.default_rng(3)
    for n, k in ((3, 3), (12, 3), (40, 4), (40, 1)):
        points = rng.normal(size=(n, 3)) + rng.integers(0, 3, (n, 1)) * 2
        labels = references.ward_labels(points, np.ones(n), k)
        assert {frozenset(i for i in range(n) if labels[i] == c) for c in set(labels)} == plain_ward(points, k)
    rows = [(int(i), float(a), float(b), 7.0) for i, (a, b) in enumerate(rng.normal(size=(60, 2)))] + [(60, None, 1.0, 7.0)]
    df = spark.createDataFrame(rows, "id int, x double, y double, c double")
    got = references.ward(df, ["x", "y", "c"], 3).collect()
    x = np.array([r[1:3] for r in rows[:60]])
    assert {frozenset(r.id for r in got if r.cluster == c) for c in range(3)} == plain_ward((x - x.mean(0)) / x.std(0), 3)


def test_ward_of_many_rows(spark):
    random.seed(1)
    df = spark.range(3000).select("id", (F.col("id") % 3 * 10 + F.rand(1)).alias("x"), F.rand(2).alias("y"))
    got = references.ward(df, ["x"], 3, most=20)
    assert got.count() == 3000 and got.groupBy("cluster").agg(F.count_distinct(F.col("id") % 3).alias("n")).where("n > 1").count() == 0


def test_structured_texts_have_reasons(spark):
    rows = [("a: [1, {b: x}]\nd: 2024-01-02", "yaml"), ("{", "yaml"), ('{"a": 1}', "JSON"), ("{", "json"), ("<a><b>1</b></a>", "xml"), ("<a>", "xml"), ("x", "toml"), (None, "json"), ("x", None)]
    df = spark.createDataFrame(rows, "text string, kind string")
    got = [(sorted(r.s.doc) if r.s.doc is not None else None, r.s.reason) for r in df.select(converters.structured(F.col("text"), F.col("kind")).alias("s")).collect()]
    assert got[0] == (["$.a[0]", "$.a[1].b", "$.d"], None) and got[2] == (["$.a"], None) and got[4][1] is None
    assert [g[1] for g in got] == [None, "cannot be read as yaml", None, "cannot be read as json", None, "cannot be read as xml", "unsupported kind: toml", "no text", "unsupported kind: None"]
    assert df.select(converters.converted(F.col("text"), "yaml").alias("d")).first().d["$.d"].sval == "2024-01-02"
