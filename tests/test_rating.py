"""The two main calls on small cases whose answers are plain."""

import json

from pyspark.sql import functions as F

from leafspan.functions.paths import FieldRules
from leafspan.operators import rating
from leafspan.sources import flatten


def test_compare(spark):
    pairs = [
        ({"b": 1, "a": {"x": "same", "y": [1, 2]}}, {"b": 2, "a": {"x": "same", "y": [1, 3, 4]}}),
        ({"a": 1}, {"a": 1}),
        ({"name": "f", "arguments": {"k": 1}}, {"name": "g", "arguments": {"k": 1}}),
        ({"t": [1, 2], "n": 10}, {"t": [2, 1], "n": 10.4}),
        ({}, {}),
    ]
    rows = [(k, json.dumps(a), json.dumps(b), "kept") for k, (a, b) in enumerate(pairs)] + [(9, "not json", "{}", "kept")]
    df = spark.createDataFrame(rows, "n int, x string, y string, same string").select("n", "same", flatten.flatten_json(F.col("x")).alias("a"), flatten.flatten_json(F.col("y")).alias("b"))
    got = {r.n: r for r in rating.compare(df, "a", "b").collect()}
    assert [(d.path, d.status, d.a, d.b) for d in got[0].differences] == [("$.a.y[1]", "changed", "2", "3"), ("$.a.y[2]", "extra", None, "4"), ("$.b", "changed", "1", "2")]
    assert not got[0].same and got[0].min_readout == 0 and got[0].mean_readout == round((0 + (1 + 1 / 3) / 2) / 2, 6)
    assert got[1].same and got[1].min_readout == got[1].mean_readout == 1 and got[1].differences == []
    assert got[2].min_readout == 0 and [d.path for d in got[2].differences] == ["$.name"] and got[2].mean_readout == 0.5
    assert got[4].same and got[9].same is None and got[9].differences is None
    ruled = {r.n: r for r in rating.compare(df, "a", "b", FieldRules(unordered=("t",), tolerance={"n": 0.5}), max_differences=1).collect()}
    assert ruled[3].same and ruled[3].mean_readout == 1 and not got[3].same and len(ruled[0].differences) == 1


def test_rate(spark):
    outputs = {"p": ['{"a": "x", "b": 1}', '{"a": "x", "b": 1}', '{"a": "y"}', "broken"], "one": ['{"a": 1}', "broken"], "same": ['{"a": 1}'] * 3}
    rows = [(p, k, t) for p, own in outputs.items() for k, t in enumerate(own)]
    docs = spark.createDataFrame(rows, "prompt string, at int, raw string").select("prompt", "at", flatten.flatten_json(F.col("raw")).alias("d"))
    got = {r.prompt: r for r in rating.rate(docs, prompt="prompt", run="at", doc="d").collect()}
    p = got["p"]
    assert (p.n_outputs, p.n_valid, p.validity, p.n_pairs) == (4, 3, 0.75, 3) and p.agreement_min == round(1 / 3, 6) and p.share_same == round(1 / 3, 6) and p.agreement_mean == round(1 / 3, 6)
    assert [(f.path, f.share_of_pairs, [(v.value, v["count"]) for v in f["values"]]) for f in p.unstable_fields] == [("$.a", round(2 / 3, 6), [("x", 2), ("y", 1)]), ("$.b", round(2 / 3, 6), [("1", 2), ("(absent)", 1)])]
    w = p.least_agreeing_pair
    assert (w.i, w.j, w.min_readout) == (0, 2, 0.0) and [(d.path, d.status) for d in w.differences] == [("$.a", "changed"), ("$.b", "missing")]
    assert got["one"].note == "fewer than 2 valid outputs" and got["one"].agreement_min is None and got["one"].least_agreeing_pair is None
    assert got["same"].agreement_min == 1 and got["same"].unstable_fields == [] and got["same"].least_agreeing_pair.min_readout == 1 and got["same"].note is None


def test_early_prediction(spark):
    from leafspan.operators import verification

    rows = [("a", ["f", "g"]), ("a", ["f"]), ("b", None), ("b", []), ("b", ["x", "y", "z", "w"]), ("c", ["f"]), ("d", None)]
    got = {r.prompt_id: r for r in verification.early_prediction(spark.createDataFrame(rows, "prompt_id string, names array<string>")).collect()}
    assert got["a"].predicted == 1.0 and round(got["a"].confidence, 6) == 0.5 and got["a"].n_tools == 2 and got["a"].mean_calls == 1.5
    assert round(got["b"].predicted, 6) == 0.45 and got["b"].first_agreement == 1.0 and round(got["b"].confidence, 6) == 0.6
    assert got["c"].predicted == 1.0 and round(got["d"].predicted, 6) == round(0.7 - 0.3 + 0.15 - 0.2, 6)
