"""Kernels, rules, solvers, converters and readouts by hand-computed cases and brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from leafspan.functions import kernels
from leafspan.functions.paths import FieldRules, compiled, printed
from leafspan.operators import assign, consistency
from leafspan.sources import converters, flatten


def test_literal_classes(spark):
    cases = {"300": "number", "1,234.5": "number", "-2e5": "number", "40.3772,-105.5217": "number_list", "2024-01-15": "datetime", "01/15/2024": "datetime", "12:30": "datetime", "$45.00": "amount", "50%": "amount", "A-17": "identifier", "lambda x: x**2": "code", "a == b": "code", "hello world": None, "": None, "New York": None, "ab": None}
    df = spark.createDataFrame(list(cases), "string")
    assert {r.value: r.c for r in df.select("value", kernels.literal_class(F.col("value")).alias("c")).collect()} == cases


def test_kernels(spark):
    cases = [("300", "300.0", 1.0), ("40.3772,-105.5217", "40.3772, -105.5217", 1.0), ("01/15/2024", "2024-01-15", 0.0), ("kitten", "sitting", 1 - 3 / 7), ("", "", 1.0), ("", "abcd", 0.0)]
    df = spark.createDataFrame(cases, "a string, b string, want double")
    assert all(abs(r.k - r.want) < 1e-9 for r in df.select("want", kernels.string_kernel(F.col("a"), F.col("b")).alias("k")).collect())


def test_paths():
    import re

    assert printed(["a", 0, "b.c", ""]) == '$.a[0]["b.c"][""]'
    for pattern, path, want in [("price", ["a", 0, "price"], True), ("a.price", ["a", "price"], True), ("a.price", ["b", "a", "price"], False), ("a[*].x", ["a", 3, "x"], True), ("a[*].x", ["a", "3", "x"], False), ("*.x", ["q", "x"], True), ("**.x", ["q", 1, "x"], True), ('["a.b"]', ["a.b"], True), ("a.b", ["a.b"], False), ("[0]", [0], True), ("$", [], True)]:
        assert bool(re.search(compiled(pattern), printed(path))) is want, (pattern, path)
    for bad in ("", "a[", "[x]"):
        with pytest.raises(ValueError):
            compiled(bad)
    with pytest.raises(ValueError):
        FieldRules(tolerance={"a": -1})
    with pytest.raises(ValueError):
        FieldRules(tolerance={"a": {"near": 1}})


def test_readouts(spark):
    rows = [('{"name": "search", "arguments": {"q": "a", "n": 5, "x": null}}', '{"name": "search", "arguments": {"q": "a", "n": "5", "x": null}}', 1.0, 1.0), ('{"a": 1, "b": 2}', '{"a": 1}', 0.0, 2 / 3), ("{}", "{}", 1.0, 1.0), ('{"a": "kitten"}', '{"a": "sitting"}', (4 / 7) ** 0.5, 4 / 7), ('{"a": true}', '{"a": 1}', 0.0, 0.0), ('{"a": []}', '{"a": {}}', 0.0, 0.0)]
    df = spark.createDataFrame(rows, "a string, b string, low double, f1 double").select("*", flatten.flatten_json(F.col("a")).alias("da"), flatten.flatten_json(F.col("b")).alias("db"))
    df = df.select("*", consistency.field_scores(F.col("da"), F.col("db")).alias("s"), consistency.path_f1(F.col("da"), F.col("db"))["f1"].alias("got_f1"))
    for r in df.select("a", "low", "f1", "got_f1", consistency.min_readout(F.col("s")).alias("got")).collect():
        if r.a not in ('{"a": true}', '{"a": []}', "{}"):
            assert abs(r.got - r.low) < 1e-9, r
        assert abs(r.got_f1 - r.f1) < 1e-9 or r.a == "{}", r
    rules = FieldRules(ignore=("id",), tolerance={"price": {"rel": 0.1}})
    one = spark.createDataFrame([('{"id": 1, "price": 100, "s": {"id": [1, 2]}}', '{"id": 2, "price": 105, "s": {"id": 3}}')], "a string, b string").select(consistency.min_readout(consistency.field_scores(flatten.flatten_json(F.col("a")), flatten.flatten_json(F.col("b")), rules)).alias("m"))
    assert one.first().m == 1.0


def test_validity():
    for text, strict, loose in [("null", False, False), ("{}", False, False), ("[]", False, False), ("[null]", False, False), ("0", True, True), ("false", True, True), ("no answer", False, True), ("  ", False, False), ('["a", "b"]', False, True), ('{"a": null}', True, True)]:
        assert flatten.valid(text, True) is strict and flatten.valid(text, False) is loose, text


def test_solvers():
    rng = random.Random(1)
    for _ in range(60):
        n, m = rng.randrange(1, 5), rng.randrange(1, 6)
        cost = [[rng.randrange(10) / 10 for _ in range(m)] for _ in range(n)]
        rows, cols = (range(n), range(m)) if n <= m else (range(m), range(n))
        at = (lambda i, j: cost[i][j]) if n <= m else (lambda i, j: cost[j][i])
        every = [[at(i, j) for i, j in zip(rows, p)] for p in itertools.permutations(cols, len(rows))]
        total = sum(cost[i][j] for i, j in assign.least_total(cost))
        assert abs(total - min(map(sum, every))) < 1e-9
        greatest = [cost[i][j] for i, j in assign.least_greatest(cost)]
        low = min(map(max, every))
        assert max(greatest) == low and abs(sum(greatest) - min(sum(e) for e in every if max(e) == low)) < 1e-9
        ordered = [[at(i, j) for i, j in zip(rows, p)] for p in itertools.combinations(cols, len(rows))]
        assert abs(assign.aligned(cost) - min(map(sum, ordered))) < 1e-9


def test_converters():
    assert converters.xml_value('<r xmlns="u" a="1">t<b>2</b><b/>u</r>') == {"r": {"@a": "1", "b": ["2", None], "#text": "t u"}}
    assert converters.html_value("<p>a<br>b</p></i>")["p"]["#text"] == "a b"
    with pytest.raises(Exception):
        converters.xml_value("<a>")


def test_key_order(spark):
    df = spark.createDataFrame([('{"a": 1, "b": "x"}', '{"b": "x", "a": 1.0}')], "a string, b string")
    from leafspan.functions.leaves import canonical

    r = df.select(canonical(flatten.flatten_json(F.col("a"))).alias("a"), canonical(flatten.flatten_json(F.col("b"))).alias("b")).first()
    assert r.a == r.b
