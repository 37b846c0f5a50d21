import itertools
import json
import math
import random

from pyspark.sql import functions as F

from leafspan.functions import positions
from leafspan.functions.register import register
from leafspan.operators import consistency, information, nested, predict, references, schemas, stats, verification
from leafspan.sources import flatten, replies


def docs(spark, *values):
    rows = [tuple(json.dumps(v) for v in pair) for pair in values]
    names = [f"x{i}" for i in range(len(rows[0]))]
    return spark.createDataFrame(rows, names).select(*[flatten.flatten_json(F.col(c)).alias(c) for c in names])


def plain_mean(a, b):
    """The mean readout of equal-length arrays and objects, by recursion, with leaves equal or not."""
    if isinstance(a, dict) and isinstance(b, dict) and a and b:
        return sum(plain_mean(a[k], b[k]) for k in a.keys() & b.keys()) / max(len(a), len(b))
    if isinstance(a, list) and isinstance(b, list) and a and b:
        return sum(plain_mean(x, y) for x, y in zip(a, b)) / max(len(a), len(b))
    return float(type(a) is type(b) and a == b)


def test_mean_readout(spark):
    pairs = [
        ({"name": "a", "arguments": {"x": 1, "y": 2, "z": 3}}, {"name": "a", "arguments": {"x": 1, "y": 2, "z": 4}}),
        ({"a": [1, 2, {"b": True}]}, {"a": [1, 3, {"b": True, "c": None}]}),
        ({"a": {}}, {"a": {}}),
        ({}, {}),
        ({"a": 1}, {"b": 1}),
        ({"a": [1]}, {"a": [1, 2]}),
        ({"a": {"b": 1}}, {"a": 1}),
        ({"a b": {"c.d": [5]}}, {"a b": {"c.d": [5]}}),
    ]
    d = docs(spark, *pairs).withColumn("s", consistency.field_scores(F.col("x0"), F.col("x1")))
    got = [r[0] for r in d.select(nested.mean_readout(F.col("s"), nested.child_counts(F.col("x0")), nested.child_counts(F.col("x1")))).collect()]
    assert all(math.isclose(g, 1.0 if a == b == {} else plain_mean(a, b), abs_tol=1e-9) for g, (a, b) in zip(got, pairs)), got
    assert math.isclose(got[0], 5 / 6)


def test_order_and_readouts(spark):
    d = docs(spark, ({"a": [1, 2], "b": [1]}, {"a": [2, 1], "b": [1]}))
    na, nb = nested.child_counts(F.col("x0")), nested.child_counts(F.col("x1"))
    s = consistency.field_scores(F.col("x0"), F.col("x1"))
    r = d.select(nested.order_ambiguous(na, nb, F.col("x0")).alias("o"), nested.auto_order(na, nb, F.col("x0")).alias("l"), nested.certified(s).alias("c"), nested.exponent_interval(s, na, nb).alias("i")).first()
    assert r.o == ["$.a"] and r.l == 1.0 and r.c == 0.0 and (r.i.low, r.i.high) == (0.0, 0.5)


def test_positions(spark):
    d = docs(spark, ({"a": [], "b": {"c": ["x", "y"]}, "long key": 1}, {"a": [1]}))
    each = {r.position: r.value for r in d.select(F.inline(positions.positions(F.col("x0")))).collect()}
    assert each == {"a[]": "empty_array:[]", "b.c[0]": "string:x", "b.c[1]": "string:y", '["long key"]': "number:1"}
    row = d.select(positions.element_count(F.col("x0")).alias("n"), positions.string_values(F.col("x0")).alias("s"), positions.entailed(F.lit("a[]"), F.array(F.lit("a[0]"))).alias("e"), positions.entailed(F.lit("a[]"), F.array(F.lit("ab"))).alias("no"), positions.entailed(F.lit("{}"), F.array(F.lit("q"))).alias("root")).first()
    assert (row.n, row.s, row.e, row.no, row.root) == (3 + 0 + 1 + 2 + 3, ["x", "y"], True, False, True)


def test_generators(spark):
    d = docs(spark, ({"a": {"b": [{"c": 1.25}]}, "z": "t"}, {}))
    keys = lambda c: sorted(d.select(F.map_keys(c)).first()[0])
    doc = F.col("x0")
    assert keys(nested.renamed(doc, {"a": "A", "a.b.c": "C"})) == ["$.A.b[0].C", "$.z"]
    assert keys(nested.flattened(doc)) == ["$.a_b_0_c", "$.z"]
    assert [keys(nested.wrapped(doc, r))[0] for r in (0.1, 0.5, 0.9)] == ["$.a.b[0].c", "$.wrapper.a.b[0].c", "$.data.content.a.b[0].c"]
    assert d.select(nested.varied_numbers(doc, False)["$.a.b[0].c"]["nval"]).first()[0] in (1.2, 1.3)


def test_pick_and_long_texts(spark):
    rows = spark.createDataFrame([('{"output": {"k": 1}}',), ('{"a": 1, "b": 2}',), ("no",), (None,)], "t string")
    assert [r[0] for r in rows.select(positions.pick(F.col("t"))).collect()] == ['{"k":1}', '{"a": 1, "b": 2}', "no", None]
    assert [r[0] for r in rows.select(positions.pick(F.col("t"), "b")).collect()] == [None, "2", None, None]
    r = spark.range(1).select(positions.chunks(F.lit("abcde"), 2).alias("c"), positions.chunks(F.lit(""), 2).alias("e"), positions.chunk_kernel(F.array(F.lit("ab"), F.lit("cd")), F.array(F.lit("cd"))).alias("k")).first()
    assert r.c == ["ab", "cd", "e"] and r.e == [] and math.isclose(r.k, (0.5 + 1.0) / 2)


def test_greedy(spark):
    rng = random.Random(3)
    rows = [[[rng.randint(0, 9) / 10 for _ in range(n)] for _ in range(n)] for n in (0, 1, 2, 3, 5, 5, 6)]
    got = [r[0] for r in spark.createDataFrame([(m,) for m in rows], "m array<array<double>>").select(nested.greedy_total(F.col("m"))).collect()]
    for m, g in zip(rows, got):
        free, total = set(range(len(m))), 0.0
        for row in m:
            j = min(free, key=lambda j: (row[j], j))
            free.discard(j)
            total += row[j]
        assert math.isclose(g, total)


def test_tree_weights(spark):
    rng = random.Random(5)
    rows = [(a, a if rng.random() < 0.8 else rng.randint(0, 3), rng.randint(0, 2), 7) for a in (rng.randint(0, 3) for _ in range(400))]
    tree = {r.position: r for r in information.tree_weights(spark.createDataFrame(rows, "a int, b int, c int, d int"), ["a", "b", "c", "d"]).collect()}

    def h(*columns):
        counts = {}
        for r in rows:
            k = tuple(r[c] for c in columns)
            counts[k] = counts.get(k, 0) + 1
        n = len(rows) + 0.5 * (len(counts) + 1)
        cells = [c + 0.5 for c in counts.values()] + [0.5]
        return -sum(x / n * math.log(x / n) for x in cells) + len(counts) / (2 * n)

    place = {c: i for i, c in enumerate("abcd")}
    best = max(sum(max(0.0, h(x) + h(y) - h(x, y)) for x, y in t) for t in itertools.combinations(list(itertools.combinations(range(4), 2)), 3) if len({v for e in t for v in e}) == 4)
    edges = [(place[r.position], place[r.parent]) for r in tree.values() if r.parent]
    assert math.isclose(sum(max(0.0, h(x) + h(y) - h(x, y)) for x, y in edges), best, abs_tol=1e-9)
    for r in tree.values():
        want = h(place[r.position]) if r.parent is None else max(h(place[r.position], place[r.parent]) - h(place[r.parent]), h(3))
        assert math.isclose(r.weight, want, abs_tol=1e-9)
    assert information.tree_weights(spark.createDataFrame([], "a int, b int"), ["a", "b"]).count() == 0


def test_bootstrap(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, rng.gauss(10, 2)) for i in range(1000)] + [(-1, None)], "k int, v double")
    r = verification.bootstrap_mean(df, "v", "k", replicates=400).first()
    half = 1.96 * 2 / math.sqrt(1000)
    assert r.n == 1000 and r.low < r.mean < r.high and abs((r.high - r.low) / 2 - half) < 0.3 * half
    assert all(math.isclose(x, y) for x, y in zip(verification.bootstrap_mean(df.repartition(7), "v", "k", replicates=400).first(), r))


def test_decay():
    start, rate, r2 = verification.decay([(t / 10, 0.9 * math.exp(-0.7 * t / 10)) for t in range(11)])
    assert math.isclose(start, 0.9, abs_tol=1e-6) and math.isclose(rate, 0.7, abs_tol=1e-6) and r2 > 0.999999
    assert verification.decay([(0.0, 1.0), (1.0, 1.0)])[1] < 1e-6


def test_predictor(spark):
    rng = random.Random(2)
    rows = [(i // 2, x, y, max(0.0, 1 - 0.5 * x)) for i in range(400) for x, y in [(rng.random(), rng.random())]]
    df = spark.createDataFrame(rows, "sample int, x double, y double, c double")
    model = predict.Predictor(["x", "y"], "c", trees=5, depth=3).fit(df)
    out = model.predict(df)
    assert out.columns == ["sample", "x", "y", "c", "predicted", "inconsistency", "level"]
    assert out.select(F.avg(F.abs(F.col("c") - F.col("predicted")))).first()[0] < 0.05 and model.importance()[0][0] == "x"
    folds = predict.cross_validated(df, ["x", "y"], "c", "sample", folds=2, trees=5, depth=3)
    assert all(f["r2"] > 0.8 and f["auc"] > 0.9 for f in folds)


def test_schema_of_nested_tools(spark):
    tool = {"properties": {"a": {"type": "object", "properties": {"b": {"type": "array", "items": {"type": "object", "properties": {"c": {"type": "array", "items": {"type": "string"}}}}}}}, "s": {"type": "string", "properties": {"not": {"type": "string"}}}}}
    d = docs(spark, (tool, {}))
    m = d.select(schemas.schema_metrics(F.col("x0")).alias("m"), schemas.schema_metrics(F.col("x1")).alias("e")).first()
    assert (m.m.depth, m.m.params, m.m.optional, m.m.types, m.m.string_params, m.m.free_strings) == (3, 4, 2, 2, 1, 1)
    assert (m.e.depth, m.e.params, m.e.types) == (0, 0, 0)


def test_benchmark_folders(spark, tmp_path):
    for folder, meta in (("model_temp_0_7", {}), ("deep/other", {"metadata": {"temperature": 0.2}})):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "all_results.json").write_text(json.dumps({**meta, "results": [{"ground_truth": {"a": 1}, "responses": [{"a": i} for i in range(12)]}, {"ground_truth": None, "generated_runs": []}]}))
    got = sorted((r.folder, r.temperature, r.sample, len(r.responses)) for r in replies.read_benchmarks(spark, str(tmp_path)).collect())
    assert got == [("model_temp_0_7", 0.7, 0, 10), ("model_temp_0_7", 0.7, 1, 0), ("other", 0.2, 0, 10), ("other", 0.2, 1, 0)]
    replies.write_report(spark.range(1).select(F.lit(1).alias("n"), F.lit(None).cast("string").alias("x")), str(tmp_path / "out"), text=True)
    assert spark.read.text(str(tmp_path / "out")).first()[0] == "n: 1, x: null"


def test_registered(spark):
    register(spark)
    assert spark.sql("select char_sim('abc', 'abd') as s, numbers_close(1.0d, 1.0000000001d) as c, json_readable('{') as j").first().asDict() == {"s": 1 - 1 / 3, "c": True, "j": False}
    assert [r.path for r in spark.sql("select path from flatten_json('{\"a\": [1, {}]}') order by path").collect()] == ["$.a[0]", "$.a[1]"]


def test_validity_is_that_of_the_plain_rule(spark):
    texts = [None, "", "  \t", "null", "{}", "{ }", "[]", "[null]", "[{}]", "[0]", '["a"]', '["{\\"a\\": 1}"]', "0", "false", "1.5", '"hello"', '""', "hello", '{"a": null}', '{"a": 1, "a": 2}', "[1, NaN]", "NaN", "-Infinity", "{broken", "[[], [1]]", "1e400", "\n{}\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for strict in (True, False):
        got = [r[0] for r in df.select(flatten.is_valid(F.col("t"), strict)).collect()]
        want = [t is not None and flatten.valid(t, strict) for t in texts]
        assert got == want, [x for x in zip(texts, got, want) if x[1] != x[2]]


def test_quantiles(spark):
    rng = random.Random(4)
    for n in (1, 2, 7, 100):
        values = sorted(float(rng.randint(0, 20)) for _ in range(n))
        got = stats.quantiles(spark.createDataFrame([(v,) for v in values] + [(None,)], "v double"), "v", [0.25, 0.5, 0.9])
        for q, g in zip((0.25, 0.5, 0.9), got):
            at = q * (n - 1)
            low, high = values[math.floor(at)], values[math.ceil(at)]
            assert math.isclose(g, low + (at - math.floor(at)) * (high - low), abs_tol=1e-9)
    assert stats.quantiles(spark.createDataFrame([], "v double"), "v", [0.5]) == []


def test_alignment(spark):
    d = docs(spark, ({"steps": [{"name": "a"}, {"name": "b"}, {"name": "x"}]}, {"steps": [{"name": "b"}, {"name": "a"}, {"name": "y"}, {"name": "z"}]}))
    r = spark.range(1).select(nested.aligned_order(F.array(*map(F.lit, "abx")), F.array(*map(F.lit, "bayz"))).alias("o"), nested.aligned_order(F.array(*map(F.lit, "aab")), F.array(F.lit("a"))).alias("p")).first()
    assert r.o.order == [1, 0, 2, 3] and r.o.n_named == 2 and r.p.order == [0, None, None]
    moved = d.select(nested.reordered(F.col("x1"), "$.steps", F.array(*map(F.lit, r.o.order)))).first()[0]
    assert {k: v.sval for k, v in moved.items()} == {"$.steps[0].name": "a", "$.steps[1].name": "b", "$.steps[2].name": "y", "$.steps[3].name": "z"}


def test_patterns(spark):
    rows = [(i, 0.95, 0.02) for i in range(10)] + [(10 + i, 0.5, 0.05) for i in range(10)] + [(20 + i, 0.75, 0.6) for i in range(10)]
    got = references.patterns(spark.createDataFrame(rows, "i int, c double, s double"), ["c", "s"], "c", "s").collect()
    assert {(r.i // 10, r.pattern) for r in got} == {(0, "stable"), (1, "unstable"), (2, "sensitive")}
