"""Steps that large tables go through: what they make, and that it is made once."""

import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from leafspan.functions import kernels
from leafspan.functions.leaves import document, number_leaf, text_leaf
from leafspan.functions.tables import made_once
from leafspan.operators import consistency, references, schemas, trees, verification
from leafspan.sources import converters, flatten, traces


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_classed_once(spark):
    df = spark.createDataFrame([("1, 2",), (None,)], "s string")
    leaf = df.select(text_leaf(F.col("s")).alias("x"))
    assert plan(leaf).count(kernels.CODE) == 1
    assert [(r.x.cls, r.x.nums) for r in leaf.collect()] == [("number_list", [1.0, 2.0]), (None, None)]


def test_documents_are_known_to_be_there(spark):
    df = spark.createDataFrame([("a", 1.0), (None, None)], "s string, n double").select(document({"$.s": text_leaf(F.col("s")), "$.n": number_leaf(F.col("n"))}).alias("doc"))
    assert not df.schema["doc"].nullable
    assert [{k: v.vtype for k, v in r.doc.items()} for r in df.collect()] == [{"$.s": "string", "$.n": "number"}, {"$.s": "null", "$.n": "null"}]


def test_equal_runs_come_from_the_same_join(spark):
    rows = [("p", i, s) for i, s in enumerate(["x", "x", "x", "y", "y", "z"])] + [("q", 7, "x"), ("q", 7, "y")]  # q: a run id twice
    df = spark.createDataFrame(rows, "prompt_id string, run_id int, s string")
    found = consistency.pairs(df.select("prompt_id", "run_id", document({"$.s": text_leaf(F.col("s"))}).alias("doc")))
    assert "Union" not in plan(found)
    assert sorted((r.prompt_id, r.run_a, r.run_b, r.weight, r.min_readout) for r in found.collect()) == [("p", 0, 0, 3, 1.0), ("p", 0, 3, 6, 0.0), ("p", 0, 5, 3, 0.0), ("p", 3, 3, 1, 1.0), ("p", 3, 5, 2, 0.0)]


def test_null_documents_cost_no_null_lists(spark):
    df = spark.createDataFrame([(1, "a", "a"), (2, None, "a"), (3, None, None), (4, "a", "b")], "i int, s string, t string")
    docs = df.select("i", *[F.when(F.col(c).isNotNull(), document({"$.x[0]": text_leaf(F.col(c))})).alias(c) for c in ("s", "t")])
    out = trees.profile_scores(docs, "s", "t", "typed_mean")
    assert re.search(r"coalesce\(__a#\d+\.path", plan(out))
    assert [(r.i, r.score is None) for r in out.orderBy("i").collect()] == [(1, False), (2, True), (3, True), (4, False)]
    assert math.isclose(out.where("i = 1").first().score, 1.0)


def test_schemas_are_searched_once(spark):
    text = '{"type": "object", "required": ["id"], "properties": {"id": {"type": "integer"}, "size": {"type": "object", "properties": {"w": {"type": "string", "enum": ["a"]}}}, "kind": {"type": "string", "enum": ["a", "b"]}, "bare": {"properties": {"x": {}}}}}'
    docs = spark.createDataFrame([(text,)], "t string").select(flatten.flatten_json(F.col("t")).alias("schema"))
    m = docs.select(schemas.schema_metrics(F.col("schema")).alias("m"))
    assert plan(m).count("PythonUDF") <= 2 and plan(m).count(schemas.PARAMETER) <= 3
    assert m.first().m.asDict() == {"depth": 1, "params": 5, "optional": 3, "types": 4, "string_params": 1, "free_strings": 0, "top": 4, "described": 0.0}


def test_scores_that_change_when_made_again_lose_no_row(spark):
    noisy = F.udf(lambda: random.random(), "double").asNondeterministic()
    scores = spark.range(200).selectExpr("id % 2 as t", "id div 2 as i").withColumn("v", noisy())
    assert [(r.a, r.b, r.n) for r in references.ranking_stability(scores, "t", "i", "v").collect()] == [(0, 1, 100)]


def test_documents_leave_python_in_pieces(spark):
    import pandas as pd

    pieces = [*flatten.in_pieces(pd.Series(range(1000)))]
    assert max(map(len, pieces)) <= flatten.PIECE and [x for p in pieces for x in p] == [*range(1000)]
    df = spark.range(1000).selectExpr("id", "if(id % 10 = 3, null, concat('{\"k\": ', id, '}')) as j", "concat('<p>', id, '</p>') as h").coalesce(1)
    out = df.select("id", "j", flatten.flatten_json(F.col("j"))["$.k"]["nval"].alias("n"), converters.converted(F.col("h"), "html")["$.p"]["sval"].alias("s"))
    assert all((r.n is None if r.j is None else r.n == r.id) and r.s == str(r.id) for r in out.collect())


def test_what_is_made_of_columns_is_made_once(spark):
    df = spark.range(900).selectExpr("id", "if(id % 3 = 0, null, id % 3) as a", "if(id % 2 = 0, 'x', null) as b")
    out = made_once(df, ["a", "b"], {"mark": F.concat_ws(":", "a", "b", F.uuid())})
    assert out.columns == ["id", "a", "b", "mark"] and out.count() == 900 and out.select("mark").distinct().count() == 6
    assert out.where("mark is null or a is null and id % 3 <> 0").isEmpty()


def test_path_f1_scores_its_paths_once(spark):
    doc = lambda c: document({"$.s": text_leaf(F.col(c))})
    out = spark.createDataFrame([("ab", "ac")], "a string, b string").select(doc("a").alias("a"), doc("b").alias("b")).select(consistency.path_f1(F.col("a"), F.col("b")).alias("f"))
    assert plan(out).count("map_zip_with") == 1 and out.first().f.asDict() == {"f1": 0.5, "precision": 0.5, "recall": 0.5}


def test_pairs_of_rows_are_those_of_documents(spark):
    rows = [(p, i, random.Random(10 * p + i).choice(["ab", "ac", "b", None])) for p in range(4) for i in range(9)] + [(9, 0, "x")]
    df = spark.createDataFrame(rows, "prompt_id int, run_id int, s string")
    doc = lambda of="": document({"$.s": text_leaf(F.col(f"{of}s"))})
    docs, own = df.withColumn("doc", doc()), consistency.distinct_rows(df, ["s"])
    scored = consistency.pairs(docs)
    got = lambda found: sorted((r.prompt_id, r.run_a, r.run_b, r.weight, r.min_readout, r.scores["$.s"].asDict()["status"]) for r in found.collect())
    assert got(scored) == got(consistency.row_pairs(own, doc)) == got(consistency.row_pairs(own, doc, block=2))
    central = consistency.centroids(docs, scored)
    assert "Union" not in plan(central)  # every pair is scored once for its two runs
    assert sorted(central.collect()) == sorted(consistency.centroids_of(own, scored).collect())
    for r in central.collect():
        texts = {i: s for p, i, s in rows if p == r.prompt_id}
        alike = lambda a, b: 1.0 if a == b else math.sqrt(0.5) if {a, b} == {"ab", "ac"} or {a, b} == {"ab", "b"} else 0.0
        mean = {i: round(sum(alike(texts[i], texts[j]) for j in texts if j != i) / (len(texts) - 1), 9) if len(texts) > 1 else 1.0 for i in texts}
        assert r.run_id == min(mean, key=lambda i: (-mean[i], i)) and math.isclose(r.similarity, mean[r.run_id], abs_tol=1e-8)


def test_trace_records_are_taken_apart_once(spark):
    lines = ['{"attributes": {"tool_name": "a", "tool_input": "{\\"q\\": 1}", "prompt.id": "p"}}', '{"attributes": [{"key": "tool_name", "value": {"stringValue": "b"}}, {"key": "tool_name", "value": {"stringValue": "c"}}], "body": {"tool_input": {}}}', '{"tool_name": "d", "attributes": null, "body": "x"}', "broken"]
    steps = traces.steps_of(spark.createDataFrame(lines, "string"), "value")
    assert plan(steps).count("$.attributes") == 2 and plan(steps).count("parseJson") + plan(steps).count("parse_json") <= 3
    assert sorted((r.name, r.prompt, r.args) for r in steps.collect()) == [("a", "p", '{"q":1}'), ("c", None, "{}")]


def test_draws_are_read_from_one_digest(spark):
    rows = [(f"r{i}", float(i)) for i in range(60)]
    got = verification.bootstrap_mean(spark.createDataFrame(rows, "k string, v double"), "v", "k", replicates=38, level=0.0, seed=3)
    assert plan(got).count("md5") == 1
    means = []
    for r in range(38):
        w = [sum(int(hashlib.md5(f"3:{k}:{r // 4}".encode()).hexdigest()[r % 4 * 8 :][:8], 16) / (1 << 32) >= c for c in verification.POISSON) for k, _ in rows]
        means.append(sum(n * v for n, (_, v) in zip(w, rows)) / sum(w))
    means.sort()
    assert math.isclose(got.first().low, (means[18] + means[19]) / 2) and math.isclose(got.first().mean, 29.5)


def test_numbers_and_texts_are_compared_once_for_each_two(spark):
    from leafspan.plans import queries

    assert kernels.CODE not in plan(queries.QUERIES["numeric_string_equal"](spark, "/root/testdata/sf0.001"))  # the lines are joined to scores
