"""Queries that leave nothing out, against the rows they must have."""

from leafspan.operators import prompts
from leafspan.plans import queries

SF = "/root/testdata/sf0.001"


def test_self_consistency_of_all_users(spark):
    days = spark.read.parquet(f"{SF}/events.parquet").selectExpr("user_id", "date(ts) as d").distinct().groupBy("user_id").count().where("count > 1")
    got = queries.QUERIES["self_consistency_jaccard_all"](spark, SF)
    assert {(r.user_id, r.n_pairs) for r in got.collect()} == {(r.user_id, r["count"] * (r["count"] - 1) // 2) for r in days.collect()}


def test_self_consistency_weights(spark):
    rows = [(1, 1, ["a"]), (1, 2, ["a"]), (1, 3, ["b", "a"]), (1, 4, ["a", "b"]), (2, 1, ["a"]), (2, 2, ["a"]), (3, 1, ["a"]), (None, 1, ["a"]), (None, 2, ["a"])]
    got = prompts.self_consistency(spark.createDataFrame(rows, "p long, r long, s array<string>"), "p", "r", "s").collect()
    got = {r.p: (r.n_pairs, round(r.consistency, 6), round(r.confidence, 6)) for r in got}
    assert got == {1: (6, round(4 / 6, 6), 0.764298), 2: (1, 1.0, 0.5)}


def test_classes_of_all_orders(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    got = queries.QUERIES["literal_class_texts_all"](spark, SF).where("id like 'd%'")
    assert got.where("class = 'datetime'").count() == orders.count() and got.select("id").distinct().count() == orders.count()


def test_priorities_beyond_the_sixth(spark, tmp_path):
    own = {1: "AAAAAABC", 2: "AAAAAACB", 3: "AAAAAACC", 4: "AAAAAAC", 5: "D", 6: "D"}
    rows = [(c, 100 * c + k, x) for c, s in own.items() for k, x in enumerate(s)]
    spark.createDataFrame(rows, "o_custkey long, o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = queries.QUERIES["unordered_priorities_all"](spark, str(tmp_path)).collect()
    assert {r.prompt_id: r.same_as_sets for r in got} == {1: True, 2: False, 3: False, 4: False, 5: True}


def test_agreement_over_all_samples(spark, tmp_path):
    rows = [(10 * day + k, c, f"2024-01-{day:02d}", "x" if day < 20 or c == 1 else "y") for day in range(1, 29) for k, c in enumerate((1, 2))]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "A"), (2, "B")], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    got = queries.QUERIES["cross_segment_agreement_all"](spark, str(tmp_path)).collect()
    assert [(r.model_a, r.model_b, r.n, r.agreement) for r in got] == [("A", "B", 28, round(19 / 28, 6))]


def test_nearest_of_any_label(spark, tmp_path):
    rows = [(0, 1, [1.0, 0.0]), (1, 2, [1.0, 0.1]), (2, None, [1.0, 0.2]), (3, 1, [0.0, 1.0]), (4, 1, [1.0, 1.0]), (20, None, [0.0, 1.0])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.QUERIES["embedding_cosine_topk_all"](spark, str(tmp_path)).collect()
    assert {(r.a, r.b) for r in got} == {(0, 1), (0, 2), (0, 4), (20, 3), (20, 4), (20, 2)}
