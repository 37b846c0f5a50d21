"""Run files read in splits, and documents of any length renamed."""

import json

from pyspark.sql import functions as F

from leafspan.functions.leaves import number_leaf, text_leaf
from leafspan.operators import nested
from leafspan.sources import flatten


def runs(spark, path):
    return [tuple(r) for r in flatten.read_runs(spark, str(path)).orderBy("run_id").collect()]


def test_lines_are_read_in_splits(spark, tmp_path):
    path = tmp_path / "runs.jsonl"
    path.write_text("".join(json.dumps({"v": k, "pad": "x" * 200}) + "\n" for k in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        df = flatten.read_runs(spark, str(path))
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 5
        got = [json.loads(r.raw)["v"] for r in df.orderBy("run_id").collect()]
        assert got == list(range(20_000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_arrays_and_lines_of_arrays(spark, tmp_path):
    cases = {
        "lines.jsonl": ("[1, 2]\n\n[3]\n", ["[1, 2]", "[3]"]),
        "array.json": ('[{"a": 1},\n {"a": 2}]', ['{"a":1}', '{"a":2}']),
        "one.json": ("  [7, 8]", ["7", "8"]),
        "broken.jsonl": ("[1,\n2\n", ["[1,", "2"]),
        "empty.jsonl": ("\n \n", []),
    }
    for name, (text, want) in cases.items():
        (tmp_path / name).write_text(text)
        assert [r[2] for r in runs(spark, tmp_path / name)] == want, name
    (tmp_path / "prompts.json").write_text('[{"prompt": "p", "outputs": ["x", "y"]}, {"outputs": ["z"]}]')
    assert [(r[0], r[2]) for r in runs(spark, tmp_path / "prompts.json")] == [("p", "x"), ("p", "y"), ("row 1", "z")]


def test_any_key_is_renamed(spark):
    """A conversation of 20 turns, and keys that hold marks of patterns."""
    entries = F.array(*[F.struct(F.lit(f"$.turns.t{k}.role").alias("k"), text_leaf(F.lit("user")).alias("v")) for k in range(20)], F.struct(F.lit("$.turns.t0.size").alias("k"), number_leaf(F.lit(1.0)).alias("v")))
    doc = spark.range(1).select(nested.renamed(F.map_from_entries(entries), {"turns.*.role": "speaker", "turns": "chat"}).alias("d")).first().d
    assert sorted(doc) == sorted([f"$.chat.t{k}.speaker" for k in range(20)] + ["$.chat.t0.size"])


def test_prepared_and_responses(spark):
    rows = [('{"a": 1}',), ("[1, \"x\"]",), ("plain text",), (None,), ("[]",), ('["{\\"a\\": 1}", {"b": 2}, 7]',), ("3",), ('"{}"',)]
    df = spark.createDataFrame(rows, "t string").select("t", flatten.prepared(F.col("t")).alias("d"), flatten.responses(F.col("t")).alias("r")).collect()
    assert sorted(df[0].d) == ["$.a"] and df[2].d["$"].sval == "plain text" and df[3].d is None and df[4].d["$"].vtype == "empty_array"
    assert [r.r for r in df] == ['{"a":1}', None, None, None, None, '{"responses":[{"a":1},{"b":2}]}', None, None]
