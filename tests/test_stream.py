"""Runs that arrive one at a time, and pairs of a prompt of very many runs."""

import json
import random

from pyspark.sql import functions as F

from leafspan.operators import consistency
from leafspan.sources import flatten
from leafspan.streaming import stream

SCHEMA = "prompt string, run int, raw string, at timestamp"


def scores(df):
    docs = df.select("prompt_id", "run_id", flatten.flatten_json(F.col("raw")).alias("doc"))
    return consistency.prompt_scores(docs, consistency.pairs(docs))


def rounded(df):
    return sorted((r.prompt_id, r.n_runs, r.n_valid, r.n_pairs, round(r.c_mean, 9), round(r.c_std, 6)) for r in df.collect())


def test_closed_groups_equal_the_batch(spark, tmp_path):
    rng = random.Random(9)
    rows = [(f"p{k % 7}", k, json.dumps({"a": rng.randrange(3), "b": "x" * rng.randrange(4)}) if rng.random() > 0.1 else "not json", f"2024-01-01 00:{k % 50:02d}:00") for k in range(70)]
    rng.shuffle(rows)  # in whatever order they arrive
    rows.append(("late", 0, "{}", "2024-01-02 00:00:00"))  # moves the watermark on
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()

    def feed(name, part):
        spark.createDataFrame(part, "prompt string, run int, raw string, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(str(tmp_path / name))
        for f in (tmp_path / name).glob("*.parquet"):
            f.rename(source / f"{name}.parquet")

    def go():
        runs = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
        closed = stream.closed_groups(runs, "prompt", "run", "raw", "at", 3600, "2 hours")
        put = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")
        stream.score_batches(closed, scores, put, str(tmp_path / "checkpoint")).awaitTermination()

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        feed("one", rows[:25])
        go()
        assert spark.read.parquet(out).count() == 0  # all prompts are open, and stay so over the restart
        feed("two", rows[25:50])
        feed("three", rows[50:])
        go()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    want = spark.createDataFrame(rows[:-1], "prompt_id string, run_id int, raw string, at string")
    assert rounded(spark.read.parquet(out)) == rounded(scores(want))


def test_pairs_of_a_huge_prompt_are_dealt_out(spark):
    rng = random.Random(2)
    rows = [("big", k, json.dumps({"a": rng.randrange(40), "b": "y" * rng.randrange(3)})) for k in range(300)] + [("small", k, json.dumps({"a": k})) for k in range(4)] + [("none", 0, "bad")]
    docs = spark.createDataFrame(rows, "prompt_id string, run_id int, raw string").select("prompt_id", "run_id", flatten.flatten_json(F.col("raw")).alias("doc"))
    whole = consistency.pairs(docs)
    dealt = consistency.pairs(docs, block=40)
    key = lambda df: sorted((r.prompt_id, r.run_a, r.run_b, r.weight, round(r.min_readout, 9)) for r in df.select("prompt_id", "run_a", "run_b", "weight", "min_readout").collect())
    assert key(dealt) == key(whole)
    # A hundred thousand runs, 3,000 of them different: no task has more than a small part of the pairs.
    many = spark.range(100_000).select(F.lit("p").alias("prompt_id"), F.col("id").alias("run_id"), F.create_map(F.lit("$.a"), F.struct(F.lit("number").alias("vtype"), F.lit(None).cast("string").alias("sval"), (F.col("id") % 3000).cast("double").alias("nval"), F.lit(None).cast("boolean").alias("bval"), F.lit("number").alias("cls"), F.array((F.col("id") % 3000).cast("double")).alias("nums"))).alias("doc"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r.n for r in consistency.pairs(many).where("run_a <> run_b").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 3000 * 2999 // 2 and max(sizes) < 0.4 * sum(sizes) and len(sizes) > 4
