"""The two calls that answer most questions: how two outputs compare, and how consistent the outputs of each prompt are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.leaves import shown
from ..functions.paths import FieldRules
from ..functions.positions import exact_where, key_of, steps
from ..functions.tables import saved
from . import consistency, nested, trees

#: More than a list of differences, examples or fields ever shows.
MOST = 1 << 20


def path_order(path: Column) -> Column:
    """What sorts paths as their typed steps do when written out, keys as ('key', 'a') and indices as ('index', 0)."""
    one = lambda s: F.when(key_of(s).isNull(), F.concat(F.lit("('index', "), F.regexp_extract(s, "[0-9]+", 0), F.lit(")"))).otherwise(F.concat(F.lit("('key', '"), key_of(s), F.lit("')")))
    own = F.transform(steps(path), one)
    return F.concat(F.lit("("), F.array_join(own, ", "), F.when(F.size(own) == 1, ",").otherwise(""), F.lit(")"))


def differences(scores: Column, most: int = MOST) -> Column:
    """What differs between two documents, from their field scores: path, status, a, b, score, the lowest score first and then by path."""
    each = F.filter(F.map_entries(scores), lambda e: e["value"]["status"] != "same")
    ordered = F.array_sort(F.transform(each, lambda e: F.struct(F.round(e["value"]["score"], 9).alias("by"), path_order(e["key"]).alias("then"), e["key"].alias("path"), e["value"].alias("s"))))
    shown_ = F.transform(ordered, lambda d: F.struct(d["path"].alias("path"), d["s"]["status"].alias("status"), d["s"]["a"].alias("a"), d["s"]["b"].alias("b"), F.round(d["s"]["score"], 6).alias("score")))
    return F.slice(shown_, 1, most)


def _scored(df: DataFrame, a: str, b: str, rules: FieldRules) -> DataFrame:
    """df with scores (callees by name wholly or not at all), min_readout and mean_readout."""
    out = consistency.with_scores(df, a, b, rules) if "scores" not in df.columns else df
    # Behind a fence each time, or the scores would be made again wherever they are read.
    out = trees.fenced(trees.fenced(out).withColumn("scores", exact_where(F.col("scores"), F.col(a)))).withColumn("min_readout", consistency.min_readout(F.col("scores")))
    # Only arrays need a solver; the mean over objects is an expression.
    arrays = lambda c: F.exists(F.map_keys(F.col(c)), lambda k: k.rlike(r"\[[0-9]+\]"))
    solved = arrays(a) | arrays(b)
    out = trees.profile_scores(out.withColumn("__x", F.when(solved, F.col(a))).withColumn("__y", F.when(solved, F.col(b))), "__x", "__y", "typed_mean", "__mean", rules)
    own = [rules.strip(F.col(c)) for c in (a, b)]
    flat = F.forall(F.map_keys(F.col("scores")), lambda k: k.rlike(r"^\$\.[^.\[]+$"))
    mean = F.when(F.col("__x").isNotNull(), F.col("__mean")).when(flat, consistency.flat_mean_readout(*map(F.size, own), F.col("scores")))
    return out.withColumn("mean_readout", mean.otherwise(nested.mean_readout(F.col("scores"), *map(nested.child_counts, own)))).drop("__x", "__y", "__mean")


def compare(df: DataFrame, a: str, b: str, rules: FieldRules | None = None, threshold: float = consistency.THRESHOLD, max_differences: int = MOST) -> DataFrame:
    """df with same (the minimum readout reaches the threshold), min_readout, mean_readout and differences (path, status, a, b, score), lowest score first.

    a and b name document columns; where either is null (text that could not be read) all four are null. Names of callees count wholly or not at all.
    """
    out = _scored(df, a, b, rules or FieldRules())
    there = F.col(a).isNotNull() & F.col(b).isNotNull()
    low, mean = (F.when(there, F.round(c, 6)) for c in ("min_readout", "mean_readout"))
    found = F.when(there, differences(F.col("scores"), max_differences))
    same = F.when(there, F.col("min_readout") >= threshold)
    names = {"same": same, "min_readout": low, "mean_readout": mean, "differences": found}
    return trees.fenced(out).select(*[F.col(f"`{c}`") for c in df.columns if c not in names], *[x.alias(n) for n, x in names.items()])


def rate(docs: DataFrame, rules: FieldRules | None = None, threshold: float = consistency.THRESHOLD, max_fields: int = 20, max_differences: int = 20, prompt: str = "prompt_id", run: str = "run_id", doc: str = "doc") -> DataFrame:
    """One row for each prompt: n_outputs, n_valid, validity, agreement_min, agreement_mean (of pairs of valid outputs), share_same, n_pairs, unstable_fields
    (path, share_of_pairs, values with counts, the five commonest), least_agreeing_pair (i, j, min_readout, differences) and a note.

    With fewer than two valid outputs the agreements, share_same and the pair are null. Pairs are scored once and written to the shared folder, as several
    parts of the answer read them; every disagreeing pair is searched, none sampled.
    """
    rules = rules or FieldRules()
    own = docs.select(F.col(prompt).alias("prompt_id"), F.col(run).alias("run_id"), rules.strip(F.col(doc)).alias("doc"))
    scored = saved(_scored(consistency.pairs(own, rules, keep=True), "doc", "other", rules).drop("doc", "other"), "pairs")
    per = consistency.prompt_scores(own, scored, threshold)
    mean = scored.groupBy("prompt_id").agg((F.sum(F.col("weight") * F.col("mean_readout")) / F.sum("weight")).alias("agreement_mean"))
    rank = F.struct(F.round("min_readout", 9), "run_a", "run_b")
    worst = scored.groupBy("prompt_id").agg(F.min_by(F.struct(F.col("run_a").alias("i"), F.col("run_b").alias("j"), F.round("min_readout", 6).alias("min_readout"), F.when(F.col("run_a") < F.col("run_b"), F.col("scores")).alias("scores")), rank).alias("w"))
    pair = F.struct("w.i", "w.j", "w.min_readout", F.coalesce(differences(F.col("w.scores"), max_differences), F.array().cast("array<struct<path: string, status: string, a: string, b: string, score: double>>")).alias("differences"))
    fields = consistency.unstable_fields(scored, threshold, max_fields)
    valid = own.where("doc is not null")
    n = valid.groupBy("prompt_id").agg(F.count("*").alias("n_valid"))
    cells = valid.select("prompt_id", "run_id", F.explode("doc").alias("path", "leaf")).select("prompt_id", "run_id", "path", shown(F.col("leaf")).alias("value"))
    seen = cells.join(fields.select("prompt_id", "path"), ["prompt_id", "path"], "left_semi").groupBy("prompt_id", "path", "value").agg(F.count("*").alias("count"), F.min("run_id").alias("first"))
    absent = fields.select("prompt_id", "path").join(n, "prompt_id").join(seen.groupBy("prompt_id", "path").agg(F.sum("count").alias("there")), ["prompt_id", "path"], "left")
    absent = absent.select("prompt_id", "path", F.lit("(absent)").alias("value"), (F.col("n_valid") - F.coalesce("there", F.lit(0))).alias("count"), F.lit(None).cast(own.schema["run_id"].dataType).alias("first")).where("count > 0")
    place = F.row_number().over(Window.partitionBy("prompt_id", "path").orderBy(F.desc("count"), F.asc_nulls_last("first")))
    values = seen.unionByName(absent).withColumn("place", place).where("place <= 5").groupBy("prompt_id", "path").agg(F.array_sort(F.collect_list(F.struct("place", "value", "count"))).alias("v"))
    values = values.select("prompt_id", "path", F.transform("v", lambda x: F.struct(x["value"].alias("value"), x["count"].alias("count"))).alias("values"))
    order = F.struct((-F.col("n")).alias("by"), "path", F.round("share_of_pairs", 6).alias("share_of_pairs"), "values")
    listed = fields.join(values, ["prompt_id", "path"], "left").groupBy("prompt_id").agg(F.array_sort(F.collect_list(order)).alias("f"))
    listed = listed.select("prompt_id", F.transform("f", lambda x: F.struct(x["path"].alias("path"), x["share_of_pairs"].alias("share_of_pairs"), x["values"].alias("values"))).alias("unstable_fields"))
    out = per.join(mean, "prompt_id", "left").join(worst.select("prompt_id", pair.alias("pair")), "prompt_id", "left").join(listed, "prompt_id", "left")
    enough = F.col("n_valid") >= 2
    some = lambda c: F.when(enough, F.round(c, 6))
    none = F.array().cast(listed.schema["unstable_fields"].dataType)
    return out.select(F.col("prompt_id").alias(prompt), F.col("n_runs").alias("n_outputs"), "n_valid", F.round("r_v", 6).alias("validity"), some("c_mean").alias("agreement_min"), some("agreement_mean").alias("agreement_mean"), some("share_same").alias("share_same"), "n_pairs", F.coalesce("unstable_fields", none).alias("unstable_fields"), F.when(enough, F.col("pair")).alias("least_agreeing_pair"), F.when(~enough, "fewer than 2 valid outputs").alias("note"))
