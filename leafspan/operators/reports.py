"""Reports over scored pairs and runs: worst pairs, even samples, field summaries, summaries of groups, kinds of inconsistency, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stats

from .consistency import THRESHOLD


def worst_pairs(scored: DataFrame) -> DataFrame:
    """The least agreeing pair of each prompt, the first of equals: prompt_id, run_a, run_b, min_readout."""
    least = F.min(F.struct(F.round("min_readout", 9).alias("m"), "run_a", "run_b", "min_readout")).alias("x")
    return scored.where("run_a <> run_b").groupBy("prompt_id").agg(least).select("prompt_id", "x.run_a", "x.run_b", "x.min_readout")


def even_sample(pairs: DataFrame, most: int, by: str, *order: str) -> DataFrame:
    """At most `most` rows of each group, evenly spread in order: of n > most rows those at floor(i * n / most). A group's rows meet in one window."""
    w = Window.partitionBy(by)
    place, n = F.row_number().over(w.orderBy(*order)) - 1, F.count("*").over(w)
    own = pairs.withColumn("__place", place).withColumn("__n", n)
    # place is floor(i * n / most) for some i just if a step of i ends in it.
    i = F.ceil(F.col("__place") * most / F.col("__n"))
    return own.where((F.col("__n") <= most) | ((i < most) & (F.floor(i * F.col("__n") / most) == F.col("__place")))).drop("__place", "__n")


def field_summary(scored: DataFrame) -> DataFrame:
    """For each path over all pairs that have it: n, mean, population deviation, least and greatest score. Equal runs count as pairs of score 1 in no path."""
    each = scored.where(F.col("scores").isNotNull()).select("weight", F.explode("scores").alias("path", "s")).select("path", "weight", F.col("s.score").alias("x"))
    n = F.sum("weight")
    mean = F.sum(F.col("weight") * F.col("x")) / n
    spread = F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("weight") * F.col("x") * F.col("x")) / n - mean * mean))
    return each.groupBy("path").agg(n.alias("n"), mean.alias("mean_score"), spread.alias("std_score"), F.min("x").alias("min_score"), F.max("x").alias("max_score"))


def summary(df: DataFrame, value: str, *by: str) -> DataFrame:
    """n, mean, sample deviation, least, exact median, greatest of a value."""
    g = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.min(value).alias("least"), F.max(value).alias("greatest"))
    return stats.same_groups(g, stats.medians(df, value, *by), *by, how="left").select(*by, "n", "mean", "std", "least", "median", "greatest")


def unstable_summary(unstable: DataFrame) -> DataFrame:
    """path, n_prompts, mean_share over the prompts in which a field is unstable."""
    return unstable.groupBy("path").agg(F.count("*").alias("n_prompts"), F.avg("share_of_pairs").alias("mean_share"))


def group_summary(prompts: DataFrame) -> DataFrame:
    """Mean share_same and agreement over prompts with two valid runs; the share of wholly consistent prompts and validity over all."""
    scored = F.col("n_valid") >= 2
    return prompts.agg(F.count("*").alias("n_groups"), F.avg(F.when(scored, F.col("share_same"))).alias("mean_share_same"), F.avg(F.when(scored, F.col("c_mean"))).alias("mean_agreement"), F.avg((scored & (F.col("share_same") == 1)).cast("double")).alias("share_consistent"), F.avg("r_v").alias("mean_validity"))


def penalised(prompts: DataFrame, *by: str) -> DataFrame:
    """Within each group of prompts: raw mean, validity, and their product."""
    return prompts.groupBy(*by).agg(F.count("*").alias("n"), F.avg("c_mean").alias("raw_mean"), F.avg("r_v").alias("validity"), (F.avg("c_mean") * F.avg("r_v")).alias("penalised_mean"))


def categories(runs: DataFrame, prompt: str, names: str, arguments: str, by_set: bool = True) -> DataFrame:
    """How the runs of each prompt differ: malformed (a run without names), else tool_selection (other sets of names; by_set=False: other sequences),
    else tool_count, else parameter_value, else consistent; and the number of distinct outputs. Runs have arrays of names and of arguments as text."""
    chosen = F.sort_array(F.array_distinct(names)) if by_set else F.col(names)
    g = runs.groupBy(prompt).agg(F.count("*").alias("n_runs"), F.sum(F.col(names).isNull().cast("int")).alias("bad"), F.count_distinct(chosen).alias("sets"), F.count_distinct(F.size(names)).alias("sizes"), F.count_distinct(F.struct(names, arguments)).alias("n_outputs"))
    kind = F.when(F.col("bad") > 0, "malformed").when(F.col("sets") > 1, "tool_selection").when(F.col("sizes") > 1, "tool_count").when(F.col("n_outputs") > 1, "parameter_value").otherwise("consistent")
    return g.select(prompt, "n_runs", "n_outputs", kind.alias("category"))


def differing_parameters(docs: DataFrame, prompt: str = "prompt_id", doc: str = "doc") -> DataFrame:
    """prompt_id, path, n_values for paths with more than one value across a prompt's runs."""
    from ..functions.leaves import shown

    each = docs.select(F.col(prompt).alias("prompt_id"), F.explode(doc).alias("path", "x")).select("prompt_id", "path", F.struct("x.vtype", shown(F.col("x"))).alias("value"))
    return each.groupBy("prompt_id", "path").agg(F.count_distinct("value").alias("n_values")).where("n_values > 1")


def document_statistics(doc: Column) -> Column:
    """leaves, arrays, objects, keys, depth and leaves by type of a document. A boolean counts as boolean, not as a number."""
    steps = lambda k: F.regexp_extract_all(k, F.lit(r'(\.[A-Za-z_][A-Za-z0-9_-]*|\["(?:[^"\\]|\\.)*"\]|\[[0-9]+\])'), F.lit(1))
    paths = F.transform(F.map_keys(doc), steps)
    prefixes = F.array_distinct(F.flatten(F.transform(paths, lambda p: F.transform(F.sequence(F.lit(0), F.size(p)), lambda n: F.slice(p, F.lit(1), n)))))
    inner = F.filter(prefixes, lambda p: F.size(p) > 0)
    index = lambda p: F.element_at(p, -1).rlike(r"^\[[0-9]+\]$")
    parents = F.array_distinct(F.transform(inner, lambda p: F.struct(F.slice(p, F.lit(1), F.size(p) - 1).alias("of"), index(p).alias("array"))))
    kinds = F.transform(F.map_values(doc), lambda x: x["vtype"])
    count = lambda kind: F.size(F.filter(kinds, lambda v: v == kind)).cast("long")
    empty = lambda kind: F.size(F.filter(kinds, lambda v: v == kind))
    arrays = F.size(F.filter(parents, lambda p: p["array"])) + empty("empty_array")
    objects = F.size(F.filter(parents, lambda p: ~p["array"])) + empty("empty_object")
    keys = F.size(F.filter(inner, lambda p: ~index(p)))
    depth = F.coalesce(F.array_max(F.transform(paths, F.size)), F.lit(0))
    return F.struct(F.size(doc).cast("long").alias("leaves"), arrays.cast("long").alias("arrays"), objects.cast("long").alias("objects"), keys.cast("long").alias("keys"), depth.cast("long").alias("depth"), *[count(k).alias(f"n_{k}") for k in ("string", "number", "boolean", "null")])


def first_item_agreement(runs: DataFrame, prompt: str, items: str) -> DataFrame:
    """The share of a prompt's runs that begin with its commonest first item, and how many different items its runs have on average."""
    first = F.get(F.col(items), 0)
    counts = runs.groupBy(prompt, first.alias("first")).agg(F.count("*").alias("n"), F.sum(F.size(F.array_distinct(items))).alias("kinds"))
    g = counts.groupBy(prompt).agg(F.sum("n").alias("n_runs"), F.max("n").alias("most"), F.sum("kinds").alias("kinds"))
    return g.select(prompt, "n_runs", (F.col("most") / F.col("n_runs")).alias("agreement"), (F.col("kinds") / F.col("n_runs")).alias("diversity"))


def gate(prompts: DataFrame, min_share: float | None = None, min_validity: float | None = None, threshold: float = THRESHOLD) -> None:
    """Raises AssertionError, naming the worst prompts, where one falls below a least share of agreeing pairs or of valid runs."""
    for column, least in (("share_same", min_share), ("r_v", min_validity)):
        if least is not None:
            low = prompts.where(F.col(column) < least).orderBy(column, "prompt_id").limit(5).select("prompt_id", column).collect()
            if low:
                raise AssertionError(f"{column} under {least} (threshold {threshold}): " + ", ".join(f"{r[0]}: {r[1]:.3f}" for r in low))
