"""How alike the documents of a group are: comparison, pairing, scores of prompts, unstable fields, reports.

Input is a table with a prompt, a run and a document (a map from path to leaf; null where the output was invalid). A full outer join of two documents
on their paths is one map_zip_with, so pairs need no second shuffle. Equal documents of a prompt are compacted first: scores are functions of the two
documents, so each distinct pair is scored once and weighted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.leaves import canonical, shown
from ..functions.paths import FieldRules, index_below
from ..functions.tables import fenced, made_once, saved
from . import assign

THRESHOLD = 0.95


def field_scores(a: Column, b: Column, rules: FieldRules | None = None, **how) -> Column:
    """path → (status, a, b, score) for every path of either document; missing and extra score 0. Unordered arrays take with_scores()."""
    rules = rules or FieldRules()
    if rules.unordered:
        raise ValueError("arrays without order are matched by with_scores()")
    return F.map_zip_with(rules.strip(a), rules.strip(b), _scored(rules, how))


def _scored(rules: FieldRules, how: dict):
    def scored(path: Column, x: Column, y: Column) -> Column:
        score = F.when(x.isNull() | y.isNull(), 0.0).otherwise(kernels.field_score(x, y, rules.tolerance_at(path), **how))
        return kernels.bound(score, lambda s: _field(x.isNull(), y.isNull(), shown(x), shown(y), s))

    return scored


def with_scores(df: DataFrame, a: str, b: str, rules: FieldRules | None = None, name: str = "scores", **how) -> DataFrame:
    """df and the field scores of its document columns a and b. An unordered array is one field at its own path: its elements are matched so that the
    worst pair is as good as can be, which a small solver does in Python on costs that are expressions; arrays of different lengths score 0."""
    rules = rules or FieldRules()
    if not rules.unordered:
        return df.withColumn(name, field_scores(F.col(a), F.col(b), rules, **how))
    own = df.withColumn("__a", rules.strip(F.col(a))).withColumn("__b", rules.strip(F.col(b)))
    names = lambda doc: F.array_distinct(F.filter(F.transform(F.map_entries(doc), lambda e: rules.bag_of(e["key"], e["value"])), lambda x: x.isNotNull()))
    own = own.withColumn("__in_a", names(F.col("__a"))).withColumn("__in_b", names(F.col("__b")))
    own = own.withColumn("__fields", F.transform(F.array_union("__in_a", "__in_b"), lambda bag: _bag(F.col("__a"), F.col("__b"), bag, F.col("__in_a"), F.col("__in_b"), rules, how)))
    own = fenced(own).withColumn("__worst", assign.worst_matched(F.to_json(F.col("__fields")["costs"])))  # Spark does not call Python on what holds a lambda
    plain = lambda doc: F.map_filter(doc, lambda k, v: rules.bag_of(k, v).isNull())
    each = F.zip_with("__fields", "__worst", lambda f, w: F.struct(f["bag"].alias("key"), _field(~f["in_a"], ~f["in_b"], f["a"], f["b"], F.when(f["fits"], 1 - w).otherwise(0.0)).alias("value")))
    scores = F.map_concat(F.map_zip_with(plain(F.col("__a")), plain(F.col("__b")), _scored(rules, how)), F.map_from_entries(each))
    return fenced(own.withColumn(name, scores).drop("__a", "__b", "__in_a", "__in_b", "__fields", "__worst"))


def _field(no_a: Column, no_b: Column, a: Column, b: Column, score: Column) -> Column:
    status = F.when(no_b, "missing").when(no_a, "extra").when(score < 1, "changed").otherwise("same")
    return F.struct(status.alias("status"), a.alias("a"), b.alias("b"), score.alias("score"))


def _bag(a: Column, b: Column, bag: Column, in_a: Column, in_b: Column, rules: FieldRules, how: dict) -> Column:
    """An unordered array of two documents: whether both have it in one length, and what matching each element with each costs (1 less the lowest field score)."""

    def elements(doc: Column) -> Column:
        entries = F.filter(F.map_entries(doc), lambda e: index_below(e["key"], bag).isNotNull())
        rest = lambda e: F.concat(F.lit("$"), F.regexp_replace(F.substring(e["key"], F.length(bag) + 1, F.length(e["key"])), r"^\[[0-9]+\]", ""))
        own = lambda i: F.map_from_entries(F.transform(F.filter(entries, lambda e: index_below(e["key"], bag) == i), lambda e: F.struct(rest(e).alias("key"), e["value"].alias("value"))))
        return F.transform(F.sort_array(F.array_distinct(F.transform(entries, lambda e: index_below(e["key"], bag)))), own)

    def score(path: Column, x: Column, y: Column) -> Column:
        at = F.concat(bag, F.lit("[0]"), F.substring(path, F.lit(2), F.length(path)))
        return F.when(x.isNull() | y.isNull(), 0.0).otherwise(kernels.field_score(x, y, rules.tolerance_at(at), **how))

    cost = lambda x, y: 1 - F.coalesce(F.array_min(F.map_values(F.map_zip_with(x, y, score))), F.lit(1.0))
    text = lambda own: F.concat(F.lit("["), F.array_join(F.flatten(F.transform(own, lambda x: F.transform(F.map_values(x), shown))), ", "), F.lit("]"))
    x, y = elements(a), elements(b)
    has_a, has_b = F.array_contains(in_a, bag), F.array_contains(in_b, bag)
    fits = has_a & has_b & (F.size(x) == F.size(y))
    return F.struct(bag.alias("bag"), has_a.alias("in_a"), has_b.alias("in_b"), F.when(has_a, text(x)).alias("a"), F.when(has_b, text(y)).alias("b"), fits.alias("fits"), F.when(fits, F.transform(x, lambda p: F.transform(y, lambda q: cost(p, q)))).otherwise(F.expr("cast(array() as array<array<double>>)")).alias("costs"))


def min_readout(scores: Column) -> Column:
    """The lowest field score; 1 without fields."""
    return F.coalesce(F.array_min(F.transform(F.map_values(scores), lambda s: s["score"])), F.lit(1.0))


def flat_mean_readout(n_a: Column, n_b: Column, scores: Column) -> Column:
    """For flat documents of so many fields: field scores over the larger number."""
    total = F.aggregate(F.map_values(scores), F.lit(0.0), lambda t, s: t + s["score"])
    return F.coalesce(F.try_divide(total, F.greatest(n_a, n_b)), F.lit(1.0))


def path_f1(a: Column, b: Column) -> Column:
    """Harmonic mean of recall over a's paths and precision over b's: (f1, precision, recall)."""
    score = F.aggregate(F.map_values(F.map_zip_with(a, b, lambda _, x, y: kernels.path_kernel(x, y))), F.lit(0.0), lambda t, s: t + s)
    both_empty, one_empty = (F.size(a) == 0) & (F.size(b) == 0), (F.size(a) == 0) | (F.size(b) == 0)

    def of(score: Column) -> Column:
        r, p = score / F.greatest(F.size(a), F.lit(1)), score / F.greatest(F.size(b), F.lit(1))
        f1 = F.when(both_empty, 1.0).when(one_empty | (score == 0), 0.0).otherwise(2 * p * r / (p + r))
        return F.struct(f1.alias("f1"), F.when(both_empty, 1.0).otherwise(p).alias("precision"), F.when(both_empty, 1.0).otherwise(r).alias("recall"))

    return kernels.bound(score, of)


def distinct_documents(docs: DataFrame, prompt: str = "prompt_id", run: str = "run_id", doc: str = "doc") -> DataFrame:
    """Valid documents of each prompt, equal ones once: prompt_id, key, doc, first (least run), n."""
    own = docs.where(F.col(doc).isNotNull()).select(F.col(prompt).alias("prompt_id"), F.col(run).alias("run_id"), F.col(doc).alias("doc"), canonical(F.col(doc)).alias("key")).withColumn("h", F.xxhash64("key"))
    return own.groupBy("prompt_id", "h", "key").agg(F.min("run_id").alias("first"), F.first("doc").alias("doc"), F.count("*").alias("n")).drop("h")


def _pair() -> list[Column]:
    """prompt_id, run_a, run_b, weight of what _crossed() gives."""
    return [F.col("a.prompt_id").alias("prompt_id"), F.col("a.first").alias("run_a"), F.col("b.first").alias("run_b"), F.when(F.col("a.key") == F.col("b.key"), F.expr("a.n * (a.n - 1) div 2")).otherwise(F.col("a.n") * F.col("b.n")).alias("weight")]


def _crossed(own: DataFrame, large: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct documents of each prompt, and (a, a) for what more than one run has. large: prompts that are dealt out, and to how many blocks."""
    dealt = own.join(large, "prompt_id", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("first"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("cell", F.col("blocks") * F.greatest("block", "other") + F.least("block", "other"))
    a, b = dealt.alias("a"), dealt.alias("b")
    once = (F.col("a.block") != F.col("b.block")) | (F.col("a.block") == F.col("a.other"))
    equal = F.col("a.key") == F.col("b.key")  # the same row
    return a.join(b, (F.col("a.prompt_id") == F.col("b.prompt_id")) & (F.col("a.cell") == F.col("b.cell")) & ((F.col("a.first") < F.col("b.first")) | equal & (F.col("a.n") > 1)) & once)


def pairs(docs: DataFrame, rules: FieldRules | None = None, prompt: str = "prompt_id", run: str = "run_id", doc: str = "doc", block: int = 2048, keep: bool = False, **how) -> DataFrame:
    """Distinct pairs of documents of each prompt: prompt_id, run_a < run_b (their first runs), weight (pairs of runs it stands for), scores, min_readout.

    Runs that are equal among themselves form one more pair of score 1, with run_a = run_b. A prompt of more than `block` runs is dealt out: its documents
    go to blocks by hash, and each pair of blocks is a key of its own, so that no task has all pairs of a prompt. keep: with the documents, as doc and other.
    """
    own = distinct_documents(docs, prompt, run, doc)
    large = docs.where(F.col(doc).isNotNull()).groupBy(F.col(prompt).alias("prompt_id")).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1")  # one for each `block` rows at most
    cross = _crossed(own, large)
    cross = cross.select(*_pair(), F.col("a.doc").alias("doc"), F.col("b.doc").alias("other"))
    cross = with_scores(cross, "doc", "other", rules, **how).drop(*(() if keep else ("doc", "other")))
    return cross.withColumn("min_readout", F.when(F.col("run_a") == F.col("run_b"), 1.0).otherwise(min_readout(F.col("scores"))))


def distinct_rows(rows: DataFrame, columns: list[str], prompt: str = "prompt_id", run: str = "run_id") -> DataFrame:
    """Like distinct_documents(), but by the columns that documents are made of: prompt_id, key (these columns), first, n. Written, as it is read often."""
    own = rows.groupBy(F.col(prompt).alias("prompt_id"), *columns).agg(F.min(run).alias("first"), F.count("*").alias("n"))
    return saved(own.select("prompt_id", F.struct(*columns).alias("key"), "first", "n"), "distinct-rows")


def row_pairs(own: DataFrame, make: Callable[[str], Column], rules: FieldRules | None = None, block: int = 2048, **how) -> DataFrame:
    """pairs() of what distinct_rows() gives. make: a document from columns whose names have a prefix. Documents are made and compared once for each two
    kinds of rows that meet in any prompt, not for each pair; rows with equal documents need not be equal. Unordered arrays take pairs()."""
    columns = own.schema["key"].dataType.names
    large = own.groupBy("prompt_id").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1")
    sides = [F.col(f"{x}.key")[c].alias(f"{x}_{c}") for x in "ab" for c in columns]
    scores = kernels.bound(field_scores(make("a_"), make("b_"), rules, **how), lambda s: F.struct(s.alias("scores"), min_readout(s).alias("min_readout")))
    each = made_once(_crossed(own, large).select(*_pair(), *sides), [f"{x}_{c}" for x in "ab" for c in columns], {"made": scores}, "row-pairs")
    return each.select("prompt_id", "run_a", "run_b", "weight", "made.scores", F.when(F.col("run_a") == F.col("run_b"), 1.0).otherwise(F.col("made.min_readout")).alias("min_readout"))


def prompt_scores(docs: DataFrame, scored: DataFrame, threshold: float = THRESHOLD, prompt: str = "prompt_id", doc: str = "doc") -> DataFrame:
    """A row for each prompt: n_runs, n_valid, r_v, n_pairs, c_mean, c_std (of a sample; 0 for one pair), c_adj, share_same; zeros under two valid runs."""
    runs = docs.groupBy(F.col(prompt).alias("prompt_id")).agg(F.count("*").alias("n_runs"), F.count(F.col(doc)).alias("n_valid"))
    w, x = F.col("weight"), F.col("min_readout")
    sums = scored.groupBy("prompt_id").agg(F.sum(w).alias("n_pairs"), F.sum(w * x).alias("sx"), F.sum(w * x * x).alias("sxx"), F.sum(F.when(x >= threshold, w).otherwise(0)).alias("n_same"))
    n = F.col("n_pairs")
    mean = F.coalesce(F.try_divide(F.col("sx"), n), F.lit(0.0))
    spread = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("sxx") - F.col("sx") * F.col("sx") / n, n - 1)))
    r_v = F.col("n_valid") / F.col("n_runs")
    out = runs.join(sums, "prompt_id", "left")
    return out.select("prompt_id", "n_runs", "n_valid", r_v.alias("r_v"), F.coalesce(n, F.lit(0)).alias("n_pairs"), mean.alias("c_mean"), F.coalesce(spread, F.lit(0.0)).alias("c_std"), (r_v * mean).alias("c_adj"), F.coalesce(F.try_divide("n_same", n), F.lit(0.0)).alias("share_same"))


def label(score: Column) -> Column:
    """Fixed cut points of a consistency score."""
    return F.when(score >= 0.95, "highly consistent").when(score >= 0.85, "consistent").when(score >= 0.70, "moderate").when(score >= 0.50, "inconsistent").otherwise("highly inconsistent")


def report(prompts: DataFrame) -> DataFrame:
    """One row: mean consistency over prompts with two valid runs, mean validity and adjusted consistency over all."""
    scored = F.when(F.col("n_valid") >= 2, F.col("c_mean"))
    row = prompts.agg(F.count("*").alias("n_prompts"), F.count(scored).alias("n_scored"), F.coalesce(F.avg(scored), F.lit(0.0)).alias("mean_consistency"), F.coalesce(F.avg("r_v"), F.lit(0.0)).alias("mean_validity"), F.coalesce(F.avg("c_adj"), F.lit(0.0)).alias("mean_adjusted"))
    return row.withColumn("label", label(F.col("mean_consistency")))


def worst(prompts: DataFrame, by: str = "c_mean", k: int = 10) -> DataFrame:
    """The k lowest prompts by a score, ties by prompt."""
    return prompts.where("n_valid >= 2").orderBy(by, "prompt_id").limit(k)


def unstable_fields(scored: DataFrame, threshold: float = THRESHOLD, k: int = 20) -> DataFrame:
    """prompt_id, path, n (pairs where the field scores under the threshold), share_of_pairs; the k most frequent of each prompt."""
    total = scored.groupBy("prompt_id").agg(F.sum("weight").alias("n_pairs"))
    low = scored.where(F.col("scores").isNotNull() & (F.col("min_readout") < threshold)).select("prompt_id", "weight", F.explode("scores").alias("path", "s")).where(F.col("s.score") < threshold)
    counts = low.groupBy("prompt_id", "path").agg(F.sum("weight").alias("n")).join(total, "prompt_id")
    place = F.row_number().over(Window.partitionBy("prompt_id").orderBy(F.desc("n"), "path"))
    return counts.withColumn("place", place).where(F.col("place") <= k).select("prompt_id", "path", "n", (F.col("n") / F.col("n_pairs")).alias("share_of_pairs"))


def values_at(docs: DataFrame, path: str, k: int = 5, prompt: str = "prompt_id", run: str = "run_id", doc: str = "doc") -> DataFrame:
    """The k commonest values at a path in each prompt's valid documents (absent counts too), ties by first run: prompt_id, value, n, place."""
    value = F.coalesce(shown(F.element_at(F.col(doc), path)), F.lit("(absent)"))
    counts = docs.where(F.col(doc).isNotNull()).groupBy(F.col(prompt).alias("prompt_id"), value.alias("value")).agg(F.count("*").alias("n"), F.min(run).alias("first"))
    place = F.row_number().over(Window.partitionBy("prompt_id").orderBy(F.desc("n"), "first"))
    return counts.withColumn("place", place).where(F.col("place") <= k).select("prompt_id", "value", "n", "place")


def centroids(docs: DataFrame, scored: DataFrame, prompt: str = "prompt_id", run: str = "run_id", doc: str = "doc") -> DataFrame:
    """The run of each prompt that is most like the others, first wins: prompt_id, run_id, similarity; a single valid run scores 1."""
    return centroids_of(distinct_documents(docs, prompt, run, doc), scored)


def centroids_of(own: DataFrame, scored: DataFrame) -> DataFrame:
    """centroids() of distinct documents or rows (prompt_id, first, n). A pair's weight holds both its counts, so each pair is read once for its two runs."""
    own = own.select("prompt_id", "first", "n")
    total = own.groupBy("prompt_id").agg(F.sum("n").alias("runs"))
    s = (F.col("weight") * F.col("min_readout")).alias("s")
    both = scored.where("run_a <> run_b").select("prompt_id", F.inline(F.array(F.struct(F.col("run_a").alias("first"), s), F.struct(F.col("run_b").alias("first"), s))))
    sums = both.groupBy("prompt_id", "first").agg(F.sum("s").alias("total"))
    mean = F.when(F.col("runs") == 1, 1.0).otherwise((F.coalesce(F.col("total") / F.col("n"), F.lit(0.0)) + F.col("n") - 1) / (F.col("runs") - 1))
    each = own.join(total, "prompt_id").join(sums, ["prompt_id", "first"], "left").select("prompt_id", "first", F.round(mean, 12).alias("similarity"))
    return each.groupBy("prompt_id").agg(F.min_by("first", F.struct(-F.col("similarity"), F.col("first"))).alias("run_id"), F.max("similarity").alias("similarity"))


def metric_bundle(values: DataFrame, value: str, *by: str, r_v: Column | None = None, steepness: int = 20) -> DataFrame:
    """The benchmark metrics of a group's similarity values; standard deviations are of a population."""
    n, z = F.col("n"), F.floor(F.col("n") / 2)
    g = values.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("c_mean"), F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias("d_std"))
    g = g.withColumn("r_v", F.lit(1.0) if r_v is None else r_v)
    g = g.withColumn("d_std_normalized", F.when(n > 1, F.col("d_std") / (F.sqrt(z * (n - z)) / n)).otherwise(0.0))
    g = g.withColumn("stability_score", F.when(n > 1, F.pow(1 / (1 + 2 * F.col("d_std_normalized")), F.lit(steepness))).otherwise(1.0))
    cv = F.when(F.col("c_mean") > 1e-10, F.col("d_std") / F.col("c_mean")).otherwise(0.0)
    g = g.withColumn("cv", cv).withColumn("c_adj", F.col("r_v") * F.col("c_mean")).withColumn("ranking_score", F.col("r_v") * F.col("c_mean") * F.col("stability_score"))
    g = g.withColumn("consistency_coefficient", F.when(F.col("c_mean") > 1e-10, F.pow(F.col("c_mean") * (1 - F.least(F.pow("cv", F.lit(1.5)), F.lit(1.0))), F.lit(5))).otherwise(0.0))
    g = g.withColumn("normalized_cv", F.least(F.col("cv") * 20, F.lit(1.0))).withColumn("empty_ratio", 1 - F.col("r_v"))
    g = g.withColumn("penalized_consistency_coefficient", F.col("consistency_coefficient") * F.col("r_v")).withColumn("penalized_stability_score", F.col("stability_score") * F.col("r_v"))
    return g.drop("cv")


def inconsistency_rate(values: DataFrame, value: str, *by: str, thresholds: tuple[float, ...] = (0.7, 0.8, 0.9, 0.95)) -> DataFrame:
    """The share of values under each threshold, with mean, population deviation, least and greatest."""
    rates = [F.avg((F.col(value) < t).cast("double")).alias(f"rate_{round(100 * t)}") for t in thresholds]
    return values.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean_score"), F.stddev_pop(value).alias("std_score"), F.min(value).alias("min_score"), F.max(value).alias("max_score"), *rates)
