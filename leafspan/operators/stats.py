"""Statistics over scores: effect sizes, rank statistics, agreement, bins, samples. Each returns one row for each group."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def effect_size(df: DataFrame, value: str, side: Column) -> DataFrame:
    """Cohen's d of the rows where side holds against the others, with sample variances."""
    x, yes = F.col(value), side
    one = lambda f, c: f(F.when(c, x))
    g = df.agg(one(F.count, yes).alias("n1"), one(F.count, ~yes).alias("n2"), one(F.avg, yes).alias("m1"), one(F.avg, ~yes).alias("m2"), one(F.var_samp, yes).alias("v1"), one(F.var_samp, ~yes).alias("v2"))
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2))
    return g.select("n1", "n2", ((F.col("m1") - F.col("m2")) / pooled).alias("cohens_d"))


#: Ranges of values that are ranked apart, and the accuracy of their edges.
RANGES, ACCURACY = 64, 1000


def _ranged(counts: DataFrame, value: str) -> DataFrame:
    """counts with bucket: the range of values each falls into. Edges are approximate percentiles of the distinct values, so any edges give right ranks."""
    edges = F.broadcast(counts.agg(F.percentile_approx(value, F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)]), ACCURACY).alias("edges")))  # one row
    bucket = F.size(F.filter(F.coalesce("edges", F.expr("array()")), lambda e: e <= F.col(value)))
    return counts.crossJoin(edges).withColumn("bucket", bucket).drop("edges")


def _before(of: str, *by: str, order: str) -> Column:
    """The sum of a column over the rows before each in its group."""
    return F.coalesce(F.sum(of).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def ranked(df: DataFrame, value: str, name: str = "avg_rank", *by: str) -> DataFrame:
    """Average ranks from counts of distinct values, in each group. Distinct values are ranked within ranges of the value and moved on by the sizes of the
    ranges before, so that no task gets all values of a group."""
    counts = _ranged(df.groupBy(*by, value).agg(F.count("*").alias("ties")), value)
    totals = counts.groupBy(*by, "bucket").agg(F.sum("ties").alias("total"))
    offsets = totals.select(*by, "bucket", _before("total", *by, order="bucket").alias("offset"))  # a row for each range
    own = counts.join(offsets if by else F.broadcast(offsets), [*by, "bucket"])
    rank = F.col("offset") + _before("ties", *by, "bucket", order=value) + (F.col("ties") + 1) / 2
    return df.join(own.select(*by, value, rank.alias(name)), [*by, value])


def rank_auc(df: DataFrame, value: str, positive: Column) -> DataFrame:
    """Area under the ROC curve and Cliff's delta of positive rows against the others: how many of the others lie below each, ties for half. Only counts of
    distinct values are ordered, in ranges; rows are not joined to ranks."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.sum(positive.cast("long")).alias("pos"), F.sum((~positive).cast("long")).alias("neg"))
    counts = _ranged(counts, value)
    totals = counts.groupBy("bucket").agg(F.sum("neg").alias("total"))
    own = counts.join(F.broadcast(totals.select("bucket", _before("total", order="bucket").alias("offset"))), "bucket")
    below = F.col("offset") + _before("neg", "bucket", order=value) + F.col("neg") / 2
    g = own.withColumn("won", F.col("pos") * below).agg(F.sum("won").alias("s"), F.sum("pos").alias("n1"), F.sum("neg").alias("n2"))
    auc = F.col("s") / (F.col("n1") * F.col("n2"))
    g = g.select("n1", "n2", auc.alias("auc"), (2 * auc - 1).alias("cliffs_delta"))
    size = F.abs("cliffs_delta")
    return g.withColumn("band", F.when(size < 0.147, "negligible").when(size < 0.33, "small").when(size < 0.474, "medium").otherwise("large"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    both = ranked(ranked(df.select(x, y).dropna(), x, "rx"), y, "ry")
    return both.agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("spearman"))


def cohens_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two raters beyond chance."""
    cells = df.select(a, b).dropna().groupBy(a, b).agg(F.count("*").alias("k"))
    n = cells.agg(F.sum("k").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("k")).otherwise(0)).alias("same"))
    left, right = cells.groupBy(F.col(a).alias("c")).agg(F.sum("k").alias("ka")), cells.groupBy(F.col(b).alias("c")).agg(F.sum("k").alias("kb"))
    chance = left.join(right, "c").agg(F.coalesce(F.sum(F.col("ka").cast("double") * F.col("kb")), F.lit(0.0)).alias("e"))
    both = n.crossJoin(chance).withColumn("observed", F.col("same") / F.col("n")).withColumn("expected", F.col("e") / (F.col("n").cast("double") * F.col("n")))  # one row each
    return both.select("n", "observed", "expected", F.when(F.col("expected") >= 1, 0.0).otherwise((F.col("observed") - F.col("expected")) / (1 - F.col("expected"))).alias("kappa"))


def mcnemar(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Continuity-corrected statistic of two raters' discordant rows; 0 without any."""
    g = df.agg(F.sum((a & ~b).cast("long")).alias("only_a"), F.sum((b & ~a).cast("long")).alias("only_b"))
    total = F.col("only_a") + F.col("only_b")
    return g.withColumn("statistic", F.when(total == 0, 0.0).otherwise(F.pow(F.abs(F.col("only_a") - F.col("only_b")) - 1, F.lit(2)) / total))


def same_groups(a: DataFrame, b: DataFrame, *by: str, how: str = "inner") -> DataFrame:
    """Two tables with a row of b for each group joined, null groups too; b's other columns come along."""
    own = b.select(*[F.col(f"`{c}`").alias(f"__{c}") for c in by], *[F.col(f"`{c}`") for c in b.columns if c not in by])
    if not by:
        return a.crossJoin(F.broadcast(own))  # one row
    joined = a.join(own, functools.reduce(lambda x, y: x & y, [a[c].eqNullSafe(own[f"__{c}"]) for c in by]), how)
    return joined.drop(*[f"__{c}" for c in by])


def medians(df: DataFrame, value: str, *by: str) -> DataFrame:
    """by, median: exact medians of groups, from places within ranges of the value, so that no task holds all values of a group. A group without values has
    none."""
    counts = _ranged(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("ties")), value)
    totals = counts.groupBy(*by, "bucket").agg(F.sum("ties").alias("total"))
    ranges = totals.select(*by, "bucket", _before("total", *by, order="bucket").alias("offset"), F.sum("total").over(Window.partitionBy(*by)).alias("size"))  # a row for each range
    own = same_groups(counts, ranges, *by, "bucket")
    first = F.col("offset") + _before("ties", *by, "bucket", order=value) + 1
    own = own.withColumn("first", first).withColumn("last", F.col("first") + F.col("ties") - 1)
    low, high = F.floor((F.col("size") + 1) / 2), F.floor(F.col("size") / 2) + 1
    at = lambda k: F.max(F.when((F.col("first") <= k) & (F.col("last") >= k), F.col(value).cast("double")))
    return own.groupBy(*by).agg(((at(low) + at(high)) / 2).alias("median"))


def quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float]:
    """Exact quantiles, interpolated between neighbours: from ranks within ranges of the value, so no task holds all values; the driver gets at most two
    values a share. Empty without rows."""
    own = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("__c"))
    n = own.agg(F.sum("__c").alias("n")).first()["n"]
    if not n:
        return []
    wanted = {q: (math.floor(q * (n - 1)) + 1, math.ceil(q * (n - 1)) + 1) for q in shares}
    # Equal values share a rank: the mean of the first and the last place they take.
    places = ranked(df.where(F.col(value).isNotNull()).select(value), value).distinct().join(own, value)
    half = (F.col("__c") - 1) / 2
    holds = [(F.col("avg_rank") - half <= k) & (F.col("avg_rank") + half >= k) for k in {k for ks in wanted.values() for k in ks}]
    found = places.where(functools.reduce(lambda x, y: x | y, holds)).select(F.col(value).cast("double"), F.col("avg_rank") - half, F.col("avg_rank") + half).collect()
    at = lambda k: next(v for v, low, high in found if low <= k <= high)
    return [at(low) + (q * (n - 1) - (low - 1)) * (at(high) - at(low)) for q, (low, high) in wanted.items()]


def quantile_bins(df: DataFrame, value: str, edges: int = 4) -> Column:
    """The number of the bin, from 1, that a value falls in: edges are exact quantiles, equal ones fall together. Their job runs when this is called."""
    out = F.lit(1)
    for q in sorted(set(quantiles(df, value, [k / edges for k in range(1, edges)]))):
        out = out + (F.col(value) > F.lit(q)).cast("int")
    return out


def stratified_sample(df: DataFrame, band: Column, order: Column, sizes: dict[str, int], key: str) -> DataFrame:
    """The first so many rows of each band, by order, then key. The bound on the place is a literal, so each task keeps only as many of its own rows
    before they are shuffled."""
    place = F.row_number().over(Window.partitionBy("band").orderBy("__order", key))
    wanted = F.element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), F.col("band"))
    first = df.withColumn("band", band).withColumn("__order", order).withColumn("place", place).where(F.col("place") <= max(sizes.values()))
    return first.where(F.col("place") <= wanted).drop("__order")


def entropy(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Smoothed entropy in nats: half a count for each value seen and one unseen, plus the values seen over twice
    the smoothed total."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("c"))
    totals = counts.groupBy(*by).agg(F.sum("c").alias("n"), F.count("*").alias("k"))
    both = counts.join(totals, list(by)) if by else counts.crossJoin(totals)  # one row of totals
    whole = F.col("n") + 0.5 * (F.col("k") + 1)
    p = (F.col("c") + 0.5) / whole
    unseen = 0.5 / whole
    g = both.groupBy(*by, "n", "k").agg(F.sum(-p * F.log(p)).alias("h"))
    return g.select(*by, "n", "k", (F.col("h") - unseen * F.log(unseen) + F.col("k") / (2 * whole)).alias("entropy"))


def fitted_line(df: DataFrame, y: str, x: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def fleiss_kappa(ratings: DataFrame, item: str, choice: str) -> DataFrame:
    """Agreement of several raters beyond chance; ratings has a row for each item and rater. Items with fewer than two ratings do not count."""
    cells = ratings.select(F.col(item).alias("item"), F.col(choice).alias("choice")).dropna().groupBy("item", "choice").agg(F.count("*").alias("k"))
    items = cells.groupBy("item").agg(F.sum("k").alias("m"), F.sum(F.col("k") * F.col("k")).alias("kk")).where("m > 1")
    agreed = items.agg(F.count("*").alias("n_items"), F.avg((F.col("kk") - F.col("m")) / (F.col("m") * (F.col("m") - 1))).alias("observed"))
    shares = cells.join(items.select("item"), "item", "left_semi").groupBy("choice").agg(F.sum("k").cast("double").alias("c"))
    expected = shares.agg((F.sum(F.col("c") * F.col("c")) / (F.sum("c") * F.sum("c"))).alias("expected"))
    both = agreed.crossJoin(expected)  # one row each
    return both.select("n_items", "observed", "expected", F.when(F.col("expected") >= 1, 0.0).otherwise((F.col("observed") - F.col("expected")) / (1 - F.col("expected"))).alias("kappa"))


def holm(tests: DataFrame, p: str, key: str) -> DataFrame:
    """Holm's step-down adjustment over a table of tests: adjusted p values, which never fall with p. The table of tests is small: one window."""
    w = Window.orderBy(p, key)
    n = tests.agg(F.count("*").alias("n_tests"))
    scaled = tests.crossJoin(n).withColumn("scaled", F.least(F.lit(1.0), F.col(p) * (F.col("n_tests") - F.row_number().over(w) + 1)))
    return scaled.withColumn("p_adjusted", F.max("scaled").over(w)).drop("scaled", "n_tests")


def partitions(df: DataFrame, run: str, position: str, value: str) -> DataFrame:
    """Positions that induce the same partition of the runs, hence share one entropy: class (its least position), positions, size.

    A position's partition is written as each run's first run with an equal value.
    """
    first = F.min(run).over(Window.partitionBy(position, value))
    signature = df.select(position, run, first.alias("f")).groupBy(position).agg(F.sort_array(F.collect_list(F.struct(run, "f"))).alias("signature"))
    return signature.groupBy(F.xxhash64("signature").alias("h"), "signature").agg(F.sort_array(F.collect_set(position)).alias("positions")).select(F.element_at("positions", 1).alias("class"), "positions", F.size("positions").alias("size"))
