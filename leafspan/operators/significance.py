"""Tests and agreement of score tables: signed ranks, blocks, dependent correlations, ordinal alpha, errors, collinearity. Each returns one row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import ranked


def wilcoxon(df: DataFrame, x: str, y: str) -> DataFrame:
    """Signed ranks of paired differences, zeros left out: n, w_plus, w_minus, z (normal approximation with ties)."""
    d = df.select((F.col(x) - F.col(y)).alias("d")).where("d <> 0").select("d", F.abs("d").alias("size"))
    r = ranked(d, "size", "rank")
    side = lambda c: F.coalesce(F.sum(F.when(c, F.col("rank"))), F.lit(0.0))
    g = r.agg(F.count("*").alias("n"), side(F.col("d") > 0).alias("w_plus"), side(F.col("d") < 0).alias("w_minus"), F.sum(F.col("rank") * F.col("rank")).alias("squares"))
    return g.select("n", "w_plus", "w_minus", F.try_divide(F.col("w_plus") - F.col("w_minus"), F.sqrt("squares")).alias("z"))


def complete_blocks(df: DataFrame, block: str, treatment: str) -> DataFrame:
    """The rows of blocks that have every treatment once."""
    k = df.agg(F.count_distinct(treatment).alias("k"))
    full = df.groupBy(block).agg(F.count_distinct(treatment).alias("k"), F.count("*").alias("rows")).where("k = rows").join(F.broadcast(k), "k").select(block)
    return df.join(full, block, "left_semi")


def friedman(df: DataFrame, block: str, treatment: str, value: str) -> DataFrame:
    """The Friedman statistic over complete blocks: n_blocks, k, chi2. Ranks are averages within a block; there is no tie correction."""
    w = Window.partitionBy(block)
    own = complete_blocks(df.dropna(subset=[block, treatment, value]), block, treatment)
    rank = F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(block, value)) - 1) / 2
    sums = own.select(block, treatment, rank.alias("rank")).groupBy(treatment).agg(F.sum("rank").alias("r"), F.count("*").alias("n"))
    g = sums.agg(F.max("n").alias("n_blocks"), F.count("*").alias("k"), F.sum(F.col("r") * F.col("r")).alias("rr"))
    n, k = F.col("n_blocks"), F.col("k")
    return g.select("n_blocks", "k", (F.lit(12.0) / (n * k * (k + 1)) * F.col("rr") - 3 * n * (k + 1)).alias("chi2"))


def krippendorff(ratings: DataFrame, item: str, rating: str) -> DataFrame:
    """Ordinal alpha: disagreement is the squared difference of the ratings' places among the distinct ratings. Items with one rating do not count.

    The distinct ratings are few: they alone meet in a window.
    """
    own = ratings.select(F.col(item).alias("item"), F.col(rating).alias("rating")).dropna()
    many = own.groupBy("item").agg(F.count("*").alias("m")).where("m > 1")
    own = own.join(many, "item")
    places = own.select("rating").distinct().select("rating", F.row_number().over(Window.orderBy("rating")).cast("double").alias("r"))
    units = own.join(F.broadcast(places), "rating").groupBy("item").agg(F.count("*").alias("m"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("ss"))
    g = units.agg(F.count("*").alias("n_items"), F.sum("m").cast("double").alias("n"), F.sum(2 * (F.col("m") * F.col("ss") - F.col("s") * F.col("s")) / (F.col("m") - 1)).alias("d"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    observed = F.col("d") / F.col("n")
    expected = 2 * (F.col("n") * F.col("ss") - F.col("s") * F.col("s")) / (F.col("n") * (F.col("n") - 1))
    return g.select("n_items", observed.alias("observed"), expected.alias("expected"), F.when(expected == 0, F.when(observed == 0, 1.0).otherwise(0.0)).otherwise(1 - observed / expected).alias("alpha"))


def williams(df: DataFrame, target: str, a: str, b: str) -> DataFrame:
    """Williams' t for two correlations with one target, on n - 3 degrees of freedom: n, r_a, r_b, r_ab, t."""
    g = df.select(target, a, b).dropna().agg(F.count("*").alias("n"), F.corr(target, a).alias("r_a"), F.corr(target, b).alias("r_b"), F.corr(a, b).alias("r_ab"))
    n, x, y, z = (F.col(c) for c in ("n", "r_a", "r_b", "r_ab"))
    det = 1 - x * x - y * y - z * z + 2 * x * y * z
    mean = (x + y) / 2
    bottom = F.sqrt(2 * (n - 1) / (n - 3) * det + mean * mean * F.pow(1 - z, F.lit(3)))
    return g.withColumn("t", (x - y) * F.sqrt((n - 1) * (1 + z)) / bottom)


def score_errors(df: DataFrame, a: str, b: str) -> DataFrame:
    """How far two score sets lie apart: n, mae, max_error, pearson."""
    d = F.abs(F.col(a) - F.col(b))
    return df.select(a, b).dropna().agg(F.count("*").alias("n"), F.avg(d).alias("mae"), F.max(d).alias("max_error"), F.corr(a, b).alias("pearson"))


def d_prime(df: DataFrame, value: str, side: Column) -> DataFrame:
    """The distance of two groups' means over the root of their mean population variance."""
    one = lambda f, c: f(F.when(c, F.col(value)))
    g = df.agg(one(F.avg, side).alias("m1"), one(F.avg, ~side).alias("m2"), one(F.var_pop, side).alias("v1"), one(F.var_pop, ~side).alias("v2"))
    return g.select("m1", "m2", F.try_divide(F.col("m1") - F.col("m2"), F.sqrt((F.col("v1") + F.col("v2")) / 2)).alias("d_prime"))


def zero_variance(df: DataFrame, group: str, value: str) -> DataFrame:
    """The share of groups of several rows whose values are all equal."""
    g = df.groupBy(group).agg(F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).where("n > 1")
    return g.agg(F.count("*").alias("n_groups"), F.avg((F.col("low") == F.col("high")).cast("double")).alias("zero_variance_ratio"))


def vif(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, vif: the diagonal of the inverse of the features' correlations, which come from one aggregate. A feature in the others' span has none."""
    import numpy as np

    pairs = [(i, j) for i in range(len(features)) for j in range(i)]
    row = df.select(*features).dropna().agg(*[F.corr(features[i], features[j]).alias(f"{i}_{j}") for i, j in pairs]).first()
    r = np.eye(len(features))
    for (i, j), x in zip(pairs, row):
        r[i, j] = r[j, i] = np.nan if x is None else x
    ok = np.isfinite(r).all() and np.linalg.matrix_rank(r) == len(r)
    found = np.diag(np.linalg.inv(r)).tolist() if ok else [None] * len(r)
    return df.sparkSession.createDataFrame(list(zip(features, found)), "feature string, vif double")


def partial_correlation(df: DataFrame, a: str, b: str, given: str) -> DataFrame:
    g = df.select(a, b, given).dropna().agg(F.count("*").alias("n"), F.corr(a, b).alias("r"), F.corr(a, given).alias("ra"), F.corr(b, given).alias("rb"))
    bottom = F.sqrt((1 - F.col("ra") * F.col("ra")) * (1 - F.col("rb") * F.col("rb")))
    return g.select("n", "r", F.try_divide(F.col("r") - F.col("ra") * F.col("rb"), bottom).alias("partial"))


def power_mean(values: Column, p: float) -> Column:
    """Of an array of scores, for p of at most 1: minus infinity is the least, 0 the geometric mean; a zero gives 0 for p up to 0; empty gives 1."""
    if p > 1:
        raise ValueError("p must be at most 1")
    n = F.size(values)
    mean = lambda f: F.aggregate(values, F.lit(0.0), lambda s, x: s + f(x)) / n
    low = F.array_min(values)
    out = low if p == float("-inf") else F.exp(mean(F.ln)) if p == 0 else mean(lambda x: x) if p == 1 else F.pow(mean(lambda x: F.pow(x, F.lit(p))), F.lit(1 / p))
    return F.when(n == 0, 1.0).when((low == 0) & F.lit(p <= 0), 0.0).otherwise(out)


def union_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)
