"""Outputs against a reference of their sample, and comparisons across settings and exponents."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import FieldRules
from ..functions.tables import saved
from . import consistency, stats


def against_reference(outputs: DataFrame, references: DataFrame, sample: str, run: str = "run_id", doc: str = "doc", rules: FieldRules | None = None, **how) -> DataFrame:
    """sample, run, scores, min_readout, f1 of every output beside the one reference of its sample. Equal outputs of a sample are scored once."""
    own = outputs.where(F.col(doc).isNotNull()).select(F.col(sample).alias("s"), F.col(run).alias("r"), F.col(doc).alias("b"))
    kept = references.where(F.col(doc).isNotNull()).select(F.col(sample).alias("s"), F.col(doc).alias("a"))
    both = consistency.with_scores(own.join(kept, "s"), "a", "b", rules, **how)
    return both.select(F.col("s").alias(sample), F.col("r").alias(run), "scores", consistency.min_readout(F.col("scores")).alias("min_readout"), consistency.path_f1(F.col("a"), F.col("b"))["f1"].alias("f1"))


def reference_report(scored: DataFrame, value: str, *by: str) -> DataFrame:
    """by, n, mean, std (of a population), least, median, greatest of the scores against references."""
    g = scored.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("greatest"))
    return stats.same_groups(g, stats.medians(scored, value, *by), *by, how="left").select(*by, "n", "mean", "std", "least", "median", "greatest")


def fisher_ratios(df: DataFrame, value: str, side: Column, exponents: tuple[float, ...]) -> DataFrame:
    """exponent, ratio: how well a power of a score tells two sides apart, the squared gap of means over the sum of variances. One aggregate."""
    x = F.explode(F.array(*[F.lit(float(e)) for e in exponents]))
    each = df.where(F.col(value).isNotNull()).select(side.alias("u"), F.col(value).alias("v"), x.alias("exponent")).withColumn("p", F.pow("v", "exponent"))
    one = lambda f, c: f(F.when(c, F.col("p")))
    g = each.groupBy("exponent").agg(one(F.avg, F.col("u")).alias("m1"), one(F.avg, ~F.col("u")).alias("m2"), one(F.var_pop, F.col("u")).alias("v1"), one(F.var_pop, ~F.col("u")).alias("v2"))
    return g.select("exponent", F.coalesce(F.try_divide(F.pow(F.col("m1") - F.col("m2"), F.lit(2)), F.col("v1") + F.col("v2")), F.lit(0.0)).alias("ratio"))


def ranking_stability(scores: DataFrame, setting: str, item: str, value: str) -> DataFrame:
    """a, b, n, rho: rank correlation of the items' scores between each two settings. Ranks are of all items of a setting.

    Scores are written once: ranks are joined to them by value, and a mean that is made again may differ in its last bit and find none.
    """
    own = saved(scores.select(F.col(setting).alias("t"), F.col(item).alias("i"), F.col(value).alias("v")), "scores")
    r = stats.ranked(own, "v", "rank", "t").select("t", "i", "rank")
    a, b = r.alias("a"), r.alias("b")
    both = a.join(b, (F.col("a.i") == F.col("b.i")) & (F.col("a.t") < F.col("b.t")))
    return both.groupBy(F.col("a.t").alias("a"), F.col("b.t").alias("b")).agg(F.count("*").alias("n"), F.corr("a.rank", "b.rank").alias("rho"))


def ward_merges(points: np.ndarray, weights: np.ndarray) -> list[tuple[float, int, int]]:
    """(height, i, j) of Ward's clustering of weighted points, by chains of nearest neighbours with Lance and Williams' update; i and j are points that stand
    for the clusters merged. Quadratic in the points, which are a bounded summary."""
    n = len(points)
    square = ((points[:, None] - points[None]) ** 2).sum(-1)
    distance = 2 * square * np.outer(weights, weights) / np.add.outer(weights, weights)
    np.fill_diagonal(distance, np.inf)
    size, alive, out, chain = weights.astype(float).copy(), np.ones(n, bool), [], []
    while len(out) < n - 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        row = np.where(alive, distance[chain[-1]], np.inf)
        j = int(row.argmin())
        if len(chain) > 1 and row[chain[-2]] <= row[j]:
            j = chain[-2]
        if len(chain) < 2 or j != chain[-2]:
            chain.append(j)
            continue
        i, j = sorted((chain.pop(), chain.pop()))
        out.append((float(np.sqrt(distance[i, j])), i, j))
        others = alive.copy()
        others[[i, j]] = False
        total = size[i] + size[j] + size
        new = ((size[i] + size) * distance[i] + (size[j] + size) * distance[j] - size * distance[i, j]) / total
        alive[j] = False
        size[i] += size[j]
        distance[i, others] = distance[others, i] = new[others]
    return out


def ward_labels(points: np.ndarray, weights: np.ndarray, k: int) -> list[int]:
    """The cluster of each point when the lowest merges leave k; clusters are numbered by their first point."""
    parent = list(range(len(points)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for _, i, j in sorted(ward_merges(points, weights))[: max(0, len(points) - k)]:
        a, b = sorted((root(i), root(j)))
        parent[b] = a
    number: dict[int, int] = {}
    return [number.setdefault(root(i), len(number)) for i in range(len(points))]


def ward(df: DataFrame, features: list[str], k: int = 3, most: int = 1000, seed: int = 0) -> DataFrame:
    """df with cluster: Ward's method over standardised features (a constant one counts nothing), rows with a null left out.

    Up to `most` different rows are clustered as they are. More are first summed up as `most` weighted centres by k-means, on executors, and Ward's method
    runs over those: the driver sees `most` rows whatever the size of the table.
    """
    own = df.dropna(subset=features)
    mean = own.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(features)]).first()
    scaled = [(F.col(f"`{c}`") - F.lit(mean[f"m{i}"] or 0.0)) / F.lit(mean[f"s{i}"] or 1.0) for i, c in enumerate(features)]
    own = own.withColumn("__x", F.array(*scaled))
    points = own.groupBy("__x").agg(F.count("*").alias("n")).limit(most + 1).collect()
    spark = df.sparkSession
    if not points:
        return own.drop("__x").withColumn("cluster", F.lit(None).cast("int"))
    if len(points) <= most:
        points = sorted(points, key=lambda r: r["__x"])
        labels = ward_labels(np.array([r["__x"] for r in points]), np.array([r["n"] for r in points]), k)
        table = spark.createDataFrame([(r["__x"], c) for r, c in zip(points, labels)], "__x array<double>, cluster int")
        return own.join(F.broadcast(table), "__x").drop("__x")
    own = own.withColumn("__v", array_to_vector("__x"))
    model = KMeans(featuresCol="__v", predictionCol="__c", k=most, seed=seed, maxIter=10).fit(own)
    centres = np.array(model.clusterCenters())
    labels = ward_labels(centres, np.maximum(np.array(model.summary.clusterSizes), 1), k)
    table = spark.createDataFrame(list(enumerate(labels)), "__c int, cluster int")
    return model.transform(own).join(F.broadcast(table), "__c").drop("__x", "__v", "__c")


def patterns(df: DataFrame, features: list[str], level: str, sensitivity: str, k: int = 3) -> DataFrame:
    """df with cluster and pattern: standardised features in k clusters by Ward's method, each named by its mean level (0.85, 0.7) and sensitivity (0.15)."""
    own = ward(df, features, k)
    g = own.groupBy("cluster").agg(F.avg(level).alias("__l"), F.avg(sensitivity).alias("__s"))
    name = F.when((F.col("__l") >= 0.85) & (F.col("__s") < 0.15), "stable").when(F.col("__s") >= 0.15, "sensitive").when(F.col("__l") >= 0.7, "moderate").otherwise("unstable")
    return own.join(F.broadcast(g.select("cluster", name.alias("pattern"))), "cluster")  # k rows
