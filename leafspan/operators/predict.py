"""Consistency foretold: features of prompts and outputs, probe runs, models trained across folds of whole samples, verdicts of judges read back."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels of a judge's scores, weights where it gives no overall one, and its score where it gives nothing.
JUDGED = ("STRUCTURAL_SCORE", "SEMANTIC_SCORE", "OVERALL_SCORE", "CONSISTENCY_SCORE")
STRUCTURAL, SEMANTIC, NEUTRAL = 0.6, 0.4, 0.5
#: Weights and full marks of what probe runs show, and where their risk is high and medium.
LENGTH, ARGUMENTS, VARIED = (0.6, 0.3), (0.3, 0.5), 0.1
PROBE_HIGH, PROBE_MEDIUM = 0.5, 0.2
CONSISTENT = 0.9


def judged(reply: Column) -> Column:
    """A judge's reply as structural, semantic, overall, consistency (null where not given, cut to 0..1) and score: the overall one, else the weighted
    two, else neutral."""
    given = [F.regexp_extract(reply, rf"{k}:\s*([\d.]+)", 1).try_cast("double") for k in JUDGED]
    structural, semantic, overall, consistency = (F.when(g.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), g))) for g in given)
    score = F.coalesce(overall, STRUCTURAL * structural + SEMANTIC * semantic, F.lit(NEUTRAL))
    return F.struct(structural.alias("structural"), semantic.alias("semantic"), overall.alias("overall"), consistency.alias("consistency"), score.alias("score"))


def probed(runs: DataFrame, prompt: str, length: Column, arguments: Column, tools: Column) -> DataFrame:
    """From a prompt's probe runs: predicted agreement, probability of inconsistency, and its level. Lengths and argument counts count by their variation
    (population deviation over mean), tools by whether they differ."""
    cv = lambda x: F.coalesce(F.try_divide(F.stddev_pop(x), F.avg(x)), F.lit(0.0))
    g = runs.groupBy(prompt).agg(F.count("*").alias("n_probes"), cv(length).alias("length_cv"), cv(arguments).alias("argument_cv"), (F.count_distinct(tools) > 1).cast("double").alias("varied"))
    part = lambda c, w: w[0] * F.least(F.col(c) / w[1], F.lit(1.0))
    p = F.least(F.lit(1.0), part("length_cv", LENGTH) + part("argument_cv", ARGUMENTS) + VARIED * F.col("varied"))
    out = g.withColumn("predicted", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("length_cv")))).withColumn("inconsistency", p)
    return out.withColumn("level", F.when(F.col("inconsistency") >= PROBE_HIGH, "high").when(F.col("inconsistency") >= PROBE_MEDIUM, "medium").otherwise("low"))


def text_features(text: Column) -> dict[str, Column]:
    """Counts and flags of a prompt's text."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    n = F.size(words)
    count = lambda p: F.regexp_count(text, F.lit(p))
    flag = lambda p: text.rlike(p).cast("int")
    return {
        "n_chars": F.length(text),
        "n_words": n,
        "mean_word": F.coalesce(F.try_divide(F.aggregate(words, F.lit(0.0), lambda s, w: s + F.length(w)), n), F.lit(0.0)),
        "distinct_ratio": F.coalesce(F.try_divide(F.size(F.array_distinct(F.transform(words, F.lower))), n), F.lit(0.0)),
        "n_sentences": count(r"[.!?]+(\s|$)"),
        "n_questions": count(r"\?"),
        "n_numbers": count(r"[0-9]+(\.[0-9]+)?"),
        "n_quoted": count(r'"[^"]*"'),
        "n_capitals": count(r"[A-Z]"),
        "n_commas": count(","),
        "has_url": flag(r"https?://"),
        "has_list": flag(r"(?m)^\s*([-*]|[0-9]+\.)\s"),
        "has_json": flag(r"[{\[][^{}\[\]]*:[^{}\[\]]*[}\]]"),
    }


def output_factors(runs: DataFrame, prompt: str, length: Column, output: Column) -> DataFrame:
    """How a prompt's outputs vary: coefficient of variation of their length, and the share of different ones."""
    g = runs.groupBy(prompt).agg(F.count("*").alias("n_runs"), F.coalesce(F.try_divide(F.stddev_pop(length), F.avg(length)), F.lit(0.0)).alias("length_cv"), F.count_distinct(output).alias("n_outputs"))
    return g.withColumn("distinct_share", F.col("n_outputs") / F.col("n_runs"))


def fold_of(sample: str, folds: int) -> Column:
    """The fold of a sample: all its rows fall together."""
    return F.pmod(F.xxhash64(F.col(sample)), F.lit(folds)).cast("int")


class Predictor:
    """Boosted trees over standardised features: one predicts agreement, one the probability that it stays at or under the consistent level."""

    def __init__(self, features: list[str], target: str, trees: int = 20, depth: int = 4, seed: int = 0) -> None:
        self.features, self.target, self.trees, self.depth, self.seed = features, target, trees, depth, seed

    def _vectors(self, df: DataFrame) -> DataFrame:
        filled = df.withColumns({f"__of_{f}": F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in self.features})
        return VectorAssembler(inputCols=[f"__of_{f}" for f in self.features], outputCol="__raw").transform(filled)

    def fit(self, df: DataFrame) -> Predictor:
        rows = self._vectors(df.where(F.col(self.target).isNotNull()))
        self.scaler = StandardScaler(inputCol="__raw", outputCol="__x", withMean=True).fit(rows)
        scaled = self.scaler.transform(rows).withColumn("__low", (F.col(self.target) <= CONSISTENT).cast("double"))
        how = {"featuresCol": "__x", "maxIter": self.trees, "maxDepth": self.depth, "seed": self.seed}
        self.regressor = GBTRegressor(labelCol=self.target, predictionCol="__y", **how).fit(scaled)
        self.classifier = GBTClassifier(labelCol="__low", predictionCol="__class", **how).setProbabilityCol("__p").setRawPredictionCol("__m").fit(scaled)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """df with predicted, inconsistency, level."""
        out = self.classifier.transform(self.regressor.transform(self.scaler.transform(self._vectors(df))))
        p = vector_to_array("__p")[1]
        level = F.when(p >= 0.6, "high").when(p >= 0.3, "medium").otherwise("low")
        return out.select(*[F.col(f"`{c}`") for c in df.columns], F.greatest(F.lit(0.0), F.least(F.lit(1.0), "__y")).alias("predicted"), p.alias("inconsistency"), level.alias("level"))

    def importance(self) -> list[tuple[str, float]]:
        """Features by importance, the greatest first."""
        return sorted(zip(self.features, (float(x) for x in self.regressor.featureImportances.toArray())), key=lambda kv: (-kv[1], kv[0]))


def cross_validated(df: DataFrame, features: list[str], target: str, sample: str, folds: int = 5, **how) -> list[dict]:
    """Of each fold, held out whole samples at a time: r2 and rmse of the prediction, and the area under the curve of the classes (None where only one
    occurs)."""
    out = []
    own = df.withColumn("__fold", fold_of(sample, folds))
    for k in range(folds):
        model = Predictor(features, target, **how).fit(own.where(F.col("__fold") != k))
        held = model.predict(own.where(F.col("__fold") == k)).withColumn("low", (F.col(target) <= CONSISTENT).cast("double"))
        grade = RegressionEvaluator(labelCol=target, predictionCol="predicted")
        both = held.select("low").distinct().count() == 2
        area = BinaryClassificationEvaluator(labelCol="low", rawPredictionCol="inconsistency").evaluate(held) if both else None
        out.append({"fold": k, "r2": grade.evaluate(held, {grade.metricName: "r2"}), "rmse": grade.evaluate(held, {grade.metricName: "rmse"}), "auc": area})
    return out


def transfer(df: DataFrame, features: list[str], target: str, model: str, **how) -> list[dict]:
    """Each model's rows held out in turn: how well predictors of all others do on them. Models are few; each is a fit."""
    out = []
    for name in sorted(r[0] for r in df.select(model).distinct().collect()):
        held = Predictor(features, target, **how).fit(df.where(F.col(model) != name)).predict(df.where(F.col(model) == name))
        r2 = RegressionEvaluator(labelCol=target, predictionCol="predicted", metricName="r2").evaluate(held)
        out.append({"model": name, "r2": r2, "band": "strong" if r2 >= 0.5 else "moderate" if r2 >= 0.2 else "weak"})
    return out
