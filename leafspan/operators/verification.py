"""Checks of generations without references, and comparisons of groups of scores: settings, families, annotators, resampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prompts import jaccard

#: Bands of an effect size, of Cliff's delta, and words of a prompt that direct.
EFFECTS = ((0.2, "negligible"), (0.5, "small"), (0.8, "medium"))
DIRECTIVES = {"strong": r"(?i)\b(must|always|never|exactly|only|required)\b", "soft": r"(?i)\b(should|please|could|would|try|prefer)\b"}
#: Poisson(1) cut points: how often a row is drawn in a replicate.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)


def effect_band(d: Column) -> Column:
    out = F.when(F.abs(d) < EFFECTS[0][0], EFFECTS[0][1])
    for limit, name in EFFECTS[1:]:
        out = out.when(F.abs(d) < limit, name)
    return out.otherwise("large")


def _digits(share: float) -> str:
    """The least 8 hexadecimal digits that, over 16^8, are not less than a share."""
    return f"{math.ceil(share * (1 << 32)):08x}"


def _times(u: Column) -> Column:
    """How often a row is drawn by a uniform number in digits."""
    times = F.when(u < _digits(POISSON[0]), 0)
    for i, c in enumerate(POISSON[1:], 1):
        times = times.when(u < _digits(c), i)
    return times.otherwise(len(POISSON))


def bootstrap_mean(df: DataFrame, value: str, key: str, *by: str, replicates: int = 200, level: float = 0.95, seed: int = 0) -> DataFrame:
    """by, n, mean, low, high: a percentile interval of the mean. Each row is drawn a Poisson number of times in each replicate, by a digest of its key,
    so replicates are sums that combine before the shuffle and the same rows give the same interval on any cluster."""
    own = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("v"), F.concat_ws(":", F.lit(seed), F.col(key).cast("string"), F.lit("")).alias("k"))
    each = own.select(*by, "v", "k", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // 4))).alias("b"))
    # A digest holds the uniform numbers of four replicates, 8 digits each. These are in order of value as texts, so they are not made numbers.
    drawn = each.select(*by, "b", "v", F.md5(F.concat("k", "b")).alias("d"))
    drawn = drawn.select(*by, "b", "v", *[F.substring("d", 8 * j + 1, 8).alias(f"u{j}") for j in range(4)])
    drawn = drawn.select(*by, "b", "v", *[_times(F.col(f"u{j}")).alias(f"w{j}") for j in range(4)])
    own = [x for j in range(4) for x in (F.sum(F.col(f"w{j}") * F.col("v")).alias(f"s{j}"), F.sum(f"w{j}").alias(f"w{j}"))]
    sums = drawn.groupBy(*by, "b").agg(*own, F.sum("v").alias("all"), F.count("*").alias("n"))
    four = F.array(*[F.struct((4 * F.col("b") + j).alias("r"), F.col(f"s{j}").alias("s"), F.col(f"w{j}").alias("w")) for j in range(4)])
    sums = sums.select(*by, "all", "n", F.inline(four)).where(F.col("r") < replicates)
    m = F.try_divide("s", "w")
    tail = (1 - level) / 2
    return sums.groupBy(*by).agg(F.max("n").alias("n"), F.max(F.col("all") / F.col("n")).alias("mean"), F.percentile(m, F.lit(tail)).alias("low"), F.percentile(m, F.lit(1 - tail)).alias("high"))


def setting_sweep(runs: DataFrame, prompt: str, setting: str, run: str, items: str) -> DataFrame:
    """Of each prompt over several settings: mean likeness within settings, likeness of the first runs across them, 0.6 and 0.4 of these, and how much the
    settings' likeness ranges over the settings' own range. Pairs are of one setting's runs, and of one run a setting."""
    own = runs.select(F.col(prompt).alias("p"), F.col(setting).alias("t"), F.col(run).alias("r"), F.array_distinct(items).alias("x"))
    a, b = own.alias("a"), own.alias("b")
    inside = a.join(b, (F.col("a.p") == F.col("b.p")) & F.col("a.t").eqNullSafe(F.col("b.t")) & (F.col("a.r") < F.col("b.r"))).groupBy(F.col("a.p").alias("p"), F.col("a.t").alias("t")).agg(F.avg(jaccard(F.col("a.x"), F.col("b.x"))).alias("s"))
    within = own.select("p", "t").distinct().join(inside, ["p", "t"], "left").withColumn("s", F.coalesce("s", F.lit(1.0))).groupBy("p").agg(F.avg("s").alias("within"), (F.max("s") - F.min("s")).alias("spread"), (F.max("t") - F.min("t")).alias("range"), F.count("*").alias("n_settings"))
    first = own.groupBy("p", "t").agg(F.min_by("x", "r").alias("x"))
    c, d = first.alias("c"), first.alias("d")
    across = c.join(d, (F.col("c.p") == F.col("d.p")) & (F.col("c.t") < F.col("d.t"))).groupBy(F.col("c.p").alias("p")).agg(F.avg(jaccard(F.col("c.x"), F.col("d.x"))).alias("across"))
    g = within.join(across, "p", "left").withColumn("across", F.coalesce("across", F.lit(1.0)))
    return g.select(F.col("p").alias(prompt), "n_settings", "within", "across", (0.6 * F.col("within") + 0.4 * F.col("across")).alias("score"), (F.col("spread") / (F.col("range") + 0.01)).alias("sensitivity"))


def named_share(items: Column, name=lambda x: x["name"]) -> Column:
    """The share of a run's items that have a name."""
    return F.coalesce(F.try_divide(F.size(F.filter(items, lambda x: F.coalesce(F.trim(name(x)) != "", F.lit(False)))), F.size(items)), F.lit(0.0))


def schema_guided(runs: DataFrame, prompt: str, share: Column) -> DataFrame:
    """A prompt's mean share of well-formed items, a tenth more where its runs agree: all over 0.8 or all under 0.2."""
    g = runs.groupBy(prompt).agg(F.count("*").alias("n_runs"), F.avg(share).alias("mean_share"), F.min(share).alias("least"), F.max(share).alias("most"))
    agreed = (F.col("least") > 0.8) | (F.col("most") < 0.2)
    return g.select(prompt, "n_runs", "mean_share", F.least(F.lit(1.0), F.col("mean_share") + F.when(agreed, 0.1).otherwise(0.0)).alias("score"))


def group_comparison(scores: DataFrame, group: str, value: str) -> DataFrame:
    """Each group against all others: n, mean, deviation, difference of means, Cohen's d and its band. Groups are compared by sums, so rows are read once."""
    s = scores.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"))
    whole = s.agg(F.sum("n").alias("n_all"), F.sum("s").alias("s_all"), F.sum("ss").alias("ss_all"))
    g = s.crossJoin(whole)  # one row
    n2, s2, q2 = F.col("n_all") - F.col("n"), F.col("s_all") - F.col("s"), F.col("ss_all") - F.col("ss")
    within = lambda q, t, n: q - t * t / n
    pooled = F.sqrt((within(F.col("ss"), F.col("s"), F.col("n")) + within(q2, s2, n2)) / (F.col("n_all") - 2))
    gap = F.col("s") / F.col("n") - F.try_divide(s2, n2)
    d = F.coalesce(F.try_divide(gap, pooled), F.lit(0.0))
    return g.select(group, "n", (F.col("s") / F.col("n")).alias("mean"), gap.alias("difference"), d.alias("d"), effect_band(d).alias("effect"))


def directive_of(text: Column) -> Column:
    """strong, soft, both or none: the kinds of directing words in a prompt."""
    strong, soft = text.rlike(DIRECTIVES["strong"]), text.rlike(DIRECTIVES["soft"])
    return F.when(strong & soft, "both").when(strong, "strong").when(soft, "soft").otherwise("none")


def majority(votes: DataFrame, item: str, choice: str) -> DataFrame:
    """item, choice (the commonest, the least of equals), share, n_votes; null votes do not count."""
    counts = votes.where(F.col(choice).isNotNull()).groupBy(item, choice).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col(choice).alias("choice")))
    g = counts.groupBy(item).agg(best.alias("b"), F.sum("n").alias("n_votes"))
    return g.select(item, F.col("b.choice").alias(choice), (-F.col("b.m") / F.col("n_votes")).alias("share"), "n_votes")


def disagreement(df: DataFrame, key: str, methods: list[str], k: int = 10) -> DataFrame:
    """The k items on which scorers differ most: key, spread; ties by key."""
    values = F.array(*methods)
    return df.select(key, (F.array_max(values) - F.array_min(values)).alias("spread")).where("spread is not null").orderBy(F.desc("spread"), key).limit(k)


def separation(scores: DataFrame, setting: str, side: str, value: str) -> DataFrame:
    """How well each setting tells two sides apart: the gap of their means over the root of their mean variance."""
    g = scores.groupBy(setting).agg(*[f(F.when(c, F.col(value))).alias(n) for c, i in ((F.col(side), 1), (~F.col(side), 2)) for f, n in ((F.avg, f"m{i}"), (F.var_pop, f"v{i}"))])
    return g.select(setting, "m1", "m2", F.coalesce(F.try_divide(F.col("m1") - F.col("m2"), F.sqrt((F.col("v1") + F.col("v2")) / 2)), F.lit(0.0)).alias("separation"))


def decay(means: list[tuple[float, float]], most: float = 5.0) -> tuple[float, float, float]:
    """(start, rate, r2) of start * exp(-rate * t) through the means of a few settings, 0 <= start <= 1 and 0 <= rate <= most: for a rate the best start is
    a quotient of sums; the rate is found by ternary search, which a refined grid begins."""
    def fit(rate: float) -> tuple[float, float]:
        e = [math.exp(-rate * t) for t, _ in means]
        start = min(1.0, max(0.0, sum(x * y for x, (_, y) in zip(e, means)) / sum(x * x for x in e)))
        return sum((start * x - y) ** 2 for x, (_, y) in zip(e, means)), start

    if not means:
        raise ValueError("no settings")
    best = min((most * i / 200 for i in range(201)), key=lambda r: fit(r)[0])
    low, high = max(0.0, best - most / 200), min(most, best + most / 200)
    for _ in range(100):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if fit(a)[0] <= fit(b)[0] else (a, high)
    rate = (low + high) / 2
    error, start = fit(rate)
    middle = sum(y for _, y in means) / len(means)
    total = sum((y - middle) ** 2 for _, y in means)
    return start, rate, 1.0 - error / total if total else 1.0


#: The prior of an early prediction, and what each signal adds: the bounds above and below which it is given.
PRIOR, LEAST_CONFIDENCE, MOST_CONFIDENCE, CONFIDENCE_STEP = 0.7, 0.3, 0.8, 0.1
EARLY_SIGNALS = {
    "validity": {"over": 0.9, "adds": 0.2, "under": 0.5, "takes": -0.3},
    "n_tools": {"over": 3, "adds": -0.2, "up_to": 1, "takes": 0.15},
    "first_agreement": {"over": 0.8, "adds": 0.25, "under": 0.5, "takes": -0.2},
}


def early_prediction(outputs: DataFrame, prompt: str = "prompt_id", names: str = "names") -> DataFrame:
    """For each prompt, from its first outputs: n_outputs, validity, mean_calls, n_tools, first_agreement, predicted consistency and confidence.

    names holds the names called by an output in order; null or empty where it is invalid. Few tools, valid outputs and a common first call speak for
    consistency. Without a valid output the first call agrees in nothing.
    """
    own = outputs.select(F.col(prompt).alias("prompt_id"), F.when(F.size(names) > 0, F.col(names)).alias("names"))
    base = own.groupBy("prompt_id").agg(F.count("*").alias("n_outputs"), F.count("names").alias("n_valid"), F.coalesce(F.avg(F.size("names")), F.lit(0.0)).alias("mean_calls"))
    valid = own.where("names is not null")
    tools = valid.select("prompt_id", F.explode("names").alias("t")).groupBy("prompt_id", "t").agg(F.lit(1).alias("one")).groupBy("prompt_id").agg(F.count("*").alias("n_tools"))
    first = valid.groupBy("prompt_id", F.get("names", F.lit(0)).alias("f")).agg(F.count("*").alias("k")).groupBy("prompt_id").agg((F.max("k") / F.sum("k")).alias("first_agreement"))
    g = base.join(tools, "prompt_id", "left").join(first, "prompt_id", "left").withColumn("validity", F.col("n_valid") / F.col("n_outputs"))
    g = g.withColumn("n_tools", F.coalesce("n_tools", F.lit(0))).withColumn("first_agreement", F.coalesce("first_agreement", F.lit(0.0)))

    def signal(name: str, s: dict) -> Column:
        low = F.col(name) <= s["up_to"] if "up_to" in s else F.col(name) < s["under"]
        return F.when(F.col(name) > s["over"], s["adds"]).when(low, s["takes"])

    signals = [signal(*x) for x in EARLY_SIGNALS.items()]
    total = sum((F.coalesce(s, F.lit(0.0)) for s in signals), F.lit(PRIOR))
    given = sum((s.isNotNull().cast("int") for s in signals), F.lit(0))
    predicted = F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))
    confidence = F.least(F.lit(MOST_CONFIDENCE), LEAST_CONFIDENCE + CONFIDENCE_STEP * given)
    return g.select("prompt_id", "n_outputs", "validity", "mean_calls", "n_tools", "first_agreement", predicted.alias("predicted"), confidence.alias("confidence"))
