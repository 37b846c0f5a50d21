"""Quality rules: fixed base rules and a learned decision list over text statistics, all in DataFrame functions.

The statistics of a text are built-in expressions over its words and lines; nothing is exploded or shuffled. Repeated 8-word windows are found
by 64-bit hashes, which are doubled (1, 2, 4, 8 words) instead of sliced, and only texts with an equal pair go on to mark the words covered.

The decision list is learned by sequential covering on the statistics of a bounded sample of labelled rows: rules against the label are grown
one threshold condition at a time by information gain, pruned on held-out rows, and kept while they are precise. The list becomes one ordered
Spark CASE expression, so applying it is a projection.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: The base rules' numbers, white space and symbols.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What rules may test.
FEATURES = ["symbol_share", "dup_line_share", "repeat_share", "word_length", "upper_share", "mark_share", "distinct_share", "n_words"]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *also: str) -> DataFrame:
    """One row for each row of docs: id, the columns of `also`, COUNTS and FEATURES.

    Null text is empty: all counts 0 and all shares 0. Repeated rows stay repeated; a null id stays null; other columns are not read; an empty table gives
    an empty one. A text's words and windows are arrays in one row, so the longest must fit in a task.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    df = docs.select(docs[id_col].alias("id"), *[docs[c].alias(f"also_{c}") for c in also], text.alias("t"))
    keep = ["id", *[f"also_{c}" for c in also]]
    words = F.filter(F.split("t", SPACE), lambda w: w != "")
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = [F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"), F.regexp_count("t", F.lit(r"\p{Lu}")).alias("n_upper"), F.regexp_count("t", F.lit("[!?]")).alias("n_marks")]
    df = df.select(*keep, words.alias("w"), lines.alias("l"), *counts)
    keep += ["n_symbols", "n_upper", "n_marks"]
    df = df.select(*keep, F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"), F.size("l").alias("n_lines"), (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"), F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
    keep += ["n_words", "word_chars", "n_lines", "n_dup_lines"]
    distinct = F.size(F.array_distinct("h")).alias("n_distinct")
    pair = lambda step: F.transform("h", lambda x, i: F.xxhash64(x, F.get("h", i + step)))
    df = df.select(*keep, distinct, pair(1).alias("h"))
    keep.append("n_distinct")
    df = df.select(*keep, pair(2).alias("h"))
    df = df.select(*keep, pair(4).alias("h"))
    df = df.select(*keep, F.slice("h", F.lit(1), F.greatest(F.size("h") - (WINDOW - 1), F.lit(0))).alias("h"))
    order = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.select(*keep, F.when(F.size(F.array_distinct("h")) < F.size("h"), order).alias("s"))
    twin = lambda x, j: F.coalesce(x["h"] == F.get("s", j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("s", j + 1)["h"], F.lit(False))
    at = F.sort_array(F.transform(F.filter("s", twin), lambda x: x["i"]))
    df = df.select(*keep, at.alias("at"))
    covered = F.aggregate(F.transform("at", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("at", j + 1) - p, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)
    df = df.select(*keep, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)).cast("double")
    features = {"symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"), "word_length": share("word_chars", "n_words"), "upper_share": share("n_upper", "word_chars"), "mark_share": share("n_marks", "n_words"), "distinct_share": share("n_distinct", "n_words")}
    df = common.fenced(df)
    return df.select(F.col("id").alias(id_col), *[F.col(f"also_{c}").alias(c) for c in also], *COUNTS, *[features[f].alias(f) for f in FEATURES if f != "n_words"])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.cut if self.above else row[self.feature] <= self.cut

    def column(self) -> Column:
        return F.col(self.feature) > F.lit(self.cut) if self.above else F.col(self.feature) <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


#: A rule is a conjunction that rejects; a list is tried in order.
Rule = tuple[Condition, ...]


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _best(rows: list[tuple[dict, bool]]) -> Condition | None:
    """The threshold condition with the highest information gain for the bad rows, ties by feature and direction."""
    p0 = sum(bad for _, bad in rows)
    n0 = len(rows) - p0
    best: tuple[float, Condition] | None = None
    for feature in FEATURES:
        ordered = sorted((r[feature], bad) for r, bad in rows)
        p = 0
        for i, (value, bad) in enumerate(ordered[:-1]):
            p += bad
            if value == ordered[i + 1][0]:
                continue
            cut, n = (value + ordered[i + 1][0]) / 2, i + 1 - p
            for above, gain in ((False, _gain(p, n, p0, n0)), (True, _gain(p0 - p, n0 - n, p0, n0))):
                if gain > 0 and (best is None or gain > best[0] + 1e-12):
                    best = gain, Condition(feature, above, cut)
    return best[1] if best else None


def _cover(rule: Rule, rows: list[tuple[dict, bool]]) -> list[tuple[dict, bool]]:
    return [x for x in rows if all(c.holds(x[0]) for c in rule)]


def learn_rules(rows: list[tuple[dict, bool]], most: int = 12, longest: int = 4, precision: float = 0.9, least: int = 3) -> list[Rule]:
    """Sequential covering: each rule is grown on two of three of the rows still uncovered, pruned on the third, and kept if it is precise on both."""
    rules: list[Rule] = []
    left = list(rows)
    while len(rules) < most and any(bad for _, bad in left):
        grow, prune = [x for i, x in enumerate(left) if i % 3], [x for i, x in enumerate(left) if i % 3 == 0]
        rule: Rule = ()
        inside = grow
        while len(rule) < longest and any(not bad for _, bad in inside) and any(bad for _, bad in inside):
            found = _best(inside)
            if found is None:
                break
            rule += (found,)
            inside = _cover((found,), inside)

        def worth(r: Rule) -> float:
            hit = _cover(r, prune)
            p = sum(bad for _, bad in hit)
            return (2 * p - len(hit)) / len(hit) if hit else -1.0

        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)), default=())
        hit = _cover(rule, left) if rule else []
        p = sum(bad for _, bad in hit)
        if p < least or p < precision * len(hit):
            break
        rules.append(rule)
        left = [x for x in left if not all(c.holds(x[0]) for c in rule)]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True where no rule rejects: one ordered conditional expression."""
    out = None
    for rule in rules:
        test = F.lit(True)
        for c in rule:
            test = test & c.column()
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def fit_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = 6000, **how) -> list[Rule]:
    """Learn rules against label 0 from the statistics of at most most_rows labelled rows, those whose ids hash lowest.

    Null ids and labels are left out; an id labelled twice counts with its least label, of texts that share an id the least one counts. Without
    rows of both kinds there are no rules, and every text passes.
    """
    known = labels.select(labels[id_col].alias("label_id"), labels[label_col].alias("label")).dropna()
    known = known.groupBy("label_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("label_id"), "label_id").limit(most_rows)
    own = docs.select(docs[id_col].alias("own_id"), docs[text_col].alias("own_text"))
    joined = own.join(F.broadcast(known), own["own_id"] == known["label_id"]).groupBy("own_id", "label").agg(F.min("own_text").alias("own_text"))
    rows = statistics(joined, "own_id", "own_text", "label").orderBy(F.xxhash64("own_id"), "own_id").collect()
    return learn_rules([(r.asDict(), r["label"] == 0) for r in rows], **how)


def apply_rules(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, COUNTS, base_failed and kept (false if base_failed, else the decision list's verdict).

    Null texts are empty and fail the base; repeated rows stay repeated; other columns are not read; without rules only the base decides; an empty table
    gives an empty one. The longest text must fit in a task."""
    df = statistics(docs, id_col, text_col)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    df = df.withColumn("base_failed", failed)
    return df.select(id_col, *COUNTS, "base_failed", (~F.col("base_failed") & verdict(rules)).alias("kept"))
