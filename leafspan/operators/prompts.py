"""Static features of prompts, tool schemas and runs: counts that need no model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vague terms, and patterns of explicit constraints.
VAGUE = ["appropriate", "relevant", "suitable", "proper", "reasonable", "good", "best", "nice", "correct", "right", "some", "few", "several", "many", "various", "etc", "and so on", "and more", "similar", "if needed", "if necessary", "as needed", "if applicable", "maybe", "perhaps", "possibly", "probably"]
CONSTRAINTS = [r"\b[0-9]+\b", r'"[^"]+?"', r"'[^']+?'", r"\bmust\b", r"\bexactly\b", r"\bonly\b", r"\bno more than\b", r"\bat least\b", r"\bat most\b"]


def vague_terms(text: Column) -> Column:
    """The vague terms that a text holds, as substrings of its lower case."""
    low = F.lower(text)
    return F.filter(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in VAGUE]), lambda t: t.isNotNull())


def constraint_count(text: Column) -> Column:
    total = F.lit(0)
    for p in CONSTRAINTS:
        total = total + F.regexp_count(text, F.lit(f"(?i){p}"))
    return total


def key_words(key: Column) -> Column:
    """A field name as lower-case words: camel case and separators split."""
    k = F.regexp_replace(F.regexp_replace(key, "([A-Z]+)([A-Z][a-z])", "$1 $2"), "([a-z0-9])([A-Z])", "$1 $2")
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(k, "[-_.]", " ")), " +", " "))


def format_of(text: Column) -> Column:
    """json, xml, html, yaml or unknown."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    html = t.rlike(r"(?i)^(<!doctype html|<html[\s>])")
    yaml = t.rlike(r"^(---|[A-Za-z_][A-Za-z0-9_-]*:(\s|$)|- )")
    return F.when(F.try_parse_json(t).isNotNull(), "json").when(t.rlike(r"^(<\?xml|<[A-Za-z])") & ~t.rlike(r"(?i)^<!doctype"), "xml").when(html, "html").when(yaml, "yaml").otherwise("unknown")


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; two empty ones are alike, one empty one is not."""
    both, any_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / any_)


def self_consistency(runs: DataFrame, prompt: str, run: str, items: str) -> DataFrame:
    """Mean Jaccard similarity of all pairs of a prompt's item sets, and confidence: 1 less their population deviation, 0.5 for one pair.

    A run has one row. Equal sets of a prompt are compacted, each distinct pair is scored once and weighted, as in consistency.pairs.
    """
    own = runs.where(F.col(prompt).isNotNull() & F.col(run).isNotNull()).groupBy(F.col(prompt).alias("p"), F.array_sort(F.array_distinct(items)).alias("s")).agg(F.count("*").alias("n"))
    a, b = own, own.select(F.col("p").alias("p2"), F.col("s").alias("s2"), F.col("n").alias("n2"))
    weight = F.when(F.col("s") == F.col("s2"), F.expr("n * (n - 1) div 2")).otherwise(F.col("n") * F.col("n2"))
    each = a.join(b, (F.col("p") == F.col("p2")) & (F.col("s") <= F.col("s2"))).select("p", weight.alias("w"), jaccard(F.col("s"), F.col("s2")).alias("j")).where("w > 0")
    w, j = F.col("w"), F.col("j")
    g = each.groupBy("p").agg(F.sum(w).alias("n_pairs"), (F.sum(w * j) / F.sum(w)).alias("consistency"), F.sum(w * j * j).alias("jj"))
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("jj") / F.col("n_pairs") - F.col("consistency") * F.col("consistency")))
    return g.select(F.col("p").alias(prompt), "n_pairs", "consistency", F.when(F.col("n_pairs") > 1, 1 - sd).otherwise(0.5).alias("confidence"))


def transitions(events: DataFrame, group: str, kind: str, *order: str) -> DataFrame:
    """How often each kind follows another within a group."""
    nxt = F.lead(kind).over(Window.partitionBy(group).orderBy(*order))
    return events.select(F.col(kind).alias("from_kind"), nxt.alias("to_kind")).where("to_kind is not null").groupBy("from_kind", "to_kind").agg(F.count("*").alias("n"))


def trajectories(events: DataFrame, group: str, kind: str, *order: str) -> DataFrame:
    """The kinds of each group in order."""
    steps = F.sort_array(F.collect_list(F.struct(*order, kind)))
    return events.groupBy(group).agg(steps.alias("steps")).select(group, F.transform("steps", lambda s: s[kind]).alias("kinds"))


#: Words of a name whose subsets are counted; longer names are paired with those they share a word with.
MOST_WORDS = 10


def name_ambiguity(tools: DataFrame, by: str, name: str) -> DataFrame:
    """The greatest overlap (Jaccard) of the words of two different names in each group. Equal names count once; a group of one name has none.

    No pairs of names are made: of those that have all words of some set, the two shortest overlap at least by that set, and exactly so where it is all they
    share. So the greatest overlap is the greatest over all sets of words that occur, and each set needs only counts by length. Only names of more than
    MOST_WORDS words, whose sets are too many, are joined to others by their words.
    """
    words = F.array_sort(F.array_distinct(F.split(F.lower(name), r"[\s_.-]+")))
    own = tools.where(F.col(by).isNotNull() & F.col(name).isNotNull()).select(F.col(by).alias("g"), F.col(name).alias("name"), words.alias("words"))
    own = own.dropDuplicates(["g", "name"]).withColumn("n", F.size("words"))
    short, long = own.where(F.col("n") <= MOST_WORDS), own.where(F.col("n") > MOST_WORDS)
    masks = short.select("g", "n", "words", F.explode(F.expr("sequence(1, int(pow(2, n)) - 1)")).alias("mask"))
    sets = masks.select("g", "n", F.expr("filter(words, (w, i) -> mask % int(pow(2, i + 1)) >= int(pow(2, i)))").alias("s"))
    sizes = sets.groupBy("g", "s", "n").agg(F.count("*").alias("k")).groupBy("g", "s").agg(F.array_sort(F.collect_list(F.struct("n", "k"))).alias("z"))
    least = F.when(F.col("z")[0]["k"] > 1, 2 * F.col("z")[0]["n"]).otherwise(F.col("z")[0]["n"] + F.get("z", F.lit(1))["n"])
    found = sizes.select("g", (F.size("s") / (least - F.size("s"))).alias("overlap"))
    a, b = long.select("g", "name", "words", F.explode("words").alias("w")).alias("a"), own.select("g", "name", "words", F.explode("words").alias("w")).alias("b")
    paired = a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.w") == F.col("b.w")) & (F.col("a.name") != F.col("b.name")))
    paired = paired.select(F.col("a.g").alias("g"), (F.size(F.array_intersect("a.words", "b.words")) / F.size(F.array_union("a.words", "b.words"))).alias("overlap"))
    none = own.groupBy("g").agg(F.count("*").alias("k")).where("k > 1").select("g", F.lit(0.0).alias("overlap"))
    return none.unionByName(found.dropna()).unionByName(paired).groupBy("g").agg(F.max("overlap").alias("ambiguity")).withColumnRenamed("g", by)
