"""Information over a corpus of records: entropies of sets of columns, scores weighted by them, and tree-factorised weights.

Columns are positions of a flat record and are few; the number of rows is not bounded. A null is a value of its own (the position is absent)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tables import saved


def _entropy_of(counts: DataFrame, *by: str) -> DataFrame:
    """by, n, entropy from a column c of counts: half a count more for each value and for one unseen, and the bias of that many cells."""
    g = counts.groupBy(*by).agg(F.sum("c").alias("n"), F.count("*").alias("k"), F.sum((F.col("c") + 0.5) * F.log(F.col("c") + 0.5)).alias("cl"))
    whole = F.col("n") + 0.5 * (F.col("k") + 1)
    h = F.log(whole) - (F.col("cl") + 0.5 * F.log(F.lit(0.5))) / whole + F.col("k") / (2 * F.greatest(whole, F.lit(1.0)))
    return g.select(*by, "n", F.greatest(h, F.lit(0.0)).alias("entropy"))


def _records(df: DataFrame, columns: list[str]) -> DataFrame:
    """v, c: each distinct record as an array of texts, with how often it occurs. Columns may have any name."""
    cells = F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in columns])
    return df.select(cells.alias("v")).groupBy("v").agg(F.count("*").alias("c"))


def conditional_entropy(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row: the mean over groups of a value's entropy within them."""
    own = df.select(F.col(f"`{group}`").alias("g"), F.col(f"`{value}`").alias("v"))
    return _entropy_of(own.groupBy("g", "v").agg(F.count("*").alias("c")), "g").agg(F.count("*").alias("n_groups"), F.avg("entropy").alias("entropy"))


def joint_entropies(df: DataFrame, columns: list[str]) -> DataFrame:
    """mask, entropy of every set of columns (bit i is column i); the empty set has 0. One pass: rows are counted by value once, then by set.

    There are 2 to the number of columns of sets, so at most 12 columns are taken.
    """
    if len(columns) > 12:
        raise ValueError("at most 12 columns")
    masks = F.explode(F.sequence(F.lit(1), F.lit((1 << len(columns)) - 1)))
    each = _records(df, columns).select("c", "v", masks.alias("mask"))
    chosen = F.array(*[F.col("mask").bitwiseAND(1 << j) != 0 for j in range(len(columns))])
    own = F.transform("v", lambda x, i: F.when(F.get(chosen, i), x))
    counts = each.select("mask", own.alias("v"), "c").groupBy("mask", "v").agg(F.sum("c").alias("c"))
    return _entropy_of(counts, "mask").select("mask", "entropy")


def coverage(pairs: DataFrame, entropies: DataFrame, sigmas: dict[str, Column]) -> DataFrame:
    """pairs with h_agreed, h_all, coverage: how much of the information of all positions two records agree on.

    Positions are taken in falling order of likeness; each step down in likeness counts the entropy of the positions above it. entropies as of
    joint_entropies() over the positions in this order; they are as many as sets of columns and go to every task in a literal map.
    """
    names = [*sigmas]
    table = F.create_map(F.lit(0), F.lit(0.0), *[F.lit(x) for r in entropies.collect() for x in (int(r["mask"]), float(r["entropy"]))])  # 4,096 entries at most
    ordered = F.array_sort(F.array(*[F.struct((-s).alias("neg"), F.lit(1 << i).alias("bit")) for i, s in enumerate(sigmas.values())]))
    own = pairs.withColumn("__o", ordered)
    start = F.struct(F.lit(0.0).alias("h"), F.lit(0).alias("mask"))

    def step(state: Column, i: Column) -> Column:
        mask = state["mask"].bitwiseOR(F.get("__o", i)["bit"])
        width = -F.get("__o", i)["neg"] + F.coalesce(F.get("__o", i + 1)["neg"], F.lit(0.0))
        return F.struct((state["h"] + F.when(width > 0, width * F.element_at(table, mask)).otherwise(0.0)).alias("h"), mask.alias("mask"))

    agreed = F.aggregate(F.sequence(F.lit(0), F.lit(len(names) - 1)), start, step)["h"]
    whole = F.element_at(table, F.lit((1 << len(names)) - 1))
    out = own.withColumn("h_agreed", agreed).withColumn("h_all", whole)
    return out.withColumn("coverage", F.when(F.col("h_all") <= 0, 1.0).otherwise(F.least(F.col("h_agreed") / F.col("h_all"), F.lit(1.0)))).drop("__o")


def prefix_coverage(pairs: DataFrame, key: list[str], records: DataFrame, sigmas: dict[str, Column]) -> DataFrame:
    """key, h_agreed, h_all, coverage as of coverage(), for any number of positions: only the sets that occur, as prefixes of some pair's order of likeness,
    get an entropy.

    A set is known by the exclusive-or of its positions' hashes, and a record's class under it by that of its cells', so that a set's partition refines that
    of the prefix before it without its values being sent. Rows sent are distinct records times sets at most, counted before they are sent; likeness
    that takes few values makes few sets. What two records agree on is added up once for each way of being alike, and joined to the pairs, which are written
    once. key names the columns of pairs that are kept.
    """
    columns = [*sigmas]
    either = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))
    marks = F.array(*[F.xxhash64(F.lit("position"), F.lit(i)) for i in range(len(columns))])
    own = saved(pairs.select(*[F.col(f"`{k}`") for k in key], F.array(*sigmas.values()).alias("__likeness")), "likeness")
    kinds = saved(own.select("__likeness").distinct().withColumn("__kind", F.monotonically_increasing_id()), "kinds")
    ordered = F.array_sort(F.transform("__likeness", lambda s, i: F.struct((-s).alias("neg"), i.alias("i"))))
    ends = F.sequence(F.lit(1), F.lit(len(columns)))

    def prefix(n: Column) -> Column:
        members = F.array_sort(F.transform(F.slice("__o", F.lit(1), n), lambda x: x["i"]))
        width = -F.element_at("__o", n)["neg"] + F.coalesce(F.get("__o", n)["neg"], F.lit(0.0))
        return F.struct(width.alias("width"), either(F.transform(members, lambda i: F.get(marks, i))).alias("set"), members.alias("members"))

    steps = kinds.select("__kind", ordered.alias("__o")).select("__kind", F.explode(F.filter(F.transform(ends, prefix), lambda p: p["width"] > 0)).alias("p")).select("__kind", "p.*")
    spark = records.sparkSession
    whole = spark.range(1).select(either(marks).alias("set"), F.array(*map(F.lit, range(len(columns)))).alias("members"))
    sets = saved(steps.select("set", "members").unionByName(whole).dropDuplicates(["set"]), "prefixes")
    cells = F.array(*[F.xxhash64(F.lit(i), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0"))) for i, c in enumerate(columns)])
    distinct = records.select(cells.alias("cells")).groupBy("cells").agg(F.count("*").alias("c"))
    batches = sets.groupBy(F.pmod("set", F.lit(1024)).alias("batch")).agg(F.collect_list(F.struct("set", "members")).alias("sets"))
    each = distinct.crossJoin(batches).select("cells", "c", F.explode("sets").alias("s"))
    classes = each.select("s.set", either(F.transform("s.members", lambda i: F.get("cells", i))).alias("class"), "c")
    entropies = saved(_entropy_of(classes.groupBy("set", "class").agg(F.sum("c").alias("c")), "set").select("set", "entropy"), "prefix-entropies")
    total = entropies.join(F.broadcast(whole.select("set")), "set").select(F.col("entropy").alias("h_all"))  # one row
    agreed = steps.join(entropies, "set").groupBy("__kind").agg(F.sum(F.col("width") * F.col("entropy")).alias("h_agreed"))
    known = saved(kinds.join(agreed, "__kind", "left").select("__likeness", F.coalesce("h_agreed", F.lit(0.0)).alias("h_agreed")), "agreed")
    out = own.join(known, "__likeness").drop("__likeness").crossJoin(F.broadcast(total))
    return out.withColumn("coverage", F.when(F.col("h_all") <= 0, 1.0).otherwise(F.least(F.col("h_agreed") / F.col("h_all"), F.lit(1.0))))


def information_score(entropies: dict[str, float], sigmas: dict[str, Column]) -> Column:
    """The mean likeness of positions weighted by their entropies; 1 where none has any."""
    weight = sum(entropies[k] for k in sigmas)
    return F.lit(1.0) if weight <= 0 else sum((F.lit(entropies[k] / weight) * s for k, s in sigmas.items()), F.lit(0.0))


def pair_information(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, joint entropy and mutual information of every pair of columns, and (a, a) with a column's own entropy.

    Every distinct record goes to each pair of columns once, in one shuffle that is counted before it is sent.
    """
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.struct(F.get("v", i).alias("x"), F.get("v", j).alias("y")).alias("v")) for i, a in enumerate(columns) for j, b in enumerate(columns) if j >= i]
    counts = _records(df, columns).select("c", F.inline(F.array(*cells))).groupBy("a", "b", "v").agg(F.sum("c").alias("c"))
    h = _entropy_of(counts, "a", "b")
    own = h.where("a = b")
    x, y = own.select("a", F.col("entropy").alias("h_a")), own.select(F.col("a").alias("b"), F.col("entropy").alias("h_b"))
    return h.join(F.broadcast(x), "a").join(F.broadcast(y), "b").select("a", "b", "entropy", F.when(F.col("a") == F.col("b"), F.col("entropy")).otherwise(F.greatest(F.lit(0.0), F.col("h_a") + F.col("h_b") - F.col("entropy"))).alias("mutual"))


TREE = T.StructType([T.StructField("position", T.StringType()), T.StructField("parent", T.StringType()), T.StructField("weight", T.DoubleType())])


def tree_weights(df: DataFrame, columns: list[str]) -> DataFrame:
    """position, parent, weight: the spanning tree of most mutual information, from the column of most entropy; a weight is the entropy given the parent,
    never under that of a constant. The driver sees one number for each pair of columns; ties go to the earlier column."""
    rows = pair_information(df, columns).collect()
    joint = {frozenset((r["a"], r["b"])): r["entropy"] for r in rows}
    shared = {frozenset((r["a"], r["b"])): r["mutual"] for r in rows}
    own = {c: joint[frozenset((c,))] for c in columns} if rows else {}
    if not own:
        return df.sparkSession.createDataFrame([], TREE)
    n = df.count()
    constant = _constant_entropy(n)
    root = max(columns, key=lambda c: own[c])
    tree = [(root, None, own[root])]
    inside = [root]
    while len(inside) < len(columns):
        parent, child = max(((p, c) for p in inside for c in columns if c not in inside), key=lambda e: shared[frozenset(e)])
        tree.append((child, parent, max(joint[frozenset((child, parent))] - own[parent], constant)))
        inside.append(child)
    return df.sparkSession.createDataFrame(tree, TREE)


def run_kinds(cells: DataFrame, run: str, position: str, value: str) -> DataFrame:
    """kind, cells (array of position p and digest v of its value), c: each distinct set of a run's cells and how many runs have it, written. A run's cells
    meet in one row, as a document's leaves do; of cells repeated in a run the least value counts."""
    v = F.col(f"`{value}`").cast("string")
    each = cells.select(F.col(f"`{run}`").alias("run"), F.struct(F.col(f"`{position}`").alias("p"), v.isNull().alias("none"), v.alias("v")).alias("x"))
    runs = each.groupBy("run").agg(F.sort_array(F.collect_list("x")).alias("all"))
    first = F.filter("all", lambda x, i: (i == 0) | ~x["p"].eqNullSafe(F.get("all", i - 1)["p"]))
    own = runs.select(F.transform(first, lambda x: F.struct(x["p"].alias("p"), F.xxhash64(x["v"]).alias("v"))).alias("cells"))
    return saved(own.groupBy("cells").agg(F.count("*").alias("c")).withColumn("kind", F.monotonically_increasing_id()), "run-kinds")


def sparse_pairs(cells: DataFrame, run: str, position: str, value: str) -> DataFrame:
    """a, b (a < b), h_a, h_b, joint, mutual of every pair of positions of documents given as cells (run, position, value), where a position that a run lacks
    has the value "absent". Runs without any cell are not known here.

    Runs with the same cells are counted first. Co-occurring values are counted by a join of the cells of each kind of run; what is absent on one side or both
    follows from the positions' own counts, so the rows joined are the squares of numbers of cells, never runs times pairs of positions. Cells repeated in a
    run count once, by their least value.
    """
    return _kind_pairs(run_kinds(cells, run, position, value))


def _kind_pairs(kinds: DataFrame) -> DataFrame:
    own = kinds.select("kind", "c", F.inline("cells"))
    n = kinds.agg(F.sum("c")).first()[0] or 0
    single = saved(own.groupBy("p", "v").agg(F.sum("c").alias("c")), "values")
    there = single.groupBy("p").agg(F.sum("c").alias("n"))
    absent = there.where(F.col("n") < n).select("p", F.lit(None).cast("long").alias("v"), (F.lit(n) - F.col("n")).alias("c"))
    entropy = saved(_entropy_of(single.unionByName(absent), "p").select("p", "entropy"), "position-entropies").join(there, "p")
    x, y = own.select("kind", "c", F.col("p").alias("a"), F.col("v").alias("va")), own.select("kind", F.col("p").alias("b"), F.col("v").alias("vb"))
    both = saved(x.join(y, "kind").where("a < b").groupBy("a", "b", "va", "vb").agg(F.sum("c").alias("c")), "co-occurring")
    # The parts of sum(c), count and sum((c + 1/2) log(c + 1/2)) over a pair's cells: both there, one alone, neither.
    log = lambda c: (c + 0.5) * F.log(c + 0.5)
    parts = lambda df: df.groupBy("a", "b").agg(F.count("*").alias("k"), F.sum(log(F.col("c"))).alias("cl"), F.sum("c").alias("n"))
    joint = parts(both)

    def alone(one: str, other: str, v: str) -> DataFrame:
        """Of the values of `one` seen with `other`: what their runs without `other` add, beyond the value's own share."""
        met = both.groupBy(one, other, v).agg(F.sum("c").alias("m")).join(single.select(F.col("p").alias(one), F.col("v").alias(v), F.col("c").alias("all")), [one, v])
        left = F.col("all") - F.col("m")
        return met.groupBy("a", "b").agg(F.sum(F.when(left > 0, log(left)).otherwise(0.0) - log(F.col("all"))).alias(f"cl_{one}"), F.sum(F.when(left > 0, 0).otherwise(-1)).alias(f"k_{one}"))

    whole = single.groupBy("p").agg(F.count("*").alias("k"), F.sum(log(F.col("c"))).alias("cl"))
    sides = entropy.join(whole, "p")
    named = lambda s, q: s.select(F.col("p").alias(q), F.col("entropy").alias(f"h_{q}"), F.col("n").alias(f"n_{q}"), F.col("k").alias(f"all_k_{q}"), F.col("cl").alias(f"all_cl_{q}"))
    every = named(sides, "a").join(F.broadcast(named(sides, "b")) if sides.count() <= 100_000 else named(sides, "b"), F.col("a") < F.col("b"))
    out = every.join(joint, ["a", "b"], "left").join(alone("a", "b", "va"), ["a", "b"], "left").join(alone("b", "a", "vb"), ["a", "b"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    neither = F.lit(n) - F.col("n_a") - F.col("n_b") + zero("n")
    k = zero("k") + F.col("all_k_a") + zero("k_a") + F.col("all_k_b") + zero("k_b") + (neither > 0).cast("int")
    cl = F.coalesce("cl", F.lit(0.0)) + F.col("all_cl_a") + F.coalesce("cl_a", F.lit(0.0)) + F.col("all_cl_b") + F.coalesce("cl_b", F.lit(0.0)) + F.when(neither > 0, log(neither)).otherwise(0.0)
    size = F.lit(n) + 0.5 * (k + 1)
    h = F.greatest(F.lit(0.0), F.log(size) - (cl + 0.5 * F.log(F.lit(0.5))) / size + k / (2 * size))
    return out.select("a", "b", "h_a", "h_b", h.alias("joint"), F.greatest(F.lit(0.0), F.col("h_a") + F.col("h_b") - h).alias("mutual"))


def spanning_tree(edges: DataFrame, weight: str = "mutual") -> DataFrame:
    """The edges of the spanning tree (of each component) of greatest weight, ties to the least (a, b): each round every part takes its best edge outward, and
    parts joined by such edges become one, so that there are about as many rounds as the logarithm of the nodes. Nothing is collected but counts."""
    edges = saved(edges.select("a", "b", F.col(weight).alias("w")), "tree-edges")
    part = saved(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("part", F.col("node")), "parts")
    chosen = None
    while True:
        x, y = part.select(F.col("node").alias("a"), F.col("part").alias("pa")), part.select(F.col("node").alias("b"), F.col("part").alias("pb"))
        edges = saved(edges.select("a", "b", "w").join(x, "a").join(y, "b").where("pa <> pb"), "tree-edges")  # what is inside one part is done with
        order = F.struct((-F.col("w")).alias("neg"), "a", "b")
        out = edges.select("pa", "pb", order.alias("e")).union(edges.select("pb", "pa", order))
        best = saved(out.groupBy("pa").agg(F.min(F.struct("e", "pb")).alias("m")).select(F.col("pa").alias("part"), "m.pb", "m.e.a", "m.e.b", (-F.col("m.e.neg")).alias("w")), "best")
        if best.isEmpty():
            return chosen if chosen is not None else edges.select("a", "b", "w")
        new = best.select("a", "b", "w").distinct()
        chosen = saved(new if chosen is None else chosen.union(new).distinct(), "chosen")
        # Each part points at the one its edge leads to; the lesser of two that point at each other is a root. Pointers are then followed, doubling.
        back = best.select(F.col("part").alias("pb"), F.col("pb").alias("back"))
        to = saved(best.select("part", "pb").join(back, "pb").select("part", F.when((F.col("back") == F.col("part")) & (F.col("part") < F.col("pb")), F.col("part")).otherwise(F.col("pb")).alias("to")), "pointers")
        while True:
            jumped = saved(to.join(to.select(F.col("part").alias("to"), F.col("to").alias("next")), "to").select("part", F.col("next").alias("to")), "pointers")
            settled = jumped.join(to, ["part", "to"], "left_anti").isEmpty()
            to = jumped
            if settled:
                break
        part = saved(part.join(to, "part", "left").select("node", F.coalesce("to", "part").alias("part")), "parts")


def sparse_tree_weights(cells: DataFrame, run: str = "run", position: str = "position", value: str = "value") -> DataFrame:
    """position, parent, weight as of tree_weights(), over the sparse positions of documents: made by joins from counts to tree, whatever the number of
    positions. The tree hangs from the position of most entropy (ties to the least name); a position alone is its own root."""
    kinds = run_kinds(cells, run, position, value)
    pairs = saved(_kind_pairs(kinds), "pairs")
    names = kinds.select(F.explode("cells").alias("x")).select(F.col("x.p").alias("position")).distinct()
    own = saved(pairs.select(F.col("a").alias("position"), F.col("h_a").alias("h")).union(pairs.select("b", "h_b")).distinct(), "own")
    n = kinds.agg(F.sum("c")).first()[0] or 0
    constant = _constant_entropy(n)
    if own.isEmpty():
        counts = cells.select(F.col(f"`{position}`").alias("position"), F.col(f"`{value}`").cast("string").alias("v")).groupBy("position", "v").agg(F.count("*").alias("c"))
        return _entropy_of(counts, "position").select("position", F.lit(None).cast("string").alias("parent"), F.col("entropy").alias("weight"))
    tree = spanning_tree(pairs)
    links = saved(tree.select("a", "b").union(tree.select("b", "a")), "links")
    root = own.orderBy(F.desc("h"), "position").limit(1)
    reached = saved(root.select("position", F.lit(None).cast("string").alias("parent")), "reached")
    edge = reached
    while not edge.isEmpty():
        more = edge.select(F.col("position").alias("a")).join(links, "a").select(F.col("b").alias("position"), F.col("a").alias("parent"))
        edge = saved(more.join(reached.select("position"), "position", "left_anti"), "edge")
        reached = saved(reached.unionByName(edge), "reached")
    joint = pairs.select("a", "b", "joint").union(pairs.select("b", "a", "joint"))
    out = names.join(reached, "position", "left").join(own, "position").join(own.select(F.col("position").alias("parent"), F.col("h").alias("h_parent")), "parent", "left")
    out = out.join(joint.select(F.col("a").alias("position"), F.col("b").alias("parent"), "joint"), ["position", "parent"], "left")
    return out.select("position", "parent", F.when(F.col("parent").isNull(), F.col("h")).otherwise(F.greatest(F.col("joint") - F.col("h_parent"), F.lit(constant))).alias("weight"))


def _constant_entropy(n: int) -> float:
    whole = n + 1.0
    p, q = (n + 0.5) / whole, 0.5 / whole
    return -p * math.log(p) - q * math.log(q) + 1 / (2 * whole)
