"""Registered queries of nested documents under every reading: alignment in order, bags, keys as labels, intervals, tree edit distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.leaves import number_leaf, text_leaf
from ..operators import rating, trees
from ..operators.trees import LEAST, Reading
from .queries import _PAIRS, _SIM, _t, order_documents, query


def _turns(spark: SparkSession, sf: str, fields) -> DataFrame:
    """Each conversation as {turns: [...]} beside the next one's: conv_id, a, b. fields(row) names what a turn holds, by the rest of its path."""
    t = _t(spark, sf, "conversations").select("conv_id", "turn", "role", F.length(F.coalesce("text", F.lit(""))).alias("size"))
    rows = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "size"))).alias("rows"))
    entries = F.flatten(F.transform("rows", lambda r, i: F.array(*[F.struct(F.concat(F.lit("$.turns["), i.cast("string"), F.lit("]"), at).alias("key"), leaf.alias("value")) for at, leaf in fields(r)])))
    docs = rows.select("conv_id", F.map_from_entries(entries).alias("doc"))
    after = docs.select((F.col("conv_id") - 1).alias("conv_id"), F.col("doc").alias("b"))
    return docs.select("conv_id", F.col("doc").alias("a")).join(after, "conv_id")


def _objects(r: Column) -> list[tuple[Column, Column]]:
    return [(F.lit(".role"), text_leaf(r["role"])), (F.lit(".size"), number_leaf(r["size"]))]


def _labels(r: Column) -> list[tuple[Column, Column]]:
    """A turn as one text: its role and the size of its text modulo 7."""
    return [(F.lit(""), text_leaf(F.concat(r["role"], F.lit("-"), (r["size"] % 7).cast("string"))))]


#: The tables have at most eight turns; the SQL takes one step for each.
_STEPS = 8
_BASE = f"""t as (select conv_id, row_number() over (partition by conv_id order by turn) - 1 as i, role, length(coalesce(text, '')) as size from conversations),
n as (select conv_id, count(*) as n from t group by 1),
p as (select a.conv_id, least(a.n, b.n) as small, greatest(a.n, b.n) as large, a.n <= b.n as first from n a join n b on b.conv_id = a.conv_id + 1),
l as (select p.conv_id, x.i, y.i as j, {{cost}} as cost from p join t x on x.conv_id = case when first then p.conv_id else p.conv_id + 1 end join t y on y.conv_id = case when first then p.conv_id + 1 else p.conv_id end)"""
_ROLE = f"sqrt({_SIM.format(a='x.role', b='y.role')})"
_LABEL = f"1 - sqrt({_SIM.format(a='x.label', b='y.label')})"
_LABELLED = _BASE.replace("role, length", "role || '-' || (length(coalesce(text, '')) % 7) as label, length")


def _matched(name: str, join: str, in_order: bool) -> str:
    """The cheapest matching of all rows of the smaller side, one row a step: states are the columns taken, or only the last one where order holds."""
    free = "c.j >= s.m" if in_order else "(s.m & (1 << c.j)) = 0"
    taken = "c.j + 1" if in_order else "s.m | (1 << c.j)"
    out = [f"{name}0 as (select conv_id, 0::bigint as m, 0.0::double as cost from p)"]
    for k in range(_STEPS):
        step = f"select s.conv_id, ({taken})::bigint as m, min({join.format(a='s.cost', b='c.cost')}) as cost from {name}{k} s join p using (conv_id) join l c on c.conv_id = s.conv_id and c.i = {k} where p.small > {k} and {free} group by all"
        out.append(f"{name}{k + 1} as ({step} union all select s.* from {name}{k} s join p using (conv_id) where p.small <= {k})")
    return ", ".join([*out, f"{name} as (select conv_id, min(cost) as cost from {name}{_STEPS} group by 1)"])


_SUM, _MAX = "{a} + {b}", "greatest({a}, {b})"
_WORST = "greatest({c}, case when large > small then 1.0 else 0.0 end)"
_MEAN = "({c} + large - small) / large"


@query(f"with {_BASE.format(cost=f'1 - ({_ROLE} + (x.size = y.size)::int) / 2')}, {_matched('o', _SUM, True)} select conv_id, round(1 - {_MEAN.format(c='cost')}, 6) as score from o join p using (conv_id)")
def turns_typed_mean(spark: SparkSession, sf: str) -> DataFrame:
    """The mean readout of conversations of unequal length: turns are aligned in order as well as can be."""
    return trees.profile_scores(_turns(spark, sf, _objects), "a", "b", "typed_mean").select("conv_id", F.round("score", 6).alias("score"))


@query(f"with {_LABELLED.format(cost=_LABEL)}, {_matched('f', _MAX, False)} select conv_id, round(1 - {_WORST.format(c='cost')}, 6) as score from f join p using (conv_id)")
def turns_rank(spark: SparkSession, sf: str) -> DataFrame:
    """The rank profile: turns as a bag, matched so that the worst pair is as good as can be."""
    return trees.profile_scores(_turns(spark, sf, _labels), "a", "b", "rank").select("conv_id", F.round("score", 6).alias("score"))


@query(f"with {_LABELLED.format(cost=_LABEL)}, {_matched('o', _SUM, True)}, {_matched('f', _SUM, False)} select conv_id, round(1 - {_MEAN.format(c='o.cost')}, 6) as low, round(1 - {_MEAN.format(c='f.cost')}, 6) as high from o join f using (conv_id) join p using (conv_id)")
def turns_order_interval(spark: SparkSession, sf: str) -> DataFrame:
    """Between turns as a sequence and as a bag."""
    df = trees.order_interval(_turns(spark, sf, _labels), "a", "b", literals=False, numeric_text=False)
    return df.select("conv_id", F.round("interval.low", 6).alias("low"), F.round("interval.high", 6).alias("high"))


@query(f"with {_LABELLED.format(cost=_LABEL)}, {_matched('o', _SUM, True)}, {_matched('w', _MAX, True)} select conv_id, round(1 - {_WORST.format(c='w.cost')}, 6) as low, round(1 - {_MEAN.format(c='o.cost')}, 6) as high from o join w using (conv_id) join p using (conv_id)")
def turns_exponent_interval(spark: SparkSession, sf: str) -> DataFrame:
    """Between turns as requirements and as an average, for arrays of any length."""
    df = trees.exponent_interval(_turns(spark, sf, _labels), "a", "b", literals=False, numeric_text=False)
    return df.select("conv_id", F.round("interval.low", 6).alias("low"), F.round("interval.high", 6).alias("high"))


@query(f"with {_LABELLED.format(cost=_LABEL)}, {_matched('o', _SUM, True)}, {_matched('f', _SUM, False)} select conv_id, round(1 - (0.3 * {_MEAN.format(c='o.cost')} + 0.7 * {_MEAN.format(c='f.cost')}), 6) as score from o join f using (conv_id) join p using (conv_id)")
def turns_order_blend(spark: SparkSession, sf: str) -> DataFrame:
    """Three tenths sequence, the rest bag."""
    df = trees.with_readouts(_turns(spark, sf, _labels), "a", "b", {"score": Reading(order=0.3)}, literals=False, numeric_text=False)
    return df.select("conv_id", F.round("score", 6).alias("score"))


@query("with t as (select conv_id, row_number() over (partition by conv_id order by turn) as i, role from conversations), n as (select conv_id, count(*) as n from t group by 1), d as (select a.conv_id, sum(case when a.role = b.role then 0 when 'assistant' in (a.role, b.role) then 2 else 1 end) as d from t a join t b on b.conv_id = a.conv_id + 1 and a.i = b.i group by 1) select a.conv_id, (3 * abs(a.n - b.n) + d)::bigint as distance, (4 + 3 * (a.n + b.n))::bigint as nodes, round(1 - (3 * abs(a.n - b.n) + d) / (4 + 3 * (a.n + b.n)), 6) as score from n a join n b on b.conv_id = a.conv_id + 1 join d on d.conv_id = a.conv_id")
def turns_edit_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as trees: a turn is an object of kind m and, under a key of its role, size. Where roles differ one node is renamed, or where their keys stand on either
    side of m one goes and one comes."""
    keyed = lambda r: [(F.lit(".m"), text_leaf(r["role"])), (F.concat(F.lit("."), r["role"]), number_leaf(r["size"]))]
    df = _turns(spark, sf, keyed).select("conv_id", trees.tree_edit_distance(F.col("a"), F.col("b")).alias("e"))
    return df.select("conv_id", "e.distance", "e.nodes", F.round("e.score", 6).alias("score"))


#: Customers beside the next: one key is renamed in two letters, the other wholly.
_FOUR = [("n1", "n2", "cust name", "custname"), ("s1", "s2", "segment", "market"), ("n1", "s2", "cust name", "market"), ("s1", "n2", "segment", "custname")]
_FLAT = ", ".join(f"{_SIM.format(a=a, b=b)} as v{k}, {_SIM.format(a=repr(x), b=repr(y))} / 2 as s{k}" for k, (a, b, x, y) in enumerate(_FOUR))
_COSTS = {"legacy": "1 - (v{k} + s{k}) / 2", "label": "1 - sqrt(v{k} * s{k})"}


def _least(kind: str) -> str:
    c = [_COSTS[kind].format(k=k) for k in range(4)]
    return f"least({c[0]} + {c[1]}, {c[2]} + {c[3]}) / 2"


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "customer")
    doc = lambda name, segment: F.create_map(F.lit(name), text_leaf(F.col("c_name")), F.lit(segment), text_leaf(F.col("c_mktsegment")))
    after = c.select((F.col("c_custkey") - 1).alias("c_custkey"), doc("$.custname", "$.market").alias("b"))
    return c.select("c_custkey", doc("$.cust_name", "$.segment").alias("a")).join(after, "c_custkey")


@query(f"with k as (select a.c_custkey, a.c_name as n1, a.c_mktsegment as s1, b.c_name as n2, b.c_mktsegment as s2 from customer a join customer b on b.c_custkey = a.c_custkey + 1), x as (select c_custkey, {_FLAT} from k) select c_custkey, round(1 - {_least('legacy')}, 6) as score from x")
def renamed_keys_legacy(spark: SparkSession, sf: str) -> DataFrame:
    """The legacy profile: keys are matched by likeness, structure and content added."""
    return trees.profile_scores(_customers(spark, sf), "a", "b", "legacy").select("c_custkey", F.round("score", 6).alias("score"))


@query(f"with k as (select a.c_custkey, a.c_name as n1, a.c_mktsegment as s1, b.c_name as n2, b.c_mktsegment as s2 from customer a join customer b on b.c_custkey = a.c_custkey + 1), x as (select c_custkey, {_FLAT} from k) select c_custkey, 0.0 as low, round(1 - {_least('label')}, 6) as high from x")
def renamed_keys_interval(spark: SparkSession, sf: str) -> DataFrame:
    """Over order, keys and exponent at once: as names none of the renamed keys match; as labels they may."""
    df = trees.assumption_interval(_customers(spark, sf), "a", "b", LEAST, literals=False, numeric_text=False)
    return df.select("c_custkey", F.round("interval.low", 6).alias("low"), F.round("interval.high", 6).alias("high"))


@query(f"with {_PAIRS}, n as (select p, count(*) as n from runs group by 1), g as (select p, count(*) as k, avg(m) as c, avg((fs + ft) / 2) as mean, avg((m >= 0.95)::int) as same, min({{'m': round(m, 9), 'i': ra, 'j': rb}}) as w, max((fs < 0.95)::int) + max((ft < 0.95)::int) as u from scored group by 1) select n.p as prompt_id, n.n as n_outputs, round(c, 6) as agreement_min, round(mean, 6) as agreement_mean, round(same, 6) as share_same, coalesce(k, 0) as n_pairs, case when w.m < 1 then w.i end as i, case when w.m < 1 then w.j end as j, coalesce(u, 0)::bigint as n_unstable from n left join g using (p)")
def order_rating(spark: SparkSession, sf: str) -> DataFrame:
    """Everything about the consistency of each customer's orders in one call."""
    r = rating.rate(order_documents(spark, sf))
    w = F.when(F.col("least_agreeing_pair.min_readout") < 1, F.col("least_agreeing_pair"))
    return r.select("prompt_id", "n_outputs", "agreement_min", "agreement_mean", "share_same", "n_pairs", w["i"].alias("i"), w["j"].alias("j"), F.size("unstable_fields").cast("long").alias("n_unstable"))


@query(f"with o as (select o_orderkey as k, o_orderstatus as s, o_orderpriority as t, lead(o_orderstatus) over w as s2, lead(o_orderpriority) over w as t2 from orders window w as (partition by o_custkey order by o_orderkey)), f as (select k, sqrt({_SIM.format(a='s', b='s2')}) as fs, sqrt({_SIM.format(a='t', b='t2')}) as ft from o where s2 is not null) select k as o_orderkey, least(fs, ft) >= 0.95 as same, round(least(fs, ft), 6) as min_readout, round((fs + ft) / 2, 6) as mean_readout, ((fs < 1)::int + (ft < 1)::int)::bigint as n_differences, case when fs = 1 and ft = 1 then null when round(ft, 9) <= round(fs, 9) then '$.priority' else '$.status' end as worst from f")
def order_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Each order against the customer's next: sameness, both readouts, and the field that differs most."""
    docs = order_documents(spark, sf).withColumn("after", F.lead("doc").over(Window.partitionBy("prompt_id").orderBy("run_id"))).where("after is not null")
    c = rating.compare(docs, "doc", "after")
    return c.select(F.col("run_id").alias("o_orderkey"), "same", "min_readout", "mean_readout", F.size("differences").cast("long").alias("n_differences"), F.get("differences", F.lit(0))["path"].alias("worst"))
