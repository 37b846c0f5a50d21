"""The registered queries of the library over the standard tables, each with the same query in DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.leaves import document, number_leaf, text_leaf
from ..functions.paths import FieldRules
from ..functions.tables import made_once
from ..operators import assign, consistency, nearest, prompts, risk, stats
from ..sources import converters, flatten
from ..streaming import stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def order_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Each order as one generation of its customer's prompt."""
    o = _t(spark, sf, "orders")
    return o.select(F.col("o_custkey").alias("prompt_id"), F.col("o_orderkey").alias("run_id"), document({"$.status": text_leaf(F.col("o_orderstatus")), "$.priority": text_leaf(F.col("o_orderpriority"))}).alias("doc"))


_SIM = "case when {a} = {b} then 1.0 else greatest(0.0, 1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}), 1)::double) end"
_PAIRS = f"""runs as (select o_custkey as p, o_orderkey as r, o_orderstatus as s, o_orderpriority as t from orders),
pairs as (select a.p, a.r as ra, b.r as rb, sqrt({_SIM.format(a="a.s", b="b.s")}) as fs, sqrt({_SIM.format(a="a.t", b="b.t")}) as ft, a.s as sa, b.s as sb, a.t as ta, b.t as tb from runs a join runs b on a.p = b.p and a.r < b.r),
scored as (select *, least(fs, ft) as m from pairs)"""
_PROMPTS = f"""{_PAIRS}, sums as (select p, count(*) as k, avg(m) as c, coalesce(stddev_samp(m), 0) as sd, avg(case when m >= 0.95 then 1.0 else 0.0 end) as same from scored group by p),
prompts as (select n.p, n.n, coalesce(k, 0) as k, coalesce(c, 0) as c, coalesce(sd, 0) as sd, coalesce(same, 0) as same from (select p, count(*) as n from runs group by p) n left join sums using (p))"""


def _order_prompts(spark: SparkSession, sf: str) -> DataFrame:
    docs = order_documents(spark, sf)
    return consistency.prompt_scores(docs, consistency.pairs(docs))


@query(f"with {_PROMPTS} select p as prompt_id, n as n_runs, n as n_valid, 1.0::double as r_v, k as n_pairs, round(c, 6) as c_mean, round(sd, 5) as c_std, round(c, 6) as c_adj, round(same, 6) as share_same from prompts")
def order_consistency(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_order_prompts(spark, sf), "c_mean", "c_adj", "share_same").withColumn("c_std", F.round("c_std", 5))


@query(f"with {_PROMPTS}, r as (select count(*) as n_prompts, count(case when n >= 2 then 1 end) as n_scored, coalesce(avg(case when n >= 2 then c end), 0) as mc, avg(c) as ma from prompts) select n_prompts, n_scored, round(mc, 6) as mean_consistency, 1.0::double as mean_validity, round(ma, 6) as mean_adjusted, case when mc >= 0.95 then 'highly consistent' when mc >= 0.85 then 'consistent' when mc >= 0.7 then 'moderate' when mc >= 0.5 then 'inconsistent' else 'highly inconsistent' end as label from r")
def order_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(consistency.report(_order_prompts(spark, sf)), "mean_consistency", "mean_validity", "mean_adjusted")


@query(f"with {_PROMPTS} select p as prompt_id, n as n_runs, round(c, 6) as c_mean from prompts where n >= 2 order by round(c, 9), p limit 10")
def worst_customers(spark: SparkSession, sf: str) -> DataFrame:
    p = _order_prompts(spark, sf).withColumn("c_mean", F.round("c_mean", 9))
    return rounded(consistency.worst(p).select("prompt_id", "n_runs", "c_mean"), "c_mean")


@query(f"with {_PAIRS}, total as (select p, count(*) as k from scored group by p), low as (select p, '$.status' as path from scored where fs < 0.95 union all select p, '$.priority' from scored where ft < 0.95) select p as prompt_id, path, count(*) as n, round(count(*) / max(k), 6) as share_of_pairs from low join total using (p) group by p, path")
def order_unstable_fields(spark: SparkSession, sf: str) -> DataFrame:
    out = consistency.unstable_fields(consistency.pairs(order_documents(spark, sf)))
    return rounded(out, "share_of_pairs").withColumn("n", F.col("n").cast("long"))


@query("select prompt_id, value, n, place from (select *, row_number() over (partition by prompt_id order by n desc, f) as place from (select o_custkey as prompt_id, o_orderpriority as value, count(*) as n, min(o_orderkey) as f from orders group by 1, 2)) where place <= 5")
def order_values_at_path(spark: SparkSession, sf: str) -> DataFrame:
    return consistency.values_at(order_documents(spark, sf), "$.priority").withColumn("place", F.col("place").cast("long"))


@query(f"with {_PAIRS.replace('a.r < b.r', 'a.r < b.r and b.n = a.n + 1').replace('from orders)', ', row_number() over (partition by o_custkey order by o_orderkey) as n from orders)').replace('as t ,', 'as t,')} select p as prompt_id, ra as run_a, rb as run_b, path, status, a, b, round(score, 6) as score from (select p, ra, rb, '$.status' as path, 'changed' as status, sa as a, sb as b, fs as score from scored where fs < 1 union all select p, ra, rb, '$.priority', 'changed', ta, tb, ft from scored where ft < 1)")
def order_field_differences(spark: SparkSession, sf: str) -> DataFrame:
    """What changed from each order of a customer to the next."""
    docs = order_documents(spark, sf)
    w = Window.partitionBy("prompt_id").orderBy("run_id")
    nxt = docs.withColumn("run_b", F.lead("run_id").over(w)).withColumn("doc_b", F.lead("doc").over(w)).where("run_b is not null")
    each = nxt.select("prompt_id", F.col("run_id").alias("run_a"), "run_b", F.explode(consistency.field_scores(F.col("doc"), F.col("doc_b"))).alias("path", "s")).where("s.status <> 'same'")
    return rounded(each.select("prompt_id", "run_a", "run_b", "path", "s.status", "s.a", "s.b", "s.score"), "score")


_LINES = "select l_orderkey as p, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as r, l_returnflag as f, l_linestatus as s, l_quantity as q from lineitem"
_F1 = "case when a.{0} = b.{0} then 1.0 else 0.0 end"
_QK = "case when a.q = b.q or abs(a.q - b.q) <= 1e-9 * greatest(abs(a.q), abs(b.q)) then 1.0 else 0.9 * greatest(0.0, 1 - 10 * abs(a.q - b.q) / greatest(abs(a.q), abs(b.q))) end"


_LINE = ["flag", "status", "quantity"]


def _line_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Each line as a run of its order, by what its document is made of."""
    run = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("prompt_id"), run.alias("run_id"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_quantity").alias("quantity"))


def _line_document(of: str) -> Column:
    return document({"$.flag": text_leaf(F.col(f"{of}flag")), "$.status": text_leaf(F.col(f"{of}status")), "$.quantity": number_leaf(F.col(f"{of}quantity"))})


def _line_pairs(spark: SparkSession, sf: str, made: dict[str, Column]) -> DataFrame:
    """Pairs of an order's lines: prompt_id and what is made of the two documents, once for each two of lines that are alike."""
    a, b = _line_runs(spark, sf).alias("a"), _line_runs(spark, sf).alias("b")
    both = a.join(b, (F.col("a.prompt_id") == F.col("b.prompt_id")) & (F.col("a.run_id") < F.col("b.run_id")))
    sides = [F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in "ab" for c in _LINE]
    return made_once(both.select("a.prompt_id", *sides), [f"{x}_{c}" for x in "ab" for c in _LINE], made, "line-pairs")


@query(f"with l as ({_LINES}) select a.p as prompt_id, count(*) as n, round(avg(({_F1.format('f')} + {_F1.format('s')} + {_QK}) / 3), 6) as mean_f1 from l a join l b on a.p = b.p and a.r < b.r group by a.p")
def lineitem_pairs_f1(spark: SparkSession, sf: str) -> DataFrame:
    f1 = consistency.path_f1(_line_document("a_"), _line_document("b_"))["f1"]
    return rounded(_line_pairs(spark, sf, {"f1": f1}).groupBy("prompt_id").agg(F.count("*").alias("n"), F.avg("f1").alias("mean_f1")), "mean_f1")


_QE = "case when abs(a.q - b.q) <= 1e-9 * greatest(abs(a.q), abs(b.q)) then 1.0 else 0.0 end"


@query(f"with l as ({_LINES}) select a.p as prompt_id, count(*) as n, round(avg(least({_F1.format('f')}, {_F1.format('s')}, {_QE})), 6) as mean_min, round(avg(({_F1.format('f')} + {_F1.format('s')} + {_QE}) / 3), 6) as mean_mean from l a join l b on a.p = b.p and a.r < b.r group by a.p")
def lineitem_pairs_min(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _line_document("a_"), _line_document("b_")
    read = lambda s: F.struct(consistency.min_readout(s).alias("m"), consistency.flat_mean_readout(F.size(a), F.size(b), s).alias("x"))
    each = _line_pairs(spark, sf, {"s": kernels.bound(consistency.field_scores(a, b), read)}).select("prompt_id", "s.*")
    return rounded(each.groupBy("prompt_id").agg(F.count("*").alias("n"), F.avg("m").alias("mean_min"), F.avg("x").alias("mean_mean")), "mean_min", "mean_mean")


@query(f"with l as ({_LINES}), s as (select a.p, a.r, b.r as r2, least({_F1.format('f')}, {_F1.format('s')}) as m from l a join l b on a.p = b.p and a.r <> b.r), e as (select l.p, l.r, coalesce(round(avg(m), 12), 1.0) as x from l left join s on s.p = l.p and s.r = l.r group by l.p, l.r) select p as prompt_id, run_id, round(similarity, 6) as similarity from (select p, r as run_id, x as similarity, row_number() over (partition by p order by x desc, r) as k from e) where k = 1")
def lineitem_centroid(spark: SparkSession, sf: str) -> DataFrame:
    own = consistency.distinct_rows(_line_runs(spark, sf), ["flag", "status"])
    scored = consistency.row_pairs(own, lambda of: document({f"$.{c}": text_leaf(F.col(f"{of}{c}")) for c in ("flag", "status")}))
    return rounded(consistency.centroids_of(own, scored), "similarity")


@query("select event_id, '$.k' as path, 'number' as vtype, cast(json_extract(props, '$.k') as double) as nval from events")
def event_props_flatten(spark: SparkSession, sf: str) -> DataFrame:
    doc = flatten.flatten_json(F.col("props"))
    return _t(spark, sf, "events").select("event_id", F.explode(doc).alias("path", "x")).select("event_id", "path", "x.vtype", "x.nval")


@query("select event_id, '$.k' as path, cast(json_extract(props, '$.k') as double) as nval from events")
def event_props_variant(spark: SparkSession, sf: str) -> DataFrame:
    doc = flatten.flatten_flat_json(F.col("props"), ["k"])
    return _t(spark, sf, "events").select("event_id", F.explode(doc).alias("path", "x")).select("event_id", "path", "x.nval")


_RAW = "case when event_id % 7 = 0 then 'no answer' when event_id % 11 = 0 then '{}' when event_id % 13 = 0 then '[null]' else props end"


@query(f"select user_id, count(*) as n_runs, count(case when ok then 1 end) as n_valid, round(count(case when ok then 1 end) / count(*), 6) as r_v from (select user_id, json_valid(raw) and raw not in ('{{}}', '[null]') as ok from (select user_id, {_RAW} as raw from events)) group by user_id")
def event_validity(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events").select("user_id", F.expr(_RAW).alias("raw"))
    g = e.withColumn("ok", flatten.is_valid(F.col("raw"))).groupBy("user_id").agg(F.count("*").alias("n_runs"), F.sum(F.col("ok").cast("long")).alias("n_valid"))
    return rounded(g.withColumn("r_v", F.col("n_valid") / F.col("n_runs")), "r_v")


@query("with e as (select user_id as u, event_type as t, event_id as r, value as v, row_number() over (partition by user_id, event_type order by event_id) as n from events) select a.u as user_id, a.t as event_type, count(*) as n, sum(case when abs(a.v - b.v) <= greatest(0.0, 0.5 * greatest(abs(a.v), abs(b.v))) then 1 else 0 end)::bigint as n_same from e a join e b on a.u = b.u and a.t = b.t and b.n = a.n + 1 group by all")
def event_pair_tolerance(spark: SparkSession, sf: str) -> DataFrame:
    """Consecutive values of a user and type within half of each other; the request id is ignored."""
    e = _t(spark, sf, "events")
    doc = document({"$.arguments.value": number_leaf(F.col("value")), "$.arguments.request_id": number_leaf(F.col("event_id"))})
    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    rules = FieldRules(ignore=("request_id",), tolerance={"arguments.value": {"rel": 0.5}})
    e = e.withColumn("doc", doc).withColumn("next", F.lead("doc").over(w)).where("next is not null")
    m = consistency.min_readout(consistency.field_scores(F.col("doc"), F.col("next"), rules))
    return e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum((m >= 0.95).cast("long")).alias("n_same"))


@query("select user_id, count(*) as n, string_agg(event_type, '>' order by ts, event_id) as path from events group by user_id")
def event_trajectory(spark: SparkSession, sf: str) -> DataFrame:
    t = prompts.trajectories(_t(spark, sf, "events"), "user_id", "event_type", "ts", "event_id")
    return t.select("user_id", F.size("kinds").cast("long").alias("n"), F.array_join("kinds", ">").alias("path"))


@query("select from_kind, to_kind, count(*) as n from (select event_type as from_kind, lead(event_type) over (partition by user_id order by ts, event_id) as to_kind from events) where to_kind is not null group by all")
def event_transition(spark: SparkSession, sf: str) -> DataFrame:
    return prompts.transitions(_t(spark, sf, "events"), "user_id", "event_type", "ts", "event_id")


_TEXTS = "select 'p' || p_partkey as id, p_name as s from part union all select 'd' || o_orderkey, strftime(o_orderdate, '%Y-%m-%d') from orders union all select 'n' || l_orderkey || '-' || l_linenumber, case l_linenumber % 6 when 0 then '$' || l_quantity::int when 1 then l_quantity::int || ', ' || l_linenumber when 2 then 'A-' || l_orderkey when 3 then '1,' || l_linenumber || '00' when 4 then 'x => ' || l_linenumber else l_linenumber || ':30' end from lineitem"


@query(f"select id, s, case when regexp_matches(s, '=>') then 'code' when length(s) > 64 or regexp_matches(s, '[A-Za-z]{{4,}}') then null when regexp_matches(s, '^[-+]?([0-9][0-9,]*)?(\\.[0-9]+)?([eE][-+]?[0-9]+)?$') and regexp_matches(s, '[0-9]') then 'number' when regexp_matches(s, '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}:[0-9]{{2}}(:[0-9]{{2}})?)$') then 'datetime' when regexp_matches(s, '^[-+]?[0-9]+(\\.[0-9]+)?((\\s*[,;/]\\s*|\\s+)[-+]?[0-9]+(\\.[0-9]+)?)+$') then 'number_list' when regexp_matches(s, '^[$]?\\s*[-+]?[0-9][0-9,]*(\\.[0-9]+)?\\s*(%|[A-Za-z]{{1,3}})?$') then 'amount' when regexp_matches(s, '^[A-Za-z]{{0,3}}[-_#]?[0-9][0-9A-Za-z_.:-]*$') then 'identifier' end as class from ({_TEXTS})")
def literal_class_texts_all(spark: SparkSession, sf: str) -> DataFrame:
    """With the dates of all orders."""
    part, orders, lines = _t(spark, sf, "part"), _t(spark, sf, "orders"), _t(spark, sf, "lineitem")
    a = part.select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("s"))
    b = orders.select(F.concat(F.lit("d"), "o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd"))
    made = F.expr("case l_linenumber % 6 when 0 then '$' || cast(l_quantity as int) when 1 then cast(l_quantity as int) || ', ' || l_linenumber when 2 then 'A-' || l_orderkey when 3 then '1,' || l_linenumber || '00' when 4 then 'x => ' || l_linenumber else l_linenumber || ':30' end")
    c = lines.select(F.concat(F.lit("n"), "l_orderkey", F.lit("-"), "l_linenumber"), made)
    return a.union(b).union(c).withColumn("class", kernels.literal_class(F.col("s")))


@query("select l_orderkey, l_linenumber, round(case when l_linenumber % 3 = 0 then 0.0 else 1.0 end, 6) as score from lineitem")
def numeric_string_equal(spark: SparkSession, sf: str) -> DataFrame:
    """A quantity against its text, which for every third line is off by one."""
    x = _t(spark, sf, "lineitem")
    text = F.when(F.col("l_linenumber") % 3 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")).cast("decimal(12,2)").cast("string")
    rows = x.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("number"), text.alias("text"))
    scored = made_once(rows, ["number", "text"], {"score": kernels.field_score(number_leaf(F.col("number")), text_leaf(F.col("text")))}, "number-texts")
    return rounded(scored.select("l_orderkey", "l_linenumber", "score"), "score")


@query(f"select a.p_partkey as a, b.p_partkey as b, round({_SIM.format(a='a.p_name', b='b.p_name')}, 6) as similarity from part a join part b on b.p_partkey = a.p_partkey + 1")
def char_sim_names(spark: SparkSession, sf: str) -> DataFrame:
    p = _t(spark, sf, "part").select(F.col("p_partkey").alias("a"), F.col("p_name").alias("x"))
    q = p.select((F.col("a") - 1).alias("a"), F.col("a").alias("b"), F.col("x").alias("y"))
    return rounded(p.join(q, "a").select("a", "b", kernels.char_similarity(F.col("x"), F.col("y")).alias("similarity")), "similarity")


@query("with p as (select a.vec_id as a, b.vec_id as b, round(greatest(0.0, list_cosine_similarity(a.embedding::double[], b.embedding::double[])), 6) as similarity from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id where a.vec_id % 20 = 0) select a, b, similarity from (select *, row_number() over (partition by a order by similarity desc, b) as k from p) where k <= 3")
def embedding_cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The three nearest vectors of the same label for every twentieth vector."""
    return _nearest(spark, sf, same_label=True)


@query(ORACLES["embedding_cosine_topk"].replace("a.label = b.label and ", ""))
def embedding_cosine_topk_all(spark: SparkSession, sf: str) -> DataFrame:
    """The three nearest of all vectors for every twentieth vector."""
    return _nearest(spark, sf, same_label=False)


def _nearest(spark: SparkSession, sf: str, same_label: bool) -> DataFrame:
    e = _t(spark, sf, "embeddings")
    a = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"), "label")
    b = e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"), "label")
    return rounded(nearest.most_alike(a, b, 3, "label" if same_label else None), "similarity")


_METRIC = "select c_mktsegment as model, year(o_orderdate) as temperature, o_orderkey as sample_id, 1 - o_totalprice / 600000.0 as score from orders join customer on o_custkey = c_custkey"


def _metric_table(spark: SparkSession, sf: str) -> DataFrame:
    o, c = _t(spark, sf, "orders"), _t(spark, sf, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("model"), F.year("o_orderdate").alias("temperature"), F.col("o_orderkey").alias("sample_id"), (1 - F.col("o_totalprice") / 600000.0).alias("score"))


@query(f"with g as (select model, temperature, count(score) as n, avg(score) as c_mean, stddev_pop(score) as d_std from ({_METRIC}) group by all), h as (select *, case when n > 1 then d_std / (sqrt(floor(n / 2) * (n - floor(n / 2))) / n) else 0 end as dn, d_std / c_mean as cv from g) select model, temperature, n, round(c_mean, 6) as c_mean, round(d_std, 6) as d_std, round(dn, 6) as d_std_normalized, round(pow(1 / (1 + 2 * dn), 20), 6) as stability_score, round(c_mean * pow(1 / (1 + 2 * dn), 20), 6) as ranking_score, round(pow(c_mean * (1 - least(pow(cv, 1.5), 1.0)), 5), 6) as consistency_coefficient, round(least(cv * 20, 1.0), 6) as normalized_cv from h")
def metric_bundle(spark: SparkSession, sf: str) -> DataFrame:
    g = consistency.metric_bundle(_metric_table(spark, sf), "score", "model", "temperature")
    cols = ["c_mean", "d_std", "d_std_normalized", "stability_score", "ranking_score", "consistency_coefficient", "normalized_cv"]
    return rounded(g.select("model", F.col("temperature").cast("long").alias("temperature"), "n", *cols), *cols)


@query(f"select model, temperature, count(*) as n, round(avg(score), 6) as mean_score, round(stddev_pop(score), 6) as std_score, round(min(score), 6) as min_score, round(max(score), 6) as max_score, {', '.join(f'round(avg(case when score < {t / 100} then 1.0 else 0.0 end), 6) as rate_{t}' for t in (70, 80, 90, 95))} from ({_METRIC}) group by all")
def inconsistency_rate(spark: SparkSession, sf: str) -> DataFrame:
    g = consistency.inconsistency_rate(_metric_table(spark, sf), "score", "model", "temperature")
    return rounded(g.withColumn("temperature", F.col("temperature").cast("long")), "mean_score", "std_score", "min_score", "max_score", "rate_70", "rate_80", "rate_90", "rate_95")


@query(f"select coalesce(model, '(all)') as model, coalesce(temperature::varchar, '(all)') as temperature, count(*) as n, round(avg(case when score < 0.7 then 1.0 else 0.0 end), 6) as rate from ({_METRIC}) group by grouping sets ((model, temperature), (model), (temperature))")
def inconsistency_rate_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The rate by model and temperature, and both margins."""
    m = _metric_table(spark, sf).withColumn("t", F.col("temperature").cast("string"))
    g = m.groupingSets([[F.col("model"), F.col("t")], [F.col("model")], [F.col("t")]], F.col("model"), F.col("t")).agg(F.count("*").alias("n"), F.avg((F.col("score") < 0.7).cast("double")).alias("rate"))
    return rounded(g.select(F.coalesce("model", F.lit("(all)")).alias("model"), F.coalesce("t", F.lit("(all)")).alias("temperature"), "n", "rate"), "rate")


_SPLIT = "select o_totalprice as v, o_orderpriority in ('1-URGENT', '2-HIGH') as y from orders"


@query(f"select count(case when y then v end) as n1, count(case when not y then v end) as n2, round((avg(case when y then v end) - avg(case when not y then v end)) / sqrt(((count(case when y then v end) - 1) * var_samp(case when y then v end) + (count(case when not y then v end) - 1) * var_samp(case when not y then v end)) / (count(*) - 2)), 6) as cohens_d from ({_SPLIT})")
def effect_size(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.effect_size(_t(spark, sf, "orders"), "o_totalprice", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")), "cohens_d")


@query(f"with r as (select y, rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0 as r from ({_SPLIT})), s as (select sum(case when y then r end) as s, sum(y::int)::bigint as n1, sum((not y)::int)::bigint as n2 from r), u as (select n1, n2, (s - n1 * (n1 + 1) / 2) / (n1::double * n2) as auc from s) select n1, n2, round(auc, 6) as auc, round(2 * auc - 1, 6) as cliffs_delta, case when abs(2 * auc - 1) < 0.147 then 'negligible' when abs(2 * auc - 1) < 0.33 then 'small' when abs(2 * auc - 1) < 0.474 then 'medium' else 'large' end as band from u")
def auc_rank(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.rank_auc(_t(spark, sf, "orders"), "o_totalprice", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")), "auc", "cliffs_delta")


@query("with r as (select rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0 as x, rank() over (order by l_extendedprice) + (count(*) over (partition by l_extendedprice) - 1) / 2.0 as y from lineitem) select count(*) as n, round(corr(x, y), 6) as spearman from r")
def spearman(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.spearman(_t(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"), "spearman")


@query("with q as (select quantile_cont(c_acctbal, 0.25) as a, quantile_cont(c_acctbal, 0.5) as b, quantile_cont(c_acctbal, 0.75) as c from customer) select 1 + (c_acctbal > a)::int + (c_acctbal > b)::int + (c_acctbal > c)::int as bin, count(*) as n, round(avg(c_acctbal), 6) as mean_value from customer, q group by 1")
def quantile_bins(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "customer")
    return rounded(c.groupBy(stats.quantile_bins(c, "c_acctbal").alias("bin")).agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("mean_value")), "mean_value")


@query("select o_orderkey, band from (select o_orderkey, band, row_number() over (partition by band order by o_orderkey * 7919 % 10007, o_orderkey) as k from (select o_orderkey, case when o_totalprice < 100000 then 'low' when o_totalprice < 300000 then 'mid' else 'high' end as band from orders)) where k <= case band when 'low' then 30 when 'mid' then 40 else 30 end")
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    band = F.when(F.col("o_totalprice") < 100000, "low").when(F.col("o_totalprice") < 300000, "mid").otherwise("high")
    s = stats.stratified_sample(_t(spark, sf, "orders"), band, F.col("o_orderkey") * 7919 % 10007, {"low": 30, "mid": 40, "high": 30}, "o_orderkey")
    return s.select("o_orderkey", "band")


@query("with r as (select user_id as p, strftime(ts, '%Y-%m-%d') as r, list_distinct(list(event_type)) as s from events group by 1, 2), j as (select a.p, len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) as j from r a join r b on a.p = b.p and a.r < b.r) select p as user_id, count(*) as n_pairs, round(avg(j), 6) as consistency, round(case when count(*) > 1 then 1 - stddev_pop(j) else 0.5 end, 6) as confidence from j group by p")
def self_consistency_jaccard_all(spark: SparkSession, sf: str) -> DataFrame:
    """Every user's days as runs, the event types of a day as its set of tools."""
    e = _t(spark, sf, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.collect_set("event_type").alias("items"))
    return rounded(prompts.self_consistency(e, "user_id", "day", "items"), "consistency", "confidence")


@query("select o_orderstatus, count(*) as n, round(regr_slope(o_totalprice, k), 4) as slope, round(regr_intercept(o_totalprice, k), 4) as intercept, round(regr_r2(o_totalprice, k), 6) as r2 from orders join (select l_orderkey, count(*) as k from lineitem group by 1) on l_orderkey = o_orderkey group by 1")
def linear_bound(spark: SparkSession, sf: str) -> DataFrame:
    k = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("k"))
    o = _t(spark, sf, "orders").join(k, F.col("o_orderkey") == F.col("l_orderkey"))
    return rounded(stats.fitted_line(o, "o_totalprice", "k", "o_orderstatus"), "r2").withColumns({c: F.round(c, 4) for c in ("slope", "intercept")})


_RATERS = "select quality = 1 as a, n_chars >= 1000 as b from labels join documents using (doc_id)"


def _raters(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "labels").join(_t(spark, sf, "documents"), "doc_id").select((F.col("quality") == 1).alias("a"), (F.col("n_chars") >= 1000).alias("b"))


@query(f"with g as (select count(*) as n, avg((a = b)::int) as o, avg(a::int) * avg(b::int) + (1 - avg(a::int)) * (1 - avg(b::int)) as e from ({_RATERS})) select n, round(o, 6) as observed, round(e, 6) as expected, round(case when e >= 1 then 0 else (o - e) / (1 - e) end, 6) as kappa from g")
def cohens_kappa(spark: SparkSession, sf: str) -> DataFrame:
    k = stats.cohens_kappa(_raters(spark, sf), "a", "b")
    return rounded(k.withColumn("n", F.col("n").cast("long")), "observed", "expected", "kappa")


@query(f"with g as (select sum((a and not b)::int)::bigint as x, sum((b and not a)::int)::bigint as y from ({_RATERS})) select x as only_a, y as only_b, round(case when x + y = 0 then 0.0 else pow(abs(x - y) - 1, 2) / (x + y) end, 6) as statistic from g")
def mcnemar(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.mcnemar(_raters(spark, sf), F.col("a"), F.col("b")), "statistic")


@query(f"select a as truth, count(case when b then 1 end) as said_true, count(case when not b then 1 end) as said_false, round(avg((a = b)::int), 6) as win_rate from ({_RATERS}) group by a")
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    g = _raters(spark, sf).groupBy(F.col("a").alias("truth")).agg(F.count(F.when(F.col("b"), 1)).alias("said_true"), F.count(F.when(~F.col("b"), 1)).alias("said_false"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("win_rate"))
    return rounded(g, "win_rate")


@query("with c as (select position, value, count(*) as c from (select 'status' as position, o_orderstatus as value from orders union all select 'priority', o_orderpriority from orders) group by all), t as (select position, sum(c) as n, count(*) as k, sum(c) + 0.5 * (count(*) + 1) as w from c group by 1) select position, any_value(n)::bigint as n, any_value(k) as k, round(sum(-(c + 0.5) / w * ln((c + 0.5) / w)) - any_value(0.5 / w * ln(0.5 / w)) + any_value(k / (2 * w)), 6) as entropy from c join t using (position) group by position")
def entropy_positions(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders")
    rows = o.select(F.explode(F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority")).alias("position", "value"))
    return rounded(stats.entropy(rows, "value", "position"), "entropy")


@query("with c as (select o_orderstatus || '|' || o_orderpriority as v, count(*) as c from orders group by 1), t as (select sum(c) as n, count(*) as k, sum(c) + 0.5 * (count(*) + 1) as w from c) select any_value(n)::bigint as n, any_value(k) as k, round(sum(-(c + 0.5) / w * ln((c + 0.5) / w)) - any_value(0.5 / w * ln(0.5 / w)) + any_value(k / (2 * w)), 6) as entropy from c, t")
def joint_entropy(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders").withColumn("v", F.concat_ws("|", "o_orderstatus", "o_orderpriority"))
    return rounded(stats.entropy(o, "v"), "entropy")


_VAGUE = " + ".join(f"contains(low, '{t}')::int" for t in prompts.VAGUE)
_CONSTRAINTS = " + ".join("len(regexp_extract_all(text, '(?i)" + p.replace("'", "''") + "'))" for p in prompts.CONSTRAINTS)


@query(f"with t as (select conv_id, turn, text, lower(text) as low from conversations where role = 'user') select conv_id, turn, ({_VAGUE})::bigint as n_vague, ({_CONSTRAINTS})::bigint as n_constraints from t")
def prompt_factors(spark: SparkSession, sf: str) -> DataFrame:
    t = _t(spark, sf, "conversations").where("role = 'user'")
    return t.select("conv_id", "turn", F.size(prompts.vague_terms(F.col("text"))).cast("long").alias("n_vague"), prompts.constraint_count(F.col("text")).cast("long").alias("n_constraints"))


@query("select source, format, count(*) as n from (select 'pages' as source, case when regexp_matches(html, '(?i)^<!doctype html') then 'html' else 'other' end as format from pages union all select 'events', case when json_valid(props) then 'json' else 'other' end from events) group by all")
def format_detect(spark: SparkSession, sf: str) -> DataFrame:
    a = _t(spark, sf, "pages").select(F.lit("pages").alias("source"), prompts.format_of(F.col("html")).alias("format"))
    b = _t(spark, sf, "events").select(F.lit("events"), prompts.format_of(F.col("props")))
    return a.union(b).groupBy("source", "format").agg(F.count("*").alias("n"))


@query("select status, count(*) as n from (select case when a.id is null then 'new_after' when b.id is null then 'missing_after' when a.v = b.v then 'same' else 'different' end as status from (select p_partkey as id, p_size as v from part where p_partkey % 7 <> 0) a full join (select p_partkey as id, case when p_partkey % 5 = 0 then p_size + 1 else p_size end as v from part where p_partkey % 11 <> 0) b on a.id = b.id) group by 1")
def diff_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions of a table matched by key: same, different, missing_after, new_after."""
    p = _t(spark, sf, "part")
    a = p.where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("ia"), F.col("p_size").alias("va"))
    b = p.where("p_partkey % 11 <> 0").select(F.col("p_partkey").alias("ib"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("vb"))
    status = F.when(F.col("ia").isNull(), "new_after").when(F.col("ib").isNull(), "missing_after").when(F.col("va") == F.col("vb"), "same").otherwise("different")
    return a.join(b, F.col("ia") == F.col("ib"), "full_outer").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query()
def html_to_json_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Every terminal of every page read as a document."""
    doc = converters.converted(F.col("html"), "html")
    return _t(spark, sf, "pages").select("page_id", F.explode(doc).alias("path", "x")).select("page_id", "path", "x.vtype", "x.sval")


@query("with s as (select o_custkey as p, list_sort(list(o_orderpriority)) as s from orders group by 1) select a.p as prompt_id, a.s = b.s as same_as_sets from s a join s b on b.p = a.p + 1")
def unordered_priorities_all(spark: SparkSession, sf: str) -> DataFrame:
    """Whether all priorities of two neighbouring customers are the same multiset: an optimal assignment of cost 0 that leaves no element without partner."""
    o = _t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("prompt_id")).agg(F.collect_list("o_orderpriority").alias("s"))
    nxt = o.select((F.col("prompt_id") - 1).alias("prompt_id"), F.col("s").alias("t"))
    both = o.join(nxt, "prompt_id").withColumn("m", assign.unordered_similarity(F.col("s"), F.col("t")))
    return both.select("prompt_id", ((F.col("m.total") == 0) & (F.col("m.extra") == 0)).alias("same_as_sets"))


@query("select user_id, count(*) as n_events, round(avg(value), 6) as mean_value from events group by user_id")
def stream_user_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a file stream, aggregated until all is read."""
    return rounded(stream.file_totals(spark, f"{sf}/events.parquet", "user_id", "value"), "mean_value")


def _steps(v: str, medium: float, high: float) -> str:
    return f"case when {v} <= 0 then 0.0 when {v} < {medium} then 0.1 * {v} / {medium} when {v} < {high} then 0.1 + 0.4 * ({v} - {medium}) / ({high} - {medium}) else least(0.5 + 0.5 * ({v} - {high}) / {max(high, 1)}, 1.0) end"


_RISK = f"with t as (select conv_id, count(*) as k, max(length(text)) as q, avg(case when length(text) = 0 then 0.0 when length(text) < 10 then 0.3 when length(text) < 30 then 0.6 else 1.0 end) as d, sum({_VAGUE.replace('low', 'lower(text)')}) as v from conversations group by 1), r as (select conv_id, least(0.17 * ({_steps('k', 7, 10)}) + 0.05 * ({_steps('q', 400, 600)}) + 0.04 * least(v / 5.0, 1.0) + 0.04 + 0.07 * (case when k < 2 then 0.0 when d >= 0.6 then 0.1 * (1 - d) / 0.4 when d >= 0.3 then 0.1 + 0.4 * (0.6 - d) / 0.3 else least(0.5 + 0.5 * (0.3 - d) / 0.3, 1.0) end), 1.0) as risk from t)"


@query(f"{_RISK} select conv_id, round(risk, 6) as risk, case when risk >= 0.6 then 'high' when risk >= 0.3 then 'medium' else 'low' end as level from r")
def risk_score(spark: SparkSession, sf: str) -> DataFrame:
    """A conversation's turns stand for the parameters of a tool, their texts for the descriptions."""
    t = _t(spark, sf, "conversations")
    g = t.groupBy("conv_id").agg(F.count("*").alias("k"), F.max(F.length("text")).alias("q"), F.avg(risk.description_score(F.col("text"))).alias("d"), F.sum(F.size(prompts.vague_terms(F.col("text")))).alias("v"))
    score = risk.overall_risk({"total_params": F.col("k"), "query_length": F.col("q"), "description_quality": F.col("d"), "vague_term_count": F.col("v")})
    return rounded(g.select("conv_id", score.alias("risk")).withColumn("level", risk.level(F.col("risk"))), "risk")


@query("select min(s) as min_size, count(*) as n_triples, round(avg((ab + bc >= ac)::int), 6) as rate, round(min(ab + bc - ac), 6) as least_margin from (select a.p_size as s, abs(a.p_retailprice - b.p_retailprice) as ab, abs(b.p_retailprice - c.p_retailprice) as bc, abs(a.p_retailprice - c.p_retailprice) as ac from part a join part b on b.p_partkey = a.p_partkey + 1 join part c on c.p_partkey = a.p_partkey + 2)")
def triangle_inequality(spark: SparkSession, sf: str) -> DataFrame:
    """How often, and by what margin, a distance keeps the triangle inequality, over neighbouring triples."""
    p = _t(spark, sf, "part")
    at = lambda k, name: p.select((F.col("p_partkey") - k).alias("key"), F.col("p_retailprice").alias(name))
    t = p.select(F.col("p_partkey").alias("key"), "p_size", F.col("p_retailprice").alias("a")).join(at(1, "b"), "key").join(at(2, "c"), "key")
    margin = F.abs(F.col("a") - F.col("b")) + F.abs(F.col("b") - F.col("c")) - F.abs(F.col("a") - F.col("c"))
    g = t.agg(F.min("p_size").alias("min_size"), F.count("*").alias("n_triples"), F.avg((margin >= 0).cast("double")).alias("rate"), F.min(margin).alias("least_margin"))
    return rounded(g, "rate", "least_margin")


@query("with f as (select c_mktsegment as s, o_orderdate as d, o_orderpriority as p, row_number() over (partition by c_mktsegment, o_orderdate order by o_orderkey) as k from orders join customer on o_custkey = c_custkey), g as (select * from f where k <= 3) select a.s as model_a, b.s as model_b, count(*) as n, round(avg(case when a.p = b.p then 1.0 else 0.0 end), 6) as agreement from g a join g b on a.d = b.d and a.s < b.s group by all")
def cross_segment_agreement_all(spark: SparkSession, sf: str) -> DataFrame:
    """The first three outputs of every pair of segments on the same sample, over all samples: the order dates."""
    o, c = _t(spark, sf, "orders"), _t(spark, sf, "customer")
    k = F.row_number().over(Window.partitionBy("s", "d").orderBy("o_orderkey"))
    g = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("s"), F.col("o_orderdate").alias("d"), F.col("o_orderpriority").alias("p"), "o_orderkey").withColumn("k", k).where("k <= 3")
    a, b = g.select("d", F.col("s").alias("model_a"), F.col("p").alias("x")), g.select(F.col("d").alias("e"), F.col("s").alias("model_b"), F.col("p").alias("y"))
    both = a.join(b, (F.col("d") == F.col("e")) & (F.col("model_a") < F.col("model_b")))
    return rounded(both.groupBy("model_a", "model_b").agg(F.count("*").alias("n"), F.avg((F.col("x") == F.col("y")).cast("double")).alias("agreement")), "agreement")


_THREE = "select doc_id, quality = 1 as c from labels union all select doc_id, toxic = 0 from labels union all select doc_id, n_chars >= 1000 from documents join labels using (doc_id)"


@query(f"with x as ({_THREE}), k as (select doc_id, c, count(*) as k from x group by all), i as (select doc_id, sum(k) as m, sum(k * k) as kk from k group by 1 having sum(k) > 1), o as (select count(*) as n, avg((kk - m) / (m * (m - 1))) as o from i), e as (select sum(c * c) / (sum(c) * sum(c)) as e from (select sum(k)::double as c from k where doc_id in (select doc_id from i) group by k.c)) select n as n_items, round(o, 6) as observed, round(e, 6) as expected, round(case when e >= 1 then 0 else (o - e) / (1 - e) end, 6) as kappa from o, e")
def fleiss_kappa(spark: SparkSession, sf: str) -> DataFrame:
    """Three raters of each labelled document: its quality, its freedom from insults, and its length."""
    own, docs = _t(spark, sf, "labels"), _t(spark, sf, "documents")
    rows = own.select("doc_id", (F.col("quality") == 1).alias("c")).union(own.select("doc_id", F.col("toxic") == 0)).union(own.select("doc_id").join(docs, "doc_id").select("doc_id", F.col("n_chars") >= 1000))
    return rounded(stats.fleiss_kappa(rows, "doc_id", "c"), "observed", "expected", "kappa")


@query("with t as (select label as test, (label + 1) / 100.0 as p from (select distinct label from embeddings)), r as (select *, least(1.0, p * (count(*) over () - row_number() over (order by p, test) + 1)) as s from t) select test, round(p, 6) as p, round(max(s) over (order by p, test), 6) as p_adjusted from r")
def holm_adjusted(spark: SparkSession, sf: str) -> DataFrame:
    t = _t(spark, sf, "embeddings").select(F.col("label").alias("test"), ((F.col("label") + 1) / 100.0).cast("double").alias("p")).distinct()
    return rounded(stats.holm(t, "p", "test"), "p", "p_adjusted")


@query("with r as (select r_regionkey as run, 'name' as position, r_name as value from region union all select r_regionkey, 'key', r_regionkey::varchar from region union all select r_regionkey, 'half', (r_regionkey // 2)::varchar from region union all select r_regionkey, 'one', 'x' from region), f as (select position, run, min(run) over (partition by position, value) as f from r), s as (select position, string_agg(run || ':' || f, ',' order by run) as sig from f group by 1) select min(position) as class, string_agg(position, ',' order by position) as members, count(*) as size from s group by sig")
def redundancy_classes(spark: SparkSession, sf: str) -> DataFrame:
    r = _t(spark, sf, "region")
    each = F.create_map(F.lit("name"), F.col("r_name"), F.lit("key"), F.col("r_regionkey").cast("string"), F.lit("half"), F.floor(F.col("r_regionkey") / 2).cast("string"), F.lit("one"), F.lit("x"))
    rows = r.select(F.col("r_regionkey").alias("run"), F.explode(each).alias("position", "value"))
    g = stats.partitions(rows, "run", "position", "value")
    return g.select("class", F.array_join("positions", ",").alias("members"), F.col("size").cast("long").alias("size"))


for _name in ("literal_class_texts", "self_consistency_jaccard", "unordered_priorities", "cross_segment_agreement"):
    QUERIES[_name], ORACLES[_name] = QUERIES[f"{_name}_all"], ORACLES[f"{_name}_all"]  # both names run over whole tables
