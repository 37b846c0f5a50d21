"""Further registered queries: reports, tests of scores, field rules on nested documents, readers of recorded runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import FieldRules
from ..operators import consistency, prompts, reports, significance
from ..sources import files, flatten, traces
from .queries import _PAIRS, _PROMPTS, _RAW, _THREE, _order_prompts, _t, order_documents, query, rounded


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return consistency.pairs(order_documents(spark, sf))


@query(f"with {_PAIRS} select p as prompt_id, ra as run_a, rb as run_b, round(m, 6) as min_readout from (select *, row_number() over (partition by p order by round(m, 9), ra, rb) as k from scored where m < 1) where k = 1")
def order_worst_pair(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reports.worst_pairs(_pairs(spark, sf)), "min_readout")


@query(f"with {_PAIRS}, x as (select '$.status' as path, fs as s from scored union all select '$.priority', ft from scored) select path, count(*) as n, round(avg(s), 6) as mean_score, round(stddev_pop(s), 5) as std_score, round(min(s), 6) as min_score, round(max(s), 6) as max_score from x group by path")
def order_field_summary(spark: SparkSession, sf: str) -> DataFrame:
    g = reports.field_summary(_pairs(spark, sf)).withColumn("n", F.col("n").cast("long"))
    return rounded(g, "mean_score", "min_score", "max_score").withColumn("std_score", F.round("std_score", 5))


@query("select o_custkey, o_orderkey from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as place, count(*) over (partition by o_custkey) as n from orders) where n <= 3 or place in (0, n // 3, 2 * n // 3)")
def order_even_sample(spark: SparkSession, sf: str) -> DataFrame:
    return reports.even_sample(_t(spark, sf, "orders").select("o_custkey", "o_orderkey"), 3, "o_custkey", "o_orderkey")


@query("select o_orderpriority, count(*) as n, round(avg(o_totalprice), 4) as mean, round(stddev_samp(o_totalprice), 4) as std, round(min(o_totalprice), 4) as least, round(median(o_totalprice), 4) as median, round(max(o_totalprice), 4) as greatest from orders group by 1")
def price_summary(spark: SparkSession, sf: str) -> DataFrame:
    g = reports.summary(_t(spark, sf, "orders"), "o_totalprice", "o_orderpriority")
    return g.withColumns({c: F.round(c, 4) for c in ("mean", "std", "least", "median", "greatest")})


@query(f"with {_PAIRS}, total as (select p, count(*) as k from scored group by p), low as (select p, '$.status' as path from scored where fs < 0.95 union all select p, '$.priority' from scored where ft < 0.95), u as (select p, path, count(*) / max(k) as share from low join total using (p) group by p, path) select path, count(*) as n_prompts, round(avg(share), 6) as mean_share from u group by path")
def order_unstable_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reports.unstable_summary(consistency.unstable_fields(_pairs(spark, sf))), "mean_share")


@query(f"with {_PROMPTS} select count(*) as n_groups, round(avg(case when n >= 2 then same end), 6) as mean_share_same, round(avg(case when n >= 2 then c end), 6) as mean_agreement, round(avg(case when n >= 2 and same = 1 then 1.0 else 0.0 end), 6) as share_consistent, 1.0::double as mean_validity from prompts")
def order_group_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reports.group_summary(_order_prompts(spark, sf)), "mean_share_same", "mean_agreement", "share_consistent")


@query(f"with {_PROMPTS} select c_mktsegment as model, count(*) as n, round(avg(c), 6) as raw_mean, 1.0::double as validity, round(avg(c), 6) as penalised_mean from prompts join customer on c_custkey = p group by 1")
def segment_penalised(spark: SparkSession, sf: str) -> DataFrame:
    p = _order_prompts(spark, sf).join(_t(spark, sf, "customer"), F.col("prompt_id") == F.col("c_custkey")).withColumnRenamed("c_mktsegment", "model")
    return rounded(reports.penalised(p, "model"), "raw_mean", "penalised_mean")


_DAYS = "select user_id, strftime(ts, '%Y-%m-%d') as day, list(event_type order by ts, event_id) as names, list(props order by ts, event_id) as args from events group by 1, 2"


def _days(spark: SparkSession, sf: str) -> DataFrame:
    """A user's days as runs."""
    steps = F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type", "props")))
    g = _t(spark, sf, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(steps.alias("s"))
    return g.select("user_id", "day", F.transform("s", lambda x: x["event_type"]).alias("names"), F.transform("s", lambda x: x["props"]).alias("args"))


@query(f"with r as ({_DAYS}), g as (select user_id, count(*) as n_runs, count(distinct list_sort(list_distinct(names))) as sets, count(distinct len(names)) as sizes, count(distinct {{'a': names, 'b': args}}) as n_outputs from r group by 1) select user_id, n_runs, n_outputs, case when sets > 1 then 'tool_selection' when sizes > 1 then 'tool_count' when n_outputs > 1 then 'parameter_value' else 'consistent' end as category from g")
def event_trajectory_category(spark: SparkSession, sf: str) -> DataFrame:
    return reports.categories(_days(spark, sf), "user_id", "names", "args")


@query(f"with r as ({_DAYS}), f as (select user_id, names[1] as first, count(*) as n, sum(len(list_distinct(names))) as kinds from r group by 1, 2) select user_id, sum(n)::bigint as n_runs, round(max(n) / sum(n), 6) as agreement, round(sum(kinds) / sum(n), 6) as diversity from f group by 1")
def first_item_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reports.first_item_agreement(_days(spark, sf), "user_id", "names"), "agreement", "diversity")


@query("select * from (select o_custkey as prompt_id, '$.status' as path, count(distinct o_orderstatus) as n_values from orders group by 1 union all select o_custkey, '$.priority', count(distinct o_orderpriority) from orders group by 1) where n_values > 1")
def order_differing_parameters(spark: SparkSession, sf: str) -> DataFrame:
    return reports.differing_parameters(order_documents(spark, sf))


def _conversations(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation as one nested document."""
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    g = _t(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("turns"))
    return g.select("conv_id", "turns", flatten.flatten_json(F.to_json(F.struct("conv_id", "turns"))).alias("doc"))


@query("select conv_id, 2 * count(*) + 1 as leaves, 1::bigint as arrays, count(*) + 1 as objects, 2 * count(*) + 2 as keys, 3::bigint as depth, 2 * count(*) as n_string, 1::bigint as n_number, 0::bigint as n_boolean, 0::bigint as n_null from conversations group by 1")
def doc_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _conversations(spark, sf).select("conv_id", reports.document_statistics(F.col("doc")).alias("s")).select("conv_id", "s.*")


@query("select conv_id, '$.turns[' || (k - 2) || '].' || part as path, value from (select conv_id, row_number() over (partition by conv_id order by turn) as k, role, coalesce(text, '') as text from conversations) unpivot (value for part in (role, text)) where k > 1")
def ignored_element_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Without its first turn, a conversation's later turns move up; its number is ignored."""
    rules = FieldRules(ignore=("turns[0]", "conv_id"))
    each = _conversations(spark, sf).select("conv_id", F.explode(rules.strip(F.col("doc"))).alias("path", "x"))
    return each.select("conv_id", "path", F.col("x.sval").alias("value"))


@query("with c as (select conv_id, list_sort(list(role)) as roles from conversations group by 1) select a.conv_id, case when a.roles = b.roles then 'same' else 'changed' end as status, a.roles = b.roles as is_same from c a join c b on b.conv_id = a.conv_id + 1")
def unordered_roles(spark: SparkSession, sf: str) -> DataFrame:
    """The roles of two neighbouring conversations as arrays without order: one field, whatever their turns' order."""
    g = _conversations(spark, sf).select("conv_id", flatten.flatten_json(F.to_json(F.struct(F.transform("turns", lambda x: F.struct(x["role"].alias("role"))).alias("turns")))).alias("doc"))
    nxt = g.select((F.col("conv_id") - 1).alias("conv_id"), F.col("doc").alias("other"))
    each = consistency.with_scores(g.join(nxt, "conv_id"), "doc", "other", FieldRules(unordered=("turns",))).select("conv_id", F.explode("scores").alias("path", "s"))
    return each.select("conv_id", "s.status", (F.col("s.score") == 1).alias("is_same"))


_RANK = "rank() over (order by {0}) + (count(*) over (partition by {0}) - 1) / 2.0"


@query(f"with d as (select l_quantity - (24 + l_linenumber) as d, abs(l_quantity - (24 + l_linenumber)) as s from lineitem where l_quantity <> 24 + l_linenumber), r as (select d, {_RANK.format('s')} as r from d) select count(*) as n, sum(case when d > 0 then r else 0 end) as w_plus, sum(case when d < 0 then r else 0 end) as w_minus, round((sum(case when d > 0 then r else 0 end) - sum(case when d < 0 then r else 0 end)) / sqrt(sum(r * r)), 6) as z from r")
def wilcoxon(spark: SparkSession, sf: str) -> DataFrame:
    x = _t(spark, sf, "lineitem").select("l_quantity", (F.lit(24) + F.col("l_linenumber")).alias("expected"))
    return rounded(significance.wilcoxon(x, "l_quantity", "expected"), "z")


@query("with v as (select o_custkey as b, o_orderpriority as t, avg(o_totalprice) as v from orders group by 1, 2), f as (select b from v group by 1 having count(*) = (select count(distinct t) from v)), r as (select t, rank() over (partition by b order by v) + (count(*) over (partition by b, v) - 1) / 2.0 as r from v where b in (select b from f)), s as (select t, sum(r) as r, count(*) as n from r group by 1) select max(n) as n_blocks, count(*) as k, round(12.0 / (max(n) * count(*) * (count(*) + 1)) * sum(r * r) - 3 * max(n) * (count(*) + 1), 6) as chi2 from s")
def friedman(spark: SparkSession, sf: str) -> DataFrame:
    v = _t(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.avg("o_totalprice").alias("v"))
    return rounded(significance.friedman(v, "o_custkey", "o_orderpriority", "v"), "chi2")


@query(f"with x as (select doc_id, (c::int + 1) * (c::int + 1) as c from ({_THREE})), m as (select doc_id, count(*) as m from x group by 1 having count(*) > 1), o as (select x.* from x join m using (doc_id)), p as (select c, dense_rank() over (order by c)::double as r from (select distinct c from o)), u as (select doc_id, count(*) as m, sum(r) as s, sum(r * r) as ss from o join p using (c) group by 1), g as (select count(*) as k, sum(m)::double as n, sum(2 * (m * ss - s * s) / (m - 1)) as d, sum(s) as s, sum(ss) as ss from u) select k as n_items, round(d / n, 6) as observed, round(2 * (n * ss - s * s) / (n * (n - 1)), 6) as expected, round(1 - (d / n) / (2 * (n * ss - s * s) / (n * (n - 1))), 6) as alpha from g")
def krippendorff(spark: SparkSession, sf: str) -> DataFrame:
    own, docs = _t(spark, sf, "labels"), _t(spark, sf, "documents")
    one = lambda df, c: df.select("doc_id", (F.pow(c.cast("int") + 1, F.lit(2))).alias("c"))
    rows = significance.union_all([one(own, F.col("quality") == 1), one(own, F.col("toxic") == 0), one(own.select("doc_id").join(docs, "doc_id"), F.col("n_chars") >= 1000)])
    return rounded(significance.krippendorff(rows, "doc_id", "c"), "observed", "expected", "alpha")


_CORR = "select count(*) as n, corr(l_extendedprice, l_quantity) as x, corr(l_extendedprice, l_discount) as y, corr(l_quantity, l_discount) as z from lineitem"


@query(f"select n, round(x, 6) as r_a, round(y, 6) as r_b, round(z, 6) as r_ab, round((x - y) * sqrt((n - 1) * (1 + z)) / sqrt(2 * (n - 1) / (n - 3) * (1 - x * x - y * y - z * z + 2 * x * y * z) + pow((x + y) / 2, 2) * pow(1 - z, 3)), 4) as t from ({_CORR})")
def williams(spark: SparkSession, sf: str) -> DataFrame:
    g = significance.williams(_t(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", "l_discount")
    return rounded(g, "r_a", "r_b", "r_ab").withColumn("t", F.round("t", 4))


@query("select count(*) as n, round(avg(abs(l_quantity / 50 - l_discount * 10)), 6) as mae, round(max(abs(l_quantity / 50 - l_discount * 10)), 6) as max_error, round(corr(l_quantity / 50, l_discount * 10), 6) as pearson from lineitem")
def score_errors(spark: SparkSession, sf: str) -> DataFrame:
    x = _t(spark, sf, "lineitem").select((F.col("l_quantity") / 50).alias("a"), (F.col("l_discount") * 10).alias("b"))
    return rounded(significance.score_errors(x, "a", "b"), "mae", "max_error", "pearson")


@query("with g as (select avg(case when u then v end) as m1, avg(case when not u then v end) as m2, var_pop(case when u then v end) as v1, var_pop(case when not u then v end) as v2 from (select o_totalprice as v, o_orderpriority in ('1-URGENT', '2-HIGH') as u from orders)) select round(m1, 4) as m1, round(m2, 4) as m2, round((m1 - m2) / sqrt((v1 + v2) / 2), 6) as d_prime from g")
def d_prime(spark: SparkSession, sf: str) -> DataFrame:
    g = significance.d_prime(_t(spark, sf, "orders"), "o_totalprice", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return rounded(g, "d_prime").withColumns({c: F.round(c, 4) for c in ("m1", "m2")})


@query("select count(*) as n_groups, round(avg(case when a = b then 1.0 else 0.0 end), 6) as zero_variance_ratio from (select min(o_orderstatus) as a, max(o_orderstatus) as b from orders group by o_custkey having count(*) > 1)")
def zero_variance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(significance.zero_variance(_t(spark, sf, "orders"), "o_custkey", "o_orderstatus"), "zero_variance_ratio")


@query(f"with c as ({_CORR}), d as (select x, y, z, 1 - x * x - y * y - z * z + 2 * x * y * z as det from c) select 'l_extendedprice' as feature, round((1 - z * z) / det, 6) as vif from d union all select 'l_quantity', round((1 - y * y) / det, 6) from d union all select 'l_discount', round((1 - x * x) / det, 6) from d")
def vif(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(significance.vif(_t(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity", "l_discount"]), "vif")


@query(f"select n, round(x, 6) as r, round((x - y * z) / sqrt((1 - y * y) * (1 - z * z)), 6) as partial from ({_CORR})")
def partial_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(significance.partial_correlation(_t(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", "l_discount"), "r", "partial")


@query("select o_custkey, round(min(s), 6) as least, round(exp(avg(ln(s))), 6) as geometric, round(avg(s), 6) as mean, round(pow(avg(pow(s, 0.5)), 2), 6) as half, round(1 / avg(1 / s), 6) as harmonic from (select o_custkey, o_totalprice / 600000.0 as s from orders) group by 1")
def power_means(spark: SparkSession, sf: str) -> DataFrame:
    g = _t(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list(F.col("o_totalprice") / 600000.0).alias("s"))
    kinds = {"least": float("-inf"), "geometric": 0.0, "mean": 1.0, "half": 0.5, "harmonic": -1.0}
    return g.select("o_custkey", *[F.round(significance.power_mean(F.col("s"), p), 6).alias(k) for k, p in kinds.items()])


@query("with n as (select distinct p_brand, p_name, list_distinct(string_split(lower(p_name), ' ')) as w from part) select a.p_brand, round(max(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))), 6) as ambiguity from n a join n b on a.p_brand = b.p_brand and a.p_name < b.p_name group by 1")
def name_ambiguity(spark: SparkSession, sf: str) -> DataFrame:
    """Parts stand for the tools of a brand."""
    return rounded(prompts.name_ambiguity(_t(spark, sf, "part"), "p_brand", "p_name"), "ambiguity")


_RECORDS = "to_json(named_struct('name', 'tool_result', 'attributes', map('tool_name', event_type, 'tool_input', props, 'prompt.id', cast(user_id as string), 'timestamp', lpad(cast(event_id as string), 12, '0'))))"


@query("select user_id::varchar as group_id, string_agg(event_type, '>' order by event_id) as names, count(*) as n from events group by 1")
def trace_trajectories(spark: SparkSession, sf: str) -> DataFrame:
    """The events as trace records."""
    t = traces.trajectories(_t(spark, sf, "events").select(F.expr(_RECORDS).alias("value")))
    return t.select("group_id", F.array_join(F.transform("steps", lambda s: s["name"]), ">").alias("names"), F.size("steps").cast("long").alias("n"))


@query("select event_id, props as inner_json, props as found from events")
def embedded_json(spark: SparkSession, sf: str) -> DataFrame:
    """JSON in a fenced block, and the first balanced JSON in prose."""
    e = _t(spark, sf, "events")
    block = F.concat(F.lit("So:\n```json\n"), F.col("props"), F.lit("\n```\nthat is it"))
    prose = F.concat(F.lit("I say "), F.col("props"), F.lit(" and {no more"))
    return e.select("event_id", files.fenced(block).alias("inner_json"), files.first_balanced(prose).alias("found"))


@query(f"select user_id, count(*) as n_runs, count(case when json_valid(raw) and raw not in ('{{}}', '[]', 'null', '0') then 1 end) as n_truthy from (select user_id, case when event_id % 5 = 0 then '0' else raw end as raw from (select user_id, event_id, {_RAW} as raw from events)) group by 1")
def event_truthiness(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events").select("user_id", F.expr(f"case when event_id % 5 = 0 then '0' else {_RAW} end").alias("raw"))
    return e.groupBy("user_id").agg(F.count("*").alias("n_runs"), F.sum(flatten.is_truthy(F.col("raw")).cast("long")).alias("n_truthy"))


@query("select doc_id, case when length(text) > 200 then substring(text, 1, 200) || '…' else text end as shown from documents")
def shortened_texts(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", files.shortened(F.col("text")).alias("shown"))
