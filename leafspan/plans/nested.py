"""Further registered queries: nested documents, positions, information, schemas, replies, checks without references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels, positions
from ..functions.leaves import number_leaf, text_leaf
from ..functions.register import register
from ..operators import consistency, information, nested, predict, prompts, references, schemas, verification
from ..sources import flatten, replies
from .queries import _SIM, _t, order_documents, query, rounded


def conversation_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation as {turns: {t0: {role, size}, …}}."""
    at = lambda part: F.concat(F.lit("$.turns.t"), F.col("turn"), F.lit(f".{part}"))
    entries = F.array(F.struct(at("role").alias("key"), text_leaf(F.col("role")).alias("value")), F.struct(at("size").alias("key"), number_leaf(F.length(F.coalesce("text", F.lit("")))).alias("value")))
    return _t(spark, sf, "conversations").groupBy("conv_id").agg(F.map_from_entries(F.flatten(F.collect_list(entries))).alias("doc"))


def _neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation beside the next: conv_id, a, b, counts of children and field scores."""
    own = conversation_documents(spark, sf).withColumn("n", nested.child_counts(F.col("doc")))
    after = own.select((F.col("conv_id") - 1).alias("conv_id"), F.col("doc").alias("b"), F.col("n").alias("nb"))
    both = own.select("conv_id", F.col("doc").alias("a"), F.col("n").alias("na")).join(after, "conv_id")
    return both.withColumn("scores", consistency.field_scores(F.col("a"), F.col("b")))


_TURNS = f"""t as (select conv_id, turn, role, length(coalesce(text, '')) as size from conversations), c as (select conv_id, count(*) as n from t group by 1),
f as (select a.conv_id, a.turn, sqrt({_SIM.format(a="a.role", b="b.role")}) as kr, case when a.size = b.size then 1.0 else 0.0 end as ks from t a join t b on b.conv_id = a.conv_id + 1 and a.turn = b.turn),
p as (select x.conv_id, x.n as na, y.n as nb, greatest(x.n, y.n) as m from c x join c y on y.conv_id = x.conv_id + 1),
g as (select p.*, coalesce(sum(kr + ks), 0) / 2 / any_value(m) as mean, count(kr) as common, coalesce(sum(kr * kr + ks), 0) as raw, min(least(kr, ks)) as least from p left join f using (conv_id) group by all)"""


@query(f"with {_TURNS} select conv_id, round(mean, 6) as mean from g")
def nested_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _neighbours(spark, sf).select("conv_id", F.round(nested.mean_readout(F.col("scores"), F.col("na"), F.col("nb")), 6).alias("mean"))


@query(f"with {_TURNS} select conv_id, round(mean, 6) as combined, round(common / m, 6) as structural, round(raw / 2 / m, 6) as content from g")
def nested_projections(spark: SparkSession, sf: str) -> DataFrame:
    cols = [F.col(c) for c in ("a", "b", "scores", "na", "nb")]
    return rounded(_neighbours(spark, sf).select("conv_id", nested.projections(*cols).alias("p")).select("conv_id", "p.*"), "combined", "structural", "content")


@query(f"with {_TURNS} select conv_id, round(least(case when na = nb then least else 0 end, mean), 6) as low, round(greatest(case when na = nb then least else 0 end, mean), 6) as high from g")
def exponent_interval(spark: SparkSession, sf: str) -> DataFrame:
    e = _neighbours(spark, sf).select("conv_id", nested.exponent_interval(F.col("scores"), F.col("na"), F.col("nb")).alias("i"))
    return rounded(e.select("conv_id", "i.*"), "low", "high")


@query(f"with {_TURNS}, s as (select *, greatest(0, 1 - 2 * (na + nb - 2 * common) / greatest(1 + 5 * na, 1 + 5 * nb)) as structure from g), r as (select conv_id, structure, case when structure < 0.5 or common = 0 then 0 else raw / (2 * common) end as content from s) select conv_id, round(structure, 6) as structure, round(content, 6) as content, round((structure + content) / 2, 6) as score from r")
def counted_changes(spark: SparkSession, sf: str) -> DataFrame:
    e = _neighbours(spark, sf).select("conv_id", nested.counted_changes(F.col("a"), F.col("b"), F.col("scores")).alias("x"))
    return rounded(e.select("conv_id", "x.*"), "structure", "content", "score")


@query(f"with {_TURNS} select conv_id, round(case when nb > na then 0 when nb < na then 0 else least end, 6) as certified from g")
def certified_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _neighbours(spark, sf).select("conv_id", F.round(nested.certified(F.col("scores")), 6).alias("certified"))


@query("select conv_id, 1 + 5 * count(*) as elements, 2 * count(*) as leaves from conversations group by 1")
def element_counts(spark: SparkSession, sf: str) -> DataFrame:
    return conversation_documents(spark, sf).select("conv_id", positions.element_count(F.col("doc")).cast("long").alias("elements"), F.size("doc").cast("long").alias("leaves"))


@query("select position, count(*) as n, count(distinct value) as n_values from (select 'turns[*].role' as position, role as value from conversations union all select 'turns[*].tags[]', 'x' from conversations) group by 1")
def pooled_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as elements of an array, each with an empty array of tags."""
    turns = F.collect_list(F.struct("role", F.array().cast("array<string>").alias("tags")))
    docs = _t(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("turns")).select(flatten.flatten_json(F.to_json(F.struct("turns"))).alias("doc"))
    each = docs.select(F.inline(positions.positions(F.col("doc"), exchangeable=True)))
    return each.groupBy("position").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values"))


@query("select s as string, count(distinct conv_id) as n from (select conv_id, role as s from conversations union all select conv_id, unnest(['turns', 'role', 'size']) from conversations) where length(s) >= 4 group by 1")
def strings_to_embed(spark: SparkSession, sf: str) -> DataFrame:
    d = conversation_documents(spark, sf).select("conv_id", F.explode(positions.strings_to_embed(F.col("doc"), prompts.key_words)).alias("string"))
    return d.groupBy("string").agg(F.count_distinct("conv_id").alias("n"))


@query("select conv_id, turn, '$.chat.turns.t' || turn || '.speaker' as path, role as value from conversations")
def renamed_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Roles become speakers, and all lies one level deeper."""
    d = conversation_documents(spark, sf).select("conv_id", nested.renamed(F.col("doc"), {"turns.*.role": "speaker"}).alias("doc"))
    moved = F.transform_keys("doc", lambda k, _: F.concat(F.lit("$.chat"), F.substring(k, 2, 1 << 20)))
    each = d.select("conv_id", F.inline(nested.fields(moved))).where(F.col("path").endswith(".speaker"))
    return each.select("conv_id", F.regexp_extract("path", r"\.t([0-9]+)\.", 1).cast("long").alias("turn"), "path", "value")


@query("select conv_id, '$.data.content.turns_t' || turn || '_size' as path, cast(length(coalesce(text, '')) as varchar) as value, 'string' as vtype from conversations")
def varied_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Flattened, wrapped twice, numbers as texts."""
    d = conversation_documents(spark, sf).select("conv_id", nested.varied_numbers(nested.wrapped(nested.flattened(F.col("doc")), 1.0)).alias("doc"))
    return d.select("conv_id", F.explode("doc").alias("path", "x")).where(F.col("path").endswith("_size")).select("conv_id", "path", F.col("x.sval").alias("value"), F.col("x.vtype").alias("vtype"))


@query("select event_id, json_extract_string(props, '$.k') as picked from events")
def picked_values(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "events").select("event_id", positions.pick(F.col("props")).alias("picked"))


@query("with e as (select event_id, user_id, event_type, props, lag(event_type) over (partition by user_id order by event_id) as before from events) select event_id, case when event_type = before then 1.0 else 0.0 end as name_score from e where before is not null")
def callee_names(spark: SparkSession, sf: str) -> DataFrame:
    """Events as calls: the name of what is called counts wholly or not at all."""
    call = F.to_json(F.struct(F.col("event_type").alias("name"), F.struct(F.col("value").alias("v")).alias("arguments")))
    docs = _t(spark, sf, "events").select("event_id", "user_id", flatten.flatten_json(call).alias("doc"))
    both = docs.withColumn("before", F.lag("doc").over(Window.partitionBy("user_id").orderBy("event_id"))).where("before is not null")
    scores = positions.exact_where(consistency.field_scores(F.col("before"), F.col("doc")), F.col("doc"))
    return both.select("event_id", F.element_at(scores, "$.name")["score"].alias("name_score"))


@query(f"select o_custkey, round(avg({_SIM.format(a='x', b='y')}), 6) as literal, count(*) as n from (select o_custkey, o_orderpriority as x, lead(o_orderpriority) over (partition by o_custkey order by o_orderkey) as y from orders) where y is not null group by 1")
def registered_functions(spark: SparkSession, sf: str) -> DataFrame:
    """The kernel as a function of SQL."""
    register(spark)
    _t(spark, sf, "orders").createOrReplaceTempView("registered_orders")
    return rounded(spark.sql("select o_custkey, avg(char_sim(x, y)) as literal, count(*) as n from (select o_custkey, o_orderpriority as x, lead(o_orderpriority) over (partition by o_custkey order by o_orderkey) as y from registered_orders) where y is not null group by 1"), "literal")


@query("select l_orderkey, l_linenumber, l_partkey, round(case when l_discount * 10 > 0.5 then greatest(0, (1 - (l_discount * 10 - 0.5) / 0.5) * l_quantity) end, 6) as radius, round(least(1.0, pow(0.9, 2) * 1.5), 6) as cost from lineitem")
def edit_radii(spark: SparkSession, sf: str) -> DataFrame:
    x = _t(spark, sf, "lineitem").withColumn("path", F.lit("$.a.b"))
    cost = positions.edit_cost(F.col("path"), 0.9, ("$.a.b",))
    return rounded(x.select("l_orderkey", "l_linenumber", "l_partkey", positions.edit_radius(F.col("l_discount") * 10, 0.5, F.col("l_quantity")).alias("radius"), cost.alias("cost")), "radius", "cost")


_H = "greatest(0, ln(sum(c) + 0.5 * (count(*) + 1)) - (sum((c + 0.5) * ln(c + 0.5)) + 0.5 * ln(0.5)) / (sum(c) + 0.5 * (count(*) + 1)) + count(*) / (2 * (sum(c) + 0.5 * (count(*) + 1))))"
_COLS = ["l_returnflag", "l_linestatus", "l_linenumber"]


def _h(name: str, cols: str) -> str:
    return f"{name} as (select {_H} as h from (select {cols}, count(*) as c from lineitem group by {cols}))"


_MASKS = ", ".join([_h("h1", "l_returnflag"), _h("h2", "l_linestatus"), _h("h3", "l_returnflag, l_linestatus"), _h("h4", "l_linenumber"), _h("h5", "l_returnflag, l_linenumber"), _h("h6", "l_linestatus, l_linenumber"), _h("h7", "l_returnflag, l_linestatus, l_linenumber")])


@query(f"with {_MASKS} " + " union all ".join(f"select {i} as mask, round(h, 6) as entropy from h{i}" for i in range(1, 8)))
def joint_entropies(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(information.joint_entropies(_t(spark, sf, "lineitem"), _COLS), "entropy")


@query(f"with {_MASKS} " + " union all ".join(f"select '{_COLS[a]}' as a, '{_COLS[b]}' as b, round(greatest(0, h{1 << a}.h + h{1 << b}.h - h{(1 << a) | (1 << b)}.h), 6) as mutual from h{1 << a}, h{1 << b}, h{(1 << a) | (1 << b)}" for a, b in ((0, 1), (0, 2), (1, 2))))
def mutual_information(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(information.pair_information(_t(spark, sf, "lineitem"), _COLS).where("a <> b").select("a", "b", "mutual"), "mutual")


@query(f"with {_MASKS}, s as (select h1.h + h2.h + h4.h as own, greatest(0, h1.h + h2.h - h3.h) as x, greatest(0, h1.h + h4.h - h5.h) as y, greatest(0, h2.h + h4.h - h6.h) as z from h1, h2, h3, h4, h5, h6) select 3 as n_positions, round(own - (x + y + z - least(x, y, z)), 5) as total from s")
def tree_information(spark: SparkSession, sf: str) -> DataFrame:
    w = information.tree_weights(_t(spark, sf, "lineitem"), _COLS)
    return w.agg(F.count("*").cast("int").alias("n_positions"), F.round(F.sum("weight"), 5).alias("total"))


_LEAD = "select l_orderkey, l_linenumber, l_partkey, (l_returnflag = lead(l_returnflag) over w)::int as s1, (l_linestatus = lead(l_linestatus) over w)::int as s2, (l_linenumber = lead(l_linenumber) over w)::int as s3, lead(l_partkey) over w as nxt from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey)"


def _line_pairs(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    same = [(F.col(c) == F.lead(c).over(w)).cast("double").alias(f"s{i + 1}") for i, c in enumerate(_COLS)]
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *same, F.lead("l_partkey").over(w).alias("nxt")).where("nxt is not null")


@query(f"with {_MASKS}, l as (select * from ({_LEAD}) where nxt is not null) select l_orderkey, l_linenumber, l_partkey, nxt, round(case s1 + 2 * s2 + 4 * s3 when 0 then 0 when 1 then h1.h when 2 then h2.h when 3 then h3.h when 4 then h4.h when 5 then h5.h when 6 then h6.h else h7.h end / h7.h, 6) as coverage from l, h1, h2, h3, h4, h5, h6, h7")
def line_coverage(spark: SparkSession, sf: str) -> DataFrame:
    h = information.joint_entropies(_t(spark, sf, "lineitem"), _COLS)
    out = information.coverage(_line_pairs(spark, sf), h, {c: F.col(f"s{i + 1}") for i, c in enumerate(_COLS)})
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "nxt", F.round(F.least("coverage", F.lit(1.0)), 6).alias("coverage"))


@query(f"with {_MASKS}, l as (select * from ({_LEAD}) where nxt is not null) select l_orderkey, l_linenumber, l_partkey, nxt, round((s1 * h1.h + s2 * h2.h + s3 * h4.h) / (h1.h + h2.h + h4.h), 6) as score from l, h1, h2, h4")
def line_information(spark: SparkSession, sf: str) -> DataFrame:
    x = information.pair_information(_t(spark, sf, "lineitem"), _COLS).where("a = b")
    h = {r["a"]: r["entropy"] for r in x.collect()}  # three rows
    score = information.information_score(h, {c: F.col(f"s{i + 1}") for i, c in enumerate(_COLS)})
    return rounded(_line_pairs(spark, sf).withColumn("score", score).select("l_orderkey", "l_linenumber", "l_partkey", "nxt", "score"), "score")


@query(f"select count(*) as n_groups, round(avg(h), 6) as entropy from (select o_custkey, {_H} as h from (select o_custkey, o_orderpriority, count(*) as c from orders group by 1, 2) group by 1)")
def conditional_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(information.conditional_entropy(_t(spark, sf, "orders"), "o_orderpriority", "o_custkey"), "entropy")


@query("select l_returnflag, count(*) as n, round(avg(l_quantity), 6) as mean, true as holds from lineitem group by 1")
def bootstrap_interval(spark: SparkSession, sf: str) -> DataFrame:
    """The interval itself is tested apart: it is random, if repeatable."""
    x = _t(spark, sf, "lineitem").withColumn("key", F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    b = verification.bootstrap_mean(x, "l_quantity", "key", "l_returnflag", replicates=50)
    return b.select("l_returnflag", "n", F.round("mean", 6).alias("mean"), ((F.col("low") < F.col("mean")) & (F.col("mean") < F.col("high"))).alias("holds"))


@query("with g as (select c_mktsegment, count(*) as n, avg(c_acctbal) as m, sum(c_acctbal) as s, sum(c_acctbal * c_acctbal) as q from customer group by 1), a as (select sum(n) as n, sum(s) as s, sum(q) as q from g), d as (select c_mktsegment, g.n, m, m - (a.s - g.s) / (a.n - g.n) as gap, sqrt((g.q - g.s * g.s / g.n + (a.q - g.q) - (a.s - g.s) * (a.s - g.s) / (a.n - g.n)) / (a.n - 2)) as sd from g, a) select c_mktsegment, n, round(m, 4) as mean, round(gap, 4) as difference, round(gap / sd, 6) as d, case when abs(gap / sd) < 0.2 then 'negligible' when abs(gap / sd) < 0.5 then 'small' when abs(gap / sd) < 0.8 then 'medium' else 'large' end as effect from d")
def segment_comparison(spark: SparkSession, sf: str) -> DataFrame:
    g = verification.group_comparison(_t(spark, sf, "customer"), "c_mktsegment", "c_acctbal")
    return rounded(g, "d").withColumns({c: F.round(c, 4) for c in ("mean", "difference")})


@query("select user_id, event_type, round(n / t, 6) as share, t as n_votes from (select *, row_number() over (partition by user_id order by n desc, event_type) as k, sum(n) over (partition by user_id)::bigint as t from (select user_id, event_type, count(*) as n from events group by 1, 2)) where k = 1")
def majority_votes(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(verification.majority(_t(spark, sf, "events"), "user_id", "event_type"), "share")


@query("select doc_id, greatest(quality, toxic, 0.5) - least(quality, toxic, 0.5) as spread from labels order by spread desc, doc_id limit 10")
def method_disagreement(spark: SparkSession, sf: str) -> DataFrame:
    x = _t(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"), F.lit(0.5).alias("flat"))
    return verification.disagreement(x, "doc_id", ["quality", "toxic", "flat"])


@query("select o_orderpriority, round(avg(case when u then v end), 4) as m1, round(avg(case when not u then v end), 4) as m2, round((avg(case when u then v end) - avg(case when not u then v end)) / sqrt((var_pop(case when u then v end) + var_pop(case when not u then v end)) / 2), 6) as separation from (select o_orderpriority, o_totalprice as v, o_orderstatus = 'F' as u from orders) group by 1")
def setting_separation(spark: SparkSession, sf: str) -> DataFrame:
    x = _t(spark, sf, "orders").withColumn("u", F.col("o_orderstatus") == "F")
    s = verification.separation(x, "o_orderpriority", "u", "o_totalprice")
    return rounded(s, "separation").withColumns({c: F.round(c, 4) for c in ("m1", "m2")})


_STRONG, _SOFT = (f"regexp_matches(text, '{verification.DIRECTIVES[k]}')" for k in ("strong", "soft"))


@query(f"select case when {_STRONG} and {_SOFT} then 'both' when {_STRONG} then 'strong' when {_SOFT} then 'soft' else 'none' end as directive, count(*) as n from (select coalesce(text, '') as text from documents union all select text from (values ('You must go'), ('Please go'), ('Always try'), ('Go')) v(text)) group by 1")
def directive_groups(spark: SparkSession, sf: str) -> DataFrame:
    texts = _t(spark, sf, "documents").select(F.coalesce("text", F.lit("")).alias("text")).unionAll(spark.createDataFrame([("You must go",), ("Please go",), ("Always try",), ("Go",)], "text string"))
    return texts.groupBy(verification.directive_of(F.col("text")).alias("directive")).agg(F.count("*").alias("n"))


@query("with r as (select user_id, date_trunc('day', ts) as day, length(string_agg(props, '' order by event_id)) as size, count(*) as args, string_agg(distinct event_type, ',' order by event_type) as tools from events group by 1, 2), g as (select user_id, count(*) as n_probes, stddev_pop(size) / avg(size) as l, stddev_pop(args) / avg(args) as a, case when count(distinct tools) > 1 then 1.0 else 0.0 end as v from r group by 1), p as (select *, least(1.0, 0.6 * least(l / 0.3, 1) + 0.3 * least(a / 0.5, 1) + 0.1 * v) as p from g) select user_id, n_probes, round(greatest(0, least(1, 1 - l)), 6) as predicted, round(p, 6) as inconsistency, case when p >= 0.5 then 'high' when p >= 0.2 then 'medium' else 'low' end as level from p")
def probe_prediction(spark: SparkSession, sf: str) -> DataFrame:
    """A user's days are probe runs."""
    runs = _t(spark, sf, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.sum(F.length("props")).alias("size"), F.count("*").alias("args"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("tools"))
    return rounded(predict.probed(runs, "user_id", F.col("size"), F.col("args"), F.col("tools")).select("user_id", "n_probes", "predicted", "inconsistency", "level"), "predicted", "inconsistency")


@query("select event_id, least(1, value / 100) as structural, case when event_id % 3 = 0 then 0.25 end as overall, round(coalesce(case when event_id % 3 = 0 then 0.25 end, case when event_id % 2 = 0 then 0.6 * least(1, value / 100) + 0.4 * 0.5 end, 0.5), 6) as score from events")
def judge_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Replies made of each event: always a structural score, at times a semantic and an overall one."""
    reply = F.concat(F.lit("STRUCTURAL_SCORE: "), (F.col("value") / 100).cast("decimal(20,10)").cast("string"), F.when(F.col("event_id") % 2 == 0, "\nSEMANTIC_SCORE: 0.5").otherwise(""), F.when(F.col("event_id") % 3 == 0, "\nOVERALL_SCORE:0.25").otherwise(""))
    return _t(spark, sf, "events").select("event_id", predict.judged(reply).alias("j")).select("event_id", "j.structural", "j.overall", F.round("j.score", 6).alias("score"))


@query("with w as (select doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') as w, text from documents) select doc_id, len(w)::int as n_words, length(text)::int as n_chars, coalesce(len(regexp_extract_all(text, '[0-9]+(\\.[0-9]+)?')), 0)::int as n_numbers, len(regexp_extract_all(text, ','))::int as n_commas, regexp_matches(text, 'https?://')::int as has_url from w")
def prompt_features(spark: SparkSession, sf: str) -> DataFrame:
    f = predict.text_features(F.col("text"))
    return _t(spark, sf, "documents").select("doc_id", *[f[k].alias(k) for k in ("n_words", "n_chars", "n_numbers", "n_commas", "has_url")])


_TOOL = """{"type": "object", "required": ["id"], "properties": {"id": {"type": "integer", "description": "the key of the part"}, "size": {"type": "object", "properties": {"w": {"type": "number"}, "h": {"type": "array", "items": {"type": "object", "properties": {"u": {"type": "string"}}}}}}, "kind": {"type": "string", "enum": ["a", "b"]}, "note": {"type": "string"}}}"""


@query("select p_brand, count(*) as num_tools, 7 * count(*) as total_params, 3 * count(*) as total_optional, 2::bigint as schema_depth, 3::bigint as types, round(2 * sqrt(7 * count(*)) * 1.6, 4) as schema_complexity, 0.75::double as optional_param_ratio, 0.5::double as enum_gap, 0.15::double as description_quality from part group by 1")
def tool_schema_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Every part is a tool of its brand, with one schema."""
    tools = _t(spark, sf, "part").select("p_brand", flatten.flatten_json(F.concat(F.lit(_TOOL[:-1]), F.lit(', "title": "'), F.col("p_partkey"), F.lit('"}'))).alias("schema"))
    m = schemas.prompt_metrics(tools, "p_brand", "schema").drop("string_params")
    return m.withColumn("schema_complexity", F.round("schema_complexity", 4)).withColumn("optional_param_ratio", F.round("optional_param_ratio", 6)).withColumn("description_quality", F.round("description_quality", 6))


@query("select p_brand, factor, severity, n from (select p_brand, count(*) as t, max(p_size)::bigint as s from part group by 1), lateral (select unnest([case when t >= 8 then 'many_tools' when t >= 5 then 'moderate_tool_count' end, case when s >= 10 then 'high_total_params' when s >= 7 then 'moderate_total_params' end]) as factor, unnest([case when t >= 8 then 'high' when t >= 5 then 'medium' end, case when s >= 10 then 'high' when s >= 7 then 'medium' end]) as severity, unnest([t, t]) as n) where factor is not null")
def risk_factor_list(spark: SparkSession, sf: str) -> DataFrame:
    g = _t(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.max("p_size").cast("long").alias("s"))
    each = g.select("p_brand", "n", F.inline(schemas.risk_factors({"num_tools": F.col("n"), "total_params": F.col("s")})))
    return each.select("p_brand", F.col("name").alias("factor"), "severity", "n")


@query("select path, types, n, n = (select count(*) from conversations) as required from (select '$.role' as path, 'string' as types, count(*) as n from conversations union all select '$.turn', 'number', count(*) from conversations union all select '$.late', 'boolean', count(*) from conversations where turn > 2)")
def inferred_schema(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "conversations")
    docs = c.select(flatten.flatten_json(F.to_json(F.struct("role", "turn", F.when(F.col("turn") > 2, F.lit(True)).alias("late")))).alias("doc"))
    return schemas.inferred_schema(docs).withColumn("types", F.array_join("types", ","))


@query("select conv_id, turn, 2::bigint as n_calls, 'go,' || role as names, '{\"k\":' || turn || '}' as first_args, case when nxt = 'user' then 1 else 0 end::bigint as n_responses from (select *, lead(role) over (partition by conv_id order by turn) as nxt from conversations) where role = 'assistant'")
def markup_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Two calls written into every message, one as JSON and one as a Python literal."""
    call = F.concat(F.lit('<tool_call>\n{"name": "go", "arguments": "{\\"k\\": '), F.col("turn"), F.lit('}"}\n</tool_call> and <tool_call>{\'name\': \''), F.col("role"), F.lit("', 'arguments': None}</tool_call> <tool_call>no</tool_call><tool_response>fine</tool_response>"))
    t = replies.call_turns(_t(spark, sf, "conversations").withColumn("text", call), "conv_id", "turn", "role", "text")
    return t.select("conv_id", "turn", F.size("calls").cast("long").alias("n_calls"), F.array_join(F.transform("calls", lambda c: c["name"]), ",").alias("names"), F.get("calls", 0)["args"].alias("first_args"), F.size("responses").cast("long").alias("n_responses"))


@query("select event_id, event_type as name, case when event_id % 3 = 1 then '{}' else '{\"k\":' || json_extract_string(props, '$.k') || '}' end as args from events")
def provider_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Replies in three forms: parts of a content, a choice with unreadable arguments, a history."""
    name = F.concat(F.lit('"name": "'), F.col("event_type"), F.lit('"'))
    a = F.concat(F.lit('{"output": {"message": {"content": [{"text": "x"}, {"toolUse": {'), name, F.lit(', "input": '), F.col("props"), F.lit("}}]}}}"))
    b = F.concat(F.lit('{"choices": [{"message": {"tool_calls": [{"function": {'), name, F.lit(', "arguments": "{broken"}}]}}]}'))
    c = F.concat(F.lit('{"messages": [{"type": "human"}, {"type": "ai", "tool_calls": [{'), name, F.lit(', "args": '), F.col("props"), F.lit('}, {"args": {}}]}, {"type": "tool"}]}'))
    e = _t(spark, sf, "events")
    calls = F.when(F.col("event_id") % 3 == 0, replies.provider_calls(a)).when(F.col("event_id") % 3 == 1, replies.provider_calls(b)).otherwise(replies.history_calls(c))
    return e.select("event_id", F.inline(calls))


@query("select user_id, n_settings, round(within, 6) as within, round(across, 6) as across, round(0.6 * within + 0.4 * across, 6) as score, round(spread / (rng + 0.01), 6) as sensitivity from (with r as (select user_id, (extract(hour from ts) // 12)::int as t, strftime(ts, '%Y-%m-%d') as day, list_distinct(list(event_type)) as x from events group by 1, 2, 3), j as (select a.user_id, a.t, avg(len(list_intersect(a.x, b.x)) / len(list_distinct(list_concat(a.x, b.x)))) as s from r a join r b on a.user_id = b.user_id and a.t = b.t and a.day < b.day group by 1, 2), w as (select user_id, count(*) as n_settings, avg(coalesce(s, 1)) as within, max(coalesce(s, 1)) - min(coalesce(s, 1)) as spread, max(t) - min(t) as rng from (select distinct user_id, t from r) left join j using (user_id, t) group by 1), f as (select user_id, t, arg_min(x, day) as x from r group by 1, 2), c as (select a.user_id, avg(len(list_intersect(a.x, b.x)) / len(list_distinct(list_concat(a.x, b.x)))) as across from f a join f b on a.user_id = b.user_id and a.t < b.t group by 1) select w.*, coalesce(across, 1) as across from w left join c using (user_id))")
def setting_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Halves of the day are settings, days are runs."""
    e = _t(spark, sf, "events").groupBy("user_id", F.floor(F.hour("ts") / 12).cast("int").alias("half"), F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.collect_set("event_type").alias("items"))
    return rounded(verification.setting_sweep(e, "user_id", "half", "day", "items"), "within", "across", "score", "sensitivity")


@query("select user_id, count(*) as n_runs, round(avg(share), 6) as mean_share, round(least(1, avg(share) + case when min(share) > 0.8 or max(share) < 0.2 then 0.1 else 0 end), 6) as score from (select user_id, strftime(ts, '%Y-%m-%d') as day, avg(case when event_type <> 'error' then 1.0 else 0.0 end) as share from events group by 1, 2) group by 1")
def schema_guided(spark: SparkSession, sf: str) -> DataFrame:
    """Errors are calls without a name."""
    runs = _t(spark, sf, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.collect_list(F.struct(F.when(F.col("event_type") != "error", F.col("event_type")).alias("name"))).alias("items"))
    return rounded(verification.schema_guided(runs, "user_id", verification.named_share(F.col("items"))), "mean_share", "score")


@query(f"select n_nationkey, round(sqrt({_SIM.format(a='n_name', b='r_name')}), 6) as certificate, round(1 - sqrt(0.5 * {_SIM.format(a='n_name', b='r_name')}), 6) as cost from nation join region on n_regionkey = r_regionkey")
def certificate_scores(spark: SparkSession, sf: str) -> DataFrame:
    x = _t(spark, sf, "nation").join(_t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sim = kernels.char_similarity(F.col("n_name"), F.col("r_name"))
    return rounded(x.select("n_nationkey", nested.certificate_score(text_leaf(F.col("n_name")), text_leaf(F.col("r_name"))).alias("certificate"), nested.combined(F.lit(0.5), 1 - sim).alias("cost")), "certificate", "cost")


_DAY_NAMES = "select user_id, strftime(ts, '%Y-%m-%d') as day, list(event_type order by event_id) as names from events group by 1, 2"


def _day_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The names of each day of a user beside those of the next."""
    g = _t(spark, sf, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("names"))
    return g.withColumn("others", F.lead("names").over(Window.partitionBy("user_id").orderBy("day"))).where("others is not null")


@query(f"with d as ({_DAY_NAMES}), p as (select user_id, day, names, lead(names) over (partition by user_id order by day) as others from d), q as (select * from p where others is not null), a as (select user_id, day, n, count(*) as c from (select user_id, day, unnest(names) as n from q) group by all), b as (select user_id, day, n, count(*) as c from (select user_id, day, unnest(others) as n from q) group by all), m as (select user_id, day, sum(least(a.c, b.c)) as k from a join b using (user_id, day, n) group by 1, 2) select user_id, day, coalesce(k, 0)::int as n_named, greatest(len(names), len(others))::int as n_places from q left join m using (user_id, day)")
def calls_by_name(spark: SparkSession, sf: str) -> DataFrame:
    p = _day_pairs(spark, sf).select("user_id", "day", nested.aligned_order(F.col("names"), F.col("others")).alias("o"))
    return p.select("user_id", "day", "o.n_named", F.size("o.order").alias("n_places"))


@query(f"with d as (select user_id, day, array_to_string(list_transform(names, lambda x: case x when 'error' then 'r' else left(x, 1) end), '') as s from ({_DAY_NAMES})), p as (select user_id, day, s, lead(s) over (partition by user_id order by day) as o from d) select user_id, day, levenshtein(s, o)::double as cost from p where o is not null")
def sequence_costs(spark: SparkSession, sf: str) -> DataFrame:
    return _day_pairs(spark, sf).select("user_id", "day", nested.sequence_cost(F.col("names"), F.col("others")).alias("cost"))


def _referenced(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's first order is the reference of the others."""
    docs = order_documents(spark, sf)
    first = docs.groupBy("prompt_id").agg(F.min_by("doc", "run_id").alias("doc"), F.min("run_id").alias("first"))
    rest = docs.join(first.select("prompt_id", "first"), "prompt_id").where("run_id > first")
    return references.against_reference(rest, first, "prompt_id")


_REFERENCED = f"with o as (select o_custkey as p, o_orderkey as r, o_orderstatus as s, o_orderpriority as t, min(o_orderkey) over (partition by o_custkey) as f from orders), m as (select a.p, least(sqrt({_SIM.format(a='b.s', b='a.s')}), sqrt({_SIM.format(a='b.t', b='a.t')})) as m from o a join o b on a.p = b.p and a.f = b.r and a.r > a.f)"


@query(f"{_REFERENCED} select p as prompt_id, count(*) as n, round(avg(m), 6) as mean, round(stddev_pop(m), 5) as std, round(min(m), 6) as least, round(median(m), 6) as median, round(max(m), 6) as greatest from m group by 1")
def reference_report(spark: SparkSession, sf: str) -> DataFrame:
    g = references.reference_report(_referenced(spark, sf), "min_readout", "prompt_id")
    return rounded(g, "mean", "least", "median", "greatest").withColumn("std", F.round("std", 5))


@query("with e as (select o_totalprice / 600000 as v, o_orderstatus = 'F' as u, unnest([0.5, 1.0, 2.0, 4.0])::double as e from orders) select e as exponent, round(pow(avg(case when u then pow(v, e) end) - avg(case when not u then pow(v, e) end), 2) / (var_pop(case when u then pow(v, e) end) + var_pop(case when not u then pow(v, e) end)), 8) as ratio from e group by 1")
def fisher_ratios(spark: SparkSession, sf: str) -> DataFrame:
    x = _t(spark, sf, "orders").withColumn("v", F.col("o_totalprice") / 600000)
    return references.fisher_ratios(x, "v", F.col("o_orderstatus") == "F", (0.5, 1.0, 2.0, 4.0)).withColumn("ratio", F.round("ratio", 8))


@query("with v as (select o_orderpriority as t, o_custkey as i, avg(o_totalprice) as v from orders group by 1, 2), r as (select t, i, rank() over (partition by t order by v) + (count(*) over (partition by t, v) - 1) / 2.0 as r from v) select a.t as a, b.t as b, count(*) as n, round(corr(a.r, b.r), 6) as rho from r a join r b on a.i = b.i and a.t < b.t group by 1, 2")
def ranking_stability(spark: SparkSession, sf: str) -> DataFrame:
    # To a millionth of a price, so that equal means tie in whatever order their rows were added up.
    v = _t(spark, sf, "orders").groupBy("o_orderpriority", "o_custkey").agg(F.round(F.avg("o_totalprice"), 6).alias("v"))
    return rounded(references.ranking_stability(v, "o_orderpriority", "o_custkey", "v"), "rho")
