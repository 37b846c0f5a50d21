"""Registered queries of the features over sparse positions, caches and texts of mixed kinds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import saved, shared_folder
from ..operators import information, verification
from ..sources import converters, flatten
from ..sources.vectors import VectorCache
from .nested import _COLS, _line_pairs
from .queries import ORACLES, _t, query, rounded


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of orders as documents of three positions: run, position, value."""
    rows = saved(_t(spark, sf, "lineitem").select(F.monotonically_increasing_id().alias("run"), *_COLS), "runs")
    return rows.select("run", F.explode(F.create_map(*[x for c in _COLS for x in (F.lit(c), F.col(c).cast("string"))])).alias("position", "value"))


@query(ORACLES["mutual_information"])
def sparse_mutual_information(spark: SparkSession, sf: str) -> DataFrame:
    """The mutual information of positions known only as cells."""
    p = information.sparse_pairs(_cells(spark, sf), "run", "position", "value")
    order = F.array_position(F.array(*map(F.lit, _COLS)), F.col("a")) < F.array_position(F.array(*map(F.lit, _COLS)), F.col("b"))
    return rounded(p.select(F.when(order, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(order, F.col("b")).otherwise(F.col("a")).alias("b"), "mutual"), "mutual")


@query(ORACLES["tree_information"])
def sparse_tree_information(spark: SparkSession, sf: str) -> DataFrame:
    """The information tree by Borůvka's rounds."""
    w = information.sparse_tree_weights(_cells(spark, sf))
    return w.agg(F.count("*").cast("int").alias("n_positions"), F.round(F.sum("weight"), 5).alias("total"))


@query(ORACLES["line_coverage"])
def prefix_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage with entropies only of the sets that occur."""
    key = ["l_orderkey", "l_linenumber", "l_partkey", "nxt"]
    c = information.prefix_coverage(_line_pairs(spark, sf), key, _t(spark, sf, "lineitem"), {x: F.col(f"s{i + 1}") for i, x in enumerate(_COLS)})
    return rounded(c.select(*key, "coverage"), "coverage")


@query("select count(*) as n_texts, count(distinct p_type) as computed, 0::bigint as computed_again, round(avg(length(p_type)), 6) as mean_length, round(avg(length(p_type) - length(replace(p_type, 'E', ''))), 6) as mean_e from part")
def cached_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of part types through a cache: the second run finds all there."""
    cache = VectorCache(spark, f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}", "lengths", 2)
    parts = _t(spark, sf, "part").select(F.col("p_type").alias("text"))
    before = cache.missing(parts).count()
    made = F.array(F.length("text").cast("double"), (F.length("text") - F.length(F.replace("text", F.lit("E"), F.lit("")))).cast("double"))
    out = cache.vectors(parts, lambda missing: missing.select("text", made.alias("vector")))
    again = cache.missing(parts).count()
    g = out.agg(F.count("vector").alias("n_texts"), F.avg(F.get("vector", F.lit(0))).alias("mean_length"), F.avg(F.get("vector", F.lit(1))).alias("mean_e"))
    return rounded(g.select("n_texts", F.lit(before).cast("long").alias("computed"), F.lit(again).cast("long").alias("computed_again"), "mean_length", "mean_e"), "mean_length", "mean_e")


_KIND = "case event_id % 4 when 0 then 'json' when 1 then 'xml' when 2 then 'toml' else 'yaml' end"
_MIXED = "case event_id % 4 when 1 then concat('<e><k>', event_type, '</k></e>') when 3 then concat('k: ', event_type) else props end"


@query(f"with e as (select event_id, event_type, {_KIND} as kind, props from events) select event_id, case when kind = 'toml' then 'unsupported kind: toml' when kind = 'json' and not json_valid(props) then 'cannot be read as json' end as reason, case when kind in ('xml', 'yaml') then event_type end as k from e")
def structured_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of mixed kinds, each read as what it says it is."""
    e = _t(spark, sf, "events").select("event_id", F.expr(_MIXED).alias("text"), F.expr(_KIND).alias("kind"))
    s = e.select("event_id", "kind", converters.structured(F.col("text"), F.col("kind")).alias("s"))
    leaf = F.coalesce(F.try_element_at("s.doc", F.lit("$.k")), F.try_element_at("s.doc", F.lit("$.e.k")))
    return s.select("event_id", F.col("s.reason").alias("reason"), F.when(F.col("kind").isin("xml", "yaml"), leaf["sval"]).alias("k"))


@query("select event_id, case when event_id % 7 = 0 then 'no answer' end as itself, case when event_id % 7 = 0 then 1 else len(json_keys(props)) end::bigint as n_fields from events")
def prepared_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Outputs as documents; what cannot be read is a document of its own text."""
    e = _t(spark, sf, "events").select("event_id", flatten.prepared(F.when(F.col("event_id") % 7 == 0, F.lit("no answer")).otherwise(F.col("props"))).alias("d"))
    return e.select("event_id", F.try_element_at("d", F.lit("$"))["sval"].alias("itself"), F.size("d").cast("long").alias("n_fields"))


@query("with c as (select conv_id, list(role order by turn) as r from conversations group by 1), p as (select conv_id % 10 as prompt_id, case when conv_id % 7 <> 0 or conv_id % 10 = 3 then r end as r from c), f as (select prompt_id, r[1] as f, count(*) as k from p where r is not null group by all), a as (select prompt_id, max(k) / sum(k) as agree from f group by 1), t as (select prompt_id, count(distinct x) as tools from (select prompt_id, unnest(r) as x from p) group by 1), g as (select prompt_id, count(*) as n, count(r) / count(*) as v, avg(len(r)) as m from p group by 1) select prompt_id, n as n_outputs, round(v, 6) as validity, round(m, 6) as mean_calls, tools as n_tools, round(agree, 6) as first_agreement, round(least(1, greatest(0, 0.7 + case when v > 0.9 then 0.2 when v < 0.5 then -0.3 else 0 end + case when tools > 3 then -0.2 when tools <= 1 then 0.15 else 0 end + case when agree > 0.8 then 0.25 when agree < 0.5 then -0.2 else 0 end)), 6) as predicted, round(least(0.8, 0.3 + 0.1 * ((v > 0.9 or v < 0.5)::int + (tools > 3 or tools <= 1)::int + (agree > 0.8 or agree < 0.5)::int)), 6) as confidence from g join t using (prompt_id) join a using (prompt_id)")
def early_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as outputs of ten prompts, whose roles in order are what they call; some are invalid."""
    c = _t(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("r"))
    valid = (F.col("conv_id") % 7 != 0) | (F.col("conv_id") % 10 == 3)
    p = verification.early_prediction(c.select((F.col("conv_id") % 10).alias("prompt_id"), F.when(valid, F.col("r")).alias("names")))
    return rounded(p, "validity", "mean_calls", "first_agreement", "predicted", "confidence")
