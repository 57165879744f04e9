"""Every operator as a query over the fixture tables, beside the SQL that it must equal.

The field data's own inputs don't exist here, so each query runs its operator on whole fixture tables that stand
in for them. Fractions are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshwright.functions import aggregates as agg
from meshwright.functions import kernels
from meshwright.functions import scalars as fn
from meshwright.operators import audit, features, geometry, graphs, mapping, relational, spectra
from meshwright.operators.components import connected_components
from meshwright.operators.ordering import quantiles
from meshwright.plans.registry import QUERIES, SQL, query, rounded  # noqa: F401
from meshwright.shared import written
from meshwright.sources import reports


def predictions(t: Callable[[str], DataFrame]) -> DataFrame:
    """Prices of line items, and a prediction from quantity and retail price."""
    p = t("part").select("p_partkey", "p_brand", "p_retailprice")
    return t("lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select("p_brand", "l_suppkey", "l_returnflag", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * F.col("p_retailprice")).alias("p"))


_PRED = "select p_brand, l_suppkey, l_returnflag, l_extendedprice as y, l_quantity * p_retailprice as p from lineitem join part on l_partkey = p_partkey"
_METRICS = """count(*) as n, round(sqrt(avg((p - y) * (p - y))), 6) as rmse, round(avg(abs(p - y)), 6) as mae,
  round(sqrt(avg((p - y) * (p - y))) / nullif(max(y) - min(y), 0), 6) as nrmse_range,
  round(1 - sum((p - y) * (p - y)) / nullif(var_pop(y) * count(*), 0), 6) as r2, round(covar_pop(y, p) / nullif(stddev_pop(y) * stddev_pop(p), 0), 6) as pearson_r"""


@query(f"with x as ({_PRED}) select p_brand, {_METRICS} from x group by p_brand")
def metric_bundle_by_group(t):
    return rounded(agg.metrics_by(predictions(t), ["p_brand"], "y", "p"))


@query(f"""with x as ({_PRED}), g as (select l_suppkey, sqrt(avg((p - y) * (p - y))) as rmse, avg(abs(p - y)) as mae from x group by l_suppkey)
select s_nationkey, count(*) as n, round(avg(rmse), 6) as rmse, round(avg(mae), 6) as mae from g join supplier on l_suppkey = s_suppkey group by s_nationkey""")
def metrics_per_graph_then_mean(t):
    each = agg.metrics_by(predictions(t), ["l_suppkey"], "y", "p").select("l_suppkey", "rmse", "mae")
    s = t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return rounded(each.join(s, "l_suppkey").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae")))


@query(f"""with x as ({_PRED}), a as (select 'by_price' as model, y, p from x union all select 'mean_price', y, avg(y) over () from x),
m as (select model, sqrt(avg((p - y) * (p - y))) as rmse, avg(abs(p - y)) as mae from a group by model)
select case model when 'by_price' then 1 else 2 end as rank, model, round(rmse, 6) as rmse, round(mae, 6) as mae,
  round(100 * (1 - rmse / (select rmse from m where model = 'mean_price')), 6) as rmse_reduction_pct from m""")
def model_comparison_ranked(t):
    x = predictions(t).select("y", "p")
    mean = x.agg(F.avg("y").alias("p"))
    both = x.withColumn("model", F.lit("by_price")).unionByName(x.select("y").crossJoin(F.broadcast(mean)).withColumn("model", F.lit("mean_price")))
    m = agg.metrics_by(both, ["model"], "y", "p").select("model", "rmse", "mae")
    base = m.filter("model = 'mean_price'").select(F.col("rmse").alias("base"))
    order = F.array_position(F.array(F.lit("by_price"), F.lit("mean_price")), F.col("model")).cast("int")
    return rounded(m.crossJoin(F.broadcast(base)).select(order.alias("rank"), "model", "rmse", "mae", (100 * (1 - F.col("rmse") / F.col("base"))).alias("rmse_reduction_pct")))


@query("select p_type, count(p_retailprice) as n, round(min(p_retailprice), 6) as low, round(max(p_retailprice), 6) as high, round(median(p_retailprice), 6) as mid from part group by p_type")
def group_multi_agg(t):
    w = agg.wide_stats(t("part"), ["p_type"], ["p_retailprice"])
    return rounded(w.select("p_type", *[F.col(f"p_retailprice_{a}").alias(b) for a, b in (("count", "n"), ("min", "low"), ("max", "high"), ("median", "mid"))]))


_WIDE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("select l_returnflag, " + ", ".join(f"count({c}) as {c}_count, round(avg({c}), 6) as {c}_mean, round(stddev_samp({c}), 6) as {c}_std, round(min({c}), 6) as {c}_min, round(median({c}), 6) as {c}_median, round(max({c}), 6) as {c}_max" for c in _WIDE) + " from lineitem group by 1")
def wide_stats(t):
    return rounded(agg.wide_stats(t("lineitem"), ["l_returnflag"], _WIDE))


@query("select o_orderstatus, count(*) as n from orders group by 1")
def value_counts(t):
    return t("orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


_STATUS = ("F", "O", "P")


@query("select o_orderpriority, " + ", ".join(f"count(*) filter (o_orderstatus = '{s}') as \"{s}\"" for s in _STATUS) + " from orders group by 1")
def crosstab_fill0(t):
    return relational.crosstab(t("orders"), "o_orderpriority", "o_orderstatus", list(_STATUS))


@query("""select o_orderpriority, count(*) as original_n, count(*) filter (o_orderstatus = 'F') as kept_n, count(*) - count(*) filter (o_orderstatus = 'F') as excluded_n,
  round(100 * count(*) filter (o_orderstatus = 'F') / count(*), 6) as retention_pct from orders group by 1""")
def attrition(t):
    return rounded(relational.attrition(t("orders"), t("orders").filter("o_orderstatus = 'F'"), ["o_orderpriority"]))


@query("""with a as (select c_nationkey as k, count(*) as n from customer where c_acctbal < 0 group by 1), b as (select s_nationkey as k, count(*) as n from supplier group by 1)
select coalesce(a.k, b.k) as nationkey, coalesce(a.n, 0) as n_left, coalesce(b.n, 0) as n_right from a full join b on a.k = b.k""")
def overall_outer_alignment(t):
    return relational.aligned_counts(t("customer").filter("c_acctbal < 0").select(F.col("c_nationkey").alias("nationkey")), t("supplier").select(F.col("s_nationkey").alias("nationkey")), "nationkey")


@query("""with l as (select l_orderkey, count(*) as n_lines, round(sum(l_extendedprice), 6) as total from lineitem group by 1)
select o_orderkey, round(o_totalprice, 6) as o_totalprice, n_lines, total from orders left join l on o_orderkey = l_orderkey""")
def one_to_one_left(t):
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_extendedprice").alias("total"))
    return rounded(relational.one_to_one(t("orders").select("o_orderkey", "o_totalprice"), lines, ["o_orderkey"]))


@query("select c_custkey, n_name, r_name from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def lookup_broadcast(t):
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return c.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("c_custkey", "n_name", "r_name")


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders)")
def semi_filter(t):
    return t("customer").join(t("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null and o_totalprice > 300000)")
def anti_missing(t):
    return t("customer").join(t("orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("""select (select count(*) from lineitem where l_partkey in (select p_partkey from part)) as found,
  (select count(*) from lineitem where l_partkey not in (select p_partkey from part)) as missing""")
def exact_lookup_gate(t):
    hit = t("lineitem").select("l_partkey").join(t("part").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("hit")), "l_partkey", "left")
    return hit.agg(F.count_if("hit").alias("found"), F.count_if(F.col("hit").isNull()).alias("missing"))


@query("select l_partkey, count(distinct l_suppkey) as n, list_sort(list(distinct l_suppkey))::varchar as suppliers from lineitem group by 1 having count(distinct l_suppkey) > 1")
def cross_location_duplicates(t):
    g = t("lineitem").groupBy("l_partkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("s")).filter("size(s) > 1")
    return g.select("l_partkey", F.size("s").cast("bigint").alias("n"), F.concat(F.lit("["), F.array_join(F.col("s").cast("array<string>"), ", "), F.lit("]")).alias("suppliers"))


def _checkpoints(t) -> DataFrame:
    rules = {"price not positive": F.col("o_totalprice") <= 1000, "urgent but open": (F.col("o_orderpriority").startswith("1")) & (F.col("o_orderstatus") == "O")}
    return t("orders").select("o_orderkey", (F.col("o_orderstatus") != "P").alias("success"), (F.col("o_orderkey") % 7 == 0).alias("failure"), audit.issues(rules).alias("problems"), (F.col("o_orderkey") % 3 > 0).alias("readable"), (F.col("o_orderkey") % 11 == 0).alias("elsewhere"))


_CHECK = """select o_orderkey, o_orderstatus <> 'P' as success, o_orderkey % 7 = 0 as failure, list_filter([case when o_totalprice <= 1000 then 'price not positive' end,
  case when starts_with(o_orderpriority, '1') and o_orderstatus = 'O' then 'urgent but open' end], lambda x: x is not null) as problems, o_orderkey % 3 > 0 as readable, o_orderkey % 11 = 0 as elsewhere from orders"""


@query(f"""with c as ({_CHECK}) select o_orderkey, case when not success and not failure then 'MISSING_OR_IN_PROGRESS' when success and failure then 'INVALID_CONFLICT'
  when success and len(problems) = 0 and elsewhere then 'INVALID_CROSS_WORKER_DUPLICATE' when success and len(problems) = 0 then 'VERIFIED' when success then 'INVALID_SUCCESS_CHECKPOINT'
  when readable then 'TERMINAL_QC_FAILURE' else 'INVALID_FAILURE_RECORD' end as status from c""")
def status_state_machine(t):
    c = _checkpoints(t)
    return c.select("o_orderkey", audit.status(*[F.col(x) for x in ("success", "failure", "problems", "readable", "elsewhere")]).alias("status"))


@query(f"with c as ({_CHECK}) select o_orderkey, array_to_string(problems, ' | ') as issues from c where len(problems) > 0")
def issue_list(t):
    return _checkpoints(t).filter("size(problems) > 0").select("o_orderkey", F.array_join("problems", " | ").alias("issues"))


@query("with x as (select doc_id, lower(concat_ws(' ', source, text)) as t from documents) select doc_id, case " + " ".join(f"when {' or '.join(f'''contains(t, '{k}')''' for k in keys)} then '{name}'" for name, keys in audit.FAILURES) + " else 'other' end as category from x")
def failure_category(t):
    return t("documents").select("doc_id", audit.failure_category(F.col("source"), F.col("text")).alias("category"))


@query("""select unnest(['balances_finite', 'keys_unique', 'all_positive']) as gate, unnest([bool_and(isfinite(c_acctbal)), count(distinct c_custkey) = count(*), bool_and(c_acctbal > 0)]) as pass from customer""")
def gate_table(t):
    return audit.gates(t("customer"), balances_finite=agg.all_true(fn.finite(F.col("c_acctbal"))), keys_unique=F.countDistinct("c_custkey") == F.count(F.lit(1)), all_positive=agg.all_true(F.col("c_acctbal") > 0))


@query("""with a as (select distinct o_custkey as k from orders), b as (select c_custkey as k from customer)
select (select count(*) from a where k not in (select k from b)) as missing_right, (select count(*) from b where k not in (select k from a)) as missing_left,
  (select count(*) from a where k not in (select k from b)) + (select count(*) from b where k not in (select k from a)) = 0 as equal""")
def set_equality_gates(t):
    return relational.set_gate(t("orders").select(F.col("o_custkey").alias("k")), t("customer").select(F.col("c_custkey").alias("k")))


@query("""with s as (select distinct o_orderstatus as split, o_custkey as k from orders) select a.split as a, b.split as b, count(*) as shared from s a join s b on a.k = b.k and a.split < b.split group by 1, 2""")
def split_leakage(t):
    s = t("orders").select(F.col("o_orderstatus").alias("split"), F.col("o_custkey").alias("k")).distinct()
    a, b = s.withColumnRenamed("split", "a"), s.withColumnRenamed("split", "b")
    return a.join(b, "k").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


@query("""with x as (select s_nationkey, s_suppkey, row_number() over (partition by s_nationkey order by s_suppkey) - 1 as r from supplier)
select s_nationkey, s_suppkey, (r // 2)::bigint as shard, (r % 2 + 1)::bigint as position from x""")
def assignment_cover(t):
    return relational.shards(t("supplier").select("s_nationkey", "s_suppkey"), ["s_nationkey"], [F.col("s_suppkey")], 2)


def _supply_edges(t) -> DataFrame:
    return t("lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), F.col("l_extendedprice").alias("path_length"), "l_orderkey", "l_linenumber")


@query("""with e as (select least(l_partkey, l_suppkey) as source, greatest(l_partkey, l_suppkey) as target, l_extendedprice as path_length, l_orderkey, l_linenumber from lineitem where l_partkey <> l_suppkey)
select source, target, round(path_length, 6) as path_length, l_orderkey, l_linenumber from e qualify row_number() over (partition by source, target order by path_length, l_orderkey, l_linenumber) = 1""")
def dedup_shortest_edge(t):
    return rounded(relational.dedup_edges(_supply_edges(t), F.col("l_orderkey"), F.col("l_linenumber")))


@query("select doc_id, sha256(text) as digest from documents qualify count(*) over (partition by sha256(text)) > 1")
def duplicates_keep_false(t):
    d = t("documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    many = d.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest")
    return d.join(many, "digest", "left_semi").select("doc_id", "digest")


@query("select lang, source, min(doc_id) as doc_id from documents group by lang, source")
def distinct_on_subset(t):
    return relational.first_by(t("documents").select("lang", "source", "doc_id"), ["lang", "source"], F.col("doc_id"))


_RANKED = "select p_brand, p_partkey, p_retailprice, row_number() over (partition by p_brand order by p_retailprice, p_partkey) - 1 as r, count(*) over (partition by p_brand) as n from part"


@query(f"with x as ({_RANKED}) select p_brand, p_partkey, case when r = 0 then 'low' when r = n - 1 then 'high' else 'mid' end as position from x where r in (0, n // 2, n - 1)")
def first_mid_last(t):
    return relational.low_mid_high(t("part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], F.col("p_retailprice"), F.col("p_partkey")).select("p_brand", "p_partkey", "position")


@query(f"with x as ({_RANKED}) select p_brand, min(p_partkey) filter (r = 0) as low, min(p_partkey) filter (r = n - 1) as high from x group by 1")
def low_high(t):
    return t("part").groupBy("p_brand").agg(F.min(F.struct("p_retailprice", "p_partkey")).alias("a"), F.max(F.struct("p_retailprice", "p_partkey")).alias("b")).select("p_brand", F.col("a.p_partkey").alias("low"), F.col("b.p_partkey").alias("high"))


@query("""with m as (select p_brand, median(p_retailprice) as m from part group by 1)
select p_brand, p_partkey from part join m using (p_brand) qualify row_number() over (partition by p_brand order by round(abs(p_retailprice - m), 9), p_partkey) = 1""")
def nearest_to_median(t):
    m = t("part").groupBy("p_brand").agg(F.median("p_retailprice").alias("m"))
    near = t("part").join(m, "p_brand").groupBy("p_brand").agg(F.min(F.struct(F.round(F.abs(F.col("p_retailprice") - F.col("m")), 9).alias("d"), "p_partkey")).alias("x"))
    return near.select("p_brand", F.col("x.p_partkey").alias("p_partkey"))


@query("""with x as (select c_custkey, c_mktsegment, row_number() over (partition by c_mktsegment order by c_custkey) - 1 as r, count(*) over (partition by c_mktsegment) as n from customer)
select c_custkey, c_mktsegment, case when r < floor(n * 0.6::double) then 'train' when r < floor(n * 0.8::double) then 'validation' else 'test' end as split from x""")
def stratified_split(t):
    return relational.stratified_split(t("customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", [F.col("c_custkey")], 0.6, 0.2)


@query()
def stratified_split_hashed(t):
    return relational.stratified_split(t("customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", [F.xxhash64(F.lit(7), "c_custkey")], 0.6, 0.2)


@query("""with x as (select c_custkey, c_mktsegment, row_number() over (partition by c_mktsegment <> 'BUILDING' order by c_custkey) - 1 as r, count(*) over (partition by c_mktsegment <> 'BUILDING') as n from customer)
select c_custkey, c_mktsegment, case when c_mktsegment = 'BUILDING' then 'test' when r < floor(n * 0.2::double) then 'validation' else 'train' end as "leave_BUILDING" from x""")
def leave_one_group_out(t):
    return relational.leave_one_out(t("customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ["BUILDING"], [F.col("c_custkey")], 0.2)


@query()
def latin_hypercube(t):
    spark = t("region").sparkSession
    return relational.latin_hypercube(spark.range(120).withColumnRenamed("id", "i"), 120, [f"d{k}" for k in range(6)])


_FIT = "where o_orderdate < timestamp '1997-01-01'"


@query(f"""with s as (select avg(o_totalprice) as m, stddev_pop(o_totalprice) as s from orders {_FIT}) select o_orderkey, round((o_totalprice - m) / s, 6) as z from orders, s""")
def zscore_train_only(t):
    o = t("orders")
    return rounded(features.zscored(o.select("o_orderkey", F.col("o_totalprice").alias("z")), o.filter("o_orderdate < timestamp_ntz '1997-01-01'").select(F.col("o_totalprice").alias("z")), ["z"]))


@query(f"""with s as (select avg(ln(1 + o_totalprice)) as m, stddev_pop(ln(1 + o_totalprice)) as s from orders {_FIT}),
z as (select o_orderkey, (ln(1 + o_totalprice) - m) / s as z, m, s from orders, s) select o_orderkey, round(z, 6) as z, round(exp(z * s + m) - 1, 4) as back from z""")
def log1p_target_roundtrip(t):
    o = t("orders").withColumn("v", F.log1p("o_totalprice"))
    stats = agg.mean_std(o.filter("o_orderdate < timestamp_ntz '1997-01-01'"), ["v"]).drop("n_fit")
    z = o.crossJoin(F.broadcast(stats)).withColumn("z", (F.col("v") - F.col("v_mean")) / F.col("v_std"))
    return z.select("o_orderkey", F.round("z", 6).alias("z"), F.round(F.expm1(F.col("z") * F.col("v_std") + F.col("v_mean")), 4).alias("back"))


_PRIORITIES = ("1-URGENT", "2-HIGH", "5-LOW")


@query("select o_orderkey, " + ", ".join(f"(o_orderpriority = '{p}')::double as \"p_{p}\"" for p in _PRIORITIES) + ", round(sin(2 * pi() * month(o_orderdate) / 12), 6) + 0.0 as sin_month, round(cos(2 * pi() * month(o_orderdate) / 12), 6) + 0.0 as cos_month from orders")
def onehot_trig_features(t):
    a = 2 * F.pi() * F.month("o_orderdate") / 12
    return rounded(t("orders").select("o_orderkey", *fn.one_hot(F.col("o_orderpriority"), _PRIORITIES, "p"), F.sin(a).alias("sin_month"), F.cos(a).alias("cos_month")))


@query("select p_partkey, round((p_retailprice - (select min(p_retailprice) from part)) / greatest((select max(p_retailprice) - min(p_retailprice) from part), 1e-12), 6) as v from part")
def min_max_normalise(t):
    r = t("part").agg(F.min("p_retailprice").alias("a"), F.max("p_retailprice").alias("b"))
    return rounded(t("part").crossJoin(F.broadcast(r)).select("p_partkey", ((F.col("p_retailprice") - F.col("a")) / F.greatest(F.col("b") - F.col("a"), F.lit(1e-12))).alias("v")))


_Q = (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


@query("select l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 6) as q{i}" for i, q in enumerate(_Q)) + " from lineitem group by 1")
def multi_quantiles(t):
    g = quantiles(t("lineitem"), ["l_returnflag"], ["l_extendedprice"], _Q)
    return rounded(g.select("l_returnflag", *[F.col("q")[i].alias(f"q{i}") for i in range(len(_Q))]))


def _vectors(t, n: int) -> DataFrame:
    return t("embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(n)])


_E = lambda n: "select vec_id, label, " + ", ".join(f"embedding[{i + 1}]::double as e{i}" for i in range(n)) + " from embeddings"


@query(f"with v as ({_E(3)}) select label, round(sum(e0 * greatest(vec_id % 5, 1)) / sum(greatest(vec_id % 5, 1)), 6) as x, bool_or(vec_id % 9 = 0) or count(*) > 60 as junction from v group by 1")
def weighted_centroid(t):
    w = (F.col("vec_id") % 5).cast("double")
    return rounded(_vectors(t, 3).groupBy("label").agg(agg.weighted_mean(F.col("e0"), w).alias("x"), (F.bool_or(F.col("vec_id") % 9 == 0) | (F.count(F.lit(1)) > 60)).alias("junction")))


_KNN = f"""with v as ({_E(3)}), q as (select * from v where vec_id % 100 = 0),
n as (select q.vec_id as qid, v.vec_id as pid, sqrt((q.e0 - v.e0) * (q.e0 - v.e0) + (q.e1 - v.e1) * (q.e1 - v.e1) + (q.e2 - v.e2) * (q.e2 - v.e2)) as dist from q, v),
k as (select *, row_number() over (partition by qid order by dist, pid) as rank from n)"""


def _knn(t, k: int) -> DataFrame:
    v = _vectors(t, 3).select(F.col("vec_id").alias("pid"), F.col("e0").alias("x"), F.col("e1").alias("y"), F.col("e2").alias("z"))
    return written(mapping.knn(v.filter("pid % 100 = 0").withColumnRenamed("pid", "qid"), v, k), "knn")


@query(f"{_KNN} select qid, rank, pid, round(dist, 6) as dist from k where rank <= 32")
def knn_join(t):
    return rounded(_knn(t, 32))


@query(f"{_KNN} select qid, round(sum(label / greatest(dist, 1e-9) ** 2) / sum(1 / greatest(dist, 1e-9) ** 2), 6) as v from k join v on pid = vec_id where rank between 2 and 33 group by qid")
def idw_map(t):
    n = _knn(t, 33).filter("rank > 1")
    return rounded(mapping.idw(n, t("embeddings").select(F.col("vec_id").alias("pid"), F.col("label").cast("double").alias("v")), ["v"]))


@query(f"""{_KNN}, m as (select k.qid, c.c, sum(label / greatest(dist, 1e-9) ** 2) / sum(1 / greatest(dist, 1e-9) ** 2) as v from k join v on pid = vec_id, (values (16), (32), (64)) c(c) where rank between 2 and c.c + 1 group by all)
select a.c as k, round(sqrt(avg((a.v - b.v) ** 2)) / greatest(sqrt(avg(b.v ** 2)), 1e-12), 6) as relative_rmse from m a join m b on a.qid = b.qid and b.c = 64 group by 1""")
def idw_k_sensitivity(t):
    n = _knn(t, 65).filter("rank > 1")
    values = t("embeddings").select(F.col("vec_id").alias("pid"), F.col("label").cast("double").alias("v"))
    maps = {k: mapping.idw(n.filter(F.col("rank") <= k + 1), values, ["v"]) for k in (16, 32, 64)}
    ref, out = maps[64].withColumnRenamed("v", "r"), None
    for k, m in maps.items():
        one = m.join(ref, "qid").agg(F.lit(k).alias("k"), (F.sqrt(F.avg((F.col("v") - F.col("r")) * (F.col("v") - F.col("r")))) / F.greatest(F.sqrt(F.avg(F.col("r") * F.col("r"))), F.lit(1e-12))).alias("relative_rmse"))
        out = one if out is None else out.union(one)
    return rounded(out)


def _nation_graph(t) -> DataFrame:
    return t("supplier").select(F.lit("g").alias("sample_id"), F.col("s_suppkey").alias("source"), (F.col("s_nationkey").cast("bigint") + 1_000_000).alias("target"))


@query("""with e as (select s_suppkey as a, s_nationkey + 1000000 as b from supplier), d as (select a, b from e union all select b, a from e) select a as node, count(*) as degree from d group by 1""")
def edges_doubled_degree(t):
    return graphs.doubled(_nation_graph(t)).groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


@query("select s_suppkey, (dense_rank() over (partition by s_nationkey order by s_suppkey) - 1)::bigint as node from supplier where s_acctbal > 0")
def reindex_dense(t):
    return relational.reindexed(t("supplier").filter("s_acctbal > 0").select("s_nationkey", "s_suppkey"), "s_suppkey", "node", ("s_nationkey",)).select("s_suppkey", "node")


@query("""with x as (select user_id, abs(value - lag(value) over (partition by user_id order by ts, event_id)) as d from events) select user_id, round(coalesce(sum(d), 0), 6) as length, count(d) as steps from x group by 1""")
def path_length_lag(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    d = t("events").select("user_id", F.abs(F.col("value") - F.lag("value").over(w)).alias("d"))
    return rounded(d.groupBy("user_id").agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("length"), F.count("d").alias("steps")))


@query("""with m as (select year(l_shipdate) * 100 + month(l_shipdate) as m, sum(l_extendedprice) as v from lineitem group by 1), x as (select m, v, lag(v) over (order by m) as b from m)
select m::int as month, round(100 * abs(v - b) / greatest(abs(b), 1e-12), 6) as pct from x""")
def consecutive_pct_change(t):
    m = t("lineitem").groupBy((F.year("l_shipdate") * 100 + F.month("l_shipdate")).alias("month")).agg(F.sum("l_extendedprice").alias("v"))
    return rounded(m.withColumn("b", F.lag("v").over(Window.orderBy("month"))).select("month", fn.percent_change(F.col("b"), F.col("v")).alias("pct")))


@query("select l_returnflag, row_number() over (partition by l_returnflag, l_linestatus, l_suppkey order by l_extendedprice, l_orderkey, l_linenumber) as rank, l_linestatus, l_suppkey, round(l_extendedprice, 6) as v from lineitem")
def rank_curve(t):
    w = Window.partitionBy("l_returnflag", "l_linestatus", "l_suppkey").orderBy("l_extendedprice", "l_orderkey", "l_linenumber")
    return rounded(t("lineitem").select("l_returnflag", F.row_number().over(w).alias("rank"), "l_linestatus", "l_suppkey", F.col("l_extendedprice").alias("v")))


@query("""with recursive e as (select user_id, value as v, row_number() over (partition by user_id order by ts, event_id) as e from events),
f as (select user_id, e, v as best, e as best_epoch, 0 as bad from e where e = 1
  union all select e.user_id, e.e, case when e.v < f.best - 0.0001 then e.v else f.best end, case when e.v < f.best - 0.0001 then e.e else f.best_epoch end, case when e.v < f.best - 0.0001 then 0 else f.bad + 1 end
  from f join e on e.user_id = f.user_id and e.e = f.e + 1 where f.bad < 5)
select user_id, best_epoch::bigint as best_epoch, round(best, 6) as best, e::bigint as stop_epoch from f qualify row_number() over (partition by user_id order by e desc) = 1""")
def running_best_stop_epoch(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t("events").select("user_id", F.col("value"), F.row_number().over(w).alias("epoch"))
    return rounded(relational.running_best(e, ["user_id"], "epoch", "value", 1e-4, 5))


@query("select vec_id, " + ", ".join(f"round(embedding[{i + 1}]::double, 6) as lambda_{i + 1}" for i in range(10)) + " from embeddings")
def array_to_columns(t):
    return rounded(t("embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"lambda_{i + 1}") for i in range(10)]))


_KEYS = "select distinct n_nationkey as a, (n_nationkey * 7 + 3) % 12 as b from nation"


@query(f"""with recursive e as ({_KEYS}), d as (select a, b from e union select b, a from e), r as (select distinct a as node, a as root from d union select d.b, r.root from r join d on d.a = r.node)
select node::bigint as node, min(root)::bigint as root from r group by 1""")
def connected_components_nodes(t):
    e = t("nation").select(F.col("n_nationkey").cast("bigint").alias("a"), ((F.col("n_nationkey") * 7 + 3) % 12).cast("bigint").alias("b"))
    return connected_components(e)


def _vector_graph(t) -> tuple[DataFrame, DataFrame]:
    """Nodes at embeddings, one sample for each label, and edges to the next two vectors of the label."""
    w = Window.partitionBy("label").orderBy("vec_id")
    v = _vectors(t, 3).withColumns({"t1": F.lead("vec_id", 1).over(w), "t2": F.lead("vec_id", 3).over(w)})
    sid = F.col("label").cast("string").alias("sample_id")
    nodes = v.select(sid, F.col("vec_id").alias("node"), F.col("e0").alias("x"), F.col("e1").alias("y"), F.col("e2").alias("z"), F.when(F.col("vec_id") % 3 == 0, "junction").otherwise("endpoint").alias("kind"), (F.col("vec_id") % 4).alias("region_voxels"))
    e = v.select(sid, F.col("vec_id").alias("source"), F.explode(F.array("t1", "t2")).alias("target")).filter("target is not null")
    return nodes, e.withColumn("path_length", (F.pmod(F.col("source") * 31 + F.col("target") * 17, F.lit(100)) / 100))


_VG = f"""with recursive v as (select *, lead(vec_id, 1) over (partition by label order by vec_id) as t1, lead(vec_id, 3) over (partition by label order by vec_id) as t2 from ({_E(3)})),
e0 as (select label, vec_id as source, unnest([t1, t2]) as target from v), e as (select *, ((source * 31 + target * 17) % 100) / 100 as w from e0 where target is not null)"""


@query(f"""{_VG}, d as (select source as a, target as b from e where w < 0.3 union select target, source from e where w < 0.3), r as (select vec_id as node, vec_id as root from v union select d.b, r.root from r join d on d.a = r.node),
c as (select node, min(root) as root from r group by 1)
select label::varchar as sample_id, root as node, round(sum(e0 * greatest(vec_id % 4, 1)) / sum(greatest(vec_id % 4, 1)), 6) as x, case when bool_or(vec_id % 3 = 0) or count(*) > 1 then 'junction' else 'endpoint' end as kind from v join c on vec_id = node group by 1, 2""")
def contract_short_edges(t):
    return rounded(graphs.contract_short_edges(*_vector_graph(t), 0.3)[0].select("sample_id", "node", "x", "kind"))


@query(f"""{_VG}, d as (select source as a, target as b from e where w < 0.3 union select target, source from e where w < 0.3), r as (select vec_id as node, vec_id as root from v union select d.b, r.root from r join d on d.a = r.node),
c as (select node, min(root) as root from r group by 1)
select label::varchar as sample_id, least(s.root, t.root) as source, greatest(s.root, t.root) as target, round(min(w)::double, 6) as path_length from e join c s on s.node = source join c t on t.node = target where s.root <> t.root group by 1, 2, 3""")
def contracted_edges(t):
    return rounded(graphs.contract_short_edges(*_vector_graph(t), 0.3)[1].select("sample_id", "source", "target", "path_length"))


@query()
def prune_spurs(t):
    nodes, edges = _vector_graph(t)
    return rounded(graphs.degrees(*graphs.prune_spurs(nodes, edges.filter("path_length < 0.6"), 0.5)).select("sample_id", "node", "degree"))


@query(f"""{_VG}, g as (select e.*, a.e0 as ax, a.e1 as ay, a.e2 as az, b.e0 as bx, b.e1 as by_, b.e2 as bz from e join v a on source = a.vec_id join v b on target = b.vec_id),
h as (select *, sqrt((bx - ax) ** 2 + (by_ - ay) ** 2 + (bz - az) ** 2) as chord from g)
select source, target, round(chord, 6) as chord_length, round(greatest(w, chord) / chord, 6) as tortuosity, round(atan2(by_ - ay, bx - ax), 6) as azimuth, round(acos(greatest(-1, least(1, (bz - az) / chord))), 6) as polar from h""")
def recompute_geometry(t):
    return rounded(graphs.recomputed(*_vector_graph(t)).select("source", "target", "chord_length", "tortuosity", "azimuth", "polar"))


_N = 12


def _designs(t) -> DataFrame:
    """A design for each supplier."""
    k = F.col("s_suppkey")
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (k % n + 1).cast("int"))
    return t("supplier").select(
        k.cast("string").alias("sample_id"), pick(("gyroid", "diamond", "primitive"), 3).alias("architecture"), ((25 + F.col("s_nationkey")) / 100).alias("target_relative_density"), (4 + k % 5).cast("double").alias("cell_size_mm"),
        pick(("uniform", "linear", "sinusoidal", "linear"), 4).alias("grading_mode"), F.when(k % 4 == 0, 0.0).otherwise(k % 6 / 24).alias("grading_amplitude"), *[(F.lit(v) * (k % m)).alias(f"phase_{a}_rad") for a, v, m in zip("xyz", (0.1, 0.2, 0.3), (7, 11, 5), strict=True)],
    )


_DESIGNS = """(select s_suppkey::varchar as sample_id, ['gyroid', 'diamond', 'primitive'][s_suppkey % 3 + 1] as arch, ((25 + s_nationkey) / 100)::double as rho, (4 + s_suppkey % 5)::double as cell, ['uniform', 'linear', 'sinusoidal', 'linear'][s_suppkey % 4 + 1] as mode,
  case when s_suppkey % 4 = 0 then 0::double else (s_suppkey % 6) / 24 end as amp, 0.1::double * (s_suppkey % 7) as px, 0.2::double * (s_suppkey % 11) as py, 0.3::double * (s_suppkey % 5) as pz from supplier)"""
_FIELD = f"""with recursive g as (select range as id, range // {_N * _N} as i, range // {_N} % {_N} as j, range % {_N} as k from range({_N**3})),
p as (select sample_id, arch, rho, amp, mode, id, i, j, k, 2 * pi() * (-10 + (i + 0.5) * (20::double / {_N})) / cell + px as a, 2 * pi() * (-10 + (j + 0.5) * (20::double / {_N})) / cell + py as b, 2 * pi() * ((k + 0.5) * (20::double / {_N})) / cell + pz as c, (k + 0.5) / {_N} as z from g, {_DESIGNS}),
f as (select *, case arch when 'gyroid' then sin(a) * cos(b) + sin(b) * cos(c) + sin(c) * cos(a) when 'diamond' then sin(a) * sin(b) * sin(c) + sin(a) * cos(b) * cos(c) + cos(a) * sin(b) * cos(c) + cos(a) * cos(b) * sin(c) else cos(a) + cos(b) + cos(c) end as f,
  greatest(0.2, 1 + amp * case mode when 'linear' then 2 * z - 1 when 'sinusoidal' then sin(2 * pi() * z) else 0 end) as profile from p)"""
_MASKED = f"""{_FIELD}, l as (select sample_id, list(abs(f) / profile order by abs(f) / profile) as v, any_value(rho) * (count(*) - 1) as pos from f group by 1),
q as (select sample_id, v[floor(pos)::int + 1] * (1 - (pos - floor(pos))) + v[least(floor(pos)::int + 2, len(v))] * (pos - floor(pos)) as tau from l), m as (select f.*, tau from f join q using (sample_id) where abs(f) / profile <= tau + 1e-9)"""


def _fields(t) -> DataFrame:
    return geometry.field(_designs(t), _N)


def solid(t) -> DataFrame:
    """The voxels of every design's mask."""
    return written(geometry.masked(_fields(t)).filter("solid").select("sample_id", "id", "i", "j", "k", "tau"), "designs")


@query(f"{_FIELD} select sample_id, id, round(f, 6) + 0.0 as f, round(profile, 6) as profile from f")
def tpms_field_grid(t):
    return rounded(_fields(t).select("sample_id", "id", "f", "profile"))


@query(f"{_MASKED} select sample_id, round(max(tau), 6) as tau, round(count(*) / {_N**3}.0, 6) as density from m group by 1")
def calibrated_mask_density(t):
    return rounded(solid(t).groupBy("sample_id").agg(F.max("tau").alias("tau"), (F.count(F.lit(1)) / _N**3).alias("density")))


@query(f"{_MASKED} select sample_id, " + ", ".join(f"bool_or({c} = {v}) as touch_{a}{s}" for a, c in zip("xyz", "ijk", strict=True) for s, v in (("min", 0), ("max", _N - 1))) + " from m group by 1")
def boundary_contact(t):
    return geometry.boundary_contact(solid(t), _N)


def labels(x: str, out: str = "lab") -> str:
    """SQL tables, the last one ``out`` (sample_id, id, root): components of x (sample_id, id, i, j, k), flooded from voxels without a smaller neighbour."""
    near = " and ".join(f"b.{c} = a.{c} + o.d{c}" for c in "ijk")
    steps = ", ".join(str((a, b, c)) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0))
    return f"""{out}_o(di, dj, dk) as (values {steps}), {out}_n as (select a.sample_id, a.id, b.id as nid from {x} a, {out}_o o, {x} b where b.sample_id = a.sample_id and {near}),
{out}_s as (select sample_id, id from {x} except select sample_id, id from {out}_n where nid < id),
{out}_r as (select sample_id, id as root, id from {out}_s union select r.sample_id, r.root, n.nid from {out}_r r join {out}_n n on n.sample_id = r.sample_id and n.id = r.id),
{out} as (select sample_id, id, min(root) as root from {out}_r group by 1, 2)"""


@query(f"{_MASKED}, {labels('m')} select sample_id, root, count(*) as voxels from lab group by 1, 2")
def component_label_3d(t):
    return geometry.labelled(solid(t).drop("tau")).groupBy("sample_id", "root").agg(F.count(F.lit(1)).alias("voxels"))


@query(f"{_MASKED}, s as (select sample_id, id, i, j, k from m), o as (select * from (values (0, 1, 0, 0), (0, -1, 0, 0), (1, 0, 1, 0), (1, 0, -1, 0), (2, 0, 0, 1), (2, 0, 0, -1)) o(axis, a, b, c)) select sample_id, axis, count(*) as faces from s, o where not exists (select 1 from s n where n.sample_id = s.sample_id and n.i = s.i + a and n.j = s.j + b and n.k = s.k + c) group by 1, 2")
def surface_extract(t):
    return geometry.voxel_surface(solid(t)).groupBy("sample_id", "axis").agg(F.count(F.lit(1)).alias("faces"))


@query(f"""{_MASKED}, e as (select f.sample_id, f.i, f.j, f.k from f left join m on m.sample_id = f.sample_id and m.id = f.id where m.id is null),
d as (select m.sample_id, m.id, sqrt(min((m.i - e.i) ** 2 + (m.j - e.j) ** 2 + (m.k - e.k) ** 2)) as d from m join e on e.sample_id = m.sample_id group by 1, 2) select sample_id, round(max(d), 6) as deepest, round(sum(d) / {_N**3}, 6) as mean from d group by 1""")
def distance_transform(t):
    g = geometry.masked(_fields(t)).select("sample_id", "i", "j", "k", "solid")
    return rounded(kernels.distance_transform(g).groupBy("sample_id").agg(F.max("distance").alias("deepest"), F.avg("distance").alias("mean")))


_TENSOR = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


@query("""select l_orderkey, l_linenumber, round(sqrt(0.5 * ((l_quantity - l_discount) ** 2 + (l_discount - l_tax) ** 2 + (l_tax - l_quantity) ** 2) + 3 * (l_tax ** 2 + l_discount ** 2 + l_linenumber ** 2)), 6) as von_mises from lineitem""")
def von_mises(t):
    c = [F.col(x).cast("double") for x in ("l_quantity", "l_discount", "l_tax", "l_tax", "l_discount", "l_linenumber")]
    return rounded(t("lineitem").select("l_orderkey", "l_linenumber", fn.von_mises(*c).alias("von_mises")))


@query("""with x as (select *, (l_quantity + l_discount + l_tax) / 3 as m from lineitem) select l_orderkey, l_linenumber,
  round(sqrt(2 / 3 * ((l_quantity - m) ** 2 + (l_discount - m) ** 2 + (l_tax - m) ** 2 + 0.5 * (l_tax ** 2 + l_discount ** 2 + l_linenumber ** 2))), 6) as eq from x""")
def equivalent_strain(t):
    c = [F.col(x).cast("double") for x in ("l_quantity", "l_discount", "l_tax", "l_tax", "l_discount", "l_linenumber")]
    return rounded(t("lineitem").select("l_orderkey", "l_linenumber", fn.equivalent_strain(*c).alias("eq")))


def _cubes(t) -> tuple[DataFrame, DataFrame]:
    """A cube of five tetrahedra for each supplier, of its own side."""
    s = t("supplier").select(F.col("s_suppkey").cast("string").alias("sample_id"), (F.col("s_suppkey") % 7 + 1).cast("double").alias("h"))
    corner = F.explode(F.sequence(F.lit(0), F.lit(7)))
    p = s.select("sample_id", "h", corner.alias("nid")).select("sample_id", F.col("nid").cast("bigint").alias("nid"), *[(F.floor(F.col("nid") / d) % 2 * F.col("h")).cast("double").alias(a) for a, d in zip("xyz", (1, 2, 4), strict=True)])
    tets = [(0, 1, 2, 4), (3, 1, 2, 7), (5, 1, 4, 7), (6, 2, 4, 7), (1, 2, 4, 7)]
    rows = F.array(*[F.struct(F.lit(e).cast("bigint").alias("eid"), *[F.lit(v).cast("bigint").alias(f"n{k}") for k, v in enumerate(c)]) for e, c in enumerate(tets)])
    return p, s.select("sample_id", F.explode(rows).alias("t")).select("sample_id", "t.*")


@query("""select s_suppkey::varchar as sample_id, eid, round(case when eid = 4 then h ** 3 / 3 else h ** 3 / 6 end, 6) as volume,
  round(case when eid = 4 then 1.0 else 12 * (h ** 3 / 2) ** (2.0 / 3) / (9 * h ** 2) end, 6) as quality, round(case when eid = 4 then 1.0 else sqrt(2) end, 6) as edge_ratio from (select s_suppkey, (s_suppkey % 7 + 1)::double as h from supplier), (select range as eid from range(5))""")
def tet_volume_quality(t):
    p, tets = _cubes(t)
    return rounded(geometry.tet_measures(tets, p).select("sample_id", "eid", "volume", "quality", "edge_ratio"))


@query("select s_suppkey::varchar as sample_id, 12::bigint as faces from supplier")
def exterior_faces(t):
    return geometry.exterior_faces(_cubes(t)[1]).groupBy("sample_id").agg(F.count(F.lit(1)).alias("faces"))


@query("select s_suppkey::varchar as sample_id, e as end, nid::bigint as nid from supplier, (values ('bottom', 0), ('bottom', 1), ('bottom', 2), ('bottom', 3), ('top', 4), ('top', 5), ('top', 6), ('top', 7)) v(e, nid)")
def end_sets(t):
    p, tets = _cubes(t)
    return geometry.end_sets(tets, p, 0.5)


@query("select s_suppkey::varchar as sample_id, 0::bigint as anchor, 3::bigint as guide from supplier")
def anchors(t):
    return geometry.anchors(_cubes(t)[0].filter("z = 0"))


_CUBE = [(0, 2, 1), (1, 2, 3), (4, 5, 6), (5, 7, 6), (0, 1, 4), (1, 5, 4), (2, 6, 3), (3, 6, 7), (0, 4, 2), (2, 4, 6), (1, 3, 5), (3, 7, 5)]


@query("select s_suppkey::varchar as sample_id, round(6 * h ** 2, 6) as area, round(h ** 3, 6) as volume, true as watertight, true as winding_consistent, 18::bigint as edges from (select s_suppkey, (s_suppkey % 7 + 1)::double as h from supplier)")
def face_edges_surface_measures(t):
    p, tets = _cubes(t)
    faces = tets.select("sample_id").distinct().select("sample_id", F.explode(F.array(*[F.struct(*[F.lit(v).cast("bigint").alias(n) for n, v in zip("abc", f, strict=True)]) for f in _CUBE])).alias("f")).select("sample_id", "f.*")
    return rounded(geometry.surface_measures(faces, p))


def _report(t) -> DataFrame:
    """Events as lines of a solver report: heads now and then, records, and broken lines."""
    head = F.when(F.col("event_id") % 50 == 0, F.lit(" forces (fx,fy,fz) for set TOP")).when(F.col("event_id") % 50 == 20, F.lit(" stresses (elem, integ.pnt.,sxx..)"))
    three = F.concat_ws("  ", F.col("event_id").cast("string"), F.lit("1.5D+00"), F.lit("-2.0E-01"), (F.col("event_id") % 9).cast("string"))
    eight = F.concat_ws("  ", F.col("event_id").cast("string"), F.lit("1"), *[(F.col("event_id") % d).cast("string") for d in (2, 3, 4, 5, 6, 7)])
    body = F.when(F.col("event_id") % 13 == 0, F.lit(" broken 7")).when(F.col("event_id") % 50 < 20, three).otherwise(eight)
    return t("events").select(F.col("user_id").cast("string").alias("file"), F.col("event_id").alias("line"), F.coalesce(head, body).alias("text"))


_REPORT = """select user_id::varchar as file, event_id as line, case when event_id % 50 = 0 then ' forces (fx,fy,fz) for set TOP' when event_id % 50 = 20 then ' stresses (elem, integ.pnt.,sxx..)' when event_id % 13 = 0 then ' broken 7'
  when event_id % 50 < 20 then event_id || '  1.5D+00  -2.0E-01  ' || event_id % 9 else event_id || '  1  ' || event_id % 2 || '  ' || event_id % 3 || '  ' || event_id % 4 || '  ' || event_id % 5 || '  ' || event_id % 6 || '  ' || event_id % 7 end as text from events"""
_SECTION = "case when contains(lower(text), 'forces') then 'reaction' when contains(lower(text), 'stresses') then 'stress' when contains(lower(text), 'strains') then 'strain' end"


@query(f"with r as ({_REPORT}) select file, line, len(regexp_extract_all(text, '[-+]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eEdD][-+]?[0-9]+)?'))::bigint as n, round(list_sum(list_transform(regexp_extract_all(text, '[-+]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eEdD][-+]?[0-9]+)?'), lambda x: replace(upper(x), 'D', 'E')::double)), 6) as total from r where len(regexp_extract_all(text, '[0-9]')) > 0")
def regex_numbers(t):
    n = reports.numbers(_report(t)).filter("size(numbers) > 0")
    return rounded(n.select("file", "line", F.size("numbers").cast("bigint").alias("n"), F.aggregate("numbers", F.lit(0.0), lambda a, x: a + x).alias("total")))


@query(f"with r as ({_REPORT}), h as (select *, {_SECTION} as h from r) select file, line, last_value(h ignore nulls) over (partition by file order by line rows unbounded preceding) as section from h")
def section_carry_forward(t):
    return reports.sections(_report(t)).select("file", "line", "section")


@query(f"""with r as ({_REPORT}), h as (select *, {_SECTION} as h from r), s as (select *, last_value(h ignore nulls) over (partition by file order by line rows unbounded preceding) as section, string_split_regex(trim(text), ' +') as w from h)
select file, section, w[1]::bigint as id, array_to_string(list_transform(w[case when section = 'reaction' then 2 else 3 end:], lambda x: round(replace(x, 'D', 'E')::double, 3)::varchar), ' ') as parts
from s where h is null and section is not null and line % 13 <> 0 and len(w) = case when section = 'reaction' then 4 else 8 end""")
def report_records(t):
    return reports.records(_report(t)).select("file", "section", "id", F.array_join(F.transform("values", lambda v: F.round(v, 3).cast("string")), " ").alias("parts"))


@query(f"""with r as ({_REPORT}), h as (select *, {_SECTION} as h, row_number() over (partition by file, {_SECTION} is null order by line) - 1 as k from r) select file, k as head, line, h as section, trim(text) as text from h where h is not null and k < 3""")
def report_heads(t):
    return reports.heads(_report(t), 3)


@query("""with e as (select user_id::varchar as file, event_id, sum((event_id % 5 = 0)::int) over (partition by user_id order by event_id) as block from events),
b as (select file, min(block) as block from e where event_id % 10 = 0 group by 1) select file, event_id as id from e join b using (file, block) where event_id % 5 <> 0""")
def id_set_explode(t):
    text = F.when(F.col("event_id") % 10 == 0, F.lit("*ELSET, ELSET=EALL")).when(F.col("event_id") % 5 == 0, F.lit("*NSET, NSET=TOP")).otherwise(F.concat(F.col("event_id").cast("string"), F.lit(", ")))
    deck = t("events").select(F.col("user_id").cast("string").alias("file"), F.col("event_id").alias("line"), text.alias("text"))
    return reports.id_set(deck, "ELSET", "EALL")


@query("""with i as (select row_number() over (order by s_suppkey) - 1 as r, s_suppkey + 1 as n from supplier), b as (select (r // 16 + 1)::bigint as line, array_to_string(list(n order by n), ', ') as text from i group by 1)
select 0::bigint as line, '*NSET, NSET=TOP' as text union all select line, text from b""")
def deck_id_set(t):
    return reports.deck_set(t("supplier").select(F.col("s_suppkey").alias("id")), "NSET", "TOP")


@query("select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as bigint), -1) as k from events")
def json_metadata(t):
    return t("events").select("event_id", F.coalesce(F.from_json("props", "k bigint")["k"], F.lit(-1)).alias("k"))


@query("select 'customer' as side, c_nationkey as nationkey, c_acctbal as bal from customer where c_acctbal < 0 union all select 'supplier', s_nationkey, s_acctbal from supplier where s_acctbal < 0")
def vertical_concat(t):
    c = t("customer").filter("c_acctbal < 0").select(F.lit("customer").alias("side"), F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("bal"))
    return c.unionByName(t("supplier").filter("s_acctbal < 0").select(F.lit("supplier").alias("side"), F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("bal")))


@query("select count(*) filter (not isfinite(l_tax) or l_tax < 0) as bad, count(*) filter (l_tax is null or l_discount is null) as nulls, round(avg((l_discount <= 0.05)::int), 6) as share from lineitem")
def domain_predicates(t):
    bad = ~(fn.finite(F.col("l_tax")) & (F.col("l_tax") >= 0))
    return rounded(t("lineitem").agg(F.count_if(bad).alias("bad"), F.count_if(fn.any_null(F.col("l_tax"), F.col("l_discount"))).alias("nulls"), agg.fraction(F.col("l_discount") <= 0.05).alias("share")))


@query("""with a as (select s_suppkey as k, s_nationkey as v from supplier), b as (select s_suppkey as k, case when s_suppkey % 10 = 0 then -1 else s_nationkey end as v from supplier where s_suppkey % 7 <> 0)
select coalesce(a.k, b.k) as k, case when a.k is null then 'only_right' when b.k is null then 'only_left' else 'differs' end as reason from a full join b on a.k = b.k where a.k is null or b.k is null or a.v is distinct from b.v""")
def identity_mismatch(t):
    a = t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("v"))
    b = a.filter("k % 7 <> 0").withColumn("v", F.when(F.col("k") % 10 == 0, -1).otherwise(F.col("v")))
    return audit.identity_mismatch(a, b, ["k"], ["v"])


@query()
def spectral_signature(t):
    return rounded(spectra.spectral_signature(_vector_graph(t)[1]))


_GNN = f"{_VG}, d as (select source as s, target as t from e union all select target, source from e)"


@query(f"{_GNN} select label::varchar as sample_id, v.vec_id as node, round(coalesce(avg(n.e0), 0), 6) as x_in, round(coalesce(avg(n.e1), 0), 6) as y_in from v left join d on d.t = v.vec_id left join v n on n.vec_id = d.s group by v.label, v.vec_id".replace("select label::varchar", "select v.label::varchar"))
def gnn_mean_aggregate_layer(t):
    nodes, edges = _vector_graph(t)
    return rounded(graphs.neighbour_mean(nodes, graphs.doubled(edges), ["x", "y"]).select("sample_id", "node", "x_in", "y_in"))


@query(f"{_VG}, n as (select label, count(*) as nodes from v group by 1), m as (select label, count(*) as edges, sum(w)::double as w from e group by 1) select count(*) as graphs, sum(nodes)::bigint as nodes, sum(edges)::bigint as edges, max(nodes) as most_nodes, min(edges) as least_edges, round(sum(w), 6) as path_length from n join m using (label)")
def graph_totals(t):
    return rounded(graphs.totals(*_vector_graph(t)))


@query(f"""{_VG}, d as (select source as a, target as b from e where w < 0.4 union select target, source from e where w < 0.4), r as (select vec_id as node, vec_id as root from v union select d.b, r.root from r join d on d.a = r.node),
c as (select node, min(root) as root from r group by 1) select label::varchar as sample_id, count(distinct root) as components from v join c on vec_id = node group by 1""")
def graph_components(t):
    nodes, edges = _vector_graph(t)
    return graphs.component_count(nodes, edges.filter("path_length < 0.4"))
