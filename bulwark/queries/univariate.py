"""Location, scale, skewness and boxplots by group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bulwark.operators import univariate as U
from bulwark.plans.frames import long, numeric
from bulwark.queries.registry import query, rounded, table


def _onestep_sql(source: str, key: str, value: str, psi_loc: str, psi_scale: str, delta: float, digits: int) -> str:
    return f"""with m as (select {key}, median({value}) as m from {source} group by {key}),
 s as (select {key}, any_value(m) as m, median(abs({value} - m)) / 0.6744897501960817 as s from {source} join m using ({key}) group by {key}),
 r as (select {key}, {value} as x, s, ({value} - m) / s as r from {source} join s using ({key})),
 w as (select *, case when abs(r) <= 1e-5 then 1 else {psi_loc} / r end as w, {psi_scale} as p from r)
 select {key}, round(sum(w * x) / sum(w), {digits}) as location, round(any_value(s) * sqrt(avg(p * p) / {delta}), {digits}) as scale from w group by {key}"""


_FLAG = "(select l_returnflag || l_linestatus as flag, l_extendedprice from lineitem)"


@query("huber_onestep_by_flag", sql=_onestep_sql(_FLAG, "flag", "l_extendedprice", "greatest(-1.5, least(1.5, r))", "greatest(-1.5, least(1.5, r))", 0.7784655, 3))
def huber_onestep_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("flag"), "l_extendedprice")
    return rounded(U.HuberOneStepM().agg(df, ["l_extendedprice"], ["flag"]).select("flag", "location", "scale"), 3, "location", "scale")


@query("cellwise_onestep_by_type", sql=_onestep_sql("events", "event_type", "value", "(case when abs(r) <= 3 then r * power(1 - power(r / 3, 2), 2) else 0 end)", "greatest(-2.5, least(2.5, r))", 0.845, 5))
def cellwise_onestep_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = U.CellwiseOneStepM().agg(table(spark, sf_dir, "events"), ["value"], ["event_type"])
    return rounded(out.select("event_type", "location", "scale"), 5, "location", "scale")


@query("median_mad_by_flag", sql="""select l_returnflag, l_linestatus, round(median(l_extendedprice), 4) as location, round(mad(l_extendedprice), 4) as scale from lineitem group by all""")
def median_mad_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = U.MedianMad().agg(table(spark, sf_dir, "lineitem"), ["l_extendedprice"], ["l_returnflag", "l_linestatus"])
    return rounded(out.drop("feature"), 4, "location", "scale")


@query("tau_by_type", sql="""with m as (select event_type, median(value) as m from events group by 1), s as (select event_type, any_value(m) as m, median(abs(value - m)) as s from events join m using (event_type) group by 1),
 w as (select event_type, value, s, case when abs((value-m)/s) <= 4.5 then power(1 - power((value-m)/s/4.5, 2), 2) else 0 end as w from events join s using (event_type)),
 l as (select event_type, sum(w*value)/sum(w) as l, any_value(s) as s from w group by 1),
 r as (select event_type, any_value(l) as l, any_value(s) as s, avg(least(power((value-l)/s, 2), 9.0)) as a from events join l using (event_type) group by 1)
 select event_type, round(l, 5) as location, round(s * sqrt(a / 0.9247153921761315), 3) as scale from r""")
def tau_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = U.Tau().agg(table(spark, sf_dir, "events"), ["value"], ["event_type"]).select("event_type", "location", "scale")
    return rounded(rounded(out, 5, "location"), 3, "scale")


_WINDOWS = """b as (select event_type, value, median(value) over (partition by event_type) as m, count(*) over (partition by event_type) as n from events),
 p as (select event_type, m, n, n // 2 + 1 as h, row_number() over w as rn, sum(value - m) over w as s1, sum((value-m)*(value-m)) over w as s2, value - m as v from b window w as (partition by event_type order by value rows unbounded preceding)),
 c as (select a.event_type, a.m, a.rn, (e.s1 - a.s1 + a.v) / a.h as mean, (e.s2 - a.s2 + a.v*a.v) / a.h - power((e.s1 - a.s1 + a.v) / a.h, 2) as var from p a join p e on a.event_type = e.event_type and e.rn = a.rn + a.h - 1)"""


@query("mcd_univariate_raw_by_type", sql=f"""with {_WINDOWS} select event_type, round(arg_min(mean + m, var), 4) as raw_location, round(min(var), 4) as raw_var from c group by 1""")
def mcd_univariate_raw_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = long(numeric(table(spark, sf_dir, "events"), ["value"], ["event_type"]), ["value"], ["event_type"])
    out = U.UnivariateMcd(consistency_correction=False).raw(rows, ["event_type"]).select("event_type", "raw_location", "raw_var")
    return rounded(out, 4, "raw_location", "raw_var")


@query("mcd_univariate_uncorrected_by_type", sql=f"""with {_WINDOWS}, r as (select event_type, arg_min(mean + m, var) as l, min(var) as v from c group by 1),
 k as (select event_type, value from events join r using (event_type) where power(value - l, 2) < 5.0238861873148934 * v)
 select event_type, round(avg(value), 4) as location, round(stddev_pop(value), 4) as scale from k group by 1""")
def mcd_univariate_uncorrected_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = U.UnivariateMcd(consistency_correction=False).agg(table(spark, sf_dir, "events"), ["value"], ["event_type"])
    return rounded(out.select("event_type", "location", "scale"), 4, "location", "scale")


@query("mcd_univariate_by_type")
def mcd_univariate_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = long(numeric(table(spark, sf_dir, "events"), ["value"], ["event_type"]), ["value"], ["event_type"])
    return rounded(U.UnivariateMcd().full(rows, ["event_type"]), 4, "raw_location", "raw_scale", "location", "scale")


@query("wrap_onestep_by_type")
def wrap_onestep_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = U.OneStepWrapping().agg(table(spark, sf_dir, "events"), ["value"], ["event_type"])
    return rounded(out.select("event_type", "location", "scale"), 4, "location", "scale")


_QN = """with r as (select c_mktsegment, c_acctbal as x, row_number() over (partition by c_mktsegment order by c_acctbal, c_custkey) as i from customer),
 n as (select c_mktsegment, count(*) as n, median(c_acctbal) as location from customer group by 1),
 d as (select a.c_mktsegment, b.x - a.x as d, row_number() over (partition by a.c_mktsegment order by b.x - a.x) as k from r a join r b on a.c_mktsegment = b.c_mktsegment and a.i < b.i)
 select c_mktsegment, round(location, 4) as location, round(2.219144 * d * case when n % 2 = 1 then n / (n + 1.4) else n / (n + 3.8) end, 4) as scale
 from d join n using (c_mktsegment) where k = (n // 2 + 1) * (n // 2) // 2"""


@query("qn_by_segment", sql=_QN)
def qn_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = U.Qn().agg(table(spark, sf_dir, "customer"), ["c_acctbal"], ["c_mktsegment"])
    return rounded(out.select("c_mktsegment", "location", "scale"), 4, "location", "scale")


@query("qn_by_segment_pairs", sql=_QN)
def qn_by_segment_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = U.Qn(method="pairs").agg(table(spark, sf_dir, "customer"), ["c_acctbal"], ["c_mktsegment"])
    return rounded(out.select("c_mktsegment", "location", "scale"), 4, "location", "scale")


_MC = """m as (select c_mktsegment, median(c_acctbal) as m from customer group by 1), x as (select c_mktsegment, c_acctbal as x, m from customer join m using (c_mktsegment)),
 mc as (select a.c_mktsegment, median(case when b.x > a.x then (b.x - 2 * a.m + a.x) / (b.x - a.x) else 0 end) as mc from x a join x b on a.c_mktsegment = b.c_mktsegment and a.x <= a.m and b.x >= b.m group by 1)"""


@query("medcouple_by_segment", sql=f"with {_MC} select c_mktsegment, round(mc, 6) + 0.0 as medcouple from mc")
def medcouple_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(U.medcouple(table(spark, sf_dir, "customer"), ["c_acctbal"], ["c_mktsegment"]).drop("feature"), 6, "medcouple")


_BOX = f"""{_MC}, q as (select c_mktsegment, median(c_acctbal) as med, quantile_cont(c_acctbal, 0.25) as q1, quantile_cont(c_acctbal, 0.75) as q3, min(c_acctbal) as lo, max(c_acctbal) as hi from customer group by 1),
 w as (select c_mktsegment, med, q1, q3, greatest(lo, q1 - 1.5 * exp(case when mc >= 0 then -4 else -3 end * mc) * (q3 - q1)) as lw, least(hi, q3 + 1.5 * exp(case when mc >= 0 then 3 else 4 end * mc) * (q3 - q1)) as uw from q join mc using (c_mktsegment))"""


@query("adjusted_boxplot_by_segment", sql=f"""with {_BOX} select c_mktsegment, round(med, 4) as "median", round(q1, 4) as q1, round(q3, 4) as q3, round(lw, 4) as lower_whisker, round(uw, 4) as upper_whisker from w""")
def adjusted_boxplot_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = U.adjusted_boxplot(table(spark, sf_dir, "customer"), ["c_acctbal"], ["c_mktsegment"])
    return rounded(out.drop("feature", "medcouple"), 4, "median", "q1", "q3", "lower_whisker", "upper_whisker")


@query("boxplot_fliers", sql="""with m as (select event_type, median(value) as m from events group by 1), x as (select event_type, value as x, m from events join m using (event_type)),
 mc as (select a.event_type, median(case when b.x > a.x then (b.x - 2 * a.m + a.x) / (b.x - a.x) else 0 end) as mc from x a join x b on a.event_type = b.event_type and a.x <= a.m and b.x >= b.m group by 1),
 q as (select event_type, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from events group by 1)
 select event_type, event_id, round(value, 4) as value from events join mc using (event_type) join q using (event_type)
 where (value < q1 - 1.5 * exp(case when mc >= 0 then -4 else -3 end * mc) * (q3 - q1) or value > q3 + 1.5 * exp(case when mc >= 0 then 3 else 4 end * mc) * (q3 - q1))""")
def boxplot_fliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = U.boxplot_fliers(table(spark, sf_dir, "events"), ["value"], "event_id", ["event_type"])
    return rounded(out.drop("feature"), 4, "value")


@query("weighted_median_by_supplier", sql="""with s as (select l_suppkey, l_extendedprice as x, sum(l_quantity) as w from lineitem group by 1, 2),
 r as (select *, sum(w) over (partition by l_suppkey order by x) as run, sum(w) over (partition by l_suppkey) as total from s)
 select l_suppkey, round(min(x), 4) as weighted_median from r where 2 * run > total group by 1""")
def weighted_median_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(U.weighted_median(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", ["l_suppkey"]), 4, "weighted_median")
