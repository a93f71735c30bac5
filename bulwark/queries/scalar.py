"""Kernels, scaling, wrapping, cleaning and power transforms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bulwark.functions import kernels as K
from bulwark.functions.special import chi2_1_cdf_of_square
from bulwark.operators.preprocessing import DataCleaner, RobustPowerTransformer, RobustScaler, wrapping_transformation
from bulwark.operators.univariate import HuberOneStepM, MedianMad
from bulwark.plans.frames import long
from bulwark.queries.registry import query, rounded, table


def _x(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances in thousands, both signs."""
    return table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 1000.0).alias("x"))


@query("huber_rho_psi", sql="""select c_custkey, round(case when abs(x) <= 1.5 then x*x/2 else 1.5*abs(x) - 1.125 end, 6) as rho, round(greatest(-1.5, least(1.5, x)), 6) as psi
 from (select c_custkey, c_acctbal / 1000.0 as x from customer)""")
def huber_rho_psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, x = K.Huber(1.5), F.col("x")
    return rounded(_x(spark, sf_dir).select("c_custkey", k.rho(x).alias("rho"), k.psi(x).alias("psi")), 6, "rho", "psi")


@query("tukey_rho_psi", sql="""select c_custkey, round(case when abs(x) <= 3 then x*x/2 - x**4/18 + x**6/486 else 1.5 end, 6) as rho,
 round(case when abs(x) <= 3 then x * (1 - (x/3)*(x/3)) * (1 - (x/3)*(x/3)) else 0 end, 6) + 0.0 as psi from (select c_custkey, c_acctbal / 1000.0 as x from customer)""")
def tukey_rho_psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, x = K.Tukey(3.0), F.col("x")
    return rounded(_x(spark, sf_dir).select("c_custkey", k.rho(x).alias("rho"), k.psi(x).alias("psi")), 6, "rho", "psi")


@query("tau_kernels", sql="""select c_custkey, round(case when abs(x) <= 4.5 then (1 - (x/4.5)*(x/4.5)) * (1 - (x/4.5)*(x/4.5)) else 0 end, 6) + 0.0 as weight, round(least(x*x, 9.0), 6) as rho
 from (select c_custkey, c_acctbal / 1000.0 as x from customer)""")
def tau_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_x(spark, sf_dir).select("c_custkey", K.tau_weight(F.col("x")).alias("weight"), K.tau_rho(F.col("x")).alias("rho")), 6, "weight", "rho")


@query("tanh_weight", sql="""select c_custkey, round(case when abs(x) < 1.5 then 1 when abs(x) > 4 then 0 else sqrt(0.7532528 * 3.1517212)
 * tanh(0.5 * sqrt(3.1517212 * 0.8430849 * 0.8430849 / 0.7532528) * (4 - abs(x))) / abs(x) end, 6) + 0.0 as weight from (select c_custkey, c_acctbal / 1000.0 as x from customer)""")
def tanh_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_x(spark, sf_dir).select("c_custkey", K.tanh_weight(F.col("x")).alias("weight")), 6, "weight")


@query("wrap_kernel", sql="""select c_custkey, round(case when abs(x) < 1.5 then x when abs(x) <= 4 then 1.540793 * tanh(0.8622731 * (4 - abs(x))) * sign(x) else 0 end, 6) + 0.0 as psi
 from (select c_custkey, c_acctbal / 1000.0 as x from customer)""")
def wrap_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_x(spark, sf_dir).select("c_custkey", K.wrap_psi(F.col("x")).alias("psi")), 6, "psi")


@query("sql_kernel_functions", sql="""select c_custkey, round(greatest(-1.5, least(1.5, x)), 6) as huber, round(case when abs(x) <= 3 then x * power(1 - power(x/3, 2), 2) else 0 end, 6) + 0.0 as tukey
 from (select c_custkey, c_acctbal / 1000.0 as x from customer)""")
def sql_kernel_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    K.register_sql(spark)
    return rounded(_x(spark, sf_dir).selectExpr("c_custkey", "huber_psi(x, 1.5D) as huber", "tukey_psi(x, 3D) as tukey"), 6, "huber", "tukey")


@query("chi2_cdf_of_square", sql="""select c_custkey, round(case when x = 0 then 0 when abs(x) > 8 then 1 else
 list_sum(list_transform(range(0, 160), lambda n: exp((2*n+1)*ln(abs(x)/sqrt(2.0)) - x*x/2 - lgamma(n+1.5)))) end, 6) as p from (select c_custkey, c_acctbal / 1000.0 as x from customer)""")
def chi2_cdf_of_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_x(spark, sf_dir).select("c_custkey", chi2_1_cdf_of_square(F.col("x")).alias("p")), 6, "p")


@query("boxcox_fixed", sql="""select event_id, round((power(value, 0.3) - 1) / 0.3, 5) as y, round(ln(value), 5) as y0, round(power((power(value, 0.3) - 1) / 0.3 * 0.3 + 1, 1 / 0.3), 5) as back
 from events where value > 0""")
def boxcox_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("value")
    df = table(spark, sf_dir, "events").where("value > 0").select("event_id", K.box_cox(x, 0.3).alias("y"), K.box_cox(x, 0).alias("y0"), K.box_cox_inverse(K.box_cox(x, 0.3), 0.3).alias("back"))
    return rounded(df, 5, "y", "y0", "back")


@query("yeojohnson_fixed", sql="""select c_custkey, round(case when x >= 0 then (power(1 + x, 0.5) - 1) / 0.5 else -(power(1 - x, 1.5) - 1) / 1.5 end, 6) + 0.0 as y, round(x, 6) + 0.0 as back
 from (select c_custkey, c_acctbal / 1000.0 as x from customer)""")
def yeojohnson_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = K.yeo_johnson(F.col("x"), 0.5)
    return rounded(_x(spark, sf_dir).select("c_custkey", y.alias("y"), K.yeo_johnson_inverse(y, 0.5).alias("back")), 6, "y", "back")


@query("rectified_transforms", sql="""select event_id, round(case when value > 20 then (power(20, 0.5) - 1) / 0.5 + (value - 20) * power(20, -0.5) else (power(value, 0.5) - 1) / 0.5 end, 5) as boxcox,
 round(case when value > 20 then (power(21, 0.5) - 1) / 0.5 + (value - 20) * power(21, -0.5) else (power(1 + value, 0.5) - 1) / 0.5 end, 5) as yeojohnson from events where value > 0""")
def rectified_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").where("value > 0").select("event_id", K.rectified_box_cox(F.col("value"), 0.5, 20.0).alias("boxcox"), K.rectified_yeo_johnson(F.col("value"), 0.5, 20.0).alias("yeojohnson"))
    return rounded(df, 5, "boxcox", "yeojohnson")


@query("robust_scale_transform", sql="""with m as (select median(c_acctbal) as m from customer), s as (select median(abs(c_acctbal - m)) as s from customer, m)
 select c_custkey, round((c_acctbal - m) / s, 6) + 0.0 as c_acctbal from customer, m, s""")
def robust_scale_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return rounded(RobustScaler(MedianMad()).fit(df, ["c_acctbal"]).transform(df), 6, "c_acctbal")


@query("robust_scaler_mcd")
def robust_scaler_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")
    return rounded(RobustScaler().fit(df, ["p_retailprice", "p_size"]).transform(df), 5, "p_retailprice", "p_size")


@query("wrapping_transform", sql="""with z as (select event_id, value, m, s from events, (select median(value) as m from events), (select median(abs(value - m)) as s from events, (select median(value) as m from events))),
 w as (select *, case when abs((value-m)/s) < 1.5 then (value-m)/s when abs((value-m)/s) <= 4 then 1.540793 * tanh(0.8622731 * (4 - abs((value-m)/s))) * sign(value-m) else 0 end as y from z),
 t as (select avg(y) as a, stddev_pop(y) as d from w)
 select event_id, round(y * (s / d) + m - a * s / d, 5) as value from w, t""")
def wrapping_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", "value")
    return rounded(wrapping_transformation(df, ["value"]), 5, "value")


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        "c_custkey", "c_mktsegment", "c_acctbal", F.col("c_nationkey").cast("double").alias("nation"), (F.col("c_custkey") % 3).alias("three"),
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("gaps"), F.when(F.col("c_custkey") % 5 < 2, F.col("c_acctbal")).alias("sparse"),
        F.when(F.col("c_custkey") % 97 == 0, F.col("c_acctbal")).otherwise(F.lit(1.0)).alias("flat"),
    )


@query("cleaner_column_report", sql="""select 'non_numeric' as reason, 'c_mktsegment' as "column" union all select 'discrete', 'three' where (select count(distinct c_custkey % 3) from customer) <= 3
 union all select 'small_scale', 'flat' where (select mad(case when c_custkey % 97 = 0 then c_acctbal else 1.0 end) from customer) <= 1e-12
 union all select 'missing', 'sparse' where (select avg((c_custkey % 5 >= 2)::int) from customer) >= 0.5
 union all select 'row_numbers', 'c_custkey' where (select min(c_custkey) = 0 and max(c_custkey) = count(*) - 1 from customer)""")
def cleaner_column_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DataCleaner().fit(_dirty(spark, sf_dir)).report(spark)


@query("cleaner_rows")
def cleaner_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DataCleaner().fit_transform(_dirty(spark, sf_dir))


@query("power_lambda")
def power_lambda(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("value > 0")
    rows = []
    for method in ("yeojohnson", "boxcox", "auto"):
        m = RobustPowerTransformer(method).fit(events, "value")
        rows.append((method, m.kind, round(m.lam, 3)))
    return spark.createDataFrame(rows, "method string, kind string, lam double")


@query("power_transform")
def power_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("value > 0").select("event_id", "value")
    m = RobustPowerTransformer("auto").fit(events, "value")
    z = m.transform(F.col("value"))
    return rounded(events.select("event_id", z.alias("z"), m.inverse(z).alias("back")), 4, "z", "back")


_GRID = [round(float(v), 2) for v in np.linspace(-0.5, 1.0, 7)]


@query("power_objective_grid", sql=f"""with g as (select unnest({_GRID}) as lam), y as (select lam, value, case when lam = 0 then ln(value) else (power(value, lam) - 1) / lam end as y from events, g where value > 0)
 select lam, round(count(*) / 2.0 * ln(var_pop(y)) - (lam - 1) * sum(ln(value)), 3) as objective from y group by lam""")
def power_objective_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile likelihood of Box-Cox over a grid of lambdas, all in one aggregation."""
    events = table(spark, sf_dir, "events").where("value > 0").select("value")
    wide = events.select(F.log("value").alias("l"), *[K.box_cox(F.col("value"), v).alias(f"y{i}") for i, v in enumerate(_GRID)])
    sums = wide.agg(F.count(F.lit(1)).alias("n"), F.sum("l").alias("j"), *[F.var_pop(f"y{i}").alias(f"v{i}") for i in range(len(_GRID))])
    cells = F.array(*[F.struct(F.lit(v).alias("lam"), (F.col("n") / 2 * F.log(F.col(f"v{i}")) - (v - 1) * F.col("j")).alias("objective")) for i, v in enumerate(_GRID)])
    return rounded(sums.select(F.inline(cells)), 3, "objective")


@query("huber_scaler_long", sql="""with l as (select 'p_retailprice' as feature, p_retailprice as value from part union all select 'p_size', p_size::double from part),
 m as (select feature, median(value) as m from l group by 1), s as (select feature, any_value(m) as m, median(abs(value - m)) / 0.6744897501960817 as s from l join m using (feature) group by 1),
 r as (select feature, value, s, case when abs((value-m)/s) <= 1e-5 then 1 else greatest(-1.5, least(1.5, (value-m)/s)) / ((value-m)/s) end as w, greatest(-1.5, least(1.5, (value-m)/s)) as p from l join s using (feature))
 select feature, round(sum(w*value)/sum(w), 4) as location, round(any_value(s) * sqrt(avg(p*p) / 0.7784655), 4) as scale from r group by 1""")
def huber_scaler_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select(F.col("p_retailprice"), F.col("p_size").cast("double").alias("p_size"))
    return rounded(HuberOneStepM().on_long(long(df, ["p_retailprice", "p_size"]), ["feature"]), 4, "location", "scale")
