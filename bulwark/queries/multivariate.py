"""Scatter, regression, principal components and cellwise outliers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bulwark.functions.kernels import MAD_NORMAL, Tukey, mahalanobis
from bulwark.operators import pca, regression, scatter
from bulwark.operators.cells import DDC, CellMCD, initial_ddcw
from bulwark.operators.univariate import l1_median
from bulwark.plans.frames import numeric
from bulwark.plans.moments import medians
from bulwark.queries.registry import DOC_SQL, ORDER_SQL, doc_features, order_features, query, rounded, table

PAIR = ["qty", "price"]


def _matrix(spark: SparkSession, model: scatter.ScatterModel, digits: int = 4) -> DataFrame:
    return rounded(model.to_df(spark), digits, "location", "covariance")


def _scaled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums per order in units that keep covariances readable."""
    o = order_features(spark, sf_dir)
    return o.select("l_orderkey", (F.col("qty") / 10).alias("qty"), (F.col("price") / 10000).alias("price"), "n_items", (F.col("charged") / 10000).alias("charged"))


_SCALED = f"{ORDER_SQL}, o as (select l_orderkey, qty / 10 as qty, price / 10000 as price, n_items, charged / 10000 as charged from order_features)"


@query("mahalanobis_2d", sql="""select p_partkey, round(sqrt((d1*d1*40000 - 2*0.3*14*200*d1*d2 + d2*d2*196) / (196*40000*(1 - 0.09))), 5) as distance
 from (select p_partkey, p_size - 25.0 as d1, p_retailprice - 1500.0 as d2 from part)""")
def mahalanobis_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    cov = np.array([[196.0, 0.3 * 14 * 200], [0.3 * 14 * 200, 40000.0]])
    d = mahalanobis([F.col("p_size").cast("double"), F.col("p_retailprice")], np.array([25.0, 1500.0]), cov)
    return rounded(table(spark, sf_dir, "part").select("p_partkey", d.alias("distance")), 5, "distance")


def _wrapped_sql() -> str:
    parts = []
    for c in PAIR:
        parts.append(f"""m_{c} as (select median({c}) as m from o), s_{c} as (select any_value(m) as m, median(abs({c} - m)) as s from o, m_{c}),
 y_{c} as (select l_orderkey, m, s, case when abs(({c}-m)/s) < 1.5 then ({c}-m)/s when abs(({c}-m)/s) <= 4 then 1.540793 * tanh(0.8622731 * (4 - abs(({c}-m)/s))) * sign({c}-m) else 0 end as y from o, s_{c}),
 t_{c} as (select avg(y) as a, stddev_pop(y) as d from y_{c}), w_{c} as (select l_orderkey, y * (s / d) + m - a * s / d as {c} from y_{c}, t_{c})""")
    return ", ".join(parts)


@query("wrapping_cov_matrix", sql=f"""with {_SCALED}, {_wrapped_sql()}, j as (select qty, price from w_qty join w_price using (l_orderkey)), a as (select avg(qty) as mq, avg(price) as mp from o)
 select 'qty' as "row", 'qty' as col, round((select mq from a), 4) as location, round(covar_samp(qty, qty), 4) as covariance from j union all
 select 'qty', 'price', round((select mq from a), 4), round(covar_samp(qty, price), 4) from j union all
 select 'price', 'qty', round((select mp from a), 4), round(covar_samp(qty, price), 4) from j union all
 select 'price', 'price', round((select mp from a), 4), round(covar_samp(price, price), 4) from j""")
def wrapping_cov_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, scatter.WrappingCovariance().fit(_scaled_orders(spark, sf_dir), PAIR))


@query("kendall_pairs", sql=f"""with {DOC_SQL}, x as (select doc_id, n_chars as a, n_words as b from doc_features),
 s as (select sign(p.a - q.a) as sa, sign(p.b - q.b) as sb from x p join x q on p.doc_id < q.doc_id)
 select 'n_chars' as f1, 'n_words' as f2, round(sum(sa * sb) / sqrt(sum(sa * sa)::double * sum(sb * sb)::double), 6) as tau from s""")
def kendall_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scatter.kendall_pairs(doc_features(spark, sf_dir).select("n_chars", "n_words"), ["n_chars", "n_words"]), 6, "tau")


@query("kendall_matrix")
def kendall_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, scatter.KendallTau().fit(doc_features(spark, sf_dir), ["n_chars", "n_words", "n_lines"]), 3)


def _mad_sql(name: str, source: str, value: str) -> str:
    return f"{name} as (select m, median(abs(v - m)) as s from (select {value} as v, median({value}) over () as m from {source}) group by m)"


@query("ogk_2d_iter1", sql=f"""with {_SCALED}, {_mad_sql('sq', 'o', 'qty')}, {_mad_sql('sp', 'o', 'price')},
 y as (select qty / sq.s as a, price / sp.s as b from o, sq, sp), {_mad_sql('plus', 'y', 'a + b')}, {_mad_sql('minus', 'y', 'a - b')},
 z as (select (a + b) / sqrt(2) as z1, (a - b) / sqrt(2) as z2 from y), {_mad_sql('g1', 'z', 'z1')}, {_mad_sql('g2', 'z', 'z2')}
 select 'qty' as "row", 'qty' as col, round(sq.s * (g1.m + g2.m) / sqrt(2), 4) as location, round(sq.s * sq.s * (g1.s*g1.s + g2.s*g2.s) / 2, 4) as covariance from sq, sp, g1, g2 union all
 select 'qty', 'price', round(sq.s * (g1.m + g2.m) / sqrt(2), 4), round(sq.s * sp.s * (g1.s*g1.s - g2.s*g2.s) / 2, 4) from sq, sp, g1, g2 union all
 select 'price', 'qty', round(sp.s * (g1.m - g2.m) / sqrt(2), 4), round(sq.s * sp.s * (g1.s*g1.s - g2.s*g2.s) / 2, 4) from sq, sp, g1, g2 union all
 select 'price', 'price', round(sp.s * (g1.m - g2.m) / sqrt(2), 4), round(sp.s * sp.s * (g1.s*g1.s + g2.s*g2.s) / 2, 4) from sq, sp, g1, g2""")
def ogk_2d_iter1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, scatter.OGK(n_iterations=1).fit(_scaled_orders(spark, sf_dir), PAIR))


@query("ogk_reweighted")
def ogk_reweighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, scatter.OGK(reweighting=True).fit(_scaled_orders(spark, sf_dir), ["qty", "price", "n_items"]), 3)


_CSTEP = f"""{_SCALED}, {_mad_sql('sq', 'o', 'qty')}, {_mad_sql('sp', 'o', 'price')},
 d as (select qty, price, power((qty - sq.m) / sq.s, 2) + power((price - sp.m) / sp.s, 2) as d from o, sq, sp),
 r as (select *, row_number() over (order by d) as k, count(*) over () as n from d), cut as (select d as t from r where k = (n + 3) // 2),
 h as (select qty, price from d, cut where d <= t)"""


@query("mcd_cstep_2d", sql=f"""with {_CSTEP} select round(avg(qty), 5) as qty, round(avg(price), 5) as price, round(var_samp(qty), 5) as var_qty, round(covar_samp(qty, price), 5) as cov, round(var_samp(price), 5) as var_price from h""")
def mcd_cstep_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One concentration step on all rows from medians and median absolute deviations."""
    rows = _scaled_orders(spark, sf_dir).select(*PAIR)
    n = rows.count()
    m = medians(rows, [F.col(c) for c in PAIR], n)
    s = medians(rows, [F.abs(F.col(c) - float(v)) for c, v in zip(PAIR, m, strict=True)], n)
    at, cov, _ = scatter.c_steps(rows, PAIR, m, np.diag(s**2), (n + 3) // 2, 1)
    row = tuple(round(float(v), 5) for v in (at[0], at[1], cov[0, 0], cov[0, 1], cov[1, 1]))
    return spark.createDataFrame([row], "qty double, price double, var_qty double, cov double, var_price double")


@query("fastmcd_matrix")
def fastmcd_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, scatter.FastMCD().fit(_scaled_orders(spark, sf_dir), ["qty", "price", "n_items"]), 2)


@query("detmcd_matrix")
def detmcd_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, scatter.DetMCD().fit(_scaled_orders(spark, sf_dir), ["qty", "price", "n_items"]), 2)


@query("fastmcd_distances")
def fastmcd_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _scaled_orders(spark, sf_dir)
    out = scatter.FastMCD().fit(df, ["qty", "price"]).distance_distance(df, "l_orderkey")
    return rounded(out, 2, "classical_d", "robust_d", "threshold")


@query("distance_distance_2d", sql="""with f as (select p_partkey, p_size::double as a, p_retailprice as b from part), s as (select avg(a) as ma, avg(b) as mb, var_samp(a) as va, var_samp(b) as vb, covar_samp(a, b) as c from f)
 select p_partkey, round(sqrt(((a-ma)*(a-ma)*vb - 2*c*(a-ma)*(b-mb) + (b-mb)*(b-mb)*va) / (va*vb - c*c)), 5) as classical_d, round(sqrt(-2 * ln(0.025)), 5) as threshold from f, s""")
def distance_distance_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    out = scatter.OGK().fit(df, ["a", "b"]).distance_distance(df, "p_partkey").select("p_partkey", "classical_d", "threshold")
    return rounded(out, 5, "classical_d", "threshold")


# -- regression ----------------------------------------------------------------


def _line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scaled_orders(spark, sf_dir).select("l_orderkey", "qty", "price")


_OLS = f"{_SCALED}, b as (select regr_slope(price, qty) as b, regr_intercept(price, qty) as a from o)"


@query("lts_cstep", sql=f"""with {_OLS}, r as (select qty, price, power(price - b.b * qty - b.a, 2) as r2 from o, b), k as (select *, row_number() over (order by r2) as k, count(*) over () as n from r),
 cut as (select r2 as t from k where k = (n + 2) // 2), h as (select qty, price from r, cut where r2 <= t)
 select round(regr_slope(price, qty), 5) as slope, round(regr_intercept(price, qty), 5) as intercept from h""")
def lts_cstep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numeric(_line(spark, sf_dir), PAIR)
    beta = regression.trimmed_steps(rows, ["qty"], "price", regression.least_squares(rows, ["qty"], "price"), (rows.count() + 2) // 2, 1)
    return spark.createDataFrame([tuple(round(float(v), 5) for v in beta)], "slope double, intercept double")


@query("mm_irls_2", sql=f"""with {_OLS}, s as (select median(abs(price - b.b * qty - b.a)) / 0.6744897501960817 as s from o, b),
 w1 as (select qty, price, case when abs((price - b.b*qty - b.a)/s) <= 3.44 then power(1 - power((price - b.b*qty - b.a)/s/3.44, 2), 2) else 0 end as w from o, b, s),
 b1 as (select (sum(w)*sum(w*qty*price) - sum(w*qty)*sum(w*price)) / (sum(w)*sum(w*qty*qty) - sum(w*qty)*sum(w*qty)) as b, sum(w*price)/sum(w) as my, sum(w*qty)/sum(w) as mx from w1),
 w2 as (select qty, price, case when abs((price - b1.b*qty - (my - b1.b*mx))/s) <= 3.44 then power(1 - power((price - b1.b*qty - (my - b1.b*mx))/s/3.44, 2), 2) else 0 end as w from o, b1, s)
 select round((sum(w)*sum(w*qty*price) - sum(w*qty)*sum(w*price)) / (sum(w)*sum(w*qty*qty) - sum(w*qty)*sum(w*qty)), 5) as slope,
 round(sum(w*price)/sum(w) - (sum(w)*sum(w*qty*price) - sum(w*qty)*sum(w*price)) / (sum(w)*sum(w*qty*qty) - sum(w*qty)*sum(w*qty)) * sum(w*qty)/sum(w), 5) as intercept from w2""")
def mm_irls_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reweighted steps from least squares at the scale of its residuals."""
    rows = numeric(_line(spark, sf_dir), PAIR)
    beta = regression.least_squares(rows, ["qty"], "price")
    r = F.col("price") - float(beta[0]) * F.col("qty") - float(beta[1])
    scale = medians(rows, [F.abs(r)], rows.count())[0] / MAD_NORMAL
    beta = regression.reweighted_steps(rows, ["qty"], "price", beta, scale, Tukey(3.44), 2)
    return spark.createDataFrame([tuple(round(float(v), 5) for v in beta)], "slope double, intercept double")


def _coefficients(spark: SparkSession, m: regression.RegressionModel) -> DataFrame:
    rows = [(c, round(float(b), 3)) for c, b in zip((*m.features, "intercept", "scale"), (*m.coefficients, m.intercept, m.scale), strict=True)]
    return spark.createDataFrame(rows, "term string, value double")


@query("fastlts")
def fastlts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coefficients(spark, regression.FastLTS().fit(_scaled_orders(spark, sf_dir), ["qty", "n_items"], "price"))


@query("s_regression")
def s_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coefficients(spark, regression.SRegression().fit(_scaled_orders(spark, sf_dir), ["qty", "n_items"], "price"))


@query("mm_regression")
def mm_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coefficients(spark, regression.MMRegression().fit(_scaled_orders(spark, sf_dir), ["qty", "n_items"], "price"))


@query("outlier_map_class", sql=f"""with {_OLS}, {_mad_sql('sq', 'o', 'qty')}, r as (select l_orderkey, price - b.b * qty - b.a as r, abs(qty - sq.m) / (sq.s / 0.6744897501960817) as d from o, b, sq),
 m as (select median(r) as m from r), s as (select median(abs(r - m)) / 0.6744897501960817 as s from r, m)
 select l_orderkey, case when abs(r/s) > 2.5 and d > 2.2414027276049473 then 'bad leverage' when abs(r/s) > 2.5 then 'vertical outlier' when d > 2.2414027276049473 then 'good leverage' else 'regular' end as kind from r, s""")
def outlier_map_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals of a least-squares line by their normal MAD, leverage by the robust distance of the regressor."""
    rows = numeric(_line(spark, sf_dir), PAIR, ["l_orderkey"])
    n, beta = rows.count(), regression.least_squares(rows, ["qty"], "price")
    r = F.col("price") - float(beta[0]) * F.col("qty") - float(beta[1])
    mr, mq = medians(rows, [r, F.col("qty")], n)
    sr, sq = medians(rows, [F.abs(r - float(mr)), F.abs(F.col("qty") - float(mq))], n) / MAD_NORMAL
    scored = rows.select("l_orderkey", (r / float(sr)).alias("standardised"), (F.abs(F.col("qty") - float(mq)) / float(sq)).alias("distance"))
    return regression.classify(scored, 2.5, 2.2414027276049473).select("l_orderkey", "kind")


@query("lts_outlier_map")
def lts_outlier_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _scaled_orders(spark, sf_dir)
    out = regression.FastLTS().fit(df, ["qty", "n_items"], "price").outlier_map(df, "l_orderkey")
    return rounded(out, 2, "residual", "standardised", "distance")


# -- principal components ------------------------------------------------------


@query("spatial_median_3", sql=f"""with {_SCALED}, a0 as (select avg(qty) as x, avg(price) as y from o),
 a1 as (select sum(qty / d) / sum(1 / d) as x, sum(price / d) / sum(1 / d) as y from (select qty, price, sqrt(power(qty - x, 2) + power(price - y, 2)) as d from o, a0) where d > 0),
 a2 as (select sum(qty / d) / sum(1 / d) as x, sum(price / d) / sum(1 / d) as y from (select qty, price, sqrt(power(qty - x, 2) + power(price - y, 2)) as d from o, a1) where d > 0),
 a3 as (select sum(qty / d) / sum(1 / d) as x, sum(price / d) / sum(1 / d) as y from (select qty, price, sqrt(power(qty - x, 2) + power(price - y, 2)) as d from o, a2) where d > 0)
 select round(x, 5) as qty, round(y, 5) as price from a3""")
def spatial_median_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = l1_median(_scaled_orders(spark, sf_dir), PAIR, tolerance=0.0, most_steps=3)
    return spark.createDataFrame([tuple(round(float(v), 5) for v in at)], "qty double, price double")


@query("stahel_donoho_axes", sql=f"""with {DOC_SQL}, {_mad_sql('a', 'doc_features', 'n_chars')}, {_mad_sql('b', 'doc_features', 'n_words')}
 select doc_id, round(greatest(abs(n_chars - a.m) / a.s, abs(n_words - b.m) / b.s), 5) as outlyingness from doc_features, a, b""")
def stahel_donoho_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pca.stahel_donoho(doc_features(spark, sf_dir), ["n_chars", "n_words"], axes=np.eye(2), keep=["doc_id"])
    return rounded(out.select("doc_id", "outlyingness"), 5, "outlyingness")


@query("stahel_donoho_directions")
def stahel_donoho_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pca.stahel_donoho(doc_features(spark, sf_dir), ["n_chars", "n_words", "n_distinct", "n_lines"], keep=["doc_id"])
    return rounded(out.select("doc_id", "outlyingness"), 4, "outlyingness")


def _components(spark: SparkSession, m: pca.PcaModel) -> DataFrame:
    rows = [(c, k + 1, round(float(m.components[i, k]), 3), round(float(m.eigenvalues[k]), 3), round(float(m.ratios[k]), 3)) for i, c in enumerate(m.columns) for k in range(len(m.eigenvalues))]
    return spark.createDataFrame(rows, "column string, component int, loading double, eigenvalue double, cumulative double")


@query("spherical_pca")
def spherical_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _components(spark, pca.SphericalPca(n_components=2).fit(_scaled_orders(spark, sf_dir), ["qty", "price", "n_items", "charged"]))


@query("robpca")
def robpca(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _components(spark, pca.ROBPCA(n_components=2).fit(_scaled_orders(spark, sf_dir), ["qty", "price", "n_items", "charged"]))


@query("robpca_outlier_map")
def robpca_outlier_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _scaled_orders(spark, sf_dir)
    out = pca.ROBPCA(n_components=2).fit(df, ["qty", "price", "n_items", "charged"]).outlier_map(df, "l_orderkey")
    return rounded(out, 2, "sd", "od", "sd_cutoff", "od_cutoff")


@query("embedding_pca")
def embedding_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    width = e.agg(F.max(F.size("embedding"))).first()[0]
    df = e.select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(width)])
    model = pca.SphericalPca(n_components=3).fit(df, [f"e{i}" for i in range(width)])
    return rounded(model.transform(df, ["vec_id"]), 3, "pc1", "pc2", "pc3")


# -- cells ---------------------------------------------------------------------

DOC_COLUMNS = ["n_chars", "n_words", "n_distinct"]


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = doc_features(spark, sf_dir)
    return d.select("doc_id", *[F.log1p(c).alias(c) for c in DOC_COLUMNS])


def _onestep(name: str, source: str, value: str) -> str:
    """CTE (location, scale) of a column by the cellwise one-step estimator."""
    return f"""{name}_m as (select median({value}) as m from {source}), {name}_s as (select any_value(m) as m, median(abs({value} - m)) / 0.6744897501960817 as s from {source}, {name}_m),
 {name}_r as (select {value} as x, s, ({value} - m) / s as r from {source}, {name}_s where {value} is not null),
 {name} as (select sum(w * x) / sum(w) as location, any_value(s) * sqrt(avg(power(greatest(-2.5, least(2.5, r)), 2)) / 0.845) as scale from (select *, case when abs(r) <= 1e-5 then 1 when abs(r) <= 3 then power(1 - power(r / 3, 2), 2) else 0 end as w from {name}_r))"""


_CUT = 2.5758293035489004


@query("ddc_correlation", sql=f"""with {DOC_SQL}, l as (select ln(1 + n_chars) as a, ln(1 + n_words) as b from doc_features), {_onestep('ea', 'l', 'a')}, {_onestep('eb', 'l', 'b')},
 u as (select case when abs((a - ea.location) / ea.scale) <= {_CUT} then (a - ea.location) / ea.scale end as x, case when abs((b - eb.location) / eb.scale) <= {_CUT} then (b - eb.location) / eb.scale end as y from l, ea, eb),
 p as (select x, y from u where x is not null and y is not null), {_onestep('pl', 'p', '(x + y)')}, {_onestep('mi', 'p', '(x - y)')},
 r as (select greatest(-0.99, least(0.99, (pl.scale * pl.scale - mi.scale * mi.scale) / 4)) as r from pl, mi)
 select 'n_chars' as f1, 'n_words' as f2, round(corr(x, y), 5) as r from p, r where (x*x - 2*r*x*y + y*y) / (1 - r*r) < {_CUT * _CUT}""")
def ddc_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = DDC().fit(_logs(spark, sf_dir), ["n_chars", "n_words"])
    return spark.createDataFrame([("n_chars", "n_words", round(float(model.correlation[0, 1]), 5))], "f1 string, f2 string, r double")


@query("ddc_cells")
def ddc_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _logs(spark, sf_dir)
    out = DDC().fit(df, DOC_COLUMNS).score(df, ["doc_id"])
    return rounded(out.select("doc_id", *[f"{c}_{k}" for c in DOC_COLUMNS for k in ("resid", "flag")]), 3, *[f"{c}_resid" for c in DOC_COLUMNS])


@query("ddc_rows")
def ddc_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _logs(spark, sf_dir)
    return rounded(DDC().fit(df, DOC_COLUMNS).score(df, ["doc_id"]).select("doc_id", "t", "row_flag"), 4, "t")


@query("ddc_impute")
def ddc_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _logs(spark, sf_dir)
    gaps = df.withColumn("n_words", F.when(F.col("doc_id") % 11 != 0, F.col("n_words")))
    return rounded(DDC().fit(gaps, DOC_COLUMNS).impute(gaps, ["doc_id"]), 3, *DOC_COLUMNS)


@query("initial_ddcw_matrix")
def initial_ddcw_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, cov = initial_ddcw(_logs(spark, sf_dir), DOC_COLUMNS)
    rows = [(a, b, round(float(at[i]), 3), round(float(cov[i, j]), 3)) for i, a in enumerate(DOC_COLUMNS) for j, b in enumerate(DOC_COLUMNS)]
    return spark.createDataFrame(rows, "row string, col string, location double, covariance double")


@query("cellmcd_scores")
def cellmcd_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _logs(spark, sf_dir)
    out = CellMCD().fit(df, DOC_COLUMNS).score(df, ["doc_id"])
    return rounded(out.select("doc_id", *[f"{c}_{k}" for c in DOC_COLUMNS for k in ("resid", "flag")]), 2, *[f"{c}_resid" for c in DOC_COLUMNS])
