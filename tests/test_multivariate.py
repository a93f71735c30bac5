import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bulwark.functions.kernels import inverse_submatrix, mahalanobis
from bulwark.operators import pca, regression, scatter
from bulwark.plans import frames

COV = np.array([[1.0, 0.6, 0.2], [0.6, 1.0, 0.4], [0.2, 0.4, 1.0]])


def planted(spark, n=400, share=0.2, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.multivariate_normal(np.zeros(3), COV, n)
    bad = np.arange(n) < int(share * n)
    x[bad] = rng.normal(10, 0.5, (bad.sum(), 3))
    return spark.createDataFrame(pd.DataFrame({"id": range(n), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]})).repartition(3), bad


COLS = ["a", "b", "c"]


@pytest.mark.parametrize("estimator", [scatter.FastMCD(n_initial_subsets=100), scatter.DetMCD(), scatter.OGK(reweighting=True)])
def test_scatter_resists_contamination(spark, estimator):
    df, bad = planted(spark)
    model = estimator.fit(df, COLS)
    assert np.abs(model.location).max() < 0.4 < np.abs(model.classical_location).max()
    c = model.correlation
    assert np.abs(c - COV).max() < 0.25
    assert np.allclose(model.covariance, model.covariance.T) and np.linalg.eigvalsh(model.covariance).min() > 0
    d = model.distance_distance(df, "id").orderBy("id").toPandas()
    assert d["is_outlier"][bad].all() and d["is_outlier"][~bad].mean() < 0.15


def test_mcd_on_more_rows_than_the_sample(spark):
    df, bad = planted(spark, n=4000)
    model = scatter.FastMCD(n_initial_subsets=100).fit(df, COLS)
    assert model.details["h"] == scatter.mcd_h(4000, 3, None) == 2002
    assert np.abs(model.location).max() < 0.15 and np.abs(model.covariance - COV).max() < 0.2
    # affine equivariance of the optimum
    a = np.array([[2.0, 0, 0], [0, 0.5, 0], [1.0, 0, 3.0]])
    moved = df.select("id", *[sum((F.col(c) * float(a[i, j]) for j, c in enumerate(COLS)), F.lit(5.0)).alias(COLS[i]) for i in range(3)])
    other = scatter.FastMCD(n_initial_subsets=100).fit(moved, COLS)
    assert np.allclose(other.covariance, a @ model.covariance @ a.T, rtol=0.1, atol=0.1)


@pytest.mark.parametrize("n, p, h", [(100, 2, 51), (100, 3, 52), (1000, 5, 503), (1500, 4, 752)])
def test_subset_size(n, p, h):
    assert scatter.mcd_h(n, p, None) == h
    with pytest.raises(ValueError):
        scatter.mcd_h(n, p, 0.2)


def test_missing_values_are_refused(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 1.0), (3.0, 4.0)], "a double, b double")
    for e in (scatter.FastMCD(), scatter.OGK(), scatter.KendallTau(), scatter.WrappingCovariance()):
        with pytest.raises(ValueError):
            e.fit(df, ["a", "b"])


def test_kendall_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 8, 60).astype(float), rng.integers(0, 8, 60).astype(float)
    s = np.sign(x[:, None] - x) * np.sign(y[:, None] - y)
    tau = s.sum() / np.sqrt((np.sign(x[:, None] - x) ** 2).sum() * (np.sign(y[:, None] - y) ** 2).sum())
    assert scatter._tau_b(x, y) == pytest.approx(tau)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    assert scatter.KendallTau().fit(df, ["x", "y"]).details["correlation"][0, 1] == pytest.approx(tau)


def test_mahalanobis_and_submatrix(spark):
    df, _ = planted(spark, n=20)
    got = df.select("a", "b", "c", mahalanobis([F.col(c) for c in COLS], np.array([1.0, 2, 3]), COV).alias("d")).toPandas()
    v = got[COLS].values - [1, 2, 3]
    assert np.allclose(got["d"], np.sqrt(np.einsum("ij,jk,ik->i", v, np.linalg.inv(COV), v)))
    for keep in ([1, 1, 0], [0, 1, 0], [1, 1, 1]):
        k = np.array(keep, bool)
        assert np.allclose(inverse_submatrix(COV, np.linalg.inv(COV), k), np.linalg.inv(COV[np.ix_(k, k)]))


@pytest.mark.parametrize("n, p, alpha, factor", [(10, 0, 0.5, 1.21523), (100, 1, 0.5, 1.10356), (100, 5, 0.9, 1.047415), (1000, 10, 0.9, 1.008717)])
def test_lts_factor_goldens(n, p, alpha, factor):
    assert regression.correction_factor(p, n, alpha) == pytest.approx(factor, abs=1e-4)
    with pytest.raises(ValueError):
        regression.correction_factor(p, n, 0.3)


def line(spark, n=600):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(n, 2))
    y = 2 * x[:, 0] + 3 * x[:, 1] + 1 + rng.normal(size=n) * 0.5
    y[: n // 5] -= 40
    x[: n // 10, 0] += 20
    return spark.createDataFrame(pd.DataFrame({"id": range(n), "u": x[:, 0], "v": x[:, 1], "y": y}))


@pytest.mark.parametrize("estimator", [regression.FastLTS(n_initial_subsets=100, robust_reweighting=True), regression.SRegression(n_initial_subsets=100), regression.MMRegression(regression.SRegression(n_initial_subsets=100))])
def test_regression_resists_contamination(spark, estimator):
    df = line(spark)
    m = estimator.fit(df, ["u", "v"], "y")
    assert np.allclose([*m.coefficients, m.intercept], [2, 3, 1], atol=0.25)
    assert (0.2 if isinstance(estimator, regression.FastLTS) else 0.3) < m.scale < 0.8  # trimmed squares have no consistency factor
    if isinstance(estimator, regression.FastLTS):
        kinds = {r["kind"]: r["count"] for r in m.outlier_map(df, "id").groupBy("kind").count().collect()}
        assert kinds["bad leverage"] >= 58 and kinds["vertical outlier"] >= 55


def test_pca(spark):
    rng = np.random.default_rng(3)
    t = rng.normal(size=(300, 2)) * [5, 2]
    axes = np.linalg.qr(rng.normal(size=(5, 2)))[0]
    x = t @ axes.T + rng.normal(size=(300, 5)) * 0.1
    x[:45] += rng.normal(0, 1, 5) * 30
    cols = [f"x{i}" for i in range(5)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=cols).assign(id=range(300)))
    for e in (pca.ROBPCA(n_components=2), pca.SphericalPca(n_components=2)):
        m = e.fit(df, cols)
        assert m.components.shape == (5, 2)
        assert np.abs(np.linalg.svd(m.components.T @ axes)[1]).min() > 0.95
        scores = m.transform(df, ["id"])
        assert scores.columns == ["id", "pc1", "pc2"] and m.inverse_transform(scores).columns == cols
        kinds = m.outlier_map(df, "id").where("id < 45").groupBy("kind").count().collect()
        assert sum(r["count"] for r in kinds if r["kind"] != "regular") >= 44


def test_stahel_donoho_marks_outliers(spark):
    df, bad = planted(spark, n=200, share=0.1)
    s = pca.stahel_donoho(df, COLS, keep=["id"]).orderBy("id").toPandas()
    assert s["outlyingness"][bad].min() > s["outlyingness"][~bad].median() * 2


def test_stahel_donoho_takes_all_rows(spark):
    df = spark.range(0, 30_001).select("id", (F.col("id") * F.col("id") % 30_011).cast("double").alias("a"), F.log1p(F.col("id")).alias("b"))
    s = pca.stahel_donoho(df, ["a", "b"], axes=np.eye(2), keep=["id"]).toPandas()
    x = s[["a", "b"]].to_numpy()
    d = np.abs(x - np.median(x, axis=0))
    np.testing.assert_allclose(s["outlyingness"], (d / np.median(d, axis=0)).max(axis=1), rtol=1e-9)


def test_stahel_donoho_reads_its_rows_once_to_fit_and_once_to_score(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.range(0, 3000).select("id", (F.col("id") * F.col("id") % 3011).cast("double").alias("a"), F.log1p(F.col("id")).alias("b"))
    df = df.mapInArrow(counted, "id long, a double, b double")
    assert len(pca.stahel_donoho(df, ["a", "b"], n_dir=5, keep=["id"]).collect()) == 3000
    assert read.value == 6000


def test_complete_rows_work_each_column_out_once(spark):
    text = spark.createDataFrame([(1, "a b a"), (2, "c"), (3, None), (None, "d e")], "id long, text string")
    words = F.split("text", " ", -1)
    df = text.select("id", F.size(F.array_distinct(words)).alias("n"), F.when(F.col("id") != 2, F.col("id")).otherwise(float("nan")).alias("x"))
    for columns in (["n"], ["n", "x"]):
        found = frames.complete(df, columns, ["id"])
        plain = frames.numeric(df, columns, ["id"]).dropna()
        assert found.schema.names == plain.schema.names and found.collect() == plain.collect()
        assert found._jdf.queryExecution().executedPlan().toString().count("array_distinct(") == 1
    assert found.collect() == [(1, 2.0, 1.0)]
    with pytest.raises(TypeError):
        frames.complete(text, ["text"])
