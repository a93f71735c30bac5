import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bulwark.functions import special
from bulwark.operators import univariate as U
from bulwark.operators.preprocessing import DataCleaner, RobustPowerTransformer, RobustScaler, wrapping_transformation

# Published samples with known estimates.
UNI20 = [12, 10, 1, -5, -9, 0, 30, 7, 2, 4, 21, 98, 35, 2, 4, 7, 1, -30, -13, -4]
UNI30 = [-78, 28, -31, -97, -65, -36, -30, -61, -21, 36, 92, 54, -54, 41, -51, 2, -46, -48, -93, 69, 51, 40, 64, -76, -98, 76, -82, 8, 58, 80]
POWER = [
    2.08, 0.96, 3.33, 4.35, 1.14, 1.68, 0.58, 0.31, 0.32, 3.19, 0.99, 1.73, 0.28, 0.9, 0.77, 1.87, 0.85, 1.96, 4.65, 0.79, 1.15, 1.43, 0.68, 0.66, 3.51,
    0.23, 0.9, 1.02, 0.87, 0.6, 0.28, 4.26, 0.17, 5.5, 1.05, 5.35, 0.75, 0.28, 11.45, 0.69, 0.73, 2.05, 1.3, 1.08, 2.4, 0.6, 1.14, 1.17, 0.16, 0.55,
    5.85, 0.82, 2.09, 2.4, 0.78, 1.01, 0.39, 4.1, 1.62, 2.82, 2.19, 2.11, 1.94, 3.36, 1.79, 0.92, 0.77, 0.44, 1.18, 1.91, 0.36, 3.78, 0.14, 2.82, 0.95,
    0.97, 0.82, 0.46, 0.2, 1.94, 0.42, 1.88, 4.57, 0.45, 0.72, 6.42, 1.29, 3.52, 8.91, 1.13, 0.26, 1.22, 1.17, 1.39, 0.1, 0.76, 0.5, 0.85, 0.58, 0.66,
]


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


@pytest.mark.parametrize("x, qn, tau", [(UNI20, 13.0638, 12.26054), (UNI30, 59.18402, 62.92409)])
def test_qn_and_tau_goldens(spark, x, qn, tau):
    df = frame(spark, x=np.array(x, float))
    for method in ("sorted", "pairs"):
        assert U.Qn(method=method).agg(df, ["x"]).first()["scale"] == pytest.approx(qn, abs=0.15)
    assert U.Tau().agg(df, ["x"]).first()["scale"] == pytest.approx(tau, abs=0.05)


def test_qn_selection_matches_brute_force():
    rng = np.random.default_rng(0)
    for n in (2, 3, 5, 40, 101):
        for x in (rng.normal(size=n), rng.integers(0, 5, n).astype(float)):
            x = np.sort(x)
            d = np.sort(np.abs(x[:, None] - x)[np.triu_indices(n, 1)])
            for k in (1, len(d) // 2 + 1, len(d)):
                assert U.kth_pair_difference(x, k) == pytest.approx(d[k - 1], abs=1e-9)


def test_adjusted_boxplot_goldens(spark):
    np.random.seed(100)
    df = frame(spark, x=np.random.lognormal(size=100))
    for method in ("sorted", "pairs"):
        row = U.adjusted_boxplot(df, ["x"], method=method).first()
        assert row["lower_whisker"] == pytest.approx(0.083146469, rel=1e-6)
        assert row["upper_whisker"] == pytest.approx(7.649249676, rel=1e-6)


def test_medcouple_with_ties():
    def brute(x):
        m = np.median(x)
        low, high = x[x <= m], x[x >= m]
        k = int((x == m).sum())
        out = []
        for i, a in enumerate(low):
            for j, b in enumerate(high):
                if a == b:
                    out.append(np.sign(k - 1 - (i - (len(low) - k)) - j))
                else:
                    out.append(((b - m) - (m - a)) / (b - a))
        return np.median(out)

    rng = np.random.default_rng(3)
    for _ in range(30):
        x = np.sort(rng.integers(0, 7, 21).astype(float))
        assert U.medcouple_sorted(x) == pytest.approx(brute(x), abs=1e-9)


def test_univariate_mcd_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=60), rng.normal(20, 1, size=15)])
    row = U.UnivariateMcd().full(frame(spark, g=[1] * 75, value=x).select("g", "value"), ["g"]).first()
    s = np.sort(x)
    h = 75 // 2 + 1
    windows = [s[i : i + h] for i in range(75 - h + 1)]
    best = min(windows, key=lambda w: w.var())
    raw = best.var() * U.share_factor(h, 75)
    keep = x[(x - best.mean()) ** 2 / raw < special.chi2_ppf(0.975, 1)]
    assert row["raw_location"] == pytest.approx(best.mean())
    assert row["raw_scale"] == pytest.approx(math.sqrt(raw), rel=1e-9)
    assert row["location"] == pytest.approx(keep.mean())
    assert row["scale"] == pytest.approx(math.sqrt(keep.var() * U.share_factor(len(keep), 75)), rel=1e-9)
    assert abs(row["location"]) < 1 < abs(x.mean())


def test_groups_nulls_and_constants(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", float("nan")), ("a", None), (None, 5.0), (None, 5.0), ("b", float("inf"))], "g string, x double")
    for e in (U.HuberOneStepM(), U.CellwiseOneStepM(), U.Tau(), U.Qn(), U.UnivariateMcd(), U.MedianMad(), U.OneStepWrapping()):
        rows = {r["g"]: r for r in e.agg(df, ["x"], ["g"]).collect()}
        assert set(rows) == {"a", None}
        assert rows["a"]["location"] == pytest.approx(2.0, abs=0.51)
        assert rows[None]["location"] == 5.0 and rows[None]["scale"] == pytest.approx(0.0, abs=1e-9)
    with pytest.raises(ValueError):
        U.Tau().agg(df, ["x"], ignore_missing=False)
    with pytest.raises(TypeError):
        U.Tau().agg(df, ["g"])


def test_equivariance(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=50)
    df = frame(spark, x=x, y=3 * x - 7)
    for e in (U.HuberOneStepM(), U.CellwiseOneStepM(), U.Tau(), U.Qn(), U.UnivariateMcd(), U.OneStepWrapping()):
        r = {v["feature"]: v for v in e.agg(df, ["x", "y"]).collect()}
        assert r["y"]["scale"] == pytest.approx(3 * r["x"]["scale"], rel=1e-6)
        assert r["y"]["location"] == pytest.approx(3 * r["x"]["location"] - 7, rel=1e-6, abs=1e-6)


def test_l1_and_weighted_median(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (100.0, 100.0)], "a double, b double")
    at = U.l1_median(df, ["a", "b"])
    assert np.allclose(at, [0.5, 0.5], atol=0.2)
    w = spark.createDataFrame([(1, 1.0, 1.0), (1, 2.0, 5.0), (1, 3.0, 1.0), (1, None, 9.0)], "g int, v double, w double")
    assert U.weighted_median(w, "v", "w", ["g"]).first()["weighted_median"] == 2.0


def test_special_functions():
    assert special.chi2_ppf(0.975, 2) == pytest.approx(-2 * math.log(0.025))
    assert special.chi2_cdf(special.chi2_ppf(0.3, 7), 7) == pytest.approx(0.3)
    assert special.gamma_cdf(3.0, 1.0) == pytest.approx(1 - math.exp(-3))


def test_erf_column(spark):
    from pyspark.sql import functions as F

    xs = [-7.0, -2.0, -0.3, 0.0, 0.5, 1.5, 5.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(special.erf(F.col("x"))).collect()]
    assert got == pytest.approx([math.erf(x) for x in xs], abs=1e-12)


def test_wrapping_goldens(spark):
    x1 = [10, 11, 9, 10, 11, 10, 9.5, 10.5, 12, 4, 7]
    x2 = [20, 21, 19, 21, 20, 19, 30, 23, 20, 19.5, 20.5]
    df = frame(spark, i=range(11), x1=np.array(x1, float), x2=np.array(x2, float))
    plain = wrapping_transformation(df, ["x1", "x2"], rescale=False).orderBy("i").toPandas()
    assert plain["x1"].tolist() == pytest.approx([10, 11, 9, 10, 11, 10, 9.5, 10.5, 11.44589267, 10, 8.92540939])
    assert plain["x2"].tolist() == pytest.approx([20, 21, 19, 21, 20, 19, 20, 21.07459061, 20, 19.5, 20.5])
    scaled = wrapping_transformation(df, ["x1", "x2"], b=5.0, c=50.0, q1=0.8, q2=0.05).orderBy("i").toPandas()
    assert scaled["x1"].tolist()[:3] + scaled["x1"].tolist()[-2:] == pytest.approx([10.05699239, 10.86011906, 9.25386572, 9.43007612, 7.64761237])
    assert scaled["x2"].tolist()[6:8] == pytest.approx([20.3970934, 22.46307544])


def test_power_transform_goldens_and_round_trip(spark):
    from pyspark.sql import functions as F

    df = frame(spark, x=np.array(POWER))
    for kind, std, lam in (("yeojohnson", False, -0.7974395), ("yeojohnson", True, -0.139671), ("boxcox", False, 0.04729415), ("boxcox", True, 0.04729415)):
        model = RobustPowerTransformer(kind, std).fit(df, "x")
        assert model.lam == pytest.approx(lam, abs=0.005)
        back = df.select("x", model.inverse(model.transform(F.col("x"))).alias("y")).toPandas()
        assert np.allclose(back["x"], back["y"])
    with pytest.raises(ValueError):
        RobustPowerTransformer("boxcox").fit(frame(spark, x=np.array([-1.0, 2, 3, 4])), "x")


def test_scaler_round_trip(spark):
    rng = np.random.default_rng(2)
    df = frame(spark, a=rng.random(100), b=rng.random(100) * 9)
    model = RobustScaler().fit(df, ["a", "b"])
    there = model.transform(df)
    back = model.inverse_transform(there).toPandas()
    assert np.allclose(back, df.toPandas())
    assert RobustScaler(with_centering=False).fit(df, ["a"]).location == {"a": 0.0}


def test_cleaner(spark):
    nan, inf = float("nan"), float("inf")
    rows = list(zip(
        range(9), "aa bb cc dd ee ff gg hh ii".split(), [True, False, True, False, False, True, True, True, False],
        [1.3, nan, 4.5, 2.7, 20.0, 4.4, -2.1, 1.1, -5.0], [2.3, nan, 5.0, 6.0, 7.0, 8.0, 4.0, -10.0, 0.5], [2.0, inf, 3.0, -4.0, 5.0, 6.0, 7.0, -2.0, 8.0],
        [1.0, -4.0, 2.0, nan, nan, -inf, nan, 6.0, nan], [1, 1, 2, 2, 3, 3, 3, 1, 2], [1.0, 1.5, 2.0, 2.0, 2.0, 2.0, 2.0, 3.0, 2.5], strict=True,
    ))
    df = spark.createDataFrame(rows, "i int, name string, logic boolean, V1 double, V2 double, V3 double, Vna double, Vdis int, V0s double")
    model = DataCleaner().fit(df)
    assert model.kept == ("V1", "V2", "V3")
    assert model.dropped["non_numeric"] == ("name", "logic") and model.dropped["row_numbers"] == ("i",)
    assert model.dropped["discrete"] == ("Vdis",) and model.dropped["small_scale"] == ("V0s",) and model.dropped["missing"] == ("Vna",)
    assert model.transform(df).count() == 8


def test_qn_by_pairs_counts_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(U, "PAIR_BLOCK", 16)
    rng = np.random.default_rng(11)
    groups = {"a": rng.normal(size=300) * 1e3, "b": np.round(rng.normal(size=201), 1), "c": np.full(40, 3.0), "d": np.array([1.0, 4.0]), "e": np.array([2.0]), None: np.repeat([0.0, 5.0], 30)}
    df = spark.createDataFrame([(k, float(v)) for k, x in groups.items() for v in x], "k string, value double").repartition(3)
    found = {r["k"]: r["d"] for r in U.pair_gaps(df, ["k"]).collect()}
    for k, x in groups.items():
        gaps, h = np.sort(np.abs(x[:, None] - x)[np.triu_indices(len(x), 1)]), len(x) // 2 + 1
        if len(x) > 1:
            assert found[k] == pytest.approx(gaps[h * (h - 1) // 2 - 1], abs=1e-12)
    assert set(found) == set(groups) - {"e"}


def test_qn_by_pairs_lists_no_pairs(spark):
    # a self-join of these rows would list 1,800 million pairs
    df = spark.range(0, 60_000).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("value"))
    x, h = np.arange(60_000.0), 30_001
    assert U.pair_gaps(df, ["k"]).first()["d"] == U.kth_pair_difference(x, h * (h - 1) // 2)
