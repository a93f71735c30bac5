import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bulwark.plans import moments
from bulwark.plans.frames import median_by
from bulwark.plans.moments import block_sums


@pytest.mark.parametrize("n", [5, 1000, 30_001, 30_002])
def test_exact_at_every_size(spark, n):
    rng = np.random.default_rng(n)
    a, b = rng.normal(size=n), rng.integers(0, 50, n).astype(float)  # b has many ties
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b})).repartition(4)
    for rank in (1, n // 3 + 1, n // 2 + 1, n):
        got = moments.order_statistics(df, [F.col("a"), F.col("b"), F.col("a") * 2], rank, n)
        assert got == [np.sort(a)[rank - 1], np.sort(b)[rank - 1], 2 * np.sort(a)[rank - 1]]
    assert moments.medians(df, [F.col("a"), F.col("b")], n).tolist() == [np.median(a), np.median(b)]


def test_ties_do_not_reach_the_driver(spark, monkeypatch):
    df = spark.range(0, 60_000).select((F.col("id") % 5).cast("double").alias("x"), F.when(F.col("id") < 40_000, 1.0).otherwise(F.col("id").cast("double")).alias("y"))
    got, run = [], moments._run
    monkeypatch.setattr(moments, "_run", lambda *a: got.append(run(*a)) or got[-1])
    assert moments.medians(df, [F.col("x"), F.col("y")], 60_000).tolist() == [2.0, 1.0]
    assert moments.order_statistics(df, [F.col("x"), F.col("y")], 45_000, 60_000) == [3.0, 44_999.0]
    assert max(len(v) for row in got for v in row if isinstance(v, list)) < 200


def test_moments_of_subsets(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3)) + 1e6
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]))
    (n, mean, cov), (m, _, part) = moments.subset_moments(df, ["a", "b", "c"], [None, F.col("a") > 1e6], np.full(3, 1e6))
    assert n == 500 and np.allclose(mean, x.mean(axis=0)) and np.allclose(cov, np.cov(x, rowvar=False))
    keep = x[x[:, 0] > 1e6]
    assert m == len(keep) and np.allclose(part, np.cov(keep, rowvar=False))


def test_sample_takes_rows_not_values(spark):
    hot = spark.range(0, 6000).select(F.lit(1.0).alias("a"), F.lit(-1.0).alias("b"))
    rest = spark.range(0, 12000).select((F.col("id") % 4000 + 2).cast("double").alias("a"), F.lit(0.0).alias("b"))
    df = hot.unionByName(rest)
    shares = [(moments.hashed_sample(df, ["a", "b"], 1500, seed)[:, 0] == 1).mean() for seed in range(3)]
    assert all(0.27 < s < 0.4 for s in shares)
    x = moments.hashed_sample(df, ["a", "b"], 1500)
    assert x.shape == (1500, 2) and np.array_equal(x, moments.hashed_sample(df.repartition(7), ["a", "b"], 1500))
    assert len(np.unique(x[x[:, 0] > 1][:, 0])) > 700  # of 4000 values with 3 rows each
    assert len(moments.hashed_sample(df, ["a", "b"], 20_000)) == 18_000 and len(moments.hashed_sample(df.limit(0), ["a", "b"], 5)) == 0


def test_medians_by_group_are_exact_with_ties_nulls_and_any_size(spark):
    rng = np.random.default_rng(5)
    groups = {"even": rng.normal(size=30_000), "odd": rng.normal(size=30_001), "tied": rng.integers(0, 3, 20_000).astype(float), "half": np.repeat([0.0, 1.0], 500), "one": np.array([7.0]), "two": np.array([1.0, 4.0]), None: np.arange(9.0)}
    pdf = pd.concat([pd.DataFrame({"k": k, "v": v}, dtype=object) for k, v in groups.items()])
    df = spark.createDataFrame([(k, float(v)) for k, v in pdf.itertuples(index=False)] + [("even", None), ("nothing", None)], "k string, v double").repartition(5)
    found = {r["k"]: r["m"] for r in median_by(df, ["k"], F.col("v"), "m").collect()}
    assert found == {k: float(np.median(v)) for k, v in groups.items()}
    assert median_by(df.where("false"), ["k"], F.col("v")).count() == 0


def test_block_sums_add_up_over_all_tasks_and_nothing(spark):
    x = np.random.default_rng(1).normal(size=(3000, 12))
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"c{i}" for i in range(12)])).repartition(7)
    got = block_sums(df, df.columns, lambda b: (b.T @ b).ravel())
    assert np.allclose(got.reshape(12, 12), x.T @ x)
    assert not block_sums(df.where("false"), df.columns, lambda b: (b.T @ b).ravel()).any()


def test_no_switch_by_size(spark, monkeypatch):
    """Ranks are exact beyond what is gathered, too; there is no size from which they are approximate."""
    assert not hasattr(moments, "EXACT_ROWS") and not hasattr(moments, "SMALL_ROWS")
    monkeypatch.setattr(moments, "GATHERED", 50)
    monkeypatch.setattr(moments, "BRACKET_ROWS", 40)
    x = np.random.default_rng(8).standard_cauchy(20_000)
    x[:3000], x[3000], x[3001] = 0.5, np.inf, -np.inf
    df = spark.createDataFrame(pd.DataFrame({"x": x})).repartition(4)
    for rank in (1, 2, 777, 10_000, 10_001, 19_999, 20_000):
        assert moments.order_statistics(df, [F.col("x")], rank, 20_000) == [np.sort(x)[rank - 1]]


def test_trimmed_sums_follow_moving_values(spark):
    x = np.random.default_rng(2).integers(0, 30, (30_000, 2)).astype(float) + np.random.default_rng(3).choice([0.0, 0.25], (30_000, 2))
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"])).repartition(4).persist()
    sums = moments.TrimmedSums(df, ["a", "b"], moments.moment_terms(np.zeros(2)), 15_500, 30_000)
    for at in (3.0, 3.2, 3.21, 3.21, 9.0):
        values = lambda v, at=at: np.abs(v - at) ** 2
        for row, v in zip(sums.step(values), values(x).T, strict=True):
            under = v <= np.sort(v)[15_499]
            n, mean, cov = moments.moments_from(row, np.zeros(2))
            assert n == under.sum() and np.allclose(mean, x[under].mean(axis=0)) and np.allclose(cov, np.cov(x[under], rowvar=False)) and np.isclose(row[-1], v[under].sum())
    df.unpersist()
