import numpy as np
from pyspark.sql import functions as F

from bulwark.operators.regression import FastLTS
from bulwark.operators.scatter import FastMCD
from bulwark.sources import datasets
from bulwark.sources.files import read_features, write_scores
from bulwark.streaming.scoring import score_distances, window_median_mad


def test_published_datasets(spark):
    t, s, a = datasets.load_telephone(spark), datasets.load_stars(spark), datasets.load_animals(spark)
    assert (t.data.count(), s.data.count(), a.data.count()) == (24, 47, 28)
    m = FastLTS(n_initial_subsets=200, robust_reweighting=True).fit(t.data, ["Year"], "Calls")
    assert abs(m.coefficients[0] - 0.11) < 0.03
    model = FastMCD().fit(s.data, ["Te", "light"])
    d = model.distance_distance(s.data, "row_id").where("is_outlier").select("row_id").collect()
    assert {10, 19, 29, 33} <= {r[0] for r in d}


def test_files(spark, tmp_path):
    schema = datasets.T.StructType([datasets.T.StructField("a", datasets.T.DoubleType()), datasets.T.StructField("b", datasets.T.StringType())])
    (tmp_path / "x.csv").write_text("a,b\n1.5,u\n,v\n")
    d = datasets.load(spark, str(tmp_path / "x.csv"), schema, ["a"])
    assert [r["a"] for r in d.data.collect()] == [1.5, None]
    write_scores(spark.createDataFrame([(1, float("nan"), "p")], "id long, x double, k string"), str(tmp_path / "out"), ["k"])
    assert read_features(spark, str(tmp_path / "out"), ["x"], ["id"]).collect()[0]["x"] is None
    (tmp_path / "g.csv").write_text("Make,Price,Unknown\nm,12.5,z\n")
    g = datasets.load_topgear(spark, str(tmp_path / "g.csv"))
    assert g.feature_names == ("Make", "Price") and g.categorical_features == ("Make",)


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "event_type", "value")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = window_median_mad(stream, "ts", "value", ["event_type"], "1 day", normal=False).writeStream.outputMode("complete").format("memory").queryName("bulwark_windows").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["window_start"], r["event_type"]): r for r in spark.table("bulwark_windows").collect()}
    want = events.toPandas()
    want["day"] = want["ts"].dt.floor("D")
    assert len(got) == len(want.groupby(["day", "event_type"]))
    for (day, kind), g in want.groupby(["day", "event_type"]):
        r = got[day.to_pydatetime(), kind]
        m = np.median(g["value"])
        assert r["n"] == len(g) and abs(r["location"] - m) < 1e-9 and abs(r["scale"] - np.median(np.abs(g["value"] - m))) < 1e-9

    numbers = events.select("event_id", F.col("value").alias("a"), (F.col("value") * 2 + F.col("event_id") % 7).alias("b"))
    model = FastMCD(n_initial_subsets=50).fit(numbers, ["a", "b"])
    live = stream.select("event_id", F.col("value").alias("a"), (F.col("value") * 2 + F.col("event_id") % 7).alias("b"))
    q = score_distances(live, model, ["event_id"], 3.0).writeStream.format("memory").queryName("bulwark_scores").start()
    q.processAllAvailable()
    q.stop()
    batch = score_distances(numbers, model, ["event_id"], 3.0)
    assert sorted(map(tuple, spark.table("bulwark_scores").collect())) == sorted(map(tuple, batch.collect()))
