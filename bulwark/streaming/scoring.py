"""Scoring streams with models fitted in batch, and robust statistics of time windows.

A fitted model is a projection, so it scores a stream as it scores a table.
Window medians hold the values of open windows in state until the watermark
passes; their size is that of the windows, not of the stream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bulwark.functions.kernels import MAD_NORMAL
from bulwark.operators.scatter import ScatterModel
from bulwark.plans.frames import finite


def score_distances(stream: DataFrame, model: ScatterModel, keep: Sequence[str], cutoff: float) -> DataFrame:
    """keep…, distance and is_outlier of each row of a (streaming) frame."""
    return stream.select(*keep, model.distance().alias("distance")).withColumn("is_outlier", F.col("distance") > cutoff)


def window_median_mad(stream: DataFrame, time: str, value: str, by: Sequence[str] = (), width: str = "1 hour", lateness: str = "10 minutes", normal: bool = True) -> DataFrame:
    """(window_start, by…, n, location, scale) of tumbling windows, late rows beyond ``lateness`` left out.

    One aggregation collects the sorted values of each window, from which both
    statistics follow, since a stream can't be read twice.
    """
    x = finite(F.col(value))
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness).where(x.isNotNull())
    grouped = rows.groupBy(F.window(time, width).alias("w"), *by).agg(F.sort_array(F.collect_list(x)).alias("v"))

    def middle(a):
        n = F.size(a)
        return (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2

    at = grouped.withColumn("location", middle(F.col("v")))
    gaps = F.sort_array(F.transform("v", lambda t: F.abs(t - F.col("location"))))
    scale = middle(gaps) / (MAD_NORMAL if normal else 1.0)
    return at.select(F.col("w.start").alias("window_start"), *by, F.size("v").alias("n"), "location", scale.alias("scale"))
