"""Reading feature frames and writing scored frames and fitted models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from bulwark.plans.frames import numeric


def read_features(spark: SparkSession, path: str, columns: Sequence[str], keep: Sequence[str] = (), kind: str = "parquet", **options) -> DataFrame:
    """``keep`` and the feature columns as finite doubles; only those columns are read from columnar files."""
    return numeric(spark.read.format(kind).options(**options).load(path), columns, keep)


def write_scores(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists", kind: str = "parquet") -> None:
    writer = df.write.format(kind).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
