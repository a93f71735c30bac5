"""Query op2: quality scores of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bulwark.llm.common import held_out, table
from bulwark.llm.nbsvm import score, train
from bulwark.llm.registry import query

THRESHOLD = 0.7


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels, "quality"))


@query("op2_quality_classifier")
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
