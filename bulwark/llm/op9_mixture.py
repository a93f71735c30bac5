"""Query op9: all documents mixed to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bulwark.llm.common import table
from bulwark.llm.mixture import mix, oracle_sql
from bulwark.llm.registry import query


@query("op9_mixture", sql=oracle_sql())
def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return plan.documents.select("doc_id", "size", "source_size", "target", "taken")
