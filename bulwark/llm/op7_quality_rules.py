"""Query op7: quality rules under weak supervision over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bulwark.llm.common import table
from bulwark.llm.quality_rules import judge, oracle_ctes
from bulwark.llm.registry import query

_COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op7_quality_rules", sql=f"with {oracle_ctes()}\nselect {', '.join(_COLUMNS)} from judged")
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents", "doc_id", "text"), with_text=False).select(*_COLUMNS)
