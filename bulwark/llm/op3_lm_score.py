"""Query op3: pseudo-log-likelihood of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bulwark.llm.common import table
from bulwark.llm.pseudo_likelihood import score, train
from bulwark.llm.registry import query


@query("op3_lm_score")
def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out = score(docs, train(docs), keep=["doc_id"])
    mean = F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words"))
    return out.select("doc_id", "n_words", F.round("log_likelihood", 2).alias("log_likelihood"), F.round(mean, 4).alias("mean_log_likelihood"), "n_unseen")
