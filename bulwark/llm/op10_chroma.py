"""Query op10: chroma fingerprints of all embeddings played as melodies, and their alignment with the query set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bulwark.llm.chroma import melody
from bulwark.llm.common import table
from bulwark.llm.recordings import search, with_fingerprints
from bulwark.llm.registry import query


@query("op10_chroma_fingerprints")
def op10_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = with_fingerprints(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), "vec_id", "embedding", lambda v: melody(v or []))
    found = search(prints, F.col("id") % 100 == 0)
    return found.select(F.col("id").alias("vec_id"), "n_items", "class_id", "match_id", "offset", F.round("bit_error", 6).alias("bit_error"), "n_matches")
