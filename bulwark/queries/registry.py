"""Where queries register, and the feature frames they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Rounded to that many decimals; adding zero turns a negative zero into zero."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


def order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, qty, price, n_items, charged): correlated sums per order."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("qty"), F.sum("l_extendedprice").alias("price"), F.count(F.lit(1)).cast("double").alias("n_items"),
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("charged"),
    )


ORDER_SQL = """order_features as (select l_orderkey, sum(l_quantity) as qty, sum(l_extendedprice) as price, count(*)::double as n_items,
 sum(l_extendedprice * (1 - l_discount)) as charged from lineitem group by 1)"""


def doc_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_chars, n_words, n_distinct, n_lines): skewed and strongly correlated."""
    words = F.split("text", " ", -1)
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("n_chars").cast("double").alias("n_chars"), F.size(words).cast("double").alias("n_words"),
        F.size(F.array_distinct(words)).cast("double").alias("n_distinct"), F.size(F.split("text", "\n", -1)).cast("double").alias("n_lines"),
    )


DOC_SQL = """doc_features as (select doc_id, n_chars::double as n_chars, len(string_split(text, ' '))::double as n_words,
 len(list_distinct(string_split(text, ' ')))::double as n_distinct, len(string_split(text, chr(10)))::double as n_lines from documents)"""
