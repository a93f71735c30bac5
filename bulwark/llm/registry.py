"""Queries of the operators in this subpackage, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Modules that register queries when they are imported.
MODULES = (
    "op1_bpe",
    "op2_quality_classifier",
    "op3_lm_score",
    "op4_chat",
    "op5_toxicity",
    "op6_html",
    "op7_quality_rules",
    "op8_near_duplicates",
    "op9_mixture",
    "op10_chroma",
)


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def load() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    for module in MODULES:
        import_module(f"bulwark.llm.{module}")
    return QUERIES, ORACLE_SQL
