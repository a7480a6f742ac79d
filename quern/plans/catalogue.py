"""All registered queries of the core, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries_evidence, queries_flow, queries_loop, queries_ops, queries_retrieval, queries_text, queries_verify

MODULES = (queries_text, queries_retrieval, queries_verify, queries_ops, queries_evidence, queries_flow, queries_loop)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.oracle_sql().items()}
