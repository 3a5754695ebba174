"""All registered queries and the equivalent SQL of each."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules with QUERIES (name -> function of session and table folder) and ORACLE (name -> SQL).
MODULES: tuple[str, ...] = ("jurata.plans.record_queries", "jurata.plans.evaluation_queries", "jurata.plans.text_queries", "jurata.plans.stream_queries", "jurata.plans.state_queries", "jurata.plans.workbook_queries", "jurata.plans.judging_queries", "jurata.plans.message_queries")


def _gather(name: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(m), name).items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLE")
