"""Integrity rules as data-quality checks: one row per rule with its violations, in one pass per table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rules of one row: name -> condition that a good row meets (unknown counts as met, as in a table check).
RUN_RULES = {"run_counts_add_up": "total = valid + input_invalid", "run_has_valid": "valid >= 1"}
RECORD_RULES = {
    "label_only_if_completed": "(label is not null) = (status = 'completed')",
    "review_only_if_completed": "(review_required is not null) = (status = 'completed')",
    "question_and_answer": "status = 'input_invalid' or (q is not null and a is not null)",
}
EVALUATION_RULES = {"agree_only_if_predicted": "(agent_label is null) = (agree is null)"}
ATTEMPT_RULES = {"attempt_number": "attempt_no between 1 and 3"}


def row_violations(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(rule, violations) of the rules, all counted in one aggregate."""
    counts = df.agg(*[F.count_if(~F.coalesce(F.expr(r), F.lit(True))).alias(k) for k, r in rules.items()])
    return counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, rules)), F.array(*rules))).alias("rule", "violations"))


def key_violations(df: DataFrame, rule: str, keys: Sequence[str], where: Column | str | None = None) -> DataFrame:
    """(rule, violations): keys that occur more than once."""
    rows = df.where(where) if where is not None else df
    return rows.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def reference_violations(child: DataFrame, parent: DataFrame, rule: str, child_key: str, parent_key: str) -> DataFrame:
    """(rule, violations): rows of the child without a parent."""
    lost = child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")
    return lost.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")
