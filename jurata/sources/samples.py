"""Small synthetic workbooks: one for each way an input can pass or be blocked, and gold sets."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from ..schemas import GOLD_COLUMNS, GOLD_META, INPUT_COLUMNS
from .xlsx import workbook_bytes


def record(number, q: str | None = "Where is the form?", a: str | None = "At the desk.", **refs: str) -> tuple:
    """An input row with the given references."""
    return (number, q, a, *[refs.get(f"ref{k}") for k in range(1, 11)])


def samples() -> dict[str, dict[str, tuple[list[str], list[tuple]]]]:
    """name -> sheets of a workbook (columns and rows)."""
    head = list(INPUT_COLUMNS)
    good = [record(f"N-{i}", ref1="The form is at the desk. It costs nothing.") for i in range(1, 4)]
    one = lambda rows, columns=head: {"QA_REF": (columns, rows)}
    return {
        "passed": one(good),
        "blank_rows": one([good[0], record(None, None, None), good[1]]),
        "missing_column": one([r[:2] + r[3:] for r in good], [c for c in head if c != "a"]),
        "repeated_column": one([(*r, "x") for r in good], [*head, "q"]),
        "extra_column": one([(*r, "x") for r in good], [*head, "note"]),
        "repeated_ids": one([good[0], good[0]]),
        "unreadable_cells": one([good[0], record("N-9", q="#N/A"), record("N-8", a=None)]),
        "no_valid_record": one([record("N-1", q=None)]),
    }


def sample_bytes(name: str) -> bytes:
    return workbook_bytes({sheet: (columns, iter(rows)) for sheet, (columns, rows) in samples()[name].items()})


def gold_bytes(rows: Iterable[tuple], meta: Mapping[str, str] | None = None) -> bytes:
    """A gold workbook: rows of the input and annotation columns, and the key-value sheet if there are values for it."""
    sheets = {"gold": ([*INPUT_COLUMNS, *GOLD_COLUMNS], iter(rows))}
    if meta is not None:
        sheets["meta"] = (["key", "value"], iter([(k, meta.get(k)) for k in GOLD_META]))
    return workbook_bytes(sheets)
