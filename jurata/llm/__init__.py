"""Operators of a training-data pipeline; nothing else in the library imports this subpackage."""

from __future__ import annotations

from importlib import import_module

MODULES = ("near_dedup", "substring_dedup", "decontamination", "token_counts", "quality", "chat", "url_filter", "hilbert", "forest", "sentencepieces", "token_files", "merkle", "sort_means")


def _gather(name: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"{__name__}.{m}"), name).items()}


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLE")
