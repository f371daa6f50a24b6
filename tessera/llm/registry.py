"""Queries ``opN_<name>`` of the training-data operators and their DuckDB equivalents."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession

MODULES = (
    "url_filters",
    "chat_format",
    "toxicity",
    "language_id",
    "simhash",
    "mixing",
    "packing",
    "gif_media",
    "license_scan",
    "minhash",
    "importance",
    "merkle",
    "pii",
)


def _modules() -> list[ModuleType]:
    return [importlib.import_module(f"tessera.llm.{name}") for name in MODULES]


def queries(modules: list[ModuleType] | None = None) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries of the given operators, all by default."""
    return {m.QUERY: m.query for m in (_modules() if modules is None else modules)}


def oracle_sql(modules: list[ModuleType] | None = None) -> dict[str, str]:
    return {m.QUERY: m.ORACLE_SQL for m in (_modules() if modules is None else modules) if getattr(m, "ORACLE_SQL", None)}
