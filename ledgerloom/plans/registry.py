"""All queries of the core engine with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import analyses, events, grouping, identities, lifecycles, linking, readings, relating, reports, searching, streams, texts, tracking

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (tracking, grouping, texts, analyses, identities, linking, relating, events, lifecycles, searching, reports, readings, streams)


def queries() -> dict[str, Query]:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in _MODULES for name, q in m.SQL.items()}
