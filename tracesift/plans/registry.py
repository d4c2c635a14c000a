"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import localization

FLAGSHIP = "line_ochiai"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(localization.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(localization.ORACLES)
