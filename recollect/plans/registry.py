"""All queries of the engine by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collection, language, lifecycle, perception, retrieval, streams  # noqa: F401  (they register their queries)
from .core import NAMES, ORACLES, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["moment_search"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v.replace("{names}", NAMES) for k, v in ORACLES.items()}
