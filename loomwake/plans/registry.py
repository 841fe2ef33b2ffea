"""All queries outside the text subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomwake.plans import messages, pipeline

_MODULES = [pipeline, messages]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.ORACLES.items()}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return messages.evidence(spark, d)
