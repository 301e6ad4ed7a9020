"""Registered queries: each operator over its derived relations, and the DuckDB SQL of the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import operators  # noqa: F401  registers the operators
from .dual import OPERATORS
from .fixtures import FX


def _query(op) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return op(**FX.frames(spark, sf_dir, op))

    run.__name__, run.__doc__ = op.key, op.doc
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {key: _query(op) for key, op in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    return {key: sql for key, op in OPERATORS.items() if (sql := FX.oracle(op))}
