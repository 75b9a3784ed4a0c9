"""The engine's own queries: scripts of the dialect over the driver's tables, each with what DuckDB should find.

Floats are rounded on both sides where the order of adding may show; ``+ 0.0`` makes -0.0 plain.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..runtime import Engine, Run
from .extras import EXTRAS
from .features import QUERIES as FEATURES
from .oracles import QUERIES


def _runner(script: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Engine(spark, Run(root=sf_dir)).sql(script)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _runner(script) for name, (script, _) in QUERIES.items()} | {name: f for name, (f, _) in (EXTRAS | FEATURES).items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in (QUERIES | EXTRAS | FEATURES).items() if sql}
