"""The registered queries and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewheel.queries import charts, feeds, kit, learning, live, series, trading, zones  # noqa: F401
from tidewheel.queries.base import ORACLES, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars with their day's volume-weighted price and its bands."""
    return QUERIES["vwap"](spark, sf_dir)


__all__ = ["ORACLES", "QUERIES", "flagship"]
