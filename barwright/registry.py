"""All registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barwright.operators import features
from barwright.plans import model_queries, queries as plans  # noqa: F401  registers its queries
from barwright.sources import bars


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(plans.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(plans.SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.dataset(bars.daily_order_bars(spark, sf_dir))
