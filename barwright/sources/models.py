"""Models and their parameters on disk, through Spark's own file systems."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from barwright.operators.boosting import Boosted


def _write(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"]


def save_model(spark: SparkSession, model: Boosted, path: str) -> None:
    """The trees up to the best iteration and all that predictions need, as JSON in the folder `path`."""
    _write(spark, model.to_json(), path)


def load_model(spark: SparkSession, path: str) -> Boosted:
    return Boosted.from_json(_read(spark, path))


def save_parameters(spark: SparkSession, model: Boosted, path: str) -> None:
    """The parameters and the best iteration, as JSON in the folder `path`."""
    _write(spark, json.dumps(model.parameters | {"best_iteration": model.best_iteration}), path)


def load_parameters(spark: SparkSession, path: str) -> dict:
    return json.loads(_read(spark, path))
