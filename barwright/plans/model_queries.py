"""Registered queries of the model; SQL cannot express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.config import DEFAULT, KEYS, TARGET
from barwright.operators import boosting, evaluation
from barwright.plans import pipeline
from barwright.plans.queries import ALL, clean, register
from barwright.sources.bars import daily_order_bars
from barwright.sources.shared import saved


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = saved(clean(spark, sf_dir))
    return evaluation.apply_scaler(table, evaluation.fit_scaler(table.where("split = 'train'"), ALL), ALL)


@register("param_draws")
def param_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boosting.as_rows(spark, boosting.draw_parameters(DEFAULT.draws))


@register("random_search_trials")
def random_search_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(boosting.random_search(_scaled(spark, sf_dir), ALL, DEFAULT.draws, DEFAULT.trees)[1], "draw long, val_mae double, best_iteration long")


def _predicted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, boosting.Boosted]:
    table = _scaled(spark, sf_dir)
    return table.where("split = 'test'"), boosting.fit(table, ALL, boosting.UNTUNED, DEFAULT.trees)


@register("model_predictions")
def model_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boosting.predict(*_predicted(spark, sf_dir)).select(*KEYS, F.col(TARGET).alias("y"), "prediction")


@register("shap_long")
def shap_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boosting.attribution(*_predicted(spark, sf_dir))


@register("shap_importance")
def shap_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boosting.importance(boosting.attribution(*_predicted(spark, sf_dir)))


@register("shap_importance_top")
def shap_importance_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.top(shap_importance(spark, sf_dir), 15, F.desc("mean_abs"), F.col("feature"))


@register("pipeline_report")
def pipeline_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.run(daily_order_bars(spark, sf_dir)).metrics
