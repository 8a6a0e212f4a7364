"""The whole analysis of a table of bars: gate, dataset, split, stability filter, scaling, model, scores, attribution."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.config import DEFAULT, TARGET, Settings
from barwright.operators import boosting, evaluation, features
from barwright.sources.shared import saved


@dataclass
class Report:
    volume_ok: bool
    columns: list[str]
    kept: list[str]
    table: DataFrame
    scaled: DataFrame
    stability: DataFrame | None
    drift: DataFrame
    model: boosting.Boosted
    predictions: DataFrame
    metrics: DataFrame
    confusion: DataFrame
    confusion_metrics: DataFrame
    phis: DataFrame
    importance: DataFrame


def run(bars: DataFrame, trees: int | None = None, draws: int | None = None, tune: bool = True, select: bool = True, s: Settings = DEFAULT) -> Report:
    """trees and draws of the search are those of the settings unless given; without `tune` the fixed parameters are used, without `select` all columns stay.

    The table is split before columns are chosen, so choice, scaling and drift look at training rows only as reference.
    """
    trees, draws = s.trees if trees is None else trees, s.draws if draws is None else draws
    volume_ok = features.volume_usable(bars, s)
    columns = features.feature_names(volume_ok, s)
    table = saved(evaluation.assign_split(features.dataset(bars, volume_ok, s), s))
    train = table.where("split = 'train'")
    kept, stable = evaluation.temporal_consistency(train, columns, s=s) if select else (columns, None)
    kept = kept or columns
    scaled = evaluation.apply_scaler(table, evaluation.fit_scaler(train, kept), kept)
    model = boosting.random_search(scaled, kept, draws, trees, s)[0] if tune else boosting.fit(scaled, kept, boosting.UNTUNED, trees, s.patience, s.seed)
    test = scaled.where("split = 'test'")
    predictions = boosting.predict(test, model)
    rows = evaluation.with_y_p(predictions, F.col("prediction"))
    mean = train.agg(F.avg(TARGET).alias("mean"))
    phis = boosting.attribution(test, model)
    return Report(
        volume_ok, columns, kept, table, scaled, stable, evaluation.drift(table, kept), model, predictions,
        evaluation.metrics(evaluation.predictors(rows, mean)), evaluation.confusion(rows), evaluation.confusion_metrics(rows), phis, boosting.importance(phis),
    )
