"""Registered queries of the bar analytics, each over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.config import KEYS, TARGET
from barwright.operators import evaluation as E
from barwright.operators import features as X
from barwright.plans import sql as S
from barwright.sources import bars as B

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
ALL = X.feature_names()


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def rounded(df: DataFrame, digits: int | None = 6) -> DataFrame:
    """Doubles rounded for comparison (None: by name, as in the SQL); negative zero becomes zero."""
    return df.select(*((F.round(c, digits or S.places(c)) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def clean(spark: SparkSession, sf_dir: str, panel: bool = False) -> DataFrame:
    """The modelling table of the daily bars with its split; values rounded so that ties are the same everywhere."""
    return E.assign_split(rounded(X.dataset(B.daily_order_bars(spark, sf_dir, panel=panel)), None))


def stand_in(spark: SparkSession, sf_dir: str, panel: bool = False) -> tuple[DataFrame, DataFrame]:
    """(series, date, y, p) on test rows for a simple fixed predictor, and the training mean (by series for a panel)."""
    table = clean(spark, sf_dir, panel)
    p = F.round(0.1 * F.col("daily_return") - 0.02 * F.col("ret_lag_1"), 9) + F.lit(0.0)
    return E.with_y_p(table.where("split = 'test'"), p), table.where("split = 'train'").groupBy(*["series"] * panel).agg(F.avg(TARGET).alias("mean"))


_BARS = "SELECT series, date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM bars"
register("bars_daily", f"WITH {S.DAILY} {_BARS}")(lambda s, d: rounded(B.daily_order_bars(s, d)))
register("bars_panel", f"WITH {S.PANEL} {_BARS}")(lambda s, d: rounded(B.daily_order_bars(s, d, panel=True)))
register("bars_hourly_panel", f"WITH {S.HOURLY} {_BARS}")(lambda s, d: rounded(B.hourly_event_bars(s, d)))

GROUPS = {
    "feat_price_shape": ["amplitude", "difference", "h_minus_l", "c_minus_o", "delta_c", "momentum", "sign_delta_open"],
    "feat_returns": ["daily_return"],
    "feat_lags": [f"ret_lag_{k}" for k in (0, 1, 2, 3, 5)],
    "feat_sma": [f"ma_{n}" for n in (5, 10, 20, 60)],
    "feat_delta_ma": [f"delta_c_ma_{n}" for n in (5, 10, 20)],
    "feat_intraday_ma": [f"intraday_ma_{n}" for n in (5, 10, 20)],
    "feat_rsi": ["rsi"],
    "feat_williams": ["williams_r"],
    "feat_bollinger": ["bb_high", "bb_low"],
    "feat_volume": ["delta_v", *(f"delta_v_ma_{n}" for n in (5, 10, 20))],
    "feat_ema": [f"ema_{n}" for n in (5, 10, 20, 60)],
    "feat_macd": ["macd"],
    "feat_all": ALL,
}


def _feature_query(names: list[str], source: Callable) -> Query:
    return lambda s, d: rounded(X.add_features(source(s, d)).select(*KEYS, *names), None)


for _name, _columns in GROUPS.items():
    register(_name, S.features_sql(S.DAILY, _columns))(_feature_query(_columns, B.daily_order_bars))
register("feat_panel", S.features_sql(S.PANEL, ALL))(_feature_query(ALL, lambda s, d: B.daily_order_bars(s, d, panel=True)))
register("feat_hourly_panel", S.features_sql(S.HOURLY, ALL))(_feature_query(ALL, B.hourly_event_bars))
FIRST = 300
register("feat_first_bars", S.features_sql(S.first_bars(S.DAILY, FIRST), ALL))(_feature_query(ALL, lambda s, d: X.prefix(B.daily_order_bars(s, d), FIRST)))

register("target_next", f"WITH {S.DAILY}, {S.feature_steps()} SELECT series, date, {S.pick([TARGET])} FROM f")(lambda s, d: rounded(X.add_target(B.daily_order_bars(s, d)).select(*KEYS, TARGET), None))
register("volume_gate", f"WITH {S.HOURLY} SELECT series, round(avg(CASE WHEN volume IS NULL OR volume = 0 THEN 1.0 ELSE 0.0 END), 6) AS degenerate, avg(CASE WHEN volume IS NULL OR volume = 0 THEN 1.0 ELSE 0.0 END) < 0.05 AS usable FROM bars GROUP BY series")(
    lambda s, d: rounded(X.volume_gate(B.hourly_event_bars(s, d)))
)
register("dataset_clean", f"WITH {S.dataset_steps(ALL)} SELECT series, date, {S.pick([*ALL, TARGET])} FROM d")(lambda s, d: rounded(clean(s, d).drop("split"), None))
_WHOLE = " AND ".join(f"{c} IS NOT NULL" for c in [*ALL, TARGET])
register("dataset_counts", f"WITH {S.PANEL}, {S.feature_steps()} SELECT series, count(*) AS n_before, count(*) FILTER (WHERE {_WHOLE}) AS n_after, count(*) - count(*) FILTER (WHERE {_WHOLE}) AS n_dropped FROM f GROUP BY series")(
    lambda s, d: X.dataset_counts(B.daily_order_bars(s, d, panel=True))
)
register("split_assign", f"WITH {S.dataset_steps(ALL)} SELECT series, date, split FROM d")(lambda s, d: clean(s, d).select(*KEYS, "split"))
register("split_describe", f"WITH {S.dataset_steps(ALL)} SELECT series, split, min(date) AS first_date, max(date) AS last_date, count(*) AS n FROM d GROUP BY series, split")(lambda s, d: E.describe_split(clean(s, d)))
register("semi_join_test_bars", f"WITH {S.dataset_steps(ALL)} SELECT b.series, b.date, b.open, b.high, b.low, b.close, b.volume FROM bars b SEMI JOIN (SELECT * FROM d WHERE split = 'test') t ON b.series = t.series AND b.date = t.date")(
    lambda s, d: X.keep_bars(B.daily_order_bars(s, d), clean(s, d).where("split = 'test'"))
)
register("reindex_left", f"WITH {S.dataset_steps(ALL)} SELECT b.series, b.date, round(d.rsi, 6) + 0.0 AS rsi FROM bars b LEFT JOIN d ON b.series = d.series AND b.date = d.date")(
    lambda s, d: rounded(X.reindex(clean(s, d).select(*KEYS, "rsi"), B.daily_order_bars(s, d)))
)


def _frames(s: SparkSession, d: str) -> list[DataFrame]:
    table = X.add_target(X.add_features(B.daily_order_bars(s, d)))
    return [table.select(*KEYS, c) for c in ("rsi", "ma_20", TARGET)]


register("align_outer", f"WITH {S.DAILY}, {S.feature_steps()} SELECT series, date, {S.pick(['rsi', 'ma_20', TARGET])} FROM f")(lambda s, d: rounded(X.align(_frames(s, d)), None))
register("align_complete", f"WITH {S.DAILY}, {S.feature_steps()} SELECT series, date, {S.pick(['rsi', 'ma_20', TARGET])} FROM f WHERE rsi IS NOT NULL AND ma_20 IS NOT NULL AND {TARGET} IS NOT NULL")(lambda s, d: rounded(X.align(_frames(s, d), complete=True), None))


def _train(s: SparkSession, d: str) -> DataFrame:
    return clean(s, d).where("split = 'train'")


register("tca_blocks", f"WITH {S.dataset_steps(ALL)}, {S.blocks()} SELECT series, block_id, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM bl GROUP BY series, block_id")(
    lambda s, d: E.calendar_blocks(_train(s, d)).groupBy("series", "block_id").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
)
register("tca_pairs", f"WITH {S.dataset_steps(ALL)}, {S.blocks()}, ids AS (SELECT DISTINCT series, block_id FROM bl) SELECT a.series, a.block_id AS ba, b.block_id AS bb FROM ids a JOIN ids b ON a.series = b.series AND a.block_id < b.block_id")(
    lambda s, d: E.block_pairs(E.calendar_blocks(_train(s, d)))
)
register("tca_auc", f"WITH {S.dataset_steps(ALL)}, {S.auc_steps(ALL)} SELECT series, feature, ba, bb, round(auc, 9) AS auc FROM sc")(lambda s, d: rounded(E.pair_scores(_train(s, d), ALL), 9))
register("tca_kept", f"WITH {S.dataset_steps(ALL)}, {S.auc_steps(ALL)} SELECT series, feature, round(avg(auc), 6) AS agg_auc, round(avg(auc), 9) <= 0.7 AS keep FROM sc GROUP BY series, feature")(
    lambda s, d: rounded(E.stability(E.pair_scores(_train(s, d), ALL)))
)
register("tca_kept_max", f"WITH {S.dataset_steps(ALL)}, {S.auc_steps(ALL)} SELECT series, feature, round(max(auc), 6) AS agg_auc, round(max(auc), 9) <= 0.7 AS keep FROM sc GROUP BY series, feature")(
    lambda s, d: rounded(E.stability(E.pair_scores(_train(s, d), ALL), "max"))
)
register("tca_bars", f"WITH {S.dataset_steps(ALL)}, {S.auc_steps(ALL)}, st AS (SELECT series, feature, round(avg(auc), 9) AS agg_auc FROM sc GROUP BY series, feature) SELECT series, feature, round(agg_auc, 6) AS agg_auc, agg_auc <= 0.7 AS keep, CAST(row_number() OVER (PARTITION BY series ORDER BY agg_auc, feature) AS INTEGER) AS position, round(least(greatest(agg_auc, 0.5), 1.0), 6) AS colour FROM st")(
    lambda s, d: rounded(E.stability_bars(E.stability(E.pair_scores(_train(s, d), ALL))))
)

_SCALER = S.scaler_steps(ALL)
register("scaler_fit", f"WITH {S.dataset_steps(ALL)}, {_SCALER} SELECT feature, round(center, 6) + 0.0 AS center, round(scale, 6) + 0.0 AS scale FROM sf")(lambda s, d: rounded(E.fit_scaler(_train(s, d), ALL)))


@register("scaled_features", f"WITH {S.dataset_steps(ALL)}, {_SCALER} SELECT series, date, feature, round((value - center) / scale, 6) + 0.0 AS value FROM lg JOIN sf USING (feature)")
def scaled_features(s: SparkSession, d: str) -> DataFrame:
    table = clean(s, d)
    return rounded(E.long_form(E.apply_scaler(table, E.fit_scaler(table.where("split = 'train'"), ALL), ALL), ALL, KEYS))


def _scores(s: SparkSession, d: str) -> DataFrame:
    return E.metrics(E.predictors(*stand_in(s, d)))


_M = f"WITH {S.dataset_steps(ALL)}, {S.YP}, {S.LONG}, {S.METRICS}"
_FMT = lambda c: f"CASE WHEN {c} IS NULL THEN '+nan' ELSE printf('%+.4f', {c}) END AS {c}"
register("metrics_table", f"{_M} SELECT predictor, {S.pick(['mae', 'rmse', 'dir_acc', 'ic', 'r2'], 6)} FROM m")(lambda s, d: rounded(_scores(s, d)))
register("metrics_formatted", f"{_M} SELECT predictor, printf('%.6e', round(mae, 9)) AS mae, printf('%.6e', round(rmse, 9)) AS rmse, " + ", ".join(_FMT(f"(round({c}, 9))").replace(f"AS (round({c}, 9))", f"AS {c}") for c in ("dir_acc", "ic", "r2")) + " FROM m")(
    lambda s, d: E.formatted(rounded(_scores(s, d), 9))
)
_C = f"WITH {S.dataset_steps(ALL)}, {S.YP}, c AS (SELECT count(*) FILTER (WHERE y > 0 AND p > 0) AS tp, count(*) FILTER (WHERE y > 0 AND NOT p > 0) AS fn, count(*) FILTER (WHERE NOT y > 0 AND p > 0) AS fp, count(*) FILTER (WHERE NOT y > 0 AND NOT p > 0) AS tn FROM yp WHERE y <> 0)"
register("direction_confusion", f"{_C}, t AS (SELECT *, CAST(tp + fn + fp + tn AS DOUBLE) AS n FROM c) SELECT 'up' AS actual, tp AS pred_up, fn AS pred_down, round(tp / n, 6) AS share_up, round(fn / n, 6) AS share_down FROM t UNION ALL SELECT 'down', fp, tn, round(fp / n, 6), round(tn / n, 6) FROM t")(
    lambda s, d: rounded(E.confusion(stand_in(s, d)[0]))
)
_R = lambda a, b: f"round(CAST({a} AS DOUBLE) / nullif({b}, 0), 6)"
register(
    "confusion_metrics",
    f"{_C} SELECT tp + fn + fp + tn AS n, {_R('(tp + tn)', '(tp + fn + fp + tn)')} AS accuracy, {_R('tp', '(tp + fp)')} AS precision_up, {_R('tp', '(tp + fn)')} AS recall_up, {_R('tn', '(tn + fn)')} AS precision_down, {_R('tn', '(tn + fp)')} AS recall_down, "
    f"{_R('(tp + fp)', '(tp + fn + fp + tn)')} AS pred_up_rate, {_R('(tp + fn)', '(tp + fn + fp + tn)')} AS actual_up_rate, {_R('2 * tp', '(2 * tp + fp + fn)')} AS f1_up FROM c",
)(lambda s, d: rounded(E.confusion_metrics(stand_in(s, d)[0])))
register("running_hit_rate", f"WITH {S.dataset_steps(ALL)}, {S.YP} SELECT series, date, sign(p) = sign(y) AS hit, round(avg(CASE WHEN sign(p) = sign(y) THEN 1.0 ELSE 0.0 END) OVER ({S.W}), 6) AS rate FROM yp")(
    lambda s, d: rounded(E.running_hit_rate(stand_in(s, d)[0]))
)
register("compounded_path", f"WITH {S.dataset_steps(ALL)}, {S.YP} SELECT series, date, round(exp(sum(y) OVER ({S.W})), 6) AS actual, round(exp(sum(p) OVER ({S.W})), 6) AS predicted FROM yp")(
    lambda s, d: rounded(E.compounded(stand_in(s, d)[0]))
)
register("residual_hist", f"WITH {S.dataset_steps(ALL)}, {S.YP}, r AS (SELECT round(y - p, 9) AS r FROM yp), l AS (SELECT min(r) AS lo, max(r) AS hi FROM r), b AS (SELECT CAST(least(floor((r - lo) / ((hi - lo) / 60)), 59) AS BIGINT) AS bin, lo, hi FROM r, l) SELECT bin, round(any_value(lo) + bin * (any_value(hi) - any_value(lo)) / 60, 6) + 0.0 AS lower, count(*) AS n FROM b GROUP BY bin")(
    lambda s, d: rounded(E.histogram(stand_in(s, d)[0], F.round(F.col("y") - F.col("p"), 9)))
)
register("scatter_limits", f"WITH {S.dataset_steps(ALL)}, {S.YP} SELECT round(greatest(max(abs(y)), max(abs(p))), 6) AS axis_limit, round(stddev_pop(y - p), 6) AS residual_std, round(avg(CASE WHEN sign(p) = sign(y) THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM yp")(
    lambda s, d: rounded(E.scatter_limits(stand_in(s, d)[0]))
)
_D = f"WITH {S.dataset_steps(ALL)}, {S.drift_steps(ALL)}"
register("drift_ks", f"{_D} SELECT feature, round(ks, 6) AS ks FROM dr")(lambda s, d: rounded(E.drift(clean(s, d), ALL).select("feature", "ks")))
register("drift_wasserstein", f"{_D} SELECT feature, round(wasserstein, 6) AS wasserstein FROM dr")(lambda s, d: rounded(E.drift(clean(s, d), ALL).select("feature", "wasserstein")))
register("drift_share", f"{_D} SELECT count(*) AS n_features, count(*) FILTER (WHERE wasserstein >= 0.1) AS n_drifted, round(count(*) FILTER (WHERE wasserstein >= 0.1) / CAST(count(*) AS DOUBLE), 6) AS share, count(*) FILTER (WHERE wasserstein >= 0.1) / CAST(count(*) AS DOUBLE) >= 0.5 AS drifted FROM dr")(
    lambda s, d: rounded(E.drift_share(E.drift(clean(s, d), ALL)))
)

# -- reports of the first rows, and the same operators on a panel, series by series --------------------------------------

TOP = 20
register("tca_top", f"WITH {S.dataset_steps(ALL)}, {S.auc_steps(ALL)}, st AS (SELECT feature, round(avg(auc), 9) AS agg_auc FROM sc GROUP BY feature) SELECT feature, round(agg_auc, 6) AS agg_auc FROM st ORDER BY st.agg_auc, feature LIMIT {TOP}")(
    lambda s, d: rounded(E.top(E.stability(E.pair_scores(_train(s, d), ALL)).select("feature", "agg_auc"), TOP, F.col("agg_auc"), F.col("feature")))
)


def _panel_train(s: SparkSession, d: str) -> DataFrame:
    return clean(s, d, panel=True).where("split = 'train'")


_P = S.dataset_steps(ALL, S.PANEL)
register("tca_panel", f"WITH {_P}, {S.auc_steps(ALL)} SELECT series, feature, round(avg(auc), 6) AS agg_auc, round(avg(auc), 9) <= 0.7 AS keep FROM sc GROUP BY series, feature")(lambda s, d: rounded(E.stability(E.pair_scores(_panel_train(s, d), ALL))))
register("scaler_panel", f"WITH {_P}, {S.scaler_steps(ALL, 'series, feature')} SELECT series, feature, round(center, 6) + 0.0 AS center, round(scale, 6) + 0.0 AS scale FROM sf")(lambda s, d: rounded(E.fit_scaler(_panel_train(s, d), ALL, ["series"])))


@register("scaled_panel", f"WITH {_P}, {S.scaler_steps(ALL, 'series, feature')} SELECT series, date, feature, round((value - center) / scale, 6) + 0.0 AS value FROM lg JOIN sf USING (series, feature)")
def scaled_panel(s: SparkSession, d: str) -> DataFrame:
    table = clean(s, d, panel=True)
    return rounded(E.long_form(E.apply_scaler(table, E.fit_scaler(table.where("split = 'train'"), ALL, ["series"]), ALL), ALL, KEYS))


register("drift_panel", f"WITH {_P}, {S.drift_steps(ALL, 'series, feature')} SELECT series, feature, round(ks, 6) AS ks, round(wasserstein, 6) AS wasserstein FROM dr")(lambda s, d: rounded(E.drift(clean(s, d, panel=True), ALL, ["series"])))
register("metrics_panel", f"WITH {_P}, {S.YP_BY_SERIES}, {S.LONG_BY_SERIES}, {S.METRICS_BY_SERIES} SELECT series, predictor, {S.pick(['mae', 'rmse', 'dir_acc', 'ic', 'r2'], 6)} FROM m")(
    lambda s, d: rounded(E.metrics(E.predictors(*stand_in(s, d, panel=True)), ["series"]))
)
register("confusion_panel", f"WITH {_P}, {S.YP}, c AS (SELECT series, y > 0 AS up, count(*) FILTER (WHERE p > 0) AS pred_up, count(*) FILTER (WHERE NOT p > 0) AS pred_down FROM yp WHERE y <> 0 GROUP BY ALL) SELECT series, CASE WHEN up THEN 'up' ELSE 'down' END AS actual, pred_up, pred_down, round(pred_up / CAST(sum(pred_up + pred_down) OVER (PARTITION BY series) AS DOUBLE), 6) AS share_up, round(pred_down / CAST(sum(pred_up + pred_down) OVER (PARTITION BY series) AS DOUBLE), 6) AS share_down FROM c")(
    lambda s, d: rounded(E.confusion(stand_in(s, d, panel=True)[0], by=["series"]))
)
register("residual_hist_panel", f"WITH {_P}, {S.YP}, r AS (SELECT series, round(y - p, 9) AS r FROM yp), l AS (SELECT series, min(r) AS lo, max(r) AS hi FROM r GROUP BY series), b AS (SELECT series, CAST(least(floor((r - lo) / ((hi - lo) / 60)), 59) AS BIGINT) AS bin, lo, hi FROM r JOIN l USING (series)) SELECT series, bin, round(any_value(lo) + bin * (any_value(hi) - any_value(lo)) / 60, 6) + 0.0 AS lower, count(*) AS n FROM b GROUP BY series, bin")(
    lambda s, d: rounded(E.histogram(stand_in(s, d, panel=True)[0], F.round(F.col("y") - F.col("p"), 9), by=["series"]))
)
