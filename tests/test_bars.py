import datetime as dt
import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwright import registry
from barwright.config import DEFAULT, TARGET, Settings
from barwright.functions import ranks
from barwright.functions.windows import recursive_averages
from barwright.operators import boosting, evaluation, features
from barwright.plans import pipeline
from barwright.sources.bars import cached_table, normalise, write_report, write_table
from barwright.sources.models import load_model, load_parameters, save_model, save_parameters

SF = "/root/testdata/sf0.001"


def frame(spark, closes, volumes=None, series="A"):
    rows = [(series, dt.date(2020, 1, 1) + dt.timedelta(days=i), c, c, c, c, 1.0 if volumes is None else volumes[i]) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "series string, date date, open double, high double, low double, close double, volume double")


def walk(n=200, seed=0):
    return (100 * np.exp(np.cumsum(np.random.default_rng(seed).normal(0, 0.01, n)))).tolist()


def test_averages_agree_with_pandas_over_several_pieces(spark):
    x = walk()
    got = features.add_features(frame(spark, x)).orderBy("date").toPandas()
    for n in (5, 20, 60):
        want = pd.Series(x).ewm(span=n, adjust=False, min_periods=n).mean()
        assert np.allclose(got[f"ema_{n}"].astype(float), want, equal_nan=True, rtol=1e-12)
        assert np.allclose(got[f"ma_{n}"].astype(float), pd.Series(x).rolling(n).mean(), equal_nan=True)
    assert np.allclose(got["bb_high"].astype(float), pd.Series(x).rolling(21).mean() + 2 * pd.Series(x).rolling(21).std(), equal_nan=True)


GAPS = {"some": (1500, 0.3, ()), "long": (2500, 0.1, ((500, 1500), (1600, 1650), (2000, 2300))), "sparse": (2000, 0.97, ()), "leading": (400, 0.1, ((0, 100),))}


@pytest.mark.parametrize("skip", [False, True])
@pytest.mark.parametrize("kind", GAPS)
def test_averages_over_gaps_agree_with_pandas(spark, kind, skip):
    n, missing, gaps = GAPS[kind]
    rng = np.random.default_rng(4)
    x = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    x[rng.random(n) < missing] = np.nan
    for a, b in gaps:
        x[a:b] = np.nan
    rows = [("A", dt.date(2000, 1, 1) + dt.timedelta(days=i), None if math.isnan(v) else float(v)) for i, v in enumerate(x)]
    got = recursive_averages(spark.createDataFrame(rows, "series string, date date, close double"), "close", (1, 3, 12, 60), skip_gaps=skip).orderBy("date").toPandas()
    for span in (1, 3, 12, 60):
        want = pd.Series(x).ewm(span=span, adjust=False, min_periods=span, ignore_na=skip).mean()
        assert np.allclose(got[f"ema_{span}"].astype(float), want, rtol=1e-11, equal_nan=True), span


def test_an_average_weighs_by_position(spark):
    rows = [("A", dt.date(2020, 1, i + 1), x) for i, x in enumerate([1.0, 2.0, None, 4.0])]
    bars = spark.createDataFrame(rows, "series string, date date, close double")
    last = lambda **k: recursive_averages(bars, "close", (3,), **k).orderBy("date").collect()[-1]["ema_3"]
    assert math.isclose(last(), 3.1666666666666665) and math.isclose(last(skip_gaps=True), 2.75)


def test_rows_do_not_change_when_later_ones_go(spark):
    x = walk(120)
    whole = features.prefix(features.add_features(frame(spark, x)), 90).orderBy("date").toPandas()
    part = features.add_features(features.prefix(frame(spark, x), 90)).orderBy("date").toPandas()
    assert len(part) == 90
    for c in features.feature_names():
        assert np.allclose(whole[c].astype(float), part[c].astype(float), equal_nan=True, rtol=1e-9, atol=1e-9), c


def test_two_series_do_not_mix(spark):
    a, b = frame(spark, walk(80)), frame(spark, walk(80, 1), series="B")
    both = features.add_features(a.unionByName(b)).where("series = 'B'").orderBy("date").toPandas()
    assert both.drop(columns="series").equals(features.add_features(b).orderBy("date").toPandas().drop(columns="series"))


def test_flat_and_rising_edges(spark):
    flat = features.add_features(frame(spark, [5.0] * 30)).orderBy("date").toPandas()
    assert flat.rsi.iloc[-1] == 0 and pd.isna(flat.williams_r.iloc[-1]) and pd.isna(flat.rsi.iloc[13]) and not pd.isna(flat.rsi.iloc[14])
    rising = features.add_features(frame(spark, [float(i + 1) for i in range(30)])).orderBy("date").toPandas()
    assert rising.rsi.iloc[-1] == 100
    zero = features.add_features(frame(spark, [1.0, 0.0, 2.0])).orderBy("date").toPandas()
    assert zero.daily_return.isna().all()


def test_dataset_leaves_out_the_warm_up_and_the_last_bar(spark):
    x = walk(100)
    got = features.dataset(frame(spark, x)).orderBy("date").toPandas()
    assert len(got) == 100 - 60 and math.isclose(got[TARGET].iloc[-1], math.log(x[99] / x[98]))
    assert features.dataset(frame(spark, x[:60])).count() == 0
    assert features.dataset_counts(frame(spark, x)).first().asDict() == {"series": "A", "n_before": 100, "n_after": 40, "n_dropped": 60}


def test_volume_gate_is_strict(spark):
    for zeros, usable in ((5, False), (4, True)):
        rows = features.volume_gate(frame(spark, [1.0] * 100, [0.0] * zeros + [1.0] * (100 - zeros))).collect()
        assert rows[0]["usable"] is usable
    assert features.volume_gate(frame(spark, [1.0]).drop("volume")).first()["usable"] is False


def test_stability_keeps_noise_and_drops_trend(spark):
    rng = np.random.default_rng(0)
    days = pd.bdate_range("2010-01-01", periods=600)
    table = spark.createDataFrame(pd.DataFrame({"series": "A", "date": days.date, "noise": rng.normal(size=600), "trend": np.linspace(0, 50, 600), "flat": 1.0}))
    kept, scores = evaluation.temporal_consistency(table, ["noise", "trend", "flat"])
    by = {r["feature"]: r["agg_auc"] for r in scores.collect()}
    assert kept == ["flat", "noise"] and by["flat"] == 0.5 and by["noise"] < 0.7 < by["trend"]
    with pytest.raises(ValueError):
        evaluation.temporal_consistency(table.where("date < '2010-02-01'"), ["noise"])
    with pytest.raises(ValueError):
        evaluation.stability(scores, "median")


def test_scores_of_constants(spark):
    rows = spark.createDataFrame([("A", dt.date(2020, 1, i + 1), y, 0.1) for i, y in enumerate([0.0, 0.2, -0.1])], "series string, date date, y double, p double")
    got = {r["predictor"]: r for r in evaluation.metrics(evaluation.predictors(rows, spark.createDataFrame([(0.05,)], "mean double"))).collect()}
    assert got["model"]["ic"] is None and got["model"]["dir_acc"] == 0.5 and got["persistence"]["dir_acc"] == 0.0
    assert evaluation.formatted(evaluation.metrics(rows.withColumn("predictor", F.lit("m")))).first()["ic"] == "+nan"


def test_parameter_draw_sixteen():
    row = boosting.draw_parameters(17)[16]
    # The published winning draw.
    want = {"num_leaves": 78, "learning_rate": 0.04282187151170881, "max_depth": 10, "min_child_samples": 97, "feature_fraction": 0.6361207809225795, "bagging_fraction": 0.5481954810767496, "lambda_l1": 3.2584569136159827, "lambda_l2": 0.019005594069851025}
    assert all(math.isclose(row[k], v, rel_tol=1e-12) for k, v in want.items())


def test_attribution_adds_up(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(150, 3))
    data = pd.DataFrame(x, columns=["a", "b", "c"]).assign(series="A", date=pd.bdate_range("2020-01-01", periods=150).date)
    data[TARGET] = 0.01 * x[:, 0] + 0.005 * rng.normal(size=150)
    table = evaluation.assign_split(spark.createDataFrame(data))
    model = boosting.fit(table, ["a", "b", "c"], {"max_depth": 3, "learning_rate": 0.2}, 4)
    test = table.where("split = 'test'")
    sums = boosting.attribution(test, model).groupBy("date").agg((F.sum("phi") + F.first("base")).alias("s"))
    both = boosting.predict(test, model).join(sums, "date").select("prediction", "s").toPandas()
    assert len(both) and np.allclose(both.prediction, both.s)


def test_registered_searches_are_whole(spark, monkeypatch):
    asked = []

    def fit_many(table, columns, many, trees, *_):
        asked.extend([trees] * len(many))
        return [boosting.Boosted(list(columns), [], [], 0.0, 1.0, parameters, 1, 1.0) for parameters in many]

    monkeypatch.setattr(boosting, "fit_many", fit_many)
    for name, fits in (("random_search_trials", 40), ("model_predictions", 1), ("pipeline_report", 40)):
        asked.clear()
        registry.queries()[name](spark, SF)
        assert asked == [2000] * fits, name


def gain(g, n, p):
    return max(abs(g) - p["lambda_l1"], 0.0) ** 2 / (n + p["lambda_l2"])


def test_best_split_equals_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(40):
        x, residual = rng.integers(0, 6, (50, 3)).astype(float), rng.normal(size=50)
        p = boosting.UNSET | {"lambda_l1": float(rng.uniform(0, 3)), "lambda_l2": float(rng.uniform(0.01, 3)), "min_child_samples": int(rng.integers(1, 12))}
        grad = -np.sign(residual)
        want = 0.0
        for c in range(3):
            for cut in np.unique(x[:, c])[:-1]:
                left = x[:, c] <= cut
                if min(left.sum(), (~left).sum()) >= p["min_child_samples"]:
                    want = max(want, gain(grad[left].sum(), left.sum(), p) + gain(grad[~left].sum(), (~left).sum(), p) - gain(grad.sum(), 50, p))
        edges = boosting.bin_edges(x)
        tree = boosting.grow_tree(boosting.binned(x, edges), edges, residual, np.arange(50), np.arange(3), p | {"num_leaves": 2})
        if want <= 0:
            assert len(tree["left"]) == 1
            continue
        left = x[:, tree["feature"][0]] <= tree["threshold"][0]
        got = gain(grad[left].sum(), left.sum(), p) + gain(grad[~left].sum(), (~left).sum(), p) - gain(grad.sum(), 50, p)
        assert math.isclose(got, want, rel_tol=1e-9)
        assert math.isclose(tree["value"][tree["left"][0]], np.median(residual[left])) and math.isclose(tree["value"][tree["right"][0]], np.median(residual[~left]))


def test_trees_keep_to_their_limits():
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(600, 5)), rng.normal(size=600)
    edges = boosting.bin_edges(x, 40)
    codes = boosting.binned(x, edges)
    for leaves, depth, least in ((7, -1, 5), (64, 3, 20), (64, -1, 90)):
        tree = boosting.grow_tree(codes, edges, y, np.arange(600), np.arange(5), boosting.UNSET | {"num_leaves": leaves, "max_depth": depth, "min_child_samples": least})
        ends = tree["left"] < 0
        assert ends.sum() <= leaves and tree["cover"][ends].min() >= least and tree["cover"][ends].sum() == 600
        at, deep = {0: 0}, 0
        for n in range(len(ends)):
            if not ends[n]:
                at[tree["left"][n]] = at[tree["right"][n]] = at[n] + 1
                deep = max(deep, at[n] + 1)
        assert depth < 0 or deep <= depth


def test_attribution_equals_all_coalitions():
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(200, 4)), rng.normal(size=200)
    edges = boosting.bin_edges(x)
    tree = boosting.grow_tree(boosting.binned(x, edges), edges, y, np.arange(200), np.arange(4), boosting.UNSET | {"num_leaves": 12, "min_child_samples": 5})

    def value(row, known, node=0):
        if tree["left"][node] < 0:
            return tree["value"][node]
        left, right = tree["left"][node], tree["right"][node]
        if tree["feature"][node] in known:
            return value(row, known, left if row[tree["feature"][node]] <= tree["threshold"][node] else right)
        return sum(tree["cover"][c] / tree["cover"][node] * value(row, known, c) for c in (left, right))

    phi, base = boosting.tree_shares(tree, x[:5], 4)
    for i in range(5):
        for f in range(4):
            want = 0.0
            for m in range(16):
                known = {g for g in range(4) if m >> g & 1}
                if f not in known:
                    k = len(known)
                    want += math.factorial(k) * math.factorial(3 - k) / 24 * (value(x[i], known | {f}) - value(x[i], known))
            assert math.isclose(phi[i, f], want, abs_tol=1e-12)
        assert math.isclose(base + phi[i].sum(), value(x[i], {0, 1, 2, 3}), abs_tol=1e-12)


def test_models_and_parameters_come_back(spark, tmp_path):
    rng = np.random.default_rng(8)
    data = pd.DataFrame(rng.normal(size=(200, 2)), columns=["a", "b"]).assign(series="A", date=pd.date_range("2020-01-01", periods=200, freq="h"))
    data[TARGET] = 0.01 * data.a
    table = evaluation.assign_split(spark.createDataFrame(data))
    model = boosting.fit(table, ["a", "b"], {"max_depth": 3, "learning_rate": 0.2, "lambda_l1": 0.5}, 8)
    save_model(spark, model, f"{tmp_path}/model")
    save_parameters(spark, model, f"{tmp_path}/parameters")
    again, x = load_model(spark, f"{tmp_path}/model"), data[["a", "b"]].to_numpy()
    assert np.array_equal(again.predict(x), model.predict(x)) and again.parameters == model.parameters
    assert load_parameters(spark, f"{tmp_path}/parameters") == {"max_depth": 3, "learning_rate": 0.2, "lambda_l1": 0.5, "best_iteration": model.best_iteration}
    phis = boosting.attribution(table.where("split = 'test'"), again)  # bars by the hour
    assert phis.schema["date"].dataType.simpleString() == "timestamp" and phis.count() == 2 * table.where("split = 'test'").count()
    top = evaluation.top(boosting.importance(phis), 1, F.desc("mean_abs"), F.col("feature")).collect()
    assert [r["feature"] for r in top] == ["a"]


def test_large_tables_go_to_distributed_trees(spark, monkeypatch):
    rng = np.random.default_rng(9)
    data = pd.DataFrame(rng.normal(size=(200, 2)), columns=["a", "b"]).assign(series="A", date=pd.bdate_range("2020-01-01", periods=200).date)
    data[TARGET] = 0.01 * data.a
    table = evaluation.assign_split(spark.createDataFrame(data))
    monkeypatch.setattr(boosting, "FIT_VALUES", 100)
    model = boosting.fit(table, ["a", "b"], {"max_depth": 2, "learning_rate": 0.3}, 5)
    assert model.spread != 1.0 and np.corrcoef(model.predict(data[["a", "b"]].to_numpy()), data[TARGET])[0, 1] > 0.8


def test_many_buckets_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(10)
    n = 1500
    data = pd.DataFrame({"series": rng.choice(["A", "B"], n), "date": pd.bdate_range("2015-01-01", periods=n).date, "x": rng.normal(size=n).round(1), "y": np.exp(rng.normal(size=n)), "z": 1.0})
    table = evaluation.assign_split(spark.createDataFrame(data)).persist()
    columns = ["x", "y", "z"]
    run = lambda: [sorted(map(tuple, f.collect())) for f in (evaluation.fit_scaler(table, columns), evaluation.fit_scaler(table, columns, ["series"]), evaluation.drift(table, columns, ["series"]), evaluation.pair_scores(table, columns))]
    whole = run()
    monkeypatch.setattr(evaluation, "bucketed", lambda counts, keys: ranks.bucketed(counts, keys, 10))
    for a, b in zip(whole, run()):
        assert len(a) == len(b) and all(x == y or all(u == v or abs(u - v) < 1e-12 for u, v in zip(x, y)) for x, y in zip(a, b))
    assert ranks.bucketed(table.select("series", F.col("y").alias("value")), ["series"], 10).agg(F.countDistinct("series", "bucket")).first()[0] > 50
    for feature, center, scale in whole[0]:
        q = np.quantile(data[feature], [0.25, 0.5, 0.75])
        assert math.isclose(center, q[1]) and math.isclose(scale, (q[2] - q[0]) or 1.0)
    table.unpersist()


def test_readers_and_writers(spark, tmp_path):
    bars, made = frame(spark, [1.0, 2.0, 3.0]), []
    make = lambda: made.append(1) or bars
    for _ in range(2):
        assert cached_table(spark, f"{tmp_path}/bars", make).count() == 3
    assert made == [1]
    write_table(bars.limit(1), f"{tmp_path}/bars")
    assert spark.read.parquet(f"{tmp_path}/bars").count() == 1
    write_report(bars.select("close"), f"{tmp_path}/report")
    assert sorted(r["close"] for r in spark.read.option("header", True).csv(f"{tmp_path}/report").collect()) == ["1.0", "2.0", "3.0"]


def test_an_empty_choice_keeps_all_columns(spark):
    small = Settings(ma_windows=(5,), short_windows=(5,), band_window=5, momentum_window=2, draws=2, trees=3)
    bars = frame(spark, walk(400), [0.0] * 400)
    report = pipeline.run(bars, s=Settings(**{**small.__dict__, "tau": 0.0}))
    assert not report.volume_ok and report.kept == report.columns and not any(c.startswith("delta_v") for c in report.columns)
    assert report.metrics.count() == 3 and DEFAULT.tau == 0.7


def test_patience_ends_the_growth(spark):
    assert boosting.best_prefix([3, 2, 2, 2, 1], 2) == (1, True, 2) and boosting.best_prefix([3, 2, 2, 2, 1], 3) == (4, False, 1)
    rng = np.random.default_rng(2)
    data = pd.DataFrame(rng.normal(size=(150, 2)), columns=["a", "b"]).assign(series="A", date=pd.bdate_range("2020-01-01", periods=150).date)
    data[TARGET] = 0.01 * data.a + 0.01 * data.b
    table = evaluation.assign_split(spark.createDataFrame(data)).cache()
    own = {"max_depth": 2, "learning_rate": 0.1, "bagging_fraction": 0.9}
    whole, grown = boosting.fit(table, ["a", "b"], own, 12, 50), boosting.fit(table, ["a", "b"], own, 12, 2)
    # more trees than the first growth of 4, and those of a single fit
    n = grown.best_iteration
    assert n > 4 and grown.weights == whole.weights[:n]
    assert all(np.array_equal(x[k], y[k]) for x, y in zip(grown.trees, whole.trees) for k in x)


def test_ingest_turns_nan_into_null(spark):
    got = normalise(spark.createDataFrame([("2020-01-01", float("nan"))], "Date string, Close double"), "Date")
    assert got.columns == ["series", "date", "close"] and got.first()["close"] is None
    with pytest.raises(ValueError):
        normalise(got.limit(0), "date")


@pytest.mark.parametrize("name", ["bars_daily", "feat_all", "target_next", "drift_ks", "confusion_metrics", "align_outer", "align_complete", "dataset_counts", "feat_first_bars", "tca_top", "metrics_panel", "drift_panel"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = registry.queries()[name](spark, SF)
    result = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    want = sorted([tuple(r) for r in result.fetchall()], key=repr)
    assert sorted(names) == sorted(got.columns)
    assert sorted([tuple(r[c] for c in names) for r in got.collect()], key=repr) == want
