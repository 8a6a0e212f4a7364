"""Splits, scaling, stability over calendar blocks, scores, drift and plot-ready tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.config import DEFAULT, KEYS, TARGET, Settings
from barwright.functions.ranks import bucketed, ranked
from barwright.functions.windows import ordered


def assign_split(table: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Adds `split` (train, val, test) by position in each series; never shuffled."""
    n = F.count(F.lit(1)).over(Window.partitionBy("series"))
    at = F.row_number().over(ordered()) - 1
    cut = lambda share: F.floor(F.lit(share) * n)
    return table.withColumn("split", F.when(at < cut(s.train_share), "train").when(at < cut(s.train_share + s.val_share), "val").otherwise("test"))


def describe_split(table: DataFrame) -> DataFrame:
    return table.groupBy("series", "split").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("n"))


def long_form(table: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return table.unpivot(list(keys), list(columns), "feature", "value")


def fit_scaler(train: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(*by, feature, center, scale): exact median and interquartile range; a range of zero counts as one.

    Quartiles are read off at their positions among sorted counts of values, so no task holds a feature's values."""
    keys = [*by, "feature"]
    counts = long_form(train, columns, ["series"]).where("value IS NOT NULL").groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    rows = ranked(bucketed(counts, keys), keys, ["n"])
    at = lambda share: (F.col("all_n") - 1) * share
    holds = lambda i: F.max(F.when((F.col("before_n") <= i) & (i < F.col("before_n") + F.col("n")), F.col("value")))
    parts = {name: (holds(F.floor(at(share))), holds(F.ceil(at(share))), F.max(at(share) - F.floor(at(share)))) for name, share in (("a", 0.25), ("center", 0.5), ("b", 0.75))}
    q = rows.groupBy(*keys).agg(*((low + (high - low) * rest).alias(name) for name, (low, high, rest) in parts.items()))
    width = F.col("b") - F.col("a")
    return q.select(*keys, "center", F.when(width == 0, 1.0).otherwise(width).alias("scale"))


def apply_scaler(table: DataFrame, scaler: DataFrame, columns: Sequence[str]) -> DataFrame:
    """table with the columns scaled. A scaler has one row a feature, so its values go into the plan as constants; one by series
    is joined, a row with all its features for each series."""
    if "series" not in scaler.columns:
        known = {r["feature"]: (r["center"], r["scale"]) for r in scaler.collect()}
        return table.withColumns({c: (F.col(c) - known[c][0]) / known[c][1] for c in columns})
    wide = scaler.groupBy("series").agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("center", "scale")))).alias("__scaler"))
    out = table.join(wide, "series", "left")
    return out.withColumns({c: (F.col(c) - F.col("__scaler")[c]["center"]) / F.col("__scaler")[c]["scale"] for c in columns}).select(*table.columns)


def calendar_blocks(table: DataFrame, months: int = DEFAULT.block_months) -> DataFrame:
    """Adds block_id: months since the series' first month, in groups of `months`."""
    month = F.year("date") * 12 + F.month("date") - 1
    return table.withColumn("block_id", F.floor((month - F.min(month).over(Window.partitionBy("series"))) / months).cast("long"))


def block_pairs(blocks: DataFrame) -> DataFrame:
    """(series, ba, bb) for block_id a < b of a series, by an equi-join on the series."""
    ids = blocks.select("series", "block_id").distinct()
    return ids.withColumnRenamed("block_id", "ba").join(ids.withColumnRenamed("block_id", "bb"), "series").where("ba < bb")


def pair_scores(table: DataFrame, columns: Sequence[str], months: int = DEFAULT.block_months) -> DataFrame:
    """(series, feature, ba, bb, auc): tie-aware AUC of the value for the later block, no less than a half.

    Values are counted by (feature, block) and dealt into buckets of sorted values; each goes to one bucket once, whatever the
    number of pairs. Inside a bucket running counts by block give, for all pairs at once, how often the later block's value
    is above the earlier one's (ties count half); across buckets the blocks' totals do.
    """
    keys = ["series", "feature"]
    counts = long_form(calendar_blocks(table, months), columns, ["series", "block_id"]).where("value IS NOT NULL").groupBy(*keys, "block_id", "value").agg(F.count(F.lit(1)).alias("n"))
    rows = bucketed(counts, keys)
    pairs = "series string, feature string, ba long, bb long, wins double, m0 long, m1 long"
    inside = rows.groupBy(*keys, "bucket").applyInPandas(_wins_inside, pairs)
    across = rows.groupBy(*keys, "bucket", "block_id").agg(F.sum("n").alias("n")).groupBy(*keys).applyInPandas(_wins_across, pairs)
    sums = inside.unionByName(across).groupBy(*keys, "ba", "bb").agg(F.sum("wins").alias("wins"), F.max("m0").alias("m0"), F.max("m1").alias("m1"))
    auc = F.col("wins") / (F.col("m0") * F.col("m1"))
    return sums.select(*keys, "ba", "bb", F.greatest(auc, 1 - auc).alias("auc"))


def _pairs(frame: pd.DataFrame, blocks: np.ndarray, wins: np.ndarray, sizes: np.ndarray) -> pd.DataFrame:
    a, b = np.triu_indices(len(blocks), 1)
    return pd.DataFrame({"series": frame["series"].iloc[0], "feature": frame["feature"].iloc[0], "ba": blocks[a], "bb": blocks[b], "wins": wins[a, b], "m0": sizes[a], "m1": sizes[b]})


def _wins_inside(frame: pd.DataFrame) -> pd.DataFrame:
    """wins[a, b]: the pairs of a value of block a and one of block b, both in this bucket, of which b's is larger; ties half."""
    blocks, block = np.unique(frame["block_id"].to_numpy(), return_inverse=True)
    values, value = np.unique(frame["value"].to_numpy(float), return_inverse=True)
    n = frame["n"].to_numpy(float)
    wins, before = np.zeros((len(blocks), len(blocks))), np.zeros(len(blocks))
    for first in range(0, len(values), 4096):  # a slab of values at a time
        own = np.zeros((min(4096, len(values) - first), len(blocks)))
        here = (value >= first) & (value < first + 4096)
        np.add.at(own, (value[here] - first, block[here]), n[here])
        running = before + np.cumsum(own, 0) - own / 2
        wins += running.T @ own
        before = before + own.sum(0)
    return _pairs(frame, blocks, wins, np.zeros(len(blocks), np.int64))


def _wins_across(frame: pd.DataFrame) -> pd.DataFrame:
    """The same for values of different buckets, from the blocks' totals by bucket (a row a bucket and block), and block sizes."""
    blocks, block = np.unique(frame["block_id"].to_numpy(), return_inverse=True)
    buckets, bucket = np.unique(frame["bucket"].to_numpy(), return_inverse=True)
    own = np.zeros((len(buckets), len(blocks)))
    own[bucket, block] = frame["n"].to_numpy(float)
    return _pairs(frame, blocks, (np.cumsum(own, 0) - own).T @ own, own.sum(0).astype(np.int64))


def stability(scores: DataFrame, agg: str = "mean", tau: float = DEFAULT.tau) -> DataFrame:
    """(series, feature, agg_auc, keep): mean or max over block pairs; keep at tau or below."""
    if agg not in ("mean", "max"):
        raise ValueError(f"agg is mean or max, not {agg!r}")
    value = F.avg("auc") if agg == "mean" else F.max("auc")
    return scores.groupBy("series", "feature").agg(F.round(value, 9).alias("agg_auc")).withColumn("keep", F.col("agg_auc") <= tau)


def temporal_consistency(train: DataFrame, columns: Sequence[str], agg: str = "mean", s: Settings = DEFAULT) -> tuple[list[str], DataFrame]:
    """Kept features (those that every series keeps), most stable first, and the table of scores; fewer than two blocks is an error."""
    if calendar_blocks(train, s.block_months).groupBy("series").agg(F.countDistinct("block_id").alias("b")).where("b < 2").limit(1).collect():
        raise ValueError("a series has fewer than two blocks")
    table = stability(pair_scores(train, columns, s.block_months), agg, s.tau)
    order = table.groupBy("feature").agg(F.min(F.col("keep").cast("int")).alias("k"), F.avg("agg_auc").alias("a")).where("k = 1").orderBy("a", "feature")
    return [r["feature"] for r in order.collect()], table


# -- scores -------------------------------------------------------------------------------------------------------------


def predictors(rows: DataFrame, train_mean: DataFrame) -> DataFrame:
    """(series, date, predictor, y, p): model, persistence (zero) and the training mean. rows: series, date, y, p. The mean is one
    row with one number, or one for each series."""
    both = rows.join(train_mean, "series") if "series" in train_mean.columns else rows.join(F.broadcast(train_mean))
    named = F.array(*(F.struct(F.lit(n).alias("predictor"), v.cast("double").alias("p")) for n, v in (("model", F.col("p")), ("persistence", F.lit(0.0)), ("historical_mean", F.col("mean")))))
    return both.select("series", "date", "y", F.explode(named).alias("x")).select("series", "date", "y", "x.predictor", "x.p")


def metrics(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, predictor, mae, rmse, dir_acc, ic, r2). dir_acc leaves out y = 0; ic of a constant predictor is NULL."""
    y, p = F.col("y"), F.col("p")
    d = y - p
    scale = F.nullif(F.stddev_pop(p) * F.stddev_pop(y), F.lit(0.0))
    return long.groupBy(*by, "predictor").agg(
        F.avg(F.abs(d)).alias("mae"),
        F.sqrt(F.avg(d * d)).alias("rmse"),
        F.avg(F.when(y != 0, (F.signum(p) == F.signum(y)).cast("double"))).alias("dir_acc"),
        F.when(F.min(p) < F.max(p), F.covar_pop(p, y) / scale).alias("ic"),
        (1 - F.sum(d * d) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))).alias("r2"),
    )


def formatted(table: DataFrame) -> DataFrame:
    """The metrics as text: errors in scientific form, the others signed with four decimals."""
    show = lambda form, c: F.coalesce(F.format_string(form, F.col(c)), F.lit("+nan")).alias(c)
    guard = lambda form, c: F.when(F.col(c).isNull(), F.lit("+nan")).otherwise(F.format_string(form, F.coalesce(c, F.lit(0.0)))).alias(c)
    return table.select("predictor", show("%.6e", "mae"), show("%.6e", "rmse"), *(guard("%+.4f", c) for c in ("dir_acc", "ic", "r2")))


def _cells(rows: DataFrame, exclude_zero: bool, by: Sequence[str]) -> DataFrame:
    rows = rows.where("y <> 0") if exclude_zero else rows
    up, called = F.col("y") > 0, F.col("p") > 0
    return rows.groupBy(*by).agg(F.count_if(up & called).alias("tp"), F.count_if(up & ~called).alias("fn"), F.count_if(~up & called).alias("fp"), F.count_if(~up & ~called).alias("tn"))


def confusion(rows: DataFrame, exclude_zero: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """(*by, actual, pred_up, pred_down, share_up, share_down): counts, and shares of all rows."""
    total = F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn")
    part = lambda n, a, b: F.struct(F.lit(n).alias("actual"), F.col(a).alias("pred_up"), F.col(b).alias("pred_down"), F.try_divide(F.col(a), total).alias("share_up"), F.try_divide(F.col(b), total).alias("share_down"))
    return _cells(rows, exclude_zero, by).select(*by, F.explode(F.array(part("up", "tp", "fn"), part("down", "fp", "tn"))).alias("x")).select(*by, "x.*")


def confusion_metrics(rows: DataFrame, exclude_zero: bool = True, by: Sequence[str] = ()) -> DataFrame:
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    n = tp + fn + fp + tn
    out = _cells(rows, exclude_zero, by).select(
        *by,
        n.alias("n"),
        F.try_divide(tp + tn, n).alias("accuracy"),
        F.try_divide(tp, tp + fp).alias("precision_up"),
        F.try_divide(tp, tp + fn).alias("recall_up"),
        F.try_divide(tn, tn + fn).alias("precision_down"),
        F.try_divide(tn, tn + fp).alias("recall_down"),
        F.try_divide(tp + fp, n).alias("pred_up_rate"),
        F.try_divide(tp + fn, n).alias("actual_up_rate"),
    )
    a, b = F.col("precision_up"), F.col("recall_up")
    return out.withColumn("f1_up", F.try_divide(2 * a * b, a + b))


# -- drift --------------------------------------------------------------------------------------------------------------


def drift(table: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(*by, feature, ks, wasserstein): two-sample distances of the test rows from the training rows of a split table.

    wasserstein is in units of the training rows' deviation. Steps of the distribution functions are per distinct value, and
    running counts go bucket by bucket, so no task holds a feature's values."""
    keys = [*by, "feature"]
    long = long_form(table.where("split IN ('train', 'test')"), columns, [*by, "split"]).where("value IS NOT NULL")
    counts = long.groupBy(*keys, "value").agg(F.count_if(F.col("split") == "train").alias("a"), F.count_if(F.col("split") == "test").alias("b"))
    rows = ranked(bucketed(counts, keys), keys, ["a", "b"])
    gap = F.abs((F.col("before_a") + F.col("a")) / F.col("all_a") - (F.col("before_b") + F.col("b")) / F.col("all_b"))
    distance = rows.groupBy(*keys).agg(F.max(gap).alias("ks"), F.sum(gap * (F.col("next") - F.col("value"))).alias("w"))
    spread = long.where("split = 'train'").groupBy(*keys).agg(F.stddev_samp("value").alias("sd"))
    return distance.join(spread, keys).select(*keys, "ks", (F.col("w") / F.nullif(F.col("sd"), F.lit(0.0))).alias("wasserstein"))


def drift_share(distances: DataFrame, limit: float = 0.1) -> DataFrame:
    """Number of features, of drifted ones (wasserstein at `limit` or above), their share, and whether half have drifted."""
    bad = F.col("wasserstein") >= limit
    out = distances.agg(F.count(F.lit(1)).alias("n_features"), F.count_if(bad).alias("n_drifted"))
    return out.withColumn("share", F.col("n_drifted") / F.col("n_features")).withColumn("drifted", F.col("share") >= 0.5)


# -- plot-ready tables --------------------------------------------------------------------------------------------------


def running_hit_rate(rows: DataFrame) -> DataFrame:
    """(series, date, hit, rate): sign agreement and its mean so far; rows with y = 0 stay."""
    hit = F.signum("p") == F.signum("y")
    return rows.select("series", "date", hit.alias("hit"), F.avg(hit.cast("double")).over(ordered().rowsBetween(Window.unboundedPreceding, 0)).alias("rate"))


def compounded(rows: DataFrame) -> DataFrame:
    """(series, date, actual, predicted): growth of one unit along actual and predicted log returns."""
    w = ordered().rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("series", "date", F.exp(F.sum("y").over(w)).alias("actual"), F.exp(F.sum("p").over(w)).alias("predicted"))


def histogram(rows: DataFrame, value: Column, bins: int = 60, by: Sequence[str] = ()) -> DataFrame:
    """(*by, bin, lower, n) of equal bins over the range; the largest value is in the last bin."""
    x = rows.select(*by, value.alias("r"))
    edge = x.groupBy(*by).agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("r") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1))).otherwise(0)
    both = x.join(edge, list(by)) if by else x.join(F.broadcast(edge))  # without `by` one row
    placed = both.select(*by, at.cast("long").alias("bin"), "lo", "hi")
    return placed.groupBy(*by, "bin").agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.count(F.lit(1)).alias("n")).select(*by, "bin", (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("lower"), "n")


def scatter_limits(rows: DataFrame) -> DataFrame:
    """One row: the limit of a symmetric plot of y against p, the residuals' deviation, and the overall hit rate."""
    hit = (F.signum("p") == F.signum("y")).cast("double")
    return rows.agg(F.greatest(F.max(F.abs("y")), F.max(F.abs("p"))).alias("axis_limit"), F.stddev_pop(F.col("y") - F.col("p")).alias("residual_std"), F.avg(hit).alias("hit_rate"))


def stability_bars(table: DataFrame) -> DataFrame:
    """Stability scores for a bar chart: position by score, and the score clipped to the colour range."""
    at = F.row_number().over(Window.partitionBy("series").orderBy("agg_auc", "feature"))
    return table.select("series", "feature", "agg_auc", "keep", at.alias("position"), F.least(F.greatest("agg_auc", F.lit(0.5)), F.lit(1.0)).alias("colour"))


def top(table: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of a report in the given order, a sort of n rows a task at most."""
    return table.orderBy(*order).limit(n)


def with_y_p(table: DataFrame, p: Column) -> DataFrame:
    return table.select(*KEYS, F.col(TARGET).alias("y"), p.alias("p"))
