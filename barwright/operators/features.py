"""The 36 trailing indicators and the strictly future target."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.config import DEFAULT, KEYS, TARGET, Settings
from barwright.functions.windows import ordered, floor_at_zero, full, last_rows, log_ratio, over_zero, recursive_averages


def _lag(c: str, k: int = 1) -> Column:
    return F.lag(c, k).over(ordered())


def feature_names(volume: bool = True, s: Settings = DEFAULT) -> list[str]:
    names = ["amplitude", "difference", "h_minus_l", "c_minus_o", "delta_c", "daily_return", "momentum", "sign_delta_open"]
    for n in s.short_windows:
        names += [f"intraday_ma_{n}", f"delta_c_ma_{n}"]
    for n in s.ma_windows:
        names += [f"ma_{n}", f"ema_{n}"]
    names += ["macd", "rsi", "williams_r", "bb_high", "bb_low", *(f"ret_lag_{k}" for k in s.return_lags)]
    return names + (["delta_v", *(f"delta_v_ma_{n}" for n in s.short_windows)] if volume else [])


def add_features(bars: DataFrame, volume: bool = True, s: Settings = DEFAULT) -> DataFrame:
    """bars with all indicators. Layered windows share one partitioning and order, so they shuffle and sort once."""
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    fast, slow = s.macd_spans
    spans = sorted({*s.ma_windows, fast, slow})
    df = recursive_averages(bars, "close", spans, "__ema_{}".format)
    df = df.withColumns({"__prev": _lag("close"), "h_minus_l": h - low, "c_minus_o": c - o})
    df = df.withColumns(
        {
            "amplitude": over_zero(h - low, F.col("__prev")),
            "difference": over_zero(c - o, F.col("__prev")),
            "delta_c": c - F.col("__prev"),
            "daily_return": log_ratio(c, F.col("__prev")),
            "momentum": c - _lag("close", s.momentum_window),
            "sign_delta_open": F.signum(o - _lag("open")),
        }
    )
    d = F.col("delta_c")
    more = {}
    for n in s.short_windows:
        more[f"intraday_ma_{n}"] = full(F.col("c_minus_o"), n, F.avg)
        more[f"delta_c_ma_{n}"] = full(d, n, F.avg)
    for n in s.ma_windows:
        more[f"ma_{n}"] = full(c, n, F.avg)
        more[f"ema_{n}"] = F.col(f"__ema_{n}")
    gain, loss = full(floor_at_zero(d), s.rsi_window, F.avg), full(floor_at_zero(-d), s.rsi_window, F.avg)
    top, bottom = full(h, s.williams_window, F.max), full(low, s.williams_window, F.min)
    mid, spread = full(c, s.band_window, F.avg), full(c, s.band_window, F.stddev_samp)
    df = df.withColumns(more | {"__gain": gain, "__loss": loss, "__top": top, "__bottom": bottom, "__mid": mid, "__spread": spread})
    g, b = F.col("__gain"), F.col("__loss")
    df = df.withColumns(
        {
            "macd": F.col(f"__ema_{fast}") - F.col(f"__ema_{slow}"),
            "rsi": F.when(g == 0, 0.0).when(b == 0, 100.0).otherwise(100 - 100 / (1 + over_zero(g, b))),
            "williams_r": over_zero(F.col("__top") - c, F.col("__top") - F.col("__bottom")) * -100,
            "bb_high": F.col("__mid") + s.band_width * F.col("__spread"),
            "bb_low": F.col("__mid") - s.band_width * F.col("__spread"),
            **{f"ret_lag_{k}": F.lag("daily_return", k).over(ordered()) if k else F.col("daily_return") for k in s.return_lags},
        }
    )
    if volume:
        df = df.withColumn("delta_v", F.col("volume") - _lag("volume"))
        df = df.withColumns({f"delta_v_ma_{n}": full(F.col("delta_v"), n, F.avg) for n in s.short_windows})
    return df.select(*bars.columns, *feature_names(volume, s))


def add_target(bars: DataFrame) -> DataFrame:
    """The log return from this bar to the next; NULL on the last."""
    return bars.withColumn(TARGET, log_ratio(F.lead("close").over(ordered()), F.col("close")))


def prefix(bars: DataFrame, n: int) -> DataFrame:
    """The first n bars of each series."""
    return bars.withColumn("__at", F.row_number().over(ordered())).where(F.col("__at") <= n).drop("__at")


def volume_gate(bars: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Per series: share of bars with zero or missing volume, and whether the volume columns can be used."""
    if "volume" not in bars.columns:
        return bars.select("series").distinct().select("series", F.lit(1.0).alias("degenerate"), F.lit(False).alias("usable"))
    bad = F.when(F.col("volume").isNull() | F.isnan("volume") | (F.col("volume") == 0), 1.0).otherwise(0.0)
    return bars.groupBy("series").agg(F.avg(bad).alias("degenerate")).withColumn("usable", F.col("degenerate") < s.volume_gate)


def volume_usable(bars: DataFrame, s: Settings = DEFAULT) -> bool:
    """The gate for the whole table: volume columns are kept only if every series passes."""
    return not volume_gate(bars, s).where(~F.col("usable")).limit(1).collect()


def dataset(bars: DataFrame, volume: bool = True, s: Settings = DEFAULT) -> DataFrame:
    """Keys, indicators and target, rows with a missing value left out."""
    full_table = add_target(add_features(bars, volume, s)).select(*KEYS, *feature_names(volume, s), TARGET)
    return full_table.na.drop("any")


def dataset_counts(bars: DataFrame, volume: bool = True, s: Settings = DEFAULT) -> DataFrame:
    """Per series: rows before and after those with a missing value are left out, and the rows left out."""
    columns = [*feature_names(volume, s), TARGET]
    whole = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))
    table = add_target(add_features(bars, volume, s)).groupBy("series").agg(F.count(F.lit(1)).alias("n_before"), F.count_if(whole).alias("n_after"))
    return table.withColumn("n_dropped", F.col("n_before") - F.col("n_after"))


def keep_bars(bars: DataFrame, keys: DataFrame) -> DataFrame:
    """The bars whose keys are in `keys`."""
    return bars.join(keys.select(*KEYS).distinct(), list(KEYS), "left_semi")


def reindex(values: DataFrame, keys: DataFrame) -> DataFrame:
    """values on another set of keys; missing ones are NULL."""
    return keys.select(*KEYS).join(values, list(KEYS), "left")


def align(frames: Sequence[DataFrame], complete: bool = False) -> DataFrame:
    """Frames side by side on their keys, missing ones NULL; with `complete` only rows without a missing value."""
    out = frames[0]
    for other in frames[1:]:
        out = out.join(other, list(KEYS), "inner" if complete else "full")
    return out.na.drop("any") if complete else out


def trailing(bars: DataFrame, column: str, n: int, agg) -> DataFrame:
    """Any other trailing aggregate over n full rows, as a column named after it."""
    return bars.withColumn(f"{column}_{agg.__name__}_{n}", F.when(F.count(column).over(last_rows(n)) == n, agg(F.col(column)).over(last_rows(n))))
