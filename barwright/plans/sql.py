"""The same results as SQL text, written independently of the DataFrame code, for the registered queries."""

from __future__ import annotations

DAILY = """bars AS (
  SELECT 'ALL' AS series, CAST(o_orderdate AS DATE) AS date, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
    min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM orders GROUP BY CAST(o_orderdate AS DATE))"""
PANEL = """bars AS (
  SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS date, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
    min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM orders GROUP BY o_orderpriority, CAST(o_orderdate AS DATE))"""
HOURLY = """bars AS (
  SELECT event_type AS series, date_trunc('hour', ts) AS date, arg_min(value, ts) AS open, max(value) AS high,
    min(value) AS low, arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events GROUP BY event_type, date_trunc('hour', ts))"""

W = "PARTITION BY series ORDER BY date"


def rows(n: int) -> str:
    return f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(x: str, n: int, agg: str) -> str:
    return f"CASE WHEN count({x}) {rows(n)} = {n} THEN {agg}({x}) {rows(n)} END"


def ema(span: int) -> str:
    a = f"(2.0::DOUBLE / {span + 1})"
    fold = f"list_reduce(list(close) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda y, x: y * (1 - {a}) + x * {a})"
    return f"CASE WHEN row_number() OVER ({W}) >= {span} THEN {fold} END"


EMAS = "e AS (SELECT series, date, " + ", ".join(f"{ema(s)} AS x{s}" for s in (5, 10, 12, 20, 26, 60)) + " FROM bars)"


def feature_steps() -> str:
    """CTEs b1 .. f: all 36 indicators and the target, from `bars`."""
    one = f"""b1 AS (SELECT *, lag(close) OVER ({W}) AS prev, high - low AS h_minus_l, close - open AS c_minus_o, lag(open) OVER ({W}) AS prev_open,
  lag(close, 10) OVER ({W}) AS c10, lag(volume) OVER ({W}) AS prev_v, lead(close) OVER ({W}) AS next FROM bars)"""
    two = """b2 AS (SELECT *, h_minus_l / nullif(prev, 0) AS amplitude, c_minus_o / nullif(prev, 0) AS difference, close - prev AS delta_c,
  CASE WHEN close / nullif(prev, 0) > 0 THEN ln(close / nullif(prev, 0)) END AS daily_return, close - c10 AS momentum,
  CAST(sign(open - prev_open) AS DOUBLE) AS sign_delta_open, volume - prev_v AS delta_v,
  CASE WHEN next / nullif(close, 0) > 0 THEN ln(next / nullif(close, 0)) END AS target_next_log_return FROM b1)"""
    parts = [f"{full('c_minus_o', n, 'avg')} AS intraday_ma_{n}, {full('delta_c', n, 'avg')} AS delta_c_ma_{n}, {full('delta_v', n, 'avg')} AS delta_v_ma_{n}" for n in (5, 10, 20)]
    parts += [f"{full('close', n, 'avg')} AS ma_{n}" for n in (5, 10, 20, 60)]
    parts += [f"lag(daily_return, {k}) OVER ({W}) AS ret_lag_{k}" for k in (1, 2, 3, 5)] + ["daily_return AS ret_lag_0"]
    gain, loss = "CASE WHEN delta_c IS NOT NULL THEN greatest(delta_c, 0.0) END", "CASE WHEN delta_c IS NOT NULL THEN greatest(-delta_c, 0.0) END"
    parts += [f"{full(gain, 14, 'avg')} AS ag, {full(loss, 14, 'avg')} AS al, {full('high', 14, 'max')} AS hh, {full('low', 14, 'min')} AS ll"]
    parts += [f"{full('close', 21, 'avg')} AS mid, {full('close', 21, 'stddev_samp')} AS sd"]
    three = "b3 AS (SELECT *, " + ", ".join(parts) + " FROM b2)"
    four = f"""{EMAS}, f AS (SELECT b3.*, x5 AS ema_5, x10 AS ema_10, x20 AS ema_20, x60 AS ema_60, x12 - x26 AS macd,
  CASE WHEN ag IS NULL OR al IS NULL THEN NULL WHEN ag = 0 THEN 0.0 WHEN al = 0 THEN 100.0 ELSE 100 - 100 / (1 + ag / al) END AS rsi,
  (hh - close) / nullif(hh - ll, 0) * -100 AS williams_r, mid + 2 * sd AS bb_high, mid - 2 * sd AS bb_low
  FROM b3 JOIN e USING (series, date))"""
    return ", ".join((one, two, three, four))


def places(name: str) -> int:
    """Decimals to which a column is rounded for comparison: nine for ratios, four for price and volume levels."""
    return 9 if name in ("amplitude", "difference", "daily_return", "target_next_log_return") or name.startswith("ret_lag") else 4


def pick(names: list[str], digits: int | None = None) -> str:
    return ", ".join(f"round({c}, {digits or places(c)}) + 0.0 AS {c}" for c in names)


def features_sql(bars: str, names: list[str]) -> str:
    return f"WITH {bars}, {feature_steps()} SELECT series, date, {pick(names)} FROM f"


def dataset_steps(names: list[str], bars: str = DAILY) -> str:
    """CTEs up to d: the clean modelling table, rounded as the registered query rounds it, with split."""
    target = "target_next_log_return"
    clean = " AND ".join(f"{c} IS NOT NULL" for c in [*names, target])
    return f"""{bars}, {feature_steps()}, d0 AS (SELECT series, date, {pick([*names, target])} FROM f WHERE {clean}),
d1 AS (SELECT *, row_number() OVER ({W}) - 1 AS pos, count(*) OVER (PARTITION BY series) AS n FROM d0),
d AS (SELECT * EXCLUDE (pos, n), CASE WHEN pos < floor(0.85::DOUBLE * n) THEN 'train' WHEN pos < floor((0.85::DOUBLE + 0.05::DOUBLE) * n) THEN 'val' ELSE 'test' END AS split FROM d1)"""


YP = "yp AS (SELECT series, date, target_next_log_return AS y, round(0.1 * daily_return - 0.02 * ret_lag_1, 9) + 0.0 AS p FROM d WHERE split = 'test'), tm AS (SELECT avg(target_next_log_return) AS mean FROM d WHERE split = 'train')"

LONG = """lp AS (SELECT series, date, 'model' AS predictor, y, p FROM yp UNION ALL SELECT series, date, 'persistence', y, 0.0 FROM yp
  UNION ALL SELECT series, date, 'historical_mean', y, mean FROM yp, tm)"""

LONG_BY_SERIES = LONG.replace("mean FROM yp, tm)", "mean FROM yp JOIN tm USING (series))")
YP_BY_SERIES = YP.replace("(SELECT avg(target_next_log_return) AS mean FROM d WHERE split = 'train')", "(SELECT series, avg(target_next_log_return) AS mean FROM d WHERE split = 'train' GROUP BY series)")

METRICS = """m AS (SELECT predictor, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse,
  avg(CASE WHEN y <> 0 THEN CASE WHEN sign(p) = sign(y) THEN 1.0 ELSE 0.0 END END) AS dir_acc,
  CASE WHEN min(p) < max(p) THEN covar_pop(p, y) / nullif(stddev_pop(p) * stddev_pop(y), 0) END AS ic,
  1 - sum((y - p) * (y - p)) / nullif(var_pop(y) * count(y), 0) AS r2 FROM lp GROUP BY predictor)"""


METRICS_BY_SERIES = METRICS.replace("SELECT predictor", "SELECT series, predictor").replace("GROUP BY predictor", "GROUP BY series, predictor")


def unpivot(names: list[str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT series, split, date, '{c}' AS feature, {c} AS value FROM {source}" for c in names)


def blocks(months: int = 3) -> str:
    return f"bl AS (SELECT *, CAST(floor((year(date) * 12 + month(date) - 1 - min(year(date) * 12 + month(date) - 1) OVER (PARTITION BY series)) / {months}) AS BIGINT) AS block_id FROM d WHERE split = 'train')"


def auc_steps(names: list[str]) -> str:
    long = " UNION ALL ".join(f"SELECT series, block_id, '{c}' AS feature, {c} AS value FROM bl" for c in names)
    return f"""{blocks()}, lg AS ({long}), cn AS (SELECT series, feature, block_id, value, count(*) AS n FROM lg GROUP BY ALL),
ids AS (SELECT DISTINCT series, block_id FROM bl), pr AS (SELECT a.series, a.block_id AS ba, b.block_id AS bb FROM ids a JOIN ids b ON a.series = b.series AND a.block_id < b.block_id),
u AS (SELECT cn.series, feature, ba, bb, value, n AS n0, 0 AS n1 FROM cn JOIN pr ON cn.series = pr.series AND block_id = ba
  UNION ALL SELECT cn.series, feature, ba, bb, value, 0, n FROM cn JOIN pr ON cn.series = pr.series AND block_id = bb),
v AS (SELECT series, feature, ba, bb, value, sum(n0) AS n0, sum(n1) AS n1 FROM u GROUP BY ALL),
r AS (SELECT *, coalesce(sum(n0 + n1) OVER (PARTITION BY series, feature, ba, bb ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n0 + n1 + 1) / 2.0 AS rank FROM v),
au AS (SELECT series, feature, ba, bb, CAST((sum(n1 * rank) - sum(n1) * (sum(n1) + 1) / 2.0) AS DOUBLE) / CAST(sum(n0) * sum(n1) AS DOUBLE) AS a FROM r GROUP BY ALL),
sc AS (SELECT series, feature, ba, bb, greatest(a, 1 - a) AS auc FROM au)"""


def drift_steps(names: list[str], keys: str = "feature") -> str:
    return f"""lg AS ({unpivot(names, "d WHERE split IN ('train', 'test')")}),
cn AS (SELECT {keys}, value, count(*) FILTER (WHERE split = 'train') AS a, count(*) FILTER (WHERE split = 'test') AS b FROM lg GROUP BY ALL),
g AS (SELECT {keys}, abs(sum(a) OVER w / CAST(sum(a) OVER (PARTITION BY {keys}) AS DOUBLE) - sum(b) OVER w / CAST(sum(b) OVER (PARTITION BY {keys}) AS DOUBLE)) AS gap,
  lead(value) OVER (PARTITION BY {keys} ORDER BY value) - value AS step FROM cn WINDOW w AS (PARTITION BY {keys} ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
sd AS (SELECT {keys}, stddev_samp(value) AS sd FROM lg WHERE split = 'train' GROUP BY {keys}),
dr AS (SELECT {keys}, max(gap) AS ks, sum(gap * step) / nullif(any_value(sd), 0) AS wasserstein FROM g JOIN sd USING ({keys}) GROUP BY {keys})"""


def scaler_steps(names: list[str], keys: str = "feature") -> str:
    return f"""lg AS ({unpivot(names, 'd')}), q AS (SELECT {keys}, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS center, quantile_cont(value, 0.75) AS b FROM lg WHERE split = 'train' GROUP BY {keys}),
sf AS (SELECT {keys}, center, CASE WHEN b - a = 0 THEN 1.0 ELSE b - a END AS scale FROM q)"""


def first_bars(bars: str, n: int) -> str:
    """The CTE `bars` with the first n of each series."""
    return bars.replace("bars AS (", "every_bar AS (", 1) + f", bars AS (SELECT * FROM every_bar QUALIFY row_number() OVER ({W}) <= {n})"
