"""Gradient boosting for the absolute error: parameter draws, fit with patience, seeded search, prediction, attribution.

Trees grow best leaf first on histograms of binned columns: each step follows the signs of the residuals, with num_leaves,
max_depth, min_child_samples, lambda_l1, lambda_l2, and a new sample of columns and rows for each tree; a leaf's value
then is the median of its rows' residuals. The error on the validation rows is taken tree by tree, and growth ends once
`patience` trees bring nothing better.

Scale: growing one tree is a chain of small steps, so a whole fit is one task, and the draws of a search are tasks side by side;
each needs the binned training rows, a byte a value, which are sent to all executors if they have FIT_VALUES values at most.
Larger tables go to Spark's distributed trees (fit_distributed), which have no counterpart of leaf counts and penalties.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.config import DEFAULT, KEYS, TARGET, Settings

UNTUNED = {"num_leaves": 31, "learning_rate": 0.03, "max_depth": 6}
UNSET = {"num_leaves": 31, "learning_rate": 0.1, "max_depth": -1, "min_child_samples": 20, "feature_fraction": 1.0, "bagging_fraction": 1.0, "lambda_l1": 0.0, "lambda_l2": 0.0}
BINS = 255
FIT_VALUES = 32 << 20  # values (rows x columns) that one task fits: 32 MB binned, 256 MB on the driver before


def draw_parameters(n: int, s: Settings = DEFAULT) -> list[dict]:
    """n draws of the search space, in the order of its entries; whole numbers inclusive, rates and penalties log-uniform."""
    rng, out = np.random.default_rng(s.seed), []
    for _ in range(n):
        row = {}
        for name, (low, high) in s.search.items():
            if isinstance(low, int):
                row[name] = int(rng.integers(low, high + 1))
            elif name.endswith("fraction"):
                row[name] = float(rng.uniform(low, high))
            else:
                row[name] = float(np.exp(rng.uniform(np.log(low), np.log(high))))
        out.append(row)
    return out


@dataclass
class Boosted:
    """A fitted ensemble: tree tables (bounded by trees and leaves), weights, and what undoes the standardising."""

    columns: list[str]
    trees: list[dict[str, np.ndarray]]
    weights: list[float]
    center: float
    spread: float
    parameters: dict
    best_iteration: int
    val_mae: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for t, w in zip(self.trees, self.weights, strict=True):
            total += w * t["value"][_leaves(t, x)]
        return self.center + self.spread * total

    def to_json(self) -> str:
        own = {k: getattr(self, k) for k in ("columns", "weights", "center", "spread", "parameters", "best_iteration", "val_mae")}
        return json.dumps(own | {"trees": [{k: v.tolist() for k, v in t.items()} for t in self.trees]})

    @classmethod
    def from_json(cls, text: str) -> Boosted:
        own = json.loads(text)
        return cls(**own | {"trees": [{k: np.array(v, float if k in ("threshold", "value", "cover") else np.int64) for k, v in t.items()} for t in own["trees"]]})


def _leaves(tree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), np.int64)
    while True:
        inner = tree["left"][at] >= 0
        if not inner.any():
            return at
        rows = np.flatnonzero(inner)
        node = at[rows]
        goes_left = x[rows, tree["feature"][node]] <= tree["threshold"][node]
        at[rows] = np.where(goes_left, tree["left"][node], tree["right"][node])


# -- one fit ------------------------------------------------------------------------------------------------------------


def bin_edges(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """For each column the values between its bins: between all distinct values if there are few, else between quantiles."""
    out = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > bins:
            values = np.unique(np.quantile(column, np.linspace(0, 1, bins), method="nearest"))
        out.append((values[1:] + values[:-1]) / 2)
    return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, side="left").astype(np.uint8) for e, c in zip(edges, x.T, strict=True)], 1) if x.shape[1] else np.zeros(x.shape, np.uint8)


def _best_split(count: np.ndarray, grad: np.ndarray, p: dict) -> tuple[float, int, int]:
    """(gain, column, last bin that goes left) of the best split of a leaf with these histograms; gain 0 for none."""
    n, g = count[0].sum(), grad[0].sum()
    score = lambda g, n: np.maximum(np.abs(g) - p["lambda_l1"], 0.0) ** 2 / (n + p["lambda_l2"])
    left_n, left_g = np.cumsum(count, 1)[:, :-1], np.cumsum(grad, 1)[:, :-1]
    allowed = (left_n >= max(1, p["min_child_samples"])) & (n - left_n >= max(1, p["min_child_samples"]))
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(allowed, score(left_g, left_n) + score(g - left_g, n - left_n) - score(g, n), 0.0)
    best = int(np.argmax(gain))
    return float(gain.flat[best]), best // gain.shape[1], best % gain.shape[1]


def grow_tree(codes: np.ndarray, edges: list[np.ndarray], residual: np.ndarray, rows: np.ndarray, columns: np.ndarray, p: dict) -> dict[str, np.ndarray]:
    """One tree on the given rows and columns, best leaf first; a leaf's value is the median of its rows' residuals."""
    grad = -np.sign(residual)
    own = codes[:, columns].astype(np.int64) + (BINS + 1) * np.arange(len(columns))
    size = (BINS + 1) * len(columns)
    deepest = p["max_depth"] if p["max_depth"] > 0 else 1 << 30

    def histograms(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat = own[at].ravel()
        weights = np.repeat(grad[at], len(columns))
        return np.bincount(flat, minlength=size).reshape(len(columns), -1), np.bincount(flat, weights, size).reshape(len(columns), -1)

    nodes: list[list[float]] = []  # column, threshold, left, right, value, cover
    members: dict[int, np.ndarray] = {}
    queue: list[tuple] = []

    def leaf(at: np.ndarray, depth: int, hist: tuple[np.ndarray, np.ndarray]) -> int:
        n = len(nodes)
        nodes.append([0, 0.0, -1, -1, 0.0, float(len(at))])
        members[n] = at
        if depth < deepest and len(at) >= 2 * max(1, p["min_child_samples"]):
            gain, column, last = _best_split(*hist, p)
            if gain > 0:
                heapq.heappush(queue, (-gain, n, column, last, depth, hist))
        return n

    leaf(rows, 0, histograms(rows))
    leaves = 1
    while queue and leaves < p["num_leaves"]:
        _, n, column, last, depth, hist = heapq.heappop(queue)
        at = members.pop(n)
        goes_left = codes[at, columns[column]] <= last
        left, right = at[goes_left], at[~goes_left]
        small = histograms(left if len(left) <= len(right) else right)
        rest = hist[0] - small[0], hist[1] - small[1]
        nodes[n][0], nodes[n][1] = float(columns[column]), float(edges[columns[column]][last])
        nodes[n][2] = leaf(left, depth + 1, small if len(left) <= len(right) else rest)
        nodes[n][3] = leaf(right, depth + 1, rest if len(left) <= len(right) else small)
        leaves += 1
    for n, at in members.items():
        nodes[n][4] = float(np.median(residual[at])) if len(at) else 0.0
    a = np.array(nodes, float)
    return {"feature": a[:, 0].astype(np.int64), "threshold": a[:, 1], "left": a[:, 2].astype(np.int64), "right": a[:, 3].astype(np.int64), "value": a[:, 4], "cover": a[:, 5]}


def fit_arrays(columns: Sequence[str], edges: list[np.ndarray], train: tuple[np.ndarray, np.ndarray, np.ndarray], val: tuple[np.ndarray, np.ndarray], parameters: dict, trees: int, patience: int, seed: int) -> Boosted:
    """A fit on (values, bin codes, target) of the training rows, kept up to its best tree on (values, target) of the others."""
    p = UNSET | parameters
    (x, codes, y), (vx, vy) = train, val
    rng = np.random.default_rng(seed)
    center = float(np.median(y))
    now, then = np.full(len(y), center), np.full(len(vy), center)
    grown, best, error = [], 0, np.inf
    for i in range(trees):
        rows = np.arange(len(y))
        if p["bagging_fraction"] < 1:
            rows = np.sort(rng.choice(len(y), max(1, int(p["bagging_fraction"] * len(y))), replace=False))
        chosen = np.arange(len(columns))
        if p["feature_fraction"] < 1:
            chosen = np.sort(rng.choice(len(columns), max(1, round(p["feature_fraction"] * len(columns))), replace=False))
        tree = grow_tree(codes, edges, y - now, rows, chosen, p)
        grown.append(tree)
        now += p["learning_rate"] * tree["value"][_leaves(tree, x)]
        then += p["learning_rate"] * tree["value"][_leaves(tree, vx)]
        off = float(np.abs(vy - then).mean()) if len(vy) else 0.0
        if off < error:
            best, error = i, off
        elif i - best >= patience:
            break
    grown = grown[: best + 1]
    return Boosted(list(columns), grown, [float(p["learning_rate"])] * len(grown), center, 1.0, dict(parameters), best + 1, error)


# -- fits in the cluster ------------------------------------------------------------------------------------------------


def fit_many(table: DataFrame, columns: Sequence[str], many: Sequence[dict], trees: int, patience: int = DEFAULT.patience, seed: int = DEFAULT.seed) -> list[Boosted]:
    """A fit for each set of parameters, on split = 'train' and kept up to its best tree on split = 'val', side by side."""
    columns = list(columns)
    rows = table.where("split IN ('train', 'val')")
    if rows.count() * len(columns) > FIT_VALUES:
        return [fit_distributed(table, columns, parameters, trees, patience, seed) for parameters in many]
    data = rows.select("split", *columns, TARGET, *KEYS).toPandas().sort_values(list(KEYS))  # bounded by FIT_VALUES
    parts = [(own[columns].to_numpy(float), own[TARGET].to_numpy(float)) for own in (data[data.split == name] for name in ("train", "val"))]
    edges = bin_edges(parts[0][0])
    spark = table.sparkSession
    sent = spark.sparkContext.broadcast((edges, (parts[0][0], binned(parts[0][0], edges), parts[0][1]), parts[1]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for i in frame["id"]:
                yield pd.DataFrame({"id": [i], "model": [fit_arrays(columns, *sent.value, many[i], trees, patience, seed).to_json()]})

    found = spark.range(len(many), numPartitions=max(1, len(many))).mapInPandas(run, "id long, model string").collect()
    sent.unpersist()
    return [Boosted.from_json(r["model"]) for r in sorted(found, key=lambda r: r["id"])]


def fit(table: DataFrame, columns: Sequence[str], parameters: dict, trees: int, patience: int = DEFAULT.patience, seed: int = DEFAULT.seed) -> Boosted:
    return fit_many(table, columns, [parameters], trees, patience, seed)[0]


def _table(model, n: int) -> list[dict[str, np.ndarray]]:
    """Spark's first n trees as arrays: feature, threshold, left, right (-1 at leaves), value, cover."""
    out = []
    for tree in model.trees[:n]:
        rows: list[list[float]] = []

        def walk(node, rows=rows) -> int:
            at = len(rows)
            rows.append([0, 0.0, -1, -1, float(node.prediction()), float(node.impurityStats().count())])
            if node.subtreeDepth() > 0:
                rows[at][0], rows[at][1] = node.split().featureIndex(), node.split().threshold()
                rows[at][2] = walk(node.leftChild())
                rows[at][3] = walk(node.rightChild())
            return at

        walk(tree._java_obj.rootNode())
        a = np.array(rows, float)
        out.append({"feature": a[:, 0].astype(int), "threshold": a[:, 1], "left": a[:, 2].astype(int), "right": a[:, 3].astype(int), "value": a[:, 4], "cover": a[:, 5]})
    return out


def fit_distributed(table: DataFrame, columns: Sequence[str], parameters: dict, trees: int, patience: int = DEFAULT.patience, seed: int = DEFAULT.seed) -> Boosted:
    """As fit(), by Spark's trees, for tables of any size. num_leaves, lambda_l1 and lambda_l2 aren't known there, and leaves
    follow the mean of the signs, so the target is standardised.

    Spark can't go on from a fitted ensemble, and its tree m doesn't depend on how many follow: so the ensemble is grown
    again at twice the size, up to `trees`, until patience has ended it.
    """
    p, columns = UNSET | parameters, list(columns)
    stats = table.where("split = 'train'").agg(F.avg(TARGET).alias("m"), F.stddev_pop(TARGET).alias("s")).first()
    center, spread = float(stats["m"]), float(stats["s"] or 1.0)
    ready = VectorAssembler(inputCols=columns, outputCol="features").transform(table).withColumn("label", (F.col(TARGET) - center) / spread)
    train, val = ready.where("split = 'train'").select("features", "label").persist(), ready.where("split = 'val'").select("features", "label").persist()
    depth = int(p["max_depth"]) if p["max_depth"] > 0 else int(np.ceil(np.log2(p["num_leaves"])))
    gbt = GBTRegressor(lossType="absolute", stepSize=float(p["learning_rate"]), maxDepth=depth, minInstancesPerNode=int(p["min_child_samples"]), featureSubsetStrategy=str(p["feature_fraction"]), subsamplingRate=float(p["bagging_fraction"]), seed=seed, maxBins=BINS)
    n = min(trees, 2 * patience)
    while True:
        model = gbt.copy({gbt.maxIter: n}).fit(train)
        best, ended, error = best_prefix([float(v) for v in model.evaluateEachIteration(val, "absolute")], patience)
        if ended or n >= trees:
            break
        n = min(trees, 2 * n)
    train.unpersist()
    val.unpersist()
    return Boosted(columns, _table(model, best + 1), [float(w) for w in model.treeWeights][: best + 1], center, spread, dict(parameters), best + 1, error * spread)


def best_prefix(curve: Sequence[float], patience: int) -> tuple[int, bool, float]:
    """The best tree before `patience` trees bring nothing better, whether patience ended the search, and the tree's error."""
    best = 0
    for i, v in enumerate(curve):
        if v < curve[best]:
            best = i
        elif i - best >= patience:
            return best, True, curve[best]
    return best, False, curve[best]


def random_search(table: DataFrame, columns: Sequence[str], draws: int, trees: int, s: Settings = DEFAULT) -> tuple[Boosted, list[tuple[int, float, int]]]:
    """The draw with the smallest validation error (the first of equals) and (draw, error, best iteration) of all.

    A fit is the same whenever it is made, so the winner needn't be fitted again."""
    models = fit_many(table, columns, draw_parameters(draws, s), trees, s.patience, s.seed)
    trials = [(i, model.val_mae, model.best_iteration) for i, model in enumerate(models)]
    return min(models, key=lambda model: model.val_mae, default=None), trials


def predict(table: DataFrame, model: Boosted) -> DataFrame:
    """table with `prediction`, in Arrow batches; the ensemble is small and goes with the task."""
    columns = model.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield frame.assign(prediction=model.predict(frame[columns].to_numpy(float)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)
    return table.mapInPandas(run, f"{schema}, prediction double")


# -- attribution --------------------------------------------------------------------------------------------------------


def tree_shares(tree: dict[str, np.ndarray], x: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """Exact Shapley values of one tree for all rows at once (rows x n), and the tree's mean.

    Each leaf contributes to the features on its path. With d of them, a coalition's value is a product of a factor for each:
    1 for a feature in it that the row follows, 0 for one that it doesn't, and for a feature outside the share of rows that
    do. The product of (share + follows * t) has the sums over coalitions of each size as coefficients; dividing a
    feature's own factor out leaves those of the others, which its weight is summed over.
    """
    phi, base = np.zeros((len(x), n)), 0.0
    paths: list[tuple[int, dict]] = [(0, {})]
    while paths:
        node, seen = paths.pop()
        if tree["left"][node] >= 0:
            f, left, right = int(tree["feature"][node]), int(tree["left"][node]), int(tree["right"][node])
            goes = x[:, f] <= tree["threshold"][node]
            for child, way in ((left, goes), (right, ~goes)):
                one, share = seen.get(f, (np.ones(len(x), bool), 1.0))
                paths.append((child, seen | {f: (one & way, share * tree["cover"][child] / tree["cover"][node])}))
            continue
        value, d = tree["value"][node], len(seen)
        base += value * float(np.prod([z for _, z in seen.values()]))
        poly = np.zeros((d + 1, len(x)))
        poly[0] = 1.0
        for k, (one, z) in enumerate(seen.values()):
            poly[1 : k + 2] = z * poly[1 : k + 2] + one * poly[: k + 1]
            poly[0] *= z
        sizes = np.ones(d)  # 1 / (d * choose(d - 1, k))
        for k in range(1, d):
            sizes[k] = sizes[k - 1] * k / (d - k)
        for f, (one, z) in seen.items():
            weight, rest = np.zeros(len(x)), np.zeros(len(x))
            for k in range(d - 1, -1, -1):  # followed: divided from the top; else the factor is a number
                rest = np.where(one, poly[k + 1] - z * rest, poly[k] / z)
                weight += rest * sizes[k] / d
            phi[:, f] += value * (one - z) * weight
    return phi, base


def attribution(table: DataFrame, model: Boosted) -> DataFrame:
    """(series, date, feature, phi, base): base and the phis of a row add up to its prediction."""
    columns, keys = model.columns, list(KEYS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            x = frame[columns].to_numpy(float)
            phi, base = np.zeros((len(x), len(columns))), model.center
            for t, w in zip(model.trees, model.weights, strict=True):
                own, mean = tree_shares(t, x, len(columns))
                phi += model.spread * w * own
                base += model.spread * w * mean
            out = frame[keys].loc[frame.index.repeat(len(columns))].reset_index(drop=True)
            yield out.assign(feature=np.tile(columns, len(x)), phi=phi.reshape(-1), base=base)

    kept = table.select(*keys, *columns)
    return kept.mapInPandas(run, ", ".join(f"{k} {kept.schema[k].dataType.simpleString()}" for k in keys) + ", feature string, phi double, base double")


def importance(phis: DataFrame) -> DataFrame:
    """(feature, mean_abs), largest first."""
    return phis.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs")).orderBy(F.desc("mean_abs"), "feature")


def as_rows(spark: SparkSession, draws: list[dict]) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame(draws).reset_index(names="draw"))
