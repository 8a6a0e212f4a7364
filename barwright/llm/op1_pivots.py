"""Exact top-k search by pivot-table elimination.

Every vector keeps a precomputed table of its distances to many pivots, in the form of the apex that these distances fix: its
coordinates in the space that the pivots span, and its height over it. The distance of two apexes is the largest lower bound of
two vectors' distance that their pivot distances allow (no smaller than the largest difference of two such distances), hence,
with the norms, the smallest upper bound of their inner product. Candidates are evaluated in the order of that bound until the
k-th score found beats the next bound; equal bounds are still evaluated, so ties come out exactly. Pivots decide the speed
only, never the result.

Scale: vectors are dealt into cells by their nearest pivot and into lots of bounded bytes within; a large cell has many lots. A
query first searches one lot of its own cell, which gives it a threshold; then it goes only to the cells whose ball (centre,
radius, largest norm: CELLS rows of figures) can hold a score that reaches it. Each (lot, lot of queries) is one task of
bounded size, a query's k best of each go on, and the final ranking drops all but k a query before its shuffle. Scores are
integers: sums of int64 products, or of unbounded integers where components are so large that int64 could overflow.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor do rows without an id;
vectors are compared with those of their own length; every row counts, also repeated ones and others with the query's id, but
the query's own row is no candidate of it; an empty table gives an empty result; extra columns are ignored, whatever their
names. A score beyond 64 bits counts as the largest (smallest) 64-bit number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.llm import kernels
from barwright.llm.sampling import smallest
from barwright.llm.store import Tables

K = 10
PIVOTS = 48  # at most, and at most three quarters of the components
CELLS = 32
SAMPLE = 2048  # vectors, at most, among which pivots are chosen
LOT_BYTES = 16 << 20  # vectors with their tables in a lot, about
SCALE = 1024
SLACK = 1e-6  # of the product of two norms: more than the rounding of tables and bounds
LARGEST = 2**31 - 1  # scaled components up to this are kept in 32 bits
LONG = 2**63 - 1


def choose_pivots(vectors: np.ndarray, n: int) -> np.ndarray:
    """Far-apart vectors: each next one has the largest distance to those chosen."""
    if not len(vectors):
        return vectors
    chosen = [int(np.argmax(((vectors - vectors.mean(0)) ** 2).sum(1)))]
    far = ((vectors - vectors[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(n, len(vectors)) and far.max() > 0:
        chosen.append(int(np.argmax(far)))
        far = np.minimum(far, ((vectors - vectors[chosen[-1]]) ** 2).sum(1))
    return vectors[chosen]


class Pivots:
    """Pivots of vectors of one length: an orthonormal basis of the space they span, and the cells' centres as apexes."""

    def __init__(self, sample: np.ndarray, d: int) -> None:
        with np.errstate(over="ignore"):
            usable = sample[np.isfinite((sample * sample).sum(1))] if len(sample) else np.zeros((0, d))
        found = choose_pivots(usable, min(PIVOTS, max(1, 3 * d // 4)))
        q, r = np.linalg.qr(found.T) if len(found) else (np.zeros((d, 0)), np.zeros((0, 0)))
        self.basis = q[:, np.abs(np.diag(r)) > 1e-9 * max(1.0, np.abs(r).max(initial=0))]
        centres = found[:CELLS] if len(found) else np.zeros((1, d))
        self.centres = self.apexes(centres)[0]

    def apexes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Apexes (coordinates, then the height) as float32, and norms. What isn't finite has an infinite norm."""
        with np.errstate(over="ignore", invalid="ignore"):
            square = (vectors * vectors).sum(1)
            at = vectors @ self.basis
            height = np.sqrt(np.maximum(square - (at * at).sum(1), 0.0))
            out = np.concatenate([at, height[:, None]], 1)
            wild = ~np.isfinite(square) | (square > 1e76)  # beyond float32
        out[wild] = 0.0
        return out.astype(np.float32), np.where(wild, np.inf, np.sqrt(square))

    def cells(self, apexes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each apex and its distance from the cell's centre."""
        near = np.full(len(apexes), np.inf)
        cell = np.zeros(len(apexes), np.int64)
        for c, centre in enumerate(self.centres.astype(float)):
            far = np.sqrt(((apexes - centre) ** 2).sum(1))
            cell, near = np.where(far < near, c, cell), np.minimum(far, near)
        return cell, near


def integers(raw: list[bytes], wide: list[bool], scale: int = SCALE) -> np.ndarray:
    """Scaled components as int64 or, if one row is wide, as Python's integers. Wide rows hold the components themselves."""
    if not any(wide):
        return np.stack([np.frombuffer(b, np.int32) for b in raw]).astype(np.int64)
    out = np.empty((len(raw), len(raw[0]) // (8 if wide[0] else 4)), object)
    for i, (b, w) in enumerate(zip(raw, wide, strict=True)):
        out[i] = [_scaled_integer(x, scale) for x in np.frombuffer(b, float).tolist()] if w else np.frombuffer(b, np.int32).tolist()
    return out


def _scaled_integer(x: float, scale: int) -> int:
    y = scale * x
    return math.floor(y) if math.isfinite(y) else int(x) * scale


def _exact(vectors: np.ndarray, query: np.ndarray, small: bool) -> np.ndarray:
    if small:
        return vectors @ query
    return np.array([min(max(sum(a * b for a, b in zip(v, query.tolist(), strict=True)), -LONG - 1), LONG) for v in vectors.tolist()], object)


def search(queries: np.ndarray, query_rows: np.ndarray, query_apexes: tuple[np.ndarray, np.ndarray], least: np.ndarray, vectors: np.ndarray, rows: np.ndarray, ids: np.ndarray, apexes: tuple[np.ndarray, np.ndarray], k: int = K, step: int = 64) -> tuple[np.ndarray, np.ndarray, list, int]:
    """(query position, vector position, scores) of each query's k best among the vectors that reach its threshold `least`,
    and how many candidates were evaluated. rows: numbers of the table's rows; a query's own is left out."""
    out_q, out_v, out_s, evaluated = [], [], [], 0
    if not len(vectors) or not len(queries):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
    top = max(int(abs(x).max()) for x in (queries, vectors)) if queries.dtype == object or vectors.dtype == object else int(max(np.abs(queries).max(), np.abs(vectors).max()))
    small = queries.dtype != object and vectors.dtype != object and top * top * vectors.shape[1] < 1 << 62
    if not small:
        queries, vectors = queries.astype(object), vectors.astype(object)
    (qa, qn), (va, vn) = query_apexes, apexes
    qa, va = qa.astype(float), va.astype(float)
    slab = max(1, (4 << 20) // len(vectors))
    for first in range(0, len(queries), slab):
        # inner products of apexes bound those of the vectors: heights are lengths, which at best point the same way
        with np.errstate(invalid="ignore", over="ignore"):
            bounds = qa[first : first + slab] @ va.T + SLACK * (qn[first : first + slab, None] * vn) + 1
        bounds[~np.isfinite(bounds)] = np.inf
        for q, bound in enumerate(bounds, first):
            bound[rows == query_rows[q]] = -np.inf
            floor = float(least[q])
            todo = np.flatnonzero((bound >= floor) & (bound > -np.inf))
            best: list[tuple] = []
            size = step
            while len(todo):
                if size < len(todo):
                    split = np.argpartition(-bound[todo], size)
                    part, todo = todo[split[:size]], todo[split[size:]]
                else:
                    part, todo = todo, todo[:0]
                evaluated += len(part)
                scores = _exact(vectors[part], queries[q], small).tolist()
                best = sorted([*best, *zip((-s for s in scores), ids[part].tolist(), part.tolist(), strict=True)])[:k]
                if len(best) == k:
                    floor = max(floor, float(-best[-1][0]))
                    todo = todo[bound[todo] >= floor]
                size *= 2
            best = [b for b in best if -b[0] >= least[q]]
            out_q += [q] * len(best)
            out_v += [i for _, _, i in best]
            out_s += [-s for s, _, _ in best]
    return np.array(out_q, np.int64), np.array(out_v, np.int64), out_s, evaluated


_FOUND = "row long, query_id long, vec_id long, score long"


def _lot_search(k: int, scale: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")
        if not len(left) or not len(right):
            return empty
        apexes = lambda frame: (np.stack([np.frombuffer(b, np.float32) for b in frame["apex"]]), frame["norm"].to_numpy(float))
        mine, others = integers(list(left["v"]), list(left["wide"]), scale), integers(list(right["v"]), list(right["wide"]), scale)
        q, v, s, _ = search(mine, left["row"].to_numpy(), apexes(left), left["least"].to_numpy(float), others, right["row"].to_numpy(), right["vec_id"].to_numpy(), apexes(right), k)
        if not len(q):
            return empty
        return pd.DataFrame({"row": left["row"].to_numpy()[q], "query_id": left["vec_id"].to_numpy()[q], "vec_id": right["vec_id"].to_numpy()[v], "score": np.array(s, np.int64)})

    return run


def _components(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    """(position, id, components as doubles) of the rows that take part."""
    for n, (i, v) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False), strict=True)):
        if i is None or v is None or not len(v):
            continue
        x = np.array([np.nan if c is None else c for c in v], float) if v.dtype == object else v.astype(float)
        if np.isfinite(x).all():
            yield n, i, x


def _table(pivots: dict[int, Pivots], scale: int):
    """Scaled vectors with their pivot tables and cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(2).to_pylist()
            out: dict[str, list] = {c: [] for c in ("row", "vec_id", "d", "v", "wide", "apex", "norm", "cell", "far")}
            by_length: dict[int, list] = {}
            for n, i, x in _components(batch):
                by_length.setdefault(len(x), []).append((rows[n], i, x))
            for d, own in by_length.items():
                with np.errstate(over="ignore"):
                    scaled = np.floor(scale * np.stack([x for _, _, x in own]))
                wide = (np.abs(scaled) > LARGEST).any(1)
                apexes, norms = pivots[d].apexes(scaled) if d in pivots else Pivots(scaled[:0], d).apexes(scaled)
                cells, far = pivots[d].cells(apexes) if d in pivots else (np.zeros(len(own), np.int64), np.full(len(own), np.inf))
                out["row"] += [r for r, _, _ in own]
                out["vec_id"] += [i for _, i, _ in own]
                out["d"] += [d] * len(own)
                out["v"] += [x.tobytes() if w else s.astype(np.int32).tobytes() for (_, _, x), s, w in zip(own, scaled, wide, strict=True)]
                out["wide"] += wide.tolist()
                out["apex"] += [a.tobytes() for a in apexes]
                out["norm"] += norms.tolist()
                out["cell"] += cells.tolist()
                out["far"] += np.where(np.isinf(norms), np.inf, far).tolist()
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_(), pa.binary(), pa.float64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out.values(), kinds, strict=True)], list(out))

    return run


_TABLE = "row long, vec_id long, d int, v binary, wide boolean, apex binary, norm double, cell long, far double"
_QUERY = "row long, vec_id long, d int, v binary, wide boolean, apex binary, norm double, least double, home long, home_lot long"


def _reachable(pivots: dict[int, Pivots], cells: dict[int, list[tuple[int, int, float, float]]]):
    """The lots that each query goes to: those of all cells that can hold a score that reaches its threshold, but the one it
    has searched. cells: by length, (cell, lots, radius, largest norm)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, to_cell, to_lot = [], [], []
            names = batch.schema.names
            columns = [batch.column(names.index(c)).to_pylist() for c in ("d", "apex", "norm", "least", "home", "home_lot")]
            for n, (d, raw, norm, least, home, home_lot) in enumerate(zip(*columns, strict=True)):
                apex = np.frombuffer(raw, np.float32).astype(float)
                for cell, lots, radius, most in cells[d]:
                    if d in pivots and math.isfinite(radius + norm + most):
                        centre = pivots[d].centres[cell].astype(float)
                        low = max(0.0, float(np.sqrt(((apex - centre) ** 2).sum())) - radius - SLACK * (norm + most))
                        if (norm * norm + most * most - low * low) / 2 + SLACK * norm * most + 1 < least:
                            continue
                    for lot in range(lots):
                        if (cell, lot) != (home, home_lot):
                            take.append(n)
                            to_cell.append(cell)
                            to_lot.append(lot)
                if len(take) >= 10_000:
                    yield _dealt(batch, take, to_cell, to_lot)
                    take, to_cell, to_lot = [], [], []
            if take:
                yield _dealt(batch, take, to_cell, to_lot)

    return run


def _dealt(batch: pa.RecordBatch, take: list[int], cell: list[int], lot: list[int]) -> pa.RecordBatch:
    own = batch.take(pa.array(take))
    return pa.RecordBatch.from_arrays([*own.columns, pa.array(cell, pa.int64()), pa.array(lot, pa.int64())], [*own.schema.names, "cell", "lot"])


def top_k(vectors: DataFrame, every: int = 100, k: int = K, scale: int = SCALE, lot_bytes: int = LOT_BYTES) -> DataFrame:
    """query_id, rank, vec_id and score: the k best of every query row (vec_id divisible by `every`).

    vectors: (vec_id, embedding). Components become floor(scale * x).
    """
    with Tables() as tables:
        spark = vectors.sparkSession
        rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        sample = smallest(rows.where("vec_id IS NOT NULL AND size(embedding) > 0"), F.xxhash64("vec_id", F.lit(3)), SAMPLE)  # what comes to the driver is bounded by SAMPLE
        by_length: dict[int, list] = {}
        for batch in sample.toArrow().to_batches():
            for _, _, x in _components(batch):
                by_length.setdefault(len(x), []).append(x)
        with np.errstate(over="ignore"):
            pivots = {d: Pivots(np.unique(np.floor(scale * np.stack(own)), axis=0), d) for d, own in by_length.items()}
        numbered = rows.withColumn("row", F.monotonically_increasing_id())
        table = tables.saved(numbered.mapInArrow(kernels.tidy(_table(pivots, scale)), _TABLE))
        figures = table.groupBy("d", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("v") + F.length("apex") + 64).alias("bytes"), F.max("far").alias("radius"), F.max("norm").alias("most")).collect()
        wanted = spark.sparkContext.defaultParallelism
        total = sum(f["n"] for f in figures)
        # as many lots as bytes ask for; small tables get some for each core, of 1000 vectors at least
        lots = {(f["d"], f["cell"]): max(1, -(-f["bytes"] // lot_bytes), min(-(-wanted * f["n"] // total), f["n"] // 1000)) for f in figures}
        cells: dict[int, list] = {}
        for f in figures:
            cells.setdefault(f["d"], []).append((f["cell"], lots[f["d"], f["cell"]], f["radius"], f["most"]))
        n_lots = F.coalesce(*(F.when((F.col("d") == d) & (F.col("cell") == c), F.lit(n)) for (d, c), n in lots.items() if n > 1), F.lit(1)) if lots else F.lit(1)
        placed = table.withColumn("lot", F.pmod(F.xxhash64("row"), n_lots)).select("row", "vec_id", "d", "v", "wide", "apex", "norm", "cell", "lot")
        is_query = F.pmod(F.col("vec_id"), F.lit(every)) == 0
        asked = placed.where(is_query).withColumn("least", F.lit(-math.inf))
        lot_search = _lot_search(k, scale)
        columns = ("row", "vec_id", "d", "v", "wide", "apex", "norm", "least")
        apart = lambda df: df.select(*(F.col(c).alias(c) for c in df.columns))  # noqa: E731  two readings of one table
        near = tables.saved(apart(asked).groupBy("d", "cell", "lot").cogroup(apart(placed).groupBy("d", "cell", "lot")).applyInPandas(lot_search, _FOUND))
        floors = near.groupBy(F.col("row").alias("r")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).alias("floor"))
        ready = asked.join(floors, F.col("row") == F.col("r"), "left").withColumn("least", F.coalesce("floor", F.lit(-math.inf)) - F.lit(0.0))
        ready = ready.select(*columns, F.col("cell").alias("home"), F.col("lot").alias("home_lot"))
        sent = ready.mapInArrow(_reachable(pivots, cells), f"{_QUERY}, cell long, lot long")
        query_bytes = sum(f["bytes"] for f in figures) / every
        query_lots = max(1, math.ceil(query_bytes / lot_bytes))
        sent = sent.withColumn("query_lot", F.pmod(F.xxhash64("row", F.lit(5)), F.lit(query_lots)))
        dealt = placed.withColumn("query_lot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_lots - 1).cast("long"))))
        keys = ["d", "cell", "lot", "query_lot"]
        further = sent.groupBy(*keys).cogroup(apart(dealt).groupBy(*keys)).applyInPandas(lot_search, _FOUND)
        w = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
        ranked = near.unionByName(further).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        out = tables.saved(ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
        tables.keep(out)
    return out
