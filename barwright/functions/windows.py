"""Trailing window expressions. Every frame ends at the current row and belongs to one series."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.config import KEYS


def ordered():
    """Rows of a series in order of date."""
    return Window.partitionBy("series").orderBy("date")


LOSS = 20.0  # logarithm of what the fastest recursive average loses over a piece: weights inside stay small, and so does their rounding
WEIGHTLESS = 42.0  # logarithm of a weight beyond a double's rounding


def last_rows(n: int):
    return ordered().rowsBetween(-(n - 1), 0)


def full(x: Column, n: int, agg: Callable[[Column], Column]) -> Column:
    """agg over the last n rows, NULL unless all n have a value."""
    return F.when(F.count(x).over(last_rows(n)) == n, agg(x).over(last_rows(n)))


def over_zero(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero."""
    return a / F.nullif(b, F.lit(0.0))


def floor_at_zero(x: Column) -> Column:
    """Negative values become zero; NULL stays NULL."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def log_ratio(a: Column, b: Column) -> Column:
    return F.ln(over_zero(a, b))


@lru_cache(None)
def _least_loss(span: int, fastest: int, gaps: int) -> float:
    """The least that an average loses, against the fastest one, at a value after fewer than `gaps` rows without one."""
    return min(_lost(span, m) / _lost(fastest, m) for m in range(gaps))


def _lost(span: int, gap: int) -> float:
    """The logarithm of what an average of this span loses at a value that follows `gap` rows without one."""
    a, old = 2.0 / (span + 1), (1 - 2.0 / (span + 1)) ** (gap + 1)
    return -(gap + 1) * math.log(1 - a) + math.log(old + a) if gap else -math.log(1 - a)


def recursive_averages(bars: DataFrame, column: str, spans: Sequence[int], name: Callable[[int], str] = "ema_{}".format, skip_gaps: bool = False) -> DataFrame:
    """Adds exponential averages y = (1 - a) y' + a x with a = 2 / (span + 1), the first value as start; NULL until span values
    have been seen. Rows without a value keep the last average. A span of 1 is the last value itself.

    After m rows without a value the last average weighs (1 - a) ** (m + 1) against a, as weights go by position; with
    skip_gaps they go by value, as if such rows weren't there.

    Each series is cut into pieces over which the fastest average loses e ** -LOSS: inside a piece the recursion is a running
    sum of weighted values (a window) whose weights stay in range. What a piece starts from is folded from the ends of as many
    pieces before it as can matter; what lies further back weighs less than a double's rounding. No array grows with rows.
    """
    keys, known = list(KEYS), F.col(column).isNotNull()
    upto = ordered().rowsBetween(Window.unboundedPreceding, 0)
    slow = sorted({n for n in spans if n > 1})
    rows = bars.withColumns({"__n": F.sum(known.cast("long")).over(upto), "__at": F.row_number().over(ordered())})
    last = F.max(F.when(known, F.col("__at"))).over(ordered().rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__gap", F.lit(0) if skip_gaps else F.coalesce(F.col("__at") - last - 1, F.lit(0)))
    first = known & (F.col("__n") == 1)

    def lost(n: int) -> Column:
        a, steps = 2.0 / (n + 1), F.col("__gap") + 1
        after_gap = -steps * math.log(1 - a) + F.ln(F.pow(F.lit(1 - a), steps) + a)
        return F.when(known & ~first, F.when(F.col("__gap") > 0, after_gap).otherwise(-math.log(1 - a))).otherwise(0.0)

    if slow:
        rows = rows.withColumns({f"__f{n}": lost(n) for n in slow})
        rows = rows.withColumn("__c", F.floor(F.sum(f"__f{slow[0]}").over(upto) / LOSS))
        piece = Window.partitionBy("series", "__c").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        # the piece's first value loses what came before it, not what is in the piece
        rows = rows.withColumns({f"__s{n}": F.first(F.when(known, F.col(f"__f{n}")), ignorenulls=True).over(piece) for n in slow})
        rows = rows.withColumns({f"__v{n}": F.sum(f"__f{n}").over(piece) - F.coalesce(f"__s{n}", F.lit(0.0)) for n in slow})
        share = lambda n: F.when(first, 1.0).otherwise(F.when(F.col("__gap") > 0, 1 - F.exp(-F.col(f"__f{n}"))).otherwise(2.0 / (n + 1)))
        rows = rows.withColumns({f"__l{n}": F.sum(F.when(known, F.col(column) * share(n) * F.exp(F.col(f"__v{n}")))).over(piece) * F.exp(-F.col(f"__v{n}")) for n in slow})
        ends = rows.where(known).groupBy("series", "__c").agg(*(F.max_by(F.struct(F.col(f"__l{n}").alias("end"), F.exp(-F.col(f"__v{n}") - F.col(f"__s{n}")).alias("keeps")), "__at").alias(f"__e{n}") for n in slow))
        order = Window.partitionBy("series").orderBy("__c")
        carried = []
        for n in slow:
            least = _least_loss(n, slow[0], 1 if skip_gaps else 5000)  # beyond, the loss grows with the gap for all alike
            reach = math.ceil(WEIGHTLESS / (LOSS * least)) + 1
            before = F.collect_list(f"__e{n}").over(order.rowsBetween(-reach, -1))
            carried.append(F.aggregate(before, F.lit(0.0), lambda acc, x: acc * x["keeps"] + x["end"]).alias(f"__p{n}"))
        rows = rows.join(ends.select("series", "__c", *carried), ["series", "__c"], "left")
    for n in spans:
        if n == 1:
            value = F.last(column, ignorenulls=True).over(upto)
        else:
            value = F.coalesce(f"__l{n}", F.lit(0.0)) + F.exp(-F.col(f"__v{n}") - F.coalesce(f"__s{n}", F.lit(0.0))) * F.when(F.col(f"__p{n}").isNull(), 0.0).otherwise(F.col(f"__p{n}"))
        rows = rows.withColumn(name(n), F.when(F.col("__n") >= n, value))
    return rows.select(*keys, *(c for c in bars.columns if c not in keys), *(name(n) for n in spans))
