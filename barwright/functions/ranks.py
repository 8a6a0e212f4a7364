"""Running counts over sorted values without a task for each key: values are dealt into buckets by quantiles of their key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.sources.shared import saved

SIDE = 32  # quantiles a level of the search; a key has SIDE * SIDE buckets at most
BUCKET_ROWS = 20_000  # distinct values in a bucket, about


def bucketed(counts: DataFrame, keys: Sequence[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """counts with `bucket`, which rises with `value` in each key; equal values share one. As many as the key's rows ask for.

    Counts are written out, as they are read several times, and so are the quantiles, estimates that may differ from one run of
    a plan to the next."""
    keys, counts = list(keys), saved(counts)
    shares = [i / SIDE**2 for i in range(1, SIDE**2)]
    cuts = counts.groupBy(*keys).agg(F.percentile_approx("value", shares, 10 * SIDE**2).alias("__cuts"), F.count(F.lit(1)).alias("__rows"))
    big = F.col("__rows") > bucket_rows
    out = counts.join(saved(cuts.withColumn("__cuts", F.when(big, F.col("__cuts")))), keys)
    below = lambda a: F.size(F.filter(a, lambda c: c < F.col("value")))  # noqa: E731  cuts below the value, of a sorted array
    outer = below(F.filter("__cuts", lambda c, i: (i + 1) % SIDE == 0))
    at = outer * SIDE + below(F.slice("__cuts", outer * SIDE + 1, F.lit(SIDE - 1)))
    wanted = F.least(F.ceil(F.col("__rows") / bucket_rows), F.lit(SIDE**2))
    bucket = F.when(wanted <= 1, 0).otherwise(F.floor(at * wanted / SIDE**2)).cast("int")
    return out.withColumn("bucket", bucket).drop("__cuts", "__rows")


def ranked(rows: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Bucketed rows with one row a value, and for each column of `sums`: `before_` it (its sum over smaller values of the key) and
    `all_` it (the key's sum); and `next`, the next value of the key."""
    keys = list(keys)
    whole = Window.partitionBy(*keys).orderBy("bucket")  # a row a bucket
    totals = rows.groupBy(*keys, "bucket").agg(*(F.sum(c).alias(f"__t_{c}") for c in sums), F.min("value").alias("__first"))
    totals = totals.select(
        *keys, "bucket", F.lead("__first").over(whole).alias("__next"),
        *(F.coalesce(F.sum(f"__t_{c}").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"__b_{c}") for c in sums),
        *(F.sum(f"__t_{c}").over(Window.partitionBy(*keys)).alias(f"all_{c}") for c in sums),
    )
    inside = Window.partitionBy(*keys, "bucket").orderBy("value")
    out = rows.join(totals, [*keys, "bucket"])
    before = {f"before_{c}": F.col(f"__b_{c}") + F.coalesce(F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for c in sums}
    out = out.withColumns(before | {"next": F.coalesce(F.lead("value").over(inside), "__next")})
    return out.drop("__next", *(f"__b_{c}" for c in sums))
