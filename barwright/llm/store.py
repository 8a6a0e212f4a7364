"""Intermediate tables in the folder that the driver and all executors share.

All of an application's tables lie in one folder, which the JVM deletes when it ends, even if the session was stopped before.
Operators delete earlier what no later step reads: see Tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.sources.shared import place, shared_folder


def saved(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def saved_in_buckets(df: DataFrame, key: str, n: int) -> DataFrame:
    """df in n buckets by key, a file each, in the shared folder; joins by key then don't move its rows.

    The catalog only lends its name to the reader: the entry goes at once, the files with the folder."""
    spark, name = df.sparkSession, f"barwright_{uuid.uuid4().hex}"
    df.repartition(n, F.col(key)).write.format("parquet").option("path", f"{shared_folder(spark)}/{name}").option("compression", "zstd").bucketBy(n, key).sortBy(key).saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved before the entry goes
    spark.sql(f"DROP TABLE {name}")  # an external table: its files stay
    return out


class Tables:
    """The tables that one call writes. On leaving the block, those that it was not told to keep are deleted."""

    def __init__(self) -> None:
        self.made: list[DataFrame] = []

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_) -> None:
        for df in self.made:
            drop(df)

    def saved(self, df: DataFrame) -> DataFrame:
        out = saved(df)
        self.made.append(out)
        return out

    def keep(self, *dfs: DataFrame) -> None:
        self.made = [x for x in self.made if not any(x is df for df in dfs)]


def drop(df: DataFrame) -> None:
    """Deletes a table that saved() wrote and that no later result reads."""
    target, system = place(df.sparkSession, df._saved_at)
    system.delete(target, True)
