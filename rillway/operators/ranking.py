"""Ranking, sets, samples."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillway.sources.sinks import work_folder


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each group; rows beyond n are dropped before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n).withColumn(name, F.col(name).cast("bigint"))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a that b doesn't have; repeated rows of a stay."""
    on = [a[c].eqNullSafe(b[c]) for c in a.columns]
    cond = on[0]
    for x in on[1:]:
        cond = cond & x
    return a.join(b, cond, "left_anti")


def keep(df: DataFrame, how: str = "persist") -> DataFrame:
    """df for repeated use: kept by the executors (persist), or written to the shared folder (checkpoint), which outlives them."""
    if how == "persist":
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    path = work_folder(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)
