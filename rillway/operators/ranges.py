"""Rows cut into ranges of an order, each of about as many rows, so that running figures need no task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillway.sources.sinks import work_folder


def in_ranges(df: DataFrame, order: list[Column | str], chunk: int | None = None) -> DataFrame:
    """df with `_p`, the number of its range. Written, so that all that is made of it comes from the same ranges, whatever runs again.

    There are as many ranges as the session has shuffle partitions, or with chunk, so many that each has about that many rows.
    """
    path = work_folder(df.sparkSession, "ranges")
    many = [max(1, -(-df.count() // chunk))] if chunk else []
    ranged = df.repartitionByRange(*many, *order).withColumn("_p", F.spark_partition_id())
    ranged.write.parquet(path)
    return df.sparkSession.read.schema(ranged.schema).parquet(path)


def before_range(ranged: DataFrame, figure: Column, running) -> DataFrame:
    """_p, _before: running (such as F.max) over the figures of all ranges before each one. Ranges are few: one row a task."""
    heads = ranged.groupBy("_p").agg(figure.alias("_f"))
    return heads.select("_p", running("_f").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
