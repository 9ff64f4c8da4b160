"""Aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rolling(df: DataFrame, key: str, order: list[str], agg: Column, name: str) -> DataFrame:
    """A value for each row, over all rows of its key up to it."""
    return df.withColumn(name, agg.over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def two_level(df: DataFrame, bucket: str, key: str, value: str) -> DataFrame:
    """The sum over buckets of the largest value in each."""
    return df.groupBy(bucket, key).agg(F.max(value).alias("m")).groupBy(key).agg(F.sum("m").alias("total"))


def split_distinct(df: DataFrame, keys: list[str], of: str, buckets: int = 64) -> DataFrame:
    """Distinct count in two steps, so that a hot key is counted by many tasks."""
    part = df.groupBy(*keys, F.pmod(F.hash(of), F.lit(buckets)).alias("_b")).agg(F.count_distinct(of).alias("n"))
    return part.groupBy(*keys).agg(F.sum("n").alias("n"))


def salted_count(df: DataFrame, keys: list[str], salt: Column) -> DataFrame:
    """Counts by key and salt, then by key."""
    return df.groupBy(*keys, salt.alias("_salt")).agg(F.count("*").alias("n")).groupBy(*keys).agg(F.sum("n").alias("cnt"))


def integer_average(value: str) -> Column:
    return F.expr(f"sum({value}) div count({value})")
