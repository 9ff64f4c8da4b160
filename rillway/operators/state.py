"""First, last and seen-before rows of a key. Batch forms see all rows; the streaming twins forget after a time to live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The earliest row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by aggregation: only one row a key and task is shuffled."""
    rest = [c for c in df.columns if c not in keys]
    packed = F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def repair_is_new(df: DataFrame, key: str, order: list[str], day: Column, is_new: str) -> DataFrame:
    """is_new is 0 where the key was seen on an earlier day; a key whose first row is old was seen the day before it."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    first = F.first(F.struct(day.alias("day"), F.col(is_new).alias("new"))).over(w)
    d = df.withColumn("_f", first)
    seen = F.when(F.col("_f.new") == 1, F.col("_f.day")).otherwise(F.date_sub("_f.day", 1))
    return d.withColumn("fixed", F.when((F.col(is_new) == 1) & (day != seen), 0).otherwise(F.col(is_new)).cast("bigint")).drop("_f")


def capped(df: DataFrame, keys: list, order: list[str], cap: int) -> tuple[DataFrame, DataFrame]:
    """(the first cap rows of each key, one alert row for each key that has more)."""
    d = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return d.where(F.col("_n") <= cap).drop("_n"), d.where(F.col("_n") == cap + 1).drop("_n")


def days_away(df: DataFrame, user: str, day: Column) -> DataFrame:
    """Each user's distinct days with the days since the one before."""
    d = df.select(user, day.alias("day")).distinct()
    return d.withColumn("away", F.datediff("day", F.lag("day").over(Window.partitionBy(user).orderBy("day"))).cast("bigint"))
