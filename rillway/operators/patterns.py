"""Event patterns over the ordered rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def consecutive(df: DataFrame, key: str, order: list[str], secs: str, hit: Column, times: int, within: int) -> DataFrame:
    """Each row that ends `times` hits in a row within so many seconds (both ends in); matches may overlap."""
    w = Window.partitionBy(key).orderBy(*order)
    d = df.withColumn("_hit", hit.cast("int"))
    first = F.lag(secs, times - 1).over(w)
    in_a_row = F.sum("_hit").over(w.rowsBetween(-(times - 1), 0))
    return d.withColumn("first_s", first).withColumn("_n", in_a_row).where((F.col("_n") == times) & (F.col(secs) - F.col("first_s") <= within)).drop("_hit", "_n")


def followed_by(first: DataFrame, then: DataFrame, key: str, first_s: str, then_s: str, within: int) -> DataFrame:
    """Each row of first with the earliest row of then in (0, within] seconds after it, or null."""
    both = first.select(key, F.col(first_s).alias("_s"), F.lit(0).alias("_side")).unionByName(then.select(key, F.col(then_s).alias("_s"), F.lit(1).alias("_side")))
    w = Window.partitionBy(key).orderBy("_s").rangeBetween(1, within)
    nxt = F.min(F.when(F.col("_side") == 1, F.col("_s"))).over(w)
    return both.withColumn("then_s", nxt).where("_side = 0").select(key, F.col("_s").alias("first_s"), "then_s")


def streak(df: DataFrame, key: str, order: list[str], hit: Column, at_least: int) -> DataFrame:
    """Rows at place at_least or later in a run of hits; a miss starts a new run."""
    w = Window.partitionBy(key).orderBy(*order)
    d = df.withColumn("_hit", hit).withColumn("_run", F.sum(F.when(hit, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy(key, "_run", "_hit").orderBy(*order))
    return d.withColumn("place", place.cast("bigint")).where(F.col("_hit") & (F.col("place") >= at_least)).drop("_hit", "_run")


def bounces(pages: DataFrame, key: str, order: list[str], secs: str, within: int) -> DataFrame:
    """Entry pages followed by another entry page, or by nothing within so many seconds."""
    w = Window.partitionBy(key).orderBy(*order)
    d = pages.withColumn("_next_s", F.lead(secs).over(w)).withColumn("_next_entry", F.lead(F.col("last_page_id").isNull()).over(w))
    gone = F.col("_next_s").isNull() | F.col("_next_entry") | (F.col("_next_s") - F.col(secs) > within)
    return d.where(F.col("last_page_id").isNull() & gone).drop("_next_s", "_next_entry")


def lone_entries(pages: DataFrame, key: str, order: list[str], secs: str, within: int) -> DataFrame:
    """Entry pages followed by no page at all within so many seconds."""
    nxt = F.lead(secs).over(Window.partitionBy(key).orderBy(*order))
    d = pages.withColumn("_next_s", nxt)
    return d.where(F.col("last_page_id").isNull() & (F.col("_next_s").isNull() | (F.col("_next_s") - F.col(secs) > within))).drop("_next_s")


def next_is(df: DataFrame, key: str, order: list[str], column: str, first: str, then: str) -> DataFrame:
    nxt = F.lead(column).over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_next", nxt).where((F.col(column) == first) & (F.col("_next") == then)).drop("_next")
