"""Time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillway.operators.ranges import before_range, in_ranges


def windowed(df: DataFrame, ts: str, size: str, slide: str | None, keys: list[str], aggs: list[Column]) -> DataFrame:
    """Aggregates for each window and key: window_start, window_end, keys, aggs. Partial sums run before the shuffle."""
    g = df.groupBy(F.window(ts, size, slide or size), *keys).agg(*aggs)
    return g.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in g.columns if c != "window"])


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], aggs: list[Column]) -> DataFrame:
    g = df.groupBy(F.session_window(ts, gap), *keys).agg(*aggs)
    return g.select(F.col("session_window.start").alias("window_start"), F.col("session_window.end").alias("window_end"), *[c for c in g.columns if c != "session_window"])


def cumulative(df: DataFrame, secs: Column, step: int, size: int, keys: list[str], aggs: list[Column]) -> DataFrame:
    """Windows that start at multiples of size seconds and grow by step: start_s, end_s, keys, aggs."""
    start = secs - F.pmod(secs, F.lit(size))
    first = secs - F.pmod(secs, F.lit(step)) + step
    d = df.withColumn("start_s", start).withColumn("end_s", F.explode(F.sequence(first, start + size, F.lit(step))))
    return d.groupBy("start_s", "end_s", *keys).agg(*aggs)


def floored(df: DataFrame, secs: Column, size: int, keys: list[str], aggs: list[Column]) -> DataFrame:
    """Tumbling windows by arithmetic on a plain column."""
    return df.groupBy((secs - F.pmod(secs, F.lit(size))).alias("start_s"), *keys).agg(*aggs)


def unique_counts(df: DataFrame, secs: Column, size: int, key: str, rsd: float, salts: int = 8) -> DataFrame:
    """start_s, uv, exact: distinct keys of each tumbling window, by a sketch with that relative error and exactly.

    Each key is taken once in its window before anything is counted, so that there are as many sketches as windows and salts, not one for each key.
    """
    start = (secs - F.pmod(secs, F.lit(size))).alias("start_s")
    once = df.select(start, F.pmod(F.xxhash64(key), F.lit(salts)).alias("_salt"), key).repartition("start_s", "_salt").distinct()
    return once.groupBy("start_s").agg(F.approx_count_distinct(key, rsd).alias("uv"), F.count(key).alias("exact"))


def running_average(df: DataFrame, secs: Column, bucket: int, value: str, key: str) -> DataFrame:
    """key, start_s, avg of all values up to the end of each bucket: sums by bucket first, then a running window."""
    b = df.groupBy(key, (secs - F.pmod(secs, F.lit(bucket))).alias("start_s")).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    w = Window.partitionBy(key).orderBy("start_s")
    return b.select(key, "start_s", (F.sum("s").over(w) / F.sum("n").over(w)).alias("running_avg"))


def mark_late(df: DataFrame, arrival: str, secs: str, size: int, slide: int, delay: int, lateness: int, seen: int | None = None, chunk: int | None = None) -> DataFrame:
    """df with `late`: all windows of the row were closed when it arrived.

    A row is late if its last window's end + lateness is at most the largest event time that arrived before, less the
    delay; seen is the largest one of before these rows. That running maximum is taken in two steps: maxima of ranges of the
    arrival order, which hold about as many rows each, then inside each range.
    """
    d = in_ranges(df, [arrival, secs], chunk)
    inside = F.max(secs).over(Window.partitionBy("_p").orderBy(arrival, secs).rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_inside", inside).join(before_range(d, F.max(secs), F.max), "_p")
    last_end = F.col(secs) - F.pmod(F.col(secs), F.lit(slide)) + size
    so_far = F.greatest("_before", "_inside", F.lit(seen).cast("bigint"))
    return d.withColumn("late", F.coalesce(last_end + lateness <= so_far - delay, F.lit(False))).select(*df.columns, "late")


def late_rows(df: DataFrame, arrival: str, secs: str, size: int, slide: int, delay: int, lateness: int, chunk: int | None = None) -> DataFrame:
    """Rows all of whose windows were closed when they arrived."""
    return mark_late(df, arrival, secs, size, slide, delay, lateness, chunk=chunk).where("late").drop("late")


def panes(df: DataFrame, secs: Column, size: int, slide: int, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """start_s, end_s, keys, sums for each sliding window with rows in it; each row is added once, to its pane of one slide.

    A pane's sums enter the running sums with the first window that holds it and are taken out again behind the last one.
    Between two such points the sums stay as they are, and the windows that start there are written out. size is a
    multiple of slide. Sums of floating-point numbers come out only nearly equal, as what is taken out may not cancel.
    """
    if size % slide:
        raise ValueError("the window's size must be a multiple of its slide")
    pane = (secs - F.pmod(secs, F.lit(slide))).alias("_pane")
    p = df.groupBy(pane, *keys).agg(F.count("*").alias("_rows"), *[F.sum(c).alias(n) for n, c in sums.items()])
    names = ["_rows", *sums]
    change = lambda at, sign: F.struct((F.col("_pane") + at).alias("start_s"), *[(sign * F.coalesce(n, F.lit(0))).alias(n) for n in names])
    steps = p.select(*keys, F.explode(F.array(change(slide - size, 1), change(slide, -1))).alias("_c")).select(*keys, "_c.*")
    steps = steps.groupBy(*keys, "start_s").agg(*[F.sum(n).alias(n) for n in names])
    w = Window.partitionBy(*keys).orderBy("start_s")
    so_far = [F.sum(n).over(w).alias(n) for n in names]
    held = steps.select(*keys, "start_s", F.lead("start_s").over(w).alias("_next"), *so_far).where("_rows > 0")
    out = held.withColumn("start_s", F.explode(F.sequence("start_s", F.col("_next") - slide, F.lit(slide))))
    return out.select("start_s", (F.col("start_s") + size).alias("end_s"), *keys, *sums)
