"""Joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillway.operators.ranges import before_range, in_ranges

BLOCKS = 4  # pairs of blocks that a task of dealt_join makes, on an average


def interval_join(left: DataFrame, right: DataFrame, key: str, left_s: str, right_s: str, low: int, high: int, how: str = "inner", row: list[str] | None = None) -> DataFrame:
    """Rows of one key whose right time lies within [left + low, left + high] seconds, both ends in.

    Time is cut into buckets as wide as the interval and each left row goes to the two or three buckets that it can
    reach, so that a hot key is spread over its buckets and the join stays an equality. how is inner, or left with row,
    the columns that tell left rows apart.
    """
    if how not in ("inner", "left") or (how == "left" and not row):
        raise ValueError("how is inner, or left with the columns that tell left rows apart")
    width = max(1, high - low)
    l = left.withColumn("_n", F.explode(F.sequence(F.floor((F.col(left_s) + low) / width), F.floor((F.col(left_s) + high) / width))))
    r = right.withColumn("_m", F.floor(F.col(right_s) / width)).withColumnRenamed(key, "_key")
    on = (l[key] == r["_key"]) & (l["_n"] == r["_m"]) & r[right_s].between(l[left_s] + low, l[left_s] + high)
    both = l.join(r, on).drop("_n", "_m", "_key")
    if how == "inner":
        return both
    return both.unionByName(left.join(both.select(*row).distinct(), row, "left_anti"), allowMissingColumns=True)


def dealt_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, block: int = 4096) -> DataFrame:
    """Inner join of keys that have very many rows on both sides: all columns of both, a row for each pair.

    A key's rows are dealt to blocks of about so many by a hash, and each block of one side meets each block of the other: a task holds a
    few blocks and makes a bounded number of pairs, however many rows a key has. The rows are dealt on as often as the other side has blocks.
    """
    count = lambda df, key, n: df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.ceil(F.count("*") / block).cast("int").alias(n))
    blocks = count(left, left_key, "_a").join(count(right, right_key, "_b"), "_k").select("_k", "_a", "_b")
    pairs = blocks.agg(F.sum(F.col("_a").cast("bigint") * F.col("_b"))).first()[0] or 0
    tasks = int(max(1, -(-pairs // BLOCKS)))

    def dealt(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        place = F.pmod(F.xxhash64(*[c for c, t in df.dtypes if "map<" not in t]), F.col(f"_{own}")).cast("int")
        rows = df.join(blocks, df[key] == F.col("_k")).withColumn(f"_{own}_at", place).withColumn(f"_{other}_at", F.explode(F.sequence(F.lit(0), F.col(f"_{other}") - 1)))
        return rows.drop("_a", "_b").repartition(tasks, "_k", "_a_at", "_b_at")

    l, r = dealt(left, left_key, "a", "b"), dealt(right, right_key, "b", "a")
    return l.hint("shuffle_hash").join(r, ["_k", "_a_at", "_b_at"]).drop("_k", "_a_at", "_b_at")


def reconcile(left: DataFrame, right: DataFrame, key: str, left_s: str, right_s: str, before: int, after: int, left_row: list[str], right_row: list[str]) -> DataFrame:
    """Every row of both sides with status matched, left_only or right_only; partners lie in [left - before, left + after].

    left_row and right_row are the columns that tell each side's rows apart. A hot key is spread over buckets of time.
    """
    both = interval_join(left, right, key, left_s, right_s, -before, after)
    alone = lambda side, row, status: side.join(both.select(*row).distinct(), row, "left_anti").withColumn("status", F.lit(status))
    out = both.withColumn("status", F.lit("matched"))
    return out.unionByName(alone(left, left_row, "left_only"), allowMissingColumns=True).unionByName(alone(right, right_row, "right_only"), allowMissingColumns=True)


def as_of_control(main: DataFrame, control: DataFrame, main_s: str, control_s: str, word: str, chunk: int | None = None) -> DataFrame:
    """main with the control word that held at each row's time (the last one before or at it; null if none).

    Both are laid out by time and the last word is carried forward: inside ranges of time that hold about as many rows
    each, then from range to range, of which there are few. Of words of the same second the largest holds.
    """
    c = control.groupBy(F.col(control_s).alias("_t")).agg(F.struct(F.max(word).alias("w")).alias("_w"))
    m = main.select(F.col(main_s).alias("_t"), F.lit(None).cast(c.schema["_w"].dataType).alias("_w"), F.struct(*main.columns).alias("_row"))
    both = m.unionByName(c, allowMissingColumns=True).withColumn("_main", F.col("_row").isNotNull())
    both = in_ranges(both, ["_t", "_main"], chunk)
    before = before_range(both, F.max_by("_w", F.when(F.col("_w").isNotNull(), F.col("_t"))), lambda f: F.last(f, ignorenulls=True))
    inside = F.last("_w", ignorenulls=True).over(Window.partitionBy("_p").orderBy("_t", "_main"))
    carried = both.withColumn("_in", inside).join(before, "_p").where("_main")
    return carried.select("_row.*", F.coalesce("_in", "_before")["w"].alias(word))


def ip_to_long(ip: str):
    p = F.split(ip, r"\.")
    at = lambda i: F.get(p, F.lit(i)).try_cast("bigint")
    return ((at(0) * 256 + at(1)) * 256 + at(2)) * 256 + at(3)


def range_join(df: DataFrame, value: str, ranges: DataFrame, low: str, high: str, bucket: int = 1 << 16) -> DataFrame:
    """df with the range that holds value (inclusive); ranges are cut into buckets, so the join is an equality first."""
    r = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / bucket), F.floor(F.col(high) / bucket))))
    d = df.withColumn("_b", F.floor(F.col(value) / bucket))
    cond = (d["_b"] == r["_b"]) & d[value].between(r[low], r[high])
    return d.join(r, cond, "left").drop("_b")


def cogroup(a: DataFrame, b: DataFrame, key: str, value_a: str, value_b: str) -> DataFrame:
    """key with the sorted values of both sides, empty where a side has none."""
    x = a.groupBy(key).agg(F.sort_array(F.collect_list(value_a)).alias("left"))
    y = b.groupBy(key).agg(F.sort_array(F.collect_list(value_b)).alias("right"))
    return x.join(y, key, "full").select(key, F.coalesce("left", F.array()).alias("left"), F.coalesce("right", F.array()).alias("right"))


def cogroup_parts(a: DataFrame, b: DataFrame, key: str, value_a: str, value_b: str, size: int = 10_000) -> DataFrame:
    """cogroup for keys of any number of rows: key, part (from 0), left, right; part i holds the sorted values i * size and on of each side.

    Values are numbered by ranges of (key, value), so that no task gathers a key and no row holds more than size values of a side;
    equal values are dealt over several ranges. Null values are left out, as collect_list does; null keys match nothing.
    """

    def side(df: DataFrame, value: str, name: str) -> DataFrame:
        rows = numbered(df.select(F.col(key).alias("_k"), F.col(value).alias("_v"), F.rand(7).alias("_u")).where("_v IS NOT NULL"), ["_k", "_v", "_u"])
        first = rows.groupBy(F.col("_k").alias("_f")).agg(F.min("idx").alias("_low"))
        rows = rows.join(first, F.col("_k").eqNullSafe(F.col("_f"))).withColumn("part", F.floor((F.col("idx") - F.col("_low")) / size))
        return rows.groupBy(F.col("_k").alias(key), "part").agg(F.sort_array(F.collect_list("_v")).alias(name))

    both = side(a, value_a, "left").join(side(b, value_b, "right"), [key, "part"], "full")
    return both.select(key, "part", F.coalesce("left", F.array()).alias("left"), F.coalesce("right", F.array()).alias("right"))


def numbered(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """Rows numbered in order from 0, without one task seeing them all: counts of ranges, then places inside each."""
    parts = in_ranges(df, order)
    inside = parts.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    before = before_range(parts, F.count("*"), F.sum)
    return inside.join(before, "_p").withColumn(name, (F.coalesce("_before", F.lit(0)) + F.col("_i") - 1).cast("bigint")).drop("_p", "_i", "_before")
