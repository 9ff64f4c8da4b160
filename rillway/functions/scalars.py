"""Scalar functions of the event warehouse, on built-in expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillway.operators.search import tokens


def day(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def oplog_seconds(c: Column) -> Column:
    """The seconds in the upper half of a 64-bit log position."""
    return F.shiftright(c, 32)


def age(birthday: Column, as_of: Column) -> Column:
    """Whole years of 365 days."""
    return F.floor(F.datediff(as_of, birthday) / 365)


def date_columns(df: DataFrame, key: str, at: str) -> DataFrame:
    c = F.col(at)
    date = F.to_date(c)
    position = F.shiftleft(F.unix_timestamp(c.cast("timestamp")), 32)
    return df.select(
        key, day(c).alias("day"), F.date_format(c, "yyyy-MM-dd_HH").alias("date_hour"), F.datediff(F.lit("1998-12-01").cast("date"), date).cast("bigint").alias("days"),
        day(F.date_add(date, 7)).alias("plus_week"), day(F.add_months(date, 1)).alias("plus_month"), day(F.trunc(date, "month")).alias("month_first"),
        day(F.last_day(date)).alias("month_last"), day(F.trunc(date, "week")).alias("week_first"), day(F.trunc(date, "year")).alias("year_first"),
        F.signum(F.unix_timestamp(c.cast("timestamp")) - F.unix_timestamp(F.lit("1995-01-01").cast("timestamp"))).cast("bigint").alias("compared"),
        age(date, F.lit("2020-01-01").cast("date")).alias("age"), oplog_seconds(position).alias("oplog_s"),
    )


#: The digits of a phone number that stay, and what stands for the others.
PHONE, MASKED = r"(\d{3})\d{4}(\d{3})", "$1****$2"


def seconds_between(a: Column, b: Column) -> Column:
    """Whole seconds from a to b."""
    return F.timestamp_diff("SECOND", a, b)


def date_of_days(c: Column) -> Column:
    """A date that a change feed gives as days since 1970."""
    return F.date_from_unix_date(c)


def local_datetime(ms: Column, hours: int = 8) -> Column:
    """A local date-time that a change feed gives as if it were UTC."""
    return F.timestamp_millis(ms) - F.make_dt_interval(hours=F.lit(hours))


def local_timestamp(text: Column, hours: int = 8) -> Column:
    """A time written with Z, moved to local time."""
    return F.to_timestamp(text) + F.make_dt_interval(hours=F.lit(hours))


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x[:1].upper() + x[1:] for x in rest)


def camel_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*map(camel, df.columns))


def first_of(a: Column, b: Column, fields: list[str]) -> Column:
    """A struct whose fields are a's where they are set, b's otherwise."""
    return F.struct(*[F.coalesce(a[f], b[f]).alias(f) for f in fields])


def name_values(c: Column, null: str = "\\N") -> Column:
    """An array of (name, value) as a map; nulls are written out."""
    return F.map_from_arrays(F.transform(c, lambda x: x["name"]), F.transform(c, lambda x: F.coalesce(x["value"], F.lit(null))))


class SplitWords:
    """Table function: a text's words with their lengths, or, with a second argument, only words of that length."""

    def eval(self, text: str, length: int = 0):
        for word in (text or "").split():
            if not length or len(word) == length:
                yield word, len(word)


def register_table_functions(spark: SparkSession) -> None:
    spark.udtf.register("split_words", F.udtf(SplitWords, returnType="word string, n int"))


def mask_phone(c: Column) -> Column:
    return F.regexp_replace(c, PHONE, MASKED)


def pairs(c: Column, key: str) -> Column:
    """A value out of `k=v&k=v`."""
    return F.try_element_at(F.str_to_map(c, F.lit("&"), F.lit("=")), F.lit(key))


def decode_url(c: Column) -> Column:
    """URL decoding that takes a percent sign without two hex digits for itself."""
    return F.try_url_decode(F.regexp_replace(c, "%(?![0-9a-fA-F]{2})", "%25"))


def string_columns(customers: DataFrame) -> DataFrame:
    phone = F.concat(F.lit("1385555"), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"))
    return customers.select(
        "c_custkey", pairs(F.concat(F.lit("a=1&b=v"), "c_custkey"), "b").alias("looked_up"), mask_phone(phone).alias("masked"),
        F.btrim(F.concat(F.lit(",,"), "c_name", F.lit(",")), F.lit(",")).alias("trimmed"), F.regexp_replace(F.lit("a\r\n b\t"), r"[\r\n\t]", "").alias("cleaned"),
        decode_url(F.lit("x%3D1%26y+z")).alias("decoded"), F.upper(F.substring("c_name", 1, 4)).alias("head"), F.startswith("c_name", F.lit("Cust")).alias("starts"),
        F.contains("c_name", F.lit("1")).alias("has_one"), F.replace("c_mktsegment", F.lit("A"), F.lit("a")).alias("replaced"),
    )


def math_columns(lines: DataFrame) -> DataFrame:
    return lines.select(
        "l_orderkey", "l_linenumber", F.expr("l_partkey div 7").alias("whole"), F.ceil(F.col("l_quantity") / 4).alias("up"), F.floor(F.col("l_quantity") / 4).alias("down"),
        F.pow("l_linenumber", F.lit(3)).cast("bigint").alias("cubed"), F.abs(F.col("l_linenumber") - 4).cast("bigint").alias("distance"), (F.col("l_suppkey") % 5).alias("rest"),
        (F.col("l_partkey") / F.lit(7.0)).alias("ratio"), F.round(F.col("l_quantity") / 4, 1).alias("rounded"),
    )


def seeded(key: Column, seed: int) -> Column:
    """A number in [0, 1) for each key and seed, evenly spread; unlike rand(seed) it doesn't depend on how rows are dealt to tasks. Null for a null key."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("bigint") / F.lit(2.0**32)


def seeded_between(key: Column, seed: int, low: int, high: int) -> Column:
    """A whole number from low to high, both in."""
    return (F.floor(seeded(key, seed) * (high - low + 1)) + low).cast("bigint")


def seeded_choice(key: Column, seed: int, shares: dict[str, float]) -> Column:
    """One of the names, each as often as its share of all shares; the last for a null key."""
    roll, names, total, below = seeded(key, seed), list(shares), sum(shares.values()), 0.0
    out = None
    for name in names[:-1]:
        below += shares[name] / total
        out = F.when(roll < below, name) if out is None else out.when(roll < below, name)
    return F.lit(names[-1]) if out is None else out.otherwise(names[-1])


def json_columns(events: DataFrame) -> DataFrame:
    row = F.from_json("props", "k bigint, missing string")
    named = F.map_from_arrays(F.array(F.lit("type")), F.array("event_type"))
    return events.select("event_id", row["k"].alias("k"), F.to_json(row).alias("dropped"), F.to_json(row, {"ignoreNullFields": "false"}).alias("kept"), named["type"].alias("named"))


def encrypt(c: Column, key: str) -> Column:
    return F.base64(F.aes_encrypt(c, F.lit(key), F.lit("ECB"), F.lit("PKCS")))


def decrypt(c: Column, key: str) -> Column:
    return F.try_aes_decrypt(F.unbase64(c), F.lit(key), F.lit("ECB"), F.lit("PKCS")).cast("string")


def keywords(text: str, whole: bool = True) -> Column:
    """Rows of a text's lower-case words; where there is none the whole text, or nothing without whole."""
    words = F.filter(tokens(text), lambda w: w != "")
    return F.explode(words if not whole else F.when(F.size(words) > 0, words).otherwise(F.array(text)))


@F.pandas_udf(T.StringType())
def middle(text: pd.Series, begin: pd.Series, end: pd.Series) -> pd.Series:
    if begin.nunique() == 1 and end.nunique() == 1:
        return text.str.slice(int(begin.iloc[0]), int(end.iloc[0]))
    return pd.Series([None if t is None else t[b:e] for t, b, e in zip(text, begin, end)])


@F.pandas_udf(T.DoubleType())
def truncated_mean(total: pd.Series, n: pd.Series) -> float:
    """Grouped aggregate of partial sums and counts: the mean of whole numbers, cut to a whole number."""
    return float(int(total.sum()) // max(1, int(n.sum())))
