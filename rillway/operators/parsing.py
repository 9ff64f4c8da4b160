"""Parsing, filtering and splitting of raw rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def delimited(lines: DataFrame, schema: str, sep: str = ",", column: str = "line") -> DataFrame:
    """Typed rows of a delimited line; a field that can't be cast is null."""
    parts = F.split(column, sep)
    fields = T.StructType.fromDDL(schema).fields
    return lines.select(*[F.get(parts, F.lit(i)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(fields)])


def access_log(lines: DataFrame, column: str = "line") -> DataFrame:
    """`ip - user time zone method url`, separated by spaces, time as dd/MM/yyyy:HH:mm:ss."""
    p = F.split(column, " ")
    return lines.select(
        F.get(p, F.lit(0)).alias("ip"), F.get(p, F.lit(2)).alias("user_id"), F.get(p, F.lit(5)).alias("method"),
        F.get(p, F.lit(6)).alias("url"), F.try_to_timestamp(F.get(p, F.lit(3)), F.lit("dd/MM/yyyy:HH:mm:ss")).alias("ts"),
    )


def json_rows(df: DataFrame, column: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a parsed struct `row`, rows whose text is not a JSON object)."""
    parsed = df.withColumn("_ok", F.try_parse_json(column).isNotNull() & F.col(column).rlike(r"^\s*\{"))
    good = parsed.where("_ok").drop("_ok").withColumn("row", F.from_json(column, schema))
    return good, parsed.where(~F.coalesce("_ok", F.lit(False))).drop("_ok")


def without_static(df: DataFrame, url: str = "url", endings: str = "css|js|png|ico", method: str | None = None) -> DataFrame:
    """Rows whose url is no static resource; with method, a column, only GET requests."""
    kept = df.where(~F.col(url).rlike(rf"\.({endings})$"))
    return kept.where(F.col(method) == "GET") if method else kept


def own_day(df: DataFrame, body: str) -> DataFrame:
    """df with dt, the day of the time (ts, ms) inside a JSON body; rows whose body is no JSON go."""
    ts = F.get_json_object(body, "$.ts").try_cast("bigint")
    return df.where(F.try_parse_json(body).isNotNull()).withColumn("dt", F.date_format(F.timestamp_millis(ts), "yyyyMMdd"))


def batch_rows(df: DataFrame, message: str, columns: list[str]) -> DataFrame:
    """Text lines of the rows in messages of a change log: chosen columns, then database, table, type and time; schema changes skipped."""
    m = F.from_json(message, "isDdl boolean, database string, `table` string, type string, ts bigint, data array<map<string,string>>")
    d = df.select(m.alias("m")).where("NOT coalesce(m.isDdl, false)").select("m", F.explode("m.data").alias("row"))
    d = d.select(*[F.try_element_at("row", F.lit(c)).alias(c) for c in columns], "m.database", "m.table", "m.type", "m.ts")
    return d.select(text_rows(d, d.columns).alias("line"))


def prune_map(data: Column, keep: Column) -> Column:
    """The entries of a map whose keys stand in a comma-separated list."""
    wanted = F.transform(F.split(keep, ","), lambda x: F.trim(x))
    return F.map_filter(data, lambda k, v: F.array_contains(wanted, k))


def version_gate(df: DataFrame, version: str, major: int = 11, minor: int = 6) -> DataFrame:
    """Rows without a version, below the major one, or at it or above with a lower minor number."""
    p = F.split(version, r"\.")
    a, b = F.get(p, F.lit(0)).try_cast("int"), F.get(p, F.lit(1)).try_cast("int")
    return df.where(F.col(version).isNull() | (a < major) | ((a >= major) & (b < minor)))


def type_tag(body: Column, word: str = "start") -> Column:
    """word where the body holds it, event otherwise and for a null body."""
    return F.when(F.contains(body, F.lit(word)), word).otherwise("event")


def split_log(log: DataFrame) -> dict[str, DataFrame]:
    """error, start, display, action and page rows of a parsed log.

    Columns of log: common, ts, page, start, err, displays, actions. A row with an error also goes its other way;
    start rows are not pages; each display and action carries the page.
    """
    page = log.where("start IS NULL AND page IS NOT NULL")
    return {
        "error": log.where("err IS NOT NULL").select("common", "err", "ts"),
        "start": log.where("start IS NOT NULL").select("common", "start", "ts"),
        "display": page.select("common", "page", "ts", F.explode("displays").alias("display")),
        "action": page.select("common", "page", F.explode("actions").alias("action")),
        "page": page.select("common", "page", "ts"),
    }


def request_body(df: DataFrame, column: str, fields: list[str]) -> DataFrame:
    """`k=v&k=v&e=<url-encoded JSON array>`: one row for each element of e; what is missing is `-`."""
    pairs = F.str_to_map(column, F.lit("&"), F.lit("="))
    items = F.from_json(F.try_url_decode(F.try_element_at(pairs, F.lit("e"))), "array<map<string,string>>")
    d = df.withColumn("_p", pairs).withColumn("_e", F.explode(items))
    value = lambda k: F.coalesce(F.try_element_at("_e", F.lit(k)), F.try_element_at("_p", F.lit(k)), F.lit("-"))
    return d.select(*[c for c in df.columns if c != column], *[value(k).alias(k) for k in fields])


def text_rows(df: DataFrame, columns: list[str], null: str = "\\N", sep: str = "\x01") -> Column:
    """Columns as one text line: nulls written out, line breaks removed."""
    return F.concat_ws(sep, *[F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"[\r\n\t]", ""), F.lit(null)) for c in columns])


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
