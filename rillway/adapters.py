"""The test tables in the shapes that the operators expect."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIX_HOURS = 6 * 3600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, user_id, event_type, value, k (the item)."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def fresh_name() -> str:
    """A name for a view or table of which a second run in the same session takes another."""
    return f"rillway_{uuid.uuid4().hex}"


def seconds(c: str = "ts"):
    """Whole seconds since 1970 of a time without zone."""
    return F.unix_timestamp(F.col(c).cast("timestamp"))


def page_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as page views: mid, page_id, last_page_id (null on entry: first of a user, or after six hours), dims, ts."""
    e = events(spark, sf_dir)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    near = seconds() - F.lag(seconds()).over(w) <= SIX_HOURS
    return e.select(
        "event_id",
        F.col("user_id").alias("mid"),
        F.col("event_type").alias("page_id"),
        F.when(near, F.lag("event_type").over(w)).alias("last_page_id"),
        (F.col("user_id") % 3).alias("ch"),
        (F.col("user_id") % 5).alias("ar"),
        (F.col("user_id") % 2).alias("vc"),
        ((F.col("user_id") + F.col("event_id")) % 2).alias("is_new"),
        F.col("value").cast("bigint").alias("during_time"),
        "ts",
        "k",
    )


def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a change feed: an insert for each, an update for those in status F or P, a delete for every tenth.

    table string, type string, data map<string,string>, old map<string,string>, ts timestamp, seq bigint
    """
    o = table(spark, sf_dir, "orders")

    def data(status):
        return F.create_map(
            F.lit("id"), F.col("o_orderkey").cast("string"), F.lit("user_id"), F.col("o_custkey").cast("string"),
            F.lit("status"), status, F.lit("total"), F.round("o_totalprice").cast("bigint").cast("string"),
            F.lit("priority"), F.col("o_orderpriority"),
        )

    none = F.lit(None).cast("map<string,string>")
    key = F.col("o_orderkey")
    cols = lambda type_, d, old, day, seq: [F.lit("order_info").alias("table"), F.lit(type_).alias("type"), d.alias("data"), old.alias("old"), (F.col("o_orderdate") + F.expr(f"INTERVAL {day} DAY")).alias("ts"), (key * 3 + seq).alias("seq")]
    inserts = o.select(*cols("insert", data(F.lit("O")), none, 0, 0))
    updates = o.where("o_orderstatus <> 'O'").select(*cols("update", data(F.col("o_orderstatus")), F.create_map(F.lit("status"), F.lit("O")), 1, 1))
    deletes = o.where("o_orderkey % 10 = 0").select(*cols("delete", data(F.col("o_orderstatus")), none, 2, 2))
    return inserts.unionByName(updates).unionByName(deletes)
