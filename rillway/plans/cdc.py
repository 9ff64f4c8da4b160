"""Queries: change feeds, upserts, routed and partitioned writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillway.adapters import change_feed, events, fresh_name, table
from rillway.operators import cdc, ranking
from rillway.registry import FEED, ORACLES, query
from rillway.sources import sinks
from rillway.streaming import twins

def _flat():
    return [F.col("data")["id"].cast("bigint").alias("id"), F.col("data")["status"].alias("status"), "type", "seq"]


@query(f"WITH {FEED} SELECT 'shop' AS database, 'order_info' AS \"table\", type, id, status FROM feed")
def cdc_normalize(spark, d):
    f = change_feed(spark, d)
    op = F.when(F.col("type") == "insert", "c").when(F.col("type") == "update", "u").otherwise("d")
    none = F.lit(None).cast("map<string,string>")
    records = f.select(F.struct(F.lit("shop").alias("db"), "table").alias("source"), op.alias("op"), F.when(op == "d", F.col("data")).otherwise(none).alias("before"), F.when(op != "d", F.col("data")).otherwise(none).alias("after"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    return cdc.normalize(records, ["shop"], ["order_info"]).select("database", "table", "type", F.col("data")["id"].cast("bigint").alias("id"), F.col("data")["status"].alias("status"))


@query(f"WITH {FEED}, l AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS n FROM feed) SELECT id, status FROM l WHERE n = 1 AND type <> 'delete'")
def cdc_apply(spark, d):
    return cdc.apply_changes(change_feed(spark, d).select(*_flat()), "id", "seq").select("id", "status")


@query(f"WITH {FEED}, l AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS n FROM feed) SELECT id, 'status=' || status AS value FROM l WHERE n = 1 AND type <> 'delete'")
def upsert_fold(spark, d):
    """(key, value or null) rows of an upsert topic, folded by key; null deletes."""
    f = change_feed(spark, d).select(*_flat())
    topic = f.select("id", "seq", F.when(F.col("type") != "delete", F.to_json(F.struct("status"))).alias("value"))
    last = topic.groupBy("id").agg(F.max_by(F.struct("value"), "seq").alias("v")).where("v.value IS NOT NULL")
    return last.select("id", F.concat(F.lit("status="), F.get_json_object("v.value", "$.status")).alias("value"))


@query(f"WITH {FEED}, r AS (SELECT id % 100 AS k, strftime(ts, '%Y%m') AS dt, id AS ver FROM feed) SELECT k, dt, max(ver) AS ver FROM r GROUP BY 1, 2")
def replacing_merge(spark, d):
    """Rows of one sort key and month: the one with the largest version stays."""
    from rillway.operators.state import latest_by

    f = change_feed(spark, d).select((F.col("data")["id"].cast("bigint") % 100).alias("k"), F.date_format("ts", "yyyyMM").alias("dt"), F.col("data")["id"].cast("bigint").alias("ver"))
    return latest_by(f, ["k", "dt"], ["ver"])


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN 'MOVED' ELSE c_mktsegment END AS segment FROM customer")
def keyed_upsert(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_mktsegment").alias("segment"), F.lit(1).alias("v"))
    new = c.where("c_custkey % 3 = 0").withColumn("segment", F.lit("MOVED")).withColumn("v", F.lit(2))
    return cdc.upsert(c, new, "c_custkey", "v").drop("v")


CONFIG = [("order_info", "dim_old", "id", "id", "c", 1), ("order_info", "dim_order", "id,status", "id", "u", 2), ("user_info", "dim_user", "id", "id", "c", 3), ("user_info", "dim_user", "id", "id", "d", 4)]


def _config(spark):
    """The control table after its own changes."""
    return cdc.current_config(spark.createDataFrame(CONFIG, "source_table string, sink_table string, sink_columns string, sink_pk string, op string, seq int"))


@query(f"WITH {FEED} SELECT 'dim_order' AS sink_table, 'id' AS sink_pk, type, id, status, NULL::VARCHAR AS total FROM feed")
def dim_route(spark, d):
    r = cdc.route_dimensions(change_feed(spark, d), _config(spark))
    at = lambda k: F.try_element_at("data", F.lit(k))
    return r.select("sink_table", "sink_pk", "type", at("id").cast("bigint").alias("id"), at("status").alias("status"), at("total").alias("total"))


@query(f"WITH {FEED}, l AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS n FROM feed) SELECT 'dim_order' AS sink_table, id, status FROM l WHERE n = 1 AND type <> 'delete'")
def dim_upsert(spark, d):
    """Each change put into the table that its row names, read back from there."""
    root = sinks.work_folder(spark, "dimensions")
    cdc.write_dimensions(root)(cdc.dimension_rows(cdc.route_dimensions(change_feed(spark, d), _config(spark))), 0)
    return cdc.read_dimensions(spark, root).select("sink_table", F.col("pk").cast("bigint").alias("id"), F.try_element_at("data", F.lit("status")).alias("status"))


@query(f"WITH {FEED} SELECT 'dwd_order_info_' || type AS sink, id, seq FROM feed")
def route_by_table(spark, d):
    """Each change in the folder that its table and type name, read back from there."""
    f = change_feed(spark, d).select(F.concat(F.lit("dwd_"), "table", F.lit("_"), "type").alias("sink"), F.col("data")["id"].cast("bigint").alias("id"), "seq")
    root = sinks.write_routed(f, "sink", sinks.work_folder(spark, "routed"))
    return spark.read.schema("id bigint, seq bigint, sink string").parquet(root)


@query("SELECT strftime(ts, '%Y%m%d') AS dt, count(*) AS n FROM events GROUP BY 1")
def sink_partitioned(spark, d):
    """Events written by day of their own time, and counted from the files."""
    e = events(spark, d).withColumn("dt", F.date_format("ts", "yyyyMMdd"))
    path = sinks.write_partitioned(e, ["dt"], sinks.work_folder(spark, "by_day"))
    return spark.read.schema("event_id bigint, dt string").parquet(path).groupBy("dt").agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type, strftime(ts, '%Y%m%d') AS dt FROM events")
def compact_partition(spark, d):
    """Small files of each day rewritten as one; the rows are the same."""
    e = events(spark, d).select("event_id", "event_type", F.date_format("ts", "yyyyMMdd").alias("dt"))
    path = sinks.write_partitioned(e.repartition("event_id"), ["dt"], sinks.work_folder(spark, "small"))
    return spark.read.schema("event_id bigint, event_type string, dt string").parquet(sinks.compact(spark, path, ["dt"], sinks.work_folder(spark, "large")))


def _new_table(spark):
    return fresh_name(), sinks.work_folder(spark, "table")


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1")
def src_table(spark, d):
    """One partition of a catalog table, read by name."""
    name, path = _new_table(spark)
    sinks.save(table(spark, d, "events").select("event_id", "user_id", "event_type"), name, "overwrite", path, ["event_type"])
    n = spark.table(name).where("event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("n"))
    n = ranking.keep(n, "checkpoint")
    spark.sql(f"DROP TABLE {name}")
    return n


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1")
def src_view(spark, d):
    """A view registered under a name and read by SQL."""
    name = fresh_name()
    events(spark, d).createOrReplaceTempView(name)
    n = spark.sql(f"SELECT user_id, count(*) AS n FROM {name} WHERE event_type = 'view' GROUP BY user_id")
    spark.catalog.dropTempView(name)
    return n


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y%m') AS dt FROM orders)
 SELECT * FROM o WHERE o_orderstatus = 'P' UNION ALL SELECT * FROM o WHERE o_orderstatus <> 'P' AND dt NOT IN (SELECT dt FROM o WHERE o_orderstatus = 'P')""")
def write_modes(spark, d):
    """A table written, appended to, and then partly replaced: months with an order of status P hold only those."""
    name, path = _new_table(spark)
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyyMM").alias("dt"))
    sinks.save(o.where("o_orderstatus = 'F'"), name, "overwrite", path, ["dt"])
    sinks.save(o.where("o_orderstatus = 'O'"), name, "append", path, ["dt"])
    sinks.insert(o.where("o_orderstatus = 'P'"), name, replace=True)
    spark.sql(f"DROP TABLE {name}")
    return spark.read.schema(o.schema).parquet(path)


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority AS priority FROM orders WHERE o_orderstatus <> 'P'")
def insert_rows(spark, d):
    """Rows inserted into a table partition by partition."""
    name, path = _new_table(spark)
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderpriority").alias("priority"))
    sinks.save(o.limit(0), name, "overwrite", path, ["priority"])
    for status in ("F", "O"):
        sinks.insert(o.where(F.col("o_orderstatus") == status), name)
    spark.sql(f"DROP TABLE {name}")
    return spark.read.schema(o.schema).parquet(path)


@query(f"WITH {FEED} SELECT CAST(id AS VARCHAR) AS key, CASE WHEN type = 'insert' THEN 'c' ELSE 'u' END AS op, status FROM feed WHERE type <> 'delete'")
def cdc_live(spark, d):
    f = change_feed(spark, d)
    op = F.when(F.col("type") == "insert", "c").when(F.col("type") == "update", "u").otherwise("d")
    records = f.select(op.alias("op"), F.col("data").alias("after"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    return cdc.live(records).select("key", "op", F.col("after")["status"].alias("status"))


@query("SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def src_formats(spark, d):
    """The events through CSV, JSON, ORC, Parquet and text files in turn."""
    e = table(spark, d, "events").select("event_id", "event_type")
    for kind in ("csv", "json", "orc", "parquet"):
        path = sinks.work_folder(spark, kind)
        e.write.format(kind).save(path)
        e = spark.read.format(kind).schema("event_id bigint, event_type string").load(path)
    path = sinks.work_folder(spark, "text")
    e.select(F.concat_ws(" ", "event_id", "event_type")).write.text(path)
    parts = F.split("value", " ")
    e = spark.read.text(path).select(parts[0].cast("bigint").alias("event_id"), parts[1].alias("event_type"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query(ORACLES["cdc_apply"])
def cdc_handover(spark, d):
    """A snapshot of the table at the middle of its feed, then the rest of the feed."""
    feed = change_feed(spark, d).select(*_flat())
    middle = feed.agg(F.floor(F.avg("seq"))).first()[0] or 0
    snapshot = cdc.apply_changes(feed.where(F.col("seq") <= middle), "id", "seq").select("id", "status")
    return cdc.apply_changes(cdc.handover(snapshot, feed, middle), "id", "seq").select("id", "status")


@query(ORACLES["cdc_apply"])
def stream_cdc_handover(spark, d):
    """The same with the feed as a stream, read from its start, into an upserting table that the snapshot fills first."""
    feed = change_feed(spark, d).select(*_flat(), "ts")
    middle = feed.agg(F.floor(F.avg("seq"))).first()[0] or 0
    snapshot = cdc.apply_changes(feed.where(F.col("seq") <= middle).drop("ts"), "id", "seq").select("id", "status")
    path = sinks.work_folder(spark, "handed_over")
    sinks.upsert_batch(path, "id", "seq")(cdc.handover(snapshot, feed.drop("ts").where("false"), middle), -1)
    stream = twins.arrivals(feed, "ts", F.col("seq") * 7919 % 86400)
    later = cdc.handover(snapshot, stream.drop("ts"), middle)
    twins.upserted(later, sinks.upsert_batch(path, "id", "seq"))
    return spark.read.schema("id bigint, status string, type string, seq bigint, of int, bucket int").parquet(path).where("type <> 'delete'").select("id", "status")
