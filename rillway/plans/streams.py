"""Queries: streaming forms run over the tables, held against the SQL of their batch twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rillway.adapters import change_feed, fresh_name, page_log
from rillway.operators import cdc
from rillway.operators.ranking import top_n
from rillway.operators.state import latest_by, repair_is_new
from rillway.operators.windows import floored
from rillway.plans.windows import LATE
from rillway.registry import EV, FEED, ORACLES, query
from rillway.sources.sinks import work_folder
from rillway.streaming import keyed, stateful, twins


def twin(name: str):
    return query(ORACLES[name])


@twin("tumble_count")
def stream_tumble_count(spark, d):
    return twins.folded(twins.window_counts(twins.event_stream(spark, d), "1 hour", None, ["event_type"], "10 minutes"), ["start_s", "end_s", "event_type"])


@twin("slide_count")
def stream_slide_count(spark, d):
    return twins.folded(twins.window_counts(twins.event_stream(spark, d), "1 hour", "5 minutes", [], "10 minutes"), ["start_s", "end_s"])


@twin("session_count")
def stream_session_count(spark, d):
    """Each session once, when it is over."""
    e = twins.event_stream(spark, d, closing=True, keep=["user_id", "ts"])
    return twins.drain(twins.session_counts(e, "6 hours", "user_id", "10 minutes"), "append", count_state=False).drop("batch")


@twin("uv_hourly")
def stream_uv_hourly(spark, d):
    return twins.drain(twins.unique_users(twins.event_stream(spark, d), "1 hour", "10 minutes"), "append").groupBy("start_s").agg(F.count("*").alias("uv"))


@twin("interval_join")
def stream_interval_join(spark, d):
    side = lambda kind, x: twins.event_stream(spark, d).where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(f"{x}_id"), F.col("ts").alias(f"{x}_ts"))
    # seconds are compared in the batch form, so both sides are cut to whole seconds
    a, b = (side(k, x).withColumn(f"{x}_ts", F.date_trunc("second", f"{x}_ts")) for k, x in (("purchase", "a"), ("view", "b")))
    j = twins.interval_join(a, b, "user_id", "a_ts", "b_ts", "-6 HOURS", "6 HOURS", "7 hours")
    return twins.drain(j.select("user_id", "a_id", "b_id"), "append").drop("batch")


@query(f"WITH {EV} SELECT event_id, k, s FROM ev QUALIFY row_number() OVER (PARTITION BY k, s // 86400 ORDER BY ts, event_id) = 1")
def stream_first_by_key(spark, d):
    """The first row of each item and day, held back until it is known to be the first."""
    return twins.drain(stateful.first_of_day(twins.event_stream(spark, d, closing=True), "k", "10 minutes"), "append").where("event_id >= 0").drop("batch")


@twin("latest_by_key")
def stream_latest_by_key(spark, d):
    """The last row of each item, sent when none came for a day; the last one sent stays."""
    rows = twins.drain(stateful.last_after_wait(twins.event_stream(spark, d, closing=True), "k", 86400, "10 minutes"), "append")
    return latest_by(rows, ["k"], ["s", "event_id"]).select("event_id", "event_type", "k")


@twin("login_fail3")
def stream_login_fail3(spark, d):
    return twins.drain(stateful.consecutive_fails(twins.event_stream(spark, d, closing=True), 3, 86400, "10 minutes"), "append").drop("batch")


@twin("order_timeout")
def stream_order_timeout(spark, d):
    return twins.drain(stateful.paid_or_timeout(twins.event_stream(spark, d, closing=True), "signup", "purchase", 86400, "10 minutes"), "append").drop("batch")


@twin("uv_daily")
def stream_uv_daily(spark, d):
    return twins.drain(stateful.daily_entries(twins.event_stream(spark, d, closing=True), "10 minutes"), "append").select(F.col("user_id").alias("mid"), "page_id", "s")


@twin("hot_pages")
def stream_hot_pages(spark, d):
    """Counts corrected by late rows, then ranked."""
    c = twins.folded(twins.window_counts(twins.event_stream(spark, d), "1 hour", "10 minutes", ["event_type"], "10 minutes"), ["start_s", "end_s", "event_type"])
    return top_n(c, ["start_s", "end_s"], [F.desc("cnt"), F.col("event_type")], 2).select("end_s", F.col("event_type").alias("url"), "cnt", "rank")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_state_count(spark, d):
    """Running totals since the start."""
    return twins.folded(twins.running_counts(twins.event_stream(spark, d), ["event_type"]), ["event_type"])


@query("SELECT event_type AS word, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1")
def stream_batch_sql(spark, d):
    """Counts of each micro-batch by SQL over a view, added up."""
    rows = twins.each_batch_by_sql(twins.event_stream(spark, d), "SELECT event_type AS word, count(*) AS n FROM {batch} WHERE event_type <> 'error' GROUP BY 1", "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


@twin("tumble_count")
def stream_union_count(spark, d):
    e = twins.event_stream(spark, d)
    views = F.col("event_type").isin("view", "click")
    return twins.folded(twins.both_counts(e.where(views), e.where(~views), "10 minutes", "20 minutes", "1 hour", ["event_type"]), ["start_s", "end_s", "event_type"])


@twin("tumble_count")
def stream_sql_table(spark, d):
    """A named stream with a time column that is computed and watermarked, read by SQL."""
    e = twins.event_stream(spark, d).withColumn("at", F.unix_micros("ts")).drop("ts")
    e.withColumn("ts", F.timestamp_micros("at")).withWatermark("ts", "10 minutes").createOrReplaceTempView(name := fresh_name())
    g = spark.sql(f"SELECT window AS w, event_type, count(*) AS cnt FROM {name} GROUP BY window(ts, '1 hour'), event_type")
    spark.catalog.dropTempView(name)
    return twins.folded(g.select(F.unix_timestamp("w.start").alias("start_s"), F.unix_timestamp("w.end").alias("end_s"), "event_type", "cnt"), ["start_s", "end_s", "event_type"])


@query("SELECT count(*) AS n FROM events")
def stream_arrival_count(spark, d):
    """Windows of processing time differ from run to run; together they hold every row once."""
    return twins.folded(twins.arrival_counts(twins.event_stream(spark, d), "1 minute"), ["start_s"]).agg(F.sum("cnt").alias("n"))


@query(f"WITH {EV}, a AS (SELECT s + event_id * 7919 % 600 AS a FROM ev) SELECT a - a % 1800 AS start_s, count(*) AS cnt FROM a GROUP BY 1")
def stream_clock_count(spark, d):
    """Windows of processing time by a clock that can be read again: each row's arrival."""
    clock = F.timestamp_seconds(F.unix_seconds("ts") + F.col("event_id") * 7919 % 600)
    return twins.folded(twins.arrival_counts(twins.event_stream(spark, d), "30 minutes", clock), ["start_s"])


@twin("running_avg")
def stream_running_avg(spark, d):
    b = twins.folded(twins.bucket_sums(twins.event_stream(spark, d), "1 day", "event_type", "k", "10 minutes"), ["event_type", "start_s"])
    w = Window.partitionBy("event_type").orderBy("start_s")
    return b.select("event_type", "start_s", F.round(F.sum("total").over(w) / F.sum("n").over(w), 4).alias("running_avg"))


@twin("reconcile")
def stream_reconcile(spark, d):
    """Purchases and clicks wait for each other in keyed state; matched and lone rows are three outputs of one query."""
    e = twins.event_stream(spark, d, closing=True)
    side = lambda kind, x: e.where(F.col("event_type").isin(kind, twins.CLOSING)).select("user_id", "ts", F.col("event_id").alias(x))
    both = keyed.reconcile(side("purchase", "a_id"), side("click", "b_id"), "user_id", "a_id", "b_id", 3600, 7200, "10 minutes", "10 minutes")
    parts = twins.drain_split(both, "append", "status", ["matched", "left_only", "right_only"])
    return parts["matched"].unionByName(parts["left_only"]).unionByName(parts["right_only"]).where("user_id >= 0").drop("batch")


@query("""WITH r AS (SELECT l_orderkey, min(l_shipdate) AS ts FROM lineitem GROUP BY 1)
 SELECT coalesce(o_orderkey, l_orderkey) AS order_id, o_custkey AS a_id, l_orderkey % 1000 AS b_id, CASE WHEN l_orderkey IS NULL THEN 'left_only' WHEN o_orderkey IS NULL THEN 'right_only' ELSE 'matched' END AS status
 FROM (SELECT * FROM orders WHERE o_orderstatus <> 'P') o FULL JOIN r ON o_orderkey = l_orderkey AND ts BETWEEN o_orderdate - INTERVAL 5 DAY AND o_orderdate + INTERVAL 30 DAY""")
def stream_reconcile_once(spark, d):
    """Orders and their first shipment: a pair is taken out of the state on its match, and its timer with it."""
    orders = spark.read.parquet(f"{d}/orders.parquet").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("a_id"), F.col("o_orderdate").alias("ts"))
    first = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.min("l_shipdate").alias("ts"))
    first = first.select("order_id", (F.col("order_id") % 1000).alias("b_id"), "ts")
    late = F.col("order_id") * 7919 % 86400
    a = twins.arrivals(orders, "ts", late, closing={"order_id": F.lit(-1), "a_id": F.lit(-1)}, days=400)
    b = twins.arrivals(first, "ts", late, closing={"order_id": F.lit(-1), "b_id": F.lit(-1)}, days=400)
    both = keyed.reconcile(a, b, "order_id", "a_id", "b_id", 5 * 86400, 30 * 86400, "1 day", "1 day", once=True)
    return twins.drain(both, "append").where("order_id >= 0").drop("batch")


#: How the sink of a source table changes: none before the first time, then two sinks, then removed, then again.
ROUTES = [("1992-01-01", "dim_old", "id", "id", "c"), ("1994-06-01", "dim_order", "id,status", "id", "u"), ("1997-01-01", None, None, None, "d"), ("1998-03-01", "dim_order", "id,total", "id", "c")]


def _routes(spark, rows):
    return spark.createDataFrame([("order_info", *r) for r in rows], "source_table string, at string, sink_table string, sink_columns string, sink_pk string, op string").withColumn("ts", F.col("at").cast("timestamp")).drop("at")


ROUTED = """routed AS (SELECT CASE WHEN ts >= TIMESTAMP '1994-06-01' THEN 'dim_order' ELSE 'dim_old' END AS sink_table, 'id' AS sink_pk, type, id, CASE WHEN ts BETWEEN TIMESTAMP '1994-06-01' AND TIMESTAMP '1996-12-31 23:59:59' THEN status END AS status,
 CASE WHEN ts >= TIMESTAMP '1998-03-01' THEN CAST(round(total) AS BIGINT) END AS total, seq FROM feed WHERE ts >= TIMESTAMP '1992-01-01' AND NOT ts BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-02-28 23:59:59')"""


def _routed(spark, d):
    feed = change_feed(spark, d).withColumn("table", F.lit("order_info"))
    late = F.col("seq") * 7919 % 86400
    data = twins.arrivals(feed, "ts", late, closing={"table": F.lit("none"), "seq": F.lit(-1)})
    told = twins.arrivals(_routes(spark, ROUTES[1:]), "ts", F.lit(3600), closing={"source_table": F.lit("none"), "op": F.lit("d")}, pace=twins.paced(feed, "ts", late))
    return keyed.route_dimensions(data, told, "1 day", _routes(spark, ROUTES[:1]))


def _value(k):
    return F.try_element_at("data", F.lit(k))


@query(f"WITH {FEED}, {ROUTED} SELECT * EXCLUDE (seq) FROM routed")
def stream_dim_route(spark, d):
    """Changes of orders, each to the sink that their table had at the time; the first setting is there when the stream starts."""
    out = twins.drain(_routed(spark, d), "append")
    return out.select("sink_table", "sink_pk", "type", _value("id").cast("bigint").alias("id"), _value("status").alias("status"), _value("total").cast("bigint").alias("total"))


@query(f"WITH {FEED}, {ROUTED}, l AS (SELECT *, row_number() OVER (PARTITION BY sink_table, id ORDER BY seq DESC) AS n FROM routed) SELECT sink_table, id, status, total FROM l WHERE n = 1 AND type <> 'delete'")
def stream_dim_upsert(spark, d):
    """The same, each micro-batch put into the tables that its rows name."""
    root = work_folder(spark, "dimensions")
    twins.upserted(cdc.dimension_rows(_routed(spark, d)), cdc.write_dimensions(root), once=True)
    return cdc.read_dimensions(spark, root).select("sink_table", F.col("pk").cast("bigint").alias("id"), _value("status").alias("status"), _value("total").cast("bigint").alias("total"))


@twin("control_filter")
def stream_control(spark, d):
    """Events of the type that the control stream last named by their time."""
    e = twins.event_stream(spark, d, closing=True).withColumn("one", F.lit(1))
    by_day = spark.read.parquet(f"{d}/events.parquet").where("user_id = 1").groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("ts")).agg(F.max("event_type").alias("word"))
    told = twins.arrivals(by_day.withColumn("one", F.lit(1)).withColumn("removed", F.lit(False)), "ts", F.lit(0), closing={"one": F.lit(0), "removed": F.lit(True)}, pace=twins.paced(spark.read.parquet(f"{d}/events.parquet"), "ts", F.col("event_id") * 7919 % 600))
    out = keyed.as_of(e, told, ["one"], "word string", "event_id bigint, event_type string", "10 minutes")
    return twins.drain(out, "append").where("event_type = word").select("event_id", "word")


@twin("fix_is_new")
def stream_fix_is_new(spark, d):
    """The later half of the days as a stream, whose keys start with the day on which the earlier half first saw them."""
    pages = page_log(spark, d).select("event_id", "ts", "mid", "is_new")
    days = F.expr("unix_date(to_date(ts))")
    middle = pages.select(F.floor(F.avg(days))).first()[0] or 0
    past = pages.where(days < middle)
    first = F.min_by(F.struct(days.alias("day"), F.col("is_new").alias("new")), F.struct("ts", "event_id"))
    history = past.groupBy("mid").agg(first.alias("f")).select("mid", F.when(F.col("f.new") == 1, F.col("f.day")).otherwise(F.col("f.day") - 1).cast("bigint").alias("day"))
    now = twins.arrivals(pages.where(days >= middle), "ts", F.col("event_id") * 7919 % 600, closing={"event_id": F.lit(-1), "mid": F.lit(-1), "is_new": F.lit(1)})
    fixed = twins.drain(keyed.repair_is_new(now, "mid", "10 minutes", history), "append").where("event_id >= 0")
    before = repair_is_new(past, "mid", ["ts", "event_id"], F.to_date("ts"), "is_new")
    columns = ["event_id", F.col("is_new").cast("bigint").alias("is_new"), "fixed"]
    return before.select(*columns).unionByName(fixed.select(*columns))


@twin("late_rows")
def stream_late_rows(spark, d):
    """Rows that arrive when all their windows are closed, split off before Spark would drop them."""
    return _late(spark, d)[1].select("event_id", "s")


@query(f"WITH {EV}, {LATE} SELECT s - s % 300 AS start_s, s - s % 300 + 300 AS end_s, count(*) AS cnt FROM b WHERE NOT coalesce(s - s % 300 + 600 + 60 <= seen - 1, false) GROUP BY ALL")
def stream_on_time_count(spark, d):
    """Windows of the rows that came in time."""
    return floored(_late(spark, d)[0], F.col("s"), 300, [], [F.count("*").alias("cnt")]).select("start_s", (F.col("start_s") + 300).alias("end_s"), "cnt")


def _late(spark, d):
    e = twins.event_stream(spark, d, lag=7200).withColumn("s", F.unix_seconds("ts"))
    e = e.select("event_id", "s", (F.col("s") + F.col("event_id") * 7919 % 7200).alias("arrival"))
    return twins.late_split(e, "arrival", "s", size=600, slide=300, delay=1, lateness=60)


def _capped(spark, d):
    e = twins.event_stream(spark, d, closing=True).where(F.col("event_type").isin("click", twins.CLOSING)).withColumn("ad_id", F.col("k") % 10)
    return twins.drain(keyed.capped(e, ["user_id", "ad_id"], 1, "10 minutes"), "append").where("event_id >= 0")


@twin("ad_clicks_pass")
def stream_ad_clicks(spark, d):
    """Each user's first click on an ad and day; a timer at midnight clears the count."""
    return _capped(spark, d).where("passed").select("event_id", "user_id", "ad_id")


@twin("ad_blacklist")
def stream_ad_blacklist(spark, d):
    return _capped(spark, d).where("NOT passed").select("user_id", "ad_id", "day", F.lit("more than 1 click").alias("msg"))


@twin("order_detail")
def stream_order_detail(spark, d):
    """Orders joined with their lines as both come; an order without lines once the watermark has passed its wait."""
    o = spark.read.parquet(f"{d}/orders.parquet").where("o_orderstatus <> 'P'").select("o_orderkey", F.col("o_orderdate").alias("ordered_at"))
    l = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("bigint").alias("net"), F.col("l_shipdate").alias("shipped_at"))
    # a line is known with its order, whenever it ships: its time is the order's here
    l = l.join(o.select(F.col("o_orderkey").alias("l_orderkey"), F.col("ordered_at").alias("at")), "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "net", (F.col("at") + F.expr("INTERVAL 1 HOUR") * (F.col("l_linenumber") % 24)).alias("detail_at"))
    # both come side by side, in as many micro-batches as the lines need: orders ahead of their lines would wait in the state
    came = F.col("o_orderkey") * 7919 % 86400
    pace = twins.paced(o, "ordered_at", came, rows=spark.read.parquet(f"{d}/lineitem.parquet").count())
    orders = twins.arrivals(o, "ordered_at", came, closing={"o_orderkey": F.lit(-1)}, pace=pace)
    lines = twins.arrivals(l, "detail_at", F.col("l_orderkey") * 104729 % 86400, closing={"l_orderkey": F.lit(-2)}, pace=pace)
    out = keyed.left_join(orders, lines, "o_orderkey", "l_orderkey", 2 * 86400, "1 day")
    return twins.drain(out, "append").where("o_orderkey >= 0").select("o_orderkey", "l_linenumber", "l_partkey", "net")


@twin("dict_lookup")
def stream_dict_lookup(spark, d):
    """Customers as a stream, each micro-batch joined with the dictionary as it is then."""
    c = spark.read.parquet(f"{d}/customer.parquet").withColumn("ts", F.timestamp_seconds("c_custkey")).select("c_custkey", "c_nationkey", "ts")
    nations = lambda: spark.read.parquet(f"{d}/nation.parquet").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return twins.looked_up(twins.arrivals(c, "ts", F.lit(0)), nations, ["c_nationkey"]).select("c_custkey", "n_name")
