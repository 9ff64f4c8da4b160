"""Queries: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillway.adapters import events, seconds, table
from rillway.operators import joins
from rillway.registry import EV, query

money = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


def _two(spark, d, a, b):
    e = events(spark, d).withColumn("s", seconds())
    left = e.where(F.col("event_type") == a).select("user_id", F.col("event_id").alias("a_id"), F.col("s").alias("a_s"))
    right = e.where(F.col("event_type") == b).select("user_id", F.col("event_id").alias("b_id"), F.col("s").alias("b_s"))
    return left, right


@query(f"WITH {EV} SELECT a.user_id, a.event_id AS a_id, b.event_id AS b_id FROM ev a JOIN ev b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'view' AND b.s BETWEEN a.s - 21600 AND a.s + 21600")
def interval_join(spark, d):
    a, b = _two(spark, d, "purchase", "view")
    return joins.interval_join(a, b, "user_id", "a_s", "b_s", -21600, 21600).select("user_id", "a_id", "b_id")


@query(f"WITH {EV} SELECT a.user_id, a.event_id AS a_id, b.event_id AS b_id FROM ev a JOIN ev b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'view' AND a.s // 86400 = b.s // 86400")
def window_join(spark, d):
    a, b = _two(spark, d, "purchase", "view")
    day = lambda c: F.expr(f"{c} div 86400")
    return a.withColumn("w", day("a_s")).join(b.withColumn("w", day("b_s")), ["user_id", "w"]).select("user_id", "a_id", "b_id")


@query("SELECT o_orderkey, c_name, o_orderstatus FROM orders JOIN customer ON c_custkey = o_custkey")
def equi_join(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_orderstatus")


CONTROL = "c0 AS (SELECT s - s % 86400 AS f, max(event_type) AS word FROM ev WHERE user_id = 1 GROUP BY 1), c AS (SELECT *, lead(f) OVER (ORDER BY f) AS t FROM c0)"


@query(f"WITH {EV}, {CONTROL} SELECT event_id, word FROM ev JOIN c ON s >= f AND (t IS NULL OR s < t) WHERE event_type = word")
def control_filter(spark, d):
    """Events of the type that was last named by user 1, the control, on an earlier or the same day's start."""
    e = events(spark, d).withColumn("s", seconds())
    control = e.where("user_id = 1").groupBy((F.col("s") - F.col("s") % 86400).alias("f")).agg(F.max("event_type").alias("word"))
    return joins.as_of_control(e, control, "s", "f", "word").where("event_type = word").select("event_id", "word")


@query(f"WITH {EV}, o AS (SELECT user_id, event_id AS a_id, s AS a FROM ev WHERE event_type = 'purchase'), r AS (SELECT user_id, event_id AS b_id, s AS b FROM ev WHERE event_type = 'click') SELECT coalesce(o.user_id, r.user_id) AS user_id, a_id, b_id, CASE WHEN r.user_id IS NULL THEN 'left_only' WHEN o.user_id IS NULL THEN 'right_only' ELSE 'matched' END AS status FROM o FULL JOIN r ON o.user_id = r.user_id AND b BETWEEN a - 3600 AND a + 7200")
def reconcile(spark, d):
    a, b = _two(spark, d, "purchase", "click")
    return joins.reconcile(a, b, "user_id", "a_s", "b_s", 3600, 7200, ["a_id"], ["b_id"]).select("user_id", "a_id", "b_id", "status")


@query("SELECT o_orderkey, l_linenumber, l_partkey, CAST(round(l_extendedprice * (1 - l_discount)) AS BIGINT) AS net FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'")
def order_detail(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus <> 'P'")
    net = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("bigint")
    return o.join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", "l_linenumber", "l_partkey", net.alias("net"))


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> 2")
def dict_lookup(spark, d):
    """Inner lookup of a dictionary; rows without an entry go."""
    n = table(spark, d, "nation").where("n_regionkey <> 2")
    return table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query("""SELECT l_orderkey, l_linenumber, c_name AS user_name, n_name AS province, r_name AS area, p_name AS sku, p_brand AS brand, p_type AS category, s_name AS spu,
 CAST(floor(date_diff('day', o_orderdate, TIMESTAMP '2020-01-01') / 365) AS BIGINT) AS age
 FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT * FROM nation WHERE n_nationkey <> 3) n ON n_nationkey = c_nationkey
 LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey""")
def order_wide(spark, d):
    """Order lines with their dimensions; a missing dimension keeps the row."""
    t = lambda n: table(spark, d, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(t("nation").where("n_nationkey <> 3"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    j = j.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").join(t("part"), F.col("l_partkey") == F.col("p_partkey"), "left").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    age = F.floor(F.datediff(F.lit("2020-01-01").cast("date"), F.to_date("o_orderdate")) / 365)
    return j.select("l_orderkey", "l_linenumber", F.col("c_name").alias("user_name"), F.col("n_name").alias("province"), F.col("r_name").alias("area"), F.col("p_name").alias("sku"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.col("s_name").alias("spu"), age.alias("age"))


@query("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON c_nationkey = s_nationkey")
def join_basic(spark, d):
    """Each supplier with each customer of its nation; the rows grow with the square of the tables."""
    s, c = table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return joins.dealt_join(s, c, "s_nationkey", "c_nationkey").select("s_suppkey", "c_custkey")


@query("SELECT coalesce(a.k, b.k) AS nation, coalesce(l, '') AS \"left\", coalesce(r, '') AS \"right\" FROM (SELECT s_nationkey AS k, string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey) AS l FROM supplier GROUP BY 1) a FULL JOIN (SELECT c_nationkey AS k, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) AS r FROM customer GROUP BY 1) b ON a.k = b.k")
def cogroup(spark, d):
    s = table(spark, d, "supplier").withColumnRenamed("s_nationkey", "nation")
    c = table(spark, d, "customer").withColumnRenamed("c_nationkey", "nation")
    g = joins.cogroup(s, c, "nation", "s_suppkey", "c_custkey")
    return g.select("nation", F.array_join("left", ",").alias("left"), F.array_join("right", ",").alias("right"))


@query("""WITH s AS (SELECT l_suppkey AS k, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) - 1) // 50 AS part, l_partkey AS v FROM lineitem),
 e AS (SELECT user_id AS k, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 50 AS part, event_id AS v FROM events),
 l AS (SELECT k, part, string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) AS l FROM s GROUP BY ALL), r AS (SELECT k, part, string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) AS r FROM e GROUP BY ALL)
 SELECT coalesce(l.k, r.k) AS key, coalesce(l.part, r.part) AS part, coalesce(l, '') AS "left", coalesce(r, '') AS "right" FROM l FULL JOIN r ON l.k = r.k AND l.part = r.part""")
def cogroup_parts(spark, d):
    """The parts that each supplier ships beside the events of the user of the same number, fifty of each in a row."""
    parts = table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "key")
    seen = table(spark, d, "events").withColumnRenamed("user_id", "key")
    g = joins.cogroup_parts(parts, seen, "key", "l_partkey", "event_id", 50)
    return g.select("key", "part", F.array_join("left", ",").alias("left"), F.array_join("right", ",").alias("right"))


@query("SELECT r_name, n_name FROM region, nation")
def cross_join(spark, d):
    """A product of two dimension tables of fixed size, the only kind of table it is meant for."""
    return table(spark, d, "region").crossJoin(table(spark, d, "nation")).select("r_name", "n_name")


@query("SELECT a.s_suppkey, b.c_custkey FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier) a JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS i FROM customer) b USING (i)")
def zip_join(spark, d):
    a = joins.numbered(table(spark, d, "supplier").select("s_suppkey"), ["s_suppkey"])
    b = joins.numbered(table(spark, d, "customer").select("c_custkey"), ["c_custkey"])
    return a.join(b, "idx").select("s_suppkey", "c_custkey")


@query("SELECT c_custkey, CAST(coalesce(n_nationkey, 0) AS INTEGER) AS hit FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 1) ON n_nationkey = c_nationkey")
def broadcast_join(spark, d):
    """A map-side join with nation, a table of fixed size; what isn't found gives 0."""
    n = table(spark, d, "nation").where("n_regionkey = 1")
    return table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("n_nationkey", F.lit(0)).alias("hit"))


@query(f"WITH {EV}, o AS (SELECT e.user_id, event_id AS order_id, s AS o_s, c_mktsegment FROM ev e LEFT JOIN customer ON c_custkey = e.user_id WHERE event_type = 'signup'), p AS (SELECT user_id, event_id AS payment_id, s AS p_s, k FROM ev WHERE event_type = 'purchase') SELECT payment_id, order_id, c_mktsegment AS segment, k FROM p JOIN o ON p.user_id = o.user_id AND o_s BETWEEN p_s - 86400 AND p_s")
def payment_wide(spark, d):
    """Payments with the wide orders of the day before them."""
    e = events(spark, d).withColumn("s", seconds())
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    o = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("order_id"), F.col("s").alias("o_s")).join(c, "user_id", "left")
    p = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("payment_id"), F.col("s").alias("p_s"), "k")
    return joins.interval_join(p, o, "user_id", "p_s", "o_s", -86400, 0).select("payment_id", "order_id", "segment", "k")


@query("SELECT l_orderkey, l_partkey, count(*) AS n, max(n_name) AS place FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = 'F' JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE l_returnflag = 'R' GROUP BY 1, 2")
def refund_detail(spark, d):
    r = table(spark, d, "lineitem").where("l_returnflag = 'R'").join(table(spark, d, "orders").where("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey"))
    r = r.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return r.groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n"), F.max("n_name").alias("place"))


@query("SELECT event_id, n_name AS place FROM events LEFT JOIN nation ON (user_id * 7919) % 2000 BETWEEN n_nationkey * 80 AND n_nationkey * 80 + 60")
def ip_range_join(spark, d):
    """Addresses made of user ids, looked up in ranges of 61 out of each 80 addresses, one for each nation."""
    n = table(spark, d, "nation").select("n_name", (F.col("n_nationkey") * 80 + 167772160).cast("bigint").alias("low"), (F.col("n_nationkey") * 80 + 167772220).cast("bigint").alias("high"))
    host = F.col("user_id") * 7919 % 2000
    e = table(spark, d, "events").select("event_id", joins.ip_to_long(F.concat(F.lit("10.0."), F.floor(host / 256), F.lit("."), host % 256)).alias("ip"))
    return joins.range_join(e, "ip", n, "low", "high", bucket=256).select("event_id", F.col("n_name").alias("place"))
