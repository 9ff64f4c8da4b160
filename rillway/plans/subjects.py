"""Queries: subject statistics by day, composed of the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillway.adapters import events, page_log, seconds, table
from rillway.operators import patterns, state
from rillway.operators.search import tokens
from rillway.registry import EV, PG, query

DAY = 86400
ORDER = ["ts", "event_id"]


def day_number():
    """Days since 1970 of a row's time."""
    return F.expr("unix_timestamp(cast(ts AS timestamp)) div 86400")


@query(f"""WITH {PG}, n AS (SELECT *, lead(s) OVER w AS ns, lead(last_page_id IS NULL) OVER w AS ne, row_number() OVER (PARTITION BY mid, s // {DAY}, last_page_id IS NULL ORDER BY ts, event_id) AS first FROM pg WINDOW w AS (PARTITION BY mid ORDER BY ts, event_id))
 SELECT s // {DAY} AS day, vc, ch, ar, is_new, count(*) AS pv_cnt, count(*) FILTER (last_page_id IS NULL AND first = 1) AS uv_cnt, count(*) FILTER (last_page_id IS NULL) AS sv_cnt,
 count(*) FILTER (last_page_id IS NULL AND (ns IS NULL OR ne OR ns - s > 3600)) AS uj_cnt, CAST(sum(during_time) AS BIGINT) AS dur_sum FROM n GROUP BY ALL""")
def visitor_stats(spark, d):
    """Page views, visitors, sessions, bounces and time on page."""
    p = page_log(spark, d).withColumn("s", seconds()).withColumn("day", day_number())
    dims = ["day", "vc", "ch", "ar", "is_new"]
    kinds = {
        "pv_cnt": p,
        "uv_cnt": state.first_by(p.where("last_page_id IS NULL"), ["mid", "day"], ORDER),
        "sv_cnt": p.where("last_page_id IS NULL"),
        "uj_cnt": patterns.bounces(p, "mid", ORDER, "s", 3600),
    }
    parts = None
    for name, rows in kinds.items():
        part = rows.select(*dims, *[F.lit(int(k == name)).cast("bigint").alias(k) for k in kinds], (F.col("during_time") if name == "pv_cnt" else F.lit(0).cast("bigint")).alias("dur_sum"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy(*dims).agg(*[F.sum(c).alias(c) for c in (*kinds, "dur_sum")])


@query(f"""WITH {EV}, u AS (SELECT s // {DAY} AS day, k AS sku_id, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS click, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS display,
 CASE WHEN event_type = 'click' AND k % 2 = 0 THEN 1 ELSE 0 END AS favor, CASE WHEN event_type = 'click' AND k % 2 = 1 THEN 1 ELSE 0 END AS cart, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS said, CASE WHEN event_type = 'error' AND value >= 10 THEN 1 ELSE 0 END AS good,
 CASE WHEN event_type = 'signup' THEN user_id END AS o, CASE WHEN event_type = 'purchase' THEN user_id END AS p, CASE WHEN event_type = 'error' THEN user_id END AS r FROM ev)
 SELECT day, sku_id, max(p_brand) AS brand, CAST(sum(click) AS BIGINT) AS click_ct, CAST(sum(display) AS BIGINT) AS display_ct, count(DISTINCT o) AS order_ct, count(DISTINCT p) AS paid_ct, count(DISTINCT r) AS refund_ct, CAST(sum(favor) AS BIGINT) AS favor_ct, CAST(sum(cart) AS BIGINT) AS cart_ct, CAST(sum(said) AS BIGINT) AS comment_ct, CAST(sum(good) AS BIGINT) AS good_comment_ct
 FROM u LEFT JOIN part ON p_partkey = sku_id GROUP BY 1, 2""")
def product_stats(spark, d):
    """Counts of each product and day from seven kinds of rows, with its dimensions (favour: a click on an even item, cart: on an odd one, comment: an error)."""
    e = events(spark, d).withColumn("day", day_number())
    one = lambda kind: F.when(F.col("event_type") == kind, F.col("user_id"))
    count = lambda kind, more=F.lit(True): F.sum(((F.col("event_type") == kind) & more).cast("bigint"))
    even = F.col("k") % 2 == 0
    said = [count("click", even).alias("favor_ct"), count("click", ~even).alias("cart_ct"), count("error").alias("comment_ct"), count("error", F.col("value") >= 10).alias("good_comment_ct")]
    g = e.groupBy("day", F.col("k").alias("sku_id")).agg(count("click").alias("click_ct"), count("view").alias("display_ct"), F.count_distinct(one("signup")).alias("order_ct"), F.count_distinct(one("purchase")).alias("paid_ct"), F.count_distinct(one("error")).alias("refund_ct"), *said)
    p = table(spark, d, "part").select(F.col("p_partkey").alias("sku_id"), F.col("p_brand").alias("brand"))
    return g.join(p, "sku_id", "left").select("day", "sku_id", "brand", "click_ct", "display_ct", "order_ct", "paid_ct", "refund_ct", "favor_ct", "cart_ct", "comment_ct", "good_comment_ct")


@query("SELECT strftime(o_orderdate, '%Y%m') AS month, n_name AS province, count(DISTINCT o_orderkey) AS order_count, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2")
def area_stats(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    o = o.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.groupBy(F.date_format("o_orderdate", "yyyyMM").alias("month"), F.col("n_name").alias("province")).agg(F.count_distinct("o_orderkey").alias("order_count"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("amount"))


@query("SELECT source, w AS keyword, count(*) AS cnt FROM (SELECT source, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9_]+')) AS w FROM documents) WHERE w <> '' GROUP BY ALL")
def keyword_stats(spark, d):
    t = table(spark, d, "documents").select("source", F.explode(tokens("text")).alias("keyword"))
    return t.where("keyword <> ''").groupBy("source", "keyword").agg(F.count("*").alias("cnt"))


@query(f"WITH {EV}, w AS (SELECT s - s % 21600 AS start_s, unnest(string_split(p_name, ' ')) AS keyword FROM ev JOIN part ON p_partkey = k WHERE event_type = 'view') SELECT start_s, start_s + 21600 AS end_s, keyword, count(*) AS cnt FROM w WHERE keyword <> '' GROUP BY ALL")
def keyword_windows(spark, d):
    """Words of what was looked at on the search page (view), by window, through SQL's own window function."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_name")
    w = events(spark, d).where("event_type = 'view'").join(p, "k").select("ts", F.explode(F.split("p_name", " ")).alias("keyword")).where("keyword <> ''")
    return spark.sql("SELECT unix_timestamp(cast(window.start AS timestamp)) AS start_s, unix_timestamp(cast(window.end AS timestamp)) AS end_s, keyword, count(*) AS cnt FROM {searches} GROUP BY window(ts, '6 hours'), keyword", searches=w)


@query("""SELECT s - s % 2592000 AS start_s, s - s % 2592000 + 2592000 AS end_s, n_name AS province, count(DISTINCT o_orderkey) AS order_count FROM (SELECT *, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS s FROM orders)
 JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL""")
def area_windows(spark, d):
    """Orders by place and window of 30 days."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    g = o.groupBy(F.window(F.col("o_orderdate").cast("timestamp"), "30 days").alias("w"), F.col("n_name").alias("province")).agg(F.count_distinct("o_orderkey").alias("order_count"))
    return g.select(F.unix_timestamp("w.start").alias("start_s"), F.unix_timestamp("w.end").alias("end_s"), "province", "order_count")


@query(f"WITH {EV} SELECT s // {DAY} AS day, count(DISTINCT user_id) AS cart_uv FROM ev WHERE event_type = 'click' GROUP BY 1")
def cart_stats(spark, d):
    e = events(spark, d).where("event_type = 'click'").withColumn("day", day_number())
    return e.dropDuplicates(["day", "user_id"]).groupBy("day").agg(F.count("*").alias("cart_uv"))


@query(f"WITH {EV} SELECT s // {DAY} AS day, count(*) AS registered FROM ev WHERE event_type = 'signup' GROUP BY 1")
def register_stats(spark, d):
    return events(spark, d).where("event_type = 'signup'").groupBy(day_number().alias("day")).agg(F.count("*").alias("registered"))


@query("""WITH f AS (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS first FROM orders GROUP BY 1)
 SELECT strftime(o_orderdate, '%Y%m%d') AS dt, count(DISTINCT o_custkey) AS users, count(DISTINCT CASE WHEN CAST(o_orderdate AS DATE) = first THEN o_custkey END) AS new_users,
 CAST(coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS amount, CAST(coalesce(sum(CAST(l_discount AS DECIMAL(18,2))), 0) AS DOUBLE) AS reduced
 FROM orders JOIN f USING (o_custkey) LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def order_stats(spark, d):
    """Order users, those who order for the first time, amounts (a missing one counts as 0)."""
    o = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    o = o.join(o.groupBy("o_custkey").agg(F.min("day").alias("first")), "o_custkey")
    j = o.join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    total = lambda c: F.coalesce(F.sum(F.col(c).cast("decimal(18,2)")), F.lit(0)).cast("double")
    new = F.count_distinct(F.when(F.col("day") == F.col("first"), F.col("o_custkey")))
    return j.groupBy(F.date_format("o_orderdate", "yyyyMMdd").alias("dt")).agg(F.count_distinct("o_custkey").alias("users"), new.alias("new_users"), total("l_extendedprice").alias("amount"), total("l_discount").alias("reduced"))


@query(f"WITH {EV}, p AS (SELECT *, min(s // {DAY}) OVER (PARTITION BY user_id) AS first FROM ev WHERE event_type = 'purchase') SELECT s // {DAY} AS day, count(DISTINCT user_id) AS users, count(DISTINCT CASE WHEN s // {DAY} = first THEN user_id END) AS new_users FROM p GROUP BY 1")
def payment_stats(spark, d):
    p = events(spark, d).where("event_type = 'purchase'").select("user_id", day_number().alias("day")).distinct()
    p = p.join(p.groupBy("user_id").agg(F.min("day").alias("first")), "user_id")
    return p.groupBy("day").agg(F.count("*").alias("users"), F.sum((F.col("day") == F.col("first")).cast("bigint")).alias("new_users"))


@query(f"WITH {EV}, u AS (SELECT DISTINCT user_id, s // {DAY} AS day FROM ev WHERE event_type = 'signup'), a AS (SELECT *, day - lag(day) OVER (PARTITION BY user_id ORDER BY day) AS away FROM u) SELECT day, count(*) AS uv, count(*) FILTER (away >= 7 AND away < 15) AS back7, count(*) FILTER (away >= 15 AND away < 30) AS back15, count(*) FILTER (away >= 30) AS back30 FROM a GROUP BY 1")
def login_stats(spark, d):
    """Login users, and those who were away for a week, two weeks, a month."""
    a = state.days_away(events(spark, d).where("event_type = 'signup'"), "user_id", F.to_date("ts"))
    back = lambda low, high: F.count(F.when((F.col("away") >= low) & (F.col("away") < high), 1))
    g = a.groupBy("day").agg(F.count("*").alias("uv"), back(7, 15).alias("back7"), back(15, 30).alias("back15"), back(30, 1 << 30).alias("back30"))
    return g.withColumn("day", F.unix_date("day").cast("bigint"))


@query(f"WITH {EV} SELECT s // {DAY} AS day, count(DISTINCT CASE WHEN event_type = 'view' THEN user_id END) AS home_uv, count(DISTINCT CASE WHEN event_type = 'click' THEN user_id END) AS detail_uv FROM ev WHERE event_type IN ('view', 'click') GROUP BY 1")
def page_stats(spark, d):
    e = events(spark, d).where("event_type IN ('view', 'click')").select("user_id", "event_type", day_number().alias("day")).distinct()
    n = lambda kind: F.sum((F.col("event_type") == kind).cast("bigint"))
    return e.groupBy("day").agg(n("view").alias("home_uv"), n("click").alias("detail_uv"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_linenumber - coalesce(lag(l_linenumber) OVER w, 0) AS BIGINT) AS delta FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber) QUALIFY l_linenumber > coalesce(lag(l_linenumber) OVER w, 0)")
def cart_delta(spark, d):
    """Growth of a number between the changes of a key, as a cart's quantity: the first counts whole, decreases don't."""
    from pyspark.sql import Window

    before = F.coalesce(F.lag("l_linenumber").over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_linenumber")), F.lit(0))
    t = table(spark, d, "lineitem").withColumn("delta", (F.col("l_linenumber") - before).cast("bigint"))
    return t.where("delta > 0").select("l_orderkey", "l_linenumber", "delta")


@query(f"WITH {EV} SELECT event_id, user_id, k AS sku_id FROM ev WHERE event_type = 'click' AND NOT k % 2 = 1")
def favor(spark, d):
    """Favours that are new or no longer cancelled (cancelled: an odd item)."""
    return events(spark, d).where("event_type = 'click' AND NOT k % 2 = 1").select("event_id", "user_id", F.col("k").alias("sku_id"))


@query(f"WITH {EV} SELECT event_id, p_name AS name, p_brand AS appraise FROM ev JOIN part ON p_partkey = k WHERE event_type = 'error'")
def comment(spark, d):
    c = events(spark, d).where("event_type = 'error'").join(table(spark, d, "part"), F.col("k") == F.col("p_partkey"))
    return c.select("event_id", F.col("p_name").alias("name"), F.col("p_brand").alias("appraise"))


@query(f"WITH {EV} SELECT user_id, min(s) AS at_s FROM ev WHERE event_type = 'signup' GROUP BY 1")
def register(spark, d):
    return events(spark, d).where("event_type = 'signup'").groupBy("user_id").agg(F.min(seconds()).alias("at_s"))


@query(f"WITH {PG} SELECT mid, s // {DAY} AS day, min(s) AS at_s FROM pg WHERE last_page_id IS NULL OR last_page_id = 'signup' GROUP BY 1, 2")
def user_login(spark, d):
    """The first row of each user and day that starts a visit or follows a login page."""
    p = page_log(spark, d).where("last_page_id IS NULL OR last_page_id = 'signup'")
    return p.groupBy("mid", day_number().alias("day")).agg(F.min(seconds()).alias("at_s"))
