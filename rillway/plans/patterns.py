"""Queries: event patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillway.adapters import events, page_log, seconds
from rillway.operators import joins, patterns, sequences
from rillway.registry import EV, ORACLES, PG, query

DAY = 86400
ORDER = ["ts", "event_id"]


@query(f"WITH {EV}, l AS (SELECT *, lag(event_type, 1) OVER w AS e1, lag(event_type, 2) OVER w AS e2, lag(s, 2) OVER w AS s2 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, s2 AS first_s, s AS last_s FROM l WHERE event_type = 'error' AND e1 = 'error' AND e2 = 'error' AND s - s2 <= {DAY}")
def login_fail3(spark, d):
    e = events(spark, d).withColumn("s", seconds())
    out = patterns.consecutive(e, "user_id", ORDER, "s", F.col("event_type") == "error", 3, DAY)
    return out.select("user_id", "first_s", F.col("s").alias("last_s"))


PAID = f"o AS (SELECT a.event_id, a.user_id, a.s AS created_s, (SELECT min(b.s) FROM ev b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND b.s > a.s AND b.s <= a.s + {DAY}) AS paid_s FROM ev a WHERE a.event_type = 'signup')"


@query(f"WITH {EV}, {PAID} SELECT user_id, created_s, paid_s, CASE WHEN paid_s IS NULL THEN 'timeout' ELSE 'paid' END AS status FROM o")
def order_timeout(spark, d):
    e = events(spark, d).withColumn("s", seconds())
    out = patterns.followed_by(e.where("event_type = 'signup'"), e.where("event_type = 'purchase'"), "user_id", "s", "s", DAY)
    return out.select("user_id", F.col("first_s").alias("created_s"), F.col("then_s").alias("paid_s"), F.when(F.col("then_s").isNull(), "timeout").otherwise("paid").alias("status"))


@query(f"""WITH {EV}, c AS (SELECT user_id, min(s) AS c FROM ev WHERE event_type = 'signup' GROUP BY 1), p AS (SELECT user_id, min(s) AS p FROM ev WHERE event_type = 'purchase' GROUP BY 1)
 SELECT user_id, c AS created_s, p AS paid_s, CASE WHEN c IS NULL THEN 'not created' WHEN p IS NULL OR p > c + {DAY} THEN 'timeout' WHEN p < c THEN 'not created' ELSE 'paid' END AS status FROM c FULL JOIN p USING (user_id)""")
def order_check(spark, d):
    """First creation and first payment of each user."""
    e = events(spark, d).withColumn("s", seconds())
    c = e.where("event_type = 'signup'").groupBy("user_id").agg(F.min("s").alias("created_s"))
    p = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("s").alias("paid_s"))
    a, b = F.col("created_s"), F.col("paid_s")
    status = F.when(a.isNull(), "not created").when(b.isNull() | (b > a + DAY), "timeout").when(b < a, "not created").otherwise("paid")
    return c.join(p, "user_id", "full").withColumn("status", status)


@query(f"WITH {EV}, r AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM ev), p AS (SELECT *, row_number() OVER (PARTITION BY user_id, run, event_type = 'error' ORDER BY ts, event_id) AS place FROM r) SELECT event_id, user_id, place FROM p WHERE event_type = 'error' AND place >= 2")
def fail_streak(spark, d):
    return patterns.streak(events(spark, d), "user_id", ORDER, F.col("event_type") == "error", 2).select("event_id", "user_id", "place")


@query(f"WITH {PG}, n AS (SELECT *, lead(s) OVER w AS ns, lead(last_page_id IS NULL) OVER w AS ne FROM pg WINDOW w AS (PARTITION BY mid ORDER BY ts, event_id)) SELECT event_id, mid, page_id FROM n WHERE last_page_id IS NULL AND (ns IS NULL OR ne OR ns - s > 3600)")
def bounce(spark, d):
    p = page_log(spark, d).withColumn("s", seconds())
    return patterns.bounces(p, "mid", ORDER, "s", 3600).select("event_id", "mid", "page_id")


@query(f"WITH {PG}, n AS (SELECT *, lead(s) OVER (PARTITION BY mid ORDER BY ts, event_id) AS ns FROM pg) SELECT event_id, mid, page_id FROM n WHERE last_page_id IS NULL AND (ns IS NULL OR ns - s > 3600)")
def bounce_gap(spark, d):
    p = page_log(spark, d).withColumn("s", seconds())
    return patterns.lone_entries(p, "mid", ORDER, "s", 3600).select("event_id", "mid", "page_id")


@query(f"WITH {EV}, n AS (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ne FROM ev) SELECT event_id, user_id FROM n WHERE event_type = 'view' AND ne = 'click'")
def pat_next(spark, d):
    return patterns.next_is(events(spark, d), "user_id", ORDER, "event_type", "view", "click").select("event_id", "user_id")


@query(f"WITH {EV} SELECT a.event_id AS view_id, b.event_id AS purchase_id FROM ev a JOIN ev b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND b.s BETWEEN a.s + 1 AND a.s + 21600")
def pat_followed_any(spark, d):
    e = events(spark, d).withColumn("s", seconds())
    a = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("s").alias("a_s"))
    b = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("s").alias("b_s"))
    return joins.interval_join(a, b, "user_id", "a_s", "b_s", 1, 21600).select("view_id", "purchase_id")


@query(f"WITH {EV} SELECT user_id, s AS view_s FROM ev a WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM ev b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND b.s > a.s AND b.s <= a.s + {DAY})")
def pat_not_followed(spark, d):
    e = events(spark, d).withColumn("s", seconds())
    out = patterns.followed_by(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), "user_id", "s", "s", DAY)
    return out.where("then_s IS NULL").select("user_id", F.col("first_s").alias("view_s"))


@query(ORACLES["login_fail3"])
def pattern_fail3(spark, d):
    """Three failures in a row within a day, as a stage that is strictly repeated."""
    e = events(spark, d).withColumn("s", seconds())
    # ids in the order of time, so that rows of one second keep it
    ordered = e.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) % 1_000_000 * 1_000_000_000 + F.col("event_id"))
    fails = sequences.Stage(F.col("event_type") == "error", times=(3, 3), again=sequences.STRICT)
    return sequences.detect(ordered, "user_id", "at", "s", [fails], 86400).select("user_id", "first_s", "last_s")


@query(f"""WITH {EV}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS i FROM ev), b AS (SELECT a.user_id, a.i, a.s, a.event_id AS a_id, min(b.i) AS j FROM n a JOIN n b ON b.user_id = a.user_id AND b.i > a.i AND b.event_type IN ('view', 'click') WHERE a.event_type = 'signup' GROUP BY ALL)
 SELECT b.user_id, b.s AS first_s, c.s AS last_s, a_id, m.event_id AS b_id, c.event_id AS c_id FROM b JOIN n m ON m.user_id = b.user_id AND m.i = b.j JOIN n c ON c.user_id = b.user_id AND c.i > b.j AND c.event_type = 'purchase' AND c.s - b.s <= 172800""")
def pattern_funnel(spark, d):
    """A signup, the next view or click after it, then each purchase within two days of the signup."""
    kind = lambda *k: F.col("event_type").isin(*k)
    stages = [sequences.Stage(kind("signup")), sequences.Stage(kind("view") | kind("click")), sequences.Stage(kind("purchase"), after=sequences.ANY)]
    out = sequences.detect(events(spark, d).withColumn("s", seconds()), "user_id", "event_id", "s", stages, 172800)
    return out.select("user_id", "first_s", "last_s", *[F.col("ids")[i].alias(f"{n}_id") for i, n in enumerate("abc")])
