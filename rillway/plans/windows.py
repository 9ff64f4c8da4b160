"""Queries: time windows, rankings inside windows, first and last rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillway.adapters import events, page_log, seconds, table
from rillway.operators import ranking, state, windows
from rillway.registry import EV, PG, query

def count():
    return F.count("*").alias("cnt")


def _of(e, behavior):
    return e.where(F.col("event_type") == behavior) if behavior else e


def _s(df):
    """Window ends as whole seconds."""
    return df.withColumn("start_s", seconds("window_start")).withColumn("end_s", seconds("window_end")).drop("window_start", "window_end")


@query(f"WITH {EV} SELECT s - s % 3600 AS start_s, s - s % 3600 + 3600 AS end_s, event_type, count(*) AS cnt FROM ev GROUP BY ALL")
def tumble_count(spark, d):
    return _s(windows.windowed(events(spark, d), "ts", "1 hour", None, ["event_type"], [count()]))


SLIDE = "w AS (SELECT k, s - s % 300 - 300 * j AS start_s FROM ev, (SELECT unnest(range(12)) AS j))"


@query(f"WITH {EV}, {SLIDE} SELECT start_s, start_s + 3600 AS end_s, count(*) AS cnt FROM w GROUP BY ALL")
def slide_count(spark, d):
    """Counts by panes of five minutes, each taken out again when it leaves the window."""
    return windows.panes(events(spark, d), seconds(), 3600, 300, [], {"cnt": F.lit(1)})


@query(f"WITH {EV}, {SLIDE}, c AS (SELECT start_s, k, count(*) AS cnt FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY start_s ORDER BY cnt DESC, k) AS rank FROM c) SELECT start_s + 3600 AS end_s, k AS item_id, cnt, rank FROM r WHERE rank <= 3")
def hot_items(spark, d, behavior=None):
    """Top items of each window; of one kind of event with behavior."""
    c = windows.panes(_of(events(spark, d), behavior), seconds(), 3600, 300, ["k"], {"cnt": F.lit(1)})
    return ranking.top_n(c, ["start_s", "end_s"], [F.desc("cnt"), F.col("k")], 3).select("end_s", F.col("k").alias("item_id"), "cnt", "rank")


@query(f"WITH {EV}, w AS (SELECT event_type, s - s % 600 - 600 * j AS start_s FROM ev, (SELECT unnest(range(6)) AS j)), c AS (SELECT start_s, event_type, count(*) AS cnt FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY start_s ORDER BY cnt DESC, event_type) AS rank FROM c) SELECT start_s + 3600 AS end_s, event_type AS url, cnt, rank FROM r WHERE rank <= 2")
def hot_pages(spark, d):
    c = windows.panes(events(spark, d), seconds(), 3600, 600, ["event_type"], {"cnt": F.lit(1)})
    return ranking.top_n(c, ["start_s", "end_s"], [F.desc("cnt"), F.col("event_type")], 2).select("end_s", F.col("event_type").alias("url"), "cnt", "rank")


@query(f"WITH {EV}, g AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 21600 THEN 0 ELSE 1 END AS n FROM ev), h AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM g) SELECT user_id, min(s) AS start_s, count(*) AS cnt FROM h GROUP BY user_id, g")
def session_count(spark, d):
    return _s(windows.sessions(events(spark, d), "ts", "6 hours", ["user_id"], [count()])).select("user_id", "start_s", "cnt")


@query(f"WITH {EV}, w AS (SELECT s - s % 86400 AS start_s, unnest(range(s - s % 21600 + 21600, s - s % 86400 + 86401, 21600)) AS end_s FROM ev) SELECT start_s, CAST(end_s AS BIGINT) AS end_s, count(*) AS cnt FROM w GROUP BY ALL")
def cumulate_count(spark, d):
    return windows.cumulative(events(spark, d), seconds(), 21600, 86400, [], [count()])


@query(f"WITH {EV} SELECT s - s % 86400 AS start_s, event_type, count(*) AS cnt FROM ev GROUP BY ALL")
def tumble_floor(spark, d):
    return windows.floored(events(spark, d), seconds(), 86400, ["event_type"], [count()])


@query(f"WITH {EV} SELECT s - s % 86400 AS start_s, user_id, string_agg(event_type, ',' ORDER BY ts, event_id) AS rows FROM ev GROUP BY ALL")
def window_rows(spark, d):
    """All rows of each user's day in order."""
    e = events(spark, d).withColumn("start_s", seconds() - F.pmod(seconds(), F.lit(86400)))
    g = e.groupBy("start_s", "user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("r"))
    return g.select("start_s", "user_id", F.array_join("r.event_type", ",").alias("rows"))


@query(f"WITH {EV}, b AS (SELECT event_type, s - s % 86400 AS start_s, sum(k) AS t, count(k) AS n FROM ev GROUP BY ALL) SELECT event_type, start_s, round((sum(t) OVER w) / (sum(n) OVER w), 4) AS running_avg FROM b WINDOW w AS (PARTITION BY event_type ORDER BY start_s)")
def running_avg(spark, d):
    out = windows.running_average(events(spark, d), seconds(), 86400, "k", "event_type")
    return out.withColumn("running_avg", F.round("running_avg", 4))


@query(f"WITH {EV} SELECT s - s % 86400 AS start_s, count(*) / count(DISTINCT event_type) AS avg_visits FROM ev GROUP BY ALL")
def avg_visits_per_page(spark, d):
    b = windows.floored(events(spark, d), seconds(), 86400, ["event_type"], [count()])
    return b.groupBy("start_s").agg((F.sum("cnt") / F.count("*")).alias("avg_visits"))


LATE = "a AS (SELECT event_id, s, s + (event_id * 7919) % 7200 AS arrival FROM ev), b AS (SELECT *, max(s) OVER (ORDER BY arrival, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM a)"


@query(f"WITH {EV}, {LATE} SELECT event_id, s FROM b WHERE s - s % 300 + 600 + 60 <= seen - 1")
def late_rows(spark, d):
    """Events that arrive out of order, after all their ten-minute windows were closed."""
    e = events(spark, d).select("event_id", seconds().alias("s"), (seconds() + F.col("event_id") * 7919 % 7200).alias("arrival"))
    return windows.late_rows(e, "arrival", "s", size=600, slide=300, delay=1, lateness=60).select("event_id", "s")


@query(f"WITH {EV} SELECT s - s % 3600 AS start_s, count(*) AS cnt FROM ev WHERE event_type = 'view' GROUP BY ALL")
def pv_hourly(spark, d):
    from rillway.operators.aggregates import salted_count

    e = events(spark, d).where("event_type = 'view'").withColumn("start_s", seconds() - F.pmod(seconds(), F.lit(3600)))
    return salted_count(e, ["start_s"], F.pmod(F.col("event_id"), F.lit(8)))


@query(f"WITH {EV} SELECT s - s % 3600 AS start_s, count(DISTINCT user_id) AS uv FROM ev GROUP BY ALL")
def uv_hourly(spark, d, behavior=None):
    return windows.floored(_of(events(spark, d), behavior), seconds(), 3600, [], [F.count_distinct("user_id").alias("uv")])


@query(f"WITH {EV} SELECT DISTINCT s - s % 3600 AS start_s, true AS near FROM ev")
def uv_hourly_approx(spark, d):
    """Distinct users by a sketch of fixed size, and whether it lies within five in a hundred of the exact count."""
    out = windows.unique_counts(events(spark, d), seconds(), 3600, "user_id", 0.01)
    return out.select("start_s", (F.abs(F.col("uv") - F.col("exact")) <= F.greatest(F.lit(1), 0.05 * F.col("exact"))).alias("near"))


@query(f"WITH {EV} SELECT event_id, event_type, k FROM ev QUALIFY row_number() OVER (PARTITION BY k ORDER BY ts, event_id) = 1")
def first_by_key(spark, d):
    return state.first_by(events(spark, d), ["k"], ["ts", "event_id"]).select("event_id", "event_type", "k")


@query(f"WITH {EV} SELECT event_id, event_type, k FROM ev QUALIFY row_number() OVER (PARTITION BY k ORDER BY ts DESC, event_id DESC) = 1")
def latest_by_key(spark, d):
    return state.latest_by(events(spark, d).select("k", "ts", "event_id", "event_type"), ["k"], ["ts", "event_id"]).select("event_id", "event_type", "k")


@query(f"WITH {EV} SELECT user_id, s - s % 86400 AS day_s, min(s) AS first_s FROM ev WHERE event_type <> 'error' GROUP BY ALL")
def login_first(spark, d):
    e = events(spark, d).where("event_type <> 'error'")
    return e.groupBy("user_id", (seconds() - F.pmod(seconds(), F.lit(86400))).alias("day_s")).agg(F.min(seconds()).alias("first_s"))


@query(f"WITH {PG} SELECT mid, page_id, s FROM pg WHERE last_page_id IS NULL QUALIFY row_number() OVER (PARTITION BY mid, s // 86400 ORDER BY ts, event_id) = 1")
def uv_daily(spark, d):
    p = page_log(spark, d).where("last_page_id IS NULL")
    return state.first_by(p, ["mid", F.to_date("ts")], ["ts", "event_id"]).select("mid", "page_id", seconds().alias("s"))


@query(f"WITH {PG}, f AS (SELECT *, first_value(s // 86400) OVER w AS day1, first_value(is_new) OVER w AS new1 FROM pg WINDOW w AS (PARTITION BY mid ORDER BY ts, event_id)) SELECT event_id, is_new, CASE WHEN is_new = 1 AND s // 86400 <> CASE WHEN new1 = 1 THEN day1 ELSE day1 - 1 END THEN 0 ELSE is_new END AS fixed FROM f")
def fix_is_new(spark, d):
    out = state.repair_is_new(page_log(spark, d), "mid", ["ts", "event_id"], F.to_date("ts"), "is_new")
    return out.select("event_id", "is_new", "fixed")


@query(f"WITH {EV} SELECT s // 86400 AS day, count(DISTINCT user_id) AS dau FROM ev GROUP BY ALL")
def dau(spark, d):
    e = events(spark, d).select(F.expr("unix_timestamp(cast(ts AS timestamp)) div 86400").alias("day"), "user_id")
    return e.dropDuplicates(["day", "user_id"]).groupBy("day").agg(F.count("*").alias("dau"))


CLICKS = "c AS (SELECT event_id, user_id, k % 10 AS ad_id, s // 86400 AS day, row_number() OVER (PARTITION BY user_id, k % 10, s // 86400 ORDER BY ts, event_id) AS n FROM ev WHERE event_type = 'click')"


def _clicks(spark, d):
    e = events(spark, d).where("event_type = 'click'").withColumn("ad_id", F.col("k") % 10).withColumn("day", F.expr("unix_timestamp(cast(ts AS timestamp)) div 86400"))
    return state.capped(e, ["user_id", "ad_id", "day"], ["ts", "event_id"], 1)


@query(f"WITH {EV}, {CLICKS} SELECT event_id, user_id, ad_id FROM c WHERE n <= 1")
def ad_clicks_pass(spark, d):
    return _clicks(spark, d)[0].select("event_id", "user_id", "ad_id")


@query(f"WITH {EV}, {CLICKS} SELECT user_id, ad_id, day, 'more than 1 click' AS msg FROM c WHERE n = 2")
def ad_blacklist(spark, d):
    return _clicks(spark, d)[1].select("user_id", "ad_id", "day", F.lit("more than 1 click").alias("msg"))


@query(f"WITH {EV}, {CLICKS} SELECT n.n_name AS nation, day, count(*) AS cnt FROM c JOIN customer ON c_custkey = user_id JOIN nation n ON n_nationkey = c_nationkey WHERE c.n <= 1 GROUP BY ALL")
def ad_click_city(spark, d):
    """Clicks by place and day once repeated ones are gone."""
    c = _clicks(spark, d)[0].join(table(spark, d, "customer"), F.col("user_id") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy(F.col("n_name").alias("nation"), "day").agg(count())


@query(f"WITH {EV} SELECT event_id, user_id, k, sum(k) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS total FROM ev")
def rolling_reduce(spark, d):
    from rillway.operators.aggregates import rolling

    return rolling(events(spark, d), "user_id", ["ts", "event_id"], F.sum("k"), "total").select("event_id", "user_id", "k", "total")
