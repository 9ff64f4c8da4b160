"""Queries over the test tables and their SQL twins."""

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with SQL that DuckDB runs on the same tables."""

    def take(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return take


#: Common table expressions for the SQL twins: events with their item and second, page views, change feed.
EV = "ev AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)"
PG = (
    EV
    + """, pg0 AS (SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ls, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS le FROM ev),
 pg AS (SELECT event_id, user_id AS mid, event_type AS page_id, CASE WHEN s - ls <= 21600 THEN le END AS last_page_id, user_id % 3 AS ch, user_id % 5 AS ar, user_id % 2 AS vc,
   (user_id + event_id) % 2 AS is_new, CAST(trunc(value) AS BIGINT) AS during_time, ts, s, k FROM pg0)"""
)
FEED = """feed AS (SELECT 'insert' AS type, o_orderkey AS id, o_custkey AS user_id, 'O' AS status, NULL AS old_status, o_totalprice AS total, o_orderpriority AS priority, o_orderdate AS ts, o_orderkey * 3 AS seq FROM orders
 UNION ALL SELECT 'update', o_orderkey, o_custkey, o_orderstatus, 'O', o_totalprice, o_orderpriority, o_orderdate + INTERVAL 1 DAY, o_orderkey * 3 + 1 FROM orders WHERE o_orderstatus <> 'O'
 UNION ALL SELECT 'delete', o_orderkey, o_custkey, o_orderstatus, NULL, o_totalprice, o_orderpriority, o_orderdate + INTERVAL 2 DAY, o_orderkey * 3 + 2 FROM orders WHERE o_orderkey % 10 = 0)"""
