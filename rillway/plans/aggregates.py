"""Queries: aggregations, rankings, sets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Observation
from pyspark.sql import functions as F

from rillway.adapters import events, table
from rillway.functions.scalars import truncated_mean
from rillway.operators import aggregates, ranking
from rillway.registry import EV, query
from rillway.sources.sinks import work_folder

money = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty, max(l_extendedprice) AS top, min(l_discount) AS low FROM lineitem GROUP BY 1, 2")
def agg_basic(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), money("l_quantity").alias("qty"), F.max("l_extendedprice").alias("top"), F.min("l_discount").alias("low"))


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def agg_cube(spark, d):
    return table(spark, d, "orders").cube(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))


@query("SELECT r_name AS region, n_name AS nation, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)")
def agg_rollup(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.rollup(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority AS priority, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1")
def agg_pivot(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count("o_orderkey")).na.fill(0)


@query(f"WITH {EV} SELECT event_type, CAST(sum(k) AS BIGINT) AS total, CAST(5 + sum(k) AS BIGINT) AS folded, count(*) AS n, string_agg(DISTINCT CAST(k AS VARCHAR), ',' ORDER BY CAST(k AS VARCHAR)) AS items FROM ev GROUP BY 1")
def kv_aggs(spark, d):
    # distinct values first: what a hot key gathers is its values, not its rows
    by_item = events(spark, d).groupBy("event_type", "k").agg(F.count("*").alias("n"))
    g = by_item.groupBy("event_type").agg(F.sum(F.col("k") * F.col("n")).alias("total"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.col("k").cast("string"))).alias("s"))
    return g.select("event_type", "total", (F.col("total") + 5).alias("folded"), "n", F.array_join("s", ",").alias("items"))


@query(f"WITH {EV}, m AS (SELECT event_id % 4 AS b, event_type, max(k) AS m FROM ev GROUP BY ALL) SELECT event_type, CAST(sum(m) AS BIGINT) AS total FROM m GROUP BY 1")
def two_level_agg(spark, d):
    return aggregates.two_level(events(spark, d).withColumn("b", F.col("event_id") % 4), "b", "event_type", "k")


@query(f"WITH {EV} SELECT user_id, CAST(sum(k) // count(k) AS BIGINT) AS avg_k FROM ev GROUP BY 1")
def int_avg(spark, d):
    return events(spark, d).groupBy("user_id").agg(aggregates.integer_average("k").alias("avg_k"))


@query(f"WITH {EV} SELECT CAST(sum(k) AS BIGINT) AS total, CAST(sum(k) + 3 AS BIGINT) AS with_zero, max(event_id) AS last FROM ev")
def global_agg(spark, d):
    return events(spark, d).agg(F.sum("k").alias("total"), (F.sum("k") + 3).alias("with_zero"), F.max("event_id").alias("last"))


@query(f"WITH {EV} SELECT event_type, CAST(sum(k) // count(k) AS DOUBLE) AS avg_k FROM ev GROUP BY 1")
def udaf_avg(spark, d):
    """A grouped vectorised function over partial sums, so that a hot key comes to one task as a few rows. See int_avg for the built-in."""
    part = events(spark, d).groupBy("event_type", F.pmod("event_id", F.lit(64)).alias("part")).agg(F.sum("k").alias("total"), F.count("k").alias("n"))
    return part.groupBy("event_type").agg(truncated_mean(F.col("total"), F.col("n")).alias("avg_k"))


@query("SELECT count(*) AS n, count(*) FILTER (contains(p_name, 'h')) AS with_h, CAST(sum(p_size) AS BIGINT) AS sizes FROM part")
def observe_counts(spark, d):
    """What an accumulator would gather, observed while the rows are written."""
    seen = Observation("parts")
    p = table(spark, d, "part").observe(seen, F.count("*").alias("n"), F.count(F.when(F.contains("p_name", F.lit("h")), 1)).alias("with_h"), F.sum("p_size").cast("bigint").alias("sizes"))
    p.write.parquet(work_folder(spark, "observed"))
    return spark.createDataFrame([tuple(seen.get[c] for c in ("n", "with_h", "sizes"))], "n bigint, with_h bigint, sizes bigint")


MEASURES = ("l_quantity", "l_extendedprice", "l_discount")


@query(" UNION ALL ".join(f"SELECT '{name}' AS summary, " + ", ".join(f"round(CAST({f}({c}) AS DOUBLE), 4) + 0.0 AS {c}" for c in MEASURES) + " FROM lineitem" for name, f in (("count", "count"), ("mean", "avg"), ("stddev", "stddev_samp"), ("min", "min"), ("max", "max"))))
def describe(spark, d):
    t = table(spark, d, "lineitem").describe(*MEASURES)
    return t.select("summary", *[(F.round(F.col(c).cast("double"), 4) + F.lit(0.0)).alias(c) for c in MEASURES])


@query("SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 0.015 * (SELECT count(*) FROM lineitem)")
def freq_items(spark, d):
    """Values of a share of the rows: candidates from a sketch that misses none, then counted."""
    t = table(spark, d, "lineitem").select("l_quantity")
    few = t.stat.freqItems(["l_quantity"], 0.01).select(F.explode("l_quantity_freqItems").alias("l_quantity"))
    total = t.count()
    return t.join(few, "l_quantity").groupBy("l_quantity").agg(F.count("*").alias("n")).where(F.col("n") >= 0.015 * total)


@query("SELECT lang, count(*) AS n, max(n_chars) AS longest, min(n_chars) AS shortest, CAST(sum(n_chars) AS BIGINT) AS total, count(DISTINCT source) AS sources FROM documents GROUP BY 1")
def doc_aggs(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.max("n_chars").alias("longest"), F.min("n_chars").alias("shortest"), F.sum("n_chars").alias("total"), F.count_distinct("source").alias("sources"))


@query("SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY 1")
def split_distinct(spark, d):
    return aggregates.split_distinct(table(spark, d, "events"), ["event_type"], "user_id")


@query(f"WITH {EV} SELECT event_type AS word, CAST(sum(k) AS BIGINT) AS weight FROM ev GROUP BY 1 ORDER BY weight DESC, word LIMIT 3")
def wordcount_top(spark, d):
    """The three words of the largest weight."""
    return events(spark, d).groupBy(F.col("event_type").alias("word")).agg(F.sum("k").alias("weight")).orderBy(F.desc("weight"), "word").limit(3)


@query("SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer")
def sort_basic(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, d, "customer").select("c_custkey", "c_nationkey", F.row_number().over(w).cast("bigint").alias("place")).sortWithinPartitions("c_nationkey", "place")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 40")
def page_docs(spark, d):
    return ranking.page(table(spark, d, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), F.col("doc_id")], 3, 20)


@query()
def sample(spark, d):
    return table(spark, d, "lineitem").sample(False, 0.1, 7).select("l_orderkey", "l_linenumber")


@query("SELECT s_nationkey AS nation FROM supplier UNION ALL SELECT c_nationkey FROM customer UNION ALL SELECT n_nationkey FROM nation")
def union_all(spark, d):
    s, c, n = (table(spark, d, t).select(F.col(f"{t[0]}_nationkey").alias("nation")) for t in ("supplier", "customer", "nation"))
    return s.unionByName(c).unionByName(n)


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation")))


@query("SELECT o_custkey AS custkey FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events)")
def subtract(spark, d):
    return ranking.subtract(table(spark, d, "orders").select(F.col("o_custkey").alias("custkey")), table(spark, d, "events").select(F.col("user_id").alias("custkey")))


@query("SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def distinct(spark, d):
    return table(spark, d, "orders").select("o_custkey", "o_orderstatus").distinct()


@query("SELECT l_orderkey, count(*) AS n, 1::BIGINT AS parts FROM lineitem GROUP BY 1")
def partition_sizes(spark, d):
    """Rows of each key after dealing by key, and in how many partitions they lie."""
    p = table(spark, d, "lineitem").select("l_orderkey").repartition("l_orderkey").withColumn("part", F.spark_partition_id())
    return p.groupBy("l_orderkey", "part").agg(F.count("*").alias("n")).groupBy("l_orderkey").agg(F.sum("n").alias("n"), F.count("*").alias("parts"))


@query("SELECT l_returnflag AS flag, count(*) AS n, CAST(max(l_partkey) AS BIGINT) AS top FROM lineitem GROUP BY 1")
def map_partitions(spark, d):
    """Each partition folded to a few rows by a function over its batches, then put together."""

    def fold(batches):
        seen: dict = {}
        for b in batches:
            for flag, g in b.groupby("l_returnflag")["l_partkey"]:
                n, top = seen.get(flag, (0, -1))
                seen[flag] = n + len(g), max(top, int(g.max()))
        yield pd.DataFrame([(k, n, top) for k, (n, top) in seen.items()], columns=["flag", "n", "top"])

    part = table(spark, d, "lineitem").select("l_returnflag", "l_partkey").mapInPandas(fold, "flag string, n bigint, top bigint")
    return part.groupBy("flag").agg(F.sum("n").alias("n"), F.max("top").alias("top"))


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS place FROM orders")
def sort_global(spark, d):
    """All rows in order, with their places."""
    from rillway.operators.joins import numbered

    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", (-F.col("o_totalprice")).alias("down"))
    return numbered(o, ["down", "o_orderkey"], "place").drop("down").orderBy(F.desc("o_totalprice"), "o_orderkey")


@query("SELECT 'kept' AS how, event_type, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'checkpointed', event_type, count(*) FROM events GROUP BY 2")
def kept_twice(spark, d):
    """Rows kept in executors' memory and disk, and rows written to the shared folder, each used again."""
    e = table(spark, d, "events").select("event_type")
    how = lambda df, name: df.groupBy("event_type").agg(F.count("*").alias("n")).select(F.lit(name).alias("how"), "event_type", "n")
    return how(ranking.keep(e, "persist"), "kept").unionByName(how(ranking.keep(e, "checkpoint"), "checkpointed"))


@query("SELECT n_regionkey AS region, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM nation GROUP BY 1")
def group_list(spark, d):
    g = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.sort_array(F.collect_list("n_name")).alias("l"))
    return g.select("region", F.array_join("l", ",").alias("nations"))


@query("SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status FROM orders WHERE o_orderstatus <> 'P'")
def na_drop(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status")).na.drop()
