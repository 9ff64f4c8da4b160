"""Small worked examples, plans, and streams with rows that arrive late."""

import pytest
from pyspark.sql import functions as F

from rillway.catalog import QUERIES
from rillway.functions import scalars
from rillway.operators import aggregates, cdc, joins, parsing, patterns, ranking, state, windows

SF = "/root/testdata/sf0.001"


def ids(df, *cols):
    return sorted(tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect())


def test_sets(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "v int") for xs in ([1, 2, 3, 3], [3, 4, 5]))
    assert ids(a.intersect(b), "v") == [3]
    assert ids(a.unionByName(b), "v") == [1, 2, 3, 3, 3, 4, 5]
    assert ids(ranking.subtract(a, b), "v") == [1, 2]
    assert ids(ranking.subtract(b, a), "v") == [4, 5]


def test_keyed_aggregates(spark):
    d = spark.createDataFrame([("a", 1, 0), ("b", 5, 0), ("b", 2, 1), ("c", 4, 1), ("c", 3, 1)], "k string, v int, part int")
    assert ids(d.groupBy("k").agg(F.sum("v").alias("s")), "k", "s") == [("a", 1), ("b", 7), ("c", 7)]
    assert ids(aggregates.two_level(d, "part", "k", "v"), "k", "total") == [("a", 1), ("b", 7), ("c", 4)]
    assert ids(d.groupBy("k").agg(aggregates.integer_average("v").alias("m")), "k", "m") == [("a", 1), ("b", 3), ("c", 3)]
    assert ids(aggregates.split_distinct(d, ["k"], "v"), "k", "n") == [("a", 1), ("b", 2), ("c", 2)]


def test_interval_join_bounds(spark):
    a = spark.createDataFrame([("u", 1200)], "k string, a int")
    b = spark.createDataFrame([("u", 60 * m) for m in (5, 10, 12, 22, 25, 26)] + [("v", 1200)], "k string, b int")
    assert ids(joins.interval_join(a, b, "k", "a", "b", -600, 300), "b") == [600, 720, 1320, 1500]


def test_late_rows(spark):
    at = lambda h, m, s: h * 3600 + m * 60 + s
    # fixed values: a worked example whose outcome must be the same
    times = [at(10, 25, 49), at(10, 25, 50), at(10, 25, 51), at(10, 26, 1), at(10, 25, 46), at(10, 15, 51)]
    d = spark.createDataFrame(list(enumerate(times)), "n long, s long")
    got = windows.late_rows(d, "n", "s", size=600, slide=5, delay=1, lateness=60, chunk=2)
    assert ids(got, "n") == []
    d = spark.createDataFrame([*enumerate([*times, at(10, 27, 1), at(10, 15, 51)])], "n long, s long")
    assert ids(windows.late_rows(d, "n", "s", size=600, slide=5, delay=1, lateness=60, chunk=2), "n") == [7]


def test_bounces(spark):
    # fixed values: a worked example whose outcome must be the same
    rows = [("101", 1, None, 10), ("102", 2, None, 12), ("102", 3, None, 15), ("102", 4, "detail", 30)]
    p = spark.createDataFrame(rows, "mid string, event_id int, last_page_id string, s int")
    assert ids(patterns.bounces(p, "mid", ["s"], "s", 10), "event_id") == [1, 2, 3]
    assert ids(patterns.lone_entries(p, "mid", ["s"], "s", 10), "event_id") == [1, 3]


def test_three_fails_overlap(spark):
    d = spark.createDataFrame([("u", i, i, k) for i, k in enumerate("FFFFSFF")], "u string, i int, s int, k string")
    assert ids(patterns.consecutive(d, "u", ["i"], "s", F.col("k") == "F", 3, 5), "first_s", "s") == [(0, 2), (1, 3)]
    assert ids(patterns.streak(d, "u", ["i"], F.col("k") == "F", 2), "i") == [1, 2, 3, 6]


def test_days_away(spark):
    d = spark.createDataFrame([("u", x) for x in ("2024-01-01", "2024-01-01", "2024-01-08", "2024-01-23", "2024-03-01")], "u string, d string")
    assert [r.away for r in state.days_away(d, "u", F.to_date("d")).orderBy("day").collect()] == [None, 7, 15, 38]


def test_repair_is_new(spark):
    rows = [("a", 1, "2024-01-01", 1), ("a", 2, "2024-01-01", 1), ("a", 3, "2024-01-02", 1), ("b", 1, "2024-01-05", 0), ("b", 2, "2024-01-05", 1)]
    d = spark.createDataFrame(rows, "m string, i int, d string, n int")
    assert [r.fixed for r in state.repair_is_new(d, "m", ["i"], F.to_date("d"), "n").orderBy("m", "i").collect()] == [1, 1, 0, 0, 0]


def test_upsert_and_changes(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "id int, v string, ver int")
    new = spark.createDataFrame([(1, "c", 1), (2, "d", 4), (3, "e", 1)], "id int, v string, ver int")
    assert ids(cdc.upsert(old, new, "id", "ver"), "id", "v") == [(1, "c"), (2, "b"), (3, "e")]
    feed = spark.createDataFrame([(1, "insert", 1), (1, "delete", 2), (2, "insert", 1)], "id int, type string, seq int")
    assert ids(cdc.apply_changes(feed, "id", "seq"), "id") == [2]


def test_parsing(spark):
    urls = spark.createDataFrame([("/a.css",), ("/b.html",), ("/c.ico",), ("/css",)], "url string")
    assert ids(parsing.without_static(urls), "url") == ["/b.html", "/css"]
    v = spark.createDataFrame([(None,), ("10.9",), ("11.5",), ("11.6",), ("12.3",), ("x.y",)], "v string")
    assert {r.v for r in parsing.version_gate(v, "v").collect()} == {None, "10.9", "11.5", "12.3"}
    line = spark.createDataFrame([("192.0.2.7 - - 03/02/2021:11:12:13 +0000 GET /shop/list",)], "line string")
    r = parsing.access_log(line).first()
    assert (r.ip, r.method, r.url, str(r.ts)) == ("192.0.2.7", "GET", "/shop/list", "2021-02-03 11:12:13")
    body = spark.createDataFrame([("v=1&e=%5B%7B%22a%22%3A%22x%22%7D%2C%7B%22b%22%3A%22y%22%7D%5D",)], "request_body string")
    assert ids(parsing.request_body(body, "request_body", ["v", "a", "b"]), "v", "a", "b") == [("1", "-", "y"), ("1", "x", "-")]
    text = spark.createDataFrame([("a\nb", None)], "x string, y string")
    assert text.select(parsing.text_rows(text, ["x", "y"]).alias("t")).first().t == "ab\x01\\N"


def test_scalars(spark):
    one = spark.range(1)
    got = one.select(
        scalars.pairs(F.lit("left=3&right=4"), "right").alias("a"), scalars.decode_url(F.lit("100%&x%3D1")).alias("b"), scalars.oplog_seconds(F.lit(1700000001 << 32 | 7)).alias("c"),
        scalars.mask_phone(F.lit("1381234567")).alias("d"), scalars.decrypt(scalars.encrypt(F.lit("x"), "0123456789abcdef"), "0123456789abcdef").alias("e"),
    ).first()
    assert tuple(got) == ("4", "100%&x=1", 1700000001, "138****567", "x")


def test_numbered_and_ranges(spark):
    d = spark.range(0, 1000, 3).withColumnRenamed("id", "v")
    assert ids(joins.numbered(d, ["v"]), "v", "idx") == [(3 * i, i) for i in range(334)]
    r = spark.createDataFrame([("a", 0, 9), ("b", 100, 70000)], "n string, low long, high long")
    x = spark.createDataFrame([(5,), (10,), (100,), (70000,), (70001,)], "v long")
    assert sorted((q.v, q.n or "") for q in joins.range_join(x, "v", r, "low", "high", 1000).collect()) == [(5, "a"), (10, ""), (100, "b"), (70000, "b"), (70001, "")]


@pytest.mark.parametrize("name", ["hot_items", "order_wide", "interval_join", "latest_by_key", "product_stats", "cdc_apply", "late_rows", "ip_range_join"])
def test_plans(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "PythonUDF" not in plan and "BatchEvalPython" not in plan
    if name == "hot_items":
        assert "WindowGroupLimit" in plan and "partial_count" in plan


def test_left_interval_join(spark):
    a = spark.createDataFrame([(1, "u", 100), (2, "u", 5000), (3, None, 5)], "row int, k string, a int")
    b = spark.createDataFrame([("u", 90), ("u", 110)], "k string, b int")
    got = joins.interval_join(a, b, "k", "a", "b", -20, 20, "left", ["row"])
    assert sorted((r.row, r.b or 0) for r in got.collect()) == [(1, 90), (1, 110), (2, 0), (3, 0)]
    with pytest.raises(ValueError):
        joins.interval_join(a, b, "k", "a", "b", -20, 20, "full")


def test_reconcile(spark):
    a = spark.createDataFrame([(1, "u", 100), (2, "u", 9000), (3, "v", 100)], "a_id int, k string, a int")
    b = spark.createDataFrame([(7, "u", 95), (8, "w", 100), (9, "u", 111)], "b_id int, k string, b int")
    got = joins.reconcile(a, b, "k", "a", "b", 5, 10, ["a_id"], ["b_id"])
    assert sorted((r.k, r.a_id or 0, r.b_id or 0, r.status) for r in got.collect()) == [("u", 0, 9, "right_only"), ("u", 1, 7, "matched"), ("u", 2, 0, "left_only"), ("v", 3, 0, "left_only"), ("w", 0, 8, "right_only")]


def test_control_holds_from_its_time(spark):
    m = spark.createDataFrame([(i, s) for i, s in enumerate((5, 10, 19, 20, 90, 4000))], "i int, s int")
    c = spark.createDataFrame([(10, "x"), (20, "y"), (20, "z"), (50, None)], "f int, word string")
    for chunk in (7, 3600):
        assert [(r.i, r.word) for r in joins.as_of_control(m, c, "s", "f", "word", chunk).orderBy("i").collect()] == [(0, None), (1, "x"), (2, "x"), (3, "z"), (4, None), (5, None)]


def test_camel_names(spark):
    assert scalars.camel_columns(spark.createDataFrame([(1, 2)], "order_id int, user_phone_no int")).columns == ["orderId", "userPhoneNo"]


def test_kept_rows(spark):
    d = spark.range(10)
    assert ranking.keep(d).count() == ranking.keep(d, "checkpoint").count() == 10


def test_config_that_is_removed(spark):
    changes = spark.createDataFrame([("a", "x", "c", 1), ("b", "y", "c", 2), ("a", "z", "u", 3), ("b", "y", "d", 4)], "source_table string, sink_table string, op string, seq int")
    assert ids(cdc.current_config(changes), "source_table", "sink_table") == [("a", "z")]


def test_upsert_batches(spark, tmp_path):
    from rillway.sources.sinks import upsert_batch

    write = upsert_batch(str(tmp_path / "t"), "id", "v")
    for n, rows in enumerate([[(1, 1), (2, 1)], [(2, 3), (3, 1)], [(2, 2), (1, 5)]]):
        write(spark.createDataFrame(rows, "id int, v int"), n)
    assert ids(spark.read.parquet(f"{tmp_path}/t"), "id", "v") == [(1, 5), (2, 3), (3, 1)]


def test_buckets_follow_the_table(spark, tmp_path):
    from rillway.sources.sinks import rebucket, upsert_batch

    path, frame = str(tmp_path / "t"), lambda *rows: spark.createDataFrame(list(rows), "id int, v int")
    upsert_batch(path, "id", "v")(frame(), 0)  # no rows, no table yet
    upsert_batch(path, "id", "v", rows_per_bucket=2, buckets=5)(frame(*[(i, 1) for i in range(40)]), 0)
    upsert_batch(path, "id", "v", buckets=9)(frame((3, 2), (50, 1)), 1)
    schema = "id int, v int, of int, bucket int"
    got = spark.read.schema(schema).parquet(path)
    assert {(r.of, r.bucket < 5) for r in got.collect()} == {(5, True)}
    want = sorted((i, 2 if i == 3 else 1) for i in [*range(40), 50])
    assert ids(got, "id", "v") == want
    to = rebucket(spark, path, str(tmp_path / "u"), "id", frame().schema, 7)
    upsert_batch(to, "id", "v")(frame((3, 1), (4, 9)), 2)
    got = spark.read.schema(schema).parquet(to)
    assert {r.of for r in got.collect()} == {7}
    assert ids(got, "id", "v") == sorted((i, 9 if i == 4 else v) for i, v in want)


def test_first_rows_set_the_buckets(spark, tmp_path):
    from rillway.sources.sinks import upsert_batch

    upsert_batch(str(tmp_path / "t"), "id", "id", rows_per_bucket=3)(spark.range(300), 0)
    assert spark.read.schema("of int").parquet(str(tmp_path / "t")).first().of == 100


def test_log_of_batches(spark, tmp_path):
    """A batch rewrites no rows that are there; folding them now and then keeps the newest row of each key, the latest batch's on ties, and leaves the base alone."""
    from rillway.sources.sinks import log_batch, read_log

    root, want, names, written = tmp_path / "t", {}, set(), 0
    write = log_batch(str(root), ["t", "id"], "v", within=["t"], fold_rows=50)
    schema = spark.createDataFrame([], "t string, id int, v int, b int").schema
    for n in range(12):
        rows = [("xy"[i % 2], i * 7 % 60, 1000 - i if n == 3 else (n + i) // 3, n) for i in range(0 if n == 1 else 20)]
        for _ in range(2 if n in (2, 6) else 1):  # one that runs again changes nothing
            before = {str(f) for f in root.glob("t=*/log=*/*.parquet")}
            write(spark.createDataFrame(rows, schema), n)
            after = {str(f) for f in root.glob("t=*/log=*/*.parquet")}
            written += len(after - before) > 0 and any("log=-" in f for f in after - before)
        for t, i, v, b in rows:
            if (t, i) not in want or v >= want[t, i][0]:
                want[t, i] = (v, b)
        got = {(r.t, r.id): (r.v, r.b) for r in read_log(spark, str(root), schema, ["t", "id"], "v").collect()}
        assert got == want
        names = {f.name for f in root.glob("t=*/log=*")}
        assert sum(x.startswith("log=-") for x in names) <= 1
    assert 2 <= written <= 4


def test_dimensions_by_table(spark, tmp_path):
    """Each row in the table that it names: keys of two tables stay apart, deletes hold against older changes that come late."""
    root, write = str(tmp_path / "t"), cdc.write_dimensions(str(tmp_path / "t"))

    def changes(*rows):
        d = spark.createDataFrame(list(rows), "sink_table string, sink_pk string, type string, id string, x string, seq long")
        return cdc.dimension_rows(d.withColumn("data", F.create_map(F.lit("id"), "id", F.lit("x"), "x")))

    write(changes(("a", "id", "insert", "1", "p", 1), ("b", "id", "insert", "1", "q", 2), ("b", "x", "insert", "1", "r", 3), ("b", "none", "insert", "7", "r", 3)), 0)
    write(changes(("a", "id", "delete", "1", None, 5), ("b", "id", "update", "1", "s", 4)), 1)
    write(changes(("a", "id", "update", "1", "late", 4), ("a", "id", "insert", "2", "t", 6)), 2)
    got = cdc.read_dimensions(spark, root).select("sink_table", "pk", F.col("data")["x"].alias("x"))
    assert ids(got, "sink_table", "pk", "x") == [("a", "2", "t"), ("b", "1", "s"), ("b", "r", "r")]
    assert (tmp_path / "t" / "sink_table=a").is_dir()
    plan = got.where("sink_table = 'a'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(sink_table" in plan


def test_cogroup_in_parts(spark):
    """A key of many rows in several rows, repeated values too; null keys match nothing, null values are left out."""
    a = spark.createDataFrame([(1, v // 7) for v in range(100)] + [(2, 5), (None, 8), (3, None)], "k int, v int")
    b = spark.createDataFrame([(1, -v) for v in range(15)] + [(4, 6), (None, 9)], "k int, w int")
    got = {(r.k, r.part, tuple(r.left), tuple(r.right)) for r in joins.cogroup_parts(a, b, "k", "v", "w", 10).collect()}
    left, right = sorted(v // 7 for v in range(100)), sorted(-v for v in range(15))
    want = {(1, i, tuple(left[10 * i : 10 * i + 10]), tuple(right[10 * i : 10 * i + 10])) for i in range(10)}
    assert got == want | {(2, 0, (5,), ()), (4, 0, (), (6,)), (None, 0, (8,), ()), (None, 0, (), (9,))}
    assert joins.cogroup_parts(a.where("false"), b.where("false"), "k", "v", "w").count() == 0


def test_seeded_numbers(spark):
    """The same for a key however the rows are dealt, evenly spread, others for another seed."""
    d = spark.range(20_000)
    pick = lambda x: x.select("id", scalars.seeded(F.col("id"), 3).alias("u"), scalars.seeded_between(F.col("id"), 3, -1, 1).alias("n"), scalars.seeded_choice(F.col("id"), 3, {"a": 1, "b": 3}).alias("c"))
    one = pick(d.repartition(3)).orderBy("id").collect()
    assert one == pick(d.coalesce(1)).orderBy("id").collect()
    assert all(0 <= r.u < 1 for r in one) and abs(sum(r.u for r in one) / len(one) - 0.5) < 0.01
    assert {r.n for r in one} == {-1, 0, 1} and abs(sum(r.c == "a" for r in one) / len(one) - 0.25) < 0.02
    assert one != d.select("id", scalars.seeded(F.col("id"), 4)).orderBy("id").collect()
    none = spark.createDataFrame([(None,)], "id long").select(scalars.seeded(F.col("id"), 3).alias("u"), scalars.seeded_choice(F.col("id"), 3, {"a": 1, "b": 3}).alias("c")).first()
    assert tuple(none) == (None, "b")


def test_sources_need_no_connector_to_import():
    from rillway.sources import readers, sinks

    assert callable(readers.kafka) and callable(sinks.to_kafka)


def test_made_up_visits(spark):
    """Ten sessions a user, up to five steps in each, columns by the action."""
    v = QUERIES["mock_visits"](spark, SF)
    users = spark.read.parquet(f"{SF}/customer.parquet").count()
    assert v.select("user_id", "session").distinct().count() == 10 * users
    assert v.where("step NOT BETWEEN 0 AND 4 OR (action = 'search') <> (keyword_id IS NOT NULL) OR (action = 'search') <> (item_id IS NULL)").count() == 0
    assert v.collect() == QUERIES["mock_visits"](spark, SF).collect()


def test_sample_share(spark):
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert 0.07 * n < QUERIES["sample"](spark, SF).count() < 0.13 * n


def test_keywords_of_texts_without_words(spark, tmp_path):
    """The query counts words alone, as its SQL does; the function gives the whole text where asked to."""
    texts = spark.createDataFrame([(1, "Ab, c ab"), (2, "¡¿—!"), (3, ""), (4, None)], "doc_id long, text string")
    texts.write.parquet(f"{tmp_path}/documents.parquet")
    assert ids(QUERIES["keyword_split"](spark, str(tmp_path)), "keyword", "n") == [("ab", 2), ("c", 1)]
    got = [r.w for r in texts.select(scalars.keywords("text").alias("w")).collect()]
    assert sorted(map(str, got)) == ["", "None", "ab", "ab", "c", "¡¿—!"]
