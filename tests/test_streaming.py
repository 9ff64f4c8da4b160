"""Streams in several micro-batches, with rows that come out of order, late rows, and a checkpoint to go on from."""

import os

import pytest
from pyspark.sql import functions as F

from rillway import catalog
from rillway.sources import readers, sinks
from rillway.streaming import stateful, twins

SF = "/root/testdata/sf0.001"
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, k long"


def batches(spark, path, *groups):
    """Each group of (event_id, second, user, type) becomes a file, in order; a row of the year 2100 ends them."""
    for rows in [*groups, [(-1, 4_102_444_800, -1, twins.CLOSING)]]:
        d = spark.createDataFrame([(i, s, u, t, 0.0, u) for i, s, u, t in rows], "event_id long, s long, user_id long, event_type string, value double, k long")
        d.selectExpr("event_id", "timestamp_seconds(s) AS ts", "user_id", "event_type", "value", "k").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_stretches_are_micro_batches(spark):
    got = twins.drain(twins.event_stream(spark, SF, lag=86400, closing=True), "append")
    assert got.select("batch").distinct().count() == 4
    times = got.groupBy("batch").agg(F.min("ts").alias("low"), F.max("ts").alias("high")).orderBy("batch").collect()
    assert any(b.low < a.high for a, b in zip(times, times[1:]))  # rows of a later batch are older than some before


def test_sessions_carry_no_other_columns(spark, monkeypatch):
    """The stream of sessions is written with the two columns that it needs, in the order of arrival that a dropped column sets; the setting for uncounted state is taken back."""
    made, arrivals = [], twins.arrivals
    monkeypatch.setattr(twins, "arrivals", lambda *a, **k: made.append(arrivals(*a, **k)) or made[-1])
    got = catalog.QUERIES["stream_session_count"](spark, SF)
    assert made[0].columns == ["user_id", "ts"]
    e = spark.read.parquet(f"{SF}/events.parquet")
    assert got.agg(F.sum("cnt")).first()[0] == e.count() and got.where("user_id < 0").count() == 0
    came = [twins.drain(x, "append").where("user_id >= 0").groupBy("batch").agg(F.min("ts"), F.max("ts"), F.count("*")) for x in (made[0], twins.event_stream(spark, SF, closing=True))]
    assert rows(came[0], *came[0].columns) == rows(came[1], *came[1].columns)
    assert spark.conf.get(twins.COUNTING, "true") == "true"


def test_fails_over_batches(spark, tmp_path):
    e = batches(spark, f"{tmp_path}/e", [(1, 10, 7, "error"), (3, 30, 7, "error")], [(2, 20, 7, "error"), (4, 40, 7, "view")], [(5, 50, 7, "error")], [(6, 60, 7, "error"), (7, 70, 7, "error")])
    assert rows(twins.drain(stateful.consecutive_fails(e, 3, 20, "1 minute"), "append"), "user_id", "first_s", "last_s") == [(7, 10, 30), (7, 50, 70)]


def test_late_rows_are_dropped(spark, tmp_path):
    """A row behind the watermark doesn't come into the result; one inside the delay does."""
    e = batches(spark, f"{tmp_path}/e", [(1, 1000, 1, "view")], [(2, 5000, 1, "view")], [(3, 5100, 1, "view")], [(4, 4990, 2, "view"), (5, 100, 3, "view")], [(6, 6000, 1, "view")])
    assert rows(twins.drain(stateful.first_of_day(e, "user_id", "10 minutes"), "append").where("event_id > 0"), "user_id", "event_id", "s") == [(1, 1, 1000), (2, 4, 4990)]
    counts = twins.folded(twins.window_counts(e, "1 hour", None, [], "10 minutes"), ["start_s"])
    assert rows(counts.where("start_s < 10000"), "start_s", "cnt") == [(0, 1), (3600, 4)]


def test_timers_and_time_to_live(spark, tmp_path):
    e = batches(spark, f"{tmp_path}/e", [(1, 100, 1, "signup"), (2, 100, 2, "signup")], [(3, 130, 1, "purchase")], [(4, 400, 3, "view")], [(5, 500, 2, "purchase"), (6, 510, 1, "signup")])
    got = twins.drain(stateful.paid_or_timeout(e, "signup", "purchase", 60, "1 second"), "append")
    assert rows(got, "user_id", "created_s", "paid_s", "status") == [(1, 100, 130, "paid"), (1, 510, None, "timeout"), (2, 100, None, "timeout")]
    assert got.where("user_id = 2").first().batch < got.agg(F.max("batch")).first()[0]  # the timer fired before the end
    last = twins.drain(stateful.last_after_wait(e.where("event_type <> 'closing'"), "user_id", 50, "1 second"), "append")
    assert (1, 130) in rows(last, "user_id", "s")


def test_resume_from_a_checkpoint(spark, tmp_path):
    path, place = f"{tmp_path}/e", f"{tmp_path}/progress"
    e = batches(spark, path, [(1, 10, 1, "view")], [(2, 20, 2, "view")]).where("event_id > 0")
    assert rows(twins.drain(e, "append", place), "event_id") == [(1,), (2,)]
    batches(spark, path, [(3, 30, 1, "view")])
    assert rows(twins.drain(e, "append", place), "event_id") == [(3,)]
    assert rows(twins.drain(e, "append", place), "event_id") == []


def test_zero_delay_and_trigger_interval(spark, tmp_path):
    e = batches(spark, f"{tmp_path}/e", [(1, 10, 1, "view")], [(2, 3700, 1, "view")], [(4, 3800, 1, "view")], [(3, 20, 1, "view")])
    got = twins.drain(twins.window_counts(e, "1 hour", None, [], "0 seconds"), "append", interval="1 second")
    assert rows(got.where("start_s = 0"), "start_s", "cnt") == [(0, 1)]


def test_generated_rows(spark):
    a, b, c = (readers.generated(spark, 100, seed).collect() for seed in (1, 1, 2))
    assert len(a) == 100 and a == b and a != c


def test_records_with_their_position(spark):
    d = spark.createDataFrame([('{"a":"x"}', 3, 7), ("", 1, 1), (None, 1, 2)], "value string, partition int, offset long")
    assert [r.value for r in readers.with_position(d).collect()] == ['{"a":"x","partition":"3","offset":"7"}']


@pytest.fixture
def derby(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    try:
        spark._jvm.java.lang.Class.forName("org.apache.derby.jdbc.EmbeddedDriver")
    except Exception:
        pytest.skip("no database driver")
    return url


def test_jdbc_merge(spark, derby):
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    frame = lambda *x: spark.createDataFrame(list(x), "id int, v string, ver int, mark string")
    sinks.jdbc_append(frame((1, "a", 1, "m"), (2, "b", 5, "m")), derby, "goods", ["mark"], **driver)
    write = sinks.jdbc_upsert(derby, "goods", "id", "ver", ["id", "v", "ver"], **driver)
    write(frame((1, "c", 2, "m"), (2, "d", 4, "m"), (3, "e", 1, "m"), (3, "f", 2, "m")), 0)
    write(frame((3, "g", 3, "m")), 1)
    got = readers.jdbc(spark, derby, "goods", "id", 0, 10, 2, **driver)
    assert sorted(tuple(r) for r in got.collect()) == [(1, "c", 2), (2, "b", 5), (3, "g", 3)]


def test_shared_folder_is_asked_for(spark, monkeypatch):
    monkeypatch.setattr(sinks.tempfile, "mkdtemp", lambda **k: "/tmp/none")
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        assert sinks.work_folder(spark, "x").startswith("/tmp/none/x-")

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        sinks.work_folder(Cluster, "x")
    assert os.path.sep in SF


def test_text_and_console(spark, tmp_path, capfd):
    d = spark.createDataFrame([("x",), ("y",)], "line string")
    sinks.text_gzip(d, "line", f"{tmp_path}/t")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/t").collect()) == ["x", "y"]
    sinks.to_console(d)
