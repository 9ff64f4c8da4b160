"""Steps whose cost has to follow the rows, not the number of keys or a key's size."""

import contextlib
import io

import pandas as pd
from pyspark.sql import functions as F

from rillway.operators import joins, sequences, windows
from rillway.streaming import stateful, twins


def plan(df):
    with contextlib.redirect_stdout(text := io.StringIO()):
        df.explain("formatted")
    return text.getvalue()


def test_join_of_hot_keys_is_dealt_to_tasks(spark):
    a = spark.range(400).select(F.col("id").alias("x"), F.expr("id div 399").alias("k"))
    b = spark.range(600).select(F.col("id").alias("y"), F.when(F.col("id") < 599, F.expr("id % 3 div 2")).alias("j"))
    got = joins.dealt_join(a, b, "k", "j", block=50)
    want = a.join(b, F.col("k") == F.col("j"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # 399 x 400 pairs of key 0 in blocks of 50 x 50
    most = got.where("k = 0").groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
    assert most < 160_000 / 4


def test_join_without_partners(spark):
    a, b = spark.range(3).withColumnRenamed("id", "x"), spark.range(5, 7).withColumnRenamed("id", "y")
    assert joins.dealt_join(a, b, "x", "y").collect() == []


def test_unique_counts_take_one_sketch_for_a_window(spark):
    e = spark.createDataFrame([(1, 7), (2, 7), (3, 8), (3601, 7), (3602, None), (7200, None)], "s bigint, u bigint")
    out = windows.unique_counts(e, F.col("s"), 3600, "u", 0.01)
    assert sorted(map(tuple, out.collect())) == [(0, 2, 2), (3600, 1, 1), (7200, 0, 0)]
    keyed = [block for block in plan(out).split("\n\n") if "Aggregate" in block and "Functions" in block and "approx_count_distinct" in block]
    assert keyed and all("Keys [1]" in block for block in keyed)


def test_stages_read_many_keys_in_one_go(spark):
    e = spark.range(3000).select((F.col("id") % 1000).alias("u"), F.expr("id div 1000 * 40 + id % 7").alias("s"), "id")
    out = sequences.detect(e.withColumn("kind", F.col("s") % 2), "u", "id", "s", [sequences.Stage(F.col("kind") == 0), sequences.Stage(F.col("kind") == 0, after=sequences.ANY)], 60)
    rows = {}
    for i in range(3000):
        rows.setdefault(i % 1000, []).append((i // 1000 * 40 + i % 7, i))
    want = sorted((u, a[0], b[0], [a[1], b[1]]) for u, r in rows.items() for a in r for b in r if (a < b and a[0] % 2 == b[0] % 2 == 0 and b[0] - a[0] <= 60))
    assert sorted(map(tuple, out.collect())) == want and want
    assert "FlatMapGroups" not in plan(out)


def test_stages_with_a_text_key_and_more_matches_than_a_batch(spark):
    e = spark.range(300).select(F.lit("a").alias("u"), F.lit(5).alias("s"), "id", F.lit(True).alias("hit"))
    out = sequences.detect(e, "u", "id", "s", [sequences.Stage(F.col("hit")), sequences.Stage(F.col("hit"), after=sequences.ANY)], 60)
    assert out.count() == 300 * 299 // 2 and out.first()["u"] == "a"


def test_ordered_state_takes_batches_of_columns(spark):
    class State(dict):
        value = None
        get, clear = lambda self, *a: self.value, lambda self: setattr(self, "value", None)
        update = lambda self, v: setattr(self, "value", v)
        containsKey, removeKey, getValue, updateValue = dict.__contains__, dict.pop, dict.get, dict.__setitem__

    class Handle:
        def __init__(self):
            self.timers, self.getMapState, self.getValueState = set(), lambda *a: State(), lambda *a: State()
            self.registerTimer, self.deleteTimer = self.timers.add, self.timers.remove

    class Times:
        getCurrentWatermarkInMs = lambda self: 5000

    step = stateful.InOrder(lambda key, memory, rows, now: (None, [(key[0], id_, kind) for _, _, id_, kind in rows], None), ["_k0"], [], ["u", "id", "kind"], ["id", "kind"])
    step.init(Handle())
    # a null is told by its bit, and whole numbers stay exact beside it
    given = pd.DataFrame([(7, 2_000_000, 2**53 + 1, "b", 0), (0, 1_000_000, 0, "", 1 | 4 | 8), (7, 9_000_000, 3, "c", 0)], columns=["c0", "c1", "c2", "c3", "nulls"])
    assert list(step.handleInputRows((1,), iter([given]), None)) == [] and step.handle.timers == {1000}
    out = [t for f in step.handleExpiredTimer((1,), Times(), None) for t in f.itertuples(index=False, name=None)]
    assert sorted(out, key=str) == [(7, 2**53 + 1, "b"), (None, None, None)] and 9000 in step.handle.timers


def test_ordered_state_keeps_nulls_of_a_stream(spark):
    rows = [(1, 2**60 + 1, 10, "a"), (1, None, 20, None), (None, 3, 30, "b"), (-1, -1, 99_999, "closing")]
    e = spark.createDataFrame(rows, "u bigint, id bigint, s bigint, kind string").withColumn("ts", F.timestamp_seconds("s"))
    step = lambda key, memory, rows, now: (None, [(key[0], id_, kind) for _, _, id_, kind in rows], None)
    stream = twins.arrivals(e, "ts", F.lit(0), stretches=2, closing={"u": F.lit(-1), "s": F.lit(10**7)})
    out = twins.drain(stateful.in_order(stream, "u", "1 second", step, "n bigint", "u bigint, id bigint, kind string", "id bigint, kind string"), "append")
    got = sorted(map(tuple, out.where("coalesce(u, 0) >= 0").select("u", "id", "kind").collect()), key=str)
    assert got == sorted([r[:2] + r[3:] for r in rows[:3]], key=str)
