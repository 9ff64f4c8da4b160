"""Patterns against plain enumeration, and the handover from a snapshot at every position."""

import random
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rillway.operators import cdc, sequences
from rillway.operators.sequences import ANY, RELAXED, STRICT, Stage, _Plan


def brute(rows, wanted, within):
    """All id lists for stages of (letter, after, (low, high), again, until letter), by trying every choice of rows."""

    def follows(last, j, how, letter):
        if rows[j][1] != letter:
            return False
        between = [rows[k][1] for k in range(last + 1, j)]
        return how == ANY or (how == STRICT and not between) or (how == RELAXED and letter not in between)

    def grow(i, last, got):
        """got are the rows taken for stages before i."""
        if i == len(wanted):
            if got:
                yield got
            return
        letter, after, (low, high), again, until = wanted[i]

        def repeat(n, last, taken):
            if n >= low:
                yield from grow(i + 1, last, got + taken)
            if n < high:
                for j in range(last + 1, len(rows)) if got or taken else [last]:
                    how = again if n else after
                    if not (got or taken):
                        if rows[j][1] == letter:
                            yield from repeat(1, j, [j])
                        continue
                    if n and until and any(rows[k][1] == until for k in range(last + 1, j + 1)):
                        continue
                    if follows(last, j, how, letter):
                        yield from repeat(n + 1, j, [*taken, j])

        yield from repeat(0, last, [])

    out = []
    for start in range(len(rows)):
        for m in grow(0, start, []):
            if m[0] == start and rows[m[-1]][0] - rows[start][0] <= within:
                out.append(tuple(m))
    return sorted(out)


stage = st.tuples(st.sampled_from("ab"), st.sampled_from([STRICT, RELAXED, ANY]), st.sampled_from([(1, 1), (2, 2), (1, 3), (2, 3)]), st.sampled_from([STRICT, RELAXED, ANY]), st.sampled_from([None, "c", "b"]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=8), st.lists(stage, min_size=1, max_size=3), st.sampled_from([2, 4, 100]))
def test_fold_against_enumeration(letters, wanted, within):
    rows = [(k, x) for k, x in enumerate(letters)]
    plan = _Plan(tuple(w[2] for w in wanted), tuple(w[1] for w in wanted), tuple(w[3] for w in wanted))
    bits = [(s, s, sum((x == w[0]) << 2 * i | (x == w[4]) << 2 * i + 1 for i, w in enumerate(wanted))) for s, x in rows]
    got = sorted(tuple(i for _, i in m) for m in plan.matches(bits, within))
    assert got == brute(rows, wanted, within)


def test_optional_stage():
    plan = _Plan(((1, 1), (0, 1), (1, 1)), (RELAXED,) * 3, (RELAXED,) * 3)
    letters = "abc"
    bits = [(k, k, sum((x == w) << 2 * i for i, w in enumerate("abc"))) for k, x in enumerate(letters)]
    assert sorted([i for _, i in m] for m in plan.matches(bits, 9)) == [[0, 1, 2], [0, 2]]


def test_stretches_of_a_hot_key(spark):
    """A match that reaches from one stretch into the next is found once; odd rows are in none."""
    rng = random.Random(2)
    rows = sorted({(rng.randrange(400), i) for i in range(300)})
    given_ = [("hot", s, i, rng.choice("abx")) for s, i in rows] + [(None, 5, 1000, "a"), ("hot", None, 1001, "a"), ("other", 7, 1002, "a")]
    d = spark.createDataFrame(given_, "k string, s long, id long, kind string").selectExpr("*", "1 AS stretch")
    got = sequences.detect(d, "k", "id", "s", [Stage(F.col("kind") == "a"), Stage(F.col("kind") == "b", after=ANY)], 10)
    hot = [(s, i, x) for k, s, i, x in given_ if k == "hot" and s is not None]
    want = sorted([i, j] for (s, i, x), (t, j, y) in combinations(sorted(hot), 2) if x == "a" and y == "b" and t - s <= 10)
    assert sorted(r.ids for r in got.collect()) == want
    assert sequences.detect(d.where("false"), "k", "id", "s", [Stage(F.col("kind") == "a")], 10).count() == 0
    for wrong in ({"times": (2, 1)}, {"after": "soon"}):
        with pytest.raises(ValueError):
            Stage(F.lit(True), **wrong)


def test_every_handover_position(spark):
    changes = [(1, "a", "insert", 1), (2, "a", "insert", 2), (1, "b", "update", 3), (2, "a", "delete", 4), (3, "a", "insert", 5), (2, "c", "insert", 6), (1, "b", "delete", 7), (3, "d", "update", 8)]
    feed = spark.createDataFrame(changes, "id long, status string, type string, seq long").cache()
    want = sorted(map(tuple, cdc.apply_changes(feed, "id", "seq").select("id", "status").collect()))
    for position in range(10):
        snapshot = cdc.apply_changes(feed.where(F.col("seq") <= position), "id", "seq").select("id", "status")
        got = cdc.apply_changes(cdc.handover(snapshot, feed, position), "id", "seq").select("id", "status")
        assert sorted(map(tuple, got.collect())) == want


def test_position_keeps_json_types(spark):
    from rillway.sources import readers

    given_ = ['{"a":1,"b":{"c":[2,null]},"d":"}"}', " { } ", "{bad", "[1]", '{"a":1} ', None, ""]
    d = spark.createDataFrame([(v, 3, 7) for v in given_], "value string, partition int, offset long")
    at = '"partition":"3","offset":"7"}'
    assert sorted(r.value.strip() for r in readers.with_position(d).collect()) == sorted(['{"a":1,"b":{"c":[2,null]},"d":"}",' + at, "{" + at, "{bad", "[1]", '{"a":1,' + at])
