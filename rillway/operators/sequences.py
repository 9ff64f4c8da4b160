"""Event patterns written as stages: compiled to expectations that are folded over a key's rows in order of time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

STRICT, RELAXED, ANY = "strict", "relaxed", "any"
FOUND = 10_000  # matches that are handed on together


@dataclass(frozen=True)
class Stage:
    """Rows that a pattern takes one after the other.

    when: the rows that count (write `a | b` for either); after: how the stage's first row follows the stage before, and again: how its
    further rows follow each other. strict: the very next row; relaxed: the next row that counts; any: each later row that
    counts, a match for every one. times: least and most rows, 0 for an optional stage. until: a row that ends the repetition.
    """

    when: Column
    after: str = RELAXED
    times: tuple[int, int] = (1, 1)
    again: str = RELAXED
    until: Column | None = None

    def __post_init__(self):
        low, high = self.times
        if not 0 <= low <= high or high < 1:
            raise ValueError("times are the least and the most rows of a stage")
        if {self.after, self.again} - {STRICT, RELAXED, ANY}:
            raise ValueError(f"rows follow {STRICT}, {RELAXED} or {ANY}")


@dataclass(frozen=True)
class _Plan:
    """The stages without their conditions, which rows carry as bits: when at 2 * i, until at 2 * i + 1."""

    times: tuple[tuple[int, int], ...]
    after: tuple[str, ...]
    again: tuple[str, ...]

    def expect(self, i: int, taken: int) -> list[tuple[int, int, str]]:
        """What may be taken next when stage i has so many rows: (stage, its row's number, how it follows); stage len(times) is the end."""
        out = [(i, taken + 1, self.again[i])] if i >= 0 and taken < self.times[i][1] else []
        if i < 0 or taken >= self.times[i][0]:
            j = i + 1
            while j < len(self.times):
                out.append((j, 1, self.after[j]))
                if self.times[j][0]:
                    return out
                j += 1
            out.append((j, 0, STRICT))
        return out

    def matches(self, rows: Iterable[tuple[int, int, int]], within: int) -> Iterator[list[tuple[int, int]]]:
        """The (second, id) lists of all matches in rows of (second, id, bits)."""
        end = len(self.times)
        starts = [e for e in self.expect(-1, 0) if e[0] < end]
        held: list[tuple[tuple[int, int, str], list]] = []
        for s, id_, bits in rows:
            kept = []
            for expected, got in [*held, *((e, []) for e in starts)]:
                i, n, how = expected
                if got and (s - got[0][0] > within or (n > 1 and bits >> 2 * i + 1 & 1)):
                    continue
                if bits >> 2 * i & 1:
                    more = [*got, (s, id_)]
                    for e in self.expect(i, n):
                        if e[0] == end:
                            yield more
                        else:
                            kept.append((e, more))
                    if got and how == ANY:
                        kept.append((expected, got))
                elif got and how != STRICT:
                    kept.append((expected, got))
            held = kept


def detect(df: DataFrame, key: str, order: str, secs: str, stages: list[Stage], within: int) -> DataFrame:
    """key, first_s, last_s, ids of every match of the stages within so many seconds (both ends in).

    order is a column of unique integers that orders rows of the same second; its values are the ids. Each row may start a match;
    matches overlap freely. Conditions are evaluated by Spark, only their bits go to the fold. A hot key is cut into stretches of time
    as long as a match can be: each goes with the one after it, and gives the matches that start in it. A task reads its stretches
    one after the other, row by row, and holds what is begun of one. Null keys, and rows
    without a time, belong to no match; an empty table gives an empty result.
    """
    plan = _Plan(tuple(x.times for x in stages), tuple(x.after for x in stages), tuple(x.again for x in stages))
    if not any(low for low, _ in plan.times):
        raise ValueError("a stage has to take a row")
    bit = lambda c, k: F.when(F.coalesce(c, F.lit(False)), F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint")
    bits = [bit(x.when, 2 * i) for i, x in enumerate(stages)] + [bit(x.until, 2 * i + 1) for i, x in enumerate(stages) if x.until is not None]
    width = max(1, within)
    given = df.where(F.col(key).isNotNull() & F.col(secs).isNotNull()).select(F.col(key), F.col(secs).cast("bigint").alias("s"), F.col(order).cast("bigint").alias("id"), sum(bits[1:], bits[0]).alias("bits"))
    stretch = F.floor(F.col("s") / width).cast("bigint")
    dealt = given.select("*", F.explode(F.array(stretch, stretch - 1)).alias("stretch"))

    # rows of a group come one after the other, the first one with number 1
    placed = dealt.withColumn("n", F.row_number().over(Window.partitionBy(key, "stretch").orderBy("s", "id")))
    schema = StructType([StructField(key, df.schema[key].dataType), *StructType.fromDDL("first_s bigint, last_s bigint, ids array<bigint>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, type_ = 0, None

        def rows() -> Iterator[tuple[int, pa.RecordBatch, int, tuple[int, int, int], int]]:
            nonlocal group, type_
            for b in batches:
                type_ = b.column(0).type
                for i, (s, id_, bits, stretch, n) in enumerate(zip(*(b.column(c).to_pylist() for c in range(1, 6)))):
                    group += n == 1
                    yield group, b, i, (s, id_, bits), stretch

        def batch(found: list[tuple]) -> pa.RecordBatch:
            k, first, last, ids = zip(*found)
            return pa.record_batch([pa.array(k, type_), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(ids, pa.list_(pa.int64()))], [key, "first_s", "last_s", "ids"])

        found: list[tuple] = []
        for _, members in groupby(rows(), itemgetter(0)):
            _, b, i, row, here = next(members)
            k = None
            for m in plan.matches(chain([row], (r[3] for r in members)), within):
                if m[0][0] // width == here:
                    k = b.column(0)[i].as_py() if k is None else k
                    found.append((k, m[0][0], m[-1][0], [id_ for _, id_ in m]))
                    if len(found) >= FOUND:
                        yield batch(found)
                        found = []
        if found:
            yield batch(found)

    # a stretch without a row of its own gives no match
    return placed.mapInArrow(run, schema)
