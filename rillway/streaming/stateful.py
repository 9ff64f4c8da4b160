"""Keyed state with timers: rows of a key are handed over in order of time once the watermark has passed them."""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Callable, Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

DAY, SIX_HOURS = 86400, 6 * 3600
ROW = "event_id bigint, s bigint, event_type string"
CHUNK_KEY = StructType([StructField("first_us", LongType()), StructField("part", LongType())])
PACKED = StructType([StructField("packed", BinaryType())])
CHUNK = 4096  # rows that are held together
BUCKETS = 1024  # groups that keys are dealt to

#: A step takes (key, memory or None, rows in order, watermark in ms) and gives (memory or None, rows out, when to be called again in ms or None).
#: A row is (ms, us, the columns of ROW or of another row type).
Step = Callable[[tuple, tuple | None, list[tuple], int], tuple[tuple | None, list[tuple], int | None]]


#: What goes in the place of a null, by type.
STAND_INS = {"byte": 0, "short": 0, "integer": 0, "long": 0, "float": 0, "double": 0, "boolean": False, "string": ""}


def carried(n: int) -> list[str]:
    """Names of the columns that rows are handed over in: the key, the time, the row."""
    return [f"c{i}" for i in range(n + 1)]


def names(ddl: str) -> list[str]:
    return StructType.fromDDL(ddl).fieldNames()


class InOrder(StatefulProcessor):
    """Holds rows until the watermark passes them, so that the result doesn't depend on how they were cut into micro-batches.

    The state is that of a bucket of keys, so that calls of the state are made for many rows and keys at once. Rows are held in
    chunks, sorted by time: a micro-batch adds chunks, an expiry reads those that are due and leaves the others alone. The bucket's one timer waits for the
    earliest row or wake-up. Rows later than the watermark are dropped by Spark. A step that gives None for its memory leaves no
    state behind. With an initial state, a key's memory is what a batch table holds for it when the query starts.
    """

    def __init__(self, step: Step, keys: list[str], memory: list[str], columns: list[str], row: list[str]):
        self.step, self.keys, self.memory_names, self.columns, self.row = step, keys, memory, columns, row

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", CHUNK_KEY, PACKED)
        self.memory = handle.getValueState("memory", PACKED)
        self.alarm = handle.getValueState("alarm", StructType([StructField("ms", LongType())]))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        kept = {tuple(r[c] for c in self.keys): (tuple(r[c] for c in self.memory_names), None) for part in initialState["kept"] for r in part}
        self.memory.update((pickle.dumps(kept),))

    def tuples(self, f: pd.DataFrame) -> Iterator[tuple]:
        """(the key, time in us, the columns of the row), with None where a column stands for a null."""
        rows = zip(*(f[c].tolist() for c in carried(len(self.keys) + len(self.row))))
        for t, gone in zip(rows, f["nulls"].tolist()):
            yield tuple(None if gone >> i & 1 else v for i, v in enumerate(t)) if gone else t

    def hold(self, rows: list[tuple]) -> None:
        """Rows in order of time, as a chunk."""
        at, part = rows[0][len(self.keys)], 0
        while self.rows.containsKey((at, part)):
            part += 1
        self.rows.updateValue((at, part), (pickle.dumps(rows),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new, width = [t for f in rows for t in self.tuples(f)], len(self.keys)
        new.sort(key=itemgetter(width))
        for i in range(0, len(new), CHUNK):
            self.hold(new[i : i + CHUNK])
        first, alarm = new[0][width] // 1000, self.alarm.get()
        if alarm is None or first < alarm[0]:
            if alarm is not None:
                self.handle.deleteTimer(alarm[0])
            self.handle.registerTimer(first)
            self.alarm.update((first,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, width = timerValues.getCurrentWatermarkInMs(), len(self.keys)
        packed = self.memory.get()
        memory: dict[tuple, tuple] = pickle.loads(packed[0]) if packed else {}
        due: dict[tuple, list[tuple]] = {k: [] for k, (_, wake) in memory.items() if wake is not None and wake <= now}
        later = []
        for first, part in sorted(map(tuple, self.rows.keys())):
            if first // 1000 > now:
                later.append(first // 1000)
                break
            held = pickle.loads(self.rows.getValue((first, part))[0])
            self.rows.removeKey((first, part))
            cut = bisect_left(held, (now + 1) * 1000, key=itemgetter(width))
            for r in held[:cut]:
                due.setdefault(r[:width], []).append((r[width] // 1000, *r[width:]))
            if cut < len(held):
                self.hold(held[cut:])
                later.append(held[cut][width] // 1000)
        found: list[tuple] = []
        for k, rows in due.items():
            rows.sort(key=itemgetter(1, 2))
            kept, out, wake = self.step(k, memory[k][0] if k in memory else None, rows, now)
            if kept is None:
                memory.pop(k, None)
            else:
                memory[k] = (kept, max(wake, now + 1) if wake is not None else None)
            found += out
            if len(found) >= CHUNK:
                yield pd.DataFrame(found, columns=self.columns, dtype=object)
                found = []
        if found:
            yield pd.DataFrame(found, columns=self.columns, dtype=object)
        if memory:
            self.memory.update((pickle.dumps(memory),))
        elif packed:
            self.memory.clear()
        later += [wake for _, wake in memory.values() if wake is not None]
        if later:
            self.handle.registerTimer(min(later))
            self.alarm.update((min(later),))
        else:
            self.alarm.clear()

    def close(self) -> None:
        pass


def in_order(events: DataFrame, key: str | list[str], delay: str, step: Step, memory: str, out: str, row: str = ROW, initial: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """step applied to each key's rows of a stream with an event time ts, rows later than the delay dropped; rows of one time by the first column of row.

    initial has the columns of the key and of the memory, one row a key: the memory that the query starts with. Keys are dealt to buckets, of
    which a task holds one at a time: its keys' memory, and its rows that are due.
    """
    keys = [key] if isinstance(key, str) else key
    given = events if "s" in events.columns else events.withColumn("s", F.unix_seconds("ts"))
    held = [f"_k{i}" for i in range(len(keys))]
    typed = [F.col(k).cast(given.schema[k].dataType).alias(n) for n, k in zip(held, keys)]
    # batches of columns are much faster than rows, but hold no null beside whole numbers: a bit stands for it
    told = [*keys, "at_us", *names(row)]
    given = given.withColumn("at_us", F.unix_micros("ts"))
    plain = [F.coalesce(F.col(c), F.lit(STAND_INS[t]).cast(t)).alias(n) if (t := given.schema[c].dataType.typeName()) in STAND_INS else F.col(c).alias(n) for c, n in zip(told, carried(len(told) - 1))]
    bits = [F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, c in enumerate(told)]
    bucket = F.pmod(F.xxhash64(*[F.col(k).cast(given.schema[k].dataType) for k in keys]), F.lit(buckets)).alias("bucket")
    e = given.withWatermark("ts", delay).select(bucket, "ts", *plain, sum(bits[1:], bits[0]).alias("nulls"))
    step_ = InOrder(step, held, names(memory), names(out), names(row))
    start = initial.groupBy(bucket).agg(F.collect_list(F.struct(*typed, *names(memory))).alias("kept")).groupBy("bucket") if initial is not None else None
    return e.groupBy("bucket").transformWithStateInPandas(statefulProcessor=step_, outputStructType=out, outputMode="Append", timeMode="EventTime", initialState=start)


def consecutive_fails(events: DataFrame, times: int, within: int, delay: str) -> DataFrame:
    """user_id, first_s, last_s of each run of failures; hits are forgotten after `within` seconds."""

    def step(key, memory, rows, now):
        hits, out = list(memory[0]) if memory else [], []
        for _, _, _, s, kind in rows:
            hits = [*hits, s][-times:] if kind == "error" else []
            if len(hits) == times and hits[-1] - hits[0] <= within:
                out.append((key[0], hits[0], s))
        hits = hits if hits and now < (hits[-1] + within + 1) * 1000 else []
        return ((hits,), out, (hits[-1] + within + 1) * 1000) if hits else (None, out, None)

    return in_order(events, "user_id", delay, step, "hits array<bigint>", "user_id bigint, first_s bigint, last_s bigint")


def paid_or_timeout(events: DataFrame, first: str, then: str, within: int, delay: str) -> DataFrame:
    """Each row of type first with the next row of type then in (0, within] seconds, or a timeout once that time is over."""

    def step(key, memory, rows, now):
        pending, out = list(memory[0]) if memory else [], []

        def close(before: int) -> None:
            nonlocal pending
            out.extend((key[0], c, None, "timeout") for c in pending if c + within < before)
            pending = [c for c in pending if c + within >= before]

        for _, _, _, s, kind in rows:
            close(s)
            if kind == first:
                pending.append(s)
            elif kind == then:
                out.extend((key[0], c, s, "paid") for c in pending if c < s)
                pending = [c for c in pending if c >= s]
        close(now // 1000)
        return ((pending,), out, (min(pending) + within + 1) * 1000) if pending else (None, out, None)

    return in_order(events, "user_id", delay, step, "pending array<bigint>", "user_id bigint, created_s bigint, paid_s bigint, status string")


def daily_entries(events: DataFrame, delay: str) -> DataFrame:
    """The first visit of each user and day: a row that comes six hours or more after the one before it."""

    def step(key, memory, rows, now):
        last, day = memory or (None, -1)
        out = []
        for _, _, _, s, kind in rows:
            if (last is None or s - last > SIX_HOURS) and s // DAY != day:
                out.append((key[0], kind, s))
                day = s // DAY
            last = s
        over = max(last + SIX_HOURS + 1, (last // DAY + 1) * DAY) * 1000 if last is not None else 0
        return (None, out, None) if now >= over else ((last, day), out, over)

    return in_order(events, "user_id", delay, step, "last bigint, day bigint", "user_id bigint, page_id string, s bigint")


def first_of_day(events: DataFrame, key: str, delay: str) -> DataFrame:
    """The first row of each key and day; a key is forgotten when its day is over."""

    def step(key, memory, rows, now):
        day, out = memory[0] if memory else -1, []
        for _, _, event_id, s, _ in rows:
            if s // DAY != day:
                out.append((key[0], event_id, s))
                day = s // DAY
        over = (day + 1) * DAY * 1000
        return (None, out, None) if now >= over else ((day,), out, over)

    return in_order(events, key, delay, step, "day bigint", f"{key} bigint, event_id bigint, s bigint")


def last_after_wait(events: DataFrame, key: str, wait: int, delay: str) -> DataFrame:
    """The last row of each key once no other came for `wait` seconds; a later one gives a new row."""

    def step(key, memory, rows, now):
        last, out = memory, []
        for row in [(s, event_id, kind) for _, _, event_id, s, kind in rows]:
            if last and row[0] - last[0] > wait:
                out.append((key[0], *last))
            last = row
        if last and now > (last[0] + wait + 1) * 1000:
            return None, [*out, (key[0], *last)], None
        return (last, out, (last[0] + wait + 1) * 1000 + 1) if last else (None, out, None)

    return in_order(events, key, delay, step, "s bigint, event_id bigint, event_type string", f"{key} bigint, s bigint, event_id bigint, event_type string")
