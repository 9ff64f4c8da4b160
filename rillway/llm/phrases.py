"""Repeated passages by sharded Aho-Corasick automata."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillway.llm.common import Work, mix, scratch, word_bounds, word_hashes

PHRASE = 6  # words of a phrase that the automata look for
SHARD_CHARS = 4_000_000  # characters of a shard of documents, about
BUCKETS = 20_000  # files of the shards' table at most; more shards share files


def _lowest(marks: np.ndarray, window: int) -> np.ndarray:
    """For each window's start, the lowest mark of the phrases in it; a mark is a hash's upper half, then the place."""
    have, want = 1, window - PHRASE + 1
    while have < want:
        step = min(have, want - have)
        marks = np.minimum(marks[:-step], marks[step:])
        have += step
    return marks


_UPPER, _PLACE = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


def lowest_phrases(text: str, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the phrases that have the lowest hash in some window of words, and those hashes.

    Equal windows have the same lowest phrase at the same place, so windows can be compared by way of phrases.
    """
    buf = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    s, e = word_bounds(buf)
    if len(s) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    w = word_hashes(buf, s, e)
    g = np.zeros(len(s) - PHRASE + 1, np.uint64)
    for j in range(PHRASE):
        g = g * np.uint64(0x9E3779B97F4A7C15) + w[j : j + len(g)]
    g = mix(g)
    low = np.unique(_lowest(g & _UPPER | np.arange(len(g), dtype=np.uint64), window) & _PLACE).astype(np.int64)
    return low, g[low]


class Words:
    """A text's words as bytes, joined by one space, with a space at both ends."""

    def __init__(self, text: str):
        words = text.encode("utf-8", "surrogatepass").split()
        self.n = len(words)
        self.raw = b" " + b" ".join(words) + b" "
        self.gaps = np.flatnonzero(np.frombuffer(self.raw, np.uint8) == 32)

    def between(self, a: int, b: int) -> bytes:
        """Words a to b, b excluded."""
        return self.raw[self.gaps[a] + 1 : self.gaps[b]]

    def digest(self, a: int, b: int) -> tuple[int, int]:
        d = hashlib.blake2b(self.between(a, b), digest_size=16).digest()
        return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)

    def stretches(self, automaton: ahocorasick.Automaton, window: int) -> Iterator[tuple[int, int, int]]:
        """Stretches of windows whose lowest known phrase is the same: its hash, the first window and the last.

        The automaton finds the known phrases; windows without one are in no stretch.
        """
        if self.n < window:
            return
        hits = list(automaton.iter(self.raw.decode("latin-1")))
        if not hits:
            return
        # a phrase ends on the space behind its last word
        place = np.searchsorted(self.gaps, np.fromiter((end for end, _ in hits), np.int64, len(hits))) - PHRASE
        h = np.fromiter((h for _, h in hits), np.uint64, len(hits))
        marks, grams = np.full(self.n - PHRASE + 1, 2**64 - 1, np.uint64), np.zeros(self.n - PHRASE + 1, np.uint64)
        marks[place], grams[place] = h & _UPPER | place.astype(np.uint64), h
        low = _lowest(marks, window)
        edge = np.concatenate([[0], np.flatnonzero(np.diff(low)) + 1])
        last = np.concatenate([edge[1:], [len(low)]]) - 1
        known = low[edge] != 2**64 - 1
        at = (low[edge[known]] & _PLACE).astype(np.int64)
        yield from zip(grams[at].view(np.int64).tolist(), edge[known].tolist(), last[known].tolist())


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (words left, joined by one space).

    Words are the runs of characters other than space and \\t-\\r, as they stand. A word goes if it lies in a window of
    that many words whose word sequence also starts elsewhere, in the same document or another; windows are judged on
    the input. Null text has no words; texts shorter than a window lose nothing; each row is a document of its own,
    equal rows included. An empty table gives an empty result; other columns are not looked at. Texts are taken whole;
    a text longer than a shard is a shard of its own.

    1. Each window is stood for by its lowest phrase. Phrases that are lowest in two places or more may lie in a
       repeated passage; the others can't. Counting them moves about two rows for 31 words and confirms what recurs;
       a recurring phrase's words come from its first place.
    2. Documents lie in shards of bounded size. A shard gets the recurring phrases that are lowest somewhere in it, compiles
       them into an automaton and streams its documents through it: where a phrase stands is known from there only.
       One automaton of all phrases, run over all documents, would cost the square of the corpus.
    3. The stretch of windows around a located phrase is compared as a whole first: equal stretches repeat in all their
       windows. Only stretches that occur once, and one copy of the others with the same phrase, are compared window by
       window, by 128-bit digests. What is counted once comes back to its document, so no list of copies is ever gathered.
    """
    spark = docs.sparkSession
    work = Work(spark)
    size = docs.select(F.sum(F.length("text")).alias("n")).first().n or 0
    shards = max(1, int(size // SHARD_CHARS))
    shard_of = lambda uid: F.pmod(F.xxhash64(uid), F.lit(shards)).cast("int")
    rows = docs.select(F.col("doc_id").cast("bigint"), "text", F.monotonically_increasing_id().alias("uid"))
    # one text shuffle: later passes read whole shards from the written table
    path = scratch(spark, "shards")
    name, files = "shards_" + path.rsplit("-", 1)[1], min(shards, BUCKETS)
    rows = rows.withColumn("shard", shard_of("uid"))
    rows.repartition(files, "shard").write.bucketBy(files, "shard").option("path", path).saveAsTable(name)
    table = spark.table(name)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                found = [lowest_phrases(t or "", window) for t in b.column(2).to_pylist()]
                rows = pa.array(np.repeat(np.arange(len(found)), [len(p) for p, _ in found]))
                if len(rows):
                    p, h = (np.concatenate(x) for x in zip(*found))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(h.view(np.int64)), pa.array(p.astype(np.int32))], ["shard", "uid", "h", "p"])

    counted = table.select("shard", "uid", "text").mapInArrow(phrases, "shard int, uid bigint, h bigint, p int")
    counted = work.cut(counted.groupBy("shard", "h").agg(F.count("*").alias("n"), F.min("uid").alias("uid"), F.min_by("p", "uid").alias("p")), "phrase-counts")
    recurring = counted.groupBy("h").agg(F.sum("n").alias("n"), F.min("uid").alias("uid"), F.min_by("p", "uid").alias("p")).where("n > 1")
    wanted = recurring.select(shard_of("uid").alias("shard"), "uid", "p", "h")

    def spell(left: pa.Table, right: pa.Table) -> pa.Table:
        places = _by_document(right)
        out = []
        for uid, text in zip(left["uid"].to_pylist(), left["text"].to_pylist()):
            if uid in places:
                t = Words(text)
                out += ((h, t.between(p, p + PHRASE)) for h, p in zip(places[uid]["h"].tolist(), places[uid]["p"].tolist()))
        return pa.table({"h": pa.array([h for h, _ in out], pa.int64()), "phrase": pa.array([x for _, x in out], pa.binary())})

    # written before it is joined: both sides are then plain shuffles, and a hot phrase can be split
    spelt = work.cut(_zip(table.select("shard", "uid", "text"), wanted, spell, "h bigint, phrase binary"), "recurring")
    known = counted.select("shard", "h").join(spelt, "h").select("shard", "h", "phrase")

    def pieces(left: pa.Table, right: pa.Table) -> pa.Table:
        automaton = ahocorasick.Automaton()
        for h, phrase in zip(right["h"], right["phrase"]):
            automaton.add_word(f" {phrase.as_py().decode('latin-1')} ", h.as_py() & 0xFFFFFFFFFFFFFFFF)
        out: list[tuple] = []
        if len(automaton):
            automaton.make_automaton()
            for uid, text in zip(left["uid"].to_pylist(), left["text"]):
                t = Words(text.as_py() or "")
                out += ((h, *t.digest(a, b + window), uid, a, b) for h, a, b in t.stretches(automaton, window))
        return _table(out, ["h", "d1", "d2", "uid", "a", "b"])

    places = work.cut(_zip(table.select("shard", "uid", "text"), known, pieces, "h bigint, d1 bigint, d2 bigint, uid bigint, a bigint, b bigint"), "places")
    work.drop("phrase-counts", "recurring")
    distinct = places.groupBy("h", "d1", "d2").agg(F.count("*").alias("n"), F.min(F.struct("uid", "a", "b")).alias("at"))
    distinct = work.cut(distinct, "stretches")
    mixed = work.cut(distinct.groupBy("h").agg(F.min("n").alias("least")).where("least = 1").select("h"), "mixed")
    todo = distinct.join(mixed, "h").select(shard_of("at.uid").alias("shard"), "at.uid", "at.a", "at.b", F.least("n", F.lit(2)).alias("n"))

    def windows(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        wanted = _by_document(right)
        for uid, text in zip(left["uid"].to_pylist(), left["text"].to_pylist()):
            if uid in wanted:
                t = Words(text)
                for a, b, n in zip(*(wanted[uid][c].tolist() for c in ("a", "b", "n"))):
                    out += [(*t.digest(k, k + window), n, uid, k) for k in range(a, b + 1)]
        return _table(out, ["d1", "d2", "n", "uid", "k"])

    looked = _zip(table.select("shard", "uid", "text"), todo, windows, "d1 bigint, d2 bigint, n bigint, uid bigint, k bigint")
    single = looked.groupBy("d1", "d2").agg(F.sum("n").alias("n"), F.min("uid").alias("uid"), F.min("k").alias("k")).where("n = 1")
    # where stretches were located, and which of their windows stand alone
    found = places.select("uid", "a", "b").unionByName(single.select("uid", F.col("k").alias("a"), F.lit(-1).cast("bigint").alias("b")))
    last = work.cut(found.select(shard_of("uid").alias("shard"), "uid", "a", "b"), "found")
    work.drop("places", "stretches", "mixed")

    def clean(left: pa.Table, right: pa.Table) -> pa.Table:
        stretches = _by_document(right)
        out = []
        for uid, name, text in zip(left["uid"].to_pylist(), left["doc_id"].to_pylist(), left["text"].to_pylist()):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            n, gone = len(words), 0
            if uid in stretches:
                again = np.zeros(n - window + 1, bool)
                first, upto = stretches[uid]["a"], stretches[uid]["b"]
                for a, b in zip(first[upto >= 0].tolist(), upto[upto >= 0].tolist()):
                    again[a : b + 1] = True
                again[first[upto < 0]] = False
                edge = np.zeros(n + 1, np.int64)
                edge[: len(again)] += again
                edge[window : window + len(again)] -= again
                covered = np.cumsum(edge)[:n] > 0
                gone = int(covered.sum())
                if gone:
                    words = [w for w, c in zip(words, covered.tolist()) if not c]
            out.append((name, n, gone, b" ".join(words).decode("utf-8", "surrogatepass")))
        cols = list(zip(*out)) or [[]] * 4
        return pa.table({"doc_id": pa.array(cols[0], pa.int64()), "n_words": pa.array(cols[1], pa.int64()), "n_removed": pa.array(cols[2], pa.int64()), "kept_text": pa.array(cols[3], pa.string())})

    out = _zip(table, last, clean, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")
    spark.sql(f"DROP TABLE {name}")  # the name only: the files are read by the result
    return out


def _by_document(right: pa.Table) -> dict[int, dict[str, np.ndarray]]:
    """The columns of a shard's rows for each uid."""
    cols = {c: right[c].to_numpy() for c in right.column_names}
    by = np.argsort(cols["uid"], kind="stable")
    edge = np.flatnonzero(np.diff(cols["uid"][by], prepend=-1))  # numbers are from zero on
    return {int(cols["uid"][rows[0]]): {c: x[rows] for c, x in cols.items()} for rows in np.split(by, edge[1:]) if len(rows)}


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    cols = list(zip(*rows)) or [[]] * len(names)
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, cols)})


def _zip(table: DataFrame, rows: DataFrame, f, schema: str) -> DataFrame:
    """f on each shard's documents and what is known for the shard; only the rows are shuffled.

    They stay rows, which Spark sorts by shard and can spill: gathered in a list a shard, those of all shards of a task would lie on the heap at once.
    """
    return table.groupBy("shard").cogroup(rows.groupBy("shard")).applyInArrow(f, schema)
