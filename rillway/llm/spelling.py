"""Spelling variants: a minimised acceptor of the vocabulary composed with a one-edit transducer and the acceptor again."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillway.llm.common import Work

RUN = r"[A-Za-zÀ-ÿ]"
STEP = 3  # letters by which a partition's prefix grows
GROUP = 20_000  # words of a partition that are composed together; larger ones get longer prefixes

Node = dict  # letter -> Node; "" is a key of final states


def acceptor(words: list[str]) -> Node:
    """The minimal acyclic automaton of sorted distinct words. States with the same continuations are one object."""
    register: dict = {}

    def settle(node: Node) -> Node:
        return register.setdefault(tuple((c, id(n)) for c, n in node.items()), node)

    path: list[tuple[Node, str]] = []  # the states of the last word that may still get letters
    root: Node = {}
    last = ""
    for w in words:
        k = 0
        while k < len(last) and k < len(w) and last[k] == w[k]:
            k += 1
        for node, c in reversed(path[k:]):
            node[c] = settle(node[c])
        del path[k:]
        node = path[-1][0][path[-1][1]] if path else root
        for c in w[k:]:
            node[c] = {}
            path.append((node, c))
            node = node[c]
        node[""] = None
        last = w
    for node, c in reversed(path):
        node[c] = settle(node[c])
    return root


class OneEdit:
    """Pairs of words that an acceptor A, a one-edit transducer and A again accept together, A the same on both sides.

    A state is (state of A, edit made or not, state of A). Before the edit both sides read the same letters and are in the
    same state. The edit replaces a letter or inserts one at the first place where the words differ; after it, both
    sides must accept the same rest. What two states accept together is kept, as minimised states are met again and again.
    """

    def __init__(self, words: list[str]):
        self.root = acceptor(words)
        self.common: dict[tuple[int, int], list[str]] = {}

    def rest(self, p: Node, q: Node) -> list[str]:
        """The words that both states accept."""
        key = (id(p), id(q)) if id(p) <= id(q) else (id(q), id(p))
        if (found := self.common.get(key)) is None:
            found, todo = [], [("", p, q)]
            while todo:
                text, a, b = todo.pop()
                for c in a.keys() & b.keys():
                    if c:
                        todo.append((text + c, a[c], b[c]))
                    else:
                        found.append(text)
            self.common[key] = found
        return found

    def pairs(self, until: int | None = None) -> Iterator[tuple[str, str]]:
        """Each pair once, the shorter word first; only edits before the place `until` if it is given."""
        todo = [("", self.root)]
        while todo:
            head, p = todo.pop()
            letters = [c for c in p if c]
            for i, a in enumerate(letters):
                for b in letters[i + 1 :]:
                    for s in self.rest(p[a], p[b]):
                        yield head + a + s, head + b + s
                # a is inserted before what the other side reads, which doesn't begin with a
                q = p[a]
                for c in q:
                    if c == "":
                        if "" in p:
                            yield head, head + a
                    elif c != a and c in p:
                        for s in self.rest(p[c], q[c]):
                            yield head + c + s, head + a + c + s
            if until is None or len(head) + 1 < until:
                todo += [(head + a, p[a]) for a in letters]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (partition, skip, until, word, n, longer), sorted by partition, as (word, n_near, best_n, best), one row for a word and partition."""

    def compose(skip: int, until: int | None, rows: list[tuple[str, int, bool]]) -> Iterator[tuple]:
        if len(rows) < 2:
            return
        count = {w[skip:]: n for w, n, _ in rows}
        shorter = {w[skip:] for w, _, longer in rows if not longer}
        head, near, best = rows[0][0][:skip], {}, {}
        for a, b in OneEdit(sorted(count)).pairs(until):
            if until is not None and a not in shorter:
                continue  # this pair is found where the rest of its shorter word belongs
            for x, y in ((a, b), (b, a)):
                near[x] = near.get(x, 0) + 1
                rank = (-count[y], y)
                if x not in best or rank < best[x]:
                    best[x] = rank
        for x, k in near.items():
            yield head + x, k, -best[x][0], head + best[x][1]

    def packed(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "n_near", "best_n", "best"])

    last, rows, out = None, [], []
    for b in batches:
        for key, skip, until, *row in zip(*(c.to_pylist() for c in b.columns)):
            if last is None or key != last[0]:
                if last:
                    out += compose(*last[1:], rows)
                last, rows = (key, skip, until), []
                if len(out) > 20_000:
                    yield packed(out)
                    out = []
            rows.append(row)
    if last:
        out += compose(*last[1:], rows)
    yield packed(out)


def vocabulary(docs: DataFrame, min_letters: int = 7, min_count: int = 2) -> DataFrame:
    """word, n: the runs of letters of all texts, some with a letter lost, that have min_letters and occur min_count times.

    Only A-Z are lower-cased. Where the CRC-32 of `<doc_id>:<run>` is a multiple of 31, the run loses the letter at that
    number modulo its length. A null text has no runs; without a doc_id the run is taken as it is. Runs shorter than
    min_letters are not looked at, as losing a letter makes none longer.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"({RUN}{{{min_letters},}})"), F.lit(1))).alias("run"))
    runs = runs.select("doc_id", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))
    runs = runs.select("run", F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    lost = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = runs.select(F.when(F.col("h") % 31 == 0, lost).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= min_letters)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _partitions(work: Work, words: DataFrame) -> DataFrame:
    """partition, skip, until, word, n, longer: the words of each partition of initial states.

    Two words that differ by one edit agree before its place. Those that agree in the first STEP letters are found
    in the partition of that prefix. Those whose edit lies before agree in all that follows: they are found in the
    partition of that rest, which a word joins twice, with the rest after STEP letters and, as the longer one, after one more.
    A prefix with more than GROUP words is divided again in the same way, by the next letters; no partition of a rest can
    have more words than there are ways to write STEP letters, and the one more that the longer words have.
    """
    out, skip = [], 0
    part = lambda kind, text, longer, until: [F.concat(F.lit(f"{kind}{skip}:"), text).alias("partition"), F.lit(skip).alias("skip"), F.lit(until).cast("int").alias("until"), "word", "n", F.lit(longer).alias("longer")]
    while True:
        end = skip + STEP
        prefix = F.substring("word", 1, end)
        rest = lambda more: F.concat(F.substring("word", 1, skip), F.lit(":"), F.substring("word", end + 1 + more, 1 << 30))  # noqa: B023, E731
        out += [words.select(*part("rest", rest(0), False, STEP)), words.select(*part("rest", rest(1), True, STEP))]
        sizes = words.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("size"))
        large = work.cut(sizes.where(F.col("size") > GROUP).select("prefix"), f"large{skip}")
        here = words.join(large, prefix == F.col("prefix"), "left_anti")
        skip = end
        out.append(here.select(*part("prefix", F.substring("word", 1, end), False, None)))
        if large.isEmpty():
            break
        words = work.cut(words.join(large, prefix == F.col("prefix"), "left_semi"), f"words{skip}")
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every


def group_variants(docs: DataFrame, min_letters: int = 7, min_count: int = 2, ratio: int = 10) -> DataFrame:
    """word, n, n_near, form, form_n, root for every word of the vocabulary.

    Two words are near if one inserted, deleted or replaced letter makes one of the other. The form of a word is its near
    word with the largest n (ties: the first in code-point order), where that n is at least `ratio` times its own; root
    is where following forms ends (`ratio` is 2 or more). Rows that share a doc_id count each; an empty table, or one with null texts only, has no
    words; other columns are not looked at. Runs of any length are taken whole.
    """
    spark = docs.sparkSession
    work = Work(spark)
    words = work.cut(vocabulary(docs, min_letters, min_count), "words")
    dealt = _partitions(work, words).repartition("partition").sortWithinPartitions("partition")
    near = dealt.mapInArrow(_near, "word string, n_near bigint, best_n bigint, best string")
    near = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("first"))
    all_ = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("first.n") >= ratio * F.col("n"), F.struct(F.col("first.best").alias("form"), (-F.col("first.n")).alias("form_n"))).alias("f"))
    all_ = work.cut(all_.select("word", "n", "n_near", "f.form", "f.form_n"), "formed")
    # each step along forms multiplies n by ratio at least, so the largest n bounds them; maps of 1, 2, 4 ... steps
    moved, steps, most = all_.where("form IS NOT NULL").select("word", F.col("form").alias("root")), 1, all_.agg(F.max("n")).first()[0] or 1
    while ratio**steps < most:
        on = moved.select(F.col("word").alias("root"), F.col("root").alias("on"))
        moved = work.cut(moved.join(on, "root", "left").select("word", F.coalesce("on", "root").alias("root")), "moved")
        steps *= 2
    return all_.join(moved, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
