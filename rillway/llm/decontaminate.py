"""Benchmark decontamination by spaced seeds."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import chain
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.llm.common import cut, free_name

#: Which of the consecutive words a seed looks at (1) and which it ignores (0). An item's seeds are those of
#: the first mask that the substitutions allowed for its length can't defeat (see unbeaten), a single word if none is left.
MASKS = ("1101", "111", "11", "1")
BLOCK = 2_000_000  # benchmark words a broadcast block may hold: below 100 MB with its seeds

_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))


def plain_words(text: str) -> list[bytes]:
    """Lower-case words without ASCII punctuation."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


def _seeds(ids: np.ndarray, mask: str, k: int) -> np.ndarray:
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, k + 1, np.uint64)
    for j, bit in enumerate(mask):
        if bit == "1":
            h = h * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + n]
            h ^= h >> np.uint64(29)
    return h


@lru_cache(maxsize=None)
def fewest_defeating(mask: str, longest: int) -> list[int]:
    """By length up to longest: the fewest substitutions that leave no place of a stretch where the mask's words are all equal."""
    bits, keep = int(mask, 2), (1 << len(mask) - 1) - 1
    cost, out = {0: 0}, [0]  # by the last words of the stretch, 1 where equal: the fewest substitutions so far
    for _ in range(longest):
        after: dict[int, int] = {}
        for last, n in cost.items():
            for equal in (0, 1):
                seen = last << 1 | equal
                if seen & bits != bits:
                    after[seen & keep] = min(after.get(seen & keep, longest), n + 1 - equal)
        cost = after
        out.append(min(cost.values()))
    return out


@lru_cache(maxsize=None)
def unbeaten(masks: tuple[str, ...], n_words: int, min_words: int, min_match: float) -> tuple[str, int]:
    """The first mask that hits in every passing overlap of an item of n_words, and how often it hits at least.

    A passing stretch of twice the words needed or more has a passing part below that, so lengths below it are all there is to prove.
    """
    need = min(min_words, n_words)
    lengths = range(need, min(n_words, 2 * need - 1) + 1)
    spare = {n: n - ceil(min_match * n - 1e-6) for n in lengths}
    for mask in (*masks, "1"):
        least = fewest_defeating(mask, lengths[-1])
        if all(least[n] > spare[n] for n in lengths):
            # a substitution spoils as many places as the mask has ones
            return mask, max(1, min(n - len(mask) + 1 - spare[n] * mask.count("1") for n in lengths))
    raise ValueError(f"overlaps of {need} words need not hold an equal word at min_match {min_match}")


class Block:
    """Some benchmark items, as word ids with the seeds of every place."""

    def __init__(self, items: list[tuple[int, str]], masks: tuple[str, ...], min_words: int = 20, min_match: float = 0.75, min_item_words: int = 1):
        self.given, self.vocab = masks, {}
        self.items, self.names = [], []
        for name, text in items:
            w = plain_words(text)
            if len(w) >= max(1, min_item_words):
                self.names.append(name)
                self.items.append(np.array([self.vocab.setdefault(x, len(self.vocab) + 1) for x in w], np.uint64))
        self._seed(min_words, min_match)

    def _seed(self, min_words: int, min_match: float) -> None:
        self.rule = min_words, min_match
        chosen = [unbeaten(self.given, len(ids), min_words, min_match) for ids in self.items]
        self.masks = tuple(sorted({mask for mask, _ in chosen}))
        self.least = np.array([n for _, n in chosen], np.int64)
        rows = []
        for i, ids in enumerate(self.items):
            mask = chosen[i][0]
            h = _seeds(ids, mask, self.masks.index(mask))
            rows.append((h, np.full(len(h), i), np.arange(len(h))))
        if rows:
            h, item, at = (np.concatenate(x) for x in zip(*rows))
            order = np.argsort(h, kind="stable")
            self.h, self.item, self.at = h[order], item[order], at[order]
        else:
            self.h, self.item, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.h >> np.uint64(42)).astype(np.int64)] = True

    def search(self, text: str, min_words: int, min_match: float) -> list[tuple[int, int, int, int]]:
        """(item, first word in the text, words compared, words equal) of each item's best overlap that passes."""
        if (min_words, min_match) != self.rule:
            self._seed(min_words, min_match)
        get = self.vocab.get
        ids = np.array([get(w, 0) for w in plain_words(text)], np.uint64)
        diagonals: list[tuple[int, int]] = []
        for k, mask in enumerate(self.masks):
            h = _seeds(ids, mask, k)
            maybe = np.flatnonzero(self.filter[(h >> np.uint64(42)).astype(np.int64)])
            if not len(maybe):
                continue
            lo, hi = np.searchsorted(self.h, h[maybe], "left"), np.searchsorted(self.h, h[maybe], "right")
            hit = np.flatnonzero(hi > lo)
            many = (hi - lo)[hit]
            place = np.repeat(maybe[hit], many)
            row = np.repeat(lo[hit], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            item, shift = self.item[row], place - self.at[row]
            if not len(row):
                continue
            # an item has one mask, so all its hits on a diagonal are here: too few of them can't pass
            order = np.lexsort((shift, item))
            item, shift = item[order], shift[order]
            first = np.flatnonzero(np.concatenate([[True], (np.diff(item) != 0) | (np.diff(shift) != 0)]))
            first = first[np.diff(first, append=len(item)) >= self.least[item[first]]]
            diagonals += zip(item[first].tolist(), shift[first].tolist())
        best: dict[int, tuple[int, int, int, int]] = {}
        for item, shift in sorted(diagonals):
            found = _overlap(self.items[item], ids, shift, min_words, min_match)
            if found and (item not in best or (found[2], -found[0]) > (best[item][3], -best[item][1])):
                best[item] = (self.names[item], *found)
        return list(best.values())


def _overlap(item: np.ndarray, ids: np.ndarray, shift: int, min_words: int, min_match: float) -> tuple[int, int, int] | None:
    """The longest stretch of the item laid over the text at this shift in which min_match of the words are equal."""
    a, b = max(0, -shift), min(len(item), len(ids) - shift)
    same = item[a:b] == ids[a + shift : b + shift]
    need = min(min_words, len(item))
    if b - a < need or same.sum() < min_match * need:
        return None
    # gain is never negative over a stretch that passes: the longest such stretch, from running sums
    run = np.concatenate([[0.0], np.cumsum(same - min_match)]) + 1e-9 * np.arange(b - a + 1)
    low = np.minimum.accumulate(run)
    ends = np.arange(need, b - a + 1)
    starts = np.searchsorted(-low, -run[ends])  # first places whose running minimum is at most run[e]
    longest = int(np.argmax(ends - starts))
    s, e = int(starts[longest]), int(ends[longest])
    while s < e and not same[s]:
        s += 1
    while e > s and not same[e - 1]:
        e -= 1
    if e - s < need and not (e - s >= min_match * need and same[s:e].sum() >= min_match * need):
        return None
    return a + shift + s, e - s, int(same[s:e].sum())


def _blocks(benchmark: DataFrame, masks: tuple[str, ...], min_words: int, min_match: float, min_item_words: int) -> Iterator[Block]:
    """The benchmark in blocks of BLOCK words at most (an item of more is a block of its own), streamed through the driver one block at a time."""
    rows, held = [], 0
    for r in benchmark.select("item_id", "text").where("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        n = len(plain_words(r.text))
        if rows and held + n > BLOCK:
            yield Block(rows, masks, min_words, min_match, min_item_words)
            rows, held = [], 0
        rows.append((r.item_id, r.text))
        held += n
    if rows:
        yield Block(rows, masks, min_words, min_match, min_item_words)


def _block_by_block(blocks: Iterator[Block], spark: SparkSession, apply, name: str) -> Iterator[DataFrame]:
    """apply(block, broadcast) for each block; one is broadcast at a time and what it gives is written."""
    for block in blocks:
        held = spark.sparkContext.broadcast(block)
        yield cut(apply(held), name)
        held.destroy()


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_words: int = 20, min_match: float = 0.75, masks: tuple[str, ...] = MASKS, min_item_words: int = 1) -> DataFrame:
    """Each (doc_id, item_id) whose texts overlap: doc_id, item_id, start_word, n_words, n_equal.

    Words are lower-cased and freed of ASCII punctuation. Seeds of the fixed masks, which may ignore some positions, are
    matched between benchmark and documents; around the hits the item is laid over the text, and the overlap counts if
    a stretch of min_words words (the whole item where it is shorter, down to one word) has min_match equal words,
    substitutions in any place. Each item is seeded by a mask that is proven to hit in every such overlap, so none is
    lost. The best stretch of each pair is returned, the first of equally good ones. Null and empty texts overlap with
    nothing, on either side; equal rows each give their own result; texts are taken whole, whatever their length; an
    empty table on either side gives an empty result; other columns are not looked at.
    An item of one word overlaps with every text that holds it: min_item_words leaves items of fewer words out.
    The benchmark goes to the tasks in blocks of at most BLOCK words, one block at a time; documents never move.
    """
    schema = "doc_id bigint, item_id bigint, start_word bigint, n_words bigint, n_equal bigint"

    def scanned(held) -> DataFrame:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with np.errstate(over="ignore"):
                for b in batches:
                    rows = [
                        (i, *f)
                        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
                        if t
                        for f in held.value.search(t, min_words, min_match)
                    ]
                    cols = list(zip(*rows)) or [[]] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "start_word", "n_words", "n_equal"])

        return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(scan, schema)

    spark = docs.sparkSession
    first, rest = _first(_blocks(benchmark, masks, min_words, min_match, min_item_words))
    if first is None:
        return spark.createDataFrame([], schema)
    if rest is None:
        return scanned(spark.sparkContext.broadcast(first))
    return reduce(DataFrame.unionByName, _block_by_block(rest, spark, scanned, "leaks"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_words: int = 20, min_match: float = 0.75, masks: tuple[str, ...] = MASKS, min_item_words: int = 1) -> DataFrame:
    """The documents that overlap with no benchmark item (see find_leaks), judged where they lie: nothing is shuffled.

    Null and empty texts stay, equal rows share their fate, columns of any name pass through. A benchmark of several blocks
    is held against the texts block by block, which writes only digests of the texts that overlap; documents are written nowhere,
    and one join with those digests removes them.
    """
    at = docs.columns.index("text")

    def kept(held) -> DataFrame:
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with np.errstate(over="ignore"):
                for b in batches:
                    yield b.filter(pa.array([not (t and held.value.search(t, min_words, min_match)) for t in b.column(at).to_pylist()], pa.bool_()))

        plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # mapInArrow takes a dot in a name for a field of a struct
        return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)

    spark, digest = docs.sparkSession, free_name(docs, "digest")

    def leaking(held) -> DataFrame:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with np.errstate(over="ignore"):
                for b in batches:
                    found = [d for t, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t and held.value.search(t, min_words, min_match)]
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], [digest])

        return docs.select("text", _digest().alias(digest)).mapInArrow(scan, f"`{digest}` string")

    first, rest = _first(_blocks(benchmark, masks, min_words, min_match, min_item_words))
    if first is None:
        return docs
    if rest is None:
        return kept(spark.sparkContext.broadcast(first))
    leaks = reduce(DataFrame.unionByName, _block_by_block(rest, spark, leaking, "leaking")).distinct()
    return docs.withColumn(digest, _digest()).join(leaks, digest, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def _digest():
    return F.sha2(F.col("text").cast("binary"), 256)


def _first(blocks: Iterator[Block]) -> tuple[Block | None, Iterator[Block] | None]:
    """The first block, and all of them if there are several."""
    first, second = next(blocks, None), next(blocks, None)
    return first, None if second is None else chain([first, second], blocks)
