"""Exact Jaccard join of n-gram sets by prefix filtering and prefix tries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillway.llm.common import Work, free_name, kept, mix, word_bounds, word_hashes

SAMPLE = 0.2  # share of the hash range whose n-grams are counted
SIEVE = 1 << 24  # bits
MAP_BITS = 1 << 14  # bits of a set's bitmap at most
GROUP = 4096  # bitmaps that a task compares with each other, about
BLOCK_GRAMS = 500_000  # n-grams of the sets in one trie, about
LAST_ROUNDS = 4  # how often common n-grams are looked for and put last
LAST = 1 << 20  # common n-grams that a round puts last, at most

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def ngrams(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's n-word n-grams; of all its words if there are fewer."""
    buf = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(_LOWER), np.uint8)
    s, e = word_bounds(buf)
    w = word_hashes(buf, s, e)
    if not len(w):
        return w
    size = min(n, len(w))
    g = np.full(len(w) - size + 1, size, np.uint64)
    for j in range(size):
        g = mix(g * np.uint64(0x9E3779B97F4A7C15) + w[j : j + len(g)])
    return np.unique(g)


def set_name(grams: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    d = hashlib.blake2b(grams.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def bitmap(grams: np.ndarray) -> bytes:
    """Parity of the n-grams that fall on each bit, two bits or more for each n-gram (MAP_BITS at most).

    Two sets' bitmaps differ in no more bits than the sets have n-grams apart; the same holds for halves folded together.
    """
    bits = min(MAP_BITS, max(64, 1 << (2 * len(grams) - 1).bit_length()))
    odd = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def prefix_size(n: int, percent: int) -> int:
    """How many n-grams, first in any global order, a set of n must be compared by."""
    return n - -(-percent * n // 100) + 1


def components(work: Work, edges: DataFrame, name: str) -> DataFrame:
    """node, root (smallest reachable node) for undirected edges (a, b), by star contraction.

    Each round links the larger neighbours of every node to its smallest neighbour, then the smaller ones; about
    log n rounds. Each round is written to the shared folder, which also cuts the lineage, and replaces the one before.
    """
    now = work.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    while True:
        print_of = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()  # a sum of hashes overflows from 2 ** 24 rows on
        if before == print_of:
            break
        before = print_of
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now = work.cut(small.where("a <> b").distinct(), name)
    roots = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _sieve(wanted: DataFrame):
    """A function that tells for each row of an Arrow column of xxhash64(doc_id) whether it may be wanted (doc_id).

    The sieve is a bitmap of SIEVE bits in all, whatever the size of the corpus: where very many rows are wanted it lets
    more of the others pass, and what follows is exact in any case.
    """
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(SIEVE)) + 1
    parts = wanted.groupBy(F.bitmap_bucket_number(bit).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    sieve = np.zeros(SIEVE // 8, np.uint8)
    for r in parts.collect():  # SIEVE / 32768 rows of 4 KB at most
        sieve[(r["n"] - 1) * 4096 : r["n"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    held = wanted.sparkSession.sparkContext.broadcast(sieve)

    def passes(hashes: pa.Array) -> np.ndarray:
        at = hashes.to_numpy() % SIEVE
        return (held.value[at >> 3] >> (at & 7) & 1).astype(bool)

    return passes


def _folded(maps: list[bytes], size: int) -> np.ndarray:
    """Bitmaps of size or twice size bytes, as rows of 64-bit words of that size."""
    out = np.empty((len(maps), size // 8), np.uint64)
    for k, m in enumerate(maps):
        w = np.frombuffer(m, np.uint64)
        out[k] = w if len(m) == size else w[: size // 8] ^ w[size // 8 :]
    return out


def _by_size(maps: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows whose bitmaps can be compared, and the bitmaps: sets that link have the same size of bitmap or neighbouring ones."""
    sizes = np.array([len(m) for m in maps])
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero((sizes == size) | (sizes == 2 * size))
        yield rows, _folded([maps[k] for k in rows.tolist()], size)


def _covers(apart: np.ndarray, maps: np.ndarray) -> tuple[list[int], np.ndarray, list[int], list[int]]:
    """Leaders, the leader of each row, and for each leader how far its rows lie and the most that any of them may be apart from a partner."""
    leader, left = np.full(len(maps), -1), np.arange(len(maps))
    leaders, radius, most = [], [], []
    while len(left):
        d = np.bitwise_count(maps[left] ^ maps[left[0]]).sum(1, dtype=np.int64)
        near = d <= apart[left]
        leaders.append(int(left[0]))
        leader[left[near]] = left[0]
        radius.append(int(d[near].max()))
        most.append(int(apart[left[near]].max()))
        left = left[~near]
    return leaders, leader, radius, most


def _leader_links(maps: np.ndarray, radius: np.ndarray, most: np.ndarray, first: int = 0) -> Iterator[tuple[int, int]]:
    """Pairs of leaders that may stand for linked rows: bits apart are a metric. With first, only pairs across that place."""
    for i in range(first or len(maps)):
        rest = slice(max(i + 1, first), None)
        d = np.bitwise_count(maps[rest] ^ maps[i]).sum(1, dtype=np.int64)
        for k in np.flatnonzero(d <= radius[i] + radius[rest] + np.minimum(most[i], most[rest])).tolist():
            yield i, k + rest.start


class Trie:
    """Sets of n-grams, each in ascending hash order, as a prefix tree.

    With the sets sorted, what a set shares with the one before it is a path that is already there; a path is cut where
    later sets leave it. match() walks the tree once for all probes together: the partial overlap of every probe with a
    path is counted once for all sets below it, and a subtree that no probe can match any more is passed over.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.sets = [sets[i] for i in self.order]
        self.size = np.array([len(s) for s in self.sets], np.int64)
        shared = [0]
        for a, b in zip(self.sets, self.sets[1:]):
            k = min(len(a), len(b))
            differ = np.flatnonzero(a[:k] != b[:k])
            shared.append(int(differ[0]) if len(differ) else k)
        self.shared = shared
        # the next set that leaves the path earlier
        self.next = [len(sets)] * (len(sets) + 1)
        for i in range(len(sets) - 1, -1, -1):
            j = i + 1
            while j < len(sets) and shared[j] >= shared[i]:
                j = self.next[j]
            self.next[i] = j

    def branches(self, i: int) -> list[tuple[int, int]]:
        """Where the path of set i is left by later sets: depth and the first set outside the subtree, shallow ones first."""
        out, j = [], i + 1
        while j < len(self.sets) and self.shared[j] > self.shared[i]:
            out.append((self.shared[j], self.next[j]))
            j = self.next[j]
        return out[::-1]

    def match(self, probes: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each set's place in self.order with the probes that have 100 * intersection >= percent * union with it."""
        n = np.array([len(p) for p in probes], np.int64)
        every, owner = np.concatenate(probes), np.repeat(np.arange(len(probes)), n)
        grams, rank = np.unique(every, return_inverse=True)
        by = np.argsort(rank, kind="stable")
        posting, bounds = owner[by], np.searchsorted(rank[by], np.arange(len(grams) + 1))
        ranked, starts = owner * len(grams) + rank, np.cumsum(n) - n  # ascending, as each probe is
        low, high = self._extremes()
        held = [(0, np.zeros(len(probes), np.int32))]
        i = 0
        while i < len(self.sets):
            while held[-1][0] > self.shared[i]:
                held.pop()
            depth, overlap = held[-1]
            path, skip = self.sets[i], None
            for stop, end in [*self.branches(i), (len(path), i + 1)]:
                if stop > depth:
                    at = np.searchsorted(grams, path[depth:stop])
                    at = at[grams[np.minimum(at, len(grams) - 1)] == path[depth:stop]]
                    a, many = bounds[at], bounds[at + 1] - bounds[at]
                    hits = posting[np.repeat(a - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
                    overlap = overlap + np.bincount(hits, minlength=len(probes)).astype(np.int32)
                    depth = stop
                if end == i + 1:
                    break
                # what is left of the probe, and of the longest set below, against the least that any set below needs
                past = np.searchsorted(ranked, np.arange(len(probes)) * len(grams) + np.searchsorted(grams, path[depth - 1], "right")) - starts if depth else 0
                smallest, longest = low(i, end), high(i, end)
                need = -(-percent * (n + smallest) // (100 + percent))
                if not (overlap + np.minimum(n - past, longest - depth) >= need).any():
                    skip = end
                    break
                held.append((depth, overlap))
            if skip is None:
                need = -(-percent * (n + self.size[i]) // (100 + percent))
                found = np.flatnonzero((overlap >= need) & (need > 0))
                if len(found):
                    yield i, found
                i += 1
            else:
                i = skip

    def _extremes(self):
        """Least and largest size of the sets in a range."""
        lows, highs = [self.size], [self.size]
        while 2 << len(lows) - 1 <= len(self.size):
            step = 1 << len(lows) - 1
            lows.append(np.minimum(lows[-1][:-step], lows[-1][step:]))
            highs.append(np.maximum(highs[-1][:-step], highs[-1][step:]))

        def of(tables, pick):
            def get(a: int, b: int) -> int:
                k = (b - a).bit_length() - 1
                return int(pick(tables[k][a], tables[k][b - (1 << k)]))

            return get

        return of(lows, min), of(highs, max)


def _forest(sets: list[np.ndarray], others: list[np.ndarray] | None, percent: int) -> list[tuple[int, int, int]]:
    """Links as a spanning forest (place, place), and how many links each place has: (-1, place, count)."""
    inside = others is None
    trie, probes = Trie(sets), sets if inside else others
    offset = 0 if inside else len(sets)
    label = np.arange(len(sets) + (0 if inside else len(probes)))
    count = np.zeros(len(label), np.int64)
    out = []
    for k, found in trie.match(probes, percent):
        j = trie.order[k]
        if inside:  # each pair is met from both sides
            found = found[found != j]
            count[j] += len(found)
        else:
            count[j] += len(found)
            count[found + offset] += 1
        if len(found):
            for other in np.unique(label[found + offset]).tolist():
                if other != label[j]:
                    at = int(found[label[found + offset] == other][0]) + offset
                    out.append((at, j, 0))
                    label[label == other] = label[j]
    return out + [(-1, i, int(count[i])) for i in np.flatnonzero(count).tolist()]


def _posted(classes: DataFrame, frequent: DataFrame, percent: int) -> DataFrame:
    """h, cid: the n-grams of each class's prefix that another may share, from its sampled ones (first) and those behind them (then)."""
    prefix = F.col("n") - F.expr(f"({percent} * n + 99) div 100") + 1
    shared = classes.select("cid", "n", F.size("first").alias("sampled"), F.explode("first").alias("h")).join(frequent, "h")
    mine = Window.partitionBy("cid")
    shared = shared.withColumn("rare", F.col("sampled") - F.count("*").over(mine)).where(F.col("rare") < prefix)
    shared = shared.withColumn("rank", F.row_number().over(mine.orderBy("df", "h"))).where(F.col("rank") <= prefix - F.col("rare"))
    return shared.select("h", "cid").unionByName(classes.select(F.explode("then").alias("h"), "cid"))


def _without_common(g: np.ndarray, common: np.ndarray, bound: np.uint64, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """A set's sampled n-grams and those behind them in its prefix, where common ones (sorted) come last in the order."""
    at = np.searchsorted(common, g)
    last = common[np.minimum(at, len(common) - 1)] == g
    first, then = g[~last & (g < bound)], g[~last & (g >= bound)]
    left = max(0, prefix - len(first))
    return first, np.concatenate([then[:left], g[last][: max(0, left - len(then))]])


def _put_last(work: Work, given: DataFrame, classes: DataFrame, frequent: DataFrame, keys: DataFrame, n: int, percent: int) -> DataFrame:
    """keys (h, cid), with n-grams that more than GROUP unlike sets have in their prefixes moved to the end of the global order.

    A line that a share of the corpus holds would bring all its sets together, and the comparisons would grow with the square of the
    corpus. Any order serves, so no link is lost: sets with such an n-gram in their prefix get their next ones instead, and their texts
    alone are looked at again; the prefixes of others stay. In near copies most of the prefix is common; their n-grams
    stay where they are, as a few leaders cover them. The common n-grams of a round go through the driver: one for GROUP keys, LAST at most.
    """
    common, bound = np.zeros(0, np.uint64), np.uint64(int(SAMPLE * 2**64))
    for _ in range(LAST_ROUNDS):
        many = work.cut(keys.groupBy("h").agg(F.count("*").alias("m")).where(F.col("m") > GROUP), "many")
        if many.isEmpty():
            break
        share = keys.join(many, "h", "left").groupBy("cid").agg(F.avg(F.col("m").isNotNull().cast("int")).alias("share")).where("share > 0")
        unlike = keys.join(many, "h").join(share, "cid").groupBy("h", "m").agg(F.avg("share").alias("share")).where("share < 0.5")
        found = np.array([r.h for r in unlike.orderBy(F.desc("m"), "h").limit(LAST).select("h").collect()], np.int64).view(np.uint64)
        found = np.setdiff1d(found, common)
        if not len(found):
            break
        common = np.union1d(common, found)
        moved = work.spark.createDataFrame(pa.table({"h": pa.array(found.view(np.int64))}))
        again = work.cut(keys.join(F.broadcast(moved), "h", "left_semi").select("cid").distinct(), "again")
        todo = work.cut(classes.join(again, "cid").select("cid", "doc_id", "d1", "d2", "n"), "todo")
        wanted, held = _sieve(todo.select("doc_id")), work.spark.sparkContext.broadcast(common)

        def reorder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with np.errstate(over="ignore"):
                for b in batches:
                    sets = [g for t in b.column(1).filter(pa.array(wanted(b.column(0)))).to_pylist() if len(g := ngrams(t, n))]
                    names = [set_name(g) for g in sets]
                    parts = [_without_common(g, held.value, bound, prefix_size(len(g), percent)) for g in sets]
                    cols = [pa.array(x, pa.int64()) for x in ([a for a, _ in names], [b for _, b in names])]
                    cols += [pa.array([p[k].view(np.int64) for p in parts], pa.list_(pa.int64())) for k in (0, 1)]
                    yield pa.RecordBatch.from_arrays(cols, ["d1", "d2", "first", "then"])

        new = given.select(F.xxhash64("doc_id"), "text").mapInArrow(reorder, "d1 bigint, d2 bigint, first array<bigint>, then array<bigint>")
        new = work.cut(todo.drop("doc_id").join(new, ["d1", "d2"]).dropDuplicates(["cid"]), "reordered")
        held.destroy()
        keys = work.cut(keys.join(again, "cid", "left_anti").select("h", "cid").unionByName(_posted(new, frequent, percent)), "prefixes")
        work.drop("again", "todo", "reordered")
    work.drop("many")
    return keys


def link_documents(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, n_links.

    Words are runs of characters other than space and \\t-\\r with A-Z lower-cased; a document's set holds its distinct
    n-word shingles, or all its words as one if there are fewer. Two documents link when 100 * intersection >=
    percent * union (percent from 50 to 100). component_id is the smallest doc_id reachable by links, the document's own included (null doc_ids
    count as the largest); n_links counts linked different sets. Null and empty texts, and texts without a word, have no
    shingles, no links and a component of their own. Rows with equal sets are one class: they share a component; a
    repeated row is a document like any other. An empty table gives an empty result, other columns are not looked at.
    Texts are taken whole, whatever their length. Shingles are known by 64-bit hashes, sets by 128 bits.

    1. Equal sets become one class; its members are never paired.
    2. Global order: n-grams whose hash is in the lowest SAMPLE of the range come first, rare ones before frequent
       ones, then the others by hash, and last those that very many unlike sets have in their prefixes (_put_last). Sets that
       link share an n-gram of their prefixes. A class whose rare sampled n-grams alone fill its prefix has no partner and is dropped.
    3. Classes that share a prefix n-gram are compared by bitmaps of two bits for each n-gram: bits apart are never more
       than n-grams apart, so pairs that differ in too many bits don't link. N-grams with the same first class make one
       group; a large group is dealt to parts of about GROUP, each is covered by leaders, and only leaders meet those of
       other parts. What may link is chained into clusters; classes that merely share an n-gram are not.
    4. A cluster's sets lie in blocks of about BLOCK_GRAMS n-grams. Each block is a trie, walked once by all sets of a
       block at a time with partial overlaps; subtrees that can't reach the needed intersection are passed over. A task
       returns a spanning forest of the links it found and counts, so no pairs are stored.

    A set is sent once for each block of its own cluster; clusters of one block travel together.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent lies from 50 to 100: bitmaps compare sets whose sizes differ by a factor of two at most")
    spark = docs.sparkSession
    work = Work(spark)
    bound = np.uint64(int(SAMPLE * 2**64))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("jaccard", dict)
        with np.errstate(over="ignore"):
            for b in batches:
                names, sizes, first, then, maps = [], [], [], [], []
                for text in b.column(1).to_pylist():
                    g = ngrams(text, n)
                    k, p = int(np.searchsorted(g, bound)), prefix_size(len(g), percent)
                    names.append(set_name(g) if len(g) else (None, None))
                    sizes.append(len(g))
                    first.append(g[:k].view(np.int64))
                    then.append(g[k : max(k, p)].view(np.int64) if len(g) else g.view(np.int64))
                    maps.append(bitmap(g) if len(g) else b"")
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
                cols = [[a for a, _ in names], [b for _, b in names], sizes, first, then, maps]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "d1", "d2", "n", "first", "then", "bits"])

    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    described = work.cut(given.mapInArrow(describe, "doc_id bigint, d1 bigint, d2 bigint, n bigint, first array<bigint>, then array<bigint>, bits binary"), "sets")
    classes = described.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"), F.first(F.struct("n", "first", "then", "bits")).alias("s"))
    # numbered as they are written, so that the numbers stay
    classes = work.cut(classes.select("d1", "d2", "doc_id", "s.*", F.monotonically_increasing_id().alias("cid")), "classes")
    members = work.cut(described.select("doc_id", "d1", "d2", "n"), "members")
    work.drop("sets")

    # counts are written before they are joined: both sides are then plain shuffles, and a hot n-gram can be split
    frequent = classes.select(F.explode("first").alias("h")).groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    frequent = work.cut(frequent, "frequent")
    keys = work.cut(_posted(classes, frequent, percent), "prefixes")
    keys = _put_last(work, given, classes, frequent, keys, n, percent)
    work.drop("frequent")

    # n-grams whose first class is the same make one group: near copies share many n-grams, and meet once
    hubs = work.cut(keys.groupBy("h").agg(F.count("*").alias("m"), F.min("cid").alias("hub")).where("m > 1").drop("m"), "hubs")
    grouped = work.cut(keys.join(hubs, "h").select("hub", "cid").distinct(), "grouped")
    work.drop("prefixes", "hubs")
    sizes = work.cut(grouped.groupBy("hub").agg(F.count("*").alias("m")).withColumn("blocks", F.ceil(F.col("m") / GROUP)), "sizes")
    packs = max(1, (sizes.where("blocks = 1").agg(F.sum("m")).first()[0] or 0) // (4 * GROUP))
    posted = grouped.join(sizes, "hub").join(classes.select("cid", "n", "bits"), "cid")
    task = F.when(F.col("blocks") == 1, F.struct(F.pmod(F.xxhash64("hub"), F.lit(packs)).alias("x"), F.lit(-1).cast("bigint").alias("y"))).otherwise(F.struct(F.col("hub").alias("x"), F.pmod(F.xxhash64("cid"), F.col("blocks")).alias("y")))
    posted = posted.select("hub", "cid", "n", "bits", F.col("blocks") > 1, task.alias("task")).toDF("h", "cid", "n", "bits", "cut", "task")

    def cover(t: pa.Table) -> pa.Table:
        h, cid, size, cut_up = (t[c].to_numpy() for c in ("h", "cid", "n", "cut"))
        maps, apart = t["bits"].to_pylist(), size * (100 - percent) // percent
        by = np.lexsort((cid, h))  # by number inside, so that groups of the same sets mostly take the same leaders
        edges: list[tuple[int, int]] = []
        out: list[tuple] = []
        for rows in np.split(by, np.flatnonzero(np.diff(h[by])) + 1):
            if len(rows) == 1 and not cut_up[rows[0]]:
                continue
            for at, words in _by_size([maps[k] for k in rows.tolist()]):
                mine = rows[at]
                leaders, leader, radius, most = _covers(apart[mine], words)
                edges += zip(cid[mine[leader]].tolist(), cid[mine].tolist())
                edges += ((int(cid[mine[leaders[a]]]), int(cid[mine[leaders[b]]])) for a, b in _leader_links(words[leaders], np.array(radius), np.array(most)))
                if cut_up[mine[0]]:
                    out += ((int(h[mine[0]]), int(cid[mine[k]]), r, m, words[k].tobytes()) for k, r, m in zip(leaders, radius, most))
        edges = [e for e in set(edges) if e[0] != e[1]]
        rows = [(a, b, None, None, None, None) for a, b in edges] + [(c, None, g, r, m, w) for g, c, r, m, w in out]
        cols = list(zip(*rows)) or [[]] * 6
        kinds = [pa.int64()] * 5 + [pa.binary()]
        return pa.table({c: pa.array(x, k) for c, x, k in zip(("a", "b", "h", "radius", "most", "bits"), cols, kinds)})

    near = work.cut(posted.groupBy("task").applyInArrow(cover, "a bigint, b bigint, h bigint, radius bigint, most bigint, bits binary"), "near")
    work.drop("grouped", "sizes")

    # leaders of groups that lie in several parts, each size of bitmap for itself
    leaders = near.where("h IS NOT NULL").withColumn("w", F.octet_length("bits"))
    met = leaders.join(leaders.groupBy("h", "w").agg(F.ceil(F.count("*") / GROUP).alias("blocks")), ["h", "w"])
    own = F.pmod(F.xxhash64("a"), F.col("blocks"))
    met = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    met = met.select("a", "radius", "most", "bits", "own", "h", "w", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def across(t: pa.Table) -> pa.Table:
        own = t["own"].to_numpy()
        by = np.argsort(own, kind="stable")
        first = int((own == own.min()).sum()) if t["i"][0].as_py() != t["j"][0].as_py() else 0
        a, radius, most = (t[c].to_numpy()[by] for c in ("a", "radius", "most"))
        bits = t["bits"].to_pylist()
        words = _folded([bits[k] for k in by.tolist()], len(bits[0]))
        found = [] if first == len(own) else [(int(a[x]), int(a[y])) for x, y in _leader_links(words, radius, most, first)]
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    links = near.where("h IS NULL").select("a", "b").unionByName(met.groupBy("h", "w", "i", "j").applyInArrow(across, "a bigint, b bigint"))
    clusters = work.cut(components(work, links, "edges"), "clusters")
    work.drop("near", "edges")

    placed = classes.select("cid", "d1", "d2", "doc_id", "n").join(clusters.withColumnRenamed("node", "cid"), "cid")
    placed = work.cut(placed, "placed")
    work.drop("clusters")
    totals = work.cut(placed.groupBy("root").agg(F.ceil(F.sum("n") / BLOCK_GRAMS).alias("blocks"), F.sum("n").alias("mass")), "totals")
    packs = max(1, (totals.where("blocks = 1").agg(F.sum("mass")).first()[0] or 0) // BLOCK_GRAMS)
    todo = placed.join(totals, "root").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")))
    wanted = _sieve(placed.select("doc_id"))

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                sets = [g for t in b.column(1).filter(pa.array(wanted(b.column(0)))).to_pylist() if len(g := ngrams(t, n))]
                names = [set_name(g) for g in sets]
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in names], pa.int64()), pa.array([b for _, b in names], pa.int64()), pa.array([g.tobytes() for g in sets], pa.binary())], ["d1", "d2", "grams"])

    sets = given.select(F.xxhash64("doc_id"), "text").mapInArrow(full_sets, "d1 bigint, d2 bigint, grams binary")
    sent = todo.join(sets, ["d1", "d2"])
    alone = F.col("blocks") == 1
    sent = sent.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    sent = sent.select("cid", "root", "own", "grams", F.when(alone, F.pmod(F.xxhash64("root"), F.lit(packs))).otherwise(F.col("root")).alias("x"), F.when(alone, -1).otherwise(F.least("own", "other")).alias("i"), F.when(alone, -1).otherwise(F.greatest("own", "other")).alias("j"))

    def join(t: pa.Table) -> pa.Table:
        groups: dict[int, dict[tuple[int, int], np.ndarray]] = {}
        for cid, root, own, grams in zip(*(t[c].to_pylist() for c in ("cid", "root", "own", "grams"))):
            groups.setdefault(root, {})[own, cid] = np.frombuffer(grams, np.uint64)
        rows = []
        across = t["i"][0].as_py() != t["j"][0].as_py()
        for found in groups.values():
            places = sorted(found)
            first = sum(own == places[0][0] for own, _ in places) if across else len(places)
            if across and first == len(places):
                continue  # the other block holds nothing
            sets = [found[k] for k in places]
            for x, y, c in _forest(sets[:first], sets[first:] if across else None, percent):
                rows.append((places[x][1] if x >= 0 else None, places[y][1], c))
        cols = list(zip(*rows)) or [[]] * 3
        return pa.table({k: pa.array(c, pa.int64()) for k, c in zip(("a", "b", "links"), cols)})

    found = work.cut(sent.groupBy("x", "i", "j").applyInArrow(join, "a bigint, b bigint, links bigint"), "links")
    work.drop("placed", "totals")
    counts = found.where("a IS NULL").groupBy(F.col("b").alias("cid")).agg(F.sum("links").alias("n_links"))
    joined = components(work, found.where("a IS NOT NULL").select("a", "b"), "edges").withColumnRenamed("node", "cid")
    named = classes.select("cid", "d1", "d2", "doc_id").join(joined, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    # the smallest doc_id of each group of classes, by a plain sum-like aggregate and a join back
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    final = work.cut(named.join(least, "root").join(counts, "cid", "left").select("d1", "d2", "component_id", "n_links"), "final")
    out = members.join(final, ["d1", "d2"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
    )
    return work.finish(out, "linked")


def near_duplicate_stage(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group: the one whose doc_id is the component's; documents without words stay.

    Rows that share a doc_id stay or go together, and stay if one of them is to stay. Null and empty texts stay, and so
    do null doc_ids where no other row is in their group; an empty table stays empty; columns of any name pass through.
    Only rows that may have to go are shuffled.
    """
    groups = link_documents(docs, n, percent)
    stays = F.max(F.expr("n_shingles = 0 OR doc_id <=> component_id"))
    gone = groups.groupBy("doc_id").agg(stays.alias("stays")).where("NOT stays").select("doc_id")
    maybe = _sieve(gone)
    key, mark = free_name(docs, "_key"), free_name(docs, "_hash")
    hashed = docs.withColumn(mark, F.xxhash64(F.col("doc_id").cast("bigint")))
    at = len(docs.columns)

    def picked(wanted: bool):
        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                b = b.filter(pa.array(maybe(b.column(at)) == wanted))
                yield pa.RecordBatch.from_arrays(b.columns[:at], names)

        names = docs.columns
        return hashed.mapInArrow(pick, docs.schema)

    looked = picked(True).join(gone.withColumnRenamed("doc_id", key), F.col("doc_id").cast("bigint").eqNullSafe(F.col(key)), "left_anti")
    return picked(False).unionByName(looked)
