"""Product codes for vectors: integer k-means over equal parts, nearest entries found by Orchard's search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillway.llm.common import Work, free_name, with_fields

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
PLAIN = 1 << 27  # components up to here are compared in 64-bit integers, larger ones in Python's
LARGEST = 10**26  # beyond it a sum over a large table leaves 38 digits


class Orchard:
    """Nearest entry of a codebook, by lists of each entry's neighbours in order of distance.

    A search starts at entry 0 and walks the list of the best entry so far; a better one (nearer, or as near with a lower
    index) makes it jump to that one's list. Entries are marked when visited. A list is left where its entries lie beyond
    twice the current distance: by the triangle inequality none of them can be as near. All searches of a batch walk at once.
    """

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        apart = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(2) if entries.size else np.zeros((len(entries),) * 2, np.int64)
        listed = [sorted((j for j in range(len(entries)) if j != i), key=lambda j: (apart[i, j], j)) for i in range(len(entries))]
        self.neighbours = np.array(listed, np.int64).reshape(len(entries), -1)
        self.apart = np.take_along_axis(apart, self.neighbours, 1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each row's nearest entry, and its squared distance."""
        n, m = len(x), len(self.entries)
        best, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
        distance = ((x - self.entries[0]) ** 2).sum(1) if n else np.zeros(0, np.int64)
        visited = np.zeros((n, m), bool)
        visited[:, 0] = True
        live = np.arange(n)
        while len(live):
            live = live[place[live] < m - 1]
            live = live[(self.apart[best[live], place[live]] <= 4 * distance[live]).astype(bool)]
            entry = self.neighbours[best[live], place[live]]
            place[live] += 1
            new = ~visited[live, entry]
            rows, entry = live[new], entry[new]
            visited[rows, entry] = True
            d = ((x[rows] - self.entries[entry]) ** 2).sum(1)
            better = ((d < distance[rows]) | ((d == distance[rows]) & (entry < best[rows]))).astype(bool)
            rows = rows[better]
            best[rows], distance[rows], place[rows] = entry[better], d[better], 0
        return best, distance


def whole(vector: str) -> Column:
    """Vectors without a null or non-finite component."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(F.col(vector), lambda x: F.coalesce(finite(x), F.lit(False))), F.lit(False))


def integers(column: pa.Array, width: int | None = None) -> np.ndarray:
    """floor(4096 * component) of each vector, as 64-bit integers where their squares fit and as Python's where not."""
    sizes = np.asarray(pc.list_value_length(column))
    width = int(sizes[0]) if width is None and len(sizes) else width or 0
    if (sizes != width).any():
        raise ValueError(f"vectors of {width} and of {int(sizes[sizes != width][0])} components can't share codebooks")
    x = np.floor(np.asarray(column.flatten()).astype(np.float64) * SCALE).reshape(len(sizes), width)
    top = np.abs(x).max(initial=0)
    if top > LARGEST:
        raise ValueError(f"a component of {top / SCALE:g} is too large to be coded")
    if top <= PLAIN:
        return x.astype(np.int64)
    return np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def _cut(x: np.ndarray, parts: int) -> list[np.ndarray]:
    if x.shape[1] % parts:
        raise ValueError(f"{x.shape[1]} components can't be cut into {parts} equal parts")
    return np.split(x, parts, axis=1)


def _summed(books: list[np.ndarray]):
    """Each task's count and sums of what it assigned to each entry: one row for an entry and component, whatever the task reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, width = [Orchard(b) for b in books], sum(b.shape[1] for b in books)
        counts, sums = [np.zeros(len(b), np.int64) for b in books], [np.zeros(b.shape, object) for b in books]
        for batch in batches:
            for p, x in enumerate(_cut(integers(batch.column(0), width), len(books))):
                code, _ = search[p].nearest(x)
                counts[p] += np.bincount(code, minlength=len(books[p]))
                order = np.argsort(code, kind="stable")
                used, first = np.unique(code[order], return_index=True)
                if len(used) and x.shape[1]:
                    sums[p][used] += np.add.reduceat(x[order], first, axis=0).astype(object)
        rows = [(p, e, i, int(counts[p][e]), int(s)) for p, b in enumerate(books) for e in range(len(b)) if counts[p][e] for i, s in enumerate(sums[p][e])]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)]
        columns = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "entry", "at", "n", "total"])

    return run


def fit_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, vector: str = "embedding", name: str = "vec_id") -> list[np.ndarray]:
    """The codebook of each part, from all whole vectors.

    A round assigns every part to its nearest entry (ties: the lower index) and moves each entry to floor(sum / count) of
    what it was given; unused entries stay. Entries start as the parts of the vectors with the smallest names (nulls last,
    equal names by the vector); with fewer vectors there are fewer entries, and with none there are none. A round reads the
    vectors once and shuffles one row a task for each entry's component; the driver sees entries alone.
    """
    kept = vectors.where(whole(vector))
    first = kept.select(vector, name).orderBy(F.col(name).asc_nulls_last(), vector).limit(entries).select(vector).toArrow()
    books = [b.copy() for b in _cut(integers(first.column(0).combine_chunks()), parts)]
    if not len(first):
        return books
    for _ in range(rounds):
        sums = kept.select(vector).mapInArrow(_summed(books), "part int, entry int, at int, n bigint, total decimal(38,0)")
        moved = [b.astype(object) for b in books]
        for r in sums.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
            moved[r.part][r.entry, r["at"]] = int(r.total) // r.n
        books = [m.astype(np.int64) if all(abs(v) <= PLAIN for v in m.flat) else m for m in moved]
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.flat).encode()).hexdigest()


def encode_vectors(vectors: DataFrame, books: list[np.ndarray], vector: str = "embedding") -> DataFrame:
    """All columns of the whole vectors, with `code` (two hexadecimal digits a part) and `error` (squared distances, summed).

    Vectors that are null or hold a null or non-finite component go; equal rows stay, with equal codes. Vectors of another
    length than the codebooks', or an error beyond 64 bits, are refused. New columns whose names are taken get a `_`.
    """
    code, error = free_name(vectors, "code"), free_name(vectors, "error")
    width = sum(b.shape[1] for b in books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Orchard(b) for b in books]
        for batch in batches:
            digits, total = np.zeros((batch.num_rows, len(books)), np.int64), np.zeros(batch.num_rows, object)
            for p, x in enumerate(_cut(integers(batch.column(vector), width), len(books))):
                digits[:, p], d = search[p].nearest(x)
                total = total + d
            text = pa.array(["".join(f"{v:02x}" for v in row) for row in digits.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text, pa.array([int(v) for v in total], pa.int64())], [*batch.schema.names, code, error])

    kept = vectors.where(whole(vector))
    if not books or not len(books[0]):  # no whole vector
        return kept.select("*", F.lit("").alias(code), F.lit(0).cast("bigint").alias(error)).where("false")
    return kept.mapInArrow(run, with_fields(kept.schema, f"{code} string, {error} bigint"))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error, label_error (errors of all vectors with that label; null is a label), codebooks_sha256."""
    given = vectors.select("vec_id", "label", "embedding")
    books = fit_codebooks(given, parts, entries, rounds)
    coded = Work(vectors.sparkSession).cut(encode_vectors(given, books).drop("embedding"), "codes")
    # hot labels are summed in their tasks; the sums are one row a label
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).drop("of").withColumn("codebooks_sha256", F.lit(digest(books)))
