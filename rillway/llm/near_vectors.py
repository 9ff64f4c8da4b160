"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells and towards their visitors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillway.llm.codes import whole
from rillway.llm.common import Work, with_fields
from rillway.llm.jaccard import components

MOST_NUMBERS = 4_000_000  # in all centres: what tasks get with their code
FIT_ROWS = 100_000  # vectors that centres are fitted on, about
SPREAD = 4  # a cell has about so many times sqrt(n) vectors: smaller cells cost more in visitors than they save in products
BLOCK = 4096  # vectors on each side of a product
SLACK = 1e-6  # radians granted to rounding, where cells are ruled out


def unit(column: pa.Array, width: int) -> np.ndarray:
    """Rows of length one in double precision, shorter vectors filled up with zeros. Powers of two keep large and tiny components exact."""
    flat, ends = np.asarray(column.flatten()).astype(np.float64), np.cumsum(np.asarray(pc.list_value_length(column)))
    x = np.zeros((len(ends), width))
    if len(flat) == x.size:
        x[:] = flat.reshape(x.shape)
    else:
        sizes = np.diff(ends, prepend=0)
        x[np.repeat(np.arange(len(ends)), sizes), np.arange(len(flat)) - np.repeat(ends - sizes, sizes)] = flat
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


class Cells:
    """Centres of length one, the widest angle that a cell's members have to its centre, and who has to visit a cell.

    A vector u of cell d can be within an angle t of a member of cell c only if u lies within t of the plane between the
    centres of c and d, and within t beyond the cell's widest angle of its centre. Any other pair is ruled out by the
    triangle inequality, so that no link is lost at the borders. Of two cells the one with the lower number is visited.
    """

    def __init__(self, centres: np.ndarray, least: float):
        self.centres, self.within = centres, math.acos(max(-1.0, min(1.0, least))) + SLACK
        self.widest = np.zeros(len(centres))

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = x @ self.centres.T
        cell = near.argmax(axis=1)
        return cell, np.arccos(np.clip(near[np.arange(len(x)), cell], -1, 1))

    def visits(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the cells that they visit."""
        near = x @ self.centres.T
        apart = np.sqrt(np.maximum(0.0, 2 - 2 * self.centres[cell] @ self.centres.T))
        plane = near[np.arange(len(x)), cell][:, None] - near <= math.sin(self.within) * apart + SLACK if self.within < math.pi / 2 else True
        ball = np.arccos(np.clip(near, -1, 1)) <= self.widest + self.within
        return np.nonzero(plane & ball & (np.arange(len(self.centres)) < cell[:, None]))


def _forest(ids: np.ndarray, weight: np.ndarray, sizes: np.ndarray, x: np.ndarray, split: int, least: float) -> list[tuple[int, int, int]]:
    """(id, weights of its links, an id that it is joined with) for the linked rows of one product.

    Rows before `split` are held against those from it on, or all against all with split 0. Links are counted as they
    are met and joined into groups, so that a group gives one row for each vector and none for a pair.
    """
    left, right = (np.arange(len(x)),) * 2 if split == 0 else (np.arange(split), np.arange(split, len(x)))
    label, count = np.arange(len(x)), np.zeros(len(x), np.int64)
    mixed = len(np.unique(sizes)) > 1
    for start in range(0, len(left), 256):
        rows = left[start : start + 256]
        linked = x[rows] @ x[right].T >= least
        if mixed:
            linked &= sizes[rows][:, None] == sizes[right]
        if split == 0:
            linked[np.arange(len(rows)), rows] = False
        hit = np.flatnonzero(linked.any(axis=1))
        rows, linked = rows[hit], linked[hit]
        count[rows] += linked @ weight[right]
        if split:
            count[right] += weight[rows] @ linked
        for i, row in enumerate(rows.tolist()):
            for other in np.unique(label[right[linked[i]]]).tolist():
                if other != label[row]:
                    low, high = sorted((other, int(label[row])))
                    label[label == high] = low
    met = np.flatnonzero(count)
    return list(zip(ids[met].tolist(), count[met].tolist(), ids[label[met]].tolist()))


def _products(width: int, least: float):
    """One product of two blocks: a table of (id, n, embedding, side)."""

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        if len(np.unique(side)) == 1 and side[0] == 1:  # visitors of a block without members
            rows = []
        else:
            table = table.take(np.argsort(side, kind="stable"))
            column = table.column("embedding").combine_chunks()
            sizes = np.asarray(pc.list_value_length(column))
            among = table.column("tile_b")[0].as_py() == table.column("tile_a")[0].as_py()
            split = 0 if among else int((side == 0).sum())
            if not among and split == len(side):
                rows = []  # no visitors
            else:
                rows = _forest(table.column("id").to_numpy(), table.column("n").to_numpy(), sizes, unit(column, width), split, least)
        columns = list(zip(*rows)) or [()] * 3
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["id", "links", "other"])

    return run


def _fitted(classes: DataFrame, n: int, width: int) -> np.ndarray:
    """Centres of cells of about SPREAD * sqrt(n) vectors, by spherical k-means on a sample of FIT_ROWS chosen by hash. Every vector is assigned later."""
    k = max(1, min(round(math.sqrt(n) / SPREAD), MOST_NUMBERS // width))
    if k == 1:
        return np.eye(1, width)
    some = classes.where(F.pmod("h1", F.lit(1 << 20)) <= (1 << 20) * FIT_ROWS // n) if n > FIT_ROWS else classes
    largest = F.array_max(F.transform("embedding", lambda v: F.abs(v.cast("double"))))
    even = F.transform(F.concat("embedding", F.array_repeat(F.lit(0).cast("double"), F.lit(width) - F.size("embedding"))), lambda v: v / largest)
    model = KMeans(k=k, maxIter=5, seed=1, initMode="random", distanceMeasure="cosine").fit(some.select(array_to_vector(even).alias("features")))
    c = np.array(model.clusterCenters())
    return c / np.maximum(np.sqrt((c * c).sum(axis=1)), 1e-300)[:, None]


def link_vectors(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept: each vector, how many others have a cosine of `least` or more with it, its group.

    Cosines are in double precision, labels play no part. A vector that is null, zero, empty or holds a null or non-finite
    component links with nothing; vectors of different lengths don't link. Rows that share a vec_id, or have none, are
    vectors of their own; component_id is the smallest vec_id of the group (null if none has one), and kept says that
    the row bears it. An empty table gives an empty one; other columns are not looked at.

    Equal vectors are one class with a count, so that copies cost one comparison. Each class has a home cell, and visits
    those cells beyond whose border a partner could lie; cells are compared in blocks, and a block's links leave it as
    counts and one row for each linked vector. Uniformly spread vectors of many components have borders everywhere
    and visit a good part of all cells; clustered ones visit few.
    """
    spark = vectors.sparkSession
    work = Work(spark)
    some = F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", F.when(whole("embedding") & some, F.col("embedding")).alias("embedding"))
    name = [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(7), "embedding").alias("h2")]
    named = rows.select("vec_id", *[F.when(F.col("embedding").isNotNull(), h).alias(c) for h, c in zip(name, ("h1", "h2"))])
    classes = rows.where("embedding IS NOT NULL").select("vec_id", "embedding", *name).groupBy("h1", "h2")
    classes = classes.agg(F.min("vec_id").alias("least_id"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    classes = work.cut(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    n, width = classes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    alone = F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
    if not n:
        return rows.select("vec_id", *alone)

    cells = Cells(_fitted(classes, n, width), least)

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 2000):
                part = b.slice(s, 2000)
                cell, angle = cells.home(unit(part.column("embedding"), width))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], [*b.schema.names, "cell", "angle"])

    given = classes.select("id", "n", "embedding")
    homes = work.cut(given.mapInArrow(at_home, with_fields(given.schema, "cell int, angle double")), "homes")
    members = {r.cell: r for r in homes.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("widest")).collect()}  # a row for each centre at most
    for c, r in members.items():
        cells.widest[c] = r.widest
    empty = [c for c in range(len(cells.centres)) if c not in members]
    cells.widest[empty] = -10.0  # nobody visits an empty cell

    def visits(batches: Iterator[pa.RecordBatch], counted: bool) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 2000):
                part = b.slice(s, 2000)
                who, cell = cells.visits(unit(part.column("embedding"), width), part.column("cell").to_numpy())
                if counted:
                    to, n = np.unique(cell, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), pa.array(n)], ["cell", "n"])
                else:
                    own = part.select(["id", "n", "embedding", "cell"])
                    sent = own.take(pa.array(who)).set_column(3, "cell", pa.array(cell.astype(np.int32)))
                    for side, t in ((0, own), (1, sent)):
                        yield pa.RecordBatch.from_arrays([*t.columns, pa.array(np.full(t.num_rows, side, np.int32))], [*t.schema.names, "side"])

    counts = homes.select("embedding", "cell").mapInArrow(lambda x: visits(x, True), "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    visitors = {r.cell: r.n for r in counts.collect()}
    blocks = spark.createDataFrame([(c, -(-r.n // BLOCK), -(-visitors.get(c, 0) // BLOCK)) for c, r in members.items()], "cell int, m int, v int")
    met = homes.select("id", "n", "embedding", "cell").mapInArrow(lambda x: visits(x, False), with_fields(given.schema, "cell int, side int"))
    # a block of members meets its cell's other blocks and the blocks of visitors; a block of visitors meets all blocks of members
    own = F.pmod(F.xxhash64("id"), F.when(F.col("side") == 0, F.col("m")).otherwise(F.col("v"))).cast("int")
    tile = lambda a, b: F.struct(a.alias("tile_a"), b.alias("tile_b"))
    one, upto = F.lit(1), lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    inner = F.transform(upto(F.col("m")), lambda j: tile(F.least(F.col("own"), j), F.greatest(F.col("own"), j)))
    outer = F.transform(upto(F.col("v")), lambda j: tile(F.col("own"), F.col("m") + j))
    visit = F.transform(upto(F.col("m")), lambda i: tile(i, F.col("m") + F.col("own")))
    dealt = met.join(F.broadcast(blocks), "cell").withColumn("own", own)  # a row for each centre at most
    dealt = dealt.withColumn("tile", F.explode(F.when(F.col("side") == 0, F.concat(inner, outer)).otherwise(visit)))
    # inside a pair of member blocks the second one takes the visitors' side
    second = (F.col("tile.tile_b") == F.col("own")) & (F.col("tile.tile_a") != F.col("own")) & (F.col("side") == 0)
    dealt = dealt.select("id", "n", "embedding", "cell", F.when(second, one).otherwise(F.col("side")).alias("side"), "tile.*")
    found = dealt.groupBy("cell", "tile_a", "tile_b").applyInArrow(_products(width, least), "id bigint, links bigint, other bigint")
    found = work.cut(found, "found")
    work.drop("homes")

    linked = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(work, found.select(F.col("id").alias("a"), F.col("other").alias("b")), "groups")
    grouped = roots.join(classes.select(F.col("id").alias("node"), "least_id"), "node")
    smallest = grouped.groupBy("root").agg(F.min("least_id").alias("component_id"))
    group = roots.join(smallest, "root").select(F.col("node").alias("id"), "component_id")
    facts = classes.select("h1", "h2", "id", "least_id", "n").join(linked, "id", "left").join(group, "id", "left")
    facts = facts.select("h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least_id").alias("component_id"))
    facts = work.cut(facts, "facts")
    work.drop("classes", "found", "groups")
    out = named.join(facts, ["h1", "h2"], "left")
    group = F.when(F.col("h1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), group.alias("component_id"), F.col("vec_id").eqNullSafe(group).alias("kept"))
