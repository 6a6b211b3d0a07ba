"""Nearest neighbours inside each class: a forest of random projections, exact distances, refinement.

Rows with equal features are one point with a count, so copies cost nothing and a crowd of copies cannot fill a cell.
Each of ``trees`` trees cuts every class into cells of at most ``leaf`` points: all cells above that size are cut again, at
quantiles of a random projection that the cells of one depth share.  A round is one mergeable aggregate (counts and quantile
sketches per cell) and one join; hot cells are cut until none is left, so there is no cap on candidates and no
cell too big for a task.  Inside a cell all distances are computed; a point's ``k`` nearest of all its cells are merged, and
``refine`` rounds then compare it with its neighbours' neighbours.

The distances are exact; the search is approximate (``tests/test_neighbours.py`` measures recall against brute force: above 0.9).
A class of at most ``leaf`` points is one cell, and its neighbours are exact.

Edge cases: a null feature counts as 0.0; NaN and infinite features must not occur; a null class is a class; an empty table gives no
rows; a class of one point has no neighbours.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuelens.session import prepare, scratch_path

TREES = 8
LEAF = 512
FAN = 4  # a cell is cut into so many parts at most: wide parts keep neighbours together
GRID = 16
REFINE = 1
WIDTH = 8  # neighbours held per point while searching
MAX_DEPTH = 30  # FAN to this power exceeds any table
AT_ONCE = 128  # rows of a cell compared at once


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: branches share the rows, and lost executors cost no recomputation."""
    prepare(df.sparkSession)
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def vector(features: list[str]) -> Column:
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])


def node_of(label: str, features: list[str]) -> Column:
    """The number of a point: its class and features."""
    return F.xxhash64(F.col(label).cast("string"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) + F.lit(0.0) for c in features])


def points(rows: DataFrame, label: str, features: list[str]) -> DataFrame:
    """Rows (cls, node, vec, copies): distinct feature vectors per class."""
    keyed = rows.select(F.col(label).alias("cls"), node_of(label, features).alias("node"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(features)])
    named = [f"_{i}" for i in range(len(features))]
    counted = keyed.groupBy("cls", "node").agg(F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in named])
    return counted.select("cls", "node", vector(named).alias("vec"), "copies")


def _direction(tree: int, depth: int, size: int, seed: int) -> list[float]:
    key = int(hashlib.md5(f"{seed}:{tree}:{depth}".encode()).hexdigest()[:12], 16)
    return np.random.default_rng(key).normal(size=size).tolist()


def _same(mark: str) -> Column:
    """Whether a point (p) lies in a cell (c, its columns marked)."""
    return F.col("p.cls").eqNullSafe(F.col(f"c.{mark}cls")) & (F.col("p.tree") == F.col(f"c.{mark}tree")) & (F.col("p.cell") == F.col(f"c.{mark}cell"))


def cells(pts: DataFrame, size: int, trees: int = TREES, leaf: int = LEAF, seed: int = 42) -> DataFrame:
    """Rows (cls, node, vec, tree, cell): every point once per tree, in a cell of at most ``leaf`` points."""
    dealt = pts.select("cls", "node", "vec", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.lit(1).cast("long").alias("cell"))
    done = None  # a cell is the path to it, with a leading 1: no two depths share a number
    for depth in range(MAX_DEPTH):
        weights = F.array(*[F.array(*[F.lit(x) for x in _direction(t, depth, size, seed)]) for t in range(trees)])
        along = F.aggregate(F.zip_with("vec", weights[F.col("tree")], lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        placed = staged(dealt.withColumn("along", along), "neighbour-cells")
        grid = [i / GRID for i in range(1, GRID)]
        cut = placed.groupBy("cls", "tree", "cell").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("along", grid, 1000).alias("cuts"))
        cut = staged(cut.where(F.col("n") > leaf), "neighbour-cuts")
        keys = ["tree", "cell"]
        # Points of the cells that are not cut stay where they are: nothing is computed for them.
        rest = placed.alias("p").join(cut.select(*[F.col(c).alias(f"_{c}") for c in ("cls", *keys)]).alias("c"), _same("_"), "left_anti").drop("along")
        done = rest if done is None else done.unionByName(rest)
        if not cut.limit(1).count():
            return done
        joined = placed.alias("p").join(cut.alias("c"), _same(""))
        parts = F.least(F.greatest(F.ceil(F.col("c.n") / leaf), F.lit(2)), F.lit(FAN))
        at = F.size(F.filter("c.cuts", lambda q: q < F.col("p.along")))
        child = F.floor(at * parts / GRID).cast("long")
        dealt = joined.select("p.cls", "p.node", "p.vec", "p.tree", (F.col("p.cell") * FAN + child).alias("cell"))
    return done.unionByName(dealt)


def _near(vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, neighbour, squared distance) of the k nearest other rows of every row."""
    n, size = len(vectors), min(k, len(vectors) - 1)
    along = np.ascontiguousarray(vectors.T)
    others, far = np.empty((n, size), np.int64), np.empty((n, size))
    held, room = np.empty((AT_ONCE, n)), np.empty((AT_ONCE, n))  # used again for all rows: they stay in the cache
    for a in range(0, n, AT_ONCE):
        m = min(AT_ONCE, n - a)
        d, gap = held[:m], room[:m]
        d[:] = 0.0
        for x in along:
            np.subtract(x[a : a + m, None], x, out=gap)
            np.multiply(gap, gap, out=gap)
            np.add(d, gap, out=d)
        d[np.arange(m), np.arange(a, a + m)] = np.inf
        best = np.argpartition(d, size - 1, axis=1)[:, :size]
        others[a : a + m], far[a : a + m] = best, np.take_along_axis(d, best, 1)
    return np.repeat(np.arange(n), size), others.ravel(), far.ravel()


def _inside(placed: DataFrame, k: int) -> DataFrame:
    """Rows (node, near) by cell: structs (distance, other) of each point's k nearest in each of its cells."""

    def emit(nodes, vectors):
        _, others, far = _near(np.stack(vectors), k)  # as many for every point, point after point
        ids = np.array(nodes, np.int64)
        pairs = pa.StructArray.from_arrays([pa.array(far), pa.array(ids[others])], names=["distance", "other"])
        offsets = pa.array(np.arange(0, len(far) + 1, len(far) // len(ids)), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(offsets, pairs)], names=["node", "near"])

    def run(batches):
        key, nodes, vectors = None, [], []
        for b in batches:
            wide = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            for grp, node, vec in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), wide):
                if grp != key:
                    if len(nodes) > 1:
                        yield emit(nodes, vectors)
                    key, nodes, vectors = grp, [], []
                nodes.append(node)
                vectors.append(vec)
        if len(nodes) > 1:
            yield emit(nodes, vectors)

    grouped = placed.select(F.xxhash64(F.col("cls").cast("string"), "tree", "cell").alias("grp"), "node", "vec")
    return grouped.repartition(F.col("grp")).sortWithinPartitions("grp", "node").mapInArrow(run, "node long, near array<struct<distance: double, other: long>>")


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k nearest per point of rows (node, near): sets of at most k per source merge, then the smallest k stay."""
    sets = found.groupBy("node").agg(F.flatten(F.collect_list("near")).alias("all"))
    return sets.select("node", F.slice(F.sort_array(F.array_distinct("all")), 1, k).alias("near"))


def _second(near: DataFrame, pts: DataFrame, k: int) -> DataFrame:
    """Rows (node, near) of neighbours' neighbours that may be among a point's k nearest.

    A point goes to each of its neighbours once, and meets there the vectors of that one's neighbours: no pair of points is
    shuffled, and only pairs no farther than the point's k-th leave the task.
    """
    place = pts.select("node", "vec")
    # Of the same points: a point with its neighbours' vectors, and a point on its way to each of its neighbours.
    ends = near.select(F.col("node").alias("via"), F.explode("near.other").alias("other")).join(place.withColumnsRenamed({"node": "other", "vec": "far"}), "other")
    lists = ends.groupBy("via").agg(F.collect_list(F.struct("other", "far")).alias("ends"))
    worst = F.when(F.size("near") >= k, F.element_at("near", -1)["distance"]).otherwise(F.lit(float("inf")))
    way = near.join(place, "node").select("node", "vec", F.col("near.other").alias("known"), worst.alias("worst"), F.explode("near.other").alias("via"))
    met = way.join(lists, "via").select("node", "vec", "known", "worst", F.explode("ends").alias("e"))
    apart = F.aggregate(F.zip_with("vec", "e.far", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
    met = met.select("node", "worst", F.col("e.other").alias("other"), apart.alias("distance"), F.array_contains("known", F.col("e.other")).alias("seen"))
    closer = met.where((F.col("other") != F.col("node")) & ~F.col("seen") & (F.col("distance") <= F.col("worst")))
    return closer.select("node", F.array(F.struct("distance", "other")).alias("near"))


def nearest(
    rows: DataFrame, features: list[str], label: str = "label", k: int = 5, trees: int = TREES, leaf: int = LEAF, refine: int = REFINE, seed: int = 42,
    pts: DataFrame | None = None,
) -> DataFrame:
    """Rows (cls, node, vec, copies, near): every distinct point with its nearest other points of its class.

    ``near`` holds up to ``k`` structs (distance, other), nearest first, of squared distances.
    """
    pts = staged(points(rows, label, features), "neighbour-points") if pts is None else pts
    placed, held = cells(pts, len(features), trees, leaf, seed), max(k, WIDTH)
    near = staged(_top(_inside(placed, held), held), "neighbours")
    for _ in range(refine):
        near = staged(_top(near.unionByName(_second(near, pts, held)), held), "neighbours-refined")
    return pts.join(near, "node", "left").select("cls", "node", "vec", "copies", F.slice("near", 1, k).alias("near"))
