"""Exact nearest parents by numeric features, without comparing every child with every parent.

Parents lie in the cells of a tree of median splits over all features, built from a bounded sample of
them.  One aggregation gives each cell's exact box and number of parents.  A child vector goes down the tree
to its home cell, which bounds how far its k nearest parents can be, then visits just the cells whose boxes
begin within that bound.  The sample decides how even the cells are, never the result.  Identical child
vectors are searched once and identical parents are kept at most k times, so copies never multiply.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.scaling import cut, small_side

CELL_PARENTS = 64
MAX_CELLS = 16_384
"""Cells whose boxes the driver and each task hold; beyond a million parents cells get larger, not more."""
SAMPLE = 200_000
BROADCAST_BYTES = 32 << 20
SALTS = 16


def shared_numeric_columns(child: DataFrame, parent: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Names of numeric columns that both tables have, sorted, without the excluded ones."""
    def numeric(df):
        return {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    return sorted((numeric(child) & numeric(parent)) - set(exclude))


def feature(column: str) -> Column:
    """Column as a double; null and NaN count as 0."""
    return F.coalesce(F.nanvl(F.col(column).cast("double"), F.lit(0.0)), F.lit(0.0))


def squared_distance(left: Sequence[Column], right: Sequence[Column]) -> Column:
    total = F.lit(0.0)
    for a, b in zip(left, right):
        total = total + (a - b) * (a - b)
    return total


def pairwise_distance(pairs: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """Add the Euclidean distance of two groups of columns of the same row."""
    return pairs.withColumn("distance", F.sqrt(squared_distance(
        [feature(c) for c in left], [feature(c) for c in right])))


class CellTree:
    """Median splits over all features as flat lists; children below zero are cells.

    ``low``, ``high`` and ``count`` hold the box and the number of parents of every node and cell.
    """

    def __init__(self, points: np.ndarray, cells: int):
        leaf = max(1.0, len(points) / max(cells, 1))
        self.axis: list[int] = []
        self.split: list[float] = []
        self.child: list[list[int]] = []
        self.cells = 0
        open_ = [(points, -1, 0)]
        while open_:
            part, parent, side = open_.pop()
            spread = np.ptp(part, axis=0) if len(part) > leaf and part.shape[1] else np.zeros(1)
            axis = int(spread.argmax())
            if spread[axis] > 0:
                values = np.sort(part[:, axis])
                middle = values[len(values) // 2]
                split = values[values < middle].max() if middle == values[-1] else middle
                name = len(self.axis)
                self.axis.append(axis)
                self.split.append(float(split))
                self.child.append([0, 0])
                lower = part[:, axis] <= split
                open_ += [(part[lower], name, 0), (part[~lower], name, 1)]
            else:
                self.cells += 1
                name = -self.cells
            if parent >= 0:
                self.child[parent][side] = name
        self.root = 0 if self.axis else -1

    def set_boxes(self, boxes: dict[int, tuple[int, Sequence[float], Sequence[float]]], n_features: int) -> None:
        """Boxes of the cells as found in the data; a node's box holds those of its children."""
        size = len(self.axis) + self.cells
        self.count = np.zeros(size, np.int64)
        self.low, self.high = np.full((size, n_features), np.inf), np.full((size, n_features), -np.inf)
        for cell, (n, low, high) in boxes.items():
            self.count[-cell - 1], self.low[-cell - 1], self.high[-cell - 1] = n, low, high
        for node in range(len(self.axis) - 1, -1, -1):
            pair = self.child[node]
            self.count[node] = self.count[pair].sum()
            self.low[node], self.high[node] = self.low[pair].min(axis=0), self.high[pair].max(axis=0)

    def _down(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(node or cell, rows) along every point's way to its home cell."""
        open_ = [(self.root, np.arange(len(points)))]
        while open_:
            node, rows = open_.pop()
            if not len(rows):
                continue
            yield node, rows
            if node >= 0:
                lower = points[rows, self.axis[node]] <= self.split[node]
                open_ += [(self.child[node][0], rows[lower]), (self.child[node][1], rows[~lower])]

    def place(self, points: np.ndarray) -> np.ndarray:
        """The home cell of each point, counted from 0."""
        home = np.zeros(len(points), np.int64)
        for node, rows in self._down(points):
            if node < 0:
                home[rows] = -node - 1
        return home

    def bound(self, points: np.ndarray, k: int) -> np.ndarray:
        """A squared distance within which each point has k parents: the farthest corner of the least box on
        its way that holds so many; for one parent, the nearest face's farthest point, as each face has a parent."""
        most = np.full(len(points), np.inf)
        for node, rows in self._down(points):
            if self.count[node] >= k:
                near, far = self._sides(points[rows], node)
                reach = far.sum(axis=1)
                if k == 1 and near.shape[1]:
                    reach = (reach[:, None] - far + near).min(axis=1)
                most[rows] = np.minimum(most[rows], reach)
        return most * (1 + 1e-9)

    def _sides(self, points: np.ndarray, node: int) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances per feature to the nearer and the farther face of a box."""
        a, b = (points - self.low[node]) ** 2, (points - self.high[node]) ** 2
        return np.minimum(a, b), np.maximum(a, b)

    def reach(self, points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell): the cells that may hold one of the k nearest parents of each point."""
        most = self.bound(points, k)
        rows_, cells = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        open_ = [(self.root, np.arange(len(points)))]
        while open_:
            node, rows = open_.pop()
            gap = np.maximum(np.maximum(self.low[node] - points[rows], points[rows] - self.high[node]), 0.0)
            rows = rows[(gap ** 2).sum(axis=1) <= most[rows]]
            if not len(rows):
                continue
            if node < 0:
                rows_.append(rows)
                cells.append(np.full(len(rows), -node - 1))
            else:
                open_ += [(child, rows) for child in self.child[node]]
        return np.concatenate(rows_), np.concatenate(cells)


def cell_tree(folks: DataFrame, fs: Sequence[str], cell_parents: int = CELL_PARENTS) -> tuple[CellTree, DataFrame, int]:
    """(tree, parents with their ``_cell``, number of parents) of materialised parents."""
    n = folks.count()
    points = folks.select(*fs) if n <= SAMPLE else folks.select(*fs).sample(SAMPLE / n, seed=1)
    tree = CellTree(points.toPandas().to_numpy(float).reshape(-1, len(fs)), min(MAX_CELLS, -(-n // cell_parents)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = pa.array(tree.place(_points(batch, fs)))
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], [*batch.schema.names, "_cell"])

    placed = cut(folks.mapInArrow(place, T.StructType([*folks.schema.fields, T.StructField("_cell", T.LongType())])))
    found = placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.min(f) for f in fs]).alias("low"),
                                        F.array(*[F.max(f) for f in fs]).alias("high"))
    tree.set_boxes({r["_cell"]: (r["n"], r["low"], r["high"]) for r in found.collect()}, len(fs))
    return tree, placed, n


def _points(batch: pa.RecordBatch, fs: Sequence[str]) -> np.ndarray:
    return np.stack([np.asarray(batch.column(f)) for f in fs], axis=1) if fs else np.empty((batch.num_rows, 0))


def nearest_parents(children: DataFrame, child_id: str, parents: DataFrame, parent_id: str,
                    features: Sequence[str], k: int = 1) -> DataFrame:
    """(child_id, parent_id, distance, rank): the k closest parents of every child, the smaller
    parent id first on equal distance.  Exact for any data."""
    fs = [f"_f{i}" for i in range(len(features))]
    kids = children.select(child_id, *[feature(c).alias(f) for c, f in zip(features, fs)])
    folks = parents.select(F.col(parent_id).alias("parent_id"), *[feature(c).alias(f) for c, f in zip(features, fs)])
    if k == 1:
        folks = folks.groupBy(*fs).agg(F.min("parent_id").alias("parent_id"))
    else:
        per_vector = Window.partitionBy(*fs).orderBy("parent_id")
        folks = folks.withColumn("_r", F.row_number().over(per_vector)).filter(F.col("_r") <= k).drop("_r")
    tree, placed, n = cell_tree(cut(folks), fs)
    cells = placed.groupBy("_cell").agg(F.collect_list(F.struct("parent_id", *fs)).alias("_those"))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = tree.reach(_points(batch, fs), k)
            asked = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*asked.columns, pa.array(found)], [*fs, "_cell"])

    # vectors take few bytes but much searching: left to their size they would be one task's work; dealt by the
    # columns themselves, as the distinct rows are already, they would stay where they are
    parts = int(kids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vectors = kids.select(*fs).distinct().repartition(parts, F.xxhash64(*fs))
    asked = vectors.mapInArrow(reach, ", ".join([*(f"{f} double" for f in fs), "_cell long"]))
    if n * 8 * (len(fs) + 2) <= BROADCAST_BYTES:
        met = asked.join(F.broadcast(cells), "_cell")
    else:
        salted = cells.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = asked.withColumn("_salt", F.pmod(F.hash(*fs), F.lit(SALTS))).join(salted, ["_cell", "_salt"])
    here = [F.col(f) for f in fs]
    told = F.transform("_those", lambda p: F.struct(squared_distance(here, [p[f] for f in fs]).alias("d"), p["parent_id"].alias("id")))
    if k == 1:
        best = met.select(*fs, F.array_min(told).alias("_t")).groupBy(*fs).agg(F.min("_t").alias("_t")).withColumn("_pos", F.lit(0))
    else:
        top = met.select(*fs, F.slice(F.array_sort(told), 1, k).alias("_top")).groupBy(*fs).agg(F.flatten(F.collect_list("_top")).alias("_top"))
        best = top.select(*fs, F.posexplode(F.slice(F.array_sort("_top"), 1, k)).alias("_pos", "_t"))
    ranked = cut(best.select(*fs, F.col("_t.id").alias("parent_id"), F.sqrt("_t.d").alias("distance"), (F.col("_pos") + 1).alias("rank")))
    return kids.join(small_side(ranked, BROADCAST_BYTES // (8 * (len(fs) + 4))), fs).select(child_id, "parent_id", "distance", "rank")
