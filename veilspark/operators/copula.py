"""Non-private baseline: a Gaussian copula per table, on ranks.

Every distinct value of a column owns an interval of positions as long as its rows, in the order of the
values.  A row's normal score is the normal quantile of the middle of its value's interval; one more pass
gives all pairwise correlations.  To sample, mixed normal draws become positions again and are looked up
in the intervals by equi-join, so all values, types and shares are kept however skewed a column is.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.draws import Draws, box_muller, normal_cdf_of, normal_quantile, uniforms_of
from ..functions.scaling import cut, dense_ordinal, in_threads, row_ids, running_total
from .marginals import all_pairs
from .sample import look_up

VALUES_PER_BUCKET = 4096
WINDOW_VALUES = 10_000
BROADCAST_BYTES = 48 << 20
INTERVAL_BYTES = 32
"""Bytes of a value's positions beside the value itself."""
COLUMNS_AT_A_TIME = 8


@dataclass
class Copula:
    columns: list[str]
    intervals: dict[str, DataFrame]
    facts: dict[str, tuple[int, int, int]]
    """Rows, nulls and distinct values of each column."""
    small: set[str]
    """Columns whose intervals may be broadcast, by their bytes."""
    correlation: np.ndarray


def value_intervals(df: DataFrame, column: str) -> DataFrame:
    """(key, start, stop): the positions of each distinct non-null value, in the values' order.

    Few values are summed up by one window; more by a range partitioned order and a sum in two levels.
    """
    counts = cut(df.groupBy(F.col(column).alias("key")).agg(F.count(F.lit(1)).alias("_w")).filter("key is not null"))
    if counts.count() <= WINDOW_VALUES:
        before = F.sum("_w").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return counts.select("key", (before - F.col("_w")).alias("start"), before.alias("stop"))
    placed = dense_ordinal(counts, ["key"], "_place")
    total = running_total(placed, "_w", F.floor(F.col("_place") / VALUES_PER_BUCKET), ["_place"], "start")
    return total.select("key", "start", (F.col("start") + F.col("_w")).alias("stop"))


def normal_scores(intervals: DataFrame, n: int) -> DataFrame:
    """(key, z): normal quantile of the middle rank of each value's rows among n non-null rows."""
    return intervals.select("key", normal_quantile((F.col("start") + F.col("stop")) / (2.0 * max(n, 1))).alias("z"))


def score_correlations(df: DataFrame, scores: dict[str, DataFrame], small: Sequence[str] = (), whole: Sequence[str] = ()) -> DataFrame:
    """(a, b, r): correlation of the normal scores of every pair of columns over rows that have both.

    Values turn into scores by a join per column, broadcast for the ``small`` ones, which come first so that
    shuffled rows hold numbers.  Pairs of ``whole`` columns, which have no nulls, share their sums.
    """
    columns = list(scores)
    z = df.select(*columns)
    for c in sorted(columns, key=lambda c: c not in small):
        table = scores[c].select(F.col("key").alias(c), F.col("z").alias("_z"))
        z = z.join(F.broadcast(table) if c in small else table, c, "left").drop(c).withColumnRenamed("_z", c)
    pairs = all_pairs(columns)
    at = {c: i for i, c in enumerate(columns)}
    shared = {c for c in columns if c in whole}
    sums = [F.count(F.lit(1)).alias("n")]
    sums += [x for c in shared for x in (F.sum(c).alias(f"s{at[c]}"), F.sum(F.col(c) * F.col(c)).alias(f"q{at[c]}"))]
    sums += [F.sum(F.col(a) * F.col(b)).alias(f"r{i}") if {a, b} <= shared else F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]

    def correlation(i: int, a: str, b: str) -> Column:
        if not {a, b} <= shared:
            return F.col(f"r{i}")
        n, (sa, qa), (sb, qb) = F.col("n"), *((F.col(f"s{at[c]}"), F.col(f"q{at[c]}")) for c in (a, b))
        spread = F.sqrt((n * qa - sa * sa) * (n * qb - sb * sb))
        return F.when(spread > 0, (n * F.col(f"r{i}") - sa * sb) / spread)

    return z.agg(*sums).select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), correlation(i, a, b).alias("r"))
        for i, (a, b) in enumerate(pairs)])))


def fit_copula(df: DataFrame, columns: Sequence[str] | None = None) -> Copula:
    columns = list(columns or df.columns)
    intervals = dict(zip(columns, in_threads(df.sparkSession, lambda c: cut(value_intervals(df, c)), columns, COLUMNS_AT_A_TIME)))
    def size(c: str) -> tuple[int, int]:
        held = F.octet_length(F.col("key").cast("string")) + INTERVAL_BYTES
        return tuple(intervals[c].agg(F.count(F.lit(1)), F.coalesce(F.sum(held), F.lit(0))).first())

    sizes = dict(zip(columns, in_threads(df.sparkSession, size, columns, COLUMNS_AT_A_TIME)))
    small, sent = set(), 0
    for c in sorted(columns, key=lambda c: sizes[c][1]):
        sent += sizes[c][1]
        if sent <= BROADCAST_BYTES:
            small.add(c)
    counted = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    facts = {c: (counted["n"], counted["n"] - counted[f"c{i}"], sizes[c][0]) for i, c in enumerate(columns)}
    correlation = np.eye(len(columns))
    if len(columns) > 1:
        at = {c: i for i, c in enumerate(columns)}
        scores = {c: normal_scores(intervals[c], facts[c][0] - facts[c][1]) for c in columns}
        whole = [c for c in columns if facts[c][1] == 0]
        for r in score_correlations(df, scores, list(small), whole).collect():
            value = r["r"] if r["r"] is not None and np.isfinite(r["r"]) else 0.0
            correlation[at[r["a"]], at[r["b"]]] = correlation[at[r["b"]], at[r["a"]]] = value
    return Copula(columns, intervals, facts, small, nearest_correlation(correlation))


def nearest_correlation(matrix: np.ndarray) -> np.ndarray:
    """Pairwise correlations made positive definite, if nulls made them inconsistent."""
    values, vectors = np.linalg.eigh(matrix)
    if values.min(initial=1.0) > 1e-9:
        return matrix
    fixed = vectors @ np.diag(np.maximum(values, 1e-9)) @ vectors.T
    scale = np.sqrt(np.diag(fixed))
    return fixed / np.outer(scale, scale)


def positions(copula: Copula, rows: DataFrame, draws: Draws, scope: str = "") -> DataFrame:
    """(_rid, _p0, _p1..) of rows (_rid): the position of each column among its rows, below 0 for a null.

    Draws, normals, mixing and ranks are worked out a batch at a time: as column expressions the latter make one method
    that is too long for the compiler of the machine, and MD5 draws take several times as long.
    """
    k = len(copula.columns)
    factor = np.linalg.cholesky(copula.correlation * (1 - 1e-9) + 1e-9 * np.eye(k))
    facts = [copula.facts[c] for c in copula.columns]
    keys = [("copula", scope, i) for i in range(k + k % 2)]
    by_batch = draws.generator == "md5"
    if not by_batch:
        rows = rows.select("_rid", *[draws.uniform(*key, F.col("_rid")).alias(f"_u{i}") for i, key in enumerate(keys)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids = batch.column(0)
            drawn = uniforms_of(draws, rids.to_numpy(), keys) if by_batch else [c.to_numpy() for c in batch.columns[1:]]
            normals = [z for i in range(0, k, 2) for z in box_muller(drawn[i], drawn[i + 1])]
            places = []
            for i, (n, nulls, _) in enumerate(facts):
                mixed = sum(factor[i, j] * normals[j] for j in range(i + 1))
                places.append(pa.array(np.minimum(np.floor(normal_cdf_of(mixed) * n), n - 1).astype(np.int64) - nulls))
            yield pa.RecordBatch.from_arrays([rids, *places], ["_rid", *(f"_p{i}" for i in range(k))])

    return rows.mapInArrow(run, ", ".join(["_rid long", *(f"_p{i} long" for i in range(k))]))


def sample_copula(spark: SparkSession, copula: Copula, n: int, draws: Draws, scope: str = "") -> DataFrame:
    """``n`` rows with ``_rid`` 1..n: independent normals, mixed by the Cholesky factor, taken
    back through each column's own distribution."""
    k = len(copula.columns)
    out = positions(copula, row_ids(spark, n), draws, scope)
    # columns that are met by shuffle come first, while the rows hold little more than numbers
    for i in sorted(range(k), key=lambda i: copula.columns[i] in copula.small):
        c = copula.columns[i]
        rows, nulls, values = copula.facts[c]
        out = look_up(out.withColumnRenamed(f"_p{i}", "_pos"), copula.intervals[c], max(1, (rows - nulls) // max(values, 1)), c,
                      small=c in copula.small)
    return out.select("_rid", *copula.columns)
