"""One-to-one matching of violating rows to parents at least total distance.

Rows are numbered in order and cut into batches of fixed size.  Inside a batch every parent is
used at most once, and a row of a batch of B never needs more than its B nearest parents, so a
batch is a bounded group of at most B x B candidates.  Batches are solved side by side, first on
short candidate lists; a batch whose prices show that a list was too short is solved again with
longer ones.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scaling import cut, dense_ordinal
from .nearest import nearest_parents

FIRST_LIST = 32


def number_batches(rows: DataFrame, row_id: str, batch_size: int = 2000) -> DataFrame:
    """Add ``batch``: consecutive rows in row-id order, ``batch_size`` to a batch."""
    return (dense_ordinal(rows, [row_id], "_ordinal")
            .withColumn("batch", F.floor(F.col("_ordinal") / batch_size)).drop("_ordinal"))


def match(costs: list[np.ndarray], items: list[np.ndarray], complete: bool) -> np.ndarray | None:
    """Least-cost item per row, every item used once: shortest augmenting paths over short lists.

    None if a list was too short: no free item could be reached, or some row's dual price exceeds
    its worst listed cost, so that an item beyond the list might have been cheaper.
    """
    n, m = len(costs), 1 + max(int(i.max()) for i in items)
    row_price, item_price = np.zeros(n), np.zeros(m)
    owner, got = np.full(m, -1), np.full(n, -1)
    for start in range(n):
        dist, via, closed = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, base, passed = start, 0.0, []
        while True:
            reach = base + costs[row] - row_price[row] - item_price[items[row]]
            nearer = (reach < dist[items[row]]) & ~closed[items[row]]
            dist[items[row][nearer]], via[items[row][nearer]] = reach[nearer], row
            ahead = np.where(closed, np.inf, dist)
            item = int(ahead.argmin())
            base = ahead[item]
            if not np.isfinite(base):
                return None
            closed[item] = True
            if owner[item] < 0:
                break
            row = owner[item]
            passed.append((item, row))
        row_price[start] += base
        for j, r in passed:
            row_price[r] += base - dist[j]
            item_price[j] -= base - dist[j]
        row = -1
        while row != start:
            row = via[item]
            owner[item] = row
            got[row], item = item, got[row]
    if not complete and any(row_price[r] > costs[r][-1] for r in range(n)):
        return None
    return got


def solve_batch(pdf: pd.DataFrame) -> pd.DataFrame:
    """Match one batch; parent_id stays null if its candidate lists were too short."""
    pdf = pdf.sort_values(["_row", "rank"])
    parents, codes = np.unique(pdf["parent_id"].to_numpy(), return_inverse=True)
    rows, starts = np.unique(pdf["_row"].to_numpy(), return_index=True)
    costs = np.split(pdf["distance"].to_numpy(), starts[1:])
    items = np.split(codes, starts[1:])
    got = match(costs, items, bool(pdf["_complete"].iloc[0]))
    chosen = [None] * len(rows) if got is None else [int(p) for p in parents[got]]
    return pd.DataFrame({"batch": pdf["batch"].iloc[0], "_row": rows,
                         "parent_id": pd.Series(chosen, dtype="Int64")})


def assign_one_to_one(rows: DataFrame, row_id: str, parents: DataFrame, parent_id: str,
                      features: Sequence[str], batch_size: int = 2000) -> DataFrame:
    """(row_id, batch, parent_id).  With more rows in a batch than parents, each row simply takes
    its nearest parent.  Duplicate parent rows count as separate parents."""
    ordinal = dense_ordinal(parents.select(F.col(parent_id).alias("_pk"), *features), ["_pk", *features], "_pord")
    ordinal = cut(ordinal)
    n_parents = ordinal.count()
    rows = cut(rows.select(row_id, *features))  # numbering reads its rows twice
    batched = cut(number_batches(rows, row_id, batch_size))
    if n_parents < batch_size:
        sizes = batched.groupBy("batch").count()
        crowded = cut(batched.join(sizes.filter(F.col("count") > n_parents), "batch", "left_semi"))
        pending = cut(batched.join(sizes.filter(F.col("count") <= n_parents), "batch", "left_semi"))
    else:
        crowded, pending = batched.limit(0), batched
    results = [nearest_parents(crowded, row_id, ordinal, "_pord", features)
               .join(crowded.select(row_id, "batch"), row_id).select(row_id, "batch", "parent_id")]
    k = min(FIRST_LIST, n_parents, batch_size)
    while not pending.isEmpty():
        complete = k >= min(n_parents, batch_size)
        near = nearest_parents(pending, row_id, ordinal, "_pord", features, k)
        listed = (near.join(pending.select(row_id, "batch"), row_id)
                  .select("batch", F.col(row_id).alias("_row"), "parent_id", "distance", "rank",
                          F.lit(complete).alias("_complete")))
        out = T.StructType([T.StructField("batch", T.LongType()),
                            T.StructField("_row", rows.schema[row_id].dataType),
                            T.StructField("parent_id", T.LongType())])
        solved = cut(listed.groupBy("batch").applyInPandas(solve_batch, out))
        results.append(solved.filter(F.col("parent_id").isNotNull())
                       .select(F.col("_row").alias(row_id), "batch", "parent_id"))
        failed = solved.filter(F.col("parent_id").isNull()).select("batch").distinct()
        pending = cut(pending.join(failed, "batch", "left_semi"))
        if complete and not pending.isEmpty():
            raise RuntimeError("a batch with enough parents could not be matched")
        k = min(4 * k, n_parents, batch_size)
    best = results[0]
    for r in results[1:]:
        best = best.unionByName(r)
    return (best.withColumnRenamed("parent_id", "_pord").join(ordinal.select("_pord", "_pk"), "_pord")
            .select(row_id, "batch", F.col("_pk").alias("parent_id")))
