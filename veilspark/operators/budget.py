"""Query workloads and the split of one privacy budget over tables.

Tables and schema facts are one row per table, so windows over *those* frames are tiny by
construction.  Query logs may be of any size: they are only exploded, filtered and aggregated.

Frames:

* stats:    (table_name, n_attrs, n_children, n_parents, n_rows), plus ``ordinal``
* workload: (qid, tables array<string>, order int, weight double)
* budget:   (table_name, eps)
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.draws import Draws, choice_draw
from ..functions.scaling import cut
from ..schema import RelationalSchema

QUERY_TYPES = ("1way", "2way", "cross_table")
# Renyi orders.
RDP_ORDERS = (1.5, 2.0, 3.0, 5.0, 10.0, 25.0, 50.0, 100.0)
WORST_SETS = 32
"""Table sets that a round of the max-min play brings back."""


def table_stats(spark: SparkSession, schema: RelationalSchema, sizes: DataFrame | None = None) -> DataFrame:
    """One row per table; a table without a known size counts as one row."""
    facts = spark.createDataFrame(
        [(i, t, max(len(m.attributes), 1), len(schema.references_to(t)), len(schema.foreign_keys_of(t)))
         for i, (t, m) in enumerate(schema.tables.items())],
        "ordinal int, table_name string, n_attrs int, n_children int, n_parents int")
    if sizes is None:
        return facts.withColumn("n_rows", F.lit(1).cast("bigint"))
    return facts.join(sizes, "table_name", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(1)))


def table_weights(stats: DataFrame) -> DataFrame:
    """Structural weight of each table, as a share of all tables."""
    raw = ((F.col("n_attrs") + F.col("n_children") + F.col("n_parents"))
           * F.log1p(F.greatest("n_rows", F.lit(1)).cast("double")))
    total = F.sum("_raw").over(Window.partitionBy())
    return (stats.withColumn("_raw", raw)
            .withColumn("weight", F.when(total > 0, F.col("_raw") / total)
                        .otherwise(1.0 / F.count(F.lit(1)).over(Window.partitionBy())))
            .drop("_raw"))


def generate_workload(spark: SparkSession, weights: DataFrame, num_queries: int | Column,
                      query_types: Sequence[str] = QUERY_TYPES, decay: float = 0.9,
                      draws: Draws = Draws(), queries: DataFrame | None = None) -> DataFrame:
    """Random queries: a type, then one table or several, drawn by structural weight.

    Cross-table queries take two or three distinct tables without replacement.  Every query is
    joined with the (few) tables and keeps those with the smallest exponential keys, which is an
    exact weighted draw for one table as well as for several.  ``queries`` (column ``qid``) may
    be given instead of a number.
    """
    queries = queries if queries is not None else spark.range(num_queries).withColumnRenamed("id", "qid")
    qid = F.col("qid")
    tables = weights.agg(F.sort_array(F.collect_list(F.struct("ordinal", "table_name", "weight"))).alias("_t"))
    qtype = choice_draw(draws.uniform("query_type", qid), list(query_types))
    typed = queries.select("qid", qtype.alias("qtype")).withColumn(
        "order", F.element_at(F.create_map(*[F.lit(x) for kv in
                                             {"1way": 1, "2way": 2, "3way": 3, "cross_table": 2}.items()
                                             for x in kv]), F.col("qtype")))
    wanted = F.when(F.col("qtype") == "cross_table",
                    2 + (draws.uniform("query_size", qid) >= 0.5).cast("int")).otherwise(1)
    keyed = F.transform("_t", lambda t: F.struct(
        (-F.log(draws.uniform("query_table", qid, t["table_name"])) / t["weight"]).alias("key"),
        t["ordinal"].alias("ordinal"), t["table_name"].alias("table_name")))
    picked = (typed.withColumn("_n", wanted).withColumn("_t", tables.scalar())
              .withColumn("_picked", F.slice(F.sort_array(keyed), F.lit(1), F.col("_n"))))
    return picked.select(
        "qid", F.transform(F.array_sort(F.transform("_picked", lambda t: F.struct(
            t["ordinal"].alias("o"), t["table_name"].alias("t")))), lambda t: t["t"]).alias("tables"),
        F.col("order").cast("int").alias("order"),
        F.pow(F.lit(decay), F.col("order") - 1).alias("weight"))


def involvement(workload: DataFrame, stats: DataFrame) -> DataFrame:
    """Summed weight of the queries touching each declared table; other names are ignored."""
    touched = (workload.select(F.explode("tables").alias("table_name"), "weight")
               .groupBy("table_name").agg(F.sum("weight").alias("involvement")))
    return (stats.join(touched, "table_name", "left")
            .withColumn("involvement", F.coalesce("involvement", F.lit(0.0))))


def effective_floor(eps_total: float, eps_min: float, n_tables: Column) -> Column:
    """The floor per table, lowered if all floors together would use over nine tenths."""
    return F.least(F.lit(float(eps_min)), 0.9 * eps_total / F.greatest(n_tables, F.lit(1)))


def normalize(alloc: DataFrame, eps_total: float, eps_min: float) -> DataFrame:
    """Scale to the total, raise to the floor, scale again if the floors moved the sum."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    floor = effective_floor(eps_total, eps_min, n)
    total = F.sum("eps").over(Window.partitionBy())
    raised = F.sum("_floored").over(Window.partitionBy())
    return (alloc
            .withColumn("_floored", F.when(total < 1e-15, eps_total / n)
                        .otherwise(F.greatest(F.col("eps") * (eps_total / total), floor)))
            .withColumn("eps", F.when(F.abs(raised - eps_total) > 1e-10,
                                      F.col("_floored") * (eps_total / raised))
                        .otherwise(F.col("_floored")))
            .drop("_floored"))


def _split_by(df: DataFrame, share: Column, eps_total: float, eps_min: float) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy())
    total = F.sum("_share").over(Window.partitionBy())
    raw = (df.withColumn("_share", share)
           .withColumn("_total", total)
           .select("table_name", "_total", F.when(F.col("_total") > 1e-15, F.greatest(
               eps_total * F.col("_share") / F.col("_total"), effective_floor(eps_total, eps_min, n)))
               .otherwise(eps_total / n).alias("eps")))
    return normalize(raw.select("table_name", "eps"), eps_total, eps_min)


def split_equal(stats: DataFrame, eps_total: float) -> DataFrame:
    return stats.select("table_name", (F.lit(float(eps_total)) / F.count(F.lit(1)).over(Window.partitionBy())).alias("eps"))


def split_proportional(stats: DataFrame, workload: DataFrame, eps_total: float,
                       eps_min: float = 0.05) -> DataFrame:
    """Share of each table in the query log's summed weights; equal without any query."""
    return _split_by(involvement(workload, stats), F.col("involvement"), eps_total, eps_min)


def split_analytical(stats: DataFrame, workload: DataFrame, eps_total: float,
                     eps_min: float = 0.05) -> DataFrame:
    """Variance-optimal split: cube root of involvement x attributes x log of rows."""
    cost = (F.greatest("involvement", F.lit(0.01)) * F.greatest("n_attrs", F.lit(1))
            * F.log1p(F.greatest("n_rows", F.lit(1)).cast("double")))
    return _split_by(involvement(workload, stats), F.pow(cost, F.lit(1.0 / 3.0)), eps_total, eps_min)


def compact_workload(workload: DataFrame, stats: DataFrame) -> DataFrame:
    """One row per distinct set of declared tables with the largest weight asked of it.

    Any query log shrinks to at most the number of table sets that occur, and the max-min
    problem keeps exactly the same solutions.
    """
    known = stats.agg(F.collect_set("table_name").alias("_known"))
    cleaned = F.array_sort(F.array_intersect(F.col("tables"), F.col("_known")))
    return (workload.withColumn("_known", known.scalar())
            .select(cleaned.alias("tables"), "weight")
            .groupBy("tables").agg(F.max("weight").alias("weight"), F.count(F.lit(1)).alias("n_queries")))


def split_maxmin(stats: DataFrame, workload: DataFrame, eps_total: float, eps_min: float = 0.05,
                 tolerance: float = 1e-6) -> DataFrame:
    """Maximise the smallest (budget of a query's tables / query weight).

    The best answer is within ``tolerance`` of the optimum; see ``maxmin_allocation``.  Falls back to the
    analytical split if there is no usable query.
    """
    sets = cut(compact_workload(workload, stats).filter((F.col("weight") > 0) & (F.size("tables") > 0)))
    if sets.isEmpty():
        return split_analytical(stats, workload, eps_total, eps_min)
    names = [r["table_name"] for r in stats.select("table_name", "ordinal").orderBy("ordinal").collect()]
    best, _, _ = maxmin_allocation(sets, names, eps_total, eps_min, tolerance)
    alloc = stats.sparkSession.createDataFrame(
        [(t, float(e)) for t, e in zip(names, best)], "table_name string, eps double")
    return normalize(alloc, eps_total, eps_min)


def worst_served(sets: DataFrame, alloc: Mapping[str, float], n: int) -> list[Row]:
    """The n table sets that an allocation serves worst for their weight, of any number of sets: each task
    keeps its own n worst and only those are merged."""
    given = F.create_map(*[x for t, e in alloc.items() for x in (F.lit(t), F.lit(float(e)))])
    budget = F.aggregate("tables", F.lit(0.0), lambda total, t: total + given[t])
    return (sets.select("tables", "weight", (budget / F.col("weight")).alias("served"))
            .orderBy("served", "tables").limit(n).collect())


def maxmin_allocation(sets: DataFrame, names: Sequence[str], eps_total: float, eps_min: float = 0.05,
                      tolerance: float = 1e-6, worst: int = WORST_SETS, rounds: int = 200) -> tuple[np.ndarray, float, float]:
    """(allocation, its smallest share, an upper bound on any allocation's smallest share).

    A play of rounds between an allocation and the table sets, which stay on the cluster: each round ranks all
    sets under the present allocation and brings back the ``worst`` served ones; the allocation answers with the
    best split for all sets met so far.  That answer bounds every allocation from above, the worst set of all
    bounds it from below, and the play ends when the two meet to a part of ``tolerance``.  A set that is met
    is served at least as well from then on, so the driver holds at most ``rounds * worst`` sets (some dozens as
    a rule), however long the log is.
    """
    at = {t: i for i, t in enumerate(names)}
    floor = min(eps_min, 0.9 * eps_total / len(names))
    alloc = np.full(len(names), eps_total / len(names))
    best, low, high, met = alloc, -np.inf, np.inf, {}
    for _ in range(rounds):
        found = worst_served(sets, dict(zip(names, alloc.tolist())), worst)
        if found[0]["served"] > low:
            best, low = alloc, found[0]["served"]
        new = {tuple(r["tables"]): r["weight"] for r in found if tuple(r["tables"]) not in met}
        if not new or (np.isfinite(high) and high - low <= tolerance * high):
            return best, low, high
        met |= new
        member = np.zeros((len(met), len(names)))
        for q, tables in enumerate(met):
            member[q, [at[t] for t in tables]] = 1.0
        alloc, bound = best_answer(member, np.array(list(met.values())), eps_total, floor, 0.1 * tolerance)
        high = min(high, bound)
    warnings.warn(f"max-min split ended after {rounds} rounds between {low} and {high}", stacklevel=2)
    return best, low, high


def best_answer(member: np.ndarray, weight: np.ndarray, total: float, floor: float, tolerance: float) -> tuple[np.ndarray, float]:
    """The allocation whose worst of a few table sets is served best, and a bound on what any can reach.

    Newton steps on the logarithmic barrier of the sets' and floors' slacks, along allocations of one total;
    with weight t on the worst share, the barrier's minimum is within (number of slacks) / t of the optimum.
    The central one of all best allocations is found, so equal tables of one set get equal budgets.
    """
    n_sets, n = member.shape
    unit = weight.max()
    rows = np.vstack([np.hstack([member, -(weight / unit)[:, None]]), np.hstack([np.eye(n), np.zeros((n, 1))])])
    least = np.concatenate((np.zeros(n_sets), np.full(n, floor / total)))
    x = np.full(n + 1, 1.0 / n)
    x[n] = 0.9 * (member @ x[:n] / (weight / unit)).min()
    along = np.append(np.ones(n), 0.0)
    press = 1.0
    while True:
        for _ in range(100):
            slack = rows @ x - least
            slope = -rows.T @ (1.0 / slack)
            slope[n] -= press
            curve = (rows / slack[:, None] ** 2).T @ rows
            unit_step = 1.0 / np.sqrt(np.diag(curve))
            held = (along * unit_step / np.linalg.norm(along * unit_step))[:, None]
            system = np.block([[curve * np.outer(unit_step, unit_step), held], [held.T, np.zeros((1, 1))]])
            step = unit_step * np.linalg.lstsq(system, np.append(-slope * unit_step, 0.0), rcond=None)[0][:n + 1]
            gain = -slope @ step
            if gain < 1e-9:
                break
            change, size = rows @ step, 1.0
            if (change < 0).any():
                size = min(1.0, 0.99 * (slack[change < 0] / -change[change < 0]).min())
            value = -press * x[n] - np.log(slack).sum()
            while size > 1e-12 and -press * (x[n] + size * step[n]) - np.log(slack + size * change).sum() > value - 1e-4 * size * gain:
                size /= 2
            x = x + size * step
        gap = len(rows) / press
        if gap <= tolerance * x[n]:
            return x[:n] * total, (x[n] + gap) * total / unit
        press *= 10


def allocate(method: str, stats: DataFrame, workload: DataFrame | None, eps_total: float,
             eps_min: float = 0.05) -> DataFrame:
    """Budget by strategy name: analytical, proportional, maxmin or equal."""
    if method == "equal":
        return split_equal(stats, eps_total)
    splits = {"analytical": split_analytical, "proportional": split_proportional, "maxmin": split_maxmin}
    if method not in splits:
        raise ValueError(f"unknown budget strategy {method!r}")
    if workload is None:
        workload = stats.sparkSession.createDataFrame(
            [], "qid bigint, tables array<string>, `order` int, weight double")
    return splits[method](stats, workload, eps_total, eps_min)


def in_table_split(k: Column | int, eps) -> Column:
    """Budget of each released statistic of a table with k modelled columns."""
    k = k if isinstance(k, Column) else F.lit(k)
    return eps / (F.greatest(k * (k - 1) / 2, F.lit(1.0)) + k)


def budget_ledger(budget: DataFrame, stats: DataFrame) -> DataFrame:
    """(table_name, eps, n_releases, eps_per_release): what each table's budget is spent on."""
    k = F.col("n_attrs")
    return (budget.join(stats.select("table_name", "n_attrs"), "table_name")
            .select("table_name", "eps", (F.greatest(k * (k - 1) / 2, F.lit(1.0)) + k).cast("bigint").alias("n_releases"),
                    in_table_split(k, F.col("eps")).alias("eps_per_release")))


def rdp_cost(a: Column, e: Column, formula: str) -> Column:
    """Renyi cost of order ``a`` of one release with budget ``e``."""
    if formula == "reference":
        return a * e * e / (2.0 * (a - 1.0))
    if formula == "laplace":
        return F.log(a / (2 * a - 1) * F.exp((a - 1) * e) + (a - 1) / (2 * a - 1) * F.exp(-a * e)) / (a - 1)
    raise ValueError(f"unknown formula {formula!r}")


def composed_ledger(ledger: DataFrame, delta: float, orders: Sequence[float] = RDP_ORDERS,
                    formula: str = "laplace") -> DataFrame:
    """(table_name, n_releases, eps, composed_eps, guarantee, is_private) of each table in a ledger.

    ``eps`` adds up all releases.  ``composed_eps`` is what they cost together at ``delta``, by the
    best Renyi order, and ``guarantee`` the better of the two.  A table is private if nothing about
    it was read outside the budget.
    """
    log_term = float(np.log(1.0 / delta))
    each = F.col("eps") / F.greatest("n_releases", F.lit(1))
    costs = [F.sum(F.col("n_releases") * rdp_cost(F.lit(float(o)), each, formula)) + log_term / (o - 1.0)
             for o in orders if o > 1]
    return (ledger.groupBy("table_name")
            .agg(F.sum("n_releases").alias("n_releases"), F.sum("eps").alias("eps"),
                 F.array_min(F.array(*costs)).alias("composed_eps"), F.bool_and("is_private").alias("is_private"))
            .withColumn("guarantee", F.least("eps", "composed_eps")))


def rdp_compose(budget: DataFrame, delta: float, orders: Sequence[float] = RDP_ORDERS,
                formula: str = "reference") -> DataFrame:
    """Composed (eps, delta) per Renyi order above 1; the guarantee is the smallest of them.

    ``reference``: cost alpha * eps^2 / (2 (alpha - 1)).  ``laplace``: the Laplace mechanism's
    Renyi divergence (Mironov 2017).
    """
    usable = F.array(*[F.lit(float(o)) for o in orders if o > 1])
    return (budget.select("eps", F.explode(usable).alias("alpha"))
            .groupBy("alpha").agg(F.sum(rdp_cost(F.col("alpha"), F.col("eps"), formula)).alias("rdp"))
            .withColumn("composed_eps", F.col("rdp") + float(np.log(1.0 / delta)) / (F.col("alpha") - 1.0)))
