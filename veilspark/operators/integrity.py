"""Find and repair foreign-key violations.

Children may have one key value on a third of their rows, valid, dangling or null.  Reports and
repairs therefore look at *distinct* child keys, which a partial aggregation makes small before
any shuffle; full rows are only touched by a broadcast of the bad keys when those are few.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import Draws
from ..functions.keys import comparable
from ..functions.scaling import cut, small_side
from ..schema import ForeignKey, RelationalSchema
from ..sources.io import union_all
from .nearest import nearest_parents, shared_numeric_columns
from .sample import draw_keys

REPORT_SCHEMA = "fk string, total_rows bigint, violations bigint, violation_rate double"


def valid_keys(parent: DataFrame, key: Column) -> DataFrame:
    return parent.select(key.alias("_key")).filter(F.col("_key").isNotNull()).distinct()


def fk_violations(child: DataFrame, child_col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    """Child rows whose key is null or is no non-null parent key."""
    return split_rows(child, child_col, parent, parent_col)[1]


def fk_report(child: DataFrame | None, child_col: str, parent: DataFrame | None, parent_col: str,
              label: str) -> DataFrame:
    """One row: total, violations and rate.  A missing table reports zeros, a missing column
    reports every row as violating."""
    rate = F.col("violations") / F.greatest("total_rows", F.lit(1))
    if child is None or parent is None:
        spark = SparkSession.active()
        return spark.createDataFrame([(label, 0, 0, 0.0)], REPORT_SCHEMA)
    if child_col not in child.columns or parent_col not in parent.columns:
        return (child.agg(F.count(F.lit(1)).alias("total_rows"))
                .select(F.lit(label).alias("fk"), "total_rows", F.col("total_rows").alias("violations"),
                        F.lit(1.0).alias("violation_rate")))
    asked, given = comparable(child, child_col, parent, parent_col)
    per_key = child.groupBy(asked.alias("_child")).agg(F.count(F.lit(1)).alias("_n"))
    matched = per_key.join(valid_keys(parent, given), F.col("_child") == F.col("_key"), "left")
    return (matched.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"),
                        F.coalesce(F.sum(F.when(F.col("_key").isNull(), F.col("_n"))), F.lit(0)).alias("violations"))
            .select(F.lit(label).alias("fk"), "total_rows", "violations", rate.alias("violation_rate")))


def report_fk(fk: ForeignKey, tables: Mapping[str, DataFrame]) -> DataFrame:
    return fk_report(tables.get(fk.child_table), fk.child_col, tables.get(fk.parent_table), fk.parent_col, fk.label)


def fk_report_all(schema: RelationalSchema, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Reports of all constraints, one row each.

    Every child table is read once: all its keys are listed as (constraint, key) and counted together.
    """
    if not schema.foreign_keys:
        return SparkSession.active().createDataFrame([], REPORT_SCHEMA)
    odd, counted, given = [], [], []
    for name in dict.fromkeys(fk.child_table for fk in schema.foreign_keys):
        child, listed = tables.get(name), []
        for fk in schema.foreign_keys_of(name):
            parent = tables.get(fk.parent_table)
            if child is None or parent is None or fk.child_col not in child.columns or fk.parent_col not in parent.columns:
                odd.append(report_fk(fk, tables))
                continue
            asked, key = comparable(child, fk.child_col, parent, fk.parent_col)
            listed.append(F.struct(F.lit(fk.label).alias("fk"), asked.cast("string").alias("_child")))
            given.append(valid_keys(parent, key).select(F.lit(fk.label).alias("_fk"), F.col("_key").cast("string").alias("_key")))
        if listed:
            counted.append(child.select(F.inline(F.array(*listed))).groupBy("fk", "_child").agg(F.count(F.lit(1)).alias("_n")))
    if not counted:
        return union_all(odd)
    keys = union_all(given)
    matched = union_all(counted).join(keys, (F.col("fk") == F.col("_fk")) & (F.col("_child") == F.col("_key")), "left")
    found = (matched.groupBy("fk").agg(F.sum("_n").alias("total_rows"), F.sum(F.when(F.col("_key").isNull(), F.col("_n")).otherwise(0)).alias("violations")))
    labels = SparkSession.active().createDataFrame([(fk.label,) for fk in schema.foreign_keys], "fk string")
    if odd:
        labels = labels.join(union_all(odd).select("fk"), "fk", "left_anti")
    whole = (labels.join(found, "fk", "left").na.fill(0, ["total_rows", "violations"])
             .withColumn("violation_rate", F.col("violations") / F.greatest("total_rows", F.lit(1))))
    return union_all([whole, *odd])


def overall_consistency(reports: DataFrame) -> DataFrame:
    """Share of valid references over all constraints; 1 if there are none."""
    valid = F.sum(F.col("total_rows") - F.col("violations")) / F.sum("total_rows")
    return reports.agg(F.coalesce(F.when(F.sum("total_rows") > 0, valid), F.lit(1.0)).alias("consistency"))


def fk_metrics(schema: RelationalSchema, tables: Mapping[str, DataFrame]) -> DataFrame:
    """(metric, value): consistency per constraint and overall, from one pass over the reports."""
    reports = fk_report_all(schema, tables)
    return (reports.groupBy("fk").agg(
                F.first(1.0 - F.col("violation_rate")).alias("value"),
                F.first("total_rows").alias("t"), F.first("violations").alias("v"))
            .rollup("fk").agg(F.grouping("fk").alias("g"), F.first("value").alias("value"),
                              F.sum("t").alias("t"), F.sum("v").alias("v"))
            .select(F.when(F.col("g") == 1, "overall").otherwise(F.col("fk")).alias("metric"),
                    F.when(F.col("g") == 0, F.col("value"))
                    .when(F.col("t") > 0, (F.col("t") - F.col("v")) / F.col("t"))
                    .otherwise(1.0).alias("value")))


def bad_keys(child: DataFrame, child_col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    """Distinct non-null child keys without a parent."""
    asked = child.select(F.col(child_col).alias("_bad")).filter(F.col("_bad").isNotNull()).distinct()
    bad, given = comparable(asked, "_bad", parent, parent_col)
    return asked.join(valid_keys(parent, given), bad == F.col("_key"), "left_anti")


def split_rows(child: DataFrame, child_col: str, parent: DataFrame, parent_col: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, violating rows).

    The bad keys are materialised once; if they are few they are broadcast and the child's rows
    stay where they are, otherwise the join shuffles and AQE splits hot keys.
    """
    bad = small_side(cut(bad_keys(child, child_col, parent, parent_col)))
    present = child.filter(F.col(child_col).isNotNull())
    good = present.join(bad, F.col(child_col) == F.col("_bad"), "left_anti")
    dangling = present.join(bad, F.col(child_col) == F.col("_bad"), "left_semi")
    return good, dangling.union(child.filter(F.col(child_col).isNull()))


def most_frequent_key(parent: DataFrame, key: str) -> Column:
    """The key on most parent rows (the smallest on ties), as a scalar subquery."""
    return (parent.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), key).limit(1).select(key).scalar())


def repair_foreign_key(child: DataFrame, child_col: str, parent: DataFrame, parent_col: str, row_id: str,
                       draws: Draws = Draws(), method: str = "random", scope: str = "",
                       exclude: tuple[str, ...] = (), batch_size: int = 2000) -> DataFrame:
    """Replace every violating key; valid rows are passed through untouched.

    Methods: ``random`` draws a parent row uniformly, ``mode`` takes the most frequent key,
    ``nearest`` the parent with the closest shared numeric features, ``one_to_one`` the cheapest
    matching in batches of violating rows.  The last two fall back to ``random`` if the tables
    share no numeric column.  ``exclude`` names columns (keys) that are no features.
    """
    parent = parent.filter(F.col(parent_col).isNotNull())
    if parent.isEmpty():
        return child
    good, bad = split_rows(child, child_col, parent, parent_col)
    features = []
    if method in ("nearest", "one_to_one"):
        features = shared_numeric_columns(child, parent, exclude)
        method = method if features else "random"
    if method == "mode":
        fixed = bad.withColumn(child_col, most_frequent_key(parent, parent_col))
    elif method == "random":
        u = draws.uniform("repair", scope, child_col, F.col(row_id))
        fixed = draw_keys(bad.drop(child_col), parent, parent_col, u, child_col)
    elif method == "nearest":
        best = nearest_parents(bad, row_id, parent, parent_col, features)
        fixed = bad.drop(child_col).join(best.select(row_id, F.col("parent_id").alias(child_col)), row_id)
    elif method == "one_to_one":
        from .assign import assign_one_to_one
        best = assign_one_to_one(bad, row_id, parent, parent_col, features, batch_size)
        fixed = bad.drop(child_col).join(best.select(row_id, F.col("parent_id").alias(child_col)), row_id)
    else:
        raise ValueError(f"unknown repair method {method!r}")
    same_type = F.col(child_col).cast(child.schema[child_col].dataType).alias(child_col)
    return good.unionByName(fixed.select(*[same_type if c == child_col else c for c in child.columns]))


def repair_all(schema: RelationalSchema, tables: Mapping[str, DataFrame], row_ids: Mapping[str, str],
               method: str = "random", max_iterations: int = 100, draws: Draws = Draws(),
               exclude_keys: bool = True) -> tuple[dict[str, DataFrame], int]:
    """Check and repair until no constraint is violated: (tables, rounds used).

    Repairs go parents first and each repaired table is materialised, so one round suffices unless
    a repaired key is itself referenced.  A round that changes nothing, as with an empty parent, is the
    last one; a warning names what is left.
    """
    tables = dict(tables)
    rank = {t: i for i, t in enumerate(schema.topological_order())}
    before, iteration = None, -1
    for iteration in range(max_iterations):
        failing = {r["fk"]: r["violations"] for r in fk_report_all(schema, tables).filter("violations > 0").collect()}
        if failing and failing == before:
            break
        before = failing
        todo = [fk for fk in schema.foreign_keys if fk.label in failing
                and fk.child_col in tables[fk.child_table].columns
                and fk.parent_col in tables[fk.parent_table].columns]
        if not todo:
            return tables, iteration
        for fk in sorted(todo, key=lambda f: rank[f.child_table]):
            exclude = ()
            if exclude_keys:
                exclude = tuple(schema.key_columns(fk.child_table) | schema.key_columns(fk.parent_table))
            tables[fk.child_table] = cut(repair_foreign_key(
                tables[fk.child_table], fk.child_col, tables[fk.parent_table], fk.parent_col,
                row_ids[fk.child_table], Draws(f"{draws.seed}/{iteration}", draws.generator), method,
                fk.label, exclude))
    else:
        iteration += 1
        before = {r["fk"]: r["violations"] for r in fk_report_all(schema, tables).filter("violations > 0").collect()}
    if before:
        warnings.warn(f"violations left after {iteration} rounds: {before}", stacklevel=2)
    return tables, iteration
