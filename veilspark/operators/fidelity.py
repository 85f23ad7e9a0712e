"""How close a synthetic table is to the real one: marginal distances and query errors.

Both sides are aggregated separately first; only group counts meet in a full outer join.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.keys import comparable
from ..schema import NUMERICAL, RelationalSchema, Table
from ..sources.io import Tables, union_all
from .encode import as_number

TV_BINS = 50


def _both_sides(real: DataFrame, syn: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts per key on both sides: (keys.., r, s), each side's total in (rt, st)."""
    r = real.groupBy(*keys).agg(F.count(F.lit(1)).alias("r"))
    s = syn.groupBy(*keys).agg(F.count(F.lit(1)).alias("s"))
    return r.join(s, list(keys), "full").fillna(0, ["r", "s"])


def key_union(real: DataFrame, syn: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct group keys of either side, rows with a null key left out."""
    return real.select(*keys).dropna().union(syn.select(*keys).dropna()).distinct()


def kway_error(real: DataFrame, syn: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row (cells, error): mean absolute difference of the frequencies of all combinations
    that occur on either side.  Null keys are dropped; the error is null if real has no row."""
    sides = [comparable(real, c, syn, c) for c in columns]
    r = real.select(*[x.alias(c) for c, (x, _) in zip(columns, sides)]).dropna()
    s = syn.select(*[y.alias(c) for c, (_, y) in zip(columns, sides)]).dropna()
    both = _both_sides(r, s, columns)
    totals = both.agg(F.sum("r").alias("rt"), F.greatest(F.sum("s"), F.lit(1)).alias("st"))
    gap = F.abs(F.try_divide("r", totals.select("rt").scalar()) - F.col("s") / totals.select("st").scalar())
    return both.select(gap.alias("_gap")).agg(F.count(F.lit(1)).alias("cells"), F.avg("_gap").alias("error"))


def kway_errors(real: DataFrame, syn: DataFrame, column_sets: Sequence[Sequence[str]]) -> DataFrame:
    """(columns, cells, error) of many column sets: each side is scanned once, and one shuffle
    carries the partial counts of all sets.

    The sets are grouping sets, so keys keep their types where both sides agree in one that compares like its text.
    """
    names: dict[frozenset, list[str]] = {}
    for cs in column_sets:
        names.setdefault(frozenset(cs), []).append("|".join(cs))
    cells_alike = union_all([_cells_alike(real, syn, part) for part in _narrow(names)])
    mine = Window.partitionBy("columns")
    totals = cells_alike.withColumns({"rt": F.sum(F.col("r") * F.col("k")).over(mine),
                                      "st": F.greatest(F.sum(F.col("s") * F.col("k")).over(mine), F.lit(1))})
    gap = F.abs(F.try_divide("r", "rt") - F.col("s") / F.col("st"))
    return (totals.groupBy("columns")
            .agg(F.sum("k").alias("cells"), (F.sum(gap * F.col("k")) / F.sum(F.when(gap.isNotNull(), F.col("k")))).alias("error")))


def _narrow(names: dict[frozenset, list[str]]) -> list[dict[frozenset, list[str]]]:
    """The sets in parts of at most 60 columns, as a grouping id has 64 bits."""
    parts: list[dict[frozenset, list[str]]] = [{}]
    for cs, told in names.items():
        if parts[-1] and len(cs.union(*parts[-1])) > 60:
            parts.append({})
        parts[-1][cs] = told
    return parts


def _cells_alike(real: DataFrame, syn: DataFrame, names: dict[frozenset, list[str]]) -> DataFrame:
    """(columns, r, s, k): how many cells of each set of columns occur r times in real and s times in syn; ``names`` has the names of a set."""
    columns = sorted(frozenset().union(*names))
    keys = {c: f"_k{i}" for i, c in enumerate(columns)}

    def side(df, name):
        plain = [isinstance(real.schema[c].dataType, (T.IntegralType, T.StringType, T.DateType)) and real.schema[c].dataType == syn.schema[c].dataType
                 for c in columns]
        return df.select(*[(F.col(c) if p else F.col(c).cast("string")).alias(keys[c]) for c, p in zip(columns, plain)], F.lit(name).alias("side"))

    counted = (side(real, "r").unionByName(side(syn, "s")).groupingSets([[F.col(keys[c]) for c in sorted(cs)] for cs in names], *keys.values())
               .agg(F.grouping_id().alias("_set"), F.count(F.when(F.col("side") == "r", 1)).alias("r"), F.count(F.when(F.col("side") == "s", 1)).alias("s")))
    told, whole = F.lit(None), F.lit(False)
    for cs, mine in names.items():
        this = F.col("_set") == sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in cs)
        told = F.when(this, F.array(*map(F.lit, mine))).otherwise(told)
        whole = whole | (this & ~_any_null([keys[c] for c in sorted(cs)]))
    return (counted.filter(whole).groupBy("_set", "r", "s").agg(F.count(F.lit(1)).alias("k"))
            .select(F.explode(told).alias("columns"), "r", "s", "k"))


def _alike(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(first key, r, s, k): how many keys occur r times among the rows of side r and s times among those of side s.

    Keys are counted once for both sides.  What is asked of them afterwards depends on their two counts only, so
    totals and distances read this small table instead of the counts of all keys again.
    """
    both = rows.groupBy(*keys).agg(F.count(F.when(F.col("side") == "r", 1)).alias("r"), F.count(F.when(F.col("side") == "s", 1)).alias("s"))
    return both.groupBy(keys[0], "r", "s").agg(F.count(F.lit(1)).alias("k"))


def _any_null(columns: Sequence[str]) -> Column:
    flag = F.lit(False)
    for c in columns:
        flag = flag | F.col(c).isNull()
    return flag


def cross_count(child: DataFrame, child_col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    """Rows of the join of child and parent, without building it: both sides are counted per key
    and the products are summed, so a hot key is one row on each side."""
    return _cross_sums(child, child_col, parent, parent_col, []).select(F.coalesce("rows", F.lit(0)).alias("value"))


def cross_mean(child: DataFrame, child_col: str, parent: DataFrame, parent_col: str, column: str) -> DataFrame:
    """Mean of a parent column over the join of child and parent, from per-key sums.

    What is no number counts as missing; an empty join has the mean 0.
    """
    return _cross_sums(child, child_col, parent, parent_col, [column]).select(_mean_of(0).alias("value"))


def cross_values(child: DataFrame, child_col: str, parent: DataFrame, parent_col: str,
                 columns: Sequence[str | None]) -> DataFrame:
    """One row (values): the means of several parent columns over the join, or its rows for None, from one pass
    over child and parent."""
    measures = [c for c in dict.fromkeys(columns) if c is not None]
    values = [F.coalesce("rows", F.lit(0)).cast("double") if c is None else _mean_of(measures.index(c)) for c in columns]
    return _cross_sums(child, child_col, parent, parent_col, measures).select(F.array(*values).alias("values"))


def _mean_of(i: int) -> Column:
    return F.when(F.coalesce("rows", F.lit(0)) == 0, 0.0).when(F.col(f"n{i}") > 0, F.col(f"s{i}") / F.col(f"n{i}"))


def _cross_sums(child: DataFrame, child_col: str, parent: DataFrame, parent_col: str, columns: Sequence[str]) -> DataFrame:
    """One row (rows, n0, s0, n1, ..): rows of the join, and numbers and sum of each parent column over it."""
    def number(column):
        x = F.col(column).try_cast("double") if isinstance(parent.schema[column].dataType, T.StringType) else as_number(parent, column)
        return F.when(~F.isnan(x), x)
    asked, given = comparable(child, child_col, parent, parent_col)
    c = child.groupBy(asked.alias("_k")).agg(F.count(F.lit(1)).alias("_c"))
    p = parent.select(given.alias("_k"), *[number(m).alias(f"_x{i}") for i, m in enumerate(columns)]).groupBy("_k").agg(
        F.count(F.lit(1)).alias("_p"), *[f(f"_x{i}").alias(f"_{n}{i}") for i in range(len(columns)) for n, f in (("n", F.count), ("s", F.sum))])
    return c.join(p, "_k").agg(
        F.sum(F.col("_c") * F.col("_p")).alias("rows"),
        *[F.sum(F.col("_c") * F.col(f"_{n}{i}")).alias(f"{n}{i}") for i in range(len(columns)) for n in "ns"])


def relative_error(real: Column, syn: Column) -> Column:
    """|real - syn| / |real|, or the plain difference if real is about 0."""
    size = F.abs(real)
    return F.abs(real - syn) / F.when(size > 1e-9, size).otherwise(1.0)


def tv_numeric(real: DataFrame, syn: DataFrame, columns: Sequence[str], num_bins: int = TV_BINS) -> DataFrame:
    """(column_name, tv): half the L1 distance of histograms over the joint range.

    Equal constants are 0 apart; one empty side is 1 apart; two empty sides have no distance.
    One pass finds all ranges (they become literals), one pass per side counts all bins.
    """
    if not columns:
        return real.sparkSession.createDataFrame([], "column_name string, tv double")
    def values(df):
        return [F.nanvl(as_number(df, c), F.lit(None).cast("double")).alias(c) for c in columns]
    r, s = real.select(values(real)), syn.select(values(syn))
    ends = r.unionByName(s).agg(*[f(c).alias(f"{f.__name__}_{i}") for i, c in enumerate(columns)
                                  for f in (F.min, F.max)]).first()

    def binned(df, side):
        """Counts of (column, bin): one whole number per value until they are summed."""
        cells = []
        for i, c in enumerate(columns):
            lo, hi = ends[f"min_{i}"], ends[f"max_{i}"]
            if lo is None:
                continue
            x = F.col(c)
            # least() skips nulls, so missing values have to be kept out first
            code = F.least(F.floor((x - lo) / (hi - lo) * num_bins), F.lit(num_bins - 1)) if hi > lo else F.lit(0)
            cells.append(F.when(x.isNotNull(), code.cast("bigint") + i * num_bins))
        return (df.select(F.explode(F.array(*cells).cast("array<bigint>")).alias("_cell"))
                .filter("_cell is not null").withColumn("side", F.lit(side)))
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), (F.floor(F.col("_cell") / num_bins) + 1).cast("int"))
    counted = (binned(r, "r").unionByName(binned(s, "s")).groupBy("_cell")
               .agg(F.count(F.when(F.col("side") == "r", 1)).alias("r"), F.count(F.when(F.col("side") == "s", 1)).alias("s")))
    return _tv(counted.select(name.alias("column_name"), "r", "s", F.lit(1).cast("bigint").alias("k")), columns)


def tv_categorical(real: DataFrame, syn: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, tv): half the L1 distance of value shares, nulls left out, all columns in
    one pass per side."""
    if not columns:
        return real.sparkSession.createDataFrame([], "column_name string, tv double")
    pairs = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns]
    values = _long_values(real, pairs, "r").unionByName(_long_values(syn, pairs, "s"))
    return _tv(_alike(values, ["column_name", "value"]), columns)


def _long_values(df: DataFrame, pairs: list[Column], side: str) -> DataFrame:
    empty = F.array().cast("array<struct<column_name:string,value:string>>")
    return (df.select(F.inline(F.array(*pairs) if pairs else empty)).filter(F.col("value").isNotNull())
            .withColumn("side", F.lit(side)))


def _tv(alike: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, tv) from (column_name, r, s, k): k values with r rows on one side and s on the other."""
    rt, st = F.sum(F.col("r") * F.col("k")), F.sum(F.col("s") * F.col("k"))
    totals = alike.groupBy("column_name").agg(rt.alias("rt"), st.alias("st"))
    rt, st = F.col("rt"), F.col("st")
    gap = F.abs(F.coalesce(F.col("r") / F.nullif(rt, F.lit(0)), F.lit(0.0))
                - F.coalesce(F.col("s") / F.nullif(st, F.lit(0)), F.lit(0.0)))
    per = (alike.join(F.broadcast(totals), "column_name").groupBy("column_name")
           .agg(F.when((F.first(rt) > 0) & (F.first(st) > 0), 0.5 * F.sum(gap * F.col("k"))).otherwise(1.0).alias("tv")))
    names = F.explode(F.array(*[F.lit(c) for c in columns])).alias("column_name")
    every = alike.sparkSession.range(1).select(names)
    return every.join(per, "column_name", "left")


def table_tv(real: DataFrame, syn: DataFrame, table: Table) -> DataFrame:
    """(column_name, tv) of every column both sides have."""
    shared = [c for c in real.columns if c in syn.columns]
    numeric = [c for c in shared if table.dtypes.get(c) == NUMERICAL]
    text = [c for c in shared if c not in numeric]
    return tv_numeric(real, syn, numeric).unionByName(tv_categorical(real, syn, text))


def tv_report(real: Tables, syn: Tables, schema: RelationalSchema) -> DataFrame:
    """(table_name, column_name, tv) of all tables both sides have."""
    return union_all([table_tv(real[n], syn[n], t).select(F.lit(n).alias("table_name"), "column_name", "tv")
                      for n, t in schema.tables.items() if n in real and n in syn])


def tv_averages(report: DataFrame) -> DataFrame:
    """(table_name, tv): mean over columns per table, and the mean of those means as ``*``."""
    per = report.groupBy("table_name").agg(F.avg("tv").alias("tv"))
    return per.unionByName(per.agg(F.coalesce(F.avg("tv"), F.lit(0.0)).alias("tv"))
                           .select(F.lit("*").alias("table_name"), "tv"))


@dataclass(frozen=True)
class PlannedQuery:
    """One random query of the evaluation workload; ``copies`` counts how often it was drawn."""

    qtype: str
    table: str
    columns: tuple[str, ...]
    copies: int = 1


ORDERS = {"1way": 1, "2way": 2, "3way": 3}


def plan_queries(schema: RelationalSchema, num_queries: int, query_types: Sequence[str], seed: int,
                 available: dict[str, set[str]] | None = None) -> list[PlannedQuery]:
    """Draw the workload and merge repeated queries.  Draws with no answer (too few categorical
    columns, no foreign key) are dropped, as they add nothing to an average."""
    rng = random.Random(seed)
    drawn: dict[PlannedQuery, int] = {}
    names = list(schema.tables)
    for _ in range(num_queries):
        qtype = rng.choice(list(query_types))
        query = None
        if qtype in ORDERS:
            table = schema.tables[rng.choice(names)]
            columns = table.columns_of("categorical")
            if len(columns) >= ORDERS[qtype]:
                chosen = sorted(rng.sample(columns, ORDERS[qtype]), key=columns.index)
                query = PlannedQuery(qtype, table.name, tuple(chosen))
        elif qtype == "cross_table" and schema.foreign_keys:
            fk = rng.choice(schema.foreign_keys)
            numeric = [c for c in schema.tables[fk.parent_table].columns_of(NUMERICAL) if c != fk.parent_col]
            measure = (rng.choice(numeric),) if numeric else ()
            query = PlannedQuery(qtype, fk.label, measure)
        if query:
            drawn[query] = drawn.get(query, 0) + 1
    return [PlannedQuery(q.qtype, q.table, q.columns, n) for q, n in drawn.items()]


def query_errors(real: Tables, syn: Tables, schema: RelationalSchema, plan: Sequence[PlannedQuery]) -> DataFrame:
    """(qtype, query, error, copies): every distinct planned query once; all k-way queries of a
    table share one scan of each side."""
    spark = SparkSession.active()
    frames = []
    for name in schema.tables:
        if name not in real or name not in syn:
            continue
        known = set(real[name].columns) & set(syn[name].columns)
        mine = {}
        for q in plan:
            columns = tuple(c for c in q.columns if c in known)
            if q.qtype in ORDERS and q.table == name and columns:
                mine.setdefault(columns, []).append(q)
        if not mine:
            continue
        errors = kway_errors(real[name], syn[name], list(mine))
        ask = spark.createDataFrame([("|".join(cs), q.qtype, q.copies) for cs, qs in mine.items() for q in qs],
                                    "columns string, qtype string, copies int")
        frames.append(errors.join(F.broadcast(ask), "columns").select(
            "qtype", F.concat(F.lit(f"{name}: "), "columns").alias("query"), "error", "copies"))
    asked: dict = {}
    for q in plan:
        fk = next((f for f in schema.foreign_keys if f.label == q.table), None)
        if q.qtype == "cross_table" and fk is not None and _answerable(fk, q, real, syn):
            asked.setdefault(fk, []).append(q)
    for fk, qs in asked.items():
        measures = [q.columns[0] if q.columns else None for q in qs]
        r, s = (cross_values(side[fk.child_table], fk.child_col, side[fk.parent_table], fk.parent_col, measures)
                for side in (real, syn))
        both = r.crossJoin(s.withColumnRenamed("values", "others"))
        frames.append(both.select(F.inline(F.array(*[
            F.struct(F.lit("cross_table").alias("qtype"), F.lit(f"{fk.label} {' '.join(q.columns)}").alias("query"),
                     relative_error(F.col("values")[i], F.col("others")[i]).alias("error"), F.lit(q.copies).alias("copies"))
            for i, q in enumerate(qs)]))))
    if not frames:
        return spark.createDataFrame([], "qtype string, query string, error double, copies int")
    return union_all(frames).filter(F.col("error").isNotNull())


def _answerable(fk, q: PlannedQuery, real: Tables, syn: Tables) -> bool:
    return all(fk.child_table in side and fk.parent_table in side
               and fk.child_col in side[fk.child_table].columns
               and {fk.parent_col, *q.columns} <= set(side[fk.parent_table].columns) for side in (real, syn))


def error_summary(errors: DataFrame, query_types: Sequence[str]) -> DataFrame:
    """(metric, value): mean error per query type and over all; null for a type without answers."""
    w = F.sum(F.col("error") * F.col("copies")) / F.sum("copies")
    rolled = errors.rollup("qtype").agg(F.grouping("qtype").alias("_g"), w.alias("value")).select(
        F.when(F.col("_g") == 1, "avg").otherwise(F.col("qtype")).alias("_t"), "value")
    wanted = F.explode(F.array(*[F.lit(t) for t in [*query_types, "avg"]])).alias("_t")
    return (errors.sparkSession.range(1).select(wanted).join(rolled, "_t", "left")
            .select(F.concat(F.lit("query_error_"), "_t").alias("metric"), "value"))
