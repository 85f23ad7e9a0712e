"""Declarative table generator on ``spark.range``.

A column is described by a small value object; its expression depends only on the row's key and
the seed, so tables of any size are produced in parallel without a shuffle, and a foreign key is
drawn from the parent's dense key range without reading the parent.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import (Draws, choice_draw, index_draw, integer_draw, real_draw,
                               weighted_choice_draw)
from ..functions.scaling import row_ids
from ..schema import CATEGORICAL, NUMERICAL, ForeignKey, RelationalSchema, Table

# expression of (row key 1..n, draw function for this column)
Maker = Callable[[Column, Callable[..., Column]], Column]


@dataclass(frozen=True)
class ColumnSpec:
    make: Maker | None
    role: str = CATEGORICAL
    is_key: bool = False
    parent: tuple[str, str] | None = None
    price_of: tuple[str, str, str] | None = None
    rule: tuple = ()
    """The same column as plain values, kind first, for readers other than Spark."""


def key(prefix: str = "") -> ColumnSpec:
    """Primary key 1..n, as text if a prefix is given."""
    make = (lambda i, u: F.concat(F.lit(prefix), i.cast("string"))) if prefix else (lambda i, u: i)
    return ColumnSpec(make, is_key=True, rule=("key", prefix))


def label(prefix: str, width: int = 0) -> ColumnSpec:
    """Text made of a prefix and the row key, zero padded to ``width``."""
    return ColumnSpec(lambda i, u: F.format_string(prefix + (f"%0{width}d" if width else "%d"), i),
                      rule=("label", prefix, width))


def listed(values: list[str]) -> ColumnSpec:
    """The i-th value of a list, starting again when it is used up."""
    return ColumnSpec(lambda i, u: F.element_at(F.array(*[F.lit(v) for v in values]),
                                                (F.pmod(i - 1, len(values)) + 1).cast("int")),
                      rule=("listed", values))


def constant(value) -> ColumnSpec:
    return ColumnSpec(lambda i, u: F.lit(value), rule=("constant", value))


def choice(values: list, weights: list[float] | None = None, role: str = CATEGORICAL) -> ColumnSpec:
    if weights is None:
        return ColumnSpec(lambda i, u: choice_draw(u(), values), role, rule=("choice", values))
    return ColumnSpec(lambda i, u: weighted_choice_draw(u(), values, weights), role, rule=("weighted", values, weights))


def integer(lo: int, hi: int, role: str = NUMERICAL) -> ColumnSpec:
    return ColumnSpec(lambda i, u: integer_draw(u(), lo, hi), role, rule=("integer", lo, hi))


def real(lo: float, hi: float, digits: int) -> ColumnSpec:
    return ColumnSpec(lambda i, u: real_draw(u(), lo, hi, digits), NUMERICAL, rule=("real", lo, hi, digits))


def millions(lo: float, hi: float) -> ColumnSpec:
    return ColumnSpec(lambda i, u: F.round(real_draw(u(), lo, hi, 6) * 1e6, 0), NUMERICAL, rule=("millions", lo, hi))


def phone() -> ColumnSpec:
    """Four random number groups joined by dashes."""
    return ColumnSpec(lambda i, u: phone_draw(u), rule=("phone", PHONE_GROUPS))


# Ranges of the number groups.
PHONE_GROUPS = ((10, 99), (100, 999), (100, 999), (1000, 9999))


def phone_draw(u: Callable[..., Column]) -> Column:
    return F.concat_ws("-", *[integer_draw(u(g), lo, hi).cast("string")
                              for g, (lo, hi) in enumerate(PHONE_GROUPS)])


def ref(table: str, column: str) -> ColumnSpec:
    """Foreign key: uniform draw from the parent's keys."""
    return ColumnSpec(None, parent=(table, column))


def price_times(units: str, table: str, column: str) -> ColumnSpec:
    """Units of the row times the referenced parent's price."""
    return ColumnSpec(None, NUMERICAL, price_of=(units, table, column))


@dataclass(frozen=True)
class TableSpec:
    rows: int
    columns: dict[str, ColumnSpec]


Spec = dict[str, TableSpec]


def spec_schema(spec: Spec) -> RelationalSchema:
    """Relational schema that a spec implies: roles, primary keys and foreign keys."""
    tables = {name: Table(name, tuple(t.columns), {c: s.role for c, s in t.columns.items()},
                          next((c for c, s in t.columns.items() if s.is_key), None)) for name, t in spec.items()}
    return RelationalSchema(tables, tuple(ForeignKey(name, s.parent[0], column, s.parent[1])
                                          for name, t in spec.items() for column, s in t.columns.items() if s.parent))


def scaled(spec: Spec, factor: float) -> Spec:
    """The same tables with row counts multiplied (rounded up)."""
    return {n: replace(t, rows=-int(-t.rows * factor // 1)) for n, t in spec.items()}


def generate_table(spark: SparkSession, spec: Spec, name: str, draws: Draws,
                   tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """One table of a spec; ``tables`` is only needed for columns priced by a parent row."""
    table = spec[name]
    i = F.col("_id")
    df = row_ids(spark, table.rows, "_id")
    exprs = []
    for column, s in table.columns.items():
        def u(*extra, _column=column):
            return draws.uniform(name, _column, i, *extra)
        if s.parent:
            parent = spec[s.parent[0]]
            drawn = index_draw(u(), parent.rows) + 1
            exprs.append(parent.columns[s.parent[1]].make(drawn, u).alias(column))
        elif s.make:
            exprs.append(s.make(i, u).alias(column))
    out = df.select("_id", *exprs)
    for column, s in table.columns.items():
        if s.price_of:
            units, parent, price = s.price_of
            link = next(c for c, p in table.columns.items() if p.parent and p.parent[0] == parent)
            out = lookup_product(out, (tables or {})[parent], link, spec[name].columns[link].parent[1],
                                 units, price, column)
    return out.select(*table.columns)


def lookup_product(df: DataFrame, parent: DataFrame, child_col: str, parent_col: str,
                   units: str, price: str, name: str) -> DataFrame:
    """``units`` times the ``price`` of the parent row the child refers to, rounded to cents."""
    side = parent.select(F.col(parent_col).alias("_key"), F.col(price).alias("_price"))
    return (df.join(side, F.col(child_col) == F.col("_key"), "left")
            .withColumn(name, F.round(F.col(units) * F.col("_price"), 2)).drop("_key", "_price"))


def generate_tables(spark: SparkSession, spec: Spec, draws: Draws = Draws()) -> dict[str, DataFrame]:
    tables: dict[str, DataFrame] = {}
    for name in spec_schema(spec).topological_order():
        tables[name] = generate_table(spark, spec, name, draws, tables)
    return {n: tables[n] for n in spec}


def star_spec(num_dimension_tables: int = 4, dim_rows: int = 100, fact_rows: int = 5000,
              num_dim_attrs: int = 3, num_fact_measures: int = 2, seed: int = 42) -> Spec:
    """Star schema: dimensions with attributes of random role, and one fact that refers to all."""
    import random
    roles = random.Random(seed)
    spec: Spec = {}
    for d in range(num_dimension_tables):
        columns = {f"dim_{d}_id": key()}
        for a in range(num_dim_attrs):
            columns[f"dim_{d}_attr_{a}"] = roles.choice(
                [choice([f"cat_{v}" for v in range(10)]), real(0, 1000, 2)])
        spec[f"dim_{d}"] = TableSpec(dim_rows, columns)
    fact = {f"dim_{d}_id": ref(f"dim_{d}", f"dim_{d}_id") for d in range(num_dimension_tables)}
    fact |= {f"measure_{m}": real(0, 10000, 2) for m in range(num_fact_measures)}
    return spec | {"fact": TableSpec(fact_rows, fact)}
