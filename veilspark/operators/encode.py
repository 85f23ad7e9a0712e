"""Columns to integer codes and back.

A fitted codec holds at most ``num_bins`` values per column, so it lives on the driver and turns
into literals: encoding and decoding whole tables are single projections without joins.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.draws import Draws
from ..schema import NUMERICAL

OTHER = "__OTHER__"
PAD = 1e-9


def as_number(df: DataFrame, column: str) -> Column:
    """The column as a double; times become microseconds since the epoch."""
    dtype = df.schema[column].dataType
    c = F.col(column)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        c = F.unix_micros(c.cast("timestamp"))
    elif isinstance(dtype, T.DateType):
        c = F.datediff(c, F.lit("1970-01-01").cast("date"))
    return c.cast("double")


def from_number(value: Column, dtype: T.DataType) -> Column:
    """A decoded double back in the type of the original column."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.timestamp_micros(value.cast("bigint")).cast(dtype)
    if isinstance(dtype, T.DateType):
        return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(value).cast("int"))
    return value


def numeric_bounds(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, lo, hi): padded range of every column, all in one pass; NaN and null ignored."""
    packed = df.agg(*_bound_columns(df, columns))
    return packed.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), (F.col(f"min_{i}") - PAD).alias("lo"),
                 (F.col(f"max_{i}") + PAD).alias("hi")) for i, c in enumerate(columns)])))


def _bound_columns(df: DataFrame, columns: list[str]) -> list[Column]:
    values = [F.nanvl(as_number(df, c), F.lit(None).cast("double")) for c in columns]
    return [f(v).alias(f"{f.__name__}_{i}") for i, v in enumerate(values) for f in (F.min, F.max)]


def bin_code(x: Column, lo, hi, num_bins: int) -> Column:
    """Equal-width bin 0..num_bins-1, clamped; NaN goes to the top bin, null stays null."""
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lo, hi))
    raw = F.floor((x - lo) / (hi - lo) * num_bins)
    return (F.when(F.isnan(x), num_bins - 1)
            .when(x.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(num_bins - 1), raw))).cast("int"))


def bin_midpoint(code: Column, lo, hi, num_bins: int) -> Column:
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lo, hi))
    return lo + (code + 0.5) * (hi - lo) / num_bins


def category_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value, sort_key, cnt) of non-null values of several columns in one pass."""
    def sort_key(c):
        return (F.col(c).cast("double") if isinstance(df.schema[c].dataType, T.NumericType)
                else F.lit(None).cast("double"))
    pairs = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"),
                 sort_key(c).alias("sort_key")) for c in columns])))
    return (pairs.filter(F.col("value").isNotNull())
            .groupBy("column_name", "value", "sort_key").agg(F.count(F.lit(1)).alias("cnt")))


def category_codes(counts: DataFrame, num_bins: int) -> DataFrame:
    """(column_name, value, code, cnt): the dictionary of each column.

    Up to ``num_bins`` values: codes in ascending value order.  More: the ``num_bins - 1`` most
    frequent values by falling count, everything else is the ``__OTHER__`` code.  The first
    window is a top-k, which Spark prunes before the shuffle; later ones see at most
    ``num_bins + 1`` rows per column.
    """
    by_count = Window.partitionBy("column_name").orderBy(F.desc("cnt"), "sort_key", "value")
    by_value = Window.partitionBy("column_name").orderBy("sort_key", "value")
    top = counts.withColumn("_rank", F.row_number().over(by_count)).filter(F.col("_rank") <= num_bins + 1)
    sized = top.withColumn("_many", F.count(F.lit(1)).over(Window.partitionBy("column_name")) > num_bins)
    coded = (sized.filter(~F.col("_many") | (F.col("_rank") < num_bins))
             .withColumn("code", F.when(F.col("_many"), F.col("_rank") - 1)
                         .otherwise(F.row_number().over(by_value) - 1).cast("int")))
    return coded.select("column_name", "value", "code", "cnt", "_many")


@dataclass
class ColumnCodec:
    """How one column is coded; ``dtype`` is the type to return to."""

    name: str
    dtype: T.DataType
    lo: float | None = None
    hi: float | None = None
    values: list[str] = field(default_factory=list)
    capped: bool = False
    null_code: bool = False
    num_bins: int = 32
    declared: bool = False

    @property
    def numeric(self) -> bool:
        return self.lo is not None

    @property
    def size(self) -> int:
        """Number of codes, the null code included."""
        base = self.num_bins if self.numeric else max(len(self.values) + self.capped, 1)
        return base + self.null_code

    def encode(self, df: DataFrame) -> Column:
        top = self.size - 1
        if self.numeric:
            code = bin_code(as_number(df, self.name), self.lo, self.hi, self.num_bins)
            missing = top  # null joins NaN in the top bin, or has a code of its own
        else:
            text = F.col(self.name).cast("string")
            other = F.lit(len(self.values) if self.capped else top if self.declared and self.null_code else 0)
            known = F.create_map(*[x for i, v in enumerate(self.values) for x in (F.lit(v), F.lit(i))]) if self.values else None
            code = F.when(text.isNotNull(), F.coalesce(known[text], other) if self.values else other)
            missing = top if self.null_code or self.capped else 0
        return F.coalesce(code, F.lit(missing)).cast("int")

    def decode(self, code: Column, u: Column | None = None) -> Column:
        """Value of a code: bin midpoint, or a place inside the bin if a uniform draw is given."""
        if self.numeric:
            inside = 0.5 if u is None else u
            safe = F.least(F.greatest(code, F.lit(0)), F.lit(self.num_bins - 1))
            value = from_number(self.lo + (safe + inside) * ((self.hi - self.lo) / self.num_bins), self.dtype)
        else:
            labels = self.values + ([OTHER] if self.capped else [])
            if not labels:
                return F.lit(None).cast(self.dtype)
            safe = F.least(F.greatest(code, F.lit(0)), F.lit(len(labels) - 1))
            value = F.element_at(F.array(*[F.lit(v) for v in labels]), safe + 1)
            if not self.capped:  # the other-category only exists as text
                value = value.cast(self.dtype)
        if self.null_code:
            value = F.when(code < self.size - 1, value)
        return value


@dataclass
class Codec:
    columns: dict[str, ColumnCodec]

    @property
    def sizes(self) -> dict[str, int]:
        return {n: c.size for n, c in self.columns.items()}

    def encode(self, df: DataFrame, keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
        return df.select(*keep, *[c.encode(df).alias(n) for n, c in self.columns.items()])

    def decode(self, codes: DataFrame, keep: list[str] | tuple[str, ...] = (),
               draws: Draws | None = None, rid: str = "_rid", order: list[str] | None = None,
               scope: str = "") -> DataFrame:
        """All coded columns back to values; uniform inside the bins if ``draws`` is given."""
        exprs = []
        for n in order or list(self.columns):
            c = self.columns[n]
            u = draws.uniform("decode", scope, n, F.col(rid)) if draws and c.numeric else None
            exprs.append(c.decode(F.col(n), u).alias(n))
        return codes.select(*keep, *exprs)


def fit_codec(df: DataFrame, dtypes: Mapping[str, str], columns: list[str] | None = None,
              num_bins: int = 32, null_policy: str = "category",
              bounds: Mapping[str, tuple[float, float]] | None = None,
              domains: Mapping[str, list[str]] | None = None,
              nullable: Collection[str] | None = None) -> Codec:
    """Learn bounds and dictionaries; at most ``num_bins`` values per column reach the driver.

    ``bounds`` and ``domains`` give public ranges and value lists for columns whose own range
    must not be looked at, ``nullable`` the columns that may hold nulls; columns given by all of
    them are not read.  Numbers outside public bounds go to the end bins, values outside a public
    domain count as null.  ``null_policy``: ``category`` gives nulls a code of their own,
    ``compat`` puts them in the top bin, the first category or the other-category, as do nulls in
    columns that are not declared nullable.
    """
    if null_policy not in ("category", "compat"):
        raise ValueError(f"unknown null policy {null_policy!r}")
    columns = columns or df.columns
    bounds, domains = dict(bounds or {}), {c: list(v) for c, v in (domains or {}).items()}
    declared = set(bounds) | set(domains)
    numeric = [c for c in columns if dtypes.get(c) == NUMERICAL]
    text = [c for c in columns if c not in numeric]
    seek = [c for c in numeric if c not in bounds]
    ends = _bound_columns(df, seek)
    flags = [F.max(F.col(c).isNull()).alias(f"null_{i}") for i, c in enumerate(columns)] if nullable is None else []
    facts = df.agg(*ends, *flags).first() if ends or flags else None
    nulls = set(nullable) if nullable is not None else {c for i, c in enumerate(columns) if facts[f"null_{i}"]}
    if null_policy != "category":
        nulls = set()
    for i, c in enumerate(seek):
        lo, hi = facts[f"min_{i}"], facts[f"max_{i}"]
        bounds[c] = (lo - PAD, hi + PAD) if lo is not None else (0.0, 1.0)
    capped: set[str] = set()
    seek = [c for c in text if c not in domains]
    if seek:
        for r in category_codes(category_counts(df, seek), num_bins).orderBy("column_name", "code").collect():
            domains.setdefault(r["column_name"], []).append(r["value"])
            if r["_many"]:
                capped.add(r["column_name"])
    out = {}
    for c in columns:
        lo, hi = bounds.get(c, (None, None)) if c in numeric else (None, None)
        out[c] = ColumnCodec(c, df.schema[c].dataType, lo, hi, domains.get(c, []) if c in text else [],
                             c in capped, c in nulls, num_bins, c in declared)
    return Codec(out)
