"""Registration of check queries, and text helpers to state the same draws in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def check(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name (without a leading ``q_``, which keeps it apart
    from the operator of that name), with its SQL twin if there is one."""
    def add(fn: Query) -> Query:
        name = fn.__name__.removeprefix("q_")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: Column | str) -> Column:
    """Six digits, and no negative zero."""
    return F.round(x, 6) + F.lit(0.0)


def q6(sql: str) -> str:
    return f"(round({sql}, 6) + 0.0::DOUBLE)"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def u_sql(*parts: str, seed: str = "42") -> str:
    """The MD5 draw for SQL key parts (constants must be quoted)."""
    key = f"concat_ws(':', {quoted(seed)}, {', '.join(parts)})"
    return f"((('0x' || substr(md5({key}), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


def laplace_sql(u: str, scale: str) -> str:
    return (f"(-({scale}) * sign({u} - 0.5::DOUBLE) * ln(1.0::DOUBLE - 2.0::DOUBLE * abs({u} - 0.5::DOUBLE)))")


def index_sql(u: str, size: str) -> str:
    return f"least(floor({u} * {size})::BIGINT, ({size})::BIGINT - 1)"


def bin_sql(x: str, lo: str, hi: str, bins: int) -> str:
    code = f"greatest(0, least({bins - 1}, floor(({x} - {lo}) / ({hi} - {lo}) * {bins})::INTEGER))"
    return f"(CASE WHEN {x} IS NOT NULL THEN {code} END)"


def micros(column: str) -> str:
    return f"epoch_us({column})::DOUBLE"
