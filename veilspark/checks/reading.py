"""Scans, alignment, sizes, sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.scaling import checkpoint_dir
from ..schema import Table
from ..sources.io import align_columns, flatten_struct, load_tables, table_sizes, union_all, write_results
from .fixtures import METADATA, NUM, STAR_TABLES, star_schema, star_tables
from .registry import check, table

ALL_TABLES = [*STAR_TABLES, "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def sizes_sql(names):
    return " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in names)


@check(sizes_sql(ALL_TABLES))
def scan_all_tables(spark, sf_dir):
    return table_sizes({n: table(spark, sf_dir, n) for n in ALL_TABLES})


@check("SELECT l_quantity, l_orderkey, l_returnflag FROM lineitem")
def q_align_columns(spark, sf_dir):
    declared = Table("lineitem", ("l_quantity", "not_there", "l_orderkey", "l_returnflag"), {})
    return align_columns(table(spark, sf_dir, "lineitem"), declared.attributes)


@check(sizes_sql(STAR_TABLES))
def q_table_sizes(spark, sf_dir):
    return table_sizes(star_tables(spark, sf_dir))


@check("SELECT f.fmt, o.* FROM orders o, (VALUES ('csv'), ('json'), ('parquet')) f(fmt)")
def sink_roundtrip(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    base = f"{checkpoint_dir(spark)}/sink-{uuid.uuid4().hex}"
    back = []
    for fmt in ("csv", "json", "parquet"):
        write_results(orders, f"{base}/{fmt}", fmt)
        reader = spark.read.schema(orders.schema).format(fmt)
        reader = reader.option("header", True) if fmt == "csv" else reader
        back.append(reader.load(f"{base}/{fmt}").select(F.lit(fmt).alias("fmt"), "*"))
    return union_all(back)


@check("""SELECT o_orderkey AS "order.key", o_orderstatus AS "order.detail.status",
                 o_orderpriority AS "order.detail.priority", o_totalprice AS price FROM orders""")
def q_flatten_struct(spark, sf_dir):
    nested = table(spark, sf_dir, "orders").select(
        F.struct(F.col("o_orderkey").alias("key"),
                 F.struct(F.col("o_orderstatus").alias("status"),
                          F.col("o_orderpriority").alias("priority")).alias("detail")).alias("order"),
        F.col("o_totalprice").alias("price"))
    return flatten_struct(nested)


WHOLE = {"c_nationkey", "s_nationkey", "p_size", "l_linenumber"}
TIMES = {"o_orderdate", "l_shipdate"}


def _kinds(name):
    """How each column of a table is written down for comparison."""
    for column, role in METADATA["tables"][name]["dtypes"].items():
        if column in TIMES:
            yield column, "time"
        elif column in WHOLE or column.endswith("key"):
            yield column, "whole"
        else:
            yield column, "real" if role == NUM else "text"


def values_sql() -> str:
    forms = {"time": "epoch_us({})::VARCHAR", "whole": "{}::BIGINT::VARCHAR", "real": "round({} * 10000)::BIGINT::VARCHAR", "text": "{}"}
    return " UNION ALL ".join(f"SELECT '{n}' AS table_name, concat_ws('|', " + ", ".join(
        f"coalesce({forms[kind].format(c)}, '-')" for c, kind in _kinds(n)) + f") AS row_values FROM {n}" for n in STAR_TABLES)


@check(values_sql())
def csv_dataset_scan(spark, sf_dir):
    """All values of all tables, written as a CSV dataset and loaded again with inferred types."""
    base = f"{checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    for name, df in star_tables(spark, sf_dir).items():
        write_results(df, f"{base}/{name}.csv", "csv")
    forms = {"time": lambda c: F.unix_micros(c).cast("string"), "whole": lambda c: c.cast("bigint").cast("string"),
             "real": lambda c: F.round(c * 10000).cast("bigint").cast("string"), "text": lambda c: c}
    found = load_tables(spark, star_schema(), base)
    return union_all([found[n].select(F.lit(n).alias("table_name"), F.concat_ws("|", *[
        F.coalesce(forms[kind](F.col(c)), F.lit("-")) for c, kind in _kinds(n)]).alias("row_values")) for n in STAR_TABLES])
