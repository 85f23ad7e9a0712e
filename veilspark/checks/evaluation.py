"""Query errors and marginal distances between real tables and their disturbed copies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.fidelity import (PlannedQuery, cross_count, cross_mean, error_summary, key_union, kway_error,
                                  kway_errors, plan_queries, query_errors, relative_error, table_tv, tv_averages,
                                  tv_categorical, tv_numeric)
from ..sources.io import union_all
from .fixtures import LINEITEM_COPY, ORDERS_COPY, lineitem_copy, orders_copy, star_schema, star_tables
from .keys import disturbed
from .registry import check, micros, q6, r6, table

LINE_KEYS = ["l_returnflag", "l_linestatus", "l_linenumber"]


def kway_sql(real, syn, columns):
    ks = ", ".join(columns)
    some = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    return f"""SELECT count(*) AS cells, avg(abs(coalesce(r, 0) / (SELECT count(*) FROM {real} WHERE {some})
    - coalesce(s, 0) / greatest((SELECT count(*) FROM {syn} WHERE {some}), 1))) AS error
  FROM (SELECT {ks}, count(*) AS r FROM {real} WHERE {some} GROUP BY {ks})
  FULL JOIN (SELECT {ks}, count(*) AS s FROM {syn} WHERE {some} GROUP BY {ks}) USING ({ks})"""


def kway_check(columns):
    return f"WITH {LINEITEM_COPY} SELECT cells, {q6('error')} AS error FROM ({kway_sql('lineitem', 'lineitem_copy', columns)})"


def kway(spark, sf_dir, columns):
    return kway_error(table(spark, sf_dir, "lineitem"), lineitem_copy(spark, sf_dir), columns).withColumn("error", r6("error"))


@check(kway_check(LINE_KEYS[:1]))
def kway_error_1(spark, sf_dir):
    return kway(spark, sf_dir, LINE_KEYS[:1])


@check(kway_check(LINE_KEYS[:2]))
def kway_error_2(spark, sf_dir):
    return kway(spark, sf_dir, LINE_KEYS[:2])


@check(kway_check(LINE_KEYS))
def kway_error_3(spark, sf_dir):
    return kway(spark, sf_dir, LINE_KEYS)


ORDER_SETS = [("o_orderpriority",), ("o_orderstatus", "o_orderpriority"), ("o_custkey", "o_orderpriority")]


@check(f"WITH {ORDERS_COPY} " + " UNION ALL ".join(
    f"SELECT '{'|'.join(cs)}' AS columns, cells, {q6('error')} AS error FROM ({kway_sql('orders', 'orders_copy', cs)})" for cs in ORDER_SETS))
def kway_errors_shared(spark, sf_dir):
    """Several column sets from one scan per side, nulls on one side."""
    return kway_errors(table(spark, sf_dir, "orders"), orders_copy(spark, sf_dir), ORDER_SETS).withColumn("error", r6("error"))


@check(f"""WITH {ORDERS_COPY} SELECT o_custkey, o_orderpriority FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority IS NOT NULL
UNION SELECT o_custkey, o_orderpriority FROM orders_copy WHERE o_custkey IS NOT NULL AND o_orderpriority IS NOT NULL""")
def q_key_union(spark, sf_dir):
    return key_union(table(spark, sf_dir, "orders"), orders_copy(spark, sf_dir), ["o_custkey", "o_orderpriority"])


@check(f"""WITH {ORDERS_COPY}, {LINEITEM_COPY}
SELECT 'orders' AS side, count(*) AS value FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'orders_copy', count(*) FROM orders_copy JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'lineitem_copy', count(*) FROM lineitem_copy JOIN part ON l_partkey = p_partkey
UNION ALL SELECT 'many_to_many', count(*) FROM orders_copy JOIN events ON o_custkey = user_id""")
def q_cross_count(spark, sf_dir):
    customer, copy = table(spark, sf_dir, "customer"), orders_copy(spark, sf_dir)
    cases = {"orders": (table(spark, sf_dir, "orders"), "o_custkey", customer, "c_custkey"),
             "orders_copy": (copy, "o_custkey", customer, "c_custkey"),
             "lineitem_copy": (lineitem_copy(spark, sf_dir), "l_partkey", table(spark, sf_dir, "part"), "p_partkey"),
             "many_to_many": (copy, "o_custkey", table(spark, sf_dir, "events"), "user_id")}
    return union_all([cross_count(*c).select(F.lit(n).alias("side"), "value") for n, c in cases.items()])


@check(f"""WITH {ORDERS_COPY}, {LINEITEM_COPY}
SELECT 'acctbal' AS measure, {q6('avg(c_acctbal)')} AS value FROM orders_copy JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'retailprice', {q6('avg(p_retailprice)')} FROM lineitem_copy JOIN part ON l_partkey = p_partkey
UNION ALL SELECT 'text', NULL FROM (SELECT 1)
UNION ALL SELECT 'events', {q6('avg(value)')} FROM orders_copy JOIN events ON o_custkey = user_id
UNION ALL SELECT 'empty', 0.0::DOUBLE""")
def q_cross_mean(spark, sf_dir):
    customer, copy = table(spark, sf_dir, "customer"), orders_copy(spark, sf_dir)
    cases = {"acctbal": (copy, "o_custkey", customer, "c_custkey", "c_acctbal"),
             "retailprice": (lineitem_copy(spark, sf_dir), "l_partkey", table(spark, sf_dir, "part"), "p_partkey", "p_retailprice"),
             "text": (copy, "o_custkey", customer, "c_custkey", "c_name"),
             "events": (copy, "o_custkey", table(spark, sf_dir, "events"), "user_id", "value"),
             "empty": (copy.filter("false"), "o_custkey", customer, "c_custkey", "c_acctbal")}
    return union_all([cross_mean(*c).select(F.lit(n).alias("measure"), r6("value").alias("value")) for n, c in cases.items()])


@check(f"""WITH {ORDERS_COPY}, r AS (SELECT o_orderstatus, sum(o_totalprice) AS v FROM orders GROUP BY 1),
s AS (SELECT o_orderstatus, sum(o_totalprice) AS v FROM orders_copy GROUP BY 1)
SELECT o_orderstatus, {q6('abs(r.v - s.v) / CASE WHEN abs(r.v) > 1e-9 THEN abs(r.v) ELSE 1 END')} AS error,
  {q6('s.v / s.v')} AS from_zero FROM r JOIN s USING (o_orderstatus)""")
def q_relative_error(spark, sf_dir):
    def sums(df, name):
        return df.groupBy("o_orderstatus").agg(F.sum("o_totalprice").alias(name))
    both = sums(table(spark, sf_dir, "orders"), "r").join(sums(orders_copy(spark, sf_dir), "s"), "o_orderstatus")
    return both.select("o_orderstatus", r6(relative_error(F.col("r"), F.col("s"))).alias("error"),
                       r6(relative_error(F.lit(0.0), F.col("s") / F.col("s"))).alias("from_zero"))


def tv_num_sql(real, syn, column, syn_column=None):
    x, y = (micros(c) if c.endswith("date") else c for c in (column, syn_column or column))
    return f"""SELECT 0.5::DOUBLE * sum(abs(coalesce(r / rt, 0) - coalesce(s / st, 0))) AS tv FROM (
    SELECT b, count(*) AS r, sum(count(*)) OVER () AS rt FROM (
      SELECT least(49, floor((x - lo) / (hi - lo) * 50)::INTEGER) AS b FROM (SELECT {x} AS x FROM {real} WHERE {x} IS NOT NULL),
        (SELECT least((SELECT min({x}) FROM {real}), (SELECT min({y}) FROM {syn})) AS lo, greatest((SELECT max({x}) FROM {real}), (SELECT max({y}) FROM {syn})) AS hi)) GROUP BY b)
  FULL JOIN (
    SELECT b, count(*) AS s, sum(count(*)) OVER () AS st FROM (
      SELECT least(49, floor((x - lo) / (hi - lo) * 50)::INTEGER) AS b FROM (SELECT {y} AS x FROM {syn} WHERE {y} IS NOT NULL),
        (SELECT least((SELECT min({x}) FROM {real}), (SELECT min({y}) FROM {syn})) AS lo, greatest((SELECT max({x}) FROM {real}), (SELECT max({y}) FROM {syn})) AS hi)) GROUP BY b) USING (b)"""


def tv_cat_sql(real, syn, column):
    return f"""SELECT 0.5::DOUBLE * sum(abs(coalesce(r / rt, 0) - coalesce(s / st, 0))) AS tv FROM (
    SELECT {column}, count(*) AS r, sum(count(*)) OVER () AS rt FROM {real} WHERE {column} IS NOT NULL GROUP BY 1)
  FULL JOIN (SELECT {column}, count(*) AS s, sum(count(*)) OVER () AS st FROM {syn} WHERE {column} IS NOT NULL GROUP BY 1) USING ({column})"""


LINE_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]


@check(f"WITH {ORDERS_COPY}, {LINEITEM_COPY} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {q6('tv')} AS tv FROM ({tv_num_sql('lineitem', 'lineitem_copy', c)})" for c in LINE_NUMERIC)
    + f" UNION ALL SELECT 'acctbal', {q6('tv')} FROM ({tv_num_sql('customer', 'supplier', 'c_acctbal', 's_acctbal')})")
def q_tv_numeric(spark, sf_dir):
    balances = [table(spark, sf_dir, t).select(F.col(c).alias("acctbal")) for t, c in (("customer", "c_acctbal"), ("supplier", "s_acctbal"))]
    both = tv_numeric(table(spark, sf_dir, "lineitem"), lineitem_copy(spark, sf_dir), LINE_NUMERIC)
    return both.unionByName(tv_numeric(*balances, ["acctbal"])).withColumn("tv", r6("tv"))


ORDER_TEXT = ["o_custkey", "o_orderstatus", "o_orderpriority"]


@check(f"WITH {ORDERS_COPY} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {q6('tv')} AS tv FROM ({tv_cat_sql('orders', 'orders_copy', c)})" for c in ORDER_TEXT))
def q_tv_categorical(spark, sf_dir):
    return tv_categorical(table(spark, sf_dir, "orders"), orders_copy(spark, sf_dir), ORDER_TEXT).withColumn("tv", r6("tv"))


TV_ORDERS = " UNION ALL ".join([tv_cat_sql("orders", "orders_copy", c) for c in ["o_orderkey", *ORDER_TEXT]]
                               + [tv_num_sql("orders", "orders_copy", c) for c in ("o_totalprice", "o_orderdate")])
TV_CUSTOMER = " UNION ALL ".join([tv_cat_sql("customer", "customer", c) for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")]
                                 + [tv_num_sql("customer", "customer", "c_acctbal")])


@check(f"""WITH {ORDERS_COPY}, per AS (SELECT 'orders' AS table_name, avg(tv) AS tv FROM ({TV_ORDERS})
  UNION ALL SELECT 'customer', avg(tv) FROM ({TV_CUSTOMER}))
SELECT table_name, {q6('tv')} AS tv FROM per UNION ALL SELECT '*', {q6('avg(tv)')} FROM per""")
def q_tv_table_avg(spark, sf_dir):
    schema = star_schema("orders", "customer")
    real = star_tables(spark, sf_dir, "orders", "customer")
    syn = real | {"orders": orders_copy(spark, sf_dir)}
    report = union_all([table_tv(real[n], syn[n], schema.tables[n]).select(F.lit(n).alias("table_name"), "column_name", "tv")
                        for n in schema.tables])
    return tv_averages(report).withColumn("tv", r6("tv"))


PLAN = [PlannedQuery("1way", "lineitem", ("l_returnflag",), 3), PlannedQuery("1way", "orders", ("o_orderpriority",), 1),
        PlannedQuery("2way", "lineitem", ("l_linenumber", "l_returnflag"), 2),
        PlannedQuery("cross_table", "orders.o_custkey->customer.c_custkey", ("c_acctbal",), 2),
        PlannedQuery("cross_table", "customer.c_nationkey->nation.n_nationkey", (), 1)]
TYPES = ["1way", "2way", "3way", "cross_table"]


@check(f"""WITH {ORDERS_COPY}, {LINEITEM_COPY}, e AS (
  SELECT '1way' AS qtype, 3 AS w, error FROM ({kway_sql('lineitem', 'lineitem_copy', ['l_returnflag'])})
  UNION ALL SELECT '1way', 1, error FROM ({kway_sql('orders', 'orders_copy', ['o_orderpriority'])})
  UNION ALL SELECT '2way', 2, error FROM ({kway_sql('lineitem', 'lineitem_copy', ['l_linenumber', 'l_returnflag'])})
  UNION ALL SELECT 'cross_table', 2, abs(r - s) / abs(r) FROM (SELECT avg(c_acctbal) AS r FROM orders JOIN customer ON o_custkey = c_custkey),
    (SELECT avg(c_acctbal) AS s FROM orders_copy JOIN customer ON o_custkey = c_custkey)
  UNION ALL SELECT 'cross_table', 1, 0.0::DOUBLE)
SELECT 'query_error_' || t AS metric, {q6('sum(error * w) / sum(w)')} AS value FROM (VALUES ('1way'), ('2way'), ('3way'), ('cross_table'), ('avg')) v(t)
LEFT JOIN e ON t = qtype OR t = 'avg' GROUP BY t""")
def query_error_summary(spark, sf_dir):
    errors = query_errors(star_tables(spark, sf_dir), disturbed(spark, sf_dir), star_schema(), PLAN)
    return error_summary(errors, TYPES).withColumn("value", r6("value"))


DRAWN = plan_queries(star_schema(), 40, TYPES, 42)
COPIES = {"orders": "orders_copy", "lineitem": "lineitem_copy"}


def planned_sql(q: PlannedQuery) -> str:
    """One drawn query as SQL: its error between the given tables and their disturbed copies."""
    if q.qtype != "cross_table":
        name, error = f"{q.table}: {'|'.join(q.columns)}", f"SELECT error FROM ({kway_sql(q.table, COPIES.get(q.table, q.table), q.columns)})"
    else:
        fk = next(f for f in star_schema().foreign_keys if f.label == q.table)
        name = f"{fk.label} {' '.join(q.columns)}"
        column = q.columns[0] if q.columns else ""
        measure = f"avg({f'{micros(column)} / 1000000' if column.endswith('date') else column})" if column else "count(*)"
        r, s = (f"(SELECT {measure}::DOUBLE AS {v} FROM {of.get(fk.child_table, fk.child_table)} JOIN {of.get(fk.parent_table, fk.parent_table)} "
                f"ON {fk.child_col} = {fk.parent_col})" for v, of in (("r", {}), ("s", COPIES)))
        error = f"SELECT abs(r - s) / CASE WHEN abs(r) > 1e-9 THEN abs(r) ELSE 1 END AS error FROM {r}, {s}"
    return f"SELECT '{q.qtype}' AS qtype, '{name}' AS query, {q6('error')} AS error, {q.copies} AS copies FROM ({error})"


@check(f"WITH {ORDERS_COPY}, {LINEITEM_COPY} " + " UNION ALL ".join(planned_sql(q) for q in DRAWN))
def query_plan(spark, sf_dir):
    """A random evaluation workload and the error of each of its distinct queries."""
    errors = query_errors(star_tables(spark, sf_dir), disturbed(spark, sf_dir), star_schema(), DRAWN)
    return errors.withColumn("error", r6("error"))
