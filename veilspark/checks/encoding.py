"""Bounds, bins, dictionaries, whole-table codes and decoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.encode import (bin_code, category_codes, category_counts, fit_codec, numeric_bounds)
from ..sources.io import union_all
from .fixtures import CAT, NUM, ORDERS_COPY, orders_copy
from .registry import bin_sql, check, micros, q6, r6, table

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
BINNED = ["l_quantity", "l_extendedprice", "l_discount"]


def num(c):
    return micros(c) if c.endswith("date") else c


@check(" UNION ALL ".join(f"""SELECT '{c}' AS column_name, {q6(f'min({num(c)}) - 1e-9::DOUBLE')} AS lo,
{q6(f'max({num(c)}) + 1e-9::DOUBLE')} AS hi FROM lineitem""" for c in NUMERIC))
def q_numeric_bounds(spark, sf_dir):
    return numeric_bounds(table(spark, sf_dir, "lineitem"), NUMERIC).select("column_name", r6("lo").alias("lo"), r6("hi").alias("hi"))


def bounds_cte(source: str, columns: list[str], name: str = "b") -> str:
    return f"{name} AS (SELECT " + ", ".join(
        f"min({num(c)}) - 1e-9::DOUBLE AS {c}_lo, max({num(c)}) + 1e-9::DOUBLE AS {c}_hi" for c in columns) + f" FROM {source})"


def binned(c: str, bins: int) -> str:
    return bin_sql(num(c), f"{c}_lo", f"{c}_hi", bins)


@check(f"""WITH {bounds_cte('lineitem', BINNED)} SELECT l_orderkey, l_linenumber,
{", ".join(f"{binned(c, n)} AS {c}_{n}" for c in BINNED for n in (16, 32))} FROM lineitem, b""")
def bin_equal_width(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    ends = {r["column_name"]: r for r in numeric_bounds(lines, BINNED).collect()}
    return lines.select("l_orderkey", "l_linenumber", *[
        bin_code(F.col(c), ends[c]["lo"], ends[c]["hi"], n).alias(f"{c}_{n}") for c in BINNED for n in (16, 32)])


def dictionary_sql(columns, source):
    return " UNION ALL ".join(f"""SELECT '{c}' AS column_name, {c} AS value,
    (row_number() OVER (ORDER BY {c}) - 1)::INTEGER AS code, count(*) AS cnt FROM {source} GROUP BY {c}""" for c in columns)


@check(dictionary_sql(["o_orderpriority", "o_orderstatus"], "orders"))
def q_category_codes(spark, sf_dir):
    counts = category_counts(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"])
    return category_codes(counts, 32).drop("_many")


def topk_sql(column, source, bins):
    return f"""SELECT value, (r - 1)::INTEGER AS code, cnt FROM (
  SELECT {column} AS value, count(*) AS cnt, row_number() OVER (ORDER BY count(*) DESC, {column}) AS r
  FROM {source} WHERE {column} IS NOT NULL GROUP BY {column}) WHERE r <= {bins - 1}"""


@check(f"SELECT 'p_name' AS column_name, value, code, cnt FROM ({topk_sql('p_name', 'part', 32)})")
def category_topk_other(spark, sf_dir):
    return category_codes(category_counts(table(spark, sf_dir, "part"), ["p_name"]), 32).drop("_many")


ROLES = {"o_totalprice": NUM, "o_orderdate": NUM, "o_orderpriority": CAT, "o_orderstatus": CAT, "o_custkey": CAT}
PRIO = "coalesce(pd.code, {missing})"
CAPPED = f"""cd AS (SELECT value, (r - 1)::INTEGER AS code FROM (
  SELECT o_custkey AS value, row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS r FROM orders_copy
  WHERE o_custkey IS NOT NULL GROUP BY o_custkey) WHERE r <= 31)"""
DICTS = f"""pd AS ({dictionary_sql(['o_orderpriority'], '(SELECT * FROM orders_copy WHERE o_orderpriority IS NOT NULL)')}),
sd AS ({dictionary_sql(['o_orderstatus'], 'orders_copy')}), {CAPPED}"""


@check(f"""WITH {ORDERS_COPY}, {bounds_cte('orders_copy', ['o_totalprice'])}, {DICTS}
SELECT policy, o_orderkey,
  coalesce({binned('o_totalprice', 32)}, CASE policy WHEN 'compat' THEN 31 ELSE 32 END)::INTEGER AS o_totalprice,
  coalesce(pd.code, CASE policy WHEN 'compat' THEN 0 ELSE 5 END)::INTEGER AS o_orderpriority,
  CASE WHEN o_custkey IS NULL THEN CASE policy WHEN 'compat' THEN 31 ELSE 32 END ELSE coalesce(cd.code, 31) END::INTEGER AS o_custkey
FROM orders_copy LEFT JOIN pd ON pd.value = o_orderpriority LEFT JOIN cd ON cd.value = o_custkey, b,
  (VALUES ('compat'), ('category')) p(policy)""")
def encode_nulls(spark, sf_dir):
    orders = orders_copy(spark, sf_dir)
    columns = ["o_totalprice", "o_orderpriority", "o_custkey"]
    return union_all([fit_codec(orders, ROLES, columns, 32, policy).encode(orders, ["o_orderkey"])
                     .select(F.lit(policy).alias("policy"), "o_orderkey", *columns) for policy in ("compat", "category")])


@check(f"""WITH {bounds_cte('orders', ['o_totalprice', 'o_orderdate'])},
{DICTS.replace('orders_copy', 'orders')}
SELECT o_orderkey, {binned('o_totalprice', 32)} AS o_totalprice, {binned('o_orderdate', 32)} AS o_orderdate,
  pd.code AS o_orderpriority, sd.code AS o_orderstatus, coalesce(cd.code, 31)::INTEGER AS o_custkey
FROM orders LEFT JOIN pd ON pd.value = o_orderpriority LEFT JOIN sd ON sd.value = o_orderstatus
  LEFT JOIN cd ON cd.value = o_custkey, b""")
def encode_table(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return fit_codec(orders, ROLES, list(ROLES), 32).encode(orders, ["o_orderkey"])


@check(f"""WITH {bounds_cte('orders', ['o_totalprice', 'o_orderdate'])}
SELECT o_orderkey, {q6(f"o_totalprice_lo + ({binned('o_totalprice', 32)} + 0.5::DOUBLE) * ((o_totalprice_hi - o_totalprice_lo) / 32)")} AS o_totalprice,
  make_timestamp((o_orderdate_lo + ({binned('o_orderdate', 32)} + 0.5::DOUBLE) * ((o_orderdate_hi - o_orderdate_lo) / 32))::BIGINT) AS o_orderdate
FROM orders, b""")
def decode_numeric(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    codec = fit_codec(orders, ROLES, ["o_totalprice", "o_orderdate"], 32)
    back = codec.decode(codec.encode(orders, ["o_orderkey"]), ["o_orderkey"])
    return back.select("o_orderkey", r6("o_totalprice").alias("o_totalprice"), "o_orderdate")


@check(f"""WITH n AS ({topk_sql('p_name', 'part', 32)})
SELECT p_partkey, coalesce(n.value, '__OTHER__') AS p_name, p_brand FROM part LEFT JOIN n ON n.value = p_name""")
def decode_categorical(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    codec = fit_codec(part, {}, ["p_name", "p_brand"], 32)
    return codec.decode(codec.encode(part, ["p_partkey"]), ["p_partkey"])
