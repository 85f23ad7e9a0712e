"""Foreign-key reports and repairs on disturbed copies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.assign import number_batches
from ..operators.integrity import (fk_metrics, fk_report, fk_report_all, fk_violations, overall_consistency, repair_all,
                                   repair_foreign_key)
from ..operators.nearest import nearest_parents, pairwise_distance
from ..sources.io import union_all
from .fixtures import (DRAWS, LINEITEM_COPY, ORDERS_COPY, intervals_sql, lineitem_copy, orders_copy, position_sql,
                       star_schema, star_tables)
from .registry import check, q6, quoted, r6, table, u_sql

VALID_CUSTOMER = "o_custkey IN (SELECT c_custkey FROM customer)"


@check(f"WITH {ORDERS_COPY} SELECT o_orderkey, o_custkey::VARCHAR AS o_custkey FROM orders_copy WHERE o_custkey IS NULL OR NOT {VALID_CUSTOMER}")
def q_fk_violations(spark, sf_dir):
    return fk_violations(orders_copy(spark, sf_dir), "o_custkey", table(spark, sf_dir, "customer"), "c_custkey").select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"))


def report_sql(label, child, child_col, parent, parent_col):
    return f"""SELECT '{label}' AS fk, count(*) AS total_rows,
  count(*) FILTER ({child_col} IS NULL OR {child_col} NOT IN (SELECT {parent_col} FROM {parent} WHERE {parent_col} IS NOT NULL)) AS violations
  FROM {child}"""


def with_rate(body):
    return f"SELECT fk, total_rows, violations, {q6('violations / greatest(total_rows, 1)')} AS violation_rate FROM ({body})"


@check(f"""WITH {ORDERS_COPY} {with_rate(report_sql('orders', 'orders_copy', 'o_custkey', 'customer', 'c_custkey')
  + " UNION ALL SELECT 'no parent', 0, 0 UNION ALL SELECT 'no column', count(*), count(*) FROM orders_copy")}""")
def q_fk_report(spark, sf_dir):
    orders, customer = orders_copy(spark, sf_dir), table(spark, sf_dir, "customer")
    return union_all([fk_report(orders, "o_custkey", customer, "c_custkey", "orders"),
                      fk_report(orders, "o_custkey", None, "c_custkey", "no parent"),
                      fk_report(orders, "no_such", customer, "c_custkey", "no column")]).withColumn(
                          "violation_rate", r6("violation_rate"))


def disturbed(spark, sf_dir):
    tables = star_tables(spark, sf_dir)
    return tables | {"orders": orders_copy(spark, sf_dir), "lineitem": lineitem_copy(spark, sf_dir)}


COPIES = {"orders": "orders_copy", "lineitem": "lineitem_copy"}
ALL_REPORTS = " UNION ALL ".join(
    report_sql(fk.label, COPIES.get(fk.child_table, fk.child_table), fk.child_col,
               COPIES.get(fk.parent_table, fk.parent_table), fk.parent_col) for fk in star_schema().foreign_keys)


@check(f"WITH {ORDERS_COPY}, {LINEITEM_COPY} {with_rate(ALL_REPORTS)}")
def q_fk_report_all(spark, sf_dir):
    return fk_report_all(star_schema(), disturbed(spark, sf_dir)).withColumn("violation_rate", r6("violation_rate"))


@check(f"""WITH {ORDERS_COPY}, {LINEITEM_COPY}
SELECT {q6('sum(total_rows - violations) / sum(total_rows)')} AS consistency FROM ({ALL_REPORTS})""")
def fk_overall(spark, sf_dir):
    return overall_consistency(fk_report_all(star_schema(), disturbed(spark, sf_dir))).withColumn("consistency", r6("consistency"))


@check(f"""WITH {ORDERS_COPY}, {LINEITEM_COPY}, r AS ({ALL_REPORTS})
SELECT fk AS metric, {q6('1 - violations / total_rows')} AS value FROM r
UNION ALL SELECT 'overall', {q6('sum(total_rows - violations) / sum(total_rows)')} FROM r""")
def q_fk_metrics(spark, sf_dir):
    return fk_metrics(star_schema(), disturbed(spark, sf_dir)).withColumn("value", r6("value"))


def repaired_sql(seed, scope, parent, key):
    u = u_sql("'repair'", quoted(scope), "'o_custkey'", "o_orderkey", seed=seed)
    return f"""WITH {ORDERS_COPY}, {intervals_sql('iv', parent, key)},
placed AS (SELECT o_orderkey, o_custkey, o_custkey IN (SELECT k FROM iv) AS ok, {position_sql(u, 'iv')} AS pos FROM orders_copy)
SELECT o_orderkey, o_custkey FROM placed WHERE coalesce(ok, false)
UNION ALL SELECT o_orderkey, k FROM placed JOIN iv ON pos >= start AND pos < stop WHERE NOT coalesce(ok, false)"""


@check(repaired_sql("42", "demo", "customer", "c_custkey"))
def repair_random(spark, sf_dir):
    orders = orders_copy(spark, sf_dir).select("o_orderkey", "o_custkey")
    return repair_foreign_key(orders, "o_custkey", table(spark, sf_dir, "customer"), "c_custkey", "o_orderkey", DRAWS,
                              "random", "demo")


@check(repaired_sql("42", "demo", "customer", "c_custkey"))
def repair_fallback(spark, sf_dir):
    """Nearest parents are asked for, but no numeric column is shared: a uniform draw is taken."""
    orders = orders_copy(spark, sf_dir).select("o_orderkey", "o_custkey")
    return repair_foreign_key(orders, "o_custkey", table(spark, sf_dir, "customer"), "c_custkey", "o_orderkey", DRAWS,
                              "nearest", "demo")


@check(repaired_sql("42", "demo", "events", "user_id"))
def repair_random_repeated(spark, sf_dir):
    """Parents whose keys repeat are drawn as often as they occur."""
    orders = orders_copy(spark, sf_dir).select("o_orderkey", "o_custkey")
    return repair_foreign_key(orders, "o_custkey", table(spark, sf_dir, "events"), "user_id", "o_orderkey", DRAWS,
                              "random", "demo")


@check(f"""WITH {ORDERS_COPY} SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT user_id FROM events) THEN o_custkey
  ELSE (SELECT user_id FROM events GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 1) END AS o_custkey FROM orders_copy""")
def repair_mode(spark, sf_dir):
    orders = orders_copy(spark, sf_dir).select("o_orderkey", "o_custkey")
    return repair_foreign_key(orders, "o_custkey", table(spark, sf_dir, "events"), "user_id", "o_orderkey", DRAWS, "mode")


FIXED_LABEL = "orders.o_custkey->customer.c_custkey"


@check(repaired_sql("42/0", FIXED_LABEL, "customer", "c_custkey"))
def repair_fixpoint(spark, sf_dir):
    tables = star_tables(spark, sf_dir, "region", "nation", "customer") | {
        "orders": orders_copy(spark, sf_dir).select("o_orderkey", "o_custkey")}
    schema = star_schema("region", "nation", "customer", "orders")
    fixed, _ = repair_all(schema, tables, {"orders": "o_orderkey"}, "random", draws=DRAWS)
    return fixed["orders"]


@check(f"""WITH {ORDERS_COPY} SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) // 200)::BIGINT AS batch
FROM orders_copy WHERE o_custkey IS NULL OR NOT {VALID_CUSTOMER}""")
def repair_batches(spark, sf_dir):
    bad = fk_violations(orders_copy(spark, sf_dir), "o_custkey", table(spark, sf_dir, "customer"), "c_custkey")
    return number_batches(bad.select("o_orderkey"), "o_orderkey", 200)


@check(f"""SELECT l_orderkey, l_linenumber, l_partkey, {q6('sqrt(power(l_quantity - p_size, 2) + power(l_extendedprice - p_retailprice, 2))')} AS distance
FROM lineitem JOIN part ON l_partkey = p_partkey""")
def q_pairwise_distance(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return pairwise_distance(pairs, ["l_quantity", "l_extendedprice"], ["p_size", "p_retailprice"]).select(
        "l_orderkey", "l_linenumber", "l_partkey", r6("distance").alias("distance"))


def part_seekers(spark, sf_dir):
    """Line items with the two numeric columns that parts have too."""
    return lineitem_copy(spark, sf_dir).select("rid", "l_partkey", F.col("l_quantity").alias("p_size"),
                                               (900 + l_price()).alias("p_retailprice"))


def l_price():
    return F.round(F.col("l_extendedprice") / 1000.0, 1)


PRICE = "round(l_extendedprice / 1000.0::DOUBLE, 1)"


@check(f"""WITH {LINEITEM_COPY} SELECT rid, l_partkey FROM lineitem_copy WHERE l_partkey IN (SELECT p_partkey FROM part)
UNION ALL SELECT rid, arg_min(p_partkey, (d, p_partkey)) FROM (
  SELECT rid, p_partkey, (l_quantity - p_size) * (l_quantity - p_size)
    + ((900 + {PRICE}) - p_retailprice) * ((900 + {PRICE}) - p_retailprice) AS d
  FROM lineitem_copy, part WHERE l_partkey NOT IN (SELECT p_partkey FROM part)) GROUP BY rid""")
def repair_nearest(spark, sf_dir):
    """Two shared features; every dangling line item takes the closest part."""
    fixed = repair_foreign_key(part_seekers(spark, sf_dir), "l_partkey", table(spark, sf_dir, "part"), "p_partkey", "rid",
                               DRAWS, "nearest", exclude=("l_partkey", "p_partkey"))
    return fixed.select("rid", "l_partkey")


@check(f"""SELECT s_suppkey, c_custkey, {q6('d')} AS distance, r AS rank FROM (
  SELECT s_suppkey, c_custkey, abs(s_acctbal - c_acctbal) AS d,
    (row_number() OVER (PARTITION BY s_suppkey ORDER BY (s_acctbal - c_acctbal) * (s_acctbal - c_acctbal), c_custkey))::INTEGER AS r
  FROM supplier, customer) WHERE r <= 5""")
def nearest_five(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").withColumnRenamed("s_acctbal", "acctbal")
    customers = table(spark, sf_dir, "customer").withColumnRenamed("c_acctbal", "acctbal")
    near = nearest_parents(suppliers, "s_suppkey", customers, "c_custkey", ["acctbal"], 5)
    return near.select("s_suppkey", F.col("parent_id").alias("c_custkey"), r6("distance").alias("distance"), "rank")


def nearest_sql(children: str, parents: str, features: list[str]) -> str:
    """(child, parent, distance) by comparing every child with every parent."""
    d = " + ".join(f"(a.{f} - b.{f}) * (a.{f} - b.{f})" for f in features)
    return f"""WITH a AS ({children}), b AS ({parents}), p AS (SELECT child, parent, {d} AS d FROM a, b)
SELECT child, arg_min(parent, (d, parent)) AS parent, {q6('sqrt(min(d))')} AS distance FROM p GROUP BY child"""


def nearest_one(children, parents, features):
    found = nearest_parents(children, "child", parents, "parent", features)
    return found.select("child", F.col("parent_id").alias("parent"), r6("distance").alias("distance"))


@check(nearest_sql("SELECT c_custkey AS child, c_acctbal * 10 + 50000 AS x, c_nationkey - 100.0::DOUBLE AS y FROM customer",
                   "SELECT p_partkey AS parent, p_retailprice AS x, p_size::DOUBLE AS y FROM part", ["x", "y"]))
def nearest_outside(spark, sf_dir):
    """Children that lie far outside the range of all parents."""
    return nearest_one(
        table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("child"), (F.col("c_acctbal") * 10 + 50000).alias("x"),
                                                (F.col("c_nationkey") - 100.0).alias("y")),
        table(spark, sf_dir, "part").select(F.col("p_partkey").alias("parent"), F.col("p_retailprice").alias("x"),
                                            F.col("p_size").cast("double").alias("y")), ["x", "y"])


@check(nearest_sql("SELECT c_custkey AS child, c_acctbal / 10 + 900 AS x, c_nationkey * 2.0::DOUBLE AS y, (c_custkey % 977)::DOUBLE AS z FROM customer",
                   "SELECT p_partkey AS parent, p_retailprice AS x, p_size::DOUBLE AS y, (p_partkey % 911)::DOUBLE AS z FROM part", ["x", "y", "z"]))
def nearest_three_features(spark, sf_dir):
    return nearest_one(
        table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("child"), (F.col("c_acctbal") / 10 + 900).alias("x"),
                                                (F.col("c_nationkey") * 2.0).alias("y"), (F.col("c_custkey") % 977).cast("double").alias("z")),
        table(spark, sf_dir, "part").select(F.col("p_partkey").alias("parent"), F.col("p_retailprice").alias("x"),
                                            F.col("p_size").cast("double").alias("y"), (F.col("p_partkey") % 911).cast("double").alias("z")),
        ["x", "y", "z"])


@check(nearest_sql("SELECT o_orderkey AS child, CASE WHEN o_orderkey % 3 = 0 THEN 4321.5 ELSE o_totalprice / 50 END AS x FROM orders",
                   "SELECT c_custkey AS parent, c_acctbal AS x FROM customer", ["x"]))
def nearest_hot_vector(spark, sf_dir):
    """One feature, and a third of all children in one point."""
    return nearest_one(
        table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("child"), F.when(F.col("o_orderkey") % 3 == 0, 4321.5)
                                              .otherwise(F.col("o_totalprice") / 50).alias("x")),
        table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("parent"), F.col("c_acctbal").alias("x")), ["x"])


@check(f"""WITH {LINEITEM_COPY}, bad AS (SELECT row_number() OVER (ORDER BY rid) - 1 AS i FROM lineitem_copy
  WHERE l_partkey NOT IN (SELECT p_partkey FROM part))
SELECT (i // 150)::BIGINT AS batch, count(*) AS n_rows, count(*) AS n_parents FROM bad GROUP BY 1""")
def repair_one_to_one(spark, sf_dir):
    """Per batch of 150 dangling line items: rows, and different parts given to them."""
    from ..operators.assign import assign_one_to_one
    seekers, part = part_seekers(spark, sf_dir), table(spark, sf_dir, "part")
    bad = fk_violations(seekers, "l_partkey", part, "p_partkey")
    given = assign_one_to_one(bad, "rid", part, "p_partkey", ["p_size", "p_retailprice"], 150)
    return given.groupBy("batch").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("parent_id").alias("n_parents"))
