"""Draws from models and foreign keys from parents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.sample import bootstrap, cap_rows, condition_foreign_key, sample_codes, sample_table, stratified_split
from ..operators.encode import fit_codec
from ..plans.synthesis import Settings, fit_all, synthesize
from ..sources.io import collect_sizes, table_sizes
from .fixtures import DRAWS, ORDERS_COPY, PRIORITIES, intervals_sql, orders_copy, position_sql, star_schema, star_tables
from .modelling import MODEL, ORDER_COLUMNS, order_model
from .reading import sizes_sql
from .budgeting import ANALYTICAL, INVOLVED, MIRONOV_COST, STATS, WEIGHTS, drawn_workload
from .registry import bin_sql, check, q6, quoted, r6, table, u_sql

SLOTS = "slots AS (SELECT unnest(range(1, (SELECT count(*) FROM orders) + 1)) AS rid)"
CDF = """cdf AS (SELECT family, pidx, code, sum(round(p, 12)) OVER (PARTITION BY family, pidx ORDER BY code
  ROWS UNBOUNDED PRECEDING) AS cum FROM cpt)"""


def step_sql(name, source, family, pidx, top, keep, column, scope):
    """One more sampled column: how many cumulative entries are at most the row's draw."""
    u = u_sql("'sample'", quoted(scope), quoted(family), "rid")
    return f"""{name} AS (SELECT {keep}, least(count(c.code), {top})::INTEGER AS {column}
  FROM (SELECT *, {u} AS u, {pidx} AS px FROM {source}) s
  LEFT JOIN cdf c ON c.family = '{family}' AND c.pidx = px AND c.cum <= u GROUP BY {keep})"""


def chain_sql(scope):
    return ", ".join([
        SLOTS, CDF,
        step_sql("s1", "slots", "o_orderpriority", "0", 4, "rid", "o_orderpriority", scope),
        step_sql("s2", "s1", "o_orderstatus", "o_orderpriority", 2, "rid, o_orderpriority", "o_orderstatus", scope),
        step_sql("s3", "s2", "o_totalprice", "o_orderpriority * 3 + o_orderstatus", 7,
                 "rid, o_orderpriority, o_orderstatus", "o_totalprice", scope)])


def _slots(spark, sf_dir):
    return spark.range(1, table(spark, sf_dir, "orders").count() + 1).select(F.col("id").alias("_rid"))


@check(f"WITH {MODEL}, {chain_sql('')} SELECT rid, o_orderpriority FROM s1")
def sample_root(spark, sf_dir):
    model = order_model(spark, sf_dir)
    return sample_codes(_slots(spark, sf_dir), model.families[:1], model.cpt, DRAWS).withColumnRenamed("_rid", "rid")


@check(f"WITH {MODEL}, {chain_sql('')} SELECT rid, o_orderpriority, o_orderstatus, o_totalprice FROM s3")
def sample_conditional(spark, sf_dir):
    model = order_model(spark, sf_dir)
    return sample_codes(_slots(spark, sf_dir), model.families, model.cpt, DRAWS).withColumnRenamed("_rid", "rid")



@check(f"""WITH {MODEL}, {chain_sql('orders')},
d AS (SELECT (SELECT list(v ORDER BY v) FROM (SELECT DISTINCT o_orderpriority AS v FROM orders)) AS ps,
             (SELECT list(v ORDER BY v) FROM (SELECT DISTINCT o_orderstatus AS v FROM orders)) AS ss)
SELECT rid, ps[o_orderpriority + 1] AS o_orderpriority, ss[o_orderstatus + 1] AS o_orderstatus,
  {q6('o_totalprice_lo + (o_totalprice + 0.5::DOUBLE) * ((o_totalprice_hi - o_totalprice_lo) / 8)')} AS o_totalprice
FROM s3, b, d""")
def q_sample_table(spark, sf_dir):
    model = order_model(spark, sf_dir)
    rows = sample_table(spark, model, model.n_rows, DRAWS, "midpoint")
    return rows.select(F.col("_rid").alias("rid"), *ORDER_COLUMNS[:2], r6("o_totalprice").alias("o_totalprice"))


@check(f"""WITH {intervals_sql('iv', 'customer', 'c_custkey')},
drawn AS (SELECT o_orderkey, {position_sql(u_sql("'fk'", "'orders'", "'o_custkey'", "o_orderkey"), 'iv')} AS pos FROM orders)
SELECT o_orderkey, k AS o_custkey FROM drawn JOIN iv ON pos >= start AND pos < stop""")
def fk_condition(spark, sf_dir):
    return condition_foreign_key(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey",
                                 table(spark, sf_dir, "customer"), "c_custkey", DRAWS, "o_orderkey", "orders")


@check(f"""WITH {ORDERS_COPY}, {intervals_sql('iv', 'orders_copy', 'o_custkey')},
drawn AS (SELECT l_orderkey, l_linenumber, l_partkey, {position_sql(
    u_sql("'fk'", "'lineitem'", "'custkey'", "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"), 'iv')} AS pos FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, k AS custkey FROM drawn JOIN iv ON pos >= start AND pos < stop""")
def fk_condition_repeated(spark, sf_dir):
    """Parent keys that repeat, one of them on many rows, and some null."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat_ws(
        "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("rid"))
    return condition_foreign_key(lines, "custkey", orders_copy(spark, sf_dir), "o_custkey", DRAWS, "rid", "lineitem").drop("rid")


STAR_SETTINGS = Settings()


def synthesis(spark, sf_dir, settings=STAR_SETTINGS):
    """A synthesis of all tables, by default with the default settings."""
    schema = star_schema()
    tables = star_tables(spark, sf_dir)
    return synthesize(tables, schema, settings), tables, schema


@check(sizes_sql(["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]))
def sample_all_counts(spark, sf_dir):
    return table_sizes(synthesis(spark, sf_dir)[0].tables)


def ledger_sql(stats=STATS, open_tables=()):
    """Budgets of the settings' own workload, and what each table spends its budget on; nothing of ``open_tables`` is read."""
    schema = star_schema()
    attrs = [(t, len([c for c in m.attributes if c not in schema.key_columns(t)])) for t, m in schema.tables.items()]
    known = f"table_name IN ({', '.join(map(quoted, ['', *open_tables]))})"
    return f"""WITH {stats}, {WEIGHTS},
{drawn_workload(STAR_SETTINGS.query_types, f"SELECT unnest(range({STAR_SETTINGS.num_queries})) AS qid")},
wlog AS (SELECT qid, list(table_name) AS tables, pow(0.9::DOUBLE, any_value(ord) - 1) AS weight FROM ranked WHERE r <= n GROUP BY qid),
{INVOLVED}, {ANALYTICAL},
spent AS (SELECT table_name, k, k * (k - 1) // 2 AS pairs, eps / (greatest(k * (k - 1) // 2, 1) + k) AS share
  FROM budget JOIN (VALUES {", ".join(f"('{t}', {k})" for t, k in attrs)}) v(table_name, k) USING (table_name)),
ledger AS (SELECT table_name, 'pair marginals' AS release, pairs::BIGINT AS n_releases, pairs * share AS eps, true AS is_private FROM spent
  UNION ALL SELECT table_name, 'conditional tables', k, k * share, true FROM spent
  UNION ALL SELECT table_name, 'bounds and dictionaries', 0, 0.0::DOUBLE, {known} FROM spent
  UNION ALL SELECT table_name, 'row count', 0, 0.0::DOUBLE, {'true' if open_tables else 'false'} FROM spent)"""


LEDGER_OUT = f" SELECT table_name, release, n_releases, {q6('eps')} AS eps, is_private FROM ledger"


@check(ledger_sql() + LEDGER_OUT)
def fit_all_ledger(spark, sf_dir):
    made = fit_all(star_tables(spark, sf_dir), star_schema(), STAR_SETTINGS)
    return made.ledger(spark).withColumn("eps", r6("eps"))


@check(ledger_sql() + f""", costs AS (
  SELECT table_name, min(rdp + ln(1.0::DOUBLE / 1e-5::DOUBLE) / (a - 1)) AS composed_eps FROM (
    SELECT table_name, a, sum(n_releases * {MIRONOV_COST}) AS rdp
    FROM (SELECT *, eps / greatest(n_releases, 1) AS eps_each FROM ledger) l, (SELECT unnest([1.5, 2, 3, 5, 10, 25, 50, 100])::DOUBLE AS a)
    GROUP BY ALL) GROUP BY table_name)
SELECT table_name, sum(n_releases)::BIGINT AS n_releases, {q6('sum(eps)')} AS eps, {q6('any_value(composed_eps)')} AS composed_eps,
  {q6('least(sum(eps), any_value(composed_eps))')} AS guarantee, bool_and(is_private) AS is_private
FROM ledger JOIN costs USING (table_name) GROUP BY table_name""")
def ledger_composed(spark, sf_dir):
    made = fit_all(star_tables(spark, sf_dir), star_schema(), STAR_SETTINGS).composed(spark)
    return made.select("table_name", "n_releases", *[r6(c).alias(c) for c in ("eps", "composed_eps", "guarantee")], "is_private")


# Public knowledge of one table; prices beyond the range and priorities outside the list do occur.
PUBLIC = {"bounds": {"orders": {"o_totalprice": (0.0, 100000.0), "o_orderdate": (0.0, 2e15)}},
          "domains": {"orders": {"o_orderstatus": ["F", "O", "P"], "o_orderpriority": PRIORITIES[:3]}},
          "nullable": {"orders": ["o_orderpriority"]}}
THOUSANDS = STATS.replace("s.n_rows", "(ceil(s.n_rows / 1000.0) * 1000)::BIGINT AS n_rows")


@check(ledger_sql(THOUSANDS, ["orders"]) + LEDGER_OUT)
def fit_public_ledger(spark, sf_dir):
    """Row counts published in thousands for all tables, and all columns of one table known beforehand."""
    tables = star_tables(spark, sf_dir)
    counts = {n: -(-rows // 1000) * 1000 for n, rows in collect_sizes(tables).items()}
    made = fit_all(tables, star_schema(), Settings(**PUBLIC, row_counts=counts))
    return made.ledger(spark).withColumn("eps", r6("eps"))


@check(f"""SELECT o_orderkey, {bin_sql('o_totalprice', '0.0::DOUBLE', '100000.0::DOUBLE', 32)} AS o_totalprice,
  coalesce(list_position(['F', 'O', 'P'], o_orderstatus) - 1, 0)::INTEGER AS o_orderstatus,
  coalesce(list_position([{', '.join(map(quoted, PRIORITIES[:3]))}], o_orderpriority) - 1, 3)::INTEGER AS o_orderpriority FROM orders""")
def encode_public(spark, sf_dir):
    """Codes from public ranges and lists alone: nothing is read to fit them."""
    orders = table(spark, sf_dir, "orders")
    codec = fit_codec(orders, star_schema().tables["orders"].dtypes, ["o_totalprice", "o_orderstatus", "o_orderpriority"], 32,
                      bounds={"o_totalprice": (0.0, 100000.0)}, domains=PUBLIC["domains"]["orders"], nullable=PUBLIC["nullable"]["orders"])
    return codec.encode(orders, ["o_orderkey"])


@check(f"""WITH {intervals_sql('iv', 'customer', 'c_custkey')},
slots AS (SELECT unnest(range((SELECT count(*) FROM customer))) AS id),
drawn AS (SELECT id, {position_sql(u_sql("'bootstrap'", "id"), 'iv')} AS pos FROM slots)
SELECT id AS rid, c.* FROM drawn JOIN iv ON pos >= start AND pos < stop JOIN customer c ON c_custkey = k""")
def bootstrap_rows(spark, sf_dir):
    return bootstrap(table(spark, sf_dir, "customer"), "c_custkey", DRAWS).withColumnRenamed("_rid", "rid")


@check(f"""SELECT o_orderkey, o_totalprice FROM orders ORDER BY {u_sql("'cap'", "o_orderkey")}, o_orderkey LIMIT 5000""")
def q_cap_rows(spark, sf_dir):
    """The sampling operator itself: at most 5,000 rows without replacement."""
    return cap_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 5000, DRAWS, "o_orderkey")


@check(f"""SELECT o_orderkey, o_orderstatus, n > 1 AND r <= round(n * 0.3::DOUBLE) AS is_test FROM (
  SELECT o_orderkey, o_orderstatus, count(*) OVER (PARTITION BY o_orderstatus) AS n,
    row_number() OVER (PARTITION BY o_orderstatus ORDER BY {u_sql("'split'", "o_orderkey")}, o_orderkey) AS r FROM orders)""")
def q_stratified_split(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return stratified_split(orders, "o_orderstatus", "o_orderkey", DRAWS, 0.3)
