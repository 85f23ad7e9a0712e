"""Workloads and budgets.  The events table serves as a query log: its types stand for queries
over certain tables, one of which does not exist."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import budget as B
from ..sources.io import table_sizes
from .fixtures import DRAWS, STAR_TABLES, star_schema, star_tables
from .reading import sizes_sql
from .registry import check, q6, quoted, r6, table, u_sql

EPS, FLOOR, DECAY, DELTA = 1.0, 0.05, 0.9, 1e-5
LOG = {"signup": (["customer"], 1), "click": (["part"], 1), "view": (["part", "supplier"], 2),
       "purchase": (["customer", "orders", "lineitem"], 2), "error": (["orders", "no_such_table"], 3)}


def stats_frame(spark, sf_dir):
    return B.table_stats(spark, star_schema(), table_sizes(star_tables(spark, sf_dir)))


def query_log(spark, sf_dir):
    kinds = spark.createDataFrame([(k, t, o) for k, (t, o) in LOG.items()],
                                  "event_type string, tables array<string>, `order` int")
    return (table(spark, sf_dir, "events").join(kinds, "event_type")
            .select(F.col("event_id").alias("qid"), "tables", "order",
                    F.pow(F.lit(DECAY), F.col("order") - 1).alias("weight")))


_S = star_schema()
STATS = f"""sizes AS ({sizes_sql(STAR_TABLES)}), stats AS (
  SELECT v.*, s.n_rows FROM (VALUES {", ".join(
    f"({i}, '{t}', {len(m.attributes)}, {len(_S.references_to(t))}, {len(_S.foreign_keys_of(t))})"
    for i, (t, m) in enumerate(_S.tables.items()))}) v(ordinal, table_name, n_attrs, n_children, n_parents)
  JOIN sizes s USING (table_name))"""
WEIGHTS = """weights AS (
  SELECT ordinal, table_name, raw / sum(raw) OVER () AS weight FROM (
    SELECT *, (n_attrs + n_children + n_parents) * ln(1 + n_rows::DOUBLE) AS raw FROM stats))"""
QLOG = f"""qlog AS (SELECT event_id AS qid, CASE event_type {" ".join(
    f"WHEN '{k}' THEN [{', '.join(map(quoted, t))}]" for k, (t, _) in LOG.items())} END AS tables,
  CASE event_type {" ".join(f"WHEN '{k}' THEN {o}" for k, (_, o) in LOG.items())} END AS ord FROM events),
  wlog AS (SELECT qid, tables, ord, pow(0.9::DOUBLE, ord - 1) AS weight FROM qlog)"""
INVOLVED = """involved AS (
  SELECT s.*, coalesce(i.w, 0.0::DOUBLE) AS involvement FROM stats s LEFT JOIN (
    SELECT t AS table_name, sum(weight) AS w FROM (SELECT unnest(tables) AS t, weight FROM wlog) GROUP BY 1) i
  USING (table_name))"""


def normalized(raw: str) -> str:
    """CTEs that take (table_name, eps) rows to a normalised budget named ``budget``."""
    floor = f"least({FLOOR}::DOUBLE, 0.9::DOUBLE * {EPS} / count(*) OVER ())"
    return f"""raw AS ({raw}),
  lifted AS (SELECT table_name, greatest(eps * ({EPS}::DOUBLE / sum(eps) OVER ()), {floor}) AS eps FROM raw),
  budget AS (SELECT table_name, CASE WHEN abs(sum(eps) OVER () - {EPS}) > 1e-10
    THEN eps * ({EPS}::DOUBLE / sum(eps) OVER ()) ELSE eps END AS eps FROM lifted)"""


def split_sql(share: str) -> str:
    floor = f"least({FLOOR}::DOUBLE, 0.9::DOUBLE * {EPS} / count(*) OVER ())"
    return normalized(f"""SELECT table_name, greatest({EPS}::DOUBLE * ({share}) / sum({share}) OVER (), {floor}) AS eps
    FROM involved""")


ANALYTICAL = split_sql("pow(greatest(involvement, 0.01::DOUBLE) * n_attrs * ln(1 + n_rows::DOUBLE), 1.0::DOUBLE / 3.0::DOUBLE)")
BUDGET_OUT = f"SELECT table_name, {q6('eps')} AS eps FROM budget"


def out(df):
    return df.select("table_name", r6("eps").alias("eps"))


@check(f"WITH {STATS}, {WEIGHTS} SELECT table_name, {q6('weight')} AS weight FROM weights")
def table_weights(spark, sf_dir):
    return B.table_weights(stats_frame(spark, sf_dir)).select("table_name", r6("weight").alias("weight"))


def _workload(spark, sf_dir, types):
    queries = table(spark, sf_dir, "events").select(F.col("event_id").alias("qid"))
    drawn = B.generate_workload(spark, B.table_weights(stats_frame(spark, sf_dir)), 0, types, DECAY, DRAWS, queries)
    return drawn.select("qid", F.array_join("tables", ",").alias("tables"), "order", r6("weight").alias("weight"))


def drawn_workload(types, queries):
    """CTEs of a random workload for the ``qid`` rows of ``queries``, after STATS and WEIGHTS; ``ranked`` holds its tables."""
    pick = f"""[{', '.join(map(quoted, types))}][least(floor({u_sql("'query_type'", "qid")} * {len(types)})::INTEGER, {len(types) - 1}) + 1]"""
    return f"""typed AS (SELECT qid, {pick} AS qtype FROM ({queries})),
  sized AS (SELECT qid, qtype, CASE qtype WHEN '1way' THEN 1 WHEN '3way' THEN 3 ELSE 2 END AS ord,
    CASE WHEN qtype <> 'cross_table' THEN 1 WHEN {u_sql("'query_size'", "qid")} >= 0.5::DOUBLE THEN 3 ELSE 2 END AS n FROM typed),
  ranked AS (SELECT s.*, w.ordinal, w.table_name, row_number() OVER (PARTITION BY qid
    ORDER BY -ln({u_sql("'query_table'", "qid", "table_name")}) / weight) AS r FROM sized s, weights w)"""


def workload_sql(types):
    return f"""WITH {STATS}, {WEIGHTS}, {drawn_workload(types, "SELECT event_id AS qid FROM events")}
SELECT qid, string_agg(table_name, ',' ORDER BY ordinal) AS tables, any_value(ord)::INTEGER AS "order",
  {q6('pow(0.9::DOUBLE, any_value(ord) - 1)')} AS weight FROM ranked WHERE r <= n GROUP BY qid"""


@check(workload_sql(["1way", "2way", "3way"]))
def workload_single(spark, sf_dir):
    return _workload(spark, sf_dir, ["1way", "2way", "3way"])


@check(workload_sql(["cross_table"]))
def workload_cross(spark, sf_dir):
    return _workload(spark, sf_dir, ["cross_table"])


@check(f"WITH {STATS}, {QLOG}, {INVOLVED} SELECT table_name, {q6('involvement')} AS involvement FROM involved")
def workload_involvement(spark, sf_dir):
    return B.involvement(query_log(spark, sf_dir), stats_frame(spark, sf_dir)).select(
        "table_name", r6("involvement").alias("involvement"))


@check(f"""WITH {STATS}, {QLOG} SELECT tables, {q6('max(weight)')} AS weight, count(*) AS n_queries FROM (
  SELECT qid, weight, coalesce(string_agg(t, ',' ORDER BY t) FILTER (t IN (SELECT table_name FROM stats)), '') AS tables
  FROM (SELECT qid, weight, unnest(tables) AS t FROM wlog) GROUP BY qid, weight) GROUP BY tables""")
def workload_compact(spark, sf_dir):
    return B.compact_workload(query_log(spark, sf_dir), stats_frame(spark, sf_dir)).select(
        F.array_join("tables", ",").alias("tables"), r6("weight").alias("weight"), "n_queries")


@check(f"WITH {STATS} SELECT table_name, {q6(f'{EPS}::DOUBLE / count(*) OVER ()')} AS eps FROM stats")
def budget_equal(spark, sf_dir):
    return out(B.split_equal(stats_frame(spark, sf_dir), EPS))


@check(f"WITH {STATS}, {QLOG}, {INVOLVED}, {split_sql('involvement')} {BUDGET_OUT}")
def budget_proportional(spark, sf_dir):
    return out(B.split_proportional(stats_frame(spark, sf_dir), query_log(spark, sf_dir), EPS, FLOOR))


@check(f"WITH {STATS}, {QLOG}, {INVOLVED}, {ANALYTICAL} {BUDGET_OUT}")
def budget_analytical(spark, sf_dir):
    return out(B.split_analytical(stats_frame(spark, sf_dir), query_log(spark, sf_dir), EPS, FLOOR))


@check(f"WITH {STATS}, {normalized('SELECT table_name, n_rows::DOUBLE AS eps FROM stats')} {BUDGET_OUT}")
def budget_normalize(spark, sf_dir):
    raw = stats_frame(spark, sf_dir).select("table_name", F.col("n_rows").cast("double").alias("eps"))
    return out(B.normalize(raw, EPS, FLOOR))


@check(f"""WITH {STATS}, {QLOG},
known AS (SELECT list_intersect(tables, (SELECT list(table_name) FROM stats)) AS tables, weight FROM wlog),
asked AS (SELECT tables[1] AS table_name, max(weight) AS w FROM known WHERE len(tables) = 1 GROUP BY 1),
given AS (SELECT table_name, w, least({FLOOR}::DOUBLE, 0.9::DOUBLE * {EPS} / count(*) OVER ()) AS low FROM stats LEFT JOIN asked USING (table_name))
SELECT table_name, round(CASE WHEN w IS NULL THEN low ELSE w * ({EPS} - sum(CASE WHEN w IS NULL THEN low ELSE 0 END) OVER ()) / sum(w) OVER () END, 4) AS eps
FROM given""")
def budget_maxmin(spark, sf_dir):
    """Every larger set of this log holds a table that is asked for alone with more weight, so the optimum shares
    what the floors leave by those weights."""
    split = B.split_maxmin(stats_frame(spark, sf_dir), query_log(spark, sf_dir), EPS, FLOOR)
    return split.select("table_name", F.round("eps", 4).alias("eps"))


@check(f"""WITH {STATS}, {QLOG}, {INVOLVED}, {ANALYTICAL}
SELECT table_name, {q6('eps')} AS eps, (greatest(n_attrs * (n_attrs - 1) // 2, 1) + n_attrs)::BIGINT AS n_releases,
  {q6('eps / (greatest(n_attrs * (n_attrs - 1) / 2, 1) + n_attrs)')} AS eps_per_release
FROM budget JOIN stats USING (table_name)""")
def budget_ledger(spark, sf_dir):
    stats = stats_frame(spark, sf_dir)
    ledger = B.budget_ledger(B.split_analytical(stats, query_log(spark, sf_dir), EPS, FLOOR), stats)
    return ledger.select("table_name", r6("eps").alias("eps"), "n_releases", r6("eps_per_release").alias("eps_per_release"))


REFERENCE = "sum(a * eps * eps / (2 * (a - 1)))"
MIRONOV_COST = "(ln(a / (2*a - 1) * exp((a - 1) * eps_each) + (a - 1) / (2*a - 1) * exp(-a * eps_each)) / (a - 1))"
MIRONOV = "sum(ln(a / (2*a - 1) * exp((a - 1) * eps) + (a - 1) / (2*a - 1) * exp(-a * eps)) / (a - 1))"


@check(f"""WITH {STATS}, {QLOG}, {INVOLVED}, {ANALYTICAL},
orders_a AS (SELECT unnest([1.5, 2, 3, 5, 10, 25, 50, 100])::DOUBLE AS a)
SELECT formula, a AS alpha, {q6('rdp')} AS rdp, {q6('rdp + ln(1.0::DOUBLE / 1e-5::DOUBLE) / (a - 1)')} AS composed_eps FROM (
  SELECT 'reference' AS formula, a, {REFERENCE} AS rdp FROM budget, orders_a GROUP BY a
  UNION ALL SELECT 'laplace', a, {MIRONOV} FROM budget, orders_a GROUP BY a)""")
def rdp_compose(spark, sf_dir):
    budget = B.split_analytical(stats_frame(spark, sf_dir), query_log(spark, sf_dir), EPS, FLOOR)
    both = [B.rdp_compose(budget, DELTA, formula=f).select(F.lit(f).alias("formula"), "*") for f in ("reference", "laplace")]
    return both[0].unionByName(both[1]).select("formula", "alpha", r6("rdp").alias("rdp"), r6("composed_eps").alias("composed_eps"))
