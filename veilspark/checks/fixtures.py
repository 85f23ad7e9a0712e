"""Shared inputs: metadata of the given tables, and disturbed whole copies of them.

The copies play the synthetic side: every row of the real table is kept, and keyed draws decide
which cells are replaced, nulled or pointed at a missing parent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import Draws
from ..schema import RelationalSchema, parse_schema
from .registry import index_sql, quoted, table, u_sql

CAT, NUM = "categorical", "numerical"


def _table(pk, **roles):
    return {"attributes": list(roles), "dtypes": roles, "primary_key": pk}


METADATA = {
    "tables": {
        "region": _table("r_regionkey", r_regionkey=CAT, r_name=CAT),
        "nation": _table("n_nationkey", n_nationkey=CAT, n_name=CAT, n_regionkey=CAT),
        "customer": _table("c_custkey", c_custkey=CAT, c_name=CAT, c_nationkey=CAT, c_acctbal=NUM, c_mktsegment=CAT),
        "supplier": _table("s_suppkey", s_suppkey=CAT, s_name=CAT, s_nationkey=CAT, s_acctbal=NUM),
        "part": _table("p_partkey", p_partkey=CAT, p_name=CAT, p_brand=CAT, p_type=CAT, p_size=NUM, p_retailprice=NUM),
        "orders": _table("o_orderkey", o_orderkey=CAT, o_custkey=CAT, o_orderstatus=CAT, o_totalprice=NUM,
                         o_orderdate=NUM, o_orderpriority=CAT),
        "lineitem": _table(None, l_orderkey=CAT, l_partkey=CAT, l_suppkey=CAT, l_linenumber=CAT, l_quantity=NUM,
                           l_extendedprice=NUM, l_discount=NUM, l_tax=NUM, l_returnflag=CAT, l_linestatus=CAT,
                           l_shipdate=NUM),
    },
    "foreign_keys": [dict(zip(("child_table", "child_col", "parent_table", "parent_col"), fk)) for fk in (
        ("nation", "n_regionkey", "region", "r_regionkey"),
        ("customer", "c_nationkey", "nation", "n_nationkey"),
        ("supplier", "s_nationkey", "nation", "n_nationkey"),
        ("orders", "o_custkey", "customer", "c_custkey"),
        ("lineitem", "l_orderkey", "orders", "o_orderkey"),
        ("lineitem", "l_partkey", "part", "p_partkey"),
        ("lineitem", "l_suppkey", "supplier", "s_suppkey"))],
}
STAR_TABLES = list(METADATA["tables"])


def star_schema(*names: str) -> RelationalSchema:
    """Metadata of the given tables, or of some of them with the keys among these."""
    keep = set(names or STAR_TABLES)
    return parse_schema({
        "tables": {n: t for n, t in METADATA["tables"].items() if n in keep},
        "foreign_keys": [fk for fk in METADATA["foreign_keys"] if {fk["child_table"], fk["parent_table"]} <= keep]})


def star_tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: table(spark, sf_dir, n) for n in names or STAR_TABLES}


DRAWS = Draws(42)
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
FLAGS = ["A", "N", "R"]
LINE_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def orders_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with dangling and null customers, null and rescaled prices, redrawn priorities."""
    def u(what):
        return DRAWS.uniform("copy", what, F.col("o_orderkey"))
    drawn = F.element_at(F.array(*[F.lit(p) for p in PRIORITIES]), (F.floor(u("new") * 5) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(u("cust") < 0.06, F.lit(-1)).when(u("cust") >= 0.1, F.col("o_custkey")).cast("bigint").alias("o_custkey"),
        "o_orderstatus",
        F.when(u("gone") >= 0.02, F.round(F.col("o_totalprice") * (0.8 + 0.4 * u("scale")), 2)).alias("o_totalprice"),
        "o_orderdate",
        F.when(u("prio") < 0.3, drawn).when(u("prio") >= 0.32, F.col("o_orderpriority")).alias("o_orderpriority"))


def _o(what):
    return u_sql("'copy'", quoted(what), "o_orderkey")


ORDERS_COPY = f"""orders_copy AS (
  SELECT o_orderkey,
    CASE WHEN {_o('cust')} < 0.06::DOUBLE THEN -1 WHEN {_o('cust')} >= 0.1::DOUBLE THEN o_custkey END::BIGINT AS o_custkey,
    o_orderstatus,
    CASE WHEN {_o('gone')} >= 0.02::DOUBLE
         THEN round(o_totalprice * (0.8::DOUBLE + 0.4::DOUBLE * {_o('scale')}), 2) END AS o_totalprice,
    o_orderdate,
    CASE WHEN {_o('prio')} < 0.3::DOUBLE
         THEN [{', '.join(map(quoted, PRIORITIES))}][floor({_o('new')} * 5)::INTEGER + 1]
         WHEN {_o('prio')} >= 0.32::DOUBLE THEN o_orderpriority END AS o_orderpriority
  FROM orders)"""


def line_rid():
    return F.concat_ws("-", *[F.col(c).cast("string") for c in LINE_ID])


LINE_RID = "concat_ws('-', " + ", ".join(LINE_ID) + ")"


def lineitem_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with a row id, dangling parts, redrawn return flags and discounts."""
    base = table(spark, sf_dir, "lineitem").withColumn("rid", line_rid())

    def u(what):
        return DRAWS.uniform("copy", what, F.col("rid"))
    flag = F.element_at(F.array(*[F.lit(f) for f in FLAGS]), (F.floor(u("flag") * 3) + 1).cast("int"))
    return base.select(
        "rid", "l_orderkey", F.when(u("part") < 0.05, F.lit(-1)).otherwise(F.col("l_partkey")).cast("bigint").alias("l_partkey"),
        "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        F.when(u("disc") < 0.3, F.round(0.1 * u("new"), 2)).otherwise(F.col("l_discount")).alias("l_discount"),
        "l_tax", F.when(u("keep") < 0.2, flag).otherwise(F.col("l_returnflag")).alias("l_returnflag"),
        "l_linestatus", "l_shipdate")


def _l(what):
    return u_sql("'copy'", quoted(what), "rid")


LINEITEM_COPY = f"""lineitem_copy AS (
  SELECT rid, l_orderkey,
    (CASE WHEN {_l('part')} < 0.05::DOUBLE THEN -1 ELSE l_partkey END)::BIGINT AS l_partkey,
    l_suppkey, l_linenumber, l_quantity, l_extendedprice,
    CASE WHEN {_l('disc')} < 0.3::DOUBLE THEN round(0.1::DOUBLE * {_l('new')}, 2) ELSE l_discount END AS l_discount,
    l_tax,
    CASE WHEN {_l('keep')} < 0.2::DOUBLE
         THEN [{', '.join(map(quoted, FLAGS))}][floor({_l('flag')} * 3)::INTEGER + 1] ELSE l_returnflag END AS l_returnflag,
    l_linestatus, l_shipdate
  FROM (SELECT *, {LINE_RID} AS rid FROM lineitem))"""

KEY_BUCKETS = 4096


def intervals_sql(name: str, source: str, key: str) -> str:
    """CTE with the positions each distinct key owns, in bucket and key order."""
    bucket = f"(('0x' || substr(md5({key}::VARCHAR), 1, 8))::BIGINT % {KEY_BUCKETS})"
    return f"""{name} AS (
  SELECT k, stop - w AS start, stop, max(stop) OVER () AS n FROM (
    SELECT {key} AS k, count(*) AS w,
           (sum(count(*)) OVER (ORDER BY {bucket}, {key} ROWS UNBOUNDED PRECEDING))::BIGINT AS stop
    FROM {source} WHERE {key} IS NOT NULL GROUP BY {key}))"""


def position_sql(u: str, intervals: str) -> str:
    return index_sql(u, f"(SELECT max(n) FROM {intervals})")
