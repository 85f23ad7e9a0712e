"""Generated columns and tables; sizes, domains and ranges come from the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.draws import choice_draw, integer_draw, real_draw, weighted_choice_draw
from ..operators.sample import dense_foreign_key
from ..sources.datasets import SPECS
from ..sources.generate import generate_tables, lookup_product, phone_draw, scaled, star_spec
from ..sources.io import table_sizes, union_all
from .fixtures import DRAWS
from .registry import check, index_sql, q6, quoted, r6, table, u_sql
from .spec_sql import spec_sql

def slots(spark, sf_dir, name):
    """Row ids 1..n, as many as the table has rows."""
    return spark.range(1, table(spark, sf_dir, name).count() + 1)


def slots_sql(name):
    return f"(SELECT unnest(range(1, (SELECT count(*) FROM {name}) + 1)) AS id)"


@check(f"SELECT id FROM {slots_sql('lineitem')}")
def gen_dense_key(spark, sf_dir):
    return slots(spark, sf_dir, "lineitem")


@check(f"""WITH d AS (SELECT list(v ORDER BY v) AS vs FROM (SELECT DISTINCT o_orderpriority AS v FROM orders))
SELECT id, vs[{index_sql(u_sql("'gen'", "'choice'", "id"), "len(vs)")} + 1] AS value FROM {slots_sql('orders')}, d""")
def gen_uniform_choice(spark, sf_dir):
    values = sorted(r[0] for r in table(spark, sf_dir, "orders").select("o_orderpriority").distinct().collect())
    return slots(spark, sf_dir, "orders").select("id", choice_draw(DRAWS.uniform("gen", "choice", F.col("id")), values).alias("value"))


@check(f"""WITH s AS (SELECT o_orderstatus AS v, count(*)::DOUBLE AS w FROM orders GROUP BY 1),
c AS (SELECT v, sum(w) OVER (ORDER BY v) / sum(w) OVER () AS cum, row_number() OVER (ORDER BY v) AS i FROM s),
d AS (SELECT id, {u_sql("'gen'", "'weighted'", "id")} AS u FROM {slots_sql('orders')})
SELECT id, (SELECT v FROM c WHERE i = least((SELECT count(*) FROM c WHERE cum <= u), (SELECT count(*) FROM c) - 1) + 1) AS value
FROM d""")
def gen_weighted_choice(spark, sf_dir):
    shares = table(spark, sf_dir, "orders").groupBy("o_orderstatus").count().orderBy("o_orderstatus").collect()
    draw = weighted_choice_draw(DRAWS.uniform("gen", "weighted", F.col("id")), [r[0] for r in shares], [r[1] for r in shares])
    return slots(spark, sf_dir, "orders").select("id", draw.alias("value"))


@check(f"""WITH b AS (SELECT min(p_size) AS lo, max(p_size) + 1 AS hi FROM part)
SELECT id, least(floor(lo + {u_sql("'gen'", "'int'", "id")} * (hi - lo))::BIGINT, hi - 1)::BIGINT AS value
FROM {slots_sql('part')}, b""")
def gen_uniform_int(spark, sf_dir):
    lo, hi = table(spark, sf_dir, "part").agg(F.min("p_size"), F.max("p_size") + 1).first()
    return slots(spark, sf_dir, "part").select("id", integer_draw(DRAWS.uniform("gen", "int", F.col("id")), lo, hi).alias("value"))


@check(f"""WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
SELECT id, {q6(f'''round(lo + {u_sql("'gen'", "'real'", "id")} * (hi - lo), 2)''')} AS value FROM {slots_sql('lineitem')}, b""")
def gen_uniform_real(spark, sf_dir):
    lo, hi = table(spark, sf_dir, "lineitem").agg(F.min("l_extendedprice"), F.max("l_extendedprice")).first()
    return slots(spark, sf_dir, "lineitem").select(
        "id", r6(real_draw(DRAWS.uniform("gen", "real", F.col("id")), lo, hi, 2)).alias("value"))


def _group(g, lo, hi):
    return f"""least(floor({lo} + {u_sql("'gen'", "'phone'", "c_custkey", quoted(str(g)))} * ({hi} - {lo}))::BIGINT, {hi - 1})"""


@check(f"""SELECT c_custkey, 'Customer_' || c_custkey AS name, printf('C#%04d', c_custkey) AS code,
concat_ws('-', {_group(0, 10, 99)}, {_group(1, 100, 999)}, {_group(2, 100, 999)}, {_group(3, 1000, 9999)}) AS phone
FROM customer""")
def gen_template_string(spark, sf_dir):
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.lit("Customer_"), key.cast("string")).alias("name"),
        F.format_string("C#%04d", key).alias("code"),
        phone_draw(lambda g: DRAWS.uniform("gen", "phone", key, g)).alias("phone"))


def _dense_fk(name, column):
    return f"""{index_sql(u_sql("'fk'", "'gen'", quoted(column), "id"), f"(SELECT count(*) FROM {name})")} + 1"""


@check(f"SELECT id, {_dense_fk('customer', 'custkey')} AS custkey FROM {slots_sql('orders')}")
def gen_fk_draw(spark, sf_dir):
    n = table(spark, sf_dir, "customer").count()
    return slots(spark, sf_dir, "orders").select("id", dense_foreign_key(F.col("id"), "custkey", n, DRAWS, "gen"))


@check(f"""SELECT l_orderkey, l_linenumber, l_partkey, {q6('round(l_quantity * p_retailprice, 2)')} AS revenue
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""")
def gen_derived_measure(spark, sf_dir):
    out = lookup_product(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part"), "l_partkey", "p_partkey",
                         "l_quantity", "p_retailprice", "revenue")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", r6("revenue").alias("revenue"))


def _measure(m):
    return q6(f"""round(0.0::DOUBLE + {u_sql("'fact'", quoted(m), "id")} * 10000.0::DOUBLE, 2)""")


@check(f"""WITH c AS (SELECT count(*) AS n FROM customer), f AS {slots_sql('lineitem')}
SELECT {", ".join(f'''{index_sql(u_sql("'fact'", f"'dim_{d}_id'", "id"), "n")} + 1 AS dim_{d}_id''' for d in range(3))},
{_measure('measure_0')} AS measure_0, {_measure('measure_1')} AS measure_1 FROM f, c""")
def gen_star_fact(spark, sf_dir):
    """A generated star as large as the given one: customer-sized dimensions, lineitem-sized fact."""
    sizes = {r["table_name"]: r["n_rows"] for r in table_sizes(
        {n: table(spark, sf_dir, n) for n in ("customer", "lineitem")}).collect()}
    tables = generate_tables(spark, star_spec(3, sizes["customer"], sizes["lineitem"]), DRAWS)
    return tables["fact"].select("dim_0_id", "dim_1_id", "dim_2_id", r6("measure_0").alias("measure_0"),
                                 r6("measure_1").alias("measure_1"))


DECLARED = [(d, t, s.rows) for d, spec in SPECS.items() for t, s in spec.items()]


@check(f"""WITH f AS (SELECT count(*) / 5000.0::DOUBLE AS factor FROM orders)
SELECT dataset, table_name, ceil(declared * factor)::BIGINT AS n_rows
FROM (VALUES {", ".join(f"('{d}', '{t}', {n})" for d, t, n in DECLARED)}) v(dataset, table_name, declared), f""")
def gen_spec_counts(spark, sf_dir):
    """All named datasets, scaled so that their largest tables match the orders table."""
    factor = table(spark, sf_dir, "orders").count() / 5000.0
    return union_all([table_sizes(generate_tables(spark, scaled(spec, factor), DRAWS))
                     .select(F.lit(name).alias("dataset"), "table_name", "n_rows") for name, spec in SPECS.items()])


def whole_spec(spark, sf_dir, name):
    """All rows and columns of a named dataset, scaled by the orders table, one frame for all its tables."""
    made = generate_tables(spark, scaled(SPECS[name], table(spark, sf_dir, "orders").count() / 5000.0), DRAWS)

    def plain(df, column):
        kind = df.schema[column].dataType
        if isinstance(kind, T.DoubleType):
            return r6(column).alias(column)
        return F.col(column).cast("bigint").alias(column) if isinstance(kind, T.IntegralType) else F.col(column)
    parts = [df.select(F.lit(name).alias("table_name"), *[plain(df, c) for c in df.columns]) for name, df in made.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def dataset_sql(name):
    return spec_sql(SPECS[name], "(SELECT count(*) / 5000.0::DOUBLE FROM orders)")


@check(dataset_sql("berka"))
def gen_berka(spark, sf_dir):
    return whole_spec(spark, sf_dir, "berka")


@check(dataset_sql("rossmann"))
def gen_rossmann(spark, sf_dir):
    return whole_spec(spark, sf_dir, "rossmann")


@check(dataset_sql("imdb"))
def gen_imdb(spark, sf_dir):
    return whole_spec(spark, sf_dir, "imdb")


@check(dataset_sql("tpch"))
def gen_tpch(spark, sf_dir):
    return whole_spec(spark, sf_dir, "tpch")


@check(dataset_sql("university"))
def gen_university(spark, sf_dir):
    return whole_spec(spark, sf_dir, "university")


@check(dataset_sql("walmart"))
def gen_walmart(spark, sf_dir):
    return whole_spec(spark, sf_dir, "walmart")
