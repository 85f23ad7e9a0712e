"""Public ranges, lists, null columns and row counts, and the ledger that they change."""

from pyspark.sql import functions as F

from veilspark.operators.budget import composed_ledger
from veilspark.operators.encode import fit_codec
from veilspark.plans.synthesis import Settings, fit_all, synthesize
from veilspark.sources.datasets import load_dataset
from veilspark.sources.io import collect_sizes

SMALL = {"num_queries": 10, "num_bins": 8, "max_parents": 2, "query_types": ("1way", "2way")}


def rows(spark, values):
    return spark.createDataFrame(values, "x double, c string")


def test_public_inputs_are_not_read(spark):
    """Two tables without a row in common get the same codec."""
    known = {"bounds": {"x": (0.0, 8.0)}, "domains": {"c": ["a", "b"]}, "nullable": ["c"], "num_bins": 4}
    one = fit_codec(rows(spark, [(1.0, "a")]), {"x": "numerical"}, **known)
    two = fit_codec(rows(spark, [(900.0, None), (None, "z")]), {"x": "numerical"}, **known)
    assert one == two and one.sizes == {"x": 4, "c": 3}


def test_values_outside_public_ranges(spark):
    df = rows(spark, [(-5.0, "a"), (99.0, "z"), (None, None), (3.0, "b")])
    known = {"bounds": {"x": (0.0, 8.0)}, "domains": {"c": ["a", "b"]}, "num_bins": 4}
    codes = fit_codec(df, {"x": "numerical"}, nullable=["c"], **known).encode(df).collect()
    assert [tuple(r) for r in codes] == [(0, 0), (3, 2), (3, 2), (1, 1)]
    closed = fit_codec(df, {"x": "numerical"}, nullable=[], **known).encode(df).collect()
    assert [r["c"] for r in closed] == [0, 0, 0, 1]
    decoded = fit_codec(df, {"x": "numerical"}, nullable=["c"], **known)
    assert [r["c"] for r in decoded.decode(decoded.encode(df)).collect()] == ["a", None, None, "b"]


def test_ledger_names_what_was_read(spark):
    tables, schema = load_dataset(spark, "rossmann")
    table = schema.tables["store_states"]
    s = Settings(**SMALL, domains={"store_states": {"state_name": [f"State_{i}" for i in range(1, 17)]}},
                 nullable={"store_states": []}, row_counts={"store_states": 16})
    assert table.primary_key == "state"
    ledger = fit_all(tables, schema, s).ledger(spark)
    private = {r["table_name"] for r in ledger.groupBy("table_name").agg(F.bool_and("is_private").alias("p")).filter("p").collect()}
    assert private == {"store_states"}


def test_public_row_counts_set_the_sizes(spark):
    tables, schema = load_dataset(spark, "synthetic_star", num_dimension_tables=2, dim_rows=30, fact_rows=100)
    made = synthesize(tables, schema, Settings(**SMALL, row_counts={"fact": 140, "dim_0": 20}))
    assert collect_sizes(made.tables) == {"dim_0": 20, "dim_1": 30, "fact": 140}
    assert made.tables["fact"].agg(F.max("dim_0_id")).first()[0] <= 20


def test_many_small_releases_compose_below_their_sum(spark):
    ledger = spark.createDataFrame([("t", "tables", 5000, 50.0, True), ("t", "row count", 0, 0.0, False), ("u", "tables", 2, 0.5, True)],
                                   "table_name string, release string, n_releases bigint, eps double, is_private boolean")
    got = {r["table_name"]: r for r in composed_ledger(ledger, 1e-5).collect()}
    assert got["t"]["guarantee"] == got["t"]["composed_eps"] < 10 and not got["t"]["is_private"]
    assert got["u"]["guarantee"] == got["u"]["eps"] == 0.5 < got["u"]["composed_eps"] and got["u"]["is_private"]
