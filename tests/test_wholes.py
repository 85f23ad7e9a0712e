"""Whole procedures on small star schemas and on the named datasets."""

import pytest
from pyspark.sql import functions as F

from veilspark.functions.scaling import cut
from veilspark.operators.integrity import fk_metrics, fk_report_all
from veilspark.plans.experiments import SUMMARY_METRICS, grid_summary, run_grid, widen
from veilspark.plans.report import evaluate_all
from veilspark.plans.synthesis import Settings, independent, non_private, synthesize
from veilspark.sources.datasets import SPECS, load_dataset
from veilspark.schema import parse_schema
from veilspark.sources.io import collect_sizes, flatten_record, load_tables

SMALL = Settings(num_queries=10, num_bins=8, max_parents=2, query_types=("1way", "2way", "cross_table"))


@pytest.fixture(scope="module")
def star(spark):
    tables, schema = load_dataset(spark, "synthetic_star", num_dimension_tables=2, dim_rows=60, fact_rows=500)
    return {n: cut(df) for n, df in tables.items()}, schema


@pytest.mark.parametrize("name", list(SPECS))
def test_named_datasets_hold_their_keys(spark, name):
    tables, schema = load_dataset(spark, name)
    assert collect_sizes(tables) == {n: t.rows for n, t in SPECS[name].items()}
    assert fk_report_all(schema, tables).agg(F.sum("violations")).first()[0] == 0
    assert all(df.columns == list(schema.tables[n].attributes) for n, df in tables.items())


def test_unknown_dataset_and_missing_files(spark, tmp_path):
    with pytest.raises(ValueError):
        load_dataset(spark, "nothing")
    _, schema = load_dataset(spark, "rossmann")
    assert load_tables(spark, schema, str(tmp_path)) is None


def test_flatten_record():
    assert flatten_record({"a": {"b": 1, "c": {"d": 2}}, "e": 3}) == {"a.b": 1, "a.c.d": 2, "e": 3}


@pytest.mark.parametrize("settings", [SMALL, Settings(**{**SMALL.__dict__, "keys": "as_value", "repair": "mode"})],
                         ids=["surrogate", "as_value"])
def test_synthesis_keeps_shape_keys_and_budget(spark, star, settings):
    tables, schema = star
    made = synthesize(tables, schema, settings)
    assert {n: df.columns for n, df in made.tables.items()} == {n: df.columns for n, df in tables.items()}
    assert collect_sizes(made.tables) == collect_sizes(tables)
    assert fk_metrics(schema, made.tables).filter("metric = 'overall'").first()["value"] == 1.0
    spent = made.ledger(spark).agg(F.sum("eps")).first()[0]
    assert abs(sum(made.budget.values()) - settings.eps_total) < 1e-9 and spent <= settings.eps_total + 1e-9


def test_same_seed_same_tables(spark, star):
    tables, schema = star
    a, b = (synthesize(tables, schema, SMALL).tables["fact"] for _ in range(2))
    assert a.exceptAll(b).isEmpty()


def test_report_and_independent_baseline(spark, star):
    tables, schema = star
    made = synthesize(tables, schema, independent(SMALL))
    report = evaluate_all(tables, made.tables, schema, 10, trees=3)
    got = {(r["scope"], r["metric"]): r["value"] for r in report.collect()}
    assert got["fk_consistency", "overall"] < 1.0
    assert ("marginal_tv_avg", "average") in got and ("ml_utility", "accuracy_real") in got
    assert all(v is None or v >= 0 for v in got.values())


def test_non_private_baseline_is_close(spark, star):
    tables, schema = star
    made = non_private(tables, schema)
    assert collect_sizes(made) == collect_sizes(tables)
    tv = evaluate_all(tables, made, schema, 5, with_utility=False).filter("scope = 'marginal_tv.fact' and metric = 'measure_0'")
    assert tv.first()["value"] < 0.25


def test_grid_and_summary(spark):
    rows = run_grid(spark, ["rossmann"], [1.0], 1, SMALL, with_non_private=False, with_utility=False)
    metrics = [m for m in SUMMARY_METRICS if not m.startswith("ml_utility")]
    wide = widen(rows, ["dataset", "method", "epsilon", "run"], metrics)
    summary = grid_summary(wide.toDF(*[c.replace(".", "_") for c in wide.columns]), [m.replace(".", "_") for m in metrics])
    assert summary.filter("level = 'run'").count() == 3 and summary.filter("level = 'method'").count() == 3


def test_csv_values_that_do_not_parse_raise(spark, tmp_path):
    from py4j.protocol import Py4JError
    from pyspark.errors import PySparkException
    from pyspark.sql import types as T
    schema = parse_schema({"tables": {"t": {"attributes": ["a"], "dtypes": {"a": "numerical"}, "primary_key": None}}, "foreign_keys": []})
    spark.createDataFrame([("1",), ("2020-01-01T00:00:00.000Z",)], "a string").coalesce(1).write.option("header", True).csv(f"{tmp_path}/t.csv")
    declared = {"t": T.StructType([T.StructField("a", T.DoubleType())])}
    with pytest.raises((PySparkException, Py4JError)):
        load_tables(spark, schema, str(tmp_path), types=declared)["t"].collect()
    kept = load_tables(spark, schema, str(tmp_path))["t"]
    assert kept.filter("a is null").isEmpty()
