"""Runs that are committed once, grids that go on where they stopped, growth exponents."""

import pytest
from pyspark.sql import functions as F

from veilspark.plans.experiments import Run, growth_exponent, play
from veilspark.plans.results import ResultTable, run_id
from veilspark.plans.synthesis import Settings


def shape(real, syn, schema):
    return syn["t"].agg(F.lit("rows").alias("scope"), F.lit("t").alias("metric"), F.count(F.lit(1)).cast("double").alias("value"))


def runs(spark, made, fail=None, seed=1):
    def make(n):
        def tables():
            if n == fail:
                raise RuntimeError("lost")
            made.append(n)
            return {"t": spark.range(n)}
        return tables
    return [Run({"n": n}, make(n), {}, None, Settings(), seed) for n in (3, 5, 7)]


def test_a_stopped_grid_goes_on(spark, tmp_path):
    made, path = [], f"{tmp_path}/grid"
    with pytest.raises(RuntimeError):
        play(spark, runs(spark, made, fail=7), path, shape)
    assert made == [3, 5]
    rows = play(spark, runs(spark, made), path, shape)
    assert made == [3, 5, 7] and sorted((r["n"], r["value"]) for r in rows.collect()) == [(3, 3.0), (5, 5.0), (7, 7.0)]
    play(spark, runs(spark, made), path, shape)
    assert made == [3, 5, 7]
    play(spark, runs(spark, made, seed=2)[:1], path, shape)
    assert made == [3, 5, 7, 3]


def test_unfinished_folders_are_not_read(spark, tmp_path):
    table = ResultTable(spark, f"{tmp_path}/r")
    assert table.committed() == set()
    with pytest.raises(ValueError):
        table.read()
    table.commit("a", spark.range(2))
    table.commit("b", spark.range(4))
    (tmp_path / "r" / "run=b" / "_SUCCESS").unlink()
    assert table.committed() == {"a"} and table.read().count() == 2
    table.commit("b", spark.range(5))
    table.commit("b", spark.range(5))
    assert table.read().count() == 7


def test_run_ids_tell_options_apart():
    assert run_id({"a": 1, "b": 2}, Settings()) == run_id({"b": 2, "a": 1}, Settings())
    assert run_id({"a": 1}, Settings()) != run_id({"a": 1}, Settings(num_bins=8))


def test_growth_exponent(spark):
    rows = [("square", n, float(n * n)) for n in (1, 2, 4, 8)] + [("one", 3, 2.0), ("one", 3, 4.0), ("none", 0, 1.0)]
    got = {r["kind"]: r for r in growth_exponent(spark.createDataFrame(rows, "kind string, n int, cost double"), "n", "cost", ["kind"]).collect()}
    assert abs(got["square"]["exponent"] - 2) < 1e-9 and got["one"]["exponent"] is None and set(got) == {"square", "one"}
