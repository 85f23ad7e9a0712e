"""Work that is done once, however many results read it."""

import math

import numpy as np
from pyspark.sql import functions as F

from veilspark.functions.draws import box_muller, normal_cdf, normal_cdf_of, normal_pair
from veilspark.plans.synthesis import non_private
from veilspark.schema import parse_schema

SCHEMA = {"tables": {"a": {"attributes": ["id", "x"], "dtypes": {"id": "categorical", "x": "numerical"}, "primary_key": "id"},
                     "b": {"attributes": ["a_id", "y"], "dtypes": {"a_id": "categorical", "y": "categorical"}, "primary_key": None}},
          "foreign_keys": [{"child_table": "b", "child_col": "a_id", "parent_table": "a", "parent_col": "id"}]}


def test_baseline_tables_are_drawn_once(spark):
    """Tables of the copula baseline are stored rows, not the plan that draws them."""
    real = {"a": spark.range(1, 40).select("id", (F.col("id") % 7).alias("x")),
            "b": spark.range(90).select((F.col("id") % 39 + 1).alias("a_id"), F.concat(F.lit("v"), F.col("id") % 4).alias("y"))}
    for name, df in non_private(real, parse_schema(SCHEMA)).items():
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not any(step in plan for step in ("Join", "MapInArrow", "Range")), plan
        assert df.count() == real[name].count() and df.schema.names == real[name].schema.names


def test_batches_draw_what_columns_draw(spark):
    """Normals and their distribution function agree between batches and column expressions."""
    rows = spark.range(1, 400).select((F.col("id") / 400).alias("u"), (F.col("id") * 7 % 400 / 400).alias("v"))
    rows = rows.select("u", "v", *[z.alias(f"z{i}") for i, z in enumerate(normal_pair(F.col("u"), F.col("v")))])
    got = rows.select("*", normal_cdf(F.col("z0") * 3).alias("p")).toPandas()
    for name, z in zip(("z0", "z1"), box_muller(got["u"].to_numpy(), got["v"].to_numpy())):
        assert np.allclose(got[name], z, rtol=0, atol=1e-13)
    assert np.allclose(got["p"], normal_cdf_of(got["z0"].to_numpy() * 3), rtol=1e-13, atol=0)
    assert np.allclose(normal_cdf_of(np.array([-9.0, -1.0, 0.0, 1.0, 9.0])), [0.5 * math.erfc(-x / math.sqrt(2)) for x in (-9, -1, 0, 1, 9)], rtol=1e-6, atol=0)


def test_cross_queries_of_a_key_share_a_pass(spark):
    """Three questions about one key read each side's parent and child once; each answer is that of the single question."""
    from veilspark.operators.fidelity import PlannedQuery, cross_count, cross_mean, query_errors
    schema = parse_schema(SCHEMA | {"tables": SCHEMA["tables"] | {
        "a": {"attributes": ["id", "x", "z"], "dtypes": {"id": "categorical", "x": "numerical", "z": "numerical"}, "primary_key": "id"}}})
    def side(shift):
        a = spark.createDataFrame([(i, float(i % 5), None if i % 3 else float(i + shift)) for i in range(1, 30)], "id long, x double, z double")
        b = spark.createDataFrame([(i * i % 40 + shift, "v") for i in range(60)] + [(None, "v")], "a_id long, y string")
        return {"a": a, "b": b}
    real, syn = side(0), side(1)
    label = schema.foreign_keys[0].label
    plan = [PlannedQuery("cross_table", label, c) for c in (("x",), (), ("z",))]
    errors = query_errors(real, syn, schema, plan)
    assert errors._jdf.queryExecution().analyzed().toString().count("LogicalRDD") == 4
    for q, row in zip(plan, errors.collect()):
        r, s = ((cross_mean(t["b"], "a_id", t["a"], "id", q.columns[0]) if q.columns else cross_count(t["b"], "a_id", t["a"], "id")).first()["value"]
                for t in (real, syn))
        assert abs(row["error"] - abs(r - s) / abs(r)) < 1e-12 and row["query"] == f"{label} {' '.join(q.columns)}"


def test_errors_of_keys_with_equal_counts(spark):
    """Errors and distances from counts of counts are those over all keys, also without real rows."""
    from veilspark.operators.fidelity import kway_errors, tv_categorical
    draw = lambda m: spark.createDataFrame([(str(i * m % 7), None if i % 11 == 0 else str(i % m)) for i in range(50)], "p string, q string")
    real, syn = draw(3), draw(4)
    got = {r["columns"]: r for r in kway_errors(real, syn, [["p"], ["p", "q"]]).collect()}
    tv = {r["column_name"]: r["tv"] for r in tv_categorical(real, syn, ["p", "q"]).collect()}
    for columns in (["p"], ["q"], ["p", "q"]):
        sides = [[tuple(r[c] for c in columns) for r in df.collect() if None not in tuple(r[c] for c in columns)] for df in (real, syn)]
        gaps = [abs(sides[0].count(k) / len(sides[0]) - sides[1].count(k) / len(sides[1])) for k in {*sides[0], *sides[1]}]
        name = "|".join(columns)
        if name in got:
            assert got[name]["cells"] == len(gaps) and abs(got[name]["error"] - sum(gaps) / len(gaps)) < 1e-12
        if name in tv:
            assert abs(tv[name] - sum(gaps) / 2) < 1e-12
    assert [r["error"] for r in kway_errors(real.limit(0), syn, [["p"]]).collect()] == [None]


def test_answers_of_many_vectors_are_not_broadcast(spark, monkeypatch):
    """Found parents go to all tasks only within the bytes that may be broadcast, counted by rows of that width."""
    from veilspark.operators import nearest
    kids = spark.range(60).select("id", (F.col("id") * 1.5).alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    folks = spark.range(40).select(F.col("id").alias("pid"), (F.col("id") * 2.0).alias("x"), (F.col("id") % 5).cast("double").alias("y"))
    wide = nearest.nearest_parents(kids, "id", folks, "pid", ["x", "y"])
    monkeypatch.setattr(nearest, "BROADCAST_BYTES", 48 * 59)
    bounded = nearest.nearest_parents(kids, "id", folks, "pid", ["x", "y"])
    assert "broadcast" in wide._jdf.queryExecution().analyzed().toString()
    assert "broadcast" not in bounded._jdf.queryExecution().analyzed().toString()
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, bounded.collect()))


def test_synthetic_tables_are_written_once_and_read_by_column(spark):
    """A synthesis stores its tables by columns, and a measured run scores those tables instead of copies."""
    from veilspark.plans.experiments import Run, measured
    from veilspark.plans.synthesis import Settings, synthesize
    real = {"a": spark.range(1, 40).select("id", (F.col("id") % 7).alias("x")),
            "b": spark.range(90).select((F.col("id") % 39 + 1).alias("a_id"), F.concat(F.lit("v"), F.col("id") % 4).alias("y"))}
    schema, settings, scored = parse_schema(SCHEMA), Settings(num_queries=10, num_bins=4, max_parents=1), []
    made = synthesize(real, schema, settings).tables
    assert "ReadSchema: struct<a_id:bigint>" in made["b"].select("a_id")._jdf.queryExecution().executedPlan().toString()

    def score(_, syn, __):
        scored.append(syn)
        return spark.createDataFrame([("s", "m", 1.0)], "scope string, metric string, value double")
    rows = measured(Run({"n": 1}, lambda: made, real, schema, settings, 1), score).collect()
    assert scored[0]["b"] is made["b"] and rows[0]["metric"] == "s.m"
