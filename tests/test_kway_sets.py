"""Errors of many column sets from one pass: typed grouping sets against plain counts."""

from collections import Counter

import pytest

from veilspark.operators.fidelity import kway_errors

SETS = [("a",), ("b", "a"), ("a", "b"), ("c", "x"), ("b",)]


def test_sets_against_counts(spark):
    real = [(1, "u", 1.5, 1), (1, "v", 1.5, 2), (2, "u", None, 3), (None, "u", 0.0, 3), (2, None, 2.0, 4)]
    syn = [(1, "u", 1.5, "1"), (3, "v", 2.0, "2"), (2, "u", 0.0, "x"), (2, "u", None, None)]
    frames = (spark.createDataFrame(real, "a long, b string, c double, x int"), spark.createDataFrame(syn, "a long, b string, c double, x string"))
    out = kway_errors(*frames, SETS)
    wanted = {}
    for cs in SETS:
        keys = [[tuple(str(row["abcx".index(c)]) for c in cs) for row in rows if all(row["abcx".index(c)] is not None for c in cs)] for rows in (real, syn)]
        r, s = map(Counter, keys)
        wanted["|".join(cs)] = (len(r | s), sum(abs(r[k] / len(keys[0]) - s[k] / len(keys[1])) for k in r | s) / len(r | s))
    found = {row["columns"]: (row["cells"], pytest.approx(row["error"])) for row in out.collect()}
    assert wanted == found
    # One pass: rows are expanded with typed keys, not with arrays of texts, and the counted cells are read once.
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Expand") == 1


def test_more_columns_than_a_grouping_id_has_bits(spark):
    names = [f"c{i}" for i in range(70)]
    rows = spark.range(20).selectExpr(*[f"id % {i + 2} AS {n}" for i, n in enumerate(names)])
    found = {r["columns"]: (r["cells"], r["error"]) for r in kway_errors(rows, rows, [(n,) for n in names]).collect()}
    assert found == {n: (min(20, i + 2), 0.0) for i, n in enumerate(names)}
