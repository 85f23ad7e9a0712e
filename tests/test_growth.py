"""Work that must be spread over tasks, or done once, for the queries to keep up with their tables."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.functions.draws import Draws, uniforms_of
from veilspark.operators import copula, nearest
from veilspark.operators.assign import assign_one_to_one


def test_searched_vectors_are_dealt_over_tasks(spark, monkeypatch):
    """Distinct child vectors take few bytes, yet more than one task searches them."""
    plans, cut = [], nearest.cut
    monkeypatch.setattr(nearest, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    parents = spark.range(60).select(F.col("id").alias("pid"), F.col("id").cast("double").alias("x"))
    kids = spark.range(50).select(F.col("id").alias("cid"), (F.col("id") + 0.2).alias("x"))
    for k in (1, 3):
        found = nearest.nearest_parents(kids, "cid", parents, "pid", ["x"], k).filter("rank = 1").collect()
        assert all(r["parent_id"] == r["cid"] for r in found) and len(found) == 50
        assert "REPARTITION_BY_NUM" in plans[-1]


def test_rows_to_match_are_read_once(spark):
    """Numbering batches does not work out its rows again."""
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    kids = spark.range(90).select(F.col("id").alias("cid"), (F.col("id") % 50).cast("double").alias("x")).mapInArrow(count, "cid long, x double")
    parents = spark.range(50).select(F.col("id").alias("pid"), F.col("id").cast("double").alias("x"))
    assert assign_one_to_one(kids, "cid", parents, "pid", ["x"], 40).count() == 90
    assert read.value == 90


def test_batch_draws_equal_column_draws(spark):
    """Draws of a batch are the MD5 draws of the column, whatever the length of the key."""
    ids = [0, 1, -7, 10, 99_999, 2**62, -2**63]
    keys = [("copula", "", 0), ("copula", "é" * 5, 11), ("x" * 40, 3), ("x" * 80,)]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    for draws in (Draws(7), Draws("s:t")):
        wanted = df.select("id", *[draws.uniform(*key, F.col("id")).alias(f"u{i}") for i, key in enumerate(keys)]).collect()
        for i, found in enumerate(uniforms_of(draws, np.array(ids), keys)):
            assert dict(zip(ids, found.tolist())) == {r["id"]: r[f"u{i}"] for r in wanted}
    head = hashlib.md5(b"7:copula::0:10").hexdigest()[:13]
    assert uniforms_of(Draws(7), np.array([10]), keys)[0][0] == (int(head, 16) + 0.5) / 2**52


@pytest.mark.parametrize("generator", ["md5", "xxhash64"])
def test_copula_draws_in_batches(spark, generator):
    """Positions come from the draws of their row, by either generator, and MD5 ones are not worked out as columns."""
    df = spark.range(300).select((F.col("id") % 7).alias("a"), F.when(F.col("id") % 4 > 0, F.col("id") / 3).alias("b"), F.col("id").cast("string").alias("c"))
    fitted, draws = copula.fit_copula(df), Draws(5, generator)
    made = copula.positions(fitted, spark.range(1, 201).withColumnRenamed("id", "_rid"), draws, "t")
    assert "md5(" not in made._jdf.queryExecution().optimizedPlan().toString()
    u = spark.range(1, 201).select("id", *[draws.uniform("copula", "t", i, F.col("id")).alias(f"u{i}") for i in range(4)]).toPandas().set_index("id")
    first = np.sqrt(-2 * np.log(u["u0"])) * np.cos(2 * np.pi * u["u1"])
    assert all(r["_p0"] == min(299, int(300 * copula.normal_cdf_of(np.array([first[r["_rid"]]]))[0])) for r in made.collect())
    rows = copula.sample_copula(spark, fitted, 200, draws, "t").collect()
    assert sorted(r["_rid"] for r in rows) == list(range(1, 201)) and {r["a"] for r in rows} == set(range(7)) and any(r["b"] is None for r in rows)
