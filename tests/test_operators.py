"""Properties and edge cases of single operators, on small fixtures with brute force answers."""

import itertools
import math
import random

import numpy as np
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from veilspark.functions.draws import Draws, normal_quantile, weighted_choice_draw
from veilspark.functions.scaling import dense_ordinal, running_total
from veilspark.operators import budget as B
from veilspark.operators import marginals as M
from veilspark.operators.assign import assign_one_to_one, match
from veilspark.operators.encode import fit_codec
from veilspark.operators.fidelity import kway_error, tv_categorical, tv_numeric
from veilspark.operators.integrity import fk_report, repair_foreign_key
from veilspark.operators.model import fit_table
from veilspark.operators.nearest import cell_tree, nearest_parents
from veilspark.operators.sample import bootstrap, draw_keys, sample_table, stratified_split
from veilspark.operators.utility import chain_join, pick_target
from veilspark.schema import ForeignKey, parse_schema

D = Draws(7)


def meta(tables, fks):
    return parse_schema({"tables": {t: {"attributes": list(c), "dtypes": c, "primary_key": None} for t, c in tables.items()},
                         "foreign_keys": [dict(zip(("child_table", "parent_table", "child_col", "parent_col"), f)) for f in fks]})


def test_schema_order_chain_and_cycle():
    s = meta({t: {"k": "categorical"} for t in "abcd"}, [("b", "a", "k", "k"), ("c", "b", "k", "k"), ("d", "a", "k", "k")])
    assert s.topological_order() == ["a", "b", "d", "c"]
    assert [f.child_table for f in s.longest_chain()] == ["b", "c"]
    with pytest.raises(ValueError):
        replace(s, foreign_keys=(*s.foreign_keys, ForeignKey("a", "c", "k", "k"))).topological_order()
    with pytest.raises(ValueError):
        replace(s, foreign_keys=(ForeignKey("a", "nowhere", "k", "k"),))


@pytest.mark.parametrize("generator", ["md5", "xxhash64"])
def test_draws_are_uniform_and_do_not_depend_on_partitions(spark, generator):
    d = Draws(1, generator)
    u = F.floor(d.uniform("t", F.col("id")) * 100).alias("b")
    one = spark.range(20000).repartition(3).select("id", u)
    other = spark.range(20000).repartition(17).select("id", u)
    assert one.exceptAll(other).isEmpty()
    counts = [r["count"] for r in one.groupBy("b").count().collect()]
    chi2 = sum((c - 200) ** 2 / 200 for c in counts)
    assert len(counts) == 100 and chi2 < 160


def test_laplace_scale_and_normal_quantile(spark):
    row = spark.range(20000).select(F.avg(F.abs(D.laplace(3.0, F.col("id")))).alias("a")).first()
    assert abs(row["a"] - 3.0) < 0.15
    z = spark.createDataFrame([(0.025,), (0.5,), (0.975,), (0.001,)], "p double").select(normal_quantile(F.col("p")))
    assert np.allclose([r[0] for r in z.collect()], [-1.959964, 0.0, 1.959964, -3.090232], atol=1e-5)


def test_weighted_choice(spark):
    got = spark.range(10000).select(weighted_choice_draw(D.uniform(F.col("id")), ["a", "b", "c"], [0.6, 0.3, 0.1]).alias("v"))
    shares = {r["v"]: r["count"] / 10000 for r in got.groupBy("v").count().collect()}
    assert abs(shares["a"] - 0.6) < 0.03 and abs(shares["c"] - 0.1) < 0.02


def test_ordinals_and_running_totals(spark):
    rows = [(random.Random(i).choice(["hot", f"k{i}"]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i bigint")
    got = {(r["k"], r["i"]): r["o"] for r in dense_ordinal(df, ["k", "i"], "o").collect()}
    assert got == {r: n for n, r in enumerate(sorted(rows))}
    totals = running_total(df.withColumn("w", F.lit(2)), "w", F.floor(F.col("i") / 37), ["i"], "t").collect()
    assert all(r["t"] == 2 * r["i"] for r in totals)


# --- budget -----------------------------------------------------------------------------------

def stats(spark, n=4):
    s = meta({f"t{i}": {f"c{j}": "categorical" for j in range(i + 1)} for i in range(n)}, [("t1", "t0", "c0", "c0")])
    sizes = spark.createDataFrame([(f"t{i}", 10 ** (i + 1)) for i in range(n)], "table_name string, n_rows bigint")
    return B.table_stats(spark, s, sizes)


def workload(spark, rows):
    return spark.createDataFrame(rows, "qid int, tables array<string>, `order` int, weight double")


@pytest.mark.parametrize("method", ["equal", "proportional", "analytical", "maxmin"])
def test_budgets_sum_and_stay_positive(spark, method):
    w = workload(spark, [(1, ["t0"], 1, 1.0), (2, ["t1", "t2"], 2, 0.9), (3, ["nope"], 1, 1.0)])
    got = {r["table_name"]: r["eps"] for r in B.allocate(method, stats(spark), w, 2.0, 0.05).collect()}
    assert math.isclose(sum(got.values()), 2.0, abs_tol=1e-9) and min(got.values()) > 0
    none = B.allocate(method, stats(spark), None, 2.0, 0.05).agg(F.sum("eps")).first()[0]
    assert math.isclose(none, 2.0, abs_tol=1e-9)


def table_sets(spark, rows):
    return spark.createDataFrame(rows, "tables array<string>, weight double")


def test_maxmin_of_disjoint_sets(spark):
    """Disjoint sets share the total by their weights: z (1 + 0.2 + 1) = 1."""
    sets = table_sets(spark, [(["a"], 1.0), (["b"], 0.2), (["c", "d"], 1.0)])
    alloc, low, high = B.maxmin_allocation(sets, ["a", "b", "c", "d"], 1.0, 0.01)
    assert low == pytest.approx(1 / 2.2, rel=1e-5) and low <= high <= low * (1 + 1e-5)
    assert alloc == pytest.approx([1 / 2.2, 0.2 / 2.2, 0.5 / 2.2, 0.5 / 2.2], rel=1e-4)


def test_maxmin_floors_bind(spark):
    alloc, low, high = B.maxmin_allocation(table_sets(spark, [(["a"], 1.0)]), ["a", "b", "c"], 1.0, 0.2)
    assert alloc == pytest.approx([0.6, 0.2, 0.2], rel=1e-4) and low == pytest.approx(0.6, rel=1e-5)


def test_maxmin_of_overlapping_sets(spark):
    """All pairs of four tables, and one table asked for alone: the optimum by hand is a = 2x, others x."""
    pairs = [([a, b], 1.0) for a, b in itertools.combinations("abcd", 2)] + [(["a"], 1.0)]
    alloc, low, _ = B.maxmin_allocation(table_sets(spark, pairs), list("abcd"), 1.0, 0.0)
    assert low == pytest.approx(0.4, rel=1e-5) and alloc == pytest.approx([0.4, 0.2, 0.2, 0.2], rel=1e-3)


def test_maxmin_of_very_many_sets(spark):
    """200,000 distinct sets: within the tolerance of an upper bound, in few rounds, without another way beyond a size."""
    names = [f"t{i}" for i in range(40)]
    u = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(40)) for i in range(6)]
    sets = (spark.range(230_000).select(F.array_sort(F.array_distinct(F.array(*[F.concat(F.lit("t"), x.cast("string")) for x in u]))).alias("tables"),
                                        (0.5 + F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("weight"))
            .groupBy("tables").agg(F.max("weight").alias("weight")).cache())
    assert sets.count() > 200_000
    alloc, low, high = B.maxmin_allocation(sets, names, 1.0, 0.001)
    assert sum(alloc) == pytest.approx(1) and min(alloc) >= 0.001 and 0 <= high - low <= 1e-6 * high
    assert low > B.worst_served(sets, dict.fromkeys(names, 1 / 40), 1)[0]["served"]


def test_unknown_names_are_errors(spark):
    with pytest.raises(ValueError):
        B.allocate("nonsense", stats(spark), None, 1.0)


# --- encoding ---------------------------------------------------------------------------------

def test_codec_nulls_nan_constant_and_empty(spark):
    df = spark.createDataFrame([(1.0, "a", 5.0), (float("nan"), None, 5.0), (None, "b", 5.0), (9.0, "a", 5.0)],
                               "x double, c string, k double")
    roles = {"x": "numerical", "k": "numerical"}
    compat = fit_codec(df, roles, num_bins=4, null_policy="compat").encode(df).collect()
    assert [r["x"] for r in compat] == [0, 3, 3, 3] and [r["c"] for r in compat] == [0, 0, 1, 0]
    own = fit_codec(df, roles, num_bins=4)
    coded = own.encode(df)
    assert [r["x"] for r in coded.collect()] == [0, 3, 4, 3] and [r["c"] for r in coded.collect()] == [0, 2, 1, 0]
    back = own.decode(coded).collect()
    assert back[2]["x"] is None and back[1]["c"] is None and all(abs(r["k"] - 5.0) < 1e-6 for r in back)
    empty = df.filter("false")
    assert fit_codec(empty, roles, num_bins=4).encode(empty).count() == 0


def test_top_categories_and_other(spark):
    df = spark.createDataFrame([(str(i % 7 if i < 70 else i),) for i in range(90)], "c string")
    codec = fit_codec(df, {}, num_bins=8).columns["c"]
    assert codec.capped and codec.values == [str(i) for i in range(7)] and codec.size == 8
    ints = spark.createDataFrame([(i,) for i in (10, 9, 2)], "c int")
    assert fit_codec(ints, {}).columns["c"].values == ["2", "9", "10"]


# --- model and samples ------------------------------------------------------------------------

def skewed(spark, n=3000):
    return spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), (F.col("id") % 5).cast("string"))).alias("c"),
                                 (F.col("id") % 3).cast("string").alias("d"), (F.col("id") % 50).cast("double").alias("x"))


@pytest.mark.parametrize("noise_on", ["joint", "row"])
def test_model_rows_sum_to_one_and_samples_follow_them(spark, noise_on):
    df = skewed(spark)
    model = fit_table(df, "t", {"x": "numerical"}, 200.0, 3000, num_bins=8, max_parents=2, noise_on=noise_on, draws=D)
    sums = model.cpt.groupBy("family", "pidx").agg(F.sum("p").alias("s"), F.min("p").alias("m")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 and r["m"] >= 0 for r in sums)
    syn = sample_table(spark, model, 3000, D)
    assert syn.columns == ["_rid", "c", "d", "x"] and syn.count() == 3000
    tv = {r["column_name"]: r["tv"] for r in tv_categorical(df, syn, ["c", "d"]).collect()}
    assert max(tv.values()) < 0.05
    joint = kway_error(df, syn, ["c", "d"]).first()["error"]
    assert joint < 0.02
    again = sample_table(spark, model, 3000, D)
    assert syn.exceptAll(again.repartition(13)).isEmpty()


def test_more_budget_means_less_error(spark):
    df = skewed(spark)
    errors = []
    for eps in (0.05, 100.0):
        model = fit_table(df, "t", {"x": "numerical"}, eps, 3000, num_bins=8, max_parents=2, draws=D)
        errors.append(kway_error(df, sample_table(spark, model, 3000, D), ["c", "d"]).first()["error"])
    assert errors[1] < errors[0]


def test_one_column_table(spark):
    model = fit_table(skewed(spark).select("c"), "t", {}, 1.0, 3000, draws=D)
    assert sample_table(spark, model, 10, D).count() == 10


def test_more_columns_leave_other_families_as_they_are(spark):
    columns = [f"c{i}" for i in range(6)]
    df = spark.range(500).select(*[(F.pmod(F.hash("id", F.lit(i)), F.lit(32))).cast("string").alias(c) for i, c in enumerate(columns)])
    network = [(c, tuple(columns[max(0, i - 3):i])) for i, c in enumerate(columns)]
    sizes = {c: 32 for c in columns}
    five, six = M.cpt_families(network[:5], sizes), M.cpt_families(network, sizes)
    assert five == six[:5] and [len(f.columns) for f in six] == [1, 2, 3, 4, 4, 4]
    model = fit_table(df.select(columns[:5]), "t", {}, 1.0, 500, draws=D, network=network[:5])
    assert model.cpt.filter("family = 'c4'").count() == 32**4


def test_wide_table_fits(spark):
    df = spark.range(40).select(*[((F.col("id") * (i + 3)) % 3).cast("string").alias(f"c{i}") for i in range(120)])
    model = fit_table(df, "t", {}, 1.0, 40, num_bins=4, max_parents=1, draws=D)
    assert len(model.families) == 120 and all(len(f.columns) == 2 for f in model.families[1:])


def test_drawn_keys_follow_repetition(spark):
    keys = [(1,)] * 600 + [(i,) for i in range(2, 1202)] + [(None,)] * 50
    parent = spark.createDataFrame(keys, "k bigint")
    got = draw_keys(spark.range(9000), parent, "k", D.uniform("x", F.col("id")), "fk")
    assert got.count() == 9000 and got.filter("fk is null").isEmpty()
    assert abs(got.filter("fk = 1").count() / 9000 - 1 / 3) < 0.03
    assert got.select("fk").distinct().join(parent, F.col("fk") == F.col("k"), "left_anti").isEmpty()
    nobody = draw_keys(spark.range(5), parent.filter("false"), "k", D.uniform(F.col("id")), "fk")
    assert nobody.count() == 5 and nobody.filter("fk is not null").isEmpty()


def test_bootstrap_and_split(spark):
    df = spark.range(400).select("id", F.when(F.col("id") == 7, "single").when(F.col("id") % 3 == 0, "a").otherwise("b").alias("y"))
    drawn = bootstrap(df.withColumnRenamed("id", "rid0"), "rid0", D)
    assert drawn.count() == 400 and drawn.select("rid0").distinct().count() < 400
    parts = stratified_split(df, "y", "id", D, 0.3).groupBy("y").agg(F.count("*").alias("n"), F.sum(F.col("is_test").cast("int")).alias("t"))
    got = {r["y"]: (r["n"], r["t"]) for r in parts.collect()}
    assert got["single"] == (1, 0) and all(t == round(n * 0.3) for y, (n, t) in got.items() if y != "single")


# --- integrity --------------------------------------------------------------------------------

def test_null_parent_keys_are_ignored_and_hot_keys_are_repaired(spark):
    parent = spark.createDataFrame([(i,) for i in range(20)] + [(None,)], "p bigint")
    child = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, -5).when(F.col("id") % 10 == 1, None).otherwise(F.col("id") % 20).alias("fk"))
    report = fk_report(child, "fk", parent, "p", "x").first()
    want = sum(1 for i in range(900) if i % 3 == 0 or i % 10 == 1)
    assert (report["total_rows"], report["violations"]) == (900, want)
    for method in ("random", "mode"):
        fixed = repair_foreign_key(child, "fk", parent, "p", "id", D, method)
        assert fixed.count() == 900 and fk_report(fixed, "fk", parent, "p", "x").first()["violations"] == 0
    assert repair_foreign_key(child, "fk", parent.filter("false"), "p", "id", D).count() == 900


def test_keys_of_different_types(spark):
    parent = spark.createDataFrame([(i,) for i in range(5)], "p bigint")
    child = spark.createDataFrame([("1",), ("4",), ("__OTHER__",), (None,)], "fk string").withColumn("id", F.monotonically_increasing_id())
    assert fk_report(child, "fk", parent, "p", "x").first()["violations"] == 2
    fixed = repair_foreign_key(child, "fk", parent, "p", "id", D)
    assert fixed.count() == 4 and fk_report(fixed, "fk", parent, "p", "x").first()["violations"] == 0
    assert kway_error(parent.select(F.col("p").alias("fk")), child, ["fk"]).first()["cells"] == 6


@pytest.mark.parametrize("shape", ["spread", "copies", "outlier", "line"])
@pytest.mark.parametrize("k", [1, 4])
def test_nearest_is_exact(spark, shape, k):
    rng = random.Random(3)

    def point(i):
        if shape == "copies" and i % 3 == 0:
            return 1.0, 2.0
        if shape == "outlier" and i == 5:
            return 1e6, -1e6
        return (0.0, rng.random()) if shape == "line" else (rng.gauss(0, 1), rng.gauss(0, 1))
    parents = [(i, *point(i)) for i in range(300)]
    kids = [(i, *point(i)) for i in range(60)] + [(60, 50.0, 50.0), (61, None, float("nan"))]
    p = spark.createDataFrame(parents, "pid bigint, x double, y double")
    c = spark.createDataFrame(kids, "cid bigint, x double, y double")
    got = {}
    for r in nearest_parents(c, "cid", p, "pid", ["x", "y"], k).collect():
        got.setdefault(r["cid"], []).append((r["rank"], r["parent_id"]))
    for cid, x, y in kids:
        x, y = x or 0.0, 0.0 if y is None or y != y else y
        want = sorted(((x - px) * (x - px) + (y - py) * (y - py), pid) for pid, px, py in parents)[:k]
        assert [pid for _, pid in sorted(got[cid])] == [pid for _, pid in want]


@pytest.mark.parametrize("features", [1, 2, 3])
def test_candidates_stay_few_as_parents_grow(spark, features):
    """Ten times the parents, the same number of candidates per child, for children inside, at the rim and far outside."""
    met = {}
    fs = [f"_f{i}" for i in range(features)]
    rng = np.random.default_rng(7)
    kids = np.vstack([rng.random((200, features)), 1.5 + rng.random((100, features)), np.full((50, features), 30.0)])
    for n in (3_000, 30_000):
        points = rng.random((n, features))
        folks = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(points)], ", ".join(["parent_id long", *(f"{f} double" for f in fs)])).cache()
        tree, placed, count = cell_tree(folks, fs)
        rows, cells = tree.reach(kids, 1)
        met[n] = tree.count[-cells - 1].sum() / len(kids)
        home = tree.place(points)
        exact = ((kids[:, None] - points[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert count == n and all(home[j] in cells[rows == i] for i, j in enumerate(exact))
    assert met[30_000] < 2.5 * met[3_000] and met[30_000] < 1_500, met


def test_matching_is_optimal():
    rng = np.random.default_rng(0)
    for n, m in ((4, 6), (5, 5), (1, 3)):
        cost = rng.random((n, m)).round(1)
        order = [np.argsort(cost[i], kind="stable") for i in range(n)]
        got = match([cost[i][o] for i, o in enumerate(order)], order, True)
        best = min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))
        assert len(set(got)) == n and math.isclose(sum(cost[i, j] for i, j in enumerate(got)), best, abs_tol=1e-9)


def test_one_to_one_batches(spark):
    parents = spark.createDataFrame([(i, float(i)) for i in range(50)], "pid bigint, x double")
    kids = spark.createDataFrame([(i, 10.0 if i % 3 == 0 else float(i)) for i in range(90)], "cid bigint, x double")
    got = assign_one_to_one(kids, "cid", parents, "pid", ["x"], 40).collect()
    assert len(got) == 90
    for b in (0, 1, 2):
        used = [r["parent_id"] for r in got if r["batch"] == b]
        assert len(used) == len(set(used))
    crowded = assign_one_to_one(kids, "cid", parents.limit(5), "pid", ["x"], 40).collect()
    assert len(crowded) == 90 and len({r["parent_id"] for r in crowded}) <= 5


# --- fidelity ---------------------------------------------------------------------------------

def test_distances_of_same_and_disjoint_tables(spark):
    a = spark.createDataFrame([(1.0, "x"), (2.0, "y"), (None, None)], "n double, c string")
    b = spark.createDataFrame([(100.0, "p"), (101.0, "q")], "n double, c string")

    def tv(r, s):
        return [f(r, s, [c]).first()["tv"] for f, c in ((tv_numeric, "n"), (tv_categorical, "c"))]
    assert tv(a, a) == [0.0, 0.0] and tv(a, b) == [1.0, 1.0]
    none = a.filter("false")
    assert tv(a, none) == [1.0, 1.0] and tv(none, none) == [None, None]
    constant = a.select(F.lit(3.0).alias("n"), F.lit("z").alias("c"))
    assert tv(constant, constant) == [0.0, 0.0]
    assert kway_error(none, a, ["c"]).first()["error"] is None


def test_chain_join_renames_and_target(spark):
    s = meta({"a": {"k": "categorical", "v": "categorical"}, "b": {"k": "categorical", "v": "categorical"}}, [("b", "a", "k", "k")])
    a = spark.createDataFrame([(1, "p"), (2, "q")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z")], "k int, v string")
    joined = chain_join({"a": a, "b": b}, s.longest_chain())
    assert joined.columns == ["k", "v", "v_b"] and joined.count() == 2
    wide = spark.range(100).select("id", (F.col("id") % 3).alias("y"), (F.col("id") % 30).alias("w"))
    assert pick_target(wide) == "y"


def test_split_does_not_depend_on_buckets(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 < 2, "a").when(F.col("id") == 5, "b").otherwise(None).alias("label"))
    one, many = (stratified_split(df, "label", "id", D, 0.3, n) for n in (10**9, 50))
    assert one.exceptAll(many).isEmpty() and many.count() == 3000
