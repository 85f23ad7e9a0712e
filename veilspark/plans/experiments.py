"""Experiment grids: methods against datasets and budgets, ablations, growth, summaries."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scaling import cut
from ..schema import RelationalSchema
from ..sources.datasets import load_dataset
from ..sources.io import collect_sizes, union_all
from .report import evaluate_all
from .results import ResultTable, run_id
from .synthesis import Settings, ablations, equal_split, independent, non_private, synthesize

Tables = Mapping[str, DataFrame]
Score = Callable[[Tables, Tables, RelationalSchema], DataFrame]
SUMMARY_METRICS = ("fk_consistency.overall", "query_accuracy.query_error_avg", "query_accuracy.query_error_1way",
                   "query_accuracy.query_error_2way", "marginal_tv_avg.average", "ml_utility.accuracy_syn",
                   "ml_utility.f1_syn")


def methods(s: Settings) -> dict[str, Settings]:
    return {"full": s, "equal_split": equal_split(s), "independent": independent(s)}


@dataclass(frozen=True)
class Run:
    """One synthesis to be measured: ``make`` gives its tables, materialised, ``inputs`` is what they depend on
    besides the tags, for telling a committed run from one with other options."""

    tags: Mapping
    make: Callable[[], Tables]
    real: Tables
    schema: RelationalSchema
    settings: Settings
    seed: int
    inputs: tuple = ()

    def name(self, evaluation: Mapping) -> str:
        return run_id(self.tags, self.inputs or self.settings, self.seed, sorted((k, repr(v)) for k, v in evaluation.items()))


def measured(run: Run, score: Score | None = None, **evaluation) -> DataFrame:
    """Long metric rows of one run, tagged, with the seconds the synthesis took.

    ``score`` (real, synthetic, schema) gives the rows (scope, metric, value); by default the full report.
    """
    begin = time.monotonic()
    syn = run.make()
    seconds = round(time.monotonic() - begin, 2)
    report = (score(run.real, syn, run.schema) if score else
              evaluate_all(run.real, syn, run.schema, run.settings.num_queries, run.settings.query_types, seed=run.seed, **evaluation))
    return report.select(*[F.lit(v).alias(k) for k, v in run.tags.items()], F.lit(seconds).alias("time_sec"),
                         F.concat_ws(".", "scope", "metric").alias("metric"), "value")


def play(spark: SparkSession, runs: Sequence[Run], path: str | None = None, score: Score | None = None,
         **evaluation) -> DataFrame:
    """Metric rows of all runs.  With a ``path``, each run is committed there when it is measured, and
    runs that an earlier call committed are read instead of repeated."""
    if path is None:
        return union_all([cut(measured(run, score, **evaluation)) for run in runs])
    results = ResultTable(spark, path)
    options = {**evaluation, **({"score": score.__qualname__} if score else {})}
    done, names = results.committed(), [run.name(options) for run in runs]
    for name, run in zip(names, runs):
        if name not in done:
            results.commit(name, measured(run, score, **evaluation))
            done.add(name)
    return results.read(names)


def grid_runs(dataset: str, real: Tables, schema: RelationalSchema, epsilons: Sequence[float], num_runs: int,
              s: Settings = Settings(), base_seed: int = 42, with_non_private: bool = True,
              chosen: Sequence[str] | None = None) -> list[Run]:
    """Every method (or the ``chosen`` ones) at every budget and repetition, seeded by the repetition,
    plus the non-private baseline once."""
    runs = []
    for eps in epsilons:
        for i in range(num_runs):
            for method, settings in methods(replace(s, eps_total=float(eps), seed=base_seed + i)).items():
                if chosen is None or method in chosen:
                    runs.append(Run({"dataset": dataset, "method": method, "epsilon": float(eps), "run": i},
                                    lambda c=settings: synthesize(real, schema, c).tables, real, schema, settings, base_seed + i))
    if with_non_private:
        runs.append(Run({"dataset": dataset, "method": "non_private", "epsilon": float("inf"), "run": 0},
                        lambda: non_private(real, schema, base_seed), real, schema, s, base_seed))
    return runs


def run_grid(spark: SparkSession, datasets: Sequence[str], epsilons: Sequence[float], num_runs: int,
             s: Settings = Settings(), base_seed: int = 42, data_dir: str | None = None,
             with_non_private: bool = True, path: str | None = None, **evaluation) -> DataFrame:
    """Every method on every named dataset, budget and repetition, plus the non-private baseline once
    per dataset, as long rows (dataset, method, epsilon, run, time_sec, metric, value).

    ``path``: see ``play``; a grid that was stopped goes on where it was.
    """
    runs = []
    for name in datasets:
        real, schema = load_dataset(spark, name, data_dir)
        runs += grid_runs(name, real, schema, epsilons, num_runs, s, base_seed, with_non_private)
    return play(spark, runs, path, **evaluation)


def run_ablations(real: Tables, schema: RelationalSchema, s: Settings = Settings(), label: str = "",
                  path: str | None = None, **evaluation) -> DataFrame:
    """The full method and its variants with one part left out, as long metric rows."""
    spark = next(iter(real.values())).sparkSession
    runs = [Run({"dataset": label, "ablation": name, "epsilon": s.eps_total},
                lambda c=chosen: synthesize(real, schema, c).tables, real, schema, chosen, int(s.seed))
            for name, chosen in ablations(s).items()]
    return play(spark, runs, path, **evaluation)


def scalability_study(spark: SparkSession, table_counts: Sequence[int] = (2, 4, 8, 16, 32), s: Settings = Settings(),
                      fact_rows: Sequence[int] = (2000,), path: str | None = None, **evaluation) -> DataFrame:
    """Star schemas of growing width, and of growing fact tables, through the full method."""
    full = ablations(s)["full"]
    asked = replace(s, num_queries=50, query_types=("1way", "2way", "cross_table"))
    runs = []
    for dims in table_counts:
        for facts in fact_rows:
            real, schema = load_dataset(spark, "synthetic_star", num_dimension_tables=dims, dim_rows=100,
                                        fact_rows=facts)
            runs.append(Run({"num_dim_tables": dims, "total_tables": dims + 1, "fact_rows": facts, "epsilon": s.eps_total},
                            lambda r=real, k=schema: synthesize(r, k, full).tables, real, schema, asked, int(s.seed), (full, asked)))
    return play(spark, runs, path, **evaluation)


def growth_runs(tables: Tables, schema: RelationalSchema, factors: Sequence[int] = (1, 2, 4), s: Settings = Settings()) -> list[Run]:
    """The full method on the given tables drawn at 1, 2, 4.. times their rows."""
    sizes = collect_sizes(tables)
    runs = []
    for factor in factors:
        grown = replace(s, row_counts={n: rows * factor for n, rows in sizes.items()})
        runs.append(Run({"factor": factor, "total_rows": sum(sizes.values()) * factor},
                        lambda c=grown: synthesize(tables, schema, c).tables, tables, schema, grown, int(s.seed)))
    return runs


def growth_exponent(records: DataFrame, size: str, cost: str, by: Sequence[str] = ()) -> DataFrame:
    """(by.., exponent, n_points): how ``cost`` grows with ``size``, as the slope of their logarithms.

    1 is linear.  Records without a positive size and cost are left out; the exponent of fewer than
    two different sizes is null.
    """
    positive = records.filter((F.col(size) > 0) & (F.col(cost) > 0))
    x, y = F.log(F.col(size).cast("double")), F.log(F.col(cost).cast("double"))
    return (positive.groupBy(*by)
            .agg(F.when(F.count_distinct(size) > 1, F.regr_slope(y, x)).alias("exponent"), F.count(F.lit(1)).alias("n_points")))


def widen(long: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per run, one column per metric."""
    return long.groupBy(*keys).pivot("metric", list(metrics)).agg(F.first("value"))


def grid_summary(records: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Means of the metrics by (dataset, method, epsilon) and by method alone, rounded to 4 digits,
    from one aggregation.  ``level`` tells the two apart."""
    sets = [[F.col("dataset"), F.col("method"), F.col("epsilon")], [F.col("method")]]
    means = [F.round(F.avg(m), 4).alias(m) for m in metrics]
    return (records.groupingSets(sets, "dataset", "method", "epsilon")
            .agg(F.grouping("dataset").alias("_g"), *means)
            .select(F.when(F.col("_g") == 1, "method").otherwise("run").alias("level"),
                    "dataset", "method", "epsilon", *metrics))
