"""Contingency counts over codes, privacy noise, dependence scores and conditional tables.

Every count table is addressed by one flat integer ``cell``.  A *family* is a tuple of columns; its
cells start at its offset and run over the mixed-radix index of the columns' codes.  The last
column of a family is its ``code``, the ones before it make up ``pidx``.  So pairs, histograms
and conditional tables all share one shape,

    (family, pidx, code, cell)

one scan counts all families at once, and the shuffle moves at most one narrow row per non-empty
cell and map task, whatever the number of input rows or however skewed the values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import combinations
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.draws import Draws

CHUNK = 1 << 16
LOG_FLOOR = 1e-15


@dataclass(frozen=True)
class Family:
    name: str
    columns: tuple[str, ...]
    sizes: tuple[int, ...]
    offset: int

    @property
    def cells(self) -> int:
        return prod(self.sizes)

    def flat(self, code=F.col) -> Column:
        """Cell index of a row, from a function that gives the code of a column."""
        index = F.lit(0).cast("bigint")
        for column, size in zip(self.columns, self.sizes):
            index = index * size + code(column)
        return index + self.offset


    def flat_sql(self) -> str:
        """The same over encoded columns, as text: one expression to send, however many families."""
        index = "0L"
        for column, size in zip(self.columns, self.sizes):
            quoted = column.replace("`", "``")
            index = f"({index} * {size} + `{quoted}`)"
        return f"{index} + {self.offset}L"


def layout(families: Sequence[Sequence[str]], sizes: Mapping[str, int]) -> list[Family]:
    """Place families one after another in one cell space, however large: cells only ever live in DataFrames."""
    out, offset = [], 0
    for columns in families:
        out.append(Family("|".join(columns), tuple(columns), tuple(sizes[c] for c in columns), offset))
        offset += out[-1].cells
    return out


def cell_counts(codes: DataFrame, families: Sequence[Family]) -> DataFrame:
    """(cell, cnt) of all families in one pass over the rows.

    Each row is multiplied by the number of families, but only as one integer each, and partial
    aggregation shrinks them to the non-empty cells before the shuffle.
    """
    cells = codes.select(F.expr(f"explode(array({', '.join(f.flat_sql() for f in families)}))").alias("cell"))
    return cells.groupBy("cell").agg(F.count(F.lit(1)).alias("cnt"))


def cell_grid(spark: SparkSession, families: Sequence[Family]) -> DataFrame:
    """Every cell of every family, empty ones too: (family, pidx, code, cell).

    Families are cut into chunks of cells that are dealt out to tasks before their cells are listed.
    """
    rows = [(f.name, f.offset, f.cells, f.sizes[-1]) for f in families]
    chunks = (spark.createDataFrame(rows, "family string, _offset bigint, _cells bigint, _width bigint")
              .withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_cells") - 1, F.lit(CHUNK).cast("bigint")))))
    parts = max(spark.sparkContext.defaultParallelism, sum(-(-f.cells // CHUNK) for f in families) // 8)
    upto = F.least(F.col("_from") + CHUNK, F.col("_cells")) - 1
    return (chunks.repartition(parts).withColumn("_at", F.explode(F.sequence("_from", upto)))
            .select("family", F.floor(F.col("_at") / F.col("_width")).alias("pidx"), (F.col("_at") % F.col("_width")).cast("int").alias("code"),
                    (F.col("_offset") + F.col("_at")).alias("cell")))


def dense_counts(spark: SparkSession, families: Sequence[Family], counts: DataFrame) -> DataFrame:
    """Counts on the full grid, 0 where no row fell: the only safe start for noise."""
    return (cell_grid(spark, families).join(counts, "cell", "left")
            .withColumn("cnt", F.coalesce("cnt", F.lit(0)).cast("bigint")))


def frequencies(counts: DataFrame, by: Sequence[str] = ("family",)) -> DataFrame:
    return counts.withColumn("freq", F.try_divide("cnt", F.sum("cnt").over(Window.partitionBy(*by))))


def noise_scale(n, eps) -> Column:
    """Laplace scale of a frequency: one row changes it by 1/n."""
    n = n if isinstance(n, Column) else F.lit(n)
    return (1.0 / n) / F.greatest(eps if isinstance(eps, Column) else F.lit(float(eps)), F.lit(1e-12))


def add_noise(df: DataFrame, value: str, scale: Column, draws: Draws, tag: str) -> DataFrame:
    return df.withColumn("noisy", F.col(value) + draws.laplace(scale, tag, F.col("family"), F.col("pidx"), F.col("code")))


def clip_normalize(df: DataFrame, by: Sequence[str] = ("family",), uniform_if_empty: bool = False) -> DataFrame:
    """Negative cells to 0, then shares that sum to 1; an all-zero group stays 0 or turns uniform."""
    group = Window.partitionBy(*by)
    clipped = df.withColumn("_pos", F.greatest(F.col("noisy"), F.lit(0.0)))
    total = F.sum("_pos").over(group)
    empty = 1.0 / F.count(F.lit(1)).over(group) if uniform_if_empty else F.lit(0.0)
    return clipped.withColumn("p", F.when(total > 0, F.col("_pos") / total).otherwise(empty)).drop("_pos")


def noisy_marginals(dense: DataFrame, n, eps, draws: Draws) -> DataFrame:
    """Frequencies of each family plus Laplace noise, clipped and renormalised."""
    freq = dense.withColumn("freq", F.col("cnt") / (n if isinstance(n, Column) else F.lit(n)))
    return clip_normalize(add_noise(freq, "freq", noise_scale(n, eps), draws, "marginal"))


def mutual_information(marginals: DataFrame, p: str = "p") -> DataFrame:
    """(family, mi) of two-column families, cells floored at 1e-15."""
    floored = marginals.withColumn("_p", F.greatest(F.col(p), F.lit(LOG_FLOOR)))
    px = F.sum("_p").over(Window.partitionBy("family", "pidx"))
    py = F.sum("_p").over(Window.partitionBy("family", "code"))
    term = F.col("_p") * F.log(F.col("_p") / (F.col("_px") * F.col("_py") + LOG_FLOOR) + LOG_FLOOR)
    return (floored.withColumn("_px", px).withColumn("_py", py)
            .groupBy("family").agg(F.sum(term).alias("mi")))


def symmetric_scores(mi: DataFrame) -> DataFrame:
    """(a, b, mi) in both directions."""
    names = F.split("family", r"\|")
    return mi.select(F.inline(F.array(
        F.struct(names[0].alias("a"), names[1].alias("b"), F.col("mi")),
        F.struct(names[1].alias("a"), names[0].alias("b"), F.col("mi")))))


def rank_root(scores: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The column with the largest total score; the earlier column on ties."""
    return _best(scores, columns)


def rank_next(scores: DataFrame, columns: Sequence[str], chosen: Sequence[str], max_parents: int) -> DataFrame:
    """The unchosen column with the largest score against the last ``max_parents`` chosen."""
    recent = list(chosen)[-max_parents:]
    return _best(scores.filter(F.col("b").isin(recent) & ~F.col("a").isin(list(chosen))), columns)


def _best(scores: DataFrame, columns: Sequence[str]) -> DataFrame:
    ordinal = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("a"))
    return (scores.groupBy("a").agg(F.sum("mi").alias("score")).withColumn("ordinal", ordinal)
            .orderBy(F.desc(F.round("score", 12)), "ordinal").limit(1)
            .select(F.col("a").alias("column_name"), "score"))


def greedy_network(columns: Sequence[str], scores: Mapping[tuple[str, str], float],
                   max_parents: int) -> list[tuple[str, tuple[str, ...]]]:
    """[(column, parents)]: steps of ``rank_root`` and ``rank_next`` over the collected k x k scores."""
    def score(c, others):
        return round(sum(scores.get((c, o), 0.0) for o in others if o != c), 12)

    network: list[tuple[str, tuple[str, ...]]] = []
    left = list(columns)
    while left:
        recent = [c for c, _ in network][-max_parents:] if network and max_parents else []
        pick = max(left, key=lambda c: score(c, recent if network else columns))
        network.append((pick, tuple(recent)))
        left.remove(pick)
    return network


def cpt_families(network: Sequence[tuple[str, Sequence[str]]], sizes: Mapping[str, int]) -> list[Family]:
    """One family (parents.., child) per column, named after the child."""
    placed = layout([(*parents, child) for child, parents in network], sizes)
    return [Family(child, f.columns, f.sizes, f.offset) for (child, _), f in zip(network, placed)]


def conditional_tables(dense: DataFrame, n, eps, draws: Draws, noise_on: str = "joint") -> DataFrame:
    """(family, pidx, code, p): noisy probabilities of each child code per parent combination.

    ``joint``: noise of scale 1/eps on the joint counts, where one row changes one cell by 1, then
    rows are normalised.  ``row``: noise of scale 1/(n eps) on rows that are already normalised,
    which is kept for comparison only: its noise is too small for the claimed privacy.
    """
    row = Window.partitionBy("family", "pidx")
    if noise_on == "joint":
        scale = 1.0 / F.greatest(eps if isinstance(eps, Column) else F.lit(float(eps)), F.lit(1e-12))
        noisy = add_noise(dense.withColumn("_v", F.col("cnt").cast("double")), "_v", scale, draws, "cpt")
    elif noise_on == "row":
        total = F.sum("cnt").over(row)
        share = F.when(total > 0, F.col("cnt") / total).otherwise(0.0)
        noisy = add_noise(dense.withColumn("_v", share), "_v", noise_scale(n, eps), draws, "cpt")
    else:
        raise ValueError(f"unknown noise placement {noise_on!r}")
    return clip_normalize(noisy, ("family", "pidx"), uniform_if_empty=True).drop("_v", "noisy")


def cdf_rows(cpt: DataFrame) -> DataFrame:
    """(family, pidx, cdf array): running sums in code order of probabilities cut to 12 digits."""
    upto = Window.partitionBy("family", "pidx").orderBy("code").rowsBetween(Window.unboundedPreceding, 0)
    return (cpt.withColumn("_cum", F.sum(F.round("p", 12)).over(upto))
            .groupBy("family", "pidx")
            .agg(F.sort_array(F.collect_list(F.struct("code", "_cum"))).alias("_c"))
            .select("family", "pidx", F.transform("_c", lambda x: x["_cum"]).alias("cdf")))


def all_pairs(columns: Sequence[str]) -> list[tuple[str, str]]:
    return list(combinations(columns, 2))
