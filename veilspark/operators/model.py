"""Fit the noisy model of one table: codec, network and conditional tables."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import Draws
from ..functions.scaling import cut
from .encode import Codec, fit_codec
from .marginals import (Family, all_pairs, cell_counts, conditional_tables, cpt_families,
                        dense_counts, greedy_network, layout, mutual_information, noisy_marginals,
                        symmetric_scores)

Network = Sequence[tuple[str, tuple[str, ...]]]


@dataclass
class TableModel:
    name: str
    columns: list[str]
    codec: Codec
    network: Network
    families: list[Family]
    cpt: DataFrame
    n_rows: int
    eps: float
    eps_per_release: float
    inputs_public: bool = False
    count_public: bool = False

    def ledger(self) -> list[tuple[str, str, int, float, bool]]:
        """(table, release, n_releases, eps, is_private): what was published and at what price."""
        pairs = len(all_pairs(list(self.codec.columns)))
        k = len(self.codec.columns)
        return [(self.name, "pair marginals", pairs, pairs * self.eps_per_release, True),
                (self.name, "conditional tables", k, k * self.eps_per_release, True),
                (self.name, "bounds and dictionaries", 0, 0.0, self.inputs_public),
                (self.name, "row count", 0, 0.0, self.count_public)]


def release_share(k: int, eps: float) -> float:
    """Budget of one released statistic: k(k-1)/2 marginals (at least one) and k tables."""
    return eps / (max(k * (k - 1) // 2, 1) + k)


def fit_network(codes: DataFrame, sizes: Mapping[str, int], n_rows: int, eps: float, max_parents: int,
                draws: Draws) -> Network:
    """Noisy pair marginals, their k x k scores (the only rows collected), greedy network."""
    columns = list(sizes)
    if len(columns) == 1:
        return [(columns[0], ())]
    families = layout(all_pairs(columns), sizes)
    dense = dense_counts(codes.sparkSession, families, cell_counts(codes, families))
    mi = mutual_information(noisy_marginals(dense, n_rows, eps, draws))
    scores = {(r["a"], r["b"]): r["mi"] for r in symmetric_scores(mi).collect()}
    return greedy_network(columns, scores, max_parents)


def fit_table(df: DataFrame, name: str, dtypes: Mapping[str, str], eps: float, n_rows: int,
              columns: Sequence[str] | None = None, num_bins: int = 32, max_parents: int = 3,
              null_policy: str = "category", noise_on: str = "joint", draws: Draws = Draws(),
              network: Network | None = None, codec: Codec | None = None,
              path: str | None = None, bounds: Mapping[str, tuple[float, float]] | None = None,
              domains: Mapping[str, list[str]] | None = None, nullable: Collection[str] | None = None,
              count_public: bool = False) -> TableModel:
    """Learn a table's model within ``eps``.

    The input is scanned for bounds, dictionaries, pair counts and conditional counts; everything
    that leaves those scans is bounded by the number of cells, which ``num_bins`` and ``max_parents``
    set: every column keeps all its parents, whatever other columns there are.  The conditional tables are
    materialised (at ``path`` as Parquet, else in the checkpoint folder), so sampling never goes
    back to the real data.

    ``bounds``, ``domains`` and ``nullable`` are public knowledge of the columns (see ``fit_codec``);
    if they leave nothing to be read, the ledger lists bounds and dictionaries as private, and so
    the row count if ``count_public`` says that ``n_rows`` was not taken from the table.
    """
    columns = list(columns if columns is not None else df.columns)
    draws = Draws(f"{draws.seed}/{name}", draws.generator)
    if not columns:
        return TableModel(name, [], Codec({}), [], [], None, n_rows, eps, eps, True, count_public)
    inputs_public = codec is None and nullable is not None and set(columns) <= {*(bounds or {}), *(domains or {})}
    codec = codec or fit_codec(df, dtypes, columns, num_bins, null_policy, bounds, domains, nullable)
    codes, sizes = codec.encode(df), codec.sizes
    share = release_share(len(columns), eps)
    if network is None:
        network = fit_network(codes, sizes, max(n_rows, 1), share, max_parents, draws)
    families = cpt_families(network, sizes)
    dense = dense_counts(df.sparkSession, families, cell_counts(codes, families))
    cpt = conditional_tables(dense, max(n_rows, 1), share, draws, noise_on).select("family", "pidx", "code", "p")
    if path:
        cpt.write.mode("overwrite").parquet(path)
        cpt = df.sparkSession.read.parquet(path)
    else:
        cpt = cut(cpt)
    return TableModel(name, columns, codec, network, families, cpt, n_rows, eps, share, inputs_public, count_public)


def fit_codes(codes: DataFrame, sizes: Mapping[str, int], network: Network, n: int | Column, eps: float,
              draws: Draws, noise_on: str = "joint") -> DataFrame:
    """Conditional tables of already encoded columns with a given network, lazily."""
    families = cpt_families(network, sizes)
    dense = dense_counts(codes.sparkSession, families, cell_counts(codes, families))
    return conditional_tables(dense, n, eps, draws, noise_on)
