"""Connected components of a table of links, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node that links reach, for every node that has a link.

    Each round takes the least label among a node's neighbours and then the label of that label, so
    the number of rounds grows with the logarithm of a component's width.  Labels meet as minima with
    partial aggregation; a hub with very many links is one group of one value per task.  Links and
    labels stay partitioned by node, so a round shuffles only the minima and the jumps.
    """
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y")).union(links.select(F.col(b), F.col(a)))
    edges = written(both.groupBy("y", "x").agg(F.lit(1).alias("one")).select("x", "y"))
    labels = written(edges.groupBy(F.col("y").alias("node")).agg(F.min("x").alias("x")).select("node", F.least("node", "x").alias("root")))
    while True:
        near = (edges.join(labels.withColumnsRenamed({"node": "y"}), "y").groupBy(F.col("x").alias("node"))
                .agg(F.min("root").alias("near")))
        closer = written(labels.join(near, "node").select("node", F.least("root", "near").alias("via"), F.col("root").alias("old")))
        if closer.filter(F.col("via") != F.col("old")).isEmpty():
            return closer.select("node", F.col("via").alias("root"))
        jumped = closer.join(closer.select(F.col("node").alias("via"), F.col("via").alias("far")), "via")
        labels = written(jumped.groupBy("node").agg(F.min("far").alias("root")))


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Roots after further links: only the groups that these connect are worked on."""
    of = {x: roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab"}
    between = (links.join(of["a"], "a", "left").join(of["b"], "b", "left")
               .select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).filter("a <> b"))
    joined = components(between)
    known = roots.join(joined.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    moved = known.select("node", F.coalesce("top", "root").alias("root"))
    return written(moved.union(joined.join(roots, "node", "left_anti")))
