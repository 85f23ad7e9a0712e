"""Draw synthetic rows from fitted models and fill foreign keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.draws import Draws, index_draw, step_index
from ..functions.scaling import row_ids, running_total
from .marginals import Family, cdf_rows
from .model import TableModel

KEY_BUCKETS = 4096
CELLS_PER_CHUNK = 4096
BROADCAST_BYTES = 32 << 20


def sample_codes(rows: DataFrame, families: Sequence[Family], cpt: DataFrame, draws: Draws,
                 rid: str = "_rid", scope: str = "") -> DataFrame:
    """Add one code column per family, in network order.

    Draws are computed next to the row id; every column then looks up its cumulative row by the
    parents' flat index.  A table of at most ``BROADCAST_BYTES`` (known from its number of cells) is
    broadcast; a larger one is joined by shuffle, where a frequent parent combination is split.
    """
    cdf = cdf_rows(cpt)
    out = rows.select("*", *[draws.uniform("sample", scope, f.name, F.col(rid)).alias(f"_u{i}")
                             for i, f in enumerate(families)])
    for i, f in enumerate(families):
        table = cdf.filter(F.col("family") == f.name)
        u = F.col(f"_u{i}")
        if len(f.columns) == 1:
            out = out.withColumn("_cdf", table.select("cdf").scalar())
        else:
            parents = Family(f.name, f.columns[:-1], f.sizes[:-1], 0)
            lookup = table.select(F.col("pidx").alias("_pidx"), F.col("cdf").alias("_cdf"))
            small = 8 * f.cells + 64 * (f.cells // f.sizes[-1]) <= BROADCAST_BYTES
            out = out.withColumn("_pidx", parents.flat()).join(F.broadcast(lookup) if small else lookup, "_pidx", "left")
        code = step_index(u, F.col("_cdf"), f.sizes[-1])
        out = out.withColumn(f.columns[-1], code.cast("int")).drop("_pidx", "_cdf", f"_u{i}")
    return out


def sample_table(spark: SparkSession, model: TableModel, n: int, draws: Draws,
                 decode: str = "uniform", key: str | None = None) -> DataFrame:
    """``n`` synthetic rows of a table in the original column order, with row id ``_rid`` 1..n.

    ``decode``: numbers anywhere inside their bin (``uniform``) or at its centre (``midpoint``).
    ``key`` names a surrogate primary key column that takes the row id.
    """
    if decode not in ("uniform", "midpoint"):
        raise ValueError(f"unknown decode mode {decode!r}")
    rows = row_ids(spark, n)
    if model.columns:
        codes = sample_codes(rows, model.families, model.cpt, draws, scope=model.name)
        rows = model.codec.decode(codes, ["_rid"], draws if decode == "uniform" else None,
                                  scope=model.name, order=model.columns)
    if key:
        rows = rows.withColumn(key, F.col("_rid"))
    return rows


def key_weights(parent: DataFrame, key: str) -> DataFrame:
    """(key, _w): distinct non-null keys and their rows; a key with a third of all rows is one row
    from here on."""
    return (parent.select(F.col(key).alias("key")).filter(F.col("key").isNotNull())
            .groupBy("key").agg(F.count(F.lit(1)).alias("_w")))


def key_intervals(weights: DataFrame, buckets: int = KEY_BUCKETS) -> DataFrame:
    """(key, start, stop): each key owns as many positions as it has rows.

    The order is by a hash bucket and then by key, numbered as a two-level prefix sum.
    """
    bucket = F.conv(F.substring(F.md5(F.col("key").cast("string")), 1, 8), 16, 10).cast("bigint") % buckets
    return (running_total(weights, "_w", bucket, ["key"], "start")
            .select("key", "start", (F.col("start") + F.col("_w")).alias("stop")))


def draw_keys(rows: DataFrame, parent: DataFrame, key: str, u: Column, name: str) -> DataFrame:
    """Give every row a parent key drawn uniformly with replacement, repeated keys as often as
    they occur.  No row is lost; with no parent key at all the drawn key is null.

    A position among all parent rows is drawn per row and looked up by equi-join on a position
    grid as wide as the average repetition, so about two candidates meet each drawn row and the
    drawn rows spread evenly over the grid whatever the key distribution.
    """
    weights = key_weights(parent, key)
    intervals = key_intervals(weights)
    size = weights.agg(F.sum("_w").alias("n"), F.count(F.lit(1)).alias("k")).select(
        F.struct("n", F.greatest(F.floor(F.try_divide("n", "k")), F.lit(1)).alias("w"))).scalar()
    asked = (rows.withColumn("_n", size["n"]).withColumn("_pos", index_draw(u, F.col("_n"))).drop("_n"))
    return look_up(asked, intervals, size["w"], name)


def look_up(rows: DataFrame, intervals: DataFrame, width: Column | int, name: str, small: bool = False) -> DataFrame:
    """Replace the position ``_pos`` of every row by the key whose interval (key, start, stop) holds it, null if none.

    Keys are placed on a grid of cells ``width`` positions wide; ``small`` intervals are broadcast.
    """
    width = width if isinstance(width, Column) else F.lit(width)
    first, last = F.floor(F.col("start") / F.col("_width")), F.floor((F.col("stop") - 1) / F.col("_width"))
    chunk = F.col("_chunk") * CELLS_PER_CHUNK
    # a key that owns a third of all positions covers a third of all cells: its chunks of cells are
    # spread over the tasks before the cells themselves are listed
    placed = (intervals.withColumn("_width", width).withColumn("_first", first).withColumn("_last", last)
              .withColumn("_chunk", F.explode(F.sequence(F.floor(F.col("_first") / CELLS_PER_CHUNK),
                                                         F.floor(F.col("_last") / CELLS_PER_CHUNK))))
              .repartition("_chunk")
              .withColumn("_cell", F.explode(F.sequence(F.greatest("_first", chunk),
                                                        F.least("_last", chunk + (CELLS_PER_CHUNK - 1)))))
              .select(F.col("key").alias(name), "_cell", "start", "stop"))
    asked = rows.withColumn("_w", width).withColumn("_cell", F.floor(F.col("_pos") / F.col("_w"))).drop("_w")
    hit = ((asked["_cell"] == placed["_cell"]) & (asked["_pos"] >= placed["start"])
           & (asked["_pos"] < placed["stop"]))
    return (asked.join(F.broadcast(placed) if small else placed, hit, "left")
            .drop(asked["_cell"], placed["_cell"], "_pos", "start", "stop"))


def condition_foreign_key(child: DataFrame, child_col: str, parent: DataFrame, parent_col: str,
                          draws: Draws, rid: str = "_rid", scope: str = "") -> DataFrame:
    """Overwrite (or put first) the foreign key with keys drawn from the parent's rows."""
    if parent_col not in parent.columns:
        return child
    u = draws.uniform("fk", scope, child_col, F.col(rid))
    drawn = draw_keys(child.drop(child_col), parent, parent_col, u, "_drawn")
    names = child.columns if child_col in child.columns else [child_col, *child.columns]
    drawn = drawn.withColumnRenamed("_drawn", child_col)
    return drawn.select(*names)


def dense_foreign_key(rid: Column, child_col: str, n_parent: int, draws: Draws, scope: str = "") -> Column:
    """Foreign key into a parent whose keys are exactly 1..n: no join at all."""
    return (index_draw(draws.uniform("fk", scope, child_col, rid), n_parent) + 1).alias(child_col)


def bootstrap(df: DataFrame, row_id: str, draws: Draws, n: int | Column | None = None) -> DataFrame:
    """As many rows as the table has, drawn with replacement; ``row_id`` must be unique.

    Drawn positions are counted first, and a row is repeated as often as its position was drawn.
    """
    spark = df.sparkSession
    intervals = key_intervals(key_weights(df, row_id))
    size = df.agg(F.count(F.lit(1)).alias("n"))
    total = n if n is not None else size.first()["n"]
    slots = row_ids(spark, total, "id", 0).withColumn("_n", size.scalar())
    drawn = (slots.select(index_draw(draws.uniform("bootstrap", F.col("id")), F.col("_n")).alias("start"), "id")
             .join(intervals, "start").select(F.col("key").alias(row_id), F.col("id").alias("_rid")))
    return drawn.join(df, row_id)


def cap_rows(df: DataFrame, limit: int, draws: Draws, *row_id: str) -> DataFrame:
    """Uniform sample without replacement of at most ``limit`` rows, exact and repeatable."""
    u = draws.uniform("cap", *[F.col(c) for c in row_id])
    return df.withColumn("_u", u).orderBy("_u", *row_id).limit(limit).drop("_u")


def stratified_split(df: DataFrame, label: str, row_id: str, draws: Draws, test_fraction: float = 0.3,
                     bucket_rows: int = 100_000) -> DataFrame:
    """Add ``is_test``: of every label, the given share of rows (rounded) by smallest draw.

    The draw is uniform, so its leading part is an even bucket of about ``bucket_rows`` rows.  Counts per
    (label, bucket) tell the bucket in which a label's threshold falls: rows of earlier buckets are test
    rows, rows of later ones are not, and only that one bucket is ranked.  A label with a single row goes
    to training.
    """
    buckets = max(1, df.count() // bucket_rows)
    u = draws.uniform("split", F.col(row_id))
    tagged = df.withColumn("_u", u).withColumn("_b", F.floor(F.col("_u") * buckets))
    upto = Window.partitionBy("_l").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    per = (tagged.groupBy(F.col(label).alias("_l"), "_b").agg(F.count(F.lit(1)).alias("_c"))
           .withColumn("_upto", F.sum("_c").over(upto)).withColumn("_size", F.sum("_c").over(Window.partitionBy("_l")))
           .withColumn("_wanted", F.when(F.col("_size") > 1, F.round(F.col("_size") * test_fraction)).otherwise(0)))
    # the first bucket that reaches past the wanted rows, if any, and how many of its rows are wanted
    edge = F.min(F.when(F.col("_upto") > F.col("_wanted"), F.struct("_b", (F.col("_wanted") - F.col("_upto") + F.col("_c")).alias("_left"))))
    edges = per.groupBy("_l").agg(edge.alias("_edge"))
    joined = tagged.join(edges, F.col(label).eqNullSafe(F.col("_l")), "left")
    inside = F.col("_b") == F.col("_edge._b")
    sure = joined.filter(~F.coalesce(inside, F.lit(False))).withColumn("is_test", F.coalesce(F.col("_b") < F.col("_edge._b"), F.lit(True)))
    ranked = joined.filter(inside).withColumn("is_test", F.row_number().over(
        Window.partitionBy(label, "_b").orderBy("_u", row_id)) <= F.col("_edge._left"))
    return sure.unionByName(ranked).drop("_u", "_b", "_l", "_edge")
