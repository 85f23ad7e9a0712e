"""Helpers that keep plans safe at any table size: lineage cuts, checked broadcasts, ordinals."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BROADCAST_ROWS = 1_000_000
ROWS_PER_PARTITION = 4_000_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the session names, else one in the warehouse, which is shared too."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        sc.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, so that lost executors cost no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Materialise as a table in the shared checkpoint folder: for loops, and for tables of which parts are read often.

    Readers of a written table read the columns they need; a checkpoint is read whole, row by row.  It is planned
    by its real size.  A checkpoint keeps the estimate of the plan before it, and
    estimates of joins multiply round by round, until after some twenty rounds planning takes for ever.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def in_threads(spark: SparkSession, fn: Callable, items: Sequence, threads: int) -> list:
    """Run one chain of jobs per item, a few at a time."""
    with ThreadPoolExecutor(max(threads, 1)) as pool:
        return list(pool.map(inheritable_thread_target(spark)(fn), items))


def row_ids(spark: SparkSession, n: int, name: str = "_rid", start: int = 1) -> DataFrame:
    """Ids start..start+n-1, in enough partitions to keep each of them small."""
    parts = max(spark.sparkContext.defaultParallelism, -(-n // ROWS_PER_PARTITION))
    return spark.range(start, start + n, 1, parts).withColumnRenamed("id", name)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only if the rows, counted up to the limit, really are few.

    Beyond the limit the frame is returned unhinted and the join shuffles (with AQE splitting hot
    partitions).  Call it on materialised frames: the count is an action.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def dense_ordinal(df: DataFrame, order_by: Sequence[str], name: str,
                  partitions: int | None = None) -> DataFrame:
    """Number all rows 0..n-1 in the given order without a single-partition window.

    Rows are range partitioned and sorted once, materialised, and each partition's start is the
    running count of the partitions before it (one row per partition).  Let ``order_by`` end in a
    unique column, so that equal leading values can be spread over several partitions.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(n, *order_by).sortWithinPartitions(*order_by)
                 .withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (placed.groupBy("_part").count()
              .select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start")))
    return (placed.join(F.broadcast(starts), "_part")
            .withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("_at", "_part", "_start"))


def running_total(df: DataFrame, weight: str, bucket: Column, order_by: Sequence,
                  total: str, within: Sequence[str] = ()) -> DataFrame:
    """Sum of ``weight`` over all earlier rows, as a prefix sum in two levels.

    ``bucket`` must not decrease along ``order_by`` and should take at most some thousands of
    values; windows then run per bucket, and only one row per bucket is summed across buckets.
    """
    keys = [*within, "_bucket"]
    tagged = df.withColumn("_bucket", bucket)
    inner = Window.partitionBy(*keys).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*within).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (tagged.groupBy(*keys).agg(F.sum(weight).alias("_sum"))
              .select(*keys, F.coalesce(F.sum("_sum").over(outer), F.lit(0)).alias("_start")))
    return (tagged.withColumn("_inner", F.coalesce(F.sum(weight).over(inner), F.lit(0)))
            .join(starts, keys)
            .withColumn(total, F.col("_start") + F.col("_inner"))
            .drop("_bucket", "_inner", "_start"))
