"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

``targets`` shares a token budget over sources by weight, with a ceiling per source.  ``balance``
finds document rates r = min(cap, exp(sum of one multiplier per margin)) that meet every margin's
token targets and stay as near as possible to one copy of each token (least relative entropy).  The
dual is convex: each Newton step sums the tilted tokens of a margin's groups on the cluster and moves
that margin's multipliers; the other margins are held, which makes the Hessian block diagonal.
``copies`` rounds rates into whole copies by size class, from the largest documents down; what one
class misses of its target is made up by the next.

Rows meet only as counts per (group, size class): a hot source is some thousands of rows at most.
Ranks among documents of one class are taken in salted pieces, so a hot group of copies
spreads over tasks.  Repeated rows are ordered arbitrarily among themselves, which gives equal output.

Defined results: null groups are a group of their own (last in order); null texts have size 0; empty
tables give empty results; documents of size 0 get no copies once a group's words are used up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilspark.functions.scaling import cut

from .columns import bind, free_name, space_words

WEIGHTS = (5.0, 2.0, 1.0)
PIECE = 100_000
"""Documents of one group and size class are ranked in pieces of about this many."""


def group_of(column: str) -> Column:
    """A group key without nulls that sorts by code point, null last."""
    return F.struct(F.col(column).isNull().alias("none"), F.coalesce(F.col(column).cast("string"), F.lit("")).alias("name"))


def targets(groups: DataFrame, share: float = 1.5, ceiling: float = 2.0,
            weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """Token targets of (g, tokens), one row per source: ``share`` of all tokens, by cyclic weights.

    Resharing the excess until no source is above its ceiling ends at min(ceiling, level * weight);
    the level follows from sorting sources by ceiling per weight: the first one whose ceiling is not
    reached fixes it.  The windows here run over one row per source; later rows have lower levels.
    """
    order = Window.orderBy("g")
    w = F.element_at(F.array([F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, len(weights)) + 1).cast("int"))
    ranked = groups.withColumn("w", w).withColumn("top", ceiling * F.col("tokens")).withColumn("need", F.col("top") / F.col("w"))
    by_need, all_rows = Window.orderBy("need", "g"), Window.partitionBy()
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    after = by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = share * F.sum("tokens").over(all_rows) - F.coalesce(F.sum("top").over(before), F.lit(0.0))
    level = left / F.sum("w").over(after)
    leveled = ranked.withColumn("level", level)
    reached = F.max(F.when(F.col("level") <= F.col("need"), F.col("level"))).over(all_rows)
    return leveled.select("g", "tokens", F.least(F.col("top"), F.coalesce(reached * F.col("w"), F.col("top"))).alias("target"))


def balance(cells: DataFrame, margins: Sequence[tuple[str, DataFrame]], cap: float = 2.0,
            tolerance: float = 1e-12, max_rounds: int = 60) -> DataFrame:
    """Add ``rate`` to cells (margin columns, tokens) so that every margin meets its targets.

    ``margins`` pairs a column of the cells with a table (that column, target).  Each round takes one
    Newton step per margin: with tilted sums S, multipliers move by T / S - 1 (S is both gradient
    term and curvature), at most by 1 upwards; capped cells add to S but not to the curvature.
    Rounds end when every group is within ``tolerance`` of its target or nothing moves any more.
    """
    state = cut(cells.withColumn("eta", F.lit(0.0)))
    rate = F.least(F.lit(cap), F.exp("eta"))
    for _ in range(max_rounds):
        moved = []
        for column, wanted in margins:
            sums = (state.groupBy(column).agg(F.sum(F.col("tokens") * rate).alias("got"),
                                              F.sum(F.when(F.exp("eta") < cap, F.col("tokens") * F.exp("eta"))).alias("bend"))
                    .join(wanted, column))
            gap = F.col("target") - F.col("got")
            step = (F.when(F.abs(gap) <= tolerance * F.greatest("target", F.lit(1.0)), 0.0)
                    .when(F.col("target") <= 0, -50.0)
                    .when(F.coalesce(F.col("bend"), F.lit(0.0)) <= 0, F.when(gap < 0, -0.1).otherwise(0.0))
                    .otherwise(F.greatest(F.lit(-5.0), F.least(F.lit(1.0), gap / F.col("bend")))))
            steps = sums.select(column, step.alias("step"))
            state = cut(state.join(steps, column, "left").withColumn("eta", F.greatest(F.lit(-50.0), F.col("eta") + F.coalesce("step", F.lit(0.0))))
                        .withColumn("moved", F.abs(F.coalesce("step", F.lit(0.0))) * (F.col("eta") > -50.0).cast("int")).drop("step"))
            moved.append(state.agg(F.max("moved")).first()[0] or 0.0)
            state = state.drop("moved")
        if max(moved) <= tolerance:
            break
    return state.withColumn("rate", F.when(F.col("eta") <= -50.0, 0.0).otherwise(rate)).drop("eta")


def size_class(size: Column) -> Column:
    """Sizes up to 1023 as they are, larger ones by their seven leading bits; grows with the size."""
    bits = F.length(F.bin(size))
    return F.when(size < 1024, size).otherwise(bits * 128 + F.floor(size / F.pow(F.lit(2.0), bits - 7))).cast("long")


def shares(cells: DataFrame, cap: float) -> DataFrame:
    """Copies per size class of (g, class, n, tokens, rate): each document gets ``base``, ``extra`` of them one more.

    A fold from the largest class down keeps the tokens still wanted and still on offer, so that
    later, smaller documents even out the rounding of larger ones.  A group has at most some
    thousands of classes, whatever its rows.
    """
    def step(acc: Column, x: Column) -> Column:
        wanted = F.when(acc["left"] > 0, F.round(x["n"] * acc["want"] / acc["left"])).otherwise(0.0)
        count = F.greatest(F.lit(0), F.least(wanted.cast("long"), (x["n"] * cap).cast("long")))
        return bind(count, lambda c: F.struct(
            (acc["want"] - c * (x["tokens"] / x["n"])).alias("want"), (acc["left"] - x["tokens"]).alias("left"),
            F.array_append(acc["out"], F.struct(x["class"].alias("class"), F.floor(c / x["n"]).alias("base"),
                                                (c % x["n"]).alias("extra"))).alias("out")))

    grouped = cells.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("class", "n", "tokens")), asc=False).alias("cells"),
                                     F.sum(F.col("rate") * F.col("tokens")).alias("want"), F.sum("tokens").alias("left"))
    empty = F.expr("CAST(array() AS array<struct<class: bigint, base: bigint, extra: bigint>>)")
    start = F.struct("want", "left", empty.alias("out"))
    return grouped.select("g", F.inline(F.aggregate("cells", start, step)["out"]))


def copies(docs: DataFrame, rates: DataFrame, order: Sequence[Column], cap: float = 2.0) -> DataFrame:
    """Add ``copies`` and the columns of rates to documents (g, size): rounded by class, ranked by ``order``.

    What a group needs to know joins its size classes first, so no join has the group alone as its key.
    """
    keyed = docs.withColumn("_order", F.struct(*order)).withColumn("class", size_class(F.col("size")))
    cells = cut(keyed.groupBy("g", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("tokens")))
    shared = cut(shares(cells.join(rates.select("g", "rate"), "g"), cap).join(cells.select("g", "class", "n"), ["g", "class"]).join(rates, "g"))
    placed = (keyed.join(shared, ["g", "class"])
              .withColumn("_piece", F.pmod(F.xxhash64("_order"), F.ceil(F.col("n") / PIECE).cast("long"))))
    before = Window.partitionBy("g", "class").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = (placed.groupBy("g", "class", "_piece").agg(F.count(F.lit(1)).alias("_m"))
              .withColumn("_from", F.coalesce(F.sum("_m").over(before), F.lit(0))).drop("_m"))
    rank = F.row_number().over(Window.partitionBy("g", "class", "_piece").orderBy("_order")) - 1
    return (placed.withColumn("_rank", rank).join(starts, ["g", "class", "_piece"])
            .withColumn("copies", F.col("base") + (F.col("_from") + F.col("_rank") < F.col("extra")).cast("long"))
            .drop("_order", "_piece", "_rank", "_from", "class", "n", "base", "extra"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, with ``copies`` and ``taken`` words after their own columns.

    Decisions join back by id and text; repeated rows of one document share the sum of its copies evenly
    from the first row on.
    """
    decided = mix(docs.select("doc_id", "text", "source"), **options)
    copies_of, taken_of = free_name(docs, "copies"), free_name(docs, "taken")
    key = F.struct("doc_id", "source", F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("_digest"))
    order = Window.partitionBy("_key").orderBy(F.lit(1))
    numbered = docs.withColumn("_key", key).withColumn("_nth", F.row_number().over(order))
    marks = (decided.select(F.struct("doc_id", "source", "_digest").alias("_key"), "copies", "size")
             .withColumn("_nth", F.row_number().over(Window.partitionBy("_key").orderBy(F.desc("copies")))))
    marks = marks.select(F.col("_key").alias("_mark"), F.col("_nth").alias("_at"), F.col("copies").alias(copies_of),
                         (F.col("copies") * F.col("size")).alias(taken_of))
    joined = numbered.join(marks, (F.col("_key") == F.col("_mark")) & (F.col("_nth") == F.col("_at")))
    return joined.drop("_key", "_nth", "_mark", "_at").filter(F.col(copies_of) > 0)


def mix(docs: DataFrame, share: float = 1.5, ceiling: float = 2.0, weights: Sequence[float] = WEIGHTS,
        key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies and taken of every document."""
    sized = docs.select(F.col(key).alias("doc_id"), group_of(source).alias("g"), F.col(source).alias("source"),
                        F.size(space_words(F.col(text))).cast("long").alias("size"),
                        F.md5(F.coalesce(F.col(text), F.lit(""))).alias("_digest"))
    sized = cut(sized)
    groups = cut(sized.groupBy("g").agg(F.sum("size").alias("tokens")))
    wanted = cut(targets(groups, share, ceiling, weights))
    rates = balance(groups, [("g", wanted.select("g", "target"))], ceiling)
    order = [F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.col("_digest")]
    rates = rates.join(wanted.select("g", "target"), "g").withColumnRenamed("tokens", "source_size")
    return (copies(sized, rates, order, ceiling)
            .withColumn("taken", F.col("copies") * F.col("size"))
            .select("doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken", "_digest"))
