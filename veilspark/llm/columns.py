"""Small column helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.scaling import cut
from veilspark.functions.scaling import written as written

SPACE = r"[\x20\x09-\x0D]+"
TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
"""Words of letters, digits and non-ASCII characters, for texts whose A-Z are not lower-cased yet."""
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it in lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def space_words(text: Column) -> Column:
    """Words between ASCII white space; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def count_of(text: Column, pattern: str) -> Column:
    """Characters of the text that the (negated, repeated) pattern does not remove."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), pattern, "")).cast("long")


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the frame does not use, whatever extra columns it brings."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def document_key(id_column: str = "doc_id", text_column: str = "text") -> Column:
    """Identity of a document: rows with one id and one text are repeated rows of one document.

    Two hashes of id and text: without ids, equal texts are one document.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    return F.struct(F.col(id_column).alias("id"), F.xxhash64(text).alias("th"))


def hot_join(rows: DataFrame, keyed: DataFrame, key: str, shares: int = 256) -> DataFrame:
    """Left join with a frame of one row per key, where a few keys may hold most rows.

    Keys with more than a 1/shares part of all rows are fewer than ``shares``, so their rows of ``keyed``
    are broadcast; all other keys are small and meet by shuffle.  Both frames are read twice: pass
    materialised ones.  A null key finds nothing.
    """
    least = rows.count() // shares
    hot = F.broadcast(cut(keyed.join(F.broadcast(rows.groupBy(key).count().filter(F.col("count") > least).select(key)), key)))
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(keyed, key, "left"))
