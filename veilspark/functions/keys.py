"""Comparing keys whose two sides may differ in type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def comparable(left: DataFrame, a: str, right: DataFrame, b: str) -> tuple[Column, Column]:
    """Both key columns as they are if their types agree, else both as text.

    A synthetic key modelled as a category is text (it may be the other-category), while its
    parent's key may still be a number.
    """
    x, y = left.schema[a].dataType, right.schema[b].dataType
    if x == y or (isinstance(x, T.IntegralType) and isinstance(y, T.IntegralType)):
        return F.col(a), F.col(b)
    return F.col(a).cast("string"), F.col(b).cast("string")
