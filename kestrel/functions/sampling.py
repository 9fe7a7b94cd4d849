"""Bounded samples that do not move what they leave out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def smallest_hashes(df: DataFrame, key: str, n: int) -> DataFrame:
    """The rows whose key is among the n with the smallest hashes.

    Only hashes are ordered, to find the n-th; the rows themselves are then
    filtered where they are.  Rows that repeat a key come along.
    """
    h = F.xxhash64(key)
    cut = df.select(h.alias("h")).distinct().orderBy("h").limit(n).agg(F.max("h")).first()[0]
    return df.where(F.lit(False)) if cut is None else df.where(h <= cut)
