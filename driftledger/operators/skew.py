"""Joining rows to rows of the same key when some keys hold a large part of either side.

Adaptive execution splits a hot partition of a join when both inputs come straight from a shuffle and
nothing downstream relies on the join's partitioning. A lookup on ``target`` of an aggregate per target,
followed by a count per target, meets neither condition, so lookups get a partitioning of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def row_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))


def lookup(many: DataFrame, few: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join ``many`` to ``few`` on ``keys``; ``how`` is inner, left, left_semi or left_anti.

    A hash of the keys is a join key besides them. So no aggregate below or above shares the join's
    partitioning, both inputs are shuffled for this join alone, and adaptive execution can split the rows
    of any hot key, NULL among them, whichever side holds them. Nothing is counted beforehand, and a side
    is broadcast only where the optimizer knows it to be small.

    Keys whose types differ between the sides hash differently and are left out of the hash.
    """
    left, right = ({f.name: f.dataType for f in df.select(*keys).schema} for df in (many, few))
    hashed = F.xxhash64(F.lit(0), *[k for k in keys if left[k] == right[k]])
    both = [df.withColumn("_spread", hashed) for df in (many, few)]
    return both[0].join(both[1], [*keys, "_spread"], how).drop("_spread")
