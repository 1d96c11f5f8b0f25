"""Data checks: keys, references and NULLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from driftledger.operators.skew import lookup


def composite_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def key_count(df: DataFrame, condition: Column) -> DataFrame:
    """Point lookup: how many rows have the given key value."""
    return df.filter(condition).agg(F.count(F.lit(1)).alias("n_rows"))


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column with its number of NULLs, from one pass."""
    names = columns or df.columns
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    return counted.unpivot([], names, "column", "n_nulls")


def fk_check(child: DataFrame, parent: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Child key values without a parent row, with the number of child rows that hold them.

    ``keys`` maps child columns to parent columns; a key with a NULL part refers to nothing.
    Child rows are counted per key before the join, so a frequent key is one row there.
    """
    children = child.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    parents = parent.select(*[F.col(p).alias(c) for c, p in keys.items()])
    return children.join(parents, list(keys), "left_anti")


def parent_of(df: DataFrame, child_key: str, parent_key: str, columns: list[str]) -> DataFrame:
    """Each row that names a parent in the same table, with ``parent_<column>`` of that parent."""
    parents = df.select(
        F.col(child_key).alias(parent_key), *[F.col(c).alias(f"parent_{c}") for c in columns]
    )
    return lookup(df.filter(F.col(parent_key).isNotNull()), parents, [parent_key], "inner")
