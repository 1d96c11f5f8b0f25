"""The ledger table: one row per target and version. For its storage see ``store``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from driftledger import messages as M
from driftledger.schemas import LEDGER, conform


def as_ledger(df: DataFrame) -> DataFrame:
    """Canonical columns; a missing hash column is added and an empty hash means "none"."""
    return conform(df, LEDGER).withColumn("content_sha256", F.nullif("content_sha256", F.lit("")))


def ledger_problem() -> F.Column:
    """Why a ledger row is not acceptable, else NULL."""
    return (
        F.when(F.col("version").isNull(), "ledger row without a version")
        .when(
            F.col("version") < 0,
            F.format_string("ledger contains negative version %d; the table was modified outside", F.col("version")),
        )
        .when(~F.col("status").isin(M.APPLIED, M.REVERTED), F.concat(F.lit("unknown status "), F.col("status")))
    )


def split_ledger(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(acceptable rows, rejected rows with ``error``), so that a bad target does not stop the others."""
    checked = as_ledger(df).withColumn("error", ledger_problem())
    return checked.filter("error IS NULL").drop("error"), checked.filter("error IS NOT NULL")


def check_version_range(df: DataFrame) -> DataFrame:
    """Add ``error`` for versions, given as decimal, that do not fit the ledger's signed 64-bit column."""
    fits = F.col("version").try_cast("bigint").isNotNull()
    text = F.concat(F.lit("migration version "), F.col("version").cast("string"), F.lit(" exceeds the ledger's range"))
    return df.withColumn("error", F.when(~fits, text))
