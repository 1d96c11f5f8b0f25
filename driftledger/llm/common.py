"""Helpers that several operators share: words, intermediate tables, running totals over a global order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of the query contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session on one machine that names none gets one of its own, as in
    tests; a cluster must name it, as executors would write where nobody reads."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="driftledger-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from reliable storage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later reads take only the columns they need, and its size is known."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: str | Column = "text") -> Column:
    """All words of a text; none if it is null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def n_words(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out() -> Column:
    """The rows that no model learns from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def running(df: DataFrame, order: list[str], totals: dict[str, str], within: list[str] | None = None) -> DataFrame:
    """Adds, for each ``name: column`` of ``totals``, the sum of ``column`` over all earlier rows of the order (within equal
    ``within``, which must not be null).

    The rows are range partitioned, so neither the table nor a hot group meets in one task: totals are taken within each
    part, and what the parts before it add up to comes from one row per part. The partitioned rows are written before
    their parts are used, as a recomputed range partitioning could fall otherwise. ``order`` should be unique.
    """
    keys = list(within or [])
    columns = df.columns
    parts = cut(
        df.repartitionByRange(partitions(df.sparkSession), *keys, *order).withColumn("part__", F.spark_partition_id())
    )
    inside = Window.partitionBy("part__", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("part__", *keys).agg(*[F.sum(c).alias(f"{n}__sum") for n, c in totals.items()])
    offsets = sums.select(
        "part__", *keys, *[F.coalesce(F.sum(f"{n}__sum").over(before), F.lit(0)).alias(f"{n}__before") for n in totals]
    )
    own = parts.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"{n}__own") for n, c in totals.items()])
    return own.join(offsets, ["part__", *keys]).select(
        *columns, *[(F.col(f"{n}__own") + F.col(f"{n}__before")).alias(n) for n in totals]
    )
