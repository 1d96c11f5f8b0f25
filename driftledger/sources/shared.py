"""Intermediate tables that several branches of one report read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Tables of the innermost ``with shared_tables(...)`` around, in this thread.
_scope: ContextVar[list[str] | None] = ContextVar("shared_tables", default=None)


def shared_folder(spark: SparkSession) -> str | None:
    """The folder all executors can reach, as the session names it; None if it names none."""
    return spark.conf.get("spark.checkpoint.dir", None)


def work_folder(spark: SparkSession) -> str:
    """The shared folder, for work that cannot do without. A session on one machine that names none gets one of its own."""
    folder = shared_folder(spark)
    if folder is None and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (folder or tempfile.mkdtemp(prefix="driftledger-")).rstrip("/")


def share(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back, so that its branches do not each recompute it.

    Without a shared folder the plan is used as it is: same result, more work. The table is deleted at the end of the
    :func:`shared_tables` block that it is made in; outside of one it stays, as whoever reads it does so later.
    """
    folder = shared_folder(df.sparkSession)
    if folder is None:
        return df
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if (scope := _scope.get()) is not None:
        scope.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shared_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes what :func:`share` writes within the block when it ends, however it ends; results must be taken or written
    before. Blocks of other threads, and blocks around this one, keep their tables."""
    own: list[str] = []
    token = _scope.set(own)
    try:
        yield
    finally:
        _scope.reset(token)
        for name in own:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
