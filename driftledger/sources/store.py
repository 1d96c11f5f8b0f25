"""A ledger and its cursor on storage, published together, one commit after another.

``ledger/`` is a bucketed table: rows lie in folders by the write that made them, and within them by bucket, a hash of target
and version. A commit is one small file that names, for each bucket, the write that holds its rows, and the cursor that
goes with them. It comes into being whole under the next number, or not at all, so readers see a commit or the one before,
and of two writers that start from the same commit the second one notices, takes what the first one wrote, and tries again.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftledger import messages as M
from driftledger.operators.ledger import insert_if_absent, split_changes, upsert
from driftledger.operators.skew import lookup
from driftledger.schemas import CURSOR, LEDGER, conform
from driftledger.sources.ledger import as_ledger, ledger_problem, split_ledger

BUCKET_KEYS = ["target", "version"]

#: Threads share the session's settings.
_setting = threading.Lock()


class Conflict(RuntimeError):
    """Someone else has committed meanwhile."""


class Commit(NamedTuple):
    number: int  # 0 before the first
    writes: tuple[str, ...]  # for each bucket the write that holds its rows; "" while it has none
    cursor: str  # the write that holds the cursor, or ""


class LedgerStore:
    """``buckets`` holds for a new store only; an existing one keeps its own number, as its commits tell."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self._buckets = spark, path.rstrip("/"), buckets
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    # Reading

    def commits(self) -> list[int]:
        pattern = self._hadoop("commits/*.json")
        found = self._files(pattern).globStatus(pattern)
        return sorted(int(f.getPath().getName()[:-5]) for f in found or [])

    def commit(self, number: int | None = None) -> Commit:
        """The newest commit, or the given one."""
        numbers = self.commits() if number is None else [number]
        if not numbers:
            return Commit(0, ("",) * self._buckets, "")
        path = self._hadoop(f"commits/{numbers[-1]:020d}.json")
        stream = self._files(path).open(path)
        try:
            held = json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()
        return Commit(numbers[-1], tuple(held["writes"]), held["cursor"])

    def ledger(self, at: Commit | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The ledger of a commit (the newest), or some buckets of it.

        Joins and aggregates by target and version need no exchange of it: the scan knows the buckets. Only files that the
        commit names are read.
        """
        at = at or self.commit()
        held = {b: w for b, w in enumerate(at.writes) if w and (buckets is None or b in set(buckets))}
        if not held:
            return self.spark.createDataFrame([], LEDGER)
        by_write: dict[str, list[int]] = {}
        for b, w in held.items():
            by_write.setdefault(w, []).append(b)
        wanted = F.lit(False)
        for w, own in by_write.items():
            wanted = wanted | ((F.col("write") == w) & F.col("bucket").isin(own))
        return self._table(len(at.writes), lambda name: self.spark.table(name).filter(wanted)).select(LEDGER.fieldNames())

    def cursor(self, at: Commit | None = None) -> DataFrame:
        at = at or self.commit()
        if not at.cursor:
            return self.spark.createDataFrame([], CURSOR)
        return self.spark.read.schema(CURSOR).parquet(f"{self.path}/cursor/{at.cursor}")

    # Writing

    def upsert(self, changes: DataFrame, hash_policy: str = "keep_first") -> tuple[int, DataFrame]:
        """Write changes from outside; (number of the commit, refused rows). Targets with a refused row are left out whole."""
        accepted, refused = split_changes(changes)
        return self.merge(accepted, lambda ledger, own: upsert(ledger, own, hash_policy)), refused

    def insert(self, rows: DataFrame) -> int:
        """Add the rows whose key the ledger does not have; unique by key."""
        return self.merge(rows, insert_if_absent)

    def merge(
        self,
        changes: DataFrame,
        merged: Callable[[DataFrame, DataFrame], DataFrame],
        moved: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    ) -> int:
        """Write ``merged(ledger, changes)`` and the cursor that follows; the number of the commit.

        Only the buckets that ``changes`` touches are read and rewritten, so ``merged`` must treat each key by itself. The
        cursor is ``moved(ledger, cursor)`` of the new ledger; by default the highest applied version of the targets that
        changed, while other targets keep theirs.

        If another writer commits first, the buckets that it rewrote as well are merged again with what it left, the others
        stay as written, and the commit is tried under the next number. No change is lost, whichever order it takes.
        """
        first = self.commit()
        path = f"{self.path}/pending/{uuid.uuid4().hex}"
        bucket = self._bucket(len(first.writes))
        as_ledger(changes).withColumn("bucket", bucket).write.partitionBy("bucket").parquet(path)
        pending = self.spark.read.schema(f"{LEDGER.simpleString()[7:-1].replace(':', ' ')}, bucket int").parquet(path)
        touched = sorted(r["bucket"] for r in pending.select("bucket").distinct().collect())
        written: dict[int, tuple[str, str]] = {}  # for each bucket: the write it was merged with, and its own
        while True:
            at = self.commit()
            stale = [b for b in touched if b not in written or written[b][0] != at.writes[b]]
            if stale:
                own = pending.filter(F.col("bucket").isin(stale)).select(LEDGER.fieldNames())
                base = self.ledger(at, stale)
                # A merge with rows on storage leaves each bucket's rows in one task already.
                write = self._write(merged(base, own), len(at.writes), dealt=any(at.writes[b] for b in stale))
                written |= {b: (at.writes[b], write) for b in stale}
            writes = tuple(written[b][1] if b in written else w for b, w in enumerate(at.writes))
            new = Commit(at.number + 1, writes, uuid.uuid4().hex)
            cursor = moved(self.ledger(new), self.cursor(at)) if moved else self._moved(new, at, pending)
            conform(cursor, CURSOR).write.parquet(f"{self.path}/cursor/{new.cursor}")
            if self._publish(new):
                self._delete(path)
                return new.number
            self._delete(f"{self.path}/cursor/{new.cursor}")

    def replace(self, ledger: DataFrame, cursor: DataFrame | None = None, base: Commit | None = None) -> int:
        """Write a whole ledger, and a cursor if given; the number of the commit.

        A commit by someone else since ``base`` (by default the newest now) is an error: what it wrote would be lost.
        """
        base = base or self.commit()
        write = self._write(ledger, len(base.writes), dealt=False)
        found = self._files(self._hadoop("ledger")).globStatus(self._hadoop(f"ledger/write={write}/bucket=*"))
        held = {int(f.getPath().getName().split("=")[1]) for f in found or []}
        name = base.cursor
        if cursor is not None:
            name = uuid.uuid4().hex
            conform(cursor, CURSOR).write.parquet(f"{self.path}/cursor/{name}")
        new = Commit(base.number + 1, tuple(write if b in held else "" for b in range(len(base.writes))), name)
        if not self._publish(new):
            raise Conflict(f"the ledger in {self.path} has changed since commit {base.number}")
        return new.number

    def retain(self, commits: int) -> list[int]:
        """Delete all but the newest commits, and the rows and cursors that only they name; the numbers that went.

        A reader of a deleted commit fails. Writes that no commit names yet are left alone.
        """
        numbers = self.commits()
        kept = [self.commit(n) for n in numbers[-commits:]]
        old = [self.commit(n) for n in numbers[:-commits]]
        rows = lambda c: {f"ledger/write={w}/bucket={b}" for b, w in enumerate(c.writes) if w} | ({f"cursor/{c.cursor}"} if c.cursor else set())
        named = set().union(*map(rows, kept)) if kept else set()
        for c in old:
            self._delete(f"{self.path}/commits/{c.number:020d}.json")
        for folder in sorted(set().union(*map(rows, old)) - named) if old else []:
            self._delete(f"{self.path}/{folder}")
        return [c.number for c in old]

    # Storage

    @staticmethod
    def _bucket(n: int) -> Column:
        """The bucket that Spark's writer gives a row, as it is part of the path too."""
        return F.pmod(F.hash(*BUCKET_KEYS), F.lit(n)).cast("int")

    def _table(self, n: int, use: Callable[[str], DataFrame | None], write: str | None = None) -> DataFrame | None:
        """``use`` of the bucketed table, or the part of it that one write makes, by a name that only exists meanwhile; its files
        stay, and are listed as they are. Each write has a folder of its own, as Spark clears up where a job has written."""
        name = f"ledger_{uuid.uuid4().hex}"
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in LEDGER.fields)
        extra, by, place = (", write STRING", "write, bucket", "ledger") if write is None else ("", "bucket", f"ledger/write={write}")
        listed = "spark.sql.hive.manageFilesourcePartitions"  # else the catalog would be asked for partitions later
        with _setting:
            before = self.spark.conf.get(listed)
            self.spark.conf.set(listed, "false")
            try:
                self.spark.sql(
                    f"CREATE TABLE {name} ({columns}{extra}, bucket INT) USING parquet OPTIONS (path '{self.path}/{place}') "
                    f"PARTITIONED BY ({by}) CLUSTERED BY ({', '.join(BUCKET_KEYS)}) SORTED BY ({', '.join(BUCKET_KEYS)}) INTO {n} BUCKETS"
                )
            finally:
                self.spark.conf.set(listed, before)
        try:
            return use(name)
        finally:
            self.spark.sql(f"DROP TABLE {name}")

    def _write(self, rows: DataFrame, n: int, dealt: bool) -> str:
        write = uuid.uuid4().hex
        rows = as_ledger(rows) if dealt else as_ledger(rows).repartition(n, *BUCKET_KEYS)
        rows = rows.withColumn("bucket", self._bucket(n))
        self._table(n, lambda name: rows.write.insertInto(name), write)
        return write

    def _moved(self, new: Commit, at: Commit, pending: DataFrame) -> DataFrame:
        """The cursor after a merge: highest applied version of changed targets; where none is applied it stays."""
        changed = pending.select("target").distinct()
        applied = lookup(self.ledger(new).filter(F.col("status") == M.APPLIED).select(*BUCKET_KEYS), changed, ["target"], "left_semi")
        top = applied.groupBy("target").agg(F.max("version").alias("_top"))
        both = self.cursor(at).join(top, "target", "full")
        stays = F.col("_top").isNull()
        return both.select("target", F.coalesce("_top", "version").alias("version"), F.when(stays, F.coalesce("dirty", F.lit(False))).otherwise(F.lit(False)).alias("dirty"))

    def _publish(self, new: Commit) -> bool:
        """Whether the commit got its number: the file is written aside and renamed, which fails where the name is taken."""
        aside, place = self._hadoop(f"commits/.{uuid.uuid4().hex}"), self._hadoop(f"commits/{new.number:020d}.json")
        stream = self._files(aside).create(aside, False)
        try:
            stream.write(bytearray(json.dumps({"writes": new.writes, "cursor": new.cursor}).encode()))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self._conf) if place.toUri().getScheme() else self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._conf)
        plain = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(aside, place, plain)
        except Exception as e:
            taken = self._files(place).exists(place)
            self._files(aside).delete(aside, False)
            if not taken:
                raise RuntimeError(f"commit {new.number} in {self.path} could not be written") from e
            return False
        return True

    def _hadoop(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self, path):
        return path.getFileSystem(self._conf)

    def _delete(self, folder: str) -> None:
        path = self._jvm.org.apache.hadoop.fs.Path(folder)
        self._files(path).delete(path, True)


def read_ledger(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """The newest commit's ledger. ``strict``, for a single target, fails on a row that no ledger holds; for a fleet see
    :func:`read_checked`."""
    ledger = LedgerStore(spark, path).ledger()
    if not strict:
        return ledger
    problem = ledger_problem()
    return ledger.withColumn("version", F.when(problem.isNotNull(), F.raise_error(problem)).otherwise(F.col("version")))


def read_checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows of sound targets, refused rows with ``error``): a target with a bad row is left out, others are not affected."""
    good, refused = split_ledger(read_ledger(spark, path))
    return lookup(good, refused.select("target").distinct(), ["target"], "left_anti").select(LEDGER.fieldNames()), refused


def write_ledger(df: DataFrame, path: str, base: Commit | None = None) -> int:
    """Publish ``df`` as the whole ledger; the number of the commit. Readers of earlier commits are not disturbed."""
    return LedgerStore(df.sparkSession, path).replace(df, base=base)
