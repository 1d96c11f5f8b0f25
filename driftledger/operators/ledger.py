"""Reading from and writing to the ledger. Writes return the new ledger as a DataFrame."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from driftledger import messages as M
from driftledger.operators.scripts import find, pending, reached, script_facts, split_dirty, with_scripts, script_keys
from driftledger.operators.skew import lookup
from driftledger.schemas import CURSOR, LEDGER, conform
from driftledger.sources.ledger import as_ledger, ledger_problem
from driftledger.sources.shared import share

KEYS = ["target", "version"]

# Applied versions of a target up to which they are ranked in one piece.
RANGE = 1 << 16


def timestamp(now: dt.datetime | None) -> Column:
    """A point in time; without a zone it is wall-clock time of the session's zone."""
    return F.lit(None if now is None else now.isoformat(sep=" ")).cast("timestamp")


def _changes(rows: DataFrame, status: str, now: dt.datetime | None, note: str, sha256: Column | None = None) -> DataFrame:
    return rows.select(
        "target",
        "version",
        F.lit(status).alias("status"),
        timestamp(now).alias("recorded_at"),
        F.lit(note).alias("note"),
        (F.lit(None).cast("string") if sha256 is None else sha256).alias("content_sha256"),
    )


def applied_versions(ledger: DataFrame) -> DataFrame:
    return ledger.filter(F.col("status") == M.APPLIED).select(*KEYS)


def split_changes(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes to write, refused rows with ``error``) of changes that come from outside.

    Refused are rows that no ledger holds (no version, a negative one, an unknown status) and versions changed more than
    once, as which of these rows would stand is not defined. A target with any refused row is left out altogether; the
    others are not affected. Feed the refused rows to ``plans.status.with_refused`` to see them in the reports.
    """
    rows = as_ledger(changes)
    facts = F.struct(*[c for c in LEDGER.fieldNames() if c not in KEYS])
    each = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"), F.max(ledger_problem()).alias("_problem"), F.first(facts).alias("_row"))
    repeated = F.when(F.col("_n") > 1, F.format_string(M.CHANGED_TWICE, "version"))
    each = share(each.select(*KEYS, "_row.*", F.coalesce("_problem", repeated).alias("error")), "changes")
    refused = each.filter("error IS NOT NULL").select(*KEYS, "error")
    accepted = each.filter("error IS NULL").drop("error")
    return lookup(accepted, refused.select("target").distinct(), ["target"], "left_anti").select(LEDGER.fieldNames()), refused


def upsert(ledger: DataFrame, changes: DataFrame, hash_policy: str = "keep_first") -> DataFrame:
    """Insert new (target, version) rows; on existing ones replace status, time and note.

    The hash of an existing row is kept, even when it is absent; ``hash_policy="latest"``
    takes the new one instead. ``changes`` has one row per key (see :func:`fold`, and :func:`split_changes` for changes that
    come from outside). Both sides are unique on the join key, so no key is hot.
    """
    if hash_policy not in ("keep_first", "latest"):
        raise ValueError(f"unknown hash policy {hash_policy!r}")
    old, new = conform(ledger, LEDGER).alias("old"), conform(changes, LEDGER).alias("new")
    old, new = old.withColumn("_old", F.lit(True)), new.withColumn("_new", F.lit(True))
    was, comes = F.col("_old").isNotNull(), F.col("_new").isNotNull()

    def pick(column: str) -> Column:
        return F.when(comes, F.col(f"new.{column}")).otherwise(F.col(f"old.{column}")).alias(column)

    new_hash = comes if hash_policy == "latest" else ~was
    sha256 = F.when(new_hash, F.col("new.content_sha256")).otherwise(F.col("old.content_sha256"))
    return old.join(new, KEYS, "full").select(
        *KEYS, pick("status"), pick("recorded_at"), pick("note"), sha256.alias("content_sha256")
    )


def fold(log: DataFrame, order: list[str], keys: list[str] = KEYS) -> DataFrame:
    """Replay a log of changes: last status, time and note per key, first hash.

    ``order`` columns give the sequence. Both picks combine before the shuffle.
    """
    sequence = F.struct(*order)
    last = F.max_by(F.struct("status", "recorded_at", "note"), sequence).alias("_last")
    first = F.min_by(F.struct("content_sha256"), sequence).alias("_first")
    return log.groupBy(*keys).agg(last, first).select(*keys, "_last.*", "_first.*")


def insert_if_absent(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    """Add the rows whose key the ledger does not have."""
    absent = conform(rows, LEDGER).join(ledger.select(*KEYS), KEYS, "left_anti")
    return conform(ledger, LEDGER).unionByName(absent.select(LEDGER.fieldNames()))


def backfilled(ledger: DataFrame, corpus: DataFrame, cursor: DataFrame) -> DataFrame:
    """The rows that :func:`backfill` adds."""
    clean, _ = split_dirty(cursor)
    rows = _changes(reached(corpus, clean), M.APPLIED, None, M.NOTE_BACKFILLED)
    return rows.join(ledger.select(*KEYS), KEYS, "left_anti").select(LEDGER.fieldNames())


def backfill(ledger: DataFrame, corpus: DataFrame, cursor: DataFrame) -> DataFrame:
    """Record every script up to the cursor that the ledger does not know, without time and hash.

    Targets with a dirty cursor, or without a version, stay as they are.
    """
    return conform(ledger, LEDGER).unionByName(backfilled(ledger, corpus, cursor))


def recompute_cursor(ledger: DataFrame, cursor: DataFrame) -> DataFrame:
    """Highest applied version per target; where nothing is applied the stored cursor stays."""
    highest = ledger.groupBy("target").agg(F.max(F.when(F.col("status") == M.APPLIED, F.col("version"))).alias("_top"))
    joined = conform(cursor, CURSOR).join(highest, "target", "full")
    stamped = F.col("_top").isNotNull()
    return joined.select(
        "target",
        F.coalesce("_top", "version").alias("version"),
        F.when(stamped, F.lit(False)).otherwise(F.coalesce("dirty", F.lit(False))).alias("dirty"),
    )


def _cuts(applied: DataFrame) -> dict[str, list[int]]:
    """Versions that part the targets with very many rows into ranges of nearly equal numbers of rows.

    A range has RANGE rows or one shuffle partition's share of all rows, whichever is more. So at most as many targets as
    there are shuffle partitions are cut, into about as many ranges, and this is all that reaches the driver.
    """
    spark = applied.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = applied.groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    total = applied.agg(F.count(F.lit(1))).first()[0]
    if total <= RANGE:
        return {}
    share_of = max(RANGE, -(-total // parts))
    large = {r["target"]: -(-r["n"] // share_of) for r in counts.filter(F.col("target").isNotNull() & (F.col("n") > share_of)).collect()}
    if not large:
        return {}
    shares = lambda n: [i / n for i in range(1, n)]
    most = max(large.values())
    quantiles = [F.percentile_approx("version", shares(n), 100 * most).alias(f"q{n}") for n in sorted(set(large.values()))]
    found = applied.filter(F.col("target").isin(list(large))).groupBy("target").agg(*quantiles).collect()
    return {r["target"]: sorted(set(r[f"q{large[r['target']]}"])) for r in found}


def last_applied(ledger: DataFrame, steps: int) -> DataFrame:
    """The ``steps`` highest applied versions per target with their ``step``, 1 being the newest.

    Versions are ranked per target, and what is beyond ``steps`` within a task is dropped before the one exchange. A target
    with very many versions is ranked in ranges that quantiles of its own versions cut; a version's step is its rank within
    its range and what the newer ranges hold, one row a range. So no task ranks all of such a target, whatever ``steps``
    is and however unevenly its versions lie.
    """
    applied = applied_versions(ledger)
    cuts = _cuts(applied)
    newer = F.lit(0)
    for target, versions in cuts.items():
        newer = F.when(F.col("target") == target, F.size(F.filter(F.lit(versions), lambda c: c > F.col("version")))).otherwise(newer)
    sliced = applied.withColumn("_slice", newer)
    newest_first = Window.partitionBy("target", "_slice").orderBy(F.desc("version"))
    ranked = sliced.withColumn("_rank", F.row_number().over(newest_first)).filter(F.col("_rank") <= steps)
    if not cuts:
        return ranked.select(*KEYS, F.col("_rank").alias("step"))
    counts = sliced.filter(F.col("target").isin(list(cuts))).groupBy("target", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    above = Window.partitionBy("target").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("target", "_slice", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_above"))
    # One row a range: at most about twice the number of shuffle partitions.
    placed = ranked.join(F.broadcast(offsets), ["target", "_slice"], "left")
    step = (F.coalesce("_above", F.lit(0)) + F.col("_rank")).cast("int")
    return placed.withColumn("step", step).filter(F.col("step") <= steps).select(*KEYS, "step")


def down_plan(ledger: DataFrame, corpus: DataFrame, steps: int = 1, location: str = "corpus") -> DataFrame:
    """Down scripts of the last ``steps`` applied versions; ``steps <= 0`` means all of them.

    ``error`` marks versions without a down script. Descending version is the order to run in.
    """
    planned = last_applied(ledger, steps).drop("step") if steps > 0 else applied_versions(ledger)
    return find(corpus, planned, M.DOWN, location)


def blocked_targets(rows: DataFrame) -> DataFrame:
    """Targets with any row that has an ``error``: for them nothing at all is written."""
    return rows.filter("error IS NOT NULL").select("target").distinct()


def record_reverted(ledger: DataFrame, corpus: DataFrame, cursor: DataFrame, now: dt.datetime, steps: int = 1) -> DataFrame:
    """Mark the planned versions reverted. Targets that are dirty, or lack a down script, stay as they are.

    The hash of the down script is offered but an existing row keeps its own.
    """
    plan = down_plan(ledger, corpus, steps)
    _, dirty = split_dirty(cursor)
    stopped = blocked_targets(plan).union(dirty.select("target")).distinct()
    plan = lookup(plan.select(*KEYS), stopped, ["target"], "left_anti")
    files = script_facts(corpus, None, M.DOWN).drop("filename")
    hashed = with_scripts(plan, files, script_keys(corpus))
    return upsert(ledger, _changes(hashed, M.REVERTED, now, M.NOTE_REVERTED, F.col("sha256")))


def soft_reverted(ledger: DataFrame, steps: int = 1) -> DataFrame:
    """The versions :func:`soft_revert` takes: the last ``steps``, or one where there are fewer (or steps <= 0)."""
    if steps <= 1:
        return applied_versions(ledger).groupBy("target").agg(F.max("version").alias("version"))
    applied = applied_versions(ledger).groupBy("target").agg(F.count(F.lit(1)).alias("_n"))
    taken = F.when(F.col("_n") < steps, F.lit(1)).otherwise(F.lit(steps))
    return lookup(last_applied(ledger, steps), applied, ["target"], "inner").filter(F.col("step") <= taken).select(*KEYS)


def soft_revert(ledger: DataFrame, now: dt.datetime, steps: int = 1, cursor: DataFrame | None = None) -> DataFrame:
    """Mark the last versions reverted in the ledger only; no script is looked at.

    With a cursor given, targets where it is dirty stay as they are.
    """
    taken = soft_reverted(ledger, steps)
    if cursor is not None:
        _, dirty = split_dirty(cursor)
        taken = lookup(taken, dirty.select("target"), ["target"], "left_anti")
    return upsert(ledger, _changes(taken, M.REVERTED, now, M.NOTE_SOFT_REVERTED))


def record_applied(ledger: DataFrame, corpus: DataFrame, cursor: DataFrame, now: dt.datetime) -> DataFrame:
    """Mark everything pending as applied, with the hash of the script; dirty targets stay as they are."""
    todo = pending(corpus, cursor, [], skip_dirty=True).distinct()
    hashed = with_scripts(todo, script_facts(corpus, None).drop("filename"), script_keys(corpus))
    return upsert(ledger, _changes(hashed, M.APPLIED, now, M.NOTE_APPLIED, F.col("sha256")))


def set_status(ledger: DataFrame, instructions: DataFrame, now: dt.datetime, note: str = M.NOTE_REPAIRED) -> DataFrame:
    """Write the requested statuses; hashes are not touched."""
    changes = instructions.select(*KEYS, "status").withColumns(
        {"recorded_at": timestamp(now), "note": F.lit(note)}
    )
    return upsert(ledger, changes)


def hash_drift(ledger: DataFrame, corpus: DataFrame, missing_is_mismatch: bool = False) -> DataFrame:
    """Applied rows whose recorded hash differs from the script's present one.

    A script that is gone is a different finding, unless ``missing_is_mismatch``.
    """
    recorded = ledger.filter((F.col("status") == M.APPLIED) & F.col("content_sha256").isNotNull())
    recorded = recorded.select(*KEYS, F.col("content_sha256").alias("recorded_sha256"))
    joined = with_scripts(recorded, script_facts(corpus, None), script_keys(corpus))
    differs = F.col("sha256") != F.col("recorded_sha256")
    return joined.filter(F.coalesce(differs, F.lit(missing_is_mismatch))).select(
        *KEYS, "filename", "recorded_sha256", F.col("sha256").alias("present_sha256")
    )


def ledger_with_scripts(ledger: DataFrame, corpus: DataFrame, location: str = "corpus") -> DataFrame:
    """Ledger rows with their file name; a missing file is only acceptable for a reverted row."""
    found = find(corpus, conform(ledger, LEDGER), M.UP, location)
    bad = F.col("status") == M.APPLIED
    return found.withColumn("error", F.when(bad, F.col("error")))
