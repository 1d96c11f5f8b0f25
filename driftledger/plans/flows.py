"""Whole bookkeeping runs: what the ledger and cursor are after applying, reverting or rolling back.

Running the scripts is the databases' part; these flows record it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from driftledger import messages as M
from driftledger.operators.ledger import backfill, record_applied, record_reverted, recompute_cursor, soft_revert
from driftledger.operators.scripts import pending, split_dirty
from driftledger.schemas import CURSOR, conform
from driftledger.sources.store import Commit, Conflict, LedgerStore


class Recorded(NamedTuple):
    ledger: DataFrame
    cursor: DataFrame
    refused: DataFrame  # dirty targets with the reason


def apply_pending(ledger: DataFrame, corpus: DataFrame, cursor: DataFrame, now: dt.datetime) -> Recorded:
    """Backfill, then record every pending script as applied. The cursor moves to the last of them."""
    cursor = conform(cursor, CURSOR)
    last = pending(corpus, cursor, [], skip_dirty=True).groupBy("target").agg(F.max("version").alias("_last"))
    moved = cursor.join(last, "target", "full").select(
        "target",
        F.coalesce("_last", "version").alias("version"),
        (F.coalesce("dirty", F.lit(False)) & F.col("_last").isNull()).alias("dirty"),
    )
    _, refused = split_dirty(cursor)
    return Recorded(record_applied(backfill(ledger, corpus, cursor), corpus, cursor, now), moved, refused)


def rollback(ledger: DataFrame, corpus: DataFrame, cursor: DataFrame, now: dt.datetime, steps: int = 1) -> Recorded:
    """Backfill, then mark the last applied versions reverted without running down scripts."""
    cursor = conform(cursor, CURSOR)
    _, dirty = split_dirty(cursor)
    after = soft_revert(backfill(ledger, corpus, cursor), now, steps, cursor)
    moved = recompute_cursor(after, cursor).join(dirty.select("target"), "target", "left_anti")
    return Recorded(after, moved.unionByName(dirty.drop("error")), dirty)


def run_down(ledger: DataFrame, corpus: DataFrame, cursor: DataFrame, now: dt.datetime, steps: int = 1) -> Recorded:
    """Backfill, then record the down plan as reverted.

    The cursor moves to the highest version that is still applied; where the plan reverted the
    last one there is no version any more.
    """
    synced = backfill(ledger, corpus, cursor)
    reverted = record_reverted(synced, corpus, cursor, now, steps)
    clean, dirty = split_dirty(conform(cursor, CURSOR))
    top = F.max(F.when(F.col("status") == M.APPLIED, F.col("version")))
    before = synced.groupBy("target").agg(top.alias("_before"))
    after = reverted.groupBy("target").agg(top.alias("_after"))
    moved = clean.join(before, "target", "left").join(after, "target", "left")
    stepped = ~F.col("_before").eqNullSafe(F.col("_after"))
    new_version = F.when(stepped, F.col("_after")).otherwise(F.col("version")).alias("version")
    return Recorded(reverted, moved.select("target", new_version, "dirty").unionByName(dirty.drop("error")), dirty)


def committed(store: LedgerStore, flow: Callable[[DataFrame, DataFrame], Recorded], attempts: int = 10) -> tuple[Commit, DataFrame]:
    """Run a flow on the newest ledger and cursor of a store and publish both results in one commit; (commit, refused rows).

    If someone else commits meanwhile, the flow is run again on what they left.
    """
    for attempt in range(1, attempts + 1):
        base = store.commit()
        done = flow(store.ledger(base), store.cursor(base))
        try:
            return store.commit(store.replace(done.ledger, done.cursor, base)), done.refused
        except Conflict:
            if attempt == attempts:
                raise
    raise ValueError("at least one attempt is needed")
