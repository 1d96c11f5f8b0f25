"""Correcting ledger statuses by instruction."""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from driftledger import messages as M
from driftledger.functions.text import explode_rows, parse_uint64
from driftledger.operators.ledger import KEYS, backfill, blocked_targets, recompute_cursor, set_status
from driftledger.operators.objects import missing_objects
from driftledger.operators.scripts import script_facts, script_keys, split_dirty, with_scripts
from driftledger.operators.skew import lookup
from driftledger.functions.ddl import dialect_of
from driftledger.schemas import CURSOR, INSTRUCTIONS, conform
from driftledger.sources.shared import share


class Repaired(NamedTuple):
    ledger: DataFrame
    cursor: DataFrame
    violations: DataFrame  # (target, version, error)


def parse_instructions(df: DataFrame, text: str = "instructions") -> DataFrame:
    """One row per part of "version:status,version:status,...": (..., pos, part, version, status, error)."""
    parts = F.split(F.col(text), ",", -1)

    def read(part, pos):
        pieces = F.split(part, ":", 2)
        return F.struct(
            part.alias("part"),
            pos.alias("pos"),
            F.size(pieces).alias("n"),
            F.get(pieces, F.lit(0)).alias("number"),
            F.get(pieces, F.lit(1)).alias("status"),
            parse_uint64(F.get(pieces, F.lit(0))).alias("version"),
        )

    def repeated(sorted_parts):
        """Positions of the parts whose version an earlier part has; sorting brings equal versions together."""
        same = F.filter(sorted_parts, lambda p, i: p["version"] == F.get(sorted_parts, i - 1)["version"])
        return F.transform(same, lambda p: p["pos"])

    rows = df.withColumn("_parts", F.transform(parts, read))
    by_version = F.transform("_parts", lambda p: F.struct(p["version"].alias("version"), p["pos"].alias("pos")))
    rows = rows.withColumn("_sorted", F.array_sort(by_version)).withColumn("_repeated", repeated(F.col("_sorted")))
    keep = [c for c in df.columns if c != text]
    rows = explode_rows(rows, [*keep, "_repeated"], F.col("_parts"), "_pos").select(*keep, "_repeated", "item.*")
    valid = F.col("status").isin(M.APPLIED, M.REVERTED)
    earlier = F.array_contains("_repeated", F.col("pos"))
    error = (
        F.when(F.col("n") < 2, F.format_string('invalid version:status pair "%s" (want VERSION:applied or VERSION:reverted)', "part"))
        .when(F.col("version").isNull(), F.format_string('invalid version "%s" in pair "%s"', "number", "part"))
        .when(~valid, F.format_string('invalid status "%s" in pair "%s" (want applied or reverted)', "status", "part"))
        .when(earlier, F.format_string("duplicate version %s in repair args", F.col("version").cast("string")))
        .when(F.col("version").try_cast("bigint").isNull(), F.format_string('version "%s" is out of range', "number"))
    )
    return rows.select(*keep, "pos", "part", F.col("version").try_cast("bigint").alias("version"), "status", error.alias("error"))


def accepted_instructions(parsed: DataFrame) -> DataFrame:
    """Instructions of the targets all of whose parts are valid: one bad part rejects the whole text."""
    accepted = lookup(parsed, blocked_targets(parsed), ["target"], "left_anti")
    return conform(accepted, INSTRUCTIONS)


def repair_violations(
    corpus: DataFrame, objects: DataFrame, instructions: DataFrame, dialect: str, force: bool = False,
    location: str = "corpus",
) -> DataFrame:
    """(target, version, error): statuses that are none, versions instructed more than once, applied versions without a
    script or, unless forced, with missing objects."""
    known_status = F.coalesce(F.col("status").isin(M.APPLIED, M.REVERTED), F.lit(False))
    no_status = F.format_string(M.NO_STATUS, "version", F.coalesce("status", F.lit("")))
    unsound = instructions.filter(~known_status).select(*KEYS, no_status.alias("error"))
    repeated = instructions.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    unsound = unsound.unionByName(repeated.select(*KEYS, F.format_string(M.REPEATED, "version").alias("error")))
    wanted = instructions.filter(F.col("status") == M.APPLIED).select(*KEYS)
    known = with_scripts(wanted, script_facts(corpus, dialect), script_keys(corpus))
    known = share(known.select(*KEYS, "filename", "created"), "instructed")
    no_script = F.format_string(M.NO_SCRIPT, F.col("version"), F.lit(location))
    violations = known.filter("filename IS NULL").select(*KEYS, no_script.alias("error")).unionByName(unsound)
    if force:
        return violations
    claims = known.filter(F.size("created") > 0).select(*KEYS, "filename", F.posexplode("created"))
    claims = claims.select(*KEYS, "filename", "pos", "col.*")
    missing = missing_objects(claims, objects, ignore_schema=not dialect_of(dialect).schema_matters)
    text = F.format_string("version %d (%s): %s.%s does not exist", "version", "filename", "schema", "name")
    return violations.unionByName(missing.select(*KEYS, text.alias("error")))


def repair(
    ledger: DataFrame,
    corpus: DataFrame,
    objects: DataFrame,
    cursor: DataFrame,
    instructions: DataFrame,
    dialect: str,
    now: dt.datetime,
    force: bool = False,
) -> Repaired:
    """Write the instructed statuses, for each target all of them or none, then recompute its cursor.

    The ledgers of the instructed targets are backfilled first. A target with a violation, or a
    dirty cursor, keeps its statuses and cursor; other targets are not touched at all.
    """
    instructions = conform(instructions, INSTRUCTIONS)
    _, dirty = split_dirty(cursor)
    violations = repair_violations(corpus, objects, instructions, dialect, force)
    asked = instructions.select("target").distinct()
    refused = dirty.join(asked, "target", "left_semi").select("target", "version", "error")
    violations = share(violations.unionByName(refused), "violations")
    granted = lookup(instructions, blocked_targets(violations), ["target"], "left_anti")
    synced = backfill(ledger, corpus, conform(cursor, CURSOR).join(asked, "target", "left_semi"))
    new_ledger = set_status(synced, granted, now)

    touched = asked.join(blocked_targets(violations), "target", "left_anti").withColumn("_touched", F.lit(True))
    before = conform(cursor, CURSOR).select("target", F.col("version").alias("_was"), F.col("dirty").alias("_was_dirty"))
    moved = recompute_cursor(new_ledger, cursor).join(before, "target", "left").join(touched, "target", "left")
    stays = F.col("_touched").isNull()
    new_cursor = moved.select(
        "target",
        F.when(stays, F.col("_was")).otherwise(F.col("version")).alias("version"),
        F.when(stays, F.col("_was_dirty")).otherwise(F.col("dirty")).alias("dirty"),
    )
    return Repaired(new_ledger, new_cursor, violations)
