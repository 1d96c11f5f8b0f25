"""Drift report: does each ledger row still hold?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from driftledger import messages as M
from driftledger.functions.ddl import dialect_of
from driftledger.functions.text import detail_text
from driftledger.operators.objects import OBJECT, gone_at
from driftledger.operators.scripts import script_facts, script_keys, with_scripts
from driftledger.operators.skew import lookup
from driftledger.sources.ledger import as_ledger
from driftledger.sources.shared import share


def _object_message(text: str) -> Column:
    return F.format_string(text, "schema", "name")


def audited(ledger: DataFrame, corpus: DataFrame, dialect: str) -> DataFrame:
    """Ledger rows joined with what their script says: file, edited or not, created and dropped objects.

    ``hashed`` marks applied rows with a recorded hash. This is the one pass over script text; it
    is shared, as the reports read it several times.
    """
    facts = script_facts(corpus, dialect)
    rows = with_scripts(as_ledger(ledger), facts, script_keys(corpus))
    hashed = (F.col("status") == M.APPLIED) & F.col("content_sha256").isNotNull()
    edited = hashed & (F.col("sha256") != F.col("content_sha256"))
    checked = rows.select(
        "target",
        "version",
        "status",
        F.col("filename").alias("file"),
        hashed.alias("hashed"),
        F.coalesce(edited, F.lit(False)).alias("edited"),
        "created",
        "dropped",
    )
    return share(checked, "audited")


def object_facts(rows: DataFrame, objects: DataFrame) -> DataFrame:
    """One row per object: that any row claims: does it exist, was it dropped for good.

    Claims, drops and live objects go through one aggregation that combines before its shuffle.
    """
    applied = F.col("status") == M.APPLIED
    version = F.col("version")
    nothing = F.lit(None).cast("bigint")

    def events(array: str, create: Column, drop: Column, claims: int) -> DataFrame:
        return rows.filter(F.size(array) > 0).select(
            "target",
            create.alias("c"),
            drop.alias("d"),
            F.lit(claims).alias("n"),
            F.lit(False).alias("e"),
            F.inline(array),
        )

    known = (
        events("created", F.when(applied, version), nothing, 1)
        .unionByName(events("dropped", nothing, F.when(applied, version), 0))
        .unionByName(
            objects.select(
                "target", *OBJECT, nothing.alias("c"), nothing.alias("d"), F.lit(0).alias("n"), F.lit(True).alias("e")
            )
        )
    )
    facts = known.groupBy("target", *OBJECT).agg(
        F.max("c").alias("last_create"),
        F.max("d").alias("last_drop"),
        F.sum("n").alias("n_rows"),
        F.max("e").alias("exists"),
    )
    return facts.filter("n_rows > 0").select("target", *OBJECT, "exists", gone_at().alias("gone_at"))


def _facts_by_name(rows: DataFrame, objects: DataFrame) -> DataFrame:
    """Object facts where existence is looked up by name and kind only, whatever the schema.

    The drop rule still tells schemas apart, so the facts stay one row per full object.
    """
    facts = object_facts(rows, objects.limit(0)).drop("exists")
    there = objects.select("target", "name", "kind").distinct().withColumn("exists", F.lit(True))
    joined = lookup(facts, there, ["target", "name", "kind"])
    return joined.withColumn("exists", F.coalesce("exists", F.lit(False)))


def object_findings(rows: DataFrame, objects: DataFrame, dialect: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """(target, version, pos, message) for each object that is missing or left over; with ``carried`` columns of its row."""
    by_name = not dialect_of(dialect).schema_matters
    facts = _facts_by_name(rows, objects) if by_name else object_facts(rows, objects)
    keys = ["target", *OBJECT]
    claims = rows.filter(F.size("created") > 0).select("target", "version", "status", *carried, F.posexplode("created"))
    claims = claims.select("target", "version", "status", "pos", *carried, "col.*")
    judged = lookup(claims, facts, keys, "inner")
    excused = F.coalesce(F.col("gone_at") > F.col("version"), F.lit(False))
    missing = (F.col("status") == M.APPLIED) & ~F.col("exists") & ~excused
    leftover = (F.col("status") == M.REVERTED) & F.col("exists")
    message = F.when(missing, _object_message(M.MISSING_OBJECT)).when(leftover, _object_message(M.LEFTOVER_OBJECT))
    return judged.select("target", "version", "pos", message.alias("message"), *carried).filter("message IS NOT NULL")


def verify(
    ledger: DataFrame, corpus: DataFrame, objects: DataFrame, dialect: str, location: str = "corpus"
) -> DataFrame:
    """(target, version, file, status, detail), one row per ledger row, status OK or DRIFT.

    An applied row needs its script, unedited since, and every object the script creates,
    unless a later applied script dropped it for good. A reverted row must have left no
    such object; its script may be gone. The detail names the hash first, then objects in
    source order. One script's findings are gathered per (target, version), never per target.
    """
    return verify_audited(audited(ledger, corpus, dialect), objects, dialect, location)


def verify_audited(rows: DataFrame, objects: DataFrame, dialect: str, location: str = "corpus") -> DataFrame:
    """The drift report from rows of :func:`audited`."""
    found = object_findings(rows, objects, dialect)
    per_row = found.groupBy("target", "version").agg(
        F.array_sort(F.collect_list(F.struct("pos", "message"))).alias("_found")
    )
    no_script = F.format_string(M.NO_SCRIPT, F.col("version"), F.lit(location))
    lost = F.col("file").isNull() & (F.col("status") == M.APPLIED)
    parts = F.concat(
        F.array_compact(F.array(F.when(lost, no_script), F.when(F.col("edited"), F.lit(M.EDITED)))),
        F.coalesce(F.col("_found.message"), F.array().cast("array<string>")),
    )
    joined = rows.select("target", "version", "status", "file", "edited").join(per_row, ["target", "version"], "left")
    return joined.select(
        "target",
        "version",
        F.coalesce("file", F.lit("")).alias("file"),
        F.when(F.size(parts) > 0, M.DRIFT).otherwise(M.OK).alias("status"),
        detail_text(parts).alias("detail"),
    )


def drift_counts(report: DataFrame) -> DataFrame:
    """(target, n_checked, n_drift) of a drift report."""
    return report.groupBy("target").agg(
        F.count(F.lit(1)).alias("n_checked"), F.count_if(F.col("status") == M.DRIFT).alias("n_drift")
    )


def drift_facts(rows: DataFrame, objects: DataFrame, dialect: str) -> DataFrame:
    """(target, n_checked, n_drift, n_mismatch) as rows to be added up per target, from rows of :func:`audited`.

    A ledger row counts once, whatever is wrong with it; one with findings of its objects only is told apart from one
    that its script shows as bad already, so no finding is joined back to its row. For ``n_mismatch`` a missing script
    counts as well.
    """
    gone = F.col("file").isNull()
    bad = F.col("edited") | (gone & (F.col("status") == M.APPLIED))
    mismatch = F.col("hashed") & (F.col("edited") | gone)
    count = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    own = rows.select("target", F.lit(1).cast("long").alias("n_checked"), count(bad).alias("n_drift"), count(mismatch).alias("n_mismatch"))
    found = object_findings(rows.withColumn("sound", ~F.coalesce(bad, F.lit(False))), objects, dialect, ("sound",)).filter("sound")
    nothing = F.lit(0).cast("long")
    more = found.select("target", "version").distinct()
    return own.unionByName(more.select("target", nothing.alias("n_checked"), F.lit(1).cast("long").alias("n_drift"), nothing.alias("n_mismatch")))


def unverifiable(targets: DataFrame, ledger: DataFrame) -> DataFrame:
    """Targets that cannot be verified as their ledger holds nothing, with the reason."""
    empty = targets.select("target").join(ledger.select("target").distinct(), "target", "left_anti")
    message = F.format_string("ledger for %s is empty or not initialised", F.col("target"))
    return empty.withColumn("error", message)
