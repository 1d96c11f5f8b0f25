"""Health checks per target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from driftledger.functions.text import explode_rows
from driftledger.operators.scripts import pending_facts
from driftledger.plans.status import EXIT_ERROR, EXIT_ISSUES, EXIT_OK
from driftledger.plans.verify import audited, drift_facts
from driftledger.schemas import CURSOR, TARGETS, conform, has_target


def _check(name: str, outcome: Column, message: Column) -> Column:
    return F.struct(F.lit(name).alias("check"), outcome.alias("status"), message.alias("message"))


def _counted(text: str, number: str) -> Column:
    return F.format_string(text, F.coalesce(F.col(number), F.lit(0)))


def doctor_inputs(
    targets: DataFrame, ledger: DataFrame, corpus: DataFrame, objects: DataFrame, cursor: DataFrame, dialect: str
) -> DataFrame:
    """Everything the checks need, one row per target.

    Targets, cursors, pending scripts and drift are rows of one table, which is folded by target once; the fold combines
    before its shuffle, so a target with very many facts is no hot key. Facts of targets that are not listed go.
    """
    about = StructType([*TARGETS.fields, StructField("has_ledger", BooleanType())])
    who = conform(targets, about).select("target", F.struct(*about.fieldNames()[1:]).alias("who"))
    cursor = conform(cursor, CURSOR)
    places = cursor if has_target(corpus) else targets.select("target").join(cursor, "target", "left")
    waiting = pending_facts(corpus, places).select("target", F.col("n").alias("n_pending"))
    drift = drift_facts(audited(ledger, corpus, dialect), objects, dialect)
    placed = cursor.select("target", F.struct("version", "dirty").alias("place"))
    facts = who
    for part in (placed, waiting, drift):
        facts = facts.unionByName(part, allowMissingColumns=True)
    numbers = ("n_pending", "n_checked", "n_drift", "n_mismatch")
    folded = facts.groupBy("target").agg(F.max("who").alias("who"), F.max("place").alias("place"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in numbers])
    has_version = F.col("place.version").isNotNull()
    return folded.filter("who IS NOT NULL").select(
        "target",
        "who.*",
        F.coalesce("place.version", F.lit(0)).alias("current_version"),
        has_version.alias("has_version"),
        (F.coalesce("place.dirty", F.lit(False)) & has_version).alias("dirty"),
        *numbers,
    )


def doctor(
    targets: DataFrame,
    ledger: DataFrame,
    corpus: DataFrame,
    objects: DataFrame,
    cursor: DataFrame,
    dialect: str,
    names: list[str] | None = None,
    missing_folder: str | None = None,
) -> DataFrame:
    """(target, engine, healthy, exit, pos, check, status, message), one row per check.

    An unreachable target has only its connectivity and security rows, and exit 1. ``names``
    restricts the report; a name that is no target gets one failing row. ``missing_folder`` is
    the name of the script folder when there is none. ``targets.has_ledger``, if there is such a column, tells an empty
    ledger from none.
    """
    rows = doctor_inputs(targets, ledger, corpus, objects, cursor, dialect).withColumn("known", F.lit(True))
    if names is not None:
        asked = targets.sparkSession.createDataFrame([(n,) for n in names], "target string")
        rows = asked.join(rows, "target", "left").withColumn("known", F.coalesce("known", F.lit(False)))

    ok, warn, fail = F.lit("ok"), F.lit("warn"), F.lit("fail")
    reachable = F.col("known") & F.col("error").isNull()
    has_rows = F.coalesce("n_checked", F.lit(0)) > 0
    # An existing ledger without rows is sound, as far as it goes. Where targets do not tell, rows are what shows a ledger.
    has_ledger = F.coalesce("has_ledger", has_rows) if "has_ledger" in targets.columns else has_rows
    mismatch = F.coalesce("n_mismatch", F.lit(0)) > 0
    drifted = F.coalesce("n_drift", F.lit(0)) > 0
    waiting = F.coalesce("n_pending", F.lit(0)) > 0
    no_env = F.coalesce("url_env", F.lit("")) == ""

    connectivity = _check(
        "connectivity",
        F.when(reachable, ok).otherwise(fail),
        F.when(~F.col("known"), F.format_string('unknown target "%s"', "target"))
        .when(reachable, F.format_string("connected to database (%s)", "engine"))
        .otherwise(F.col("error")),
    )
    integrity = _check(
        "ledger-integrity",
        F.when(~has_ledger, warn).when(mismatch, fail).otherwise(ok),
        F.when(~has_ledger, "ledger table uninitialized or empty")
        .when(mismatch, _counted("content hash mismatch in %d migration(s)", "n_mismatch"))
        .otherwise(F.format_string("%d ledger entries verified (hashes match)", F.coalesce("n_checked", F.lit(0)))),
    )
    sync = _check(
        "version-sync",
        F.when(waiting, fail).otherwise(ok),
        F.when(
            waiting, F.format_string("%d pending migration(s) (current version %d)", "n_pending", "current_version")
        )
        .when(F.col("has_version"), _counted("up to date (version %d)", "current_version"))
        .otherwise("no migrations applied (clean database)"),
    )
    drift = _check(
        "drift-summary",
        F.when(~has_rows, warn).when(drifted, fail).otherwise(ok),
        F.when(~has_rows, "skipped (ledger empty or not initialized)")
        .when(drifted, _counted("drift detected in %d migration(s)", "n_drift"))
        .otherwise("no schema drift detected"),
    )
    dirty = _check(
        "dirty-ledger",
        F.when(F.col("dirty"), fail).otherwise(ok),
        F.when(
            F.col("dirty"), _counted("ledger is marked DIRTY at version %d (previous apply failed)", "current_version")
        ).otherwise("ledger clean (dirty=false)"),
    )
    folder = F.lit("" if missing_folder is None else f', migrations_dir "{missing_folder}" missing')
    security = _check(
        "security-flags",
        F.when(no_env | F.lit(missing_folder is not None), warn).otherwise(ok),
        F.concat(
            F.when(no_env, "url_env not configured").otherwise(F.concat(F.lit("url_env="), F.col("url_env"))),
            F.lit(", protected="),
            F.coalesce("protected", F.lit(False)).cast("string"),
            folder,
        ),
    )
    checks = (
        F.when(~F.col("known"), F.array(connectivity))
        .when(~reachable, F.array(connectivity, security))
        .otherwise(F.array(connectivity, integrity, sync, drift, dirty, security))
    )
    failing = F.exists("checks", lambda c: c["status"] == "fail")
    code = F.when(~reachable, EXIT_ERROR).when(failing, EXIT_ISSUES).otherwise(EXIT_OK)
    judged = rows.withColumn("checks", checks).withColumn("exit", code)
    judged = judged.withColumn("healthy", F.col("exit") == EXIT_OK)
    keep = ["target", "engine", "healthy", "exit"]
    return explode_rows(judged, keep, F.col("checks")).select(*keep, "pos", "item.*")


def doctor_exits(report: DataFrame) -> DataFrame:
    """(target, exit) of a doctor report; feed it to ``fleet_exit`` for one code."""
    return report.filter("pos = 0").select("target", "exit")
