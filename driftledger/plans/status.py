"""Per-target status and plan.

Lists such as pending scripts and drift lines are rows, not arrays in one row per
target: a target may have more of them than one task can hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from driftledger import messages as M
from driftledger.operators.scripts import pending, pending_summary
from driftledger.operators.skew import lookup
from driftledger.plans.verify import drift_counts, verify
from driftledger.schemas import CURSOR, TARGETS, conform

EXIT_OK, EXIT_ERROR, EXIT_ISSUES = 0, 1, 2


def _one(df: DataFrame, names: list[str] | None) -> DataFrame:
    return df if names is None else df.filter(F.col("target").isin(names))


def with_refused(targets: DataFrame, *refused: DataFrame) -> DataFrame:
    """``targets`` where each target that has refused rows (target, ..., error), of a write, a ledger or a folder, has the
    smallest of their reasons as its error. So the reports show it as failing, and all others as they are."""
    reasons = refused[0].select("target", "error")
    for more in refused[1:]:
        reasons = reasons.unionByName(more.select("target", "error"))
    reasons = reasons.groupBy("target").agg(F.min("error").alias("_refused"))
    kept = [c for c in targets.columns if c != "error"]
    own = F.col("error") if "error" in targets.columns else F.lit(None).cast("string")
    return targets.join(reasons, "target", "left").select(*kept, F.coalesce(own, F.col("_refused")).alias("error"))


def status(
    corpus: DataFrame, cursor: DataFrame, targets: DataFrame | None = None, names: list[str] | None = None
) -> DataFrame:
    """One row per target: version, dirty flag, number pending, first pending script, state text, error.

    A target with an error (in ``targets``) keeps only that; the others are not affected.
    ``names`` restricts the report to some targets.
    """
    corpus = _one(corpus, names) if "target" in corpus.columns else corpus
    cursor = _one(conform(cursor, CURSOR), names)
    if targets is None:
        rows = cursor.join(pending_summary(corpus, cursor), "target", "full").withColumn(
            "error", F.lit(None).cast("string")
        )
    else:
        listed = _one(conform(targets, TARGETS), names).select("target", "error")
        placed = listed.join(cursor, "target", "left")
        waiting = pending_summary(corpus, placed if "target" not in corpus.columns else cursor)
        rows = placed.join(waiting, "target", "left")
    good = F.col("error").isNull()
    n = F.coalesce("n_pending", F.lit(0))
    dirty = F.coalesce("dirty", F.lit(False)) & F.col("version").isNotNull()
    state = F.when(n > 0, F.concat(n.cast("string"), F.lit(" pending"))).otherwise(F.lit("up to date"))
    return rows.select(
        "target",
        F.when(good, F.coalesce("version", F.lit(0))).alias("current_version"),
        F.when(good, F.col("version").isNotNull()).alias("has_version"),
        F.when(good, dirty).alias("dirty"),
        F.when(good, n).alias("n_pending"),
        F.when(good, F.col("next_version")).alias("next_version"),
        F.when(good, F.col("next_file")).alias("next_file"),
        F.when(good, F.concat(state, F.when(dirty, F.lit(" [DIRTY]")).otherwise(F.lit(""))))
        .otherwise(F.concat(F.lit("error: "), F.col("error")))
        .alias("state"),
        "error",
    )


def plan(
    ledger: DataFrame,
    corpus: DataFrame,
    objects: DataFrame,
    cursor: DataFrame,
    dialect: str,
    targets: DataFrame | None = None,
) -> DataFrame:
    """Status plus ``n_drift`` and ``exit``: 1 on error, 2 when there is anything to look at, else 0.

    Drift is only looked for where a version exists. See :func:`plan_lines` for the lists.
    """
    drift = drift_counts(verify(ledger, corpus, objects, dialect)).drop("n_checked")
    rows = status(corpus, cursor, targets).join(drift, "target", "left")
    n_drift = F.when(F.col("error").isNull(), F.when(F.col("has_version"), F.coalesce("n_drift", F.lit(0))).otherwise(0))
    issue = (F.col("n_pending") > 0) | (F.col("n_drift") > 0) | F.col("dirty")
    exit_code = F.when(F.col("error").isNotNull(), EXIT_ERROR).when(issue, EXIT_ISSUES).otherwise(EXIT_OK)
    return rows.withColumn("n_drift", n_drift).withColumn("exit", exit_code).drop("state")


def plan_lines(
    ledger: DataFrame,
    corpus: DataFrame,
    objects: DataFrame,
    cursor: DataFrame,
    dialect: str,
    targets: DataFrame | None = None,
) -> DataFrame:
    """(target, section, version, line): pending file names, and ``v<version>: <detail>`` for drift."""
    cursor = conform(cursor, CURSOR)
    if targets is not None:
        scope = conform(targets, TARGETS).filter("error IS NULL").select("target")
        cursor = scope.join(cursor, "target", "left").select(*CURSOR.fieldNames())
    waiting = pending(corpus, cursor, listed_only=targets is not None).select(
        "target", F.lit("pending").alias("section"), "version", F.col("filename").alias("line")
    )
    placed = cursor.filter("version IS NOT NULL").select("target")
    audited = lookup(ledger, placed, ["target"], "left_semi")
    report = verify(audited, corpus, objects, dialect)
    drift = report.filter(F.col("status") != M.OK).select(
        "target",
        F.lit("drift").alias("section"),
        "version",
        F.concat(F.lit("v"), F.col("version").cast("string"), F.lit(": "), F.col("detail")).alias("line"),
    )
    return waiting.unionByName(drift)


def fleet_exit(rows: DataFrame) -> DataFrame:
    """One code for all targets: any error 1, else any issue 2, else 0."""
    code = F.col("exit")
    worst = F.max(F.when(code == EXIT_ERROR, 2).when(code == EXIT_ISSUES, 1).otherwise(0))
    return rows.agg(F.coalesce(worst, F.lit(0)).alias("worst")).select(
        F.when(F.col("worst") == 2, EXIT_ERROR).when(F.col("worst") == 1, EXIT_ISSUES).otherwise(EXIT_OK).alias("exit")
    )
