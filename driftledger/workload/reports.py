"""The audit reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftledger.plans import doctor as D
from driftledger.plans import status as P
from driftledger.plans import verify as V
from driftledger.workload import oracle_sql as O
from driftledger.workload.registry import query

_PG = O.judged("pg").strip()


@query(f"WITH {_PG} SELECT * FROM report")
def verify(t):
    return V.verify(t.ledger_d, t.corpus_d, t.objects_d, "pg")


@query(f"WITH {O.judged('ms').strip()} SELECT * FROM report")
def verify_ms(t):
    return V.verify(t.ledger_d, t.corpus_d, t.objects_d, "ms")


@query(f"WITH {O.judged('lite', 'o.target = c.target AND o.name = c.name AND o.kind = c.kind').strip()} SELECT * FROM report")
def verify_lite(t):
    return V.verify(t.ledger_d, t.corpus_d, t.objects_d, "lite")


@query("""
    SELECT l.target, l.version, coalesce(s.filename, '') AS file,
           concat_ws('; ',
               CASE WHEN l.status = 'applied' AND s.version IS NULL THEN concat('version ', l.version, ' does not match any migration file in corpus') END,
               CASE WHEN l.status = 'applied' AND l.version % 3 <> 0 AND l.content_sha256 <> sha256(s.body)
                    THEN 'migration file was edited after it was applied (content hash mismatch)' END,
               CASE WHEN l.status = 'applied' AND s.version IS NOT NULL AND o.target IS NULL THEN concat('public.', n.n_name, ': claimed applied but missing')
                    WHEN l.status = 'reverted' AND o.target IS NOT NULL THEN concat('public.', n.n_name, ': claimed reverted but still exists') END) AS detail
    FROM ledger_d l LEFT JOIN directory_d s ON s.version = l.version LEFT JOIN nation n ON n.n_nationkey * 5 = l.version
    LEFT JOIN (SELECT DISTINCT target, concat('NATION_', cast(version % 25 AS varchar)) AS name FROM scripts_d) o
      ON o.target = l.target AND o.name = n.n_name""")
def verify_shared(t):
    # The hash of every third script is the one of the shared corpus, the others are as recorded.
    present = t.directory_d.select("version", F.sha2("body", 256).alias("_present"))
    sha256 = F.when(F.col("version") % 3 == 0, F.coalesce("_present", "content_sha256")).otherwise(F.col("content_sha256"))
    ledger = t.ledger_d.join(present, "version", "left").withColumn("content_sha256", sha256).drop("_present")
    objects = t.sql("""SELECT DISTINCT target, 'public' AS schema, concat('NATION_', cast(version % 25 AS string)) AS name,
                              'table' AS kind FROM scripts_d""")
    return V.verify(ledger, t.directory_d, objects, "pg").drop("status")


@query(f"""
    WITH {_PG}
    SELECT target, count(*) AS n_checked, count(*) FILTER (WHERE status = 'DRIFT') AS n_drift FROM report GROUP BY target""")
def drift_counts(t):
    return V.drift_counts(V.verify(t.ledger_d, t.corpus_d, t.objects_d, "pg"))


@query("""
    SELECT target, concat('ledger for ', target, ' is empty or not initialised') AS error
    FROM targets_d WHERE target NOT IN (SELECT target FROM ledger_d WHERE content_sha256 IS NULL)""")
def unverifiable(t):
    other = F.when(F.col("content_sha256").isNotNull(), F.concat(F.lit("former "), F.col("target"))).otherwise(F.col("target"))
    return V.unverifiable(t.targets_d, t.ledger_d.withColumn("target", other))


_SHOWN = """
    CASE WHEN error IS NULL THEN current_version END AS current_version, CASE WHEN error IS NULL THEN has_version END AS has_version,
    CASE WHEN error IS NULL THEN dirty END AS dirty, CASE WHEN error IS NULL THEN n_pending END AS n_pending,
    CASE WHEN error IS NULL THEN next_version END AS next_version, CASE WHEN error IS NULL THEN next_file END AS next_file"""


@query(f"""
    WITH {O.WAITING.strip()}, {O.STANDING.strip()}
    SELECT target, {_SHOWN},
           CASE WHEN error IS NOT NULL THEN concat('error: ', error)
                ELSE concat(CASE WHEN n_pending > 0 THEN concat(n_pending, ' pending') ELSE 'up to date' END,
                            CASE WHEN dirty THEN ' [DIRTY]' ELSE '' END) END AS state, error
    FROM standing""")
def status(t):
    return P.status(t.both_d, t.cursor_d, t.targets_d)


_PLANNED = f"""{_PG}, {O.WAITING.strip()}, {O.STANDING.strip()},
    planned AS (
        SELECT s.*, CASE WHEN has_version THEN coalesce(n, 0) ELSE 0 END AS n_drift FROM standing s
        LEFT JOIN (SELECT target, count(*) AS n FROM report WHERE status = 'DRIFT' GROUP BY 1) r ON r.target = s.target)"""
_EXIT = "CASE WHEN error IS NOT NULL THEN 1 WHEN n_pending > 0 OR n_drift > 0 OR dirty THEN 2 ELSE 0 END"


@query(f"""
    WITH {_PLANNED}
    SELECT target, {_SHOWN}, error, CASE WHEN error IS NULL THEN n_drift END AS n_drift, {_EXIT} AS exit FROM planned""")
def plan(t):
    return P.plan(t.ledger_d, t.both_d, t.objects_d, t.cursor_d, "pg", t.targets_d)


@query(f"""
    WITH {_PLANNED}
    SELECT w.target, 'pending' AS section, w.version, w.filename AS line FROM waiting w JOIN targets_d t ON t.target = w.target AND t.error IS NULL
    UNION ALL
    SELECT r.target, 'drift', r.version, concat('v', r.version, ': ', r.detail) FROM report r JOIN standing s ON s.target = r.target
    WHERE r.status = 'DRIFT' AND s.error IS NULL AND s.has_version""")
def plan_lines(t):
    return P.plan_lines(t.ledger_d, t.both_d, t.objects_d, t.cursor_d, "pg", t.targets_d)


@query(f"""
    WITH {_PLANNED}
    SELECT CASE WHEN count(*) FILTER (WHERE {_EXIT} = 1) > 0 THEN 1 WHEN count(*) FILTER (WHERE {_EXIT} = 2) > 0 THEN 2 ELSE 0 END AS exit FROM planned""")
def fleet_exit(t):
    return P.fleet_exit(P.plan(t.ledger_d, t.both_d, t.objects_d, t.cursor_d, "pg", t.targets_d))


_DOCTOR = f"""
    WITH {_PLANNED},
    mismatched AS (
        SELECT l.target, count(*) AS n FROM ledger_d l LEFT JOIN corpus_d s ON s.target = l.target AND s.version = l.version
        WHERE l.status = 'applied' AND l.content_sha256 IS NOT NULL AND l.content_sha256 IS DISTINCT FROM sha256(s.body) GROUP BY 1),
    base AS (
        SELECT t.*, s.current_version, s.has_version, s.dirty, s.n_pending, coalesce(m.n, 0) AS n_mismatch,
               coalesce(r.n_checked, 0) AS n_checked, coalesce(r.n_drift, 0) AS n_drift
        FROM targets_d t JOIN standing s ON s.target = t.target LEFT JOIN mismatched m ON m.target = t.target
        LEFT JOIN (SELECT target, count(*) AS n_checked, count(*) FILTER (WHERE status = 'DRIFT') AS n_drift FROM report GROUP BY 1) r
          ON r.target = t.target),
    checks AS (
        SELECT target, 0 AS rank, 'connectivity' AS "check", CASE WHEN error IS NULL THEN 'ok' ELSE 'fail' END AS status,
               CASE WHEN error IS NULL THEN concat('connected to database (', engine, ')') ELSE error END AS message FROM base
        UNION ALL
        SELECT target, 1, 'ledger-integrity', CASE WHEN n_checked = 0 THEN 'warn' WHEN n_mismatch > 0 THEN 'fail' ELSE 'ok' END,
               CASE WHEN n_checked = 0 THEN 'ledger table uninitialized or empty'
                    WHEN n_mismatch > 0 THEN concat('content hash mismatch in ', n_mismatch, ' migration(s)')
                    ELSE concat(n_checked, ' ledger entries verified (hashes match)') END FROM base WHERE error IS NULL
        UNION ALL
        SELECT target, 2, 'version-sync', CASE WHEN n_pending > 0 THEN 'fail' ELSE 'ok' END,
               CASE WHEN n_pending > 0 THEN concat(n_pending, ' pending migration(s) (current version ', current_version, ')')
                    WHEN has_version THEN concat('up to date (version ', current_version, ')')
                    ELSE 'no migrations applied (clean database)' END FROM base WHERE error IS NULL
        UNION ALL
        SELECT target, 3, 'drift-summary', CASE WHEN n_checked = 0 THEN 'warn' WHEN n_drift > 0 THEN 'fail' ELSE 'ok' END,
               CASE WHEN n_checked = 0 THEN 'skipped (ledger empty or not initialized)'
                    WHEN n_drift > 0 THEN concat('drift detected in ', n_drift, ' migration(s)') ELSE 'no schema drift detected' END
        FROM base WHERE error IS NULL
        UNION ALL
        SELECT target, 4, 'dirty-ledger', CASE WHEN dirty THEN 'fail' ELSE 'ok' END,
               CASE WHEN dirty THEN concat('ledger is marked DIRTY at version ', current_version, ' (previous apply failed)')
                    ELSE 'ledger clean (dirty=false)' END FROM base WHERE error IS NULL
        UNION ALL
        SELECT target, 5, 'security-flags', CASE WHEN url_env IS NULL THEN 'warn' ELSE 'ok' END,
               concat(CASE WHEN url_env IS NULL THEN 'url_env not configured' ELSE concat('url_env=', url_env) END,
                      ', protected=', cast(protected AS varchar)) FROM base),
    codes AS (
        SELECT b.target, b.engine, CASE WHEN b.error IS NOT NULL THEN 1 WHEN bool_or(c.status = 'fail') THEN 2 ELSE 0 END AS exit
        FROM base b JOIN checks c ON c.target = b.target GROUP BY b.target, b.engine, b.error)"""


@query(f"""
    {_DOCTOR}
    SELECT c.target, d.engine, d.exit = 0 AS healthy, d.exit,
           cast(row_number() OVER (PARTITION BY c.target ORDER BY c.rank) - 1 AS int) AS pos, c."check", c.status, c.message
    FROM checks c JOIN codes d ON d.target = c.target""")
def doctor(t):
    return D.doctor(t.targets_d, t.ledger_d, t.both_d, t.objects_d, t.cursor_d, "pg")


@query(f"{_DOCTOR} SELECT exit, count(*) AS n_targets FROM codes GROUP BY exit")
def doctor_exits(t):
    report = D.doctor(t.targets_d, t.ledger_d, t.both_d, t.objects_d, t.cursor_d, "pg")
    return D.doctor_exits(report).groupBy("exit").agg(F.count(F.lit(1)).alias("n_targets"))


_INITIALISED = _DOCTOR.replace("'ledger-integrity', CASE WHEN n_checked = 0", "'ledger-integrity', CASE WHEN n_checked = 0 AND cast(target AS bigint) % 3 <> 0", 1).replace(
    "CASE WHEN n_checked = 0 THEN 'ledger table", "CASE WHEN n_checked = 0 AND cast(target AS bigint) % 3 <> 0 THEN 'ledger table", 1
)


@query(f"""
    {_INITIALISED}
    SELECT c.target, d.exit, c."check", c.status, c.message FROM checks c JOIN codes d ON d.target = c.target""")
def doctor_empty_ledgers(t):
    """Some targets are known to have a ledger, which may be empty."""
    targets = t.targets_d.withColumn("has_ledger", F.when(F.col("target").cast("bigint") % 3 == 0, F.lit(True)))
    return D.doctor(targets, t.ledger_d, t.both_d, t.objects_d, t.cursor_d, "pg").select("target", "exit", "check", "status", "message")
