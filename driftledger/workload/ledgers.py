"""Queries that read or rewrite the ledger."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from driftledger.operators import ledger as L
from driftledger.plans import flows
from driftledger.plans import repair as R
from driftledger.plans.status import plan, status, with_refused
from driftledger.sources import ledger as sources
from driftledger.sources import store as storage
from driftledger.sources.shared import work_folder
from driftledger.workload import oracle_sql as O
from driftledger.workload.registry import NOW, NOW_TEXT, query


def _text(ledger: DataFrame) -> DataFrame:
    return ledger.withColumn("recorded_at", F.col("recorded_at").cast("string"))


@query("SELECT target, version FROM ledger_d WHERE status = 'applied'")
def applied_versions(t):
    return L.applied_versions(t.ledger_d)


@query("""
    SELECT target, coalesce(n.version, c.version) AS version, CASE WHEN n.version IS NULL THEN coalesce(c.dirty, false) ELSE false END AS dirty
    FROM cursor_d c FULL JOIN (
        SELECT target, max(CASE WHEN status = 'applied' AND version % 3 <> 0 THEN version END) AS version FROM ledger_d GROUP BY 1) n USING (target)""")
def recompute_cursor(t):
    reverted = F.when(F.col("version") % 3 == 0, "reverted").otherwise(F.col("status"))
    return L.recompute_cursor(t.ledger_d.withColumn("status", reverted), t.cursor_d)


@query(f"SELECT {O.LEDGER_TEXT} FROM ({O.upserted('ledger_d', 'changes_d')})")
def ledger_upsert(t):
    return _text(L.upsert(t.ledger_d, t.changes_d))


@query(f"SELECT {O.LEDGER_TEXT} FROM ({O.upserted('ledger_d', 'changes_d', keep_first=False)})")
def ledger_upsert_latest_hash(t):
    return _text(L.upsert(t.ledger_d, t.changes_d, hash_policy="latest"))


@query("""
    WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY target, version ORDER BY recorded_at, event_id) AS first_rank,
                           row_number() OVER (PARTITION BY target, version ORDER BY recorded_at DESC, event_id DESC) AS last_rank FROM log_d)
    SELECT l.target, l.version, l.status, cast(l.recorded_at AS varchar) AS recorded_at, l.note, f.content_sha256
    FROM ranked l JOIN ranked f ON f.target = l.target AND f.version = l.version AND f.first_rank = 1 WHERE l.last_rank = 1""")
def ledger_fold(t):
    return _text(L.fold(t.log_d, ["recorded_at", "event_id"]))


@query(f"WITH {O.SYNCED.strip()} SELECT {O.LEDGER_TEXT} FROM synced")
def backfill(t):
    cursor = t.cursor_d.withColumn("dirty", F.col("dirty") & F.col("version").isNotNull())
    return _text(L.backfill(t.ledger_d, t.corpus_d, cursor))


@query("""
    SELECT p.target, s.version FROM directory_d s, places_d p
    WHERE s.version <= p.version AND NOT p.dirty
      AND NOT EXISTS (SELECT 1 FROM ledger_d l WHERE l.target = p.target AND l.version = s.version)""")
def backfilled_shared(t):
    return L.backfilled(t.ledger_d, t.directory_d, t.places_d).select("target", "version")


@query("""
    SELECT a.target, a.version, d.filename,
           CASE WHEN d.filename IS NULL THEN concat('version ', a.version, ' does not have a matching .down.sql migration file in corpus') END AS error
    FROM (SELECT target, version, row_number() OVER (PARTITION BY target ORDER BY version DESC) AS step
          FROM ledger_d WHERE status = 'applied') a
    LEFT JOIN down_d d ON d.target = a.target AND d.version = a.version WHERE step <= 3""")
def down_plan(t):
    return L.down_plan(t.ledger_d, t.both_d, 3)


@query("""
    SELECT a.target, a.version, d.filename,
           CASE WHEN d.filename IS NULL THEN concat('version ', a.version, ' does not have a matching .down.sql migration file in corpus') END AS error
    FROM ledger_d a LEFT JOIN down_d d ON d.target = a.target AND d.version = a.version WHERE a.status = 'applied'""")
def down_plan_all(t):
    return L.down_plan(t.ledger_d, t.both_d, 0)


@query(f"""
    WITH applied AS (SELECT target, version, row_number() OVER (PARTITION BY target ORDER BY version DESC) AS step,
                            count(*) OVER (PARTITION BY target) AS n FROM ledger_d WHERE status = 'applied'),
    changes AS (SELECT target, version, 'reverted' AS status, cast({NOW_TEXT} AS timestamp) AS recorded_at,
                       'soft-reverted via rollback' AS note, NULL AS content_sha256
                FROM applied WHERE step <= CASE WHEN n < 3 THEN 1 ELSE 3 END)
    SELECT {O.LEDGER_TEXT} FROM ({O.upserted('ledger_d', 'changes')})""")
def soft_revert(t):
    return _text(L.soft_revert(t.ledger_d, NOW, 3))


@query(f"""
    WITH {O.WAITING.strip()},
    changes AS (SELECT w.target, w.version, 'applied' AS status, cast({NOW_TEXT} AS timestamp) AS recorded_at, 'applied via up/push' AS note,
                       sha256(w.body) AS content_sha256
                FROM waiting w JOIN cursor_d c USING (target) WHERE c.version IS NULL OR NOT c.dirty)
    SELECT {O.LEDGER_TEXT} FROM ({O.upserted('ledger_d', 'changes')})""")
def record_applied(t):
    return _text(L.record_applied(t.ledger_d, t.both_d, t.cursor_d, NOW))


@query(f"""
    WITH plan AS (SELECT a.target, a.version, d.body FROM (
                      SELECT target, version, row_number() OVER (PARTITION BY target ORDER BY version DESC) AS step
                      FROM ledger_d WHERE status = 'applied') a
                  LEFT JOIN down_d d ON d.target = a.target AND d.version = a.version WHERE step <= 2),
    changes AS (SELECT target, version, 'reverted' AS status, cast({NOW_TEXT} AS timestamp) AS recorded_at, 'reverted via down' AS note,
                       sha256(body) AS content_sha256 FROM plan
                WHERE target NOT IN (SELECT target FROM plan WHERE body IS NULL)
                  AND target NOT IN (SELECT target FROM cursor_d WHERE dirty AND version IS NOT NULL))
    SELECT {O.LEDGER_TEXT} FROM ({O.upserted('ledger_d', 'changes')})""")
def record_reverted(t):
    return _text(L.record_reverted(t.ledger_d, t.both_d, t.cursor_d, NOW, 2))


@query(f"""
    WITH {O.WAITING.strip()},
    steps AS (SELECT w.target, max(w.version) AS version FROM waiting w JOIN cursor_d c USING (target)
              WHERE c.version IS NULL OR NOT c.dirty GROUP BY 1)
    SELECT c.target, coalesce(s.version, c.version) AS version, c.dirty AND s.version IS NULL AS dirty
    FROM cursor_d c LEFT JOIN steps s USING (target)""")
def apply_cursor(t):
    return flows.apply_pending(t.ledger_d, t.both_d, t.cursor_d, NOW).cursor


@query(f"""
    WITH {O.SYNCED.strip()},
    {O.WAITING.strip()},
    changes AS (SELECT w.target, w.version, 'applied' AS status, cast({NOW_TEXT} AS timestamp) AS recorded_at, 'applied via up/push' AS note,
                       sha256(w.body) AS content_sha256
                FROM waiting w JOIN cursor_d c USING (target) WHERE c.version IS NULL OR NOT c.dirty)
    SELECT {O.LEDGER_TEXT} FROM ({O.upserted('synced', 'changes')})""")
def apply_ledger(t):
    return _text(flows.apply_pending(t.ledger_d, t.both_d, t.cursor_d, NOW).ledger)


@query(f"""
    WITH {O.SYNCED.strip()},
    applied AS (SELECT target, version, row_number() OVER (PARTITION BY target ORDER BY version DESC) AS step FROM synced WHERE status = 'applied'),
    after AS (SELECT target, max(version) AS version FROM applied WHERE step > 1 GROUP BY 1)
    SELECT c.target, CASE WHEN c.dirty AND c.version IS NOT NULL THEN c.version ELSE coalesce(a.version, c.version) END AS version,
           c.dirty AND (c.version IS NOT NULL OR a.version IS NULL) AS dirty
    FROM cursor_d c LEFT JOIN after a USING (target)""")
def rollback_cursor(t):
    return flows.rollback(t.ledger_d, t.both_d, t.cursor_d, NOW).cursor


@query(f"""
    WITH {O.SYNCED.strip()},
    applied AS (SELECT target, version, row_number() OVER (PARTITION BY target ORDER BY version DESC) AS step FROM synced WHERE status = 'applied'
                AND target NOT IN (SELECT target FROM cursor_d WHERE dirty AND version IS NOT NULL)),
    changes AS (SELECT target, version, 'reverted' AS status, cast({NOW_TEXT} AS timestamp) AS recorded_at,
                       'soft-reverted via rollback' AS note, NULL AS content_sha256 FROM applied WHERE step = 1)
    SELECT {O.LEDGER_TEXT} FROM ({O.upserted('synced', 'changes')})""")
def rollback(t):
    return _text(flows.rollback(t.ledger_d, t.both_d, t.cursor_d, NOW).ledger)


@query(f"""
    WITH {O.SYNCED.strip()},
    plan AS (SELECT a.target, a.version, d.body FROM (
                 SELECT target, version, row_number() OVER (PARTITION BY target ORDER BY version DESC) AS step
                 FROM synced WHERE status = 'applied') a
             LEFT JOIN down_d d ON d.target = a.target AND d.version = a.version WHERE step = 1),
    done AS (SELECT target, version FROM plan WHERE body IS NOT NULL
             AND target NOT IN (SELECT target FROM cursor_d WHERE dirty AND version IS NOT NULL)),
    after AS (SELECT target, max(version) AS version FROM synced s WHERE status = 'applied'
              AND NOT EXISTS (SELECT 1 FROM done d WHERE d.target = s.target AND d.version = s.version) GROUP BY 1)
    SELECT c.target, CASE WHEN d.target IS NULL THEN c.version ELSE a.version END AS version, c.dirty
    FROM cursor_d c LEFT JOIN done d USING (target) LEFT JOIN after a USING (target)""")
def run_down_cursor(t):
    return flows.run_down(t.ledger_d, t.both_d, t.cursor_d, NOW).cursor


_INSTRUCTED = f"""
    {O.SYNCED.strip().replace("WHERE NOT c.dirty", "WHERE target IN (SELECT target FROM wanted_d) AND NOT c.dirty")},
    creates AS ({O.objects(O.CREATE, "pg")}),
    bad AS (
        SELECT w.target, w.version, concat('version ', w.version, ' does not match any migration file in corpus') AS error
        FROM wanted_d w WHERE w.status = 'applied' AND NOT EXISTS (SELECT 1 FROM corpus_d s WHERE s.target = w.target AND s.version = w.version)
        UNION ALL
        SELECT w.target, w.version, concat('version ', w.version, ' (', c.filename, '): ', c.schema, '.', c.name, ' does not exist')
        FROM wanted_d w JOIN creates c ON c.target = w.target AND c.version = w.version
        WHERE w.status = 'applied' AND NOT EXISTS (
            SELECT 1 FROM objects_d o WHERE o.target = c.target AND o.schema = c.schema AND o.name = c.name AND o.kind = c.kind)
        UNION ALL
        SELECT target, version, concat('migration cursor is dirty at version ', version, '; repair the target to resolve it')
        FROM cursor_d WHERE dirty AND version IS NOT NULL AND target IN (SELECT target FROM wanted_d)),
    changes AS (SELECT target, version, status, cast({NOW_TEXT} AS timestamp) AS recorded_at, 'repaired' AS note, NULL AS content_sha256
                FROM wanted_d WHERE target NOT IN (SELECT target FROM bad)),
    after AS ({O.upserted('synced', 'changes')})"""


@query(f"WITH {_INSTRUCTED.strip()} SELECT target, version, error FROM bad")
def repair_violations(t):
    return R.repair(t.ledger_d, t.corpus_d, t.objects_d, t.cursor_d, t.wanted_d, "pg", NOW).violations


@query(f"WITH {_INSTRUCTED.strip()} SELECT {O.LEDGER_TEXT} FROM after")
def repair(t):
    return _text(R.repair(t.ledger_d, t.corpus_d, t.objects_d, t.cursor_d, t.wanted_d, "pg", NOW).ledger)


@query(f"""
    WITH {_INSTRUCTED.strip()},
    tops AS (SELECT target, max(version) AS version FROM after WHERE status = 'applied' GROUP BY 1)
    SELECT c.target, CASE WHEN ok THEN coalesce(x.version, c.version) ELSE c.version END AS version,
           CASE WHEN ok AND x.version IS NOT NULL THEN false ELSE c.dirty END AS dirty
    FROM (SELECT *, target IN (SELECT target FROM changes) AS ok FROM cursor_d) c LEFT JOIN tops x ON x.target = c.target""")
def repair_cursor(t):
    return R.repair(t.ledger_d, t.corpus_d, t.objects_d, t.cursor_d, t.wanted_d, "pg", NOW).cursor


@query("""
    WITH parts AS (SELECT target, unnest(range(len(p))) AS pos, unnest(p) AS part FROM (SELECT target, string_split(instructions, ',') AS p FROM instructions_d)),
    halves AS (SELECT *, strpos(part, ':') AS colon, CASE WHEN strpos(part, ':') > 0 THEN substr(part, 1, strpos(part, ':') - 1) ELSE part END AS number,
                      CASE WHEN strpos(part, ':') > 0 THEN substr(part, strpos(part, ':') + 1) END AS status FROM parts),
    numbered AS (SELECT *, CASE WHEN regexp_full_match(number, '[0-9]+') AND try_cast(number AS hugeint) <= 18446744073709551615
                                THEN try_cast(number AS hugeint) END AS n FROM halves)
    SELECT target, cast(pos AS int) AS pos, part, try_cast(n AS bigint) AS version, status,
           CASE WHEN colon = 0 THEN concat('invalid version:status pair "', part, '" (want VERSION:applied or VERSION:reverted)')
                WHEN n IS NULL THEN concat('invalid version "', number, '" in pair "', part, '"')
                WHEN status NOT IN ('applied', 'reverted') THEN concat('invalid status "', status, '" in pair "', part, '" (want applied or reverted)')
                WHEN EXISTS (SELECT 1 FROM numbered e WHERE e.target = numbered.target AND e.pos < numbered.pos AND e.n = numbered.n)
                THEN concat('duplicate version ', n, ' in repair args') END AS error
    FROM numbered""")
def parse_instructions(t):
    return R.parse_instructions(t.instructions_d)


@query("""
    SELECT cast(c_custkey AS varchar) AS target, c_custkey + i AS version, CASE WHEN i = 1 OR c_custkey % 7 = 1 THEN 'reverted' ELSE 'applied' END AS status
    FROM customer, range(2) r(i) WHERE c_custkey % 7 = 0 OR (c_custkey % 7 = 1 AND i = 0)""")
def accepted_instructions(t):
    return R.accepted_instructions(R.parse_instructions(t.instructions_d))


@query("""
    SELECT l.target, l.version, s.filename, l.content_sha256 AS recorded_sha256, sha256(s.body) AS present_sha256
    FROM doc_ledger_d l JOIN doc_corpus_d s ON s.target = l.target AND s.version = l.version
    WHERE l.status = 'applied' AND l.content_sha256 <> '' AND l.content_sha256 <> sha256(s.body)""")
def hash_drift(t):
    return L.hash_drift(sources.as_ledger(t.doc_ledger_d), t.doc_corpus_d)


@query("""
    SELECT l.target, l.version, s.filename, l.content_sha256 AS recorded_sha256, sha256(s.body) AS present_sha256
    FROM page_ledger_d l LEFT JOIN page_corpus_d s ON s.target = l.target AND s.version = l.version
    WHERE l.content_sha256 IS NOT NULL AND l.content_sha256 IS DISTINCT FROM sha256(s.body)""")
def page_hash_drift(t):
    return L.hash_drift(sources.as_ledger(t.page_ledger_d), t.page_corpus_d, missing_is_mismatch=True)


@query("""
    SELECT l.target, l.version, l.status, s.filename,
           CASE WHEN s.version IS NULL AND l.status = 'applied' THEN concat('version ', l.version, ' does not match any migration file in corpus') END AS error
    FROM ledger_d l LEFT JOIN corpus_d s ON s.target = l.target AND s.version = l.version""")
def ledger_with_scripts(t):
    return L.ledger_with_scripts(t.ledger_d, t.corpus_d).select("target", "version", "status", "filename", "error")


@query("""
    SELECT target, version, status,
           CASE WHEN version IS NULL THEN 'ledger row without a version'
                WHEN version < 0 THEN concat('ledger contains negative version ', version, '; the table was modified outside')
                WHEN status = 'open' THEN 'unknown status open' END AS error
    FROM raw_ledger_d""")
def split_ledger(t):
    good, rejected = sources.split_ledger(t.raw_ledger_d)
    columns = ["target", "version", "status", "error"]
    return good.withColumn("error", F.lit(None).cast("string")).select(columns).unionByName(rejected.select(columns))


@query("""
    SELECT cast(v AS varchar) AS version, CASE WHEN v > 9223372036854775807 THEN concat('migration version ', v, ' exceeds the ledger''s range') END AS error
    FROM (SELECT cast(o_orderkey AS hugeint) * CASE WHEN o_orderkey % 2 = 0 THEN 1000000000000000 ELSE 1 END AS v FROM orders)""")
def check_version_range(t):
    wide = "cast(o_orderkey AS decimal(20,0)) * CASE WHEN o_orderkey % 2 = 0 THEN 1000000000000000 ELSE 1 END"
    checked = sources.check_version_range(t.sql(f"SELECT {wide} AS version FROM @orders"))
    return checked.select(F.col("version").cast("decimal(38,0)").cast("string").alias("version"), "error")


def _store(t) -> storage.LedgerStore:
    return storage.LedgerStore(t.session, f"{work_folder(t.session)}/ledger-{uuid.uuid4().hex}", buckets=16)


@query(f"SELECT {O.LEDGER_TEXT} FROM ledger_d")
def ledger_round_trip(t):
    """Published as a whole and read back."""
    path = f"{work_folder(t.session)}/ledger-{uuid.uuid4().hex}"
    storage.write_ledger(t.ledger_d, path)
    return _text(storage.read_ledger(t.session, path))


@query(f"SELECT {O.LEDGER_TEXT} FROM ({O.upserted('ledger_d', 'changes_d')})")
def ledger_two_commits(t):
    """Inserted in one commit, changed in a second, read back."""
    store = _store(t)
    store.insert(t.ledger_d)
    store.upsert(t.changes_d)
    return _text(store.ledger())


@query(f"""
    WITH after AS ({O.upserted('ledger_d', 'changes_d')}),
    tops AS (SELECT target, max(CASE WHEN status = 'applied' THEN version END) AS version FROM after GROUP BY 1),
    before AS (SELECT target, max(CASE WHEN status = 'applied' THEN version END) AS version FROM ledger_d GROUP BY 1)
    SELECT target, coalesce(t.version, b.version) AS version, false AS dirty FROM tops t LEFT JOIN before b USING (target)
    WHERE coalesce(t.version, b.version) IS NOT NULL""")
def ledger_commit_cursor(t):
    """The cursor that the second of two commits publishes."""
    store = _store(t)
    store.insert(t.ledger_d)
    store.upsert(t.changes_d)
    return store.cursor()


_OUTSIDE = """
    keyed AS (
        SELECT target, version, count(*) AS n,
               max(CASE WHEN version IS NULL THEN 'ledger row without a version'
                        WHEN version < 0 THEN concat('ledger contains negative version ', version, '; the table was modified outside')
                        WHEN status = 'open' THEN 'unknown status open' END) AS problem
        FROM outside_d GROUP BY 1, 2),
    refused AS (
        SELECT target, version, coalesce(problem, concat('version ', version, ' is changed more than once')) AS error FROM keyed
        WHERE problem IS NOT NULL OR n > 1),
    accepted AS (SELECT * FROM outside_d WHERE target NOT IN (SELECT target FROM refused))"""


@query(f"WITH {_OUTSIDE.strip()} SELECT target, version, error FROM refused")
def refused_changes(t):
    return L.split_changes(t.outside_d)[1]


@query(f"WITH {_OUTSIDE.strip()} SELECT {O.LEDGER_TEXT} FROM ({O.upserted('ledger_d', 'accepted')})")
def accepted_changes(t):
    """Changes from outside in the store: refused targets keep their ledger, the others are written."""
    store = _store(t)
    store.insert(t.ledger_d)
    store.upsert(t.outside_d)
    return _text(store.ledger())


@query(f"""
    WITH {_OUTSIDE.strip()},
    reasons AS (SELECT target, min(error) AS error FROM refused GROUP BY 1),
    failing AS (SELECT t.target, coalesce(t.error, r.error) AS error FROM targets_d t LEFT JOIN reasons r USING (target))
    SELECT target, concat('error: ', error) AS state, 1 AS exit FROM failing WHERE error IS NOT NULL""")
def refused_in_plan(t):
    """Targets with refused changes as the status and the plan show them."""
    targets = with_refused(t.targets_d, L.split_changes(t.outside_d)[1])
    shown = status(t.corpus_d, t.cursor_d, targets).select("target", "state")
    failing = plan(t.ledger_d, t.corpus_d, t.objects_d, t.cursor_d, "pg", targets).filter("error IS NOT NULL").select("target", "exit")
    return shown.join(failing, "target")
