from conftest import NOW, rows
from pyspark.sql import functions as F

from driftledger import messages as M
from driftledger.plans import doctor as D
from driftledger.plans import lint as N
from driftledger.plans import repair as R
from driftledger.plans import status as P


def fleet(make):
    """ok is clean, late has pending scripts, bad has drift, half is dirty, new has no version, off cannot be reached."""
    names = ["ok", "late", "bad", "half", "new", "off"]
    scripts = [make.script(t, v, f"create table t{v} (i int);") for t in names if t != "new" for v in (1, 2)]
    return {
        "targets": make.targets(
            [(t, "postgres", f"URL_{t.upper()}", t == "ok", "ping failed: refused" if t == "off" else None) for t in names if t != "new"]
            + [("new", "postgres", None, False, None)]
        ),
        "corpus": make.corpus(scripts),
        "cursor": make.cursor([("ok", 2, False), ("late", 1, False), ("bad", 2, False), ("half", 2, True), ("off", 2, False)]),
        "ledger": make.ledger([(t, v, "applied") for t in ("ok", "bad", "half", "off") for v in (1, 2)] + [("late", 1, "applied")]),
        "objects": make.objects(
            [(t, "public", f"t{v}", "table") for t in ("ok", "half", "late") for v in (1, 2)] + [("bad", "public", "t2", "table")]
        ),
    }


def test_status(make):
    f = fleet(make)
    found = rows(P.status(f["corpus"], f["cursor"], f["targets"]), "target", "current_version", "has_version", "n_pending", "next_version", "state")
    assert found == [
        ("bad", 2, True, 0, None, "up to date"),
        ("half", 2, True, 0, None, "up to date [DIRTY]"),
        ("late", 1, True, 1, 2, "1 pending"),
        ("new", 0, False, 0, None, "up to date"),
        ("off", None, None, None, None, "error: ping failed: refused"),
        ("ok", 2, True, 0, None, "up to date"),
    ]
    assert rows(P.status(f["corpus"], f["cursor"], f["targets"], ["late"]), "target") == [("late",)]
    assert rows(P.status(f["corpus"], f["cursor"]).filter("target = 'late'"), "n_pending") == [(1,)]


def test_plan_lines_and_exit(make):
    f = fleet(make)
    args = (f["ledger"], f["corpus"], f["objects"], f["cursor"], "pg", f["targets"])
    found = P.plan(*args)
    assert rows(found, "target", "n_pending", "n_drift", "exit") == [
        ("bad", 0, 1, 2), ("half", 0, 0, 2), ("late", 1, 0, 2), ("new", 0, 0, 0), ("off", None, None, 1), ("ok", 0, 0, 0),
    ]
    assert rows(P.plan_lines(*args)) == [
        ("bad", "drift", 1, "v1: public.t1: claimed applied but missing"),
        ("late", "pending", 2, "00000000000002_step.up.sql"),
    ]
    assert rows(P.fleet_exit(found)) == [(1,)]
    assert rows(P.fleet_exit(found.filter("exit <> 1"))) == [(2,)]
    assert rows(P.fleet_exit(found.filter("exit = 0"))) == [(0,)]
    assert rows(P.fleet_exit(found.limit(0))) == [(0,)]


def test_doctor(make):
    f = fleet(make)
    args = (f["targets"], f["ledger"], f["corpus"], f["objects"], f["cursor"], "pg")
    report = D.doctor(*args)
    by_target = {}
    for r in report.orderBy("target", "pos").collect():
        by_target.setdefault(r["target"], []).append((r["check"], r["status"], r["message"]))
    assert by_target["ok"] == [
        ("connectivity", "ok", "connected to database (postgres)"),
        ("ledger-integrity", "ok", "2 ledger entries verified (hashes match)"),
        ("version-sync", "ok", "up to date (version 2)"),
        ("drift-summary", "ok", "no schema drift detected"),
        ("dirty-ledger", "ok", "ledger clean (dirty=false)"),
        ("security-flags", "ok", "url_env=URL_OK, protected=true"),
    ]
    assert [c[:2] for c in by_target["off"]] == [("connectivity", "fail"), ("security-flags", "ok")]
    assert by_target["new"][1:4] == [
        ("ledger-integrity", "warn", "ledger table uninitialized or empty"),
        ("version-sync", "ok", "no migrations applied (clean database)"),
        ("drift-summary", "warn", "skipped (ledger empty or not initialized)"),
    ]
    assert by_target["new"][5] == ("security-flags", "warn", "url_env not configured, protected=false")
    assert by_target["late"][2] == ("version-sync", "fail", "1 pending migration(s) (current version 1)")
    assert by_target["bad"][3] == ("drift-summary", "fail", "drift detected in 1 migration(s)")
    assert by_target["half"][4] == ("dirty-ledger", "fail", "ledger is marked DIRTY at version 2 (previous apply failed)")
    exits = dict(rows(D.doctor_exits(report)))
    assert exits == {"ok": 0, "late": 2, "bad": 2, "half": 2, "new": 0, "off": 1}
    asked = D.doctor(*args, names=["ok", "nowhere"], missing_folder="db")
    assert rows(D.doctor_exits(asked)) == [("nowhere", 1), ("ok", 0)]
    folder = asked.filter("check = 'security-flags'").select("status", "message")
    assert rows(folder) == [("warn", 'url_env=URL_OK, protected=true, migrations_dir "db" missing')]


def test_lint(spark):
    files = spark.createDataFrame(
        [
            ("1_a.up.sql", "x"), ("01_b.up.sql", "x"), ("1_c.down.sql", "x"), ("2_blank.up.sql", " \n\t "),
            ("no_version.sql", "x"), ("3_sp ace.up.sql", "x"), ("18446744073709551616_big.up.sql", "x"),
            (".hidden", ""), ("ReadMe.md", ""),
        ],
        "filename string, body string",
    )
    names = "1_a.up.sql" , "01_b.up.sql"
    message = "version 1 is duplicated across multiple files: 01_b.up.sql, 1_a.up.sql"
    assert rows(N.lint(files), "file", "rule", "message") == sorted(
        [(n, M.RULE_DUPLICATE, message) for n in names]
        + [
            ("2_blank.up.sql", M.RULE_EMPTY, M.LINT_EMPTY),
            ("no_version.sql", M.RULE_FILENAME, M.LINT_FILENAME),
            ("3_sp ace.up.sql", M.RULE_FILENAME, M.LINT_FILENAME),
            ("18446744073709551616_big.up.sql", M.RULE_VERSION, M.LINT_VERSION % (("18446744073709551616",) * 2)),
        ],
        key=repr,
    )
    assert N.lintable(files).count() == 7


def test_lint_names_all_files(spark):
    files = spark.range(45).select(F.format_string("7_f%03d.up.sql", "id").alias("filename"), F.lit("x").alias("body"))
    found = N.lint(files).collect()
    assert len(found) == 45 and {r["rule"] for r in found} == {M.RULE_DUPLICATE}
    assert all(r["message"].endswith(", ".join(f"7_f{i:03d}.up.sql" for i in range(45))) for r in found)


def test_instructions(spark):
    texts = ["1:applied", "1:applied,2:reverted", "1:done", "x:applied", "1", "1:applied,01:reverted", "", "1:applied:", "9223372036854775808:applied"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "target string, instructions string")
    parsed = R.parse_instructions(df)
    errors = {r["target"]: r["error"] for r in parsed.filter("error IS NOT NULL").collect()}
    assert errors == {
        "2": 'invalid status "done" in pair "1:done" (want applied or reverted)',
        "3": 'invalid version "x" in pair "x:applied"',
        "4": 'invalid version:status pair "1" (want VERSION:applied or VERSION:reverted)',
        "5": "duplicate version 1 in repair args",
        "6": 'invalid version:status pair "" (want VERSION:applied or VERSION:reverted)',
        "7": 'invalid status "applied:" in pair "1:applied:" (want applied or reverted)',
        "8": 'version "9223372036854775808" is out of range',
    }
    assert rows(R.accepted_instructions(parsed)) == [("0", 1, "applied"), ("1", 1, "applied"), ("1", 2, "reverted")]


def test_repair_is_all_or_nothing_per_target(make):
    corpus = make.corpus([make.script(t, v, f"create table t{v} (i int);") for t in "abcd" for v in (1, 2)])
    objects = make.objects([(t, "public", "t1", "table") for t in "abcd"] + [("a", "public", "t2", "table")])
    ledger = make.ledger([(t, 1, "reverted") for t in "abcd"])
    cursor = make.cursor([("a", None, False), ("b", None, False), ("c", 1, True), ("d", 1, False)])
    wanted = make.instructions([("a", 1, "applied"), ("a", 2, "applied"), ("b", 1, "applied"), ("b", 2, "applied"), ("c", 1, "applied"), ("d", 9, "reverted")])
    done = R.repair(ledger, corpus, objects, cursor, wanted, "pg", NOW)
    assert rows(done.ledger, "target", "version", "status") == [
        ("a", 1, "applied"), ("a", 2, "applied"), ("b", 1, "reverted"), ("c", 1, "reverted"), ("d", 1, "reverted"), ("d", 9, "reverted"),
    ]
    assert rows(done.violations) == [
        ("b", 2, "version 2 (00000000000002_step.up.sql): public.t2 does not exist"),
        ("c", 1, "migration cursor is dirty at version 1; repair the target to resolve it"),
    ]
    # d has nothing applied left, so its cursor stays.
    assert rows(done.cursor) == [("a", 2, False), ("b", None, False), ("c", 1, True), ("d", 1, False)]
    forced = R.repair(ledger, corpus, objects, cursor, wanted, "pg", NOW, force=True)
    assert rows(forced.violations, "target") == [("c",)]
    assert rows(forced.cursor, "target", "version")[:2] == [("a", 2), ("b", 2)]
    unknown = make.instructions([("a", 5, "applied")])
    no_script = R.repair(ledger, corpus, objects, cursor, unknown, "pg", NOW, force=True).violations
    assert rows(no_script, "error") == [("version 5 does not match any migration file in corpus",)]
