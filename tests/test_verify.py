import hashlib
import random

import pytest
from conftest import rows

from driftledger import messages as M
from driftledger.operators import objects as J
from driftledger.plans import verify as V

TABLE_T = ("a", "public", "t", "table")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def report(make, ledger, scripts, objects=(), dialect="pg"):
    found = V.verify(make.ledger(ledger), make.corpus(scripts), make.objects(objects), dialect)
    return {r["version"]: (r["status"], r["detail"]) for r in found.collect()}


def test_edited_script(make):
    script = make.script("a", 1, "create table t (id int);")
    applied = lambda h: [("a", 1, "applied", None, "", h)]
    assert report(make, applied(sha(script[4])), [script], [TABLE_T]) == {1: ("OK", "")}
    assert report(make, applied(sha("before")), [script], [TABLE_T]) == {1: ("DRIFT", M.EDITED)}
    assert report(make, applied(None), [script], [TABLE_T]) == {1: ("OK", "")}
    assert report(make, applied(""), [script], [TABLE_T]) == {1: ("OK", "")}
    both = f"{M.EDITED}; public.t: claimed applied but missing"
    assert report(make, applied(sha("before")), [script]) == {1: ("DRIFT", both)}


def test_missing_objects_in_source_order(make):
    script = make.script("a", 1, "create table z (i int);\ncreate table t (i int);\ncreate view s.b as select 1;")
    detail = "public.z: claimed applied but missing; s.b: claimed applied but missing"
    assert report(make, [("a", 1, "applied")], [script], [TABLE_T]) == {1: ("DRIFT", detail)}


def test_reverted_but_still_there(make):
    script = make.script("a", 1, "create table t (i int);")
    assert report(make, [("a", 1, "reverted")], [script]) == {1: ("OK", "")}
    assert report(make, [("a", 1, "reverted")], [script], [TABLE_T]) == {1: ("DRIFT", "public.t: claimed reverted but still exists")}


def test_script_gone(make):
    found = report(make, [("a", 1, "applied"), ("a", 2, "reverted")], [])
    assert found == {1: ("DRIFT", "version 1 does not match any migration file in corpus"), 2: ("OK", "")}


def test_drops_and_recreates(make):
    create = make.script("a", 1, "create table t (i int);")
    drop = make.script("a", 2, "drop table t;")
    both = [("a", 1, "applied"), ("a", 2, "applied")]
    assert report(make, both, [create, drop]) == {1: ("OK", ""), 2: ("OK", "")}
    # Dropped first, created later: a genuine disappearance is drift.
    swapped = [make.script("a", 1, "drop table t;"), make.script("a", 2, "create table t (i int);")]
    assert report(make, both, swapped, [TABLE_T]) == {1: ("OK", ""), 2: ("OK", "")}
    assert report(make, both, swapped)[2][0] == "DRIFT"
    # A drop that was reverted excuses nothing.
    assert report(make, [("a", 1, "applied"), ("a", 2, "reverted")], [create, drop])[1][0] == "DRIFT"
    # Another target's drop neither.
    other = make.script("b", 2, "drop table t;")
    assert report(make, [("a", 1, "applied"), ("b", 2, "applied")], [create, other])[1][0] == "DRIFT"


def test_schema_is_ignored_only_where_the_dialect_does(make):
    script = make.script("a", 1, "create table x.t (i int);")
    assert report(make, [("a", 1, "applied")], [script], [("a", "main", "t", "table")], "lite") == {1: ("OK", "")}
    assert report(make, [("a", 1, "applied")], [script], [("a", "main", "t", "table")], "pg")[1][0] == "DRIFT"


def test_shared_corpus(make):
    corpus = make.shared_corpus([make.script(None, 1, "create table t (i int);")[1:]])
    ledger = make.ledger([("a", 1, "applied"), ("b", 1, "applied")])
    found = V.verify(ledger, corpus, make.objects([TABLE_T]), "pg")
    assert rows(found, "target", "status") == [("a", "OK"), ("b", "DRIFT")]


@pytest.mark.parametrize("seed", range(3))
def test_report_against_replay(make, seed):
    """Walk the scripts in order, per target, as one would by hand."""
    rng = random.Random(seed)
    names = ["t", "u", "v"]
    scripts, ledger, live = [], [], []
    for target in "abcd":
        for version in range(1, 9):
            verbs = [(rng.choice(["create", "drop"]), rng.choice(names)) for _ in range(rng.randint(0, 3))]
            body = "\n".join(f"{verb} table {name}" + (" (i int);" if verb == "create" else ";") for verb, name in verbs)
            if rng.random() < 0.9:
                scripts.append((target, version, verbs, body))
            ledger.append((target, version, rng.choice(["applied", "applied", "reverted"])))
        live += [(target, "public", name, "table") for name in names if rng.random() < 0.4]
    have = {(t, v): verbs for t, v, verbs, _ in scripts}
    expected = {}
    for target in "abcd":
        gone = {}
        mine = [e for e in ledger if e[0] == target]
        for _, version, status in mine:
            if status != "applied":
                continue
            for verb, name in have.get((target, version), []):
                if verb == "drop":
                    gone[name] = version
            for verb, name in have.get((target, version), []):
                if verb == "create":
                    gone.pop(name, None)
        for _, version, status in mine:
            if (target, version) not in have:
                text = f"version {version} does not match any migration file in corpus" if status == "applied" else ""
                expected[target, version] = text
                continue
            parts = []
            for verb, name in have[target, version]:
                there = (target, "public", name, "table") in live
                if verb == "create" and status == "applied" and not there and not gone.get(name, -1) > version:
                    parts.append(f"public.{name}: claimed applied but missing")
                if verb == "create" and status == "reverted" and there:
                    parts.append(f"public.{name}: claimed reverted but still exists")
            expected[target, version] = "; ".join(parts)
    corpus = make.corpus([make.script(t, v, body) for t, v, _, body in scripts])
    found = V.verify(make.ledger(ledger), corpus, make.objects(live), "pg").collect()
    assert {(r["target"], r["version"]): r["detail"] for r in found} == expected
    assert all((r["status"] == "DRIFT") == bool(r["detail"]) for r in found)


def test_object_operators(spark, make):
    claims = spark.createDataFrame(
        [("a", 1, 0, "s", "T", "table"), ("a", 2, 0, "s", "x", "table"), ("b", 1, 0, "s", "T", "table")],
        "target string, version long, pos int, schema string, name string, kind string",
    )
    live = make.objects([("a", "s", "t", "table"), ("a", "s", "x", "table"), ("a", "s", "x", "table"), ("a", "z", "T", "table")])
    key = ("target", "version")
    assert rows(J.object_exists(claims, live), *key, "exists") == [("a", 1, False), ("a", 2, True), ("b", 1, False)]
    assert rows(J.object_exists(claims, live, case_sensitive=False), *key, "exists")[0] == ("a", 1, True)
    assert rows(J.missing_objects(claims, live, ignore_schema=True), *key) == [("b", 1)]
    assert rows(J.leftover_objects(claims, live), *key) == [("a", 2)]


def test_shared_tables_go_with_their_block(spark, make):
    """Two reports at once: the end of one leaves the other's tables alone."""
    import os
    import threading

    from driftledger.plans.verify import verify
    from driftledger.sources.shared import shared_tables

    folder = spark.conf.get("spark.checkpoint.dir")
    tables = lambda: {f for f in os.listdir(folder) if f.startswith("audited-")}
    before, ready, done, seen = tables(), threading.Event(), threading.Event(), {}

    def report(name, wait):
        with shared_tables(spark):
            found = verify(make.ledger([(name, 1, "applied")]), make.corpus([make.script(name, 1, "create table t (i int);")]), make.objects([]), "pg")
            if wait:
                ready.set()
                done.wait(60)
            seen[name] = rows(found, "target", "status")

    slow = threading.Thread(target=report, args=("slow", True))
    slow.start()
    assert ready.wait(60)
    report("quick", False)
    assert len(tables() - before) == 1
    done.set()
    slow.join()
    assert seen == {"quick": [("quick", "DRIFT")], "slow": [("slow", "DRIFT")]} and tables() == before
    with pytest.raises(ZeroDivisionError), shared_tables(spark):
        verify(make.ledger([]), make.corpus([]), make.objects([]), "pg")
        1 / 0
    assert tables() == before
