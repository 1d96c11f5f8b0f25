import collections
import datetime as dt
import random

import pytest
from conftest import NOW, rows
from pyspark.sql import functions as F

from driftledger import messages as M
from driftledger.operators import ledger as L
from driftledger.operators import scripts as S
from driftledger.plans import flows

OLD = dt.datetime(2025, 1, 1)


def test_bookkeeping_from_first_apply_to_backfill(spark, make):
    """100 applied, 100 reverted, 200 applied, then a backfill up to 300."""
    ledger = make.ledger([])
    for version, status in [(100, "applied"), (100, "reverted"), (200, "applied")]:
        ledger = L.set_status(ledger, make.instructions([("a", version, status)]), NOW, "n")
    corpus = make.corpus([make.script("a", v, "select 1") for v in (100, 200, 300, 400)])
    ledger = L.backfill(ledger, corpus, make.cursor([("a", 300, False)]))
    assert rows(ledger) == [
        ("a", 100, "reverted", NOW, "n", None),
        ("a", 200, "applied", NOW, "n", None),
        ("a", 300, "applied", None, M.NOTE_BACKFILLED, None),
    ]
    assert rows(L.applied_versions(ledger), "version") == [(200,), (300,)]


def test_upsert_keeps_the_first_hash_even_when_absent(make):
    ledger = make.ledger([("a", 1, "applied", OLD, "x", "h1"), ("a", 2, "applied", OLD, "x", None)])
    changes = make.ledger([("a", 1, "reverted", NOW, "y", "h9"), ("a", 2, "applied", NOW, "y", "h9"), ("b", 1, "applied", NOW, "y", "h9")])
    assert rows(L.upsert(ledger, changes)) == [
        ("a", 1, "reverted", NOW, "y", "h1"),
        ("a", 2, "applied", NOW, "y", None),
        ("b", 1, "applied", NOW, "y", "h9"),
    ]
    latest = rows(L.upsert(ledger, changes, "latest"), "target", "version", "content_sha256")
    assert latest == [("a", 1, "h9"), ("a", 2, "h9"), ("b", 1, "h9")]
    with pytest.raises(ValueError):
        L.upsert(ledger, changes, "other")


def test_fold_is_the_same_as_writing_one_after_the_other(spark, make):
    rng = random.Random(3)
    log = [
        (rng.choice("ab"), rng.randint(1, 4), rng.choice(["applied", "reverted"]), NOW, f"n{i}", rng.choice([None, f"h{i}"]), i)
        for i in range(60)
    ]
    state = {}
    for target, version, status, at, note, sha, _ in log:
        kept = state[target, version][3] if (target, version) in state else sha
        state[target, version] = (status, at, note, kept)
    df = spark.createDataFrame(log, "target string, version long, status string, recorded_at timestamp, note string, content_sha256 string, i int")
    assert rows(L.fold(df, ["i"])) == sorted([(t, v, *s) for (t, v), s in state.items()], key=repr)


def test_pending_follows_the_cursor(make):
    corpus = make.corpus([make.script(t, v, "x") for t in "abc" for v in (1, 2)] + [make.script("a", 3, "x", "down")])
    cursor = make.cursor([("a", 1, False), ("b", None, False)])
    assert rows(S.pending(corpus, cursor), "target", "version") == [("a", 2), ("b", 1), ("b", 2), ("c", 1), ("c", 2)]
    assert rows(S.pending(corpus, cursor, listed_only=True), "target", "version") == [("a", 2), ("b", 1), ("b", 2)]


def test_shared_corpus_is_pending_per_target(make):
    corpus = make.shared_corpus([make.script(None, v, "x")[1:] for v in (0, 5, 7, 2**62 + 5, 2**63 - 1)])
    places = {"a": 5, "b": None, "c": 2**63 - 1, "d": 0, "e": 6, "f": 2**62}
    cursor = make.cursor([(t, v, False) for t, v in places.items()])
    versions = [0, 5, 7, 2**62 + 5, 2**63 - 1]
    expected = sorted([(t, v) for t, c in places.items() for v in versions if c is None or v > c], key=repr)
    assert rows(S.pending(corpus, cursor), "target", "version") == expected
    counts = rows(S.pending_summary(corpus, cursor), "target", "n_pending", "next_version")
    firsts = {t: [v for u, v in expected if u == t] for t in places}
    assert counts == sorted([(t, len(v), min(v)) for t, v in firsts.items() if v], key=repr)
    below = sorted([(t, v) for t, c in places.items() for v in versions if c is not None and v <= c], key=repr)
    assert rows(S.reached(corpus, cursor)) == below


def test_dirty_targets_are_refused(make):
    corpus = make.corpus([make.script(t, v, "x") for t in "abc" for v in (1, 2)])
    cursor = make.cursor([("a", 1, True), ("b", 1, False), ("c", None, True)])
    found = rows(S.pending_scripts(corpus, cursor), "target", "version", "error")
    message = "migration cursor is dirty at version 1; repair the target to resolve it"
    # Without a version there is nothing half applied, so c is not refused.
    assert found == sorted([("a", None, message), ("b", 2, None), ("c", 1, None), ("c", 2, None)], key=repr)
    ledger = make.ledger([])
    assert rows(L.backfill(ledger, corpus, cursor), "target", "version") == [("b", 1)]
    assert rows(L.record_applied(ledger, corpus, cursor, NOW), "target", "version") == [("b", 2), ("c", 1), ("c", 2)]


def test_next_version(make):
    empty = make.corpus([make.script("a", 1, "x")])
    assert rows(S.next_version(empty, NOW), "target", "next_version") == [("a", 20260115100000)]
    ahead = make.corpus([make.script("a", 20260120000000, "x"), make.script("a", 20270101000000, "x", "down")])
    assert rows(S.next_script_name(ahead, NOW, "x y")) == [("a", 20260120000001, None, "20260120000001_x_y.up.sql")]


def test_later_file_name_wins(make):
    corpus = make.corpus([make.script("a", 1, "first", name="a"), make.script("a", 1, "second", name="b")])
    keys = make.instructions([("a", 1), ("a", 2)]).select("target", "version")
    assert rows(S.find(corpus, keys)) == [
        ("a", 1, "00000000000001_b.up.sql", None),
        ("a", 2, None, "version 2 does not match any migration file in corpus"),
    ]


def test_down_plan_and_missing_scripts(make):
    ledger = make.ledger([("a", v, "applied") for v in (1, 2, 3)] + [("b", 1, "reverted"), ("c", 9, "applied")])
    corpus = make.corpus([make.script("a", v, "x", "down") for v in (1, 2, 3)])
    assert rows(L.down_plan(ledger, corpus, 1), "target", "version") == [("a", 3), ("c", 9)]
    for steps in (0, -1, 5):
        assert rows(L.down_plan(ledger, corpus, steps), "target", "version") == [("a", 1), ("a", 2), ("a", 3), ("c", 9)]
    errors = [r for r in rows(L.down_plan(ledger, corpus, 1), "target", "error") if r[1]]
    assert errors == [("c", "version 9 does not have a matching .down.sql migration file in corpus")]


def test_revert_is_all_or_nothing_per_target(make):
    ledger = make.ledger([("a", 1, "applied"), ("a", 2, "applied"), ("b", 1, "applied"), ("b", 2, "applied")])
    corpus = make.corpus([make.script("a", 1, "x", "down"), make.script("a", 2, "x", "down"), make.script("b", 2, "x", "down")])
    cursor = make.cursor([("a", 2, False), ("b", 2, False)])
    after = L.record_reverted(ledger, corpus, cursor, NOW, 2)
    assert rows(after, "target", "version", "status") == [
        ("a", 1, "reverted"), ("a", 2, "reverted"), ("b", 1, "applied"), ("b", 2, "applied"),
    ]
    assert rows(L.record_reverted(ledger, corpus, cursor, NOW, 0), "target", "version", "status") == rows(after, "target", "version", "status")


def test_many_steps_are_ranked_in_ranges(spark, monkeypatch):
    """Sequence numbers and timestamps mixed: ranges follow the rows, not the numbers."""
    monkeypatch.setattr(L, "RANGE", 100)
    numbers = [*range(1, 6), *(20260101000000 + i for i in range(3000)), 1 << 62]
    rows_of = [("a", v, "applied") for v in numbers] + [("b", v, "applied") for v in range(50)] + [(None, 1, "applied")]
    ledger = spark.createDataFrame(rows_of, "target string, version long, status string").repartition(3)
    cuts = L._cuts(L.applied_versions(ledger))["a"]
    edges = [-1, *cuts, 1 << 63]
    held = [sum(low < v <= high for v in numbers) for low, high in zip(edges, edges[1:])]
    assert list(L._cuts(L.applied_versions(ledger))) == ["a"] and len(held) > 2 and max(held) <= 1.3 * len(rows_of) / 4
    for steps in (1, 3, 900, 2999, 5000):
        found = rows(L.last_applied(ledger, steps))
        expected = [("a", v, i) for i, v in enumerate(sorted(numbers, reverse=True)[:steps], 1)] + [("b", v, 50 - v) for v in range(50) if 50 - v <= steps] + [(None, 1, 1)]
        assert found == sorted(expected, key=repr)


@pytest.mark.parametrize("steps", [-1, 0, 1, 2, 3, 9])
def test_soft_revert_and_cursor_against_replay(make, steps):
    rng = random.Random(steps)
    data = {t: {v: rng.choice(["applied", "applied", "reverted"]) for v in rng.sample(range(20), rng.randint(0, 5))} for t in "abcdefgh"}
    ledger = make.ledger([(t, v, s) for t, versions in data.items() for v, s in versions.items()])
    cursor = make.cursor([(t, 77, t == "a") for t in data])
    expected, places = [], []
    for t, versions in data.items():
        applied = sorted(v for v, s in versions.items() if s == "applied")
        count = 1 if steps <= 0 or steps > len(applied) else steps
        for v in applied[len(applied) - count :] if applied else []:
            versions[v] = "reverted"
        expected += [(t, v, s) for v, s in versions.items()]
        left = [v for v, s in versions.items() if s == "applied"]
        places.append((t, max(left), False) if left else (t, 77, t == "a"))
    after = L.soft_revert(ledger, NOW, steps)
    assert rows(after, "target", "version", "status") == sorted(expected, key=repr)
    assert rows(L.recompute_cursor(after, cursor)) == sorted(places, key=repr)


def test_flows(make):
    corpus = make.corpus([make.script(t, v, f"x{v}") for t in "ab" for v in (1, 2, 3)] + [make.script("a", 3, "d", "down")])
    cursor = make.cursor([("a", 1, False), ("b", 2, True)])
    done = flows.apply_pending(make.ledger([]), corpus, cursor, NOW)
    assert rows(done.ledger, "target", "version", "note") == [("a", 1, M.NOTE_BACKFILLED), ("a", 2, M.NOTE_APPLIED), ("a", 3, M.NOTE_APPLIED)]
    assert rows(done.cursor) == [("a", 3, False), ("b", 2, True)]
    assert rows(done.refused, "target") == [("b",)]
    back = flows.rollback(done.ledger, corpus, done.cursor, NOW)
    assert rows(back.cursor) == [("a", 2, False), ("b", 2, True)]
    down = flows.run_down(done.ledger, corpus, done.cursor, NOW)
    assert rows(down.cursor) == [("a", 2, False), ("b", 2, True)]
    assert rows(down.ledger.filter("version = 3"), "status", "note") == [("reverted", M.NOTE_REVERTED)]
    refused = flows.run_down(done.ledger, corpus, done.cursor, NOW, 2)  # 2 has no down script
    assert rows(refused.cursor) == rows(done.cursor)


def test_hash_drift_variants(make):
    corpus = make.corpus([make.script("a", 1, "new"), make.script("a", 2, "same"), make.script("a", 3, "new")])
    import hashlib

    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ledger = make.ledger(
        [("a", 1, "applied", None, "", h("old")), ("a", 2, "applied", None, "", h("same")), ("a", 3, "reverted", None, "", h("old")),
         ("a", 4, "applied", None, "", h("gone")), ("a", 5, "applied")]
    )
    assert rows(L.hash_drift(ledger, corpus), "version") == [(1,)]
    assert rows(L.hash_drift(ledger, corpus, missing_is_mismatch=True), "version") == [(1,), (4,)]


def test_no_version_is_left(make):
    corpus = make.corpus([make.script("a", (1 << 63) - 1, "x"), make.script("b", 3, "x")])
    found = {r["target"]: (r["next_version"], r["filename"], r["error"]) for r in S.next_script_name(corpus, NOW, "n").collect()}
    assert found["a"] == (None, None, "no version is left above 9223372036854775807") and found["b"][2] is None


def test_changes_are_refused_by_target(make):
    ledger = make.ledger([("a", 1, "applied"), ("b", 1, "applied")])
    changes = [("a", 1, "reverted"), ("a", 1, "applied"), ("a", 2, "applied"), ("b", 1, "reverted"), ("c", -4, "applied"), ("d", 5, "open"), ("e", None, "applied"), ("f", 7, "applied")]
    accepted, refused = L.split_changes(make.ledger(changes))
    assert rows(refused) == [
        ("a", 1, "version 1 is changed more than once"), ("c", -4, "ledger contains negative version -4; the table was modified outside"),
        ("d", 5, "unknown status open"), ("e", None, "ledger row without a version"),
    ]
    assert rows(L.upsert(ledger, accepted), "target", "version", "status") == [("a", 1, "applied"), ("b", 1, "reverted"), ("f", 7, "applied")]


@pytest.mark.parametrize("steps", [1, 7, 300, 5000])
def test_last_applied_of_any_number(spark, steps):
    ledger = spark.range(4000).select(
        F.when(F.col("id") % 5 == 0, "b").otherwise("a").alias("target"), (F.col("id") * F.col("id") * 99991).alias("version"),
        F.when(F.col("id") % 3 == 0, "reverted").otherwise("applied").alias("status"))
    found = collections.defaultdict(list)
    for r in L.last_applied(ledger, steps).collect():
        found[r["target"]].append((r["step"], r["version"]))
    for target in "ab":
        applied = sorted((i * i * 99991 for i in range(4000) if i % 3 and (target == "b") == (i % 5 == 0)), reverse=True)[:steps]
        assert sorted(found[target]) == list(enumerate(applied, 1))
