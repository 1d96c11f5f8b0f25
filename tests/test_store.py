import os
import threading

import pytest
from conftest import NOW, rows
from pyspark.sql import functions as F

from driftledger.operators import ledger as L
from driftledger.plans import flows
from driftledger.sources.store import LedgerStore

FACTS = ("target", "version", "status")


def files(path):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


@pytest.fixture
def store(spark, make, tmp_path):
    store = LedgerStore(spark, str(tmp_path / "store"), buckets=8)
    store.insert(make.ledger([(t, v, "applied", NOW, "n", f"h{v}") for t in "ab" for v in range(1, 31)]))
    return store


def test_upserts_add_up(spark, make, store):
    assert store.commit().number == 1 and store.ledger().count() == 60 and rows(store.cursor()) == [("a", 30, False), ("b", 30, False)]
    number, refused = store.upsert(make.ledger([("a", 30, "reverted", None, "x", "new"), ("c", 7, "applied"), ("d", 1, "applied"), ("d", 1, "reverted"), ("e", -1, "applied")]))
    assert number == 2 and rows(refused, "target", "version") == [("d", 1), ("e", -1)]
    found = {r[:2]: r[2:] for r in rows(store.ledger())}
    assert len(found) == 61 and found["a", 30] == ("reverted", None, "x", "h30") and found["c", 7][0] == "applied"
    assert rows(store.cursor()) == [("a", 29, False), ("b", 30, False), ("c", 7, False)]
    # Earlier commits stay readable; a store knows its buckets whatever it is asked for.
    again = LedgerStore(spark, store.path, buckets=99)
    assert again.ledger(again.commit(1)).count() == 60 and len(again.commit().writes) == 8
    assert again.insert(make.ledger([("a", 1, "reverted"), ("f", 1, "applied")])) == 3
    assert rows(again.ledger().filter("version = 1"), *FACTS) == [("a", 1, "applied"), ("b", 1, "applied"), ("f", 1, "applied")]


def test_only_touched_buckets_are_written(spark, make, store):
    before = files(f"{store.path}/ledger")
    store.upsert(make.ledger([("a", 3, "reverted")]))
    after = files(f"{store.path}/ledger")
    new = {f.split("bucket=")[1].split("/")[0] for f in after.keys() - before.keys()}
    assert len(new) == 1 and all(after[f] == t for f, t in before.items())
    old, now = store.commit(1).writes, store.commit(2).writes
    assert [b for b in range(8) if old[b] != now[b]] == [int(b) for b in new]
    assert len(after.keys() - before.keys()) == 1


@pytest.mark.parametrize("partitions", ["4", "200"])
def test_the_ledger_is_not_shuffled_for_changes(spark, make, store, partitions):
    settings = {"spark.sql.shuffle.partitions": partitions, "spark.sql.autoBroadcastJoinThreshold": "-1"}
    was = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        changes = make.ledger([("a", 3, "reverted")])
        for df in (L.upsert(store.ledger(), changes), L.insert_if_absent(store.ledger(), changes)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_a_lost_race_is_merged_again(spark, make, store):
    """A second writer commits while the first one has merged already: same row, other row of the bucket, other bucket."""
    def meddling(ledger, own):
        if store.commit().number == 1:
            other = make.ledger([("a", 1, "reverted", None, "other", None), ("z", 5, "applied", None, "other", None)] + [("b", v, "reverted", None, "other", None) for v in range(1, 31)])
            LedgerStore(spark, store.path).upsert(other)
        return L.upsert(ledger, own)

    assert store.merge(make.ledger([("a", 1, "applied", None, "mine", None), ("a", 2, "reverted", None, "mine", None), ("y", 9, "applied", None, "mine", None)]), meddling) == 3
    found = {r[:2]: r[2:] for r in rows(store.ledger(), "target", "version", "status", "note")}
    assert found["a", 1] == ("applied", "mine") and found["a", 2] == ("reverted", "mine") and found["y", 9] == ("applied", "mine")
    assert found["z", 5] == ("applied", "other") and all(found["b", v] == ("reverted", "other") for v in range(1, 31)) and len(found) == 62
    assert rows(store.cursor()) == [("a", 30, False), ("b", 30, False), ("y", 9, False), ("z", 5, False)]  # b has nothing applied: it stays


def test_writers_at_once_lose_nothing(spark, make, tmp_path):
    path, failed = str(tmp_path / "store"), []

    def write(name):
        try:
            LedgerStore(spark, path, buckets=2).upsert(make.ledger([(name, v, "applied") for v in range(4)]))
        except Exception as e:  # noqa: BLE001 - shown below
            failed.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in "abc"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    store = LedgerStore(spark, path)
    assert not failed and store.commits() == [1, 2, 3]
    assert rows(store.ledger(), "target", "version") == [(n, v) for n in "abc" for v in range(4)] and rows(store.cursor(), "target") == [("a",), ("b",), ("c",)]


def test_retention(spark, make, store):
    for v in (1, 2, 3):
        store.upsert(make.ledger([("a", v, "reverted")]))
    kept = rows(store.ledger())
    before = len(files(store.path))
    assert store.retain(2) == [1, 2] and store.commits() == [3, 4]
    assert rows(store.ledger()) == kept and store.ledger(store.commit(3)).count() == 60
    assert len(files(store.path)) < before and store.retain(2) == []
    assert not os.listdir(f"{store.path}/pending")


def test_a_flow_is_published_whole_and_run_again_after_a_race(spark, make, store):
    corpus = make.corpus([make.script("a", v, "x", "down") for v in range(1, 31)])
    calls = []

    def down(ledger, cursor):
        calls.append(1)
        if len(calls) == 1:
            store.upsert(make.ledger([("a", 40, "applied")]))
        return flows.run_down(ledger, corpus, cursor, NOW, 1)

    commit, refused = flows.committed(store, down)
    assert commit.number == 3 and len(calls) == 2 and refused.count() == 0
    # The newest version has no down script, so nothing is reverted; the other writer's row is there.
    assert rows(store.ledger().filter("version >= 30"), *FACTS) == [("a", 30, "applied"), ("a", 40, "applied"), ("b", 30, "applied")]
    commit, _ = flows.committed(store, lambda ledger, cursor: flows.rollback(ledger, corpus, cursor, NOW))
    assert rows(store.ledger().filter(F.col("status") == "reverted"), *FACTS) == [("a", 40, "reverted"), ("b", 30, "reverted")]
    assert rows(store.cursor(commit)) == [("a", 30, False), ("b", 29, False)]
