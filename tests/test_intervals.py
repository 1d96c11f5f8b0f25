import random

import pytest
from conftest import rows

from driftledger.operators import scripts as S


@pytest.fixture()
def small_broadcasts(spark):
    """A broadcast beyond 68 MiB ends the job; the smallest ones take 64."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", str(68 << 20))
    yield
    spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_what_is_formed_from_targets_and_scripts_is_not_broadcast(spark, tmp_path, small_broadcasts):
    """Tables whose files are small, so that all that is made of them looks small to the optimizer."""
    spark.range(8000).selectExpr("id * 3 AS version", "'up' AS direction", "concat(id, '.up.sql') AS filename", "'x' AS body").write.parquet(f"{tmp_path}/s")
    spark.range(8000).selectExpr("cast(id AS string) AS target", "nullif(id, 7) * 3 + 1 AS version", "false AS dirty").write.parquet(f"{tmp_path}/c")
    corpus, cursor = (spark.read.parquet(f"{tmp_path}/{name}") for name in "sc")
    found = {r["target"]: (r["n_pending"], r["next_version"], r["next_file"]) for r in S.pending_summary(corpus, cursor).collect()}
    assert found == {str(t): (7999 - t, t * 3 + 3, f"{t + 1}.up.sql") for t in range(7999) if t != 7} | {"7": (8000, 0, "0.up.sql")}
    late, early = cursor.filter("version > 23000"), cursor.filter("version < 1000")  # few pairs, of some 330 targets each
    assert S.pending(corpus, late).count() == sum(7999 - t for t in range(8000) if t * 3 + 1 > 23000)
    assert S.reached(corpus, early).count() == sum(t + 1 for t in range(8000) if t * 3 + 1 < 1000 and t != 7)


def test_ranges_agree_with_all_pairs(make):
    """Values that repeat, lie close together or far apart, or are NULL, in more ranges than one."""
    pick = random.Random(3)
    values = [None, 0, 5, 5, 2**62, 2**63 - 2, 2**63 - 1] + [pick.randrange(900) for _ in range(700)] + [2**53 + pick.randrange(90) for _ in range(90)]
    scripts = [(v, f"{i}.sql") for i, v in enumerate(values)]
    corpus = make.shared_corpus([(v, "up", f, "x") for v, f in scripts])
    places = {f"t{i}": v for i, v in enumerate([None, None, 0, 5, 2**63 - 1, 2**53 + 40, *[pick.randrange(1000) for _ in range(60)]])}
    cursor = make.cursor([(t, v, False) for t, v in places.items()])
    above = {t: [(v, f) for v, f in scripts if p is None or (v is not None and v > p)] for t, p in places.items()}
    assert rows(S.pending(corpus, cursor)) == sorted(((t, *s) for t, found in above.items() for s in found), key=repr)
    first = {t: min(found, key=lambda s: (s[0] is not None, s[0] or 0, s[1])) for t, found in above.items() if found}
    assert rows(S.pending_summary(corpus, cursor)) == sorted(((t, len(above[t]), *s) for t, s in first.items()), key=repr)
    reached = {(t, v) for t, p in places.items() for v, _ in scripts if None not in (p, v) and v <= p}
    assert rows(S.reached(corpus, cursor)) == sorted(reached, key=repr)
