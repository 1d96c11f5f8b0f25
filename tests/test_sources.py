import pathlib

import pytest
from conftest import NOW, rows
from pyspark.sql import functions as F

from driftledger.functions.text import content_hash
from driftledger.operators import checks as A
from driftledger.schemas import LEDGER
from driftledger.sources import catalog as X
from driftledger.sources import corpus as C
from driftledger.sources import ledger as L
from driftledger.sources import store as D
from driftledger.sources.shared import share, shared_folder


def test_corpus_from_a_folder(spark, tmp_path):
    import hashlib

    content = {"2_b.up.sql": "select 'é';\r\n".encode(), "1_a.up.sql": b"\xff\x00", "1_a.down.sql": b"", "notes.txt": b"x", "4_a%20b c+é.up.sql": b"z", "9" * 25 + "_x.up.sql": b"x",
               "9223372036854775808_x.up.sql": b"x"}
    for name, data in content.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "3_dir.up.sql").mkdir()
    corpus = C.read_corpus(spark, str(tmp_path))
    assert rows(corpus, "version", "direction", "filename") == [(1, "down", "1_a.down.sql"), (1, "up", "1_a.up.sql"), (2, "up", "2_b.up.sql"), (4, "up", "4_a%20b c+é.up.sql")]
    assert rows(C.versions(corpus)) == [(1,), (2,), (4,)]
    hashes = dict(rows(corpus.select("filename", content_hash("body"))))
    assert hashes == {n: hashlib.sha256(content[n]).hexdigest() for n in hashes}
    rejected = C.out_of_range(C.scan_files(spark, str(tmp_path)))
    assert rows(rejected, "error") == [("migration version 9223372036854775808 exceeds the ledger's range",)]


def test_absent_folder_is_an_empty_corpus(spark, tmp_path):
    assert C.read_corpus(spark, str(tmp_path / "none")).count() == 0


def test_corpus_table(spark, make, tmp_path):
    make.corpus([make.script("a", 1, "x")]).drop("body").write.parquet(str(tmp_path / "c"))
    assert rows(C.read_corpus_table(spark, str(tmp_path / "c")), "target", "body") == [("a", None)]


def test_ledger_is_replaced(spark, make, tmp_path):
    path = str(tmp_path / "ledger")
    assert D.read_ledger(spark, path).count() == 0
    first = make.ledger([("a", 1, "applied", NOW, "n", "h"), ("a", 2, "applied")])
    assert D.write_ledger(first, path) == 1
    before = D.read_ledger(spark, path)
    # The new ledger is made from the old one while that is still being read.
    assert D.write_ledger(before.filter("version = 1").withColumn("status", F.lit("reverted")), path) == 2
    assert rows(D.read_ledger(spark, path)) == [("a", 1, "reverted", NOW, "n", "h")]
    assert before.count() == 2
    # Rows that no commit names are not there.
    store = D.LedgerStore(spark, path)
    store._write(first, 64, dealt=False)
    assert D.read_ledger(spark, path).count() == 1
    with pytest.raises(RuntimeError, match="has changed since commit 1"):
        D.write_ledger(first, path, base=store.commit(1))
    assert store.commits() == [1, 2]


def test_old_ledgers_and_bad_rows(spark, make, tmp_path):
    old = spark.createDataFrame([("a", 1, "applied"), ("b", -5, "applied"), ("c", 2, "open")], "target string, version long, status string")
    assert L.as_ledger(old).schema.names == LEDGER.names
    assert rows(L.as_ledger(make.ledger([("a", 1, "applied", None, "", "")])), "content_sha256") == [(None,)]
    good, bad = L.split_ledger(old)
    assert rows(good, "target") == [("a",)]
    assert rows(bad, "target", "error") == [("b", "ledger contains negative version -5; the table was modified outside"), ("c", "unknown status open")]
    D.write_ledger(old, str(tmp_path / "l"))
    with pytest.raises(Exception, match="negative version|unknown status"):
        D.read_ledger(spark, str(tmp_path / "l"), strict=True).collect()
    assert D.read_ledger(spark, str(tmp_path / "l")).count() == 3
    sound, refused = D.read_checked(spark, str(tmp_path / "l"))
    assert rows(sound, "target") == [("a",)] and rows(refused, "target") == [("b",), ("c",)]


def test_shared_folder_is_the_named_one(spark):
    named = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    assert shared_folder(spark) == str(named)
    assert share(spark.range(3), "three").count() == 3
    assert any(p.name.startswith("three-") for p in named.iterdir())


def test_lite_columns(spark):
    tables = spark.createDataFrame([("a", "x", "t", "BASE TABLE"), ("a", "x", "sqlite_seq", "BASE TABLE"), ("a", "x", "v", "VIEW")],
                                   "target string, schema string, table string, table_type string")
    raw = spark.createDataFrame([("a", t, i, c, 0, pk) for t in ("t", "sqlite_seq", "v") for i, (c, pk) in enumerate([("id", 1), ("n", 0)], 1)],
                                "target string, table string, ordinal int, column string, not_null int, pk int")
    found = X.table_columns(tables, raw, "lite")
    assert rows(found, "schema", "table", "column", "nullable") == [("main", "t", "id", False), ("main", "t", "n", True)]


def test_system_schemas_and_exclusions(spark, make):
    tables = spark.createDataFrame([("a", s, "t", "BASE TABLE") for s in ("public", "pg_catalog", "information_schema")],
                                   "target string, schema string, table string, table_type string")
    raw = spark.createDataFrame([("a", s, "t", 1, "c", "YES") for s in ("public", "pg_catalog", "information_schema")],
                                "target string, schema string, table string, ordinal int, column string, is_nullable string")
    assert rows(X.table_columns(tables, raw, "pg"), "schema") == [("public",)]
    assert X.table_columns(tables, raw, "ms").count() == 3
    columns = make.columns([("a", "S", "T"), ("a", "S", "u"), ("a", "z", "u")])
    assert rows(X.exclude_tables(columns, [" t ", "s.U"]), "schema", "table") == [("z", "u")]
    assert X.exclude_tables(columns, []).count() == 3


def test_lake_inventory(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS audit_test")
    try:
        spark.sql("CREATE TABLE audit_test.t (id bigint NOT NULL, name string) USING parquet")
        spark.sql("CREATE VIEW audit_test.v AS SELECT 1 AS one")
        assert rows(X.lake_objects(spark, "audit_test", "lake")) == [("lake", "audit_test", "t", "table"), ("lake", "audit_test", "v", "view")]
        assert rows(X.lake_columns(spark, "audit_test", "lake"), "table", "ordinal", "column", "data_type") == [("t", 1, "id", "bigint"), ("t", 2, "name", "string")]
    finally:
        spark.sql("DROP DATABASE audit_test CASCADE")


def test_data_checks(spark):
    people = spark.createDataFrame([(1, None, "chief"), (2, 1, "lead"), (3, 2, "dev"), (4, 9, "dev")], "id int, boss int, job string")
    assert rows(A.parent_of(people, "id", "boss", ["job"]), "id", "parent_job") == [(2, "chief"), (3, "lead")]
    assert rows(A.fk_check(people, people, {"boss": "id"})) == [(9, 1)]
    assert rows(A.null_counts(people)) == [("boss", 1), ("id", 0), ("job", 0)]
    assert rows(A.composite_key(people.union(people.limit(1)), ["id", "job"]).select("n_rows")) == [(2,)]
    assert rows(A.key_count(people, F.col("job") == "dev")) == [(2,)]


def test_folder_scan_sees_every_regular_file(spark, tmp_path):
    files = {"1_a.up.sql": b"x", "_draft.sql": b"d", ".hidden": b"h", "2_empty.up.sql": b"", "3 b%20c.up.sql": b"\xff", "4_[a]{b}.up.sql": b"y"}
    for name, body in files.items():
        (tmp_path / name).write_bytes(body)
    for folder in ("sub", "k=v"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "9_z.up.sql").write_bytes(b"no")
    for path in (str(tmp_path), f"file://{tmp_path}/"):
        found = C.scan_files(spark, path).selectExpr("filename", "CAST(body AS binary) AS body", "error").collect()
        assert {r.filename: bytes(r.body) for r in found} == files and not any(r.error for r in found)
    assert C.scan_files(spark, str(tmp_path / "none")).count() == 0


def test_folders_fail_alone(spark, tmp_path):
    from driftledger.sources import folder as W

    for name in "abc":
        (tmp_path / name).mkdir()
        (tmp_path / name / "1_x.up.sql").write_text(name)
    (tmp_path / "d").write_text("no folder")
    listed = W.list_files(spark.createDataFrame([(t, str(tmp_path / t)) for t in "abcde"] + [("f", "nowhere://x/y")], "target string, folder string"))
    assert rows(listed, "target", "filename", "length") == [("a", "1_x.up.sql", 1), ("b", "1_x.up.sql", 1), ("c", "1_x.up.sql", 1), ("d", None, None), ("f", None, None)]
    listed = spark.createDataFrame(listed.collect(), listed.schema)
    (tmp_path / "b" / "1_x.up.sql").unlink()
    (tmp_path / "c" / "1_x.up.sql").write_text("longer")
    sound, refused = W.split_files(W.read_files(listed))
    assert rows(sound) == [("a", "1_x.up.sql", "a")]
    errors = {r.target: r.error for r in refused.collect()}
    assert sorted(errors) == ["b", "c", "d", "f"] and errors["b"].startswith("FileNotFoundError") and errors["c"] == "listed with 1 bytes, read with 6"
    with pytest.raises(Exception, match="read with 6"):
        C.corpus_from_files(C._raised(W.read_files(listed.filter("target = 'c'")), "c")).collect()


def test_files_are_dealt_by_bytes(spark, tmp_path):
    from driftledger.sources import folder as W

    written = spark.range(300).selectExpr(f"'{tmp_path}/many' AS folder", "concat(id, '_x.up.sql') AS filename", "repeat('x', 1000) AS body")
    assert W.write_files(written) == 300
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        listed = W.list_files(spark.createDataFrame([("a", f"{tmp_path}/many")], "target string, folder string"))
        parts = W.read_files(listed).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert len(parts) == 5 and sum(p["count"] for p in parts) == 300 and max(p["count"] for p in parts) < 100


def test_folders_are_written_and_listed_in_many_tasks(spark, tmp_path, monkeypatch):
    """Small tables in one partition: their files are what takes long, not their rows."""
    from driftledger.sources import folder as W

    monkeypatch.setattr(W, "OPENING", 1 << 22)  # 32 files a task
    names = spark.range(0, 200, 1, 1).selectExpr(f"concat('{tmp_path}/made/', id % 8) AS folder", "concat(id, '_x.up.sql') AS filename", "cast(id AS string) AS body")
    dealt = W._dealt(names, F.octet_length("body")).groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) == 7 and max(p["count"] for p in dealt) < 60
    assert W.write_files(names) == 200
    folders = spark.range(0, 8, 1, 1).selectExpr("cast(id AS string) AS target", f"concat('{tmp_path}/made/', id) AS folder")
    listed = W.list_files(folders)
    tasks = listed.groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("target").alias("n")).collect()
    assert len(tasks) >= 4 and max(t["n"] for t in tasks) <= 2
    assert rows(listed, "target", "filename") == sorted((str(i % 8), f"{i}_x.up.sql") for i in range(200))


def test_writing_makes_more_tasks_than_the_table_has(spark, tmp_path, monkeypatch):
    from driftledger.sources import folder as W

    monkeypatch.setattr(W, "OPENING", 1 << 22)
    seen, begun = spark.sparkContext.statusTracker(), set()
    spark.sparkContext.setJobGroup("writing", "files written")
    try:
        W.write_files(spark.range(0, 200, 1, 1).selectExpr(f"'{tmp_path}/w' AS folder", "concat(id, '.sql') AS filename", "'x' AS body"))
        for job in seen.getJobIdsForGroup("writing"):
            begun |= {seen.getStageInfo(s).numTasks for s in seen.getJobInfo(job).stageIds if seen.getStageInfo(s)}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert max(begun) == 7 and len(list((tmp_path / "w").iterdir())) == 200


def test_split_opens_each_file_once(spark, tmp_path):
    """What was read is kept: files that change later change no result."""
    from driftledger.sources import folder as W

    for name in "ab":
        (tmp_path / name).mkdir()
        (tmp_path / name / "1_x.up.sql").write_bytes(b"\xff" + name.encode())
    (tmp_path / "c").write_text("no folder")
    found = spark.createDataFrame([(t, str(tmp_path / t)) for t in "abc"], "target string, folder string")
    sound, refused = W.split_files(W.scan_folders(found))
    (tmp_path / "a" / "1_x.up.sql").unlink()
    (tmp_path / "b" / "1_x.up.sql").write_bytes(b"other and longer")
    assert [bytes(r["b"]) for r in sound.selectExpr("target", "cast(body AS binary) AS b").orderBy("target").collect()] == [b"\xffa", b"\xffb"]
    assert rows(refused, "target", "filename") == [("c", None)]
