import pytest
from conftest import NOW, rows
from pyspark.sql import functions as F

from driftledger.operators import ledger as L
from driftledger.operators import scripts as S
from driftledger.operators import skew
from driftledger.plans import contract as K
from driftledger.plans import status as P
from driftledger.plans import verify as V


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_is_a_plain_join(spark, how):
    # A third of the rows has one key; some keys have no partner, some partners no rows, some keys are null.
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 7 == 1, None).otherwise(F.col("id") % 20)
    many = spark.range(90).select(key.alias("k"), "id")
    one = spark.range(0, 30, 3).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    assert rows(skew.lookup(many, one, ["k"], how)) == rows(many.join(one, "k", how))
    assert rows(skew.lookup(many, one.withColumn("k", F.col("k").cast("int")), ["k"], how)) == rows(many.join(one, "k", how))


@pytest.fixture
def split_early(spark):
    """Adaptive execution that takes a partition of a few kB for a skewed one."""
    skewed = "spark.sql.adaptive.skewJoin.skewedPartition"
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
        f"{skewed}ThresholdInBytes": "2k",
        f"{skewed}Factor": "1.5",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def tasks_with(df, condition):
    """Rows that meet the condition, for each task that has any; all columns are moved."""
    counted = df.groupBy("p").agg(F.count_if(condition).alias("n"), F.max("x")).collect()
    return [r.n for r in counted if r.n]


@pytest.mark.parametrize("hot", [1, None])
@pytest.mark.parametrize("aggregated", [False, True])
def test_hot_keys_are_spread(spark, split_early, hot, aggregated):
    key = F.when(F.col("id") % 3 == 0, F.lit(hot)).otherwise(F.col("id"))
    many = spark.range(0, 60000, 1, 8).select(key.alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
    few = spark.range(60000).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    few = few.groupBy("k").agg(F.max("v").alias("v")) if aggregated else few
    got = skew.lookup(many, few, ["k"], "left").withColumn("p", F.spark_partition_id())
    per_task = tasks_with(got, F.col("k").eqNullSafe(F.lit(hot)))
    assert sum(per_task) >= 20000 and len(per_task) > 1


def test_a_hot_key_of_the_other_side_is_spread(spark, split_early):
    few = spark.range(0, 300, 1, 2).select((F.col("id") % 100).alias("k"), F.col("id").alias("t"))
    many = spark.range(0, 60000, 1, 8).select(F.when(F.col("id") % 2 == 0, F.lit(1)).otherwise(F.col("id")).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
    got = skew.lookup(few, many, ["k"], "inner").withColumn("p", F.spark_partition_id())
    per_task = tasks_with(got, F.col("k") == 1)
    assert sum(per_task) >= 90000 and len(per_task) > 1


def fleet(make):
    """Target a has most of the rows."""
    body = lambda v: f"create table t{v % 3} (i int);\ndrop table if exists d{v % 2};"
    sizes = {"a": 30, "b": 3, "c": 1}
    scripts = [make.script(t, v, body(v)) for t, n in sizes.items() for v in range(1, n + 1)]
    ledger = [(t, v, "applied" if v % 4 else "reverted") for t, n in sizes.items() for v in range(1, n + 1)]
    return make.ledger(ledger), make.corpus(scripts), make.cursor([(t, n // 2, False) for t, n in sizes.items()]), make.objects([("a", "public", "t1", "table")])


def results(make):
    ledger, corpus, cursor, objects = fleet(make)
    columns = make.columns([("a", f"s{i % 5}", "t", i, f"c{i}", "text", True) for i in range(20)])
    return [
        rows(S.pending(corpus, cursor)),
        rows(S.pending_summary(corpus, cursor)),
        rows(L.backfill(ledger.limit(0), corpus, cursor)),
        rows(L.record_applied(ledger, corpus, cursor, NOW)),
        rows(V.verify(ledger, corpus, objects, "pg")),
        rows(V.verify(ledger, corpus, objects, "lite")),
        rows(V.verify(ledger, corpus.filter("target = 'a'").drop("target"), objects, "pg")),
        rows(K.schema_contract(columns, "pg")),
    ]


@pytest.fixture(scope="module")
def plain(make):
    return results(make)


def test_spreading_changes_no_result(make, plain, split_early):
    assert results(make) == plain


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_last_steps_are_limited_before_the_shuffle(make):
    ledger, *_ = fleet(make)
    plan = plan_of(L.last_applied(ledger, 3))
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_no_cross_joins_and_no_python_but_the_mask(make):
    ledger, corpus, cursor, objects = fleet(make)
    shared = corpus.filter("target = 'a'").drop("target")
    for df in (S.pending(shared, cursor), S.pending_summary(shared, cursor), S.reached(shared, cursor), V.object_findings(V.audited(ledger, corpus, "ms"), objects, "ms")):
        plan = plan_of(df)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan


def test_script_text_is_not_shuffled(make):
    _, corpus, _, _ = fleet(make)
    exchanged = [line for line in plan_of(S.script_facts(corpus, "ms")).splitlines() if "Exchange" in line or "SortAggregate" in line]
    assert exchanged and all("body#" not in line for line in exchanged)


def scanned(make, tmp_path, spark, *frames):
    """The frames, read from files."""
    out = []
    for i, df in enumerate(frames):
        df.write.parquet(f"{tmp_path}/{i}")
        out.append(spark.read.parquet(f"{tmp_path}/{i}"))
    return out


def test_inputs_are_read_once(make, spark, tmp_path):
    _, corpus, cursor, _ = fleet(make)
    columns = make.columns([("a", "s", "t", 1, "c", "text", True)])
    corpus, cursor, columns = scanned(make, tmp_path, spark, corpus, cursor, columns)
    assert plan_of(S.pending(corpus, cursor)).count("FileScan") == 2
    assert plan_of(P.status(corpus, cursor)).count("FileScan") == 3  # the cursor for its own columns, too
    assert plan_of(K.schema_contract(columns, "pg")).count("FileScan") == 3  # columns, tables, names that repeat


def test_pending_text_is_not_shuffled(make, spark, tmp_path):
    _, corpus, cursor, _ = fleet(make)
    corpus, cursor = scanned(make, tmp_path, spark, corpus, cursor)
    exchanged = [line for line in plan_of(S.pending_scripts(corpus, cursor)).splitlines() if "Exchange hashpartitioning" in line]
    assert all("body#" not in line for line in exchanged) and "BroadcastHashJoin" in plan_of(S.pending_scripts(corpus, cursor))
