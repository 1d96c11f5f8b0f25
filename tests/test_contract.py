from conftest import rows
from pyspark.sql import functions as F

import pytest

from driftledger.functions import naming, types
from driftledger.plans import contract as K


def column(spark, function, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").coalesce(1)
    return [r[0] for r in df.select(function(F.col("v")).alias("r"), "i").orderBy("i").select("r").collect()]


def test_reserved_words():
    assert len(naming.PYTHON_RESERVED) == 35 and len(naming.WEB_RESERVED) == len(set(naming.WEB_RESERVED)) == 47


def test_names(spark):
    given = ["fact_widget_sale", "trade-log", "2fa_codes", "user id", "a.B", "a$b", "__", ""]
    assert column(spark, naming.pascal_case, *given) == ["FactWidgetSale", "TradeLog", "_2faCodes", "UserId", "AB", "A$b", "Empty", "Empty"]
    given = ["class", "ticker", "user id", "2fa", "select", "é", "", "None"]
    assert column(spark, naming.safe_field, *given) == ["class_", "ticker", "userid", "_2fa", "select", "_", "_", "None_"]
    given = ["class", "user_id", "user id", "2fa", "", "None"]
    assert column(spark, naming.web_name, *given) == ["class_", "user_id", '"user id"', '"2fa"', '""', "None"]


@pytest.mark.parametrize(
    "dialect,pairs",
    [
        ("pg", {"INTEGER": "int", "double precision": "float", "money": "Decimal", "bool": "bool", "citext": "str", "date": "datetime",
                "timetz": "time", "uuid": "UUID", "bytea": "bytes", "jsonb": "Any", "varchar(40)": None, "geometry": None}),
        ("ms", {"tinyint": "int", "real": "float", "smallmoney": "Decimal", "bit": "bool", "ntext": "str", "datetimeoffset": "datetime",
                "time": "time", "UniqueIdentifier": "UUID", "image": "bytes", "xml": None, "uuid": None}),
        ("lite", {"INTEGER": "int", "point": "int", "DECIMAL(10,2)": "Decimal", "numeric ": "Decimal", "FLOAT8": "float", "Boolean": "bool",
                  "VARCHAR(80)": "str", "CLOB": "str", "TIMESTAMP": "datetime", "time": "time", "uuid": "UUID", "": "bytes", "BLOB": "bytes",
                  "GEOMETRY": None}),
    ],
)
def test_contract_types(spark, dialect, pairs):
    found = column(spark, lambda c: types.contract_type(c, dialect), *pairs)
    assert [(r["type"], r["known"]) for r in found] == [("Any", False) if t is None else (t, True) for t in pairs.values()]


def test_web_types(spark):
    pairs = {"BIGINT": "bigint", "numeric(10,2)": "number", "bool": "boolean", " Varchar (9)": "string", "timestamptz": "string", "time": "string",
             "jsonb": "any", "bytea": "any", "timetz": "any", "int4": "any", "name": "any"}
    assert column(spark, types.web_type, *pairs) == list(pairs.values())


def test_class_names(spark, make):
    tables = make.columns([("a", "dbo", "user"), ("a", "audit", "user"), ("a", "sales", "fact_price"), ("b", "dbo", "user")])
    assert rows(K.resolve_class_names(tables), "target", "schema", "class_name") == [
        ("a", "audit", "AuditUser"), ("a", "dbo", "DboUser"), ("a", "sales", "FactPrice"), ("b", "dbo", "User"),
    ]
    assert rows(K.class_name_collisions(tables)) == []
    worse = tables.unionByName(make.columns([("a", "other", "dbo_user")]))
    assert rows(K.class_name_collisions(worse), "target", "class_name", "schema", "table", "error") == [
        ("a", "DboUser", "other", "dbo_user", 'class name "DboUser" of "other.dbo_user" is taken by "dbo.user"'),
    ]
    alike = make.columns([("a", "dbo", t) for t in ("a_b", "a-b", "a b")])
    assert rows(K.class_name_collisions(alike), "table") == [("a-b",), ("a_b",)]


def users(make):
    spec = [("id", "INTEGER", False), ("email", "TEXT", False), ("balance", "DECIMAL(10,2)", True), ("created_at", "TIMESTAMP", True),
            ("avatar", "BLOB", True), ("location", "GEOMETRY", True), ("class", "TEXT", True)]
    return make.columns([("a", "main", "users", i, n, t, null) for i, (n, t, null) in enumerate(spec, start=1)])


def test_contract_of_a_table(make):
    columns = users(make)
    contract = K.schema_contract(columns, "lite")
    found = contract.orderBy("ordinal").select("class_name", "field", "alias", "type", "nullable").collect()
    assert [tuple(r) for r in found] == [
        ("Users", "id", "id", "int", False), ("Users", "email", "email", "str", False), ("Users", "balance", "balance", "Decimal", True),
        ("Users", "created_at", "created_at", "datetime", True), ("Users", "avatar", "avatar", "bytes", True),
        ("Users", "location", "location", "Any", True), ("Users", "class_", "class", "str", True),
    ]
    assert rows(K.unmapped_types(columns, "lite")) == [("a", "main.users.location: GEOMETRY")]
    needs = K.contract_needs(contract).first().asDict()
    assert needs == {"target": "a", "need_decimal": True, "need_datetime": True, "need_time": False, "need_uuid": False, "need_any": True,
                     "need_optional": True, "typing_imports": "Any, Optional"}
    table = K.nested_contract(contract).collect()
    assert [[f["field"] for f in t["fields"]] for t in table] == [["id", "email", "balance", "created_at", "avatar", "location", "class_"]]


def test_contract_changes(make):
    old = K.schema_contract(users(make), "lite")
    new = K.schema_contract(
        users(make).filter("column <> 'avatar'").withColumn("nullable", F.col("nullable") | (F.col("column") == "email"))
        .unionByName(make.columns([("a", "main", "users", 8, "extra", "TEXT", True)])), "lite")
    assert rows(K.contract_diff(old, new), "column", "change") == [("avatar", "removed"), ("email", "changed"), ("extra", "added")]
    assert rows(K.contract_stale(old, new)) == [("a", True)]
    assert rows(K.contract_stale(old, old)) == [("a", False)]
    assert rows(K.contract_stale(old, old.repartition(3).union(old))) == [("a", True)] and rows(K.contract_diff(old, old)) == []
    plan = K.contract_stale(old, new)._jdf.queryExecution().executedPlan().toString()
    assert "FullOuter" not in plan


def fields(spark, definition):
    df = spark.createDataFrame([("a", "s", "usp_load", definition)], "target string, schema string, name string, definition string")
    return [tuple(r) for r in K.json_contracts(df).orderBy("ordinal").select("column", "path", "data_type", "type").collect()]


def test_json_block_with_converts(spark):
    body = """CREATE PROCEDURE s.usp_load @p NVARCHAR(MAX) AS
    SELECT TRY_CONVERT(BIGINT, [key]) AS k, TRY_CONVERT(DECIMAL(19, 6), amount) AS a, TRY_CONVERT(DATE, COALESCE(at1, at2)) AS d
    FROM OPENJSON(@p) WITH (reporting NVARCHAR(50)) x
    CROSS APPLY OPENJSON ( @p )
    WITH (
        [key] NVARCHAR(20) '$.head.key',
        amount NVARCHAR(30),
        at1 DATETIME2(0) '$.at1',
        at2 NVARCHAR(40) '$.AT1',
        flag BIT '$.flag'
    );"""
    assert fields(spark, body) == [
        ("key", "$.head.key", "BIGINT", "int"),
        ("amount", "$.amount", "DECIMAL", "Decimal"),
        ("at1", "$.at1", "DATETIME2", "datetime"),
        ("flag", "$.flag", "BIT", "bool"),
    ]


def test_json_value_calls(spark):
    body = """SELECT TRY_CAST(JSON_VALUE(j.value, '$.id') AS INT) AS id, UPPER(RTRIM(JSON_VALUE(j.value, '$.code'))) AS code,
    JSON_VALUE(j.value, '$.note') AS BIGINT, """ + " " * 200 + """
    TRY_CAST(COALESCE(JSON_VALUE(j.value, '$.at'), JSON_VALUE(j.value, '$.At2')) AS DATETIME2(0)) AS d,
    """ + "é" * 120 + """ TRY_CONVERT(MONEY, JSON_VALUE(j.value, '$.CODE')) , TRY_CONVERT(MONEY, JSON_VALUE(j.value, '$.pay')) FROM OPENJSON(@p) AS j"""
    assert fields(spark, body) == [
        ("id", "$.id", "INT", "int"),
        ("code", "$.code", "NVARCHAR", "str"),
        ("note", "$.note", "BIGINT", "int"),
        ("at", "$.at", "DATETIME", "datetime"),
        ("At2", "$.At2", "DATETIME", "datetime"),
        ("pay", "$.pay", "MONEY", "Decimal"),
    ]


def test_no_json_input(spark):
    assert fields(spark, "CREATE PROCEDURE p AS SELECT 1") == []
    assert fields(spark, "SELECT JSON_VALUE(x, '$.a')") == []
    assert fields(spark, "SELECT 'OPENJSON(@x) WITH (a INT'") == []


def test_payloads_join_the_tables(spark, make):
    procs = make.procs([("a", "main", "usp_in", "FROM OPENJSON(@p) WITH (\n a INT\n)")])
    both = K.with_payloads(users(make), procs)
    assert rows(K.schema_contract(both, "ms").filter("table <> 'users'"), "table", "class_name", "field", "type") == [("in_payload", "InPayload", "a", "int")]


def test_many_json_calls_stay_linear(spark):
    import time

    def run(n):
        text = "select x from OPENJSON(@p);\n" + ",\n".join(f"cast(JSON_VALUE(@p, '$.f{i % 700}') as int)" for i in range(n))
        start = time.monotonic()
        found = fields(spark, text.replace("@p,", "p,"))
        return found, time.monotonic() - start

    run(10)
    few, short = run(1000)
    many, long = run(10000)
    assert many == few and len(many) == 700 and {f[3] for f in many} == {"int"}
    assert long < 40 * max(short, 0.25)


def test_blocks_within_blocks(spark):
    text = "OPENJSON(@a) WITH (\n a int,\n b int, /* OPENJSON(@b) WITH (\n c int) */\n d int\n) OPENJSON(@c) WITH (\n e int"
    assert [f[0] for f in fields(spark, text)] == ["a", "b", "c", "d"]


def test_blocks_against_a_stack(spark):
    """Texts of random pieces: each head's block ends where a stack of its own says."""
    import random
    import re

    from driftledger.functions import payload

    head = re.compile(r"OPENJSON\s*\(\s*@\w+\s*\)\s*WITH\s*\(", re.IGNORECASE | re.ASCII)

    def blocks(text):
        found = []
        for m in head.finditer(text):
            depth = 1
            for i in range(m.end(), len(text)):
                depth += {"(": 1, ")": -1}.get(text[i], 0)
                if not depth:
                    found.append(text[m.end() : i])
                    break
        return found

    random.seed(5)
    parts = ["(", ")", ")", "a", " ", "é😀", "OPENJSON(@p) WITH (", "openjson ( @q )\nwith(", "OPENJSON(", "WITH (", "\n x INT"]
    texts = ["", "))((", "OPENJSON(@p) WITH ()"] + ["".join(random.choices(parts, k=random.randrange(60))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string")
    got = {r.i: r.b for r in df.select("i", payload._blocks(df.t).alias("b")).collect()}
    assert not got.pop(-1)
    assert got == {i: blocks(t) for i, t in enumerate(texts)}


def test_heads_that_never_close_stay_linear(spark):
    import time

    def run(n):
        start = time.monotonic()
        found = fields(spark, "OPENJSON(@p) WITH (\n a int,\n" * n + "OPENJSON(@p) WITH (\n b int,\n c bit)")
        assert [f[0] for f in found] == ["b", "c"]
        return time.monotonic() - start

    run(10)
    short, long = min(run(1000), run(1000)), min(run(10000), run(10000))
    assert long < 20 * max(short, 0.25)
