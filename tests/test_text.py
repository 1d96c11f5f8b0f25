import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from driftledger.functions import ddl, text
from driftledger.functions.ddl import created, dropped, executable_text
from driftledger.functions.masking import heads_one, mask_one, mask_text


def apply(spark, function, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").coalesce(1)
    return [r[0] for r in df.select(function(F.col("v")).alias("r"), "i").orderBy("i").select("r").collect()]


MASKED = [
    ("body in dollars", "x $$ drop table a; $$ y", "x " + " " * 19 + " y"),
    ("tagged body", "x $t_1$ a $$ b $t_1$ y", "x " + " " * 18 + " y"),
    ("digit is no tag start", "x $1$ a", "x $1$ a"),
    ("open body hides the rest", "x $$ a\nb", "x " + " " * 4 + "\n "),
    ("dollars in a string", "f('$$')\ng $$", "f(    )\ng   "),
    ("line comment", "-- a 'b\nc", " " * 7 + "\nc"),
    ("block comment", "/* a\nb */ c", "    \n     c"),
    ("nested block comment", "/* a /* b */ c */ d", " " * 17 + " d"),
    ("open block comment", "a /* b /* c */", "a " + " " * 12),
    ("doubled quote", "f('a''b') c", "f(" + " " * 6 + ") c"),
    ("escaped quote", r"f(E'a\'b') c", "f(" + " " * 7 + ") c"),
    ("backslash is plain in a plain string", r"f('a\') c", "f(" + " " * 4 + ") c"),
    ("quoted name stays", '"it\'s -- a" b', '"it\'s -- a" b'),
    ("open quoted name", 'a "b\' c', 'a "b\' c'),
    ("bytes, not characters", "'é' a", "     a"[:4] + " a"),
]


@pytest.mark.parametrize("name,given,expected", MASKED, ids=[m[0] for m in MASKED])
def test_mask(name, given, expected):
    assert mask_one(given.encode()) == expected.encode()


def test_mask_in_spark(spark):
    given = [m[1] for m in MASKED] + ["create table plain (id int);", "", None]
    expected = [m[2] for m in MASKED] + ["create table plain (id int);", "", None]
    assert apply(spark, mask_text, *given) == expected


def _mask_bytes(source: str) -> str:
    """The lexer rules once more, byte by byte."""
    src = source.encode()
    out, i, n = bytearray(src), 0, len(src)

    def hide(start, end):
        for k in range(start, min(end, n)):
            out[k] = src[k] if src[k] == 10 else 32
        return min(end, n)

    def string_end(j, quote, escapes=False):
        while j < n:
            if escapes and src[j] == 92:
                j += 2
            elif src[j] != quote:
                j += 1
            elif src[j + 1 : j + 2] == bytes([quote]):
                j += 2
            else:
                return j + 1
        return n

    while i < n:
        rest = src[i:]
        if rest.startswith(b"--"):
            found = src.find(b"\n", i)
            i = hide(i, n if found < 0 else found)
        elif rest.startswith(b"/*"):
            depth, j = 1, i + 2
            while j < n and depth:
                step = {b"/*": 1, b"*/": -1}.get(src[j : j + 2], 0)
                depth, j = depth + step, j + (2 if step else 1)
            i = hide(i, j)
        elif rest[:1] == b"'" or (rest[:1] in (b"e", b"E") and rest[1:2] == b"'"):
            escapes = rest[:1] != b"'"
            i = hide(i, string_end(i + 1 + escapes, 39, escapes))
        elif rest[:1] == b'"':
            i = string_end(i + 1, 34)
        elif rest[:1] == b"$":
            j = i + 1
            while j < n and (chr(src[j]) == "_" or chr(src[j]).isascii() and chr(src[j]).isalpha() or (j > i + 1 and 48 <= src[j] <= 57)):
                j += 1
            if src[j : j + 1] == b"$":
                found = src.find(src[i : j + 1], j + 1)
                i = hide(i, n if found < 0 else found + j + 1 - i)
            else:
                i += 1
        else:
            i += 1
    return out.decode()


def test_mask_against_byte_wise_replay():
    rng = random.Random(7)
    parts = ["'", '"', "$", "a", "E", "e", "\\", "-", "--", "/*", "*/", "*", "/", "\n", " ", "é", "$x$", "$$", "1"]
    for _ in range(20000):
        given = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        assert mask_one(given.encode()).decode() == _mask_bytes(given), given


def test_heads_hold_what_the_masked_text_does(spark):
    rng = random.Random(11)
    parts = ["CREATE", "create", "Drop", "TABLE", "view", "IF NOT EXISTS", "if exists", "OR REPLACE", "MATERIALIZED", "temp", "a", '"B"', "app.", '"s".', "x1", "(", ");", ";", "'", "--", "/*", "*/", "$$", "é",
             "\n", "\n", "\n", " ", " ", "\t", "\r\n", "\n\n  ", *["\nCREATE TABLE", "\n  create view app.", "\nDROP\nTABLE ", "\ndrop view if exists"] * 3]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["-- x\n" + "CREATE TABLE\n" * 3 + "y", "/**/ CREATE OR REPLACE\nMATERIALIZED\n\nVIEW IF\nNOT EXISTS\n s.n ( )", "--\ncreate table;\ncreate view v", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, body string")
    masked, heads = mask_text(F.col("body")), executable_text(F.col("body"), "pg")
    found = df.select("i", created(masked, "pg").alias("c"), created(heads, "pg").alias("ch"), dropped(masked, "pg").alias("d"), dropped(heads, "pg").alias("dh")).collect()
    assert all(r.c == r.ch and r.d == r.dh for r in found), [texts[r.i] for r in found if r.c != r.ch or r.d != r.dh][:3]
    assert sum(bool(r.c) for r in found) > 300 and sum(bool(r.d) for r in found) > 200


def test_scan_is_linear():
    import time

    def seconds(n):
        began = time.perf_counter()
        heads_one(b"/*" + b"x\n" * n + b"*/\n CREATE TABLE a (b int);" + b"'" + b"\n" * n + b"'")
        return time.perf_counter() - began

    assert heads_one(b"/* CREATE TABLE no */\n create  table\n a (b int); '\nDROP TABLE x'") == b"create table\na ;\n"
    assert seconds(400_000) < 1


def test_scripts_that_are_not_utf8(spark):
    body = b"-- caf\xe9 \xff\nCREATE TABLE a (x text default 'ol\xe9');\n/* \xfe */ DROP VIEW b;\n$q$ CREATE TABLE no \x80 $q$\nCREATE VIEW \"c\" AS SELECT 1"
    assert mask_one(b"'\xe9\n\xff' \xe9") == b"  \n   \xe9"
    df = spark.createDataFrame([(bytearray(body),)], "b binary").select(F.col("b").cast("string").alias("body"))
    text = executable_text(F.col("body"), "pg")
    row = df.select(created(text, "pg").alias("c"), dropped(text, "pg").alias("d")).first()
    assert [(o.name, o.kind) for o in row.c] == [("a", "table"), ("c", "view")] and [o.name for o in row.d] == ["b"]


def objects(spark, extract, dialect, body):
    df = spark.createDataFrame([(body,)], "body string")
    found = df.select(F.posexplode(extract(ddl.executable_text(F.col("body"), dialect), dialect)).alias("pos", "o"))
    return [tuple(r) for r in found.orderBy("pos").select("o.schema", "o.name", "o.kind").collect()]


def test_pg_created(spark):
    body = """
        create table if not exists accounts (id bigint);
        CREATE UNLOGGED TABLE app."Ledger" (id int);
        Create Or Replace View v1 AS select 1;
        CREATE MATERIALIZED VIEW app.mv AS select 1;
        CREATE FUNCTION touch() RETURNS trigger AS $f$
        CREATE TABLE hidden (id int);
        $f$ LANGUAGE plpgsql;
        /* CREATE TABLE off (id int); */ CREATE PROCEDURE p() AS $$ CREATE TABLE nope (); $$;
        CREATE INDEX i ON accounts (id); ALTER TABLE accounts ADD x int;
        select 1; CREATE TABLE same_line (id int);
    """
    assert objects(spark, ddl.created, "pg", body) == [
        ("public", "accounts", "table"),
        ("app", "Ledger", "table"),
        ("public", "v1", "view"),
        ("app", "mv", "view"),
        ("public", "touch", "function"),
        ("public", "p", "procedure"),
    ]


def test_pg_dropped(spark):
    body = "DROP TABLE IF EXISTS a;\n drop materialized view s.b;\nDROP INDEX i;\nDROP FUNCTION IF EXISTS s.\"F\";\n-- DROP TABLE no;"
    assert objects(spark, ddl.dropped, "pg", body) == [("public", "a", "table"), ("s", "b", "view"), ("s", "F", "function")]


def test_ms(spark):
    body = """CREATE TABLE [app].[orders] (id int);
GO
CREATE OR ALTER PROCEDURE app.usp_load AS SELECT 1;
GO
create proc load2 as select 1;
GO
/*
CREATE VIEW in_comment AS SELECT 1
*/
ALTER TABLE app.orders ADD x int;
CREATE NONCLUSTERED INDEX ix ON app.orders (id);"""
    assert objects(spark, ddl.created, "ms", body) == [
        ("app", "orders", "table"),
        ("app", "usp_load", "procedure"),
        ("dbo", "load2", "procedure"),
        ("dbo", "in_comment", "view"),
    ]
    guarded = "IF OBJECT_ID('x') IS NOT NULL DROP TABLE x;\nIF OBJECT_ID('y') IS NOT NULL\n    DROP TABLE [dbo].[y];\nDROP TABLE IF EXISTS z;"
    # The one-line guard is not at a line start; IF EXISTS is not part of this dialect's pattern.
    assert objects(spark, ddl.dropped, "ms", guarded) == [("dbo", "y", "table"), ("dbo", "IF", "table")]


def test_lite(spark):
    body = 'CREATE TABLE IF NOT EXISTS "orders" (id);\nCREATE TEMP TABLE scratch (x);\nCREATE VIEW main.v AS SELECT 1;\nCREATE TRIGGER t AFTER INSERT ON o BEGIN SELECT 1; END;\nCREATE FUNCTION f;'
    assert objects(spark, ddl.created, "lite", body) == [
        ("main", "orders", "table"),
        ("main", "scratch", "table"),
        ("main", "v", "view"),
    ]
    assert objects(spark, ddl.dropped, "lite", "DROP TABLE IF EXISTS a;\nDROP VIEW b;\nDROP INDEX c;") == [
        ("main", "a", "table"),
        ("main", "b", "view"),
    ]


def test_only_newline_starts_a_line(spark):
    assert objects(spark, ddl.created, "lite", "select 1;\rCREATE TABLE a (x);") == []
    assert objects(spark, ddl.created, "lite", "select 1;\r\nCREATE TABLE a (x);") == [("main", "a", "table")]


@pytest.mark.parametrize(
    "name,version,direction",
    [
        ("20260101000000_add.up.sql", 20260101000000, "up"),
        ("007_a b.down.sql", 7, "down"),
        ("7_.up.sql", None, None),
        ("7_a.up.sql.bak", None, None),
        ("x7_a.up.sql", None, None),
        ("18446744073709551615_a.up.sql", 18446744073709551615, "up"),
        ("18446744073709551616_a.up.sql", None, "up"),
        ("99999999999999999999999999999999999999999_a.up.sql", None, "up"),
        ("1_a.up.sql.down.sql", 1, "down"),
    ],
)
def test_script_names(spark, name, version, direction):
    row = spark.createDataFrame([(name,)], "v string").select(text.parse_script_name(F.col("v")).alias("n")).first()["n"]
    assert (None if row["version"] is None else int(row["version"]), row["direction"]) == (version, direction)


def test_batches(spark):
    given = "a\nGO\nb\n  go \t\n\nGO\nGONE\nGO"
    assert apply(spark, text.batches, given, "one", " \n", "GO") == [["a", "b", "GONE"], ["one"], [], []]


def test_split_batches_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "a\nGO\nb"), (2, "GO")], "id int, body string")
    assert rows(text.split_batches(df, "body")) == [(1, 0, "a"), (1, 1, "b")]


def test_hash_blank_and_names(spark):
    assert apply(spark, text.content_hash, "") == ["e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"]
    assert apply(spark, text.is_blank, "", " \t\n  ", " x ") == [True, True, False]
    name = lambda c: text.script_name(F.lit(20260115100000), c)
    assert apply(spark, name, " add two things\n") == ["20260115100000_add_two_things.up.sql"]
