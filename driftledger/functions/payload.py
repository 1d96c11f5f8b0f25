"""The JSON input contract of a stored procedure, read from its text.

A procedure declares its input either in ``OPENJSON(@x) WITH (...)`` blocks or by
``JSON_VALUE(x, '$.path')`` calls. Everything is an expression over the one
text column: blocks become arrays, the field rules are array functions, and no
row leaves the task that scanned it.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from driftledger.functions.text import WS
from driftledger.functions.types import base_type, contract_type

FIELD_ARRAY = "array<struct<path:string,name:string,sql_type:string>>"

# How types, columns, paths and calls are spelled.
_SIZE = rf"(?:\({WS}*\d+(?:{WS}*,{WS}*\d+)?{WS}*\))?"
_COLUMN = r"\[?([A-Za-z_][A-Za-z0-9_.]*)\]?"
_PATH = r"'(\$\.[A-Za-z0-9_.\[\]]+)'"
_OPEN_WITH = rf"(?i)OPENJSON{WS}*\({WS}*@\w+{WS}*\){WS}*WITH{WS}*\("
_DECLARED = rf"(?imd)^{WS}*{_COLUMN}{WS}+([A-Za-z0-9]+{_SIZE})(?:{WS}+{_PATH})?"
_CONVERT_TO = rf"(?i)TRY_CONVERT{WS}*\({WS}*([A-Za-z]+{_SIZE}){WS}*,"
_CONVERT = rf"{_CONVERT_TO}{WS}*{_COLUMN}{WS}*\)"
_AS_TYPE = rf"(?i)\bAS{WS}+([A-Za-z]+{_SIZE})"
_AS_TYPE_NEXT = rf"(?i)\A{WS}*\)*{WS}+AS{WS}+([A-Za-z]+{_SIZE})"
_CONTEXT = 150
_VALUE_CALL = rf"(?i)JSON_VALUE{WS}*\({WS}*[A-Za-z_][A-Za-z0-9_.]*{WS}*,{WS}*{_PATH}{WS}*\)"
# Calls that can lie within the context of another, as the shortest one has 19 characters.
_NEAR = _CONTEXT // 19 + 1
_DEFAULT_TYPE = "NVARCHAR"
_KNOWN_TYPES = (
    "BIGINT", "INT", "SMALLINT", "TINYINT", "BIT", "DECIMAL", "NUMERIC", "FLOAT", "REAL", "MONEY",
    "SMALLMONEY", "DATE", "DATETIME", "DATETIME2", "SMALLDATETIME", "DATETIMEOFFSET", "TIME", "NVARCHAR",
    "VARCHAR", "NCHAR", "CHAR", "VARBINARY", "BINARY", "UNIQUEIDENTIFIER",
)


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _opens(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^(]+", ""))


# Steps 1, 2, 4, ... of a running sum by doubling; the last is beyond the size of any array.
_DOUBLING = tuple(1 << k for k in range(31))


def running_sum(values: Column) -> Column:
    """Sum of each element of an array of numbers and all before it, in n log n steps: each round adds the element twice as far back."""
    steps = F.filter(F.array(*map(F.lit, _DOUBLING)), lambda s: s < F.size(values))
    return F.aggregate(steps, values, lambda sums, s: F.transform(sums, lambda v, i: v + F.coalesce(F.get(sums, i - s), F.lit(0))))


def closing_places(tokens: Column) -> Column:
    """``array<struct<place,end>>``: the token that closes the parenthesis a head opens, for each head that is closed, in order.

    ``tokens`` are texts with a parenthesis at the end or none, and heads, which open one more than they close. An opening at
    some depth is closed by the next parenthesis at that depth; sorted by depth and place, that one stands right behind it.
    """
    turn = F.transform(tokens, lambda t: F.when(t.endswith("("), 1).when(t.endswith(")"), -1).otherwise(0))

    def matched(c: Column) -> Column:
        marks = F.transform(c["turn"], lambda t, i: F.struct(
            (F.get(c["depth"], i) + (t < 0).cast("int")).alias("level"), i.alias("place"), t.alias("turn"),
        ))
        return F.array_sort(F.filter(marks, lambda m: m["turn"] != 0))

    def ends(marks: Column) -> Column:
        pairs = F.transform(marks, lambda m, j: F.struct(
            m["place"].alias("place"), F.when(F.get(marks, j + 1)["level"] == m["level"], F.get(marks, j + 1)["place"]).alias("end"), m["turn"].alias("turn"),
        ))
        heads = F.filter(pairs, lambda q: (q["turn"] > 0) & q["end"].isNotNull() & F.get(tokens, q["place"]).contains(")"))
        return F.array_sort(F.transform(heads, lambda q: F.struct(q["place"].alias("place"), q["end"].alias("end"))))

    depths = _let(turn, lambda t: F.struct(t.alias("turn"), running_sum(t).alias("depth")))
    return _let(_let(depths, matched), ends)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _fields(raw: Column) -> Column:
    """Finish fields given as (path, type): name from the path, base type; first spelling of a name wins."""

    def finish(f: Column) -> Column:
        name = F.substring_index(f["path"], ".", -1)
        sql_type = base_type(f["type"])
        return F.struct(f["path"].alias("path"), name.alias("name"), sql_type.alias("sql_type"), F.lower(name).alias("key"))

    def distinct(fields: Column) -> Column:
        return F.filter(fields, lambda f, i: (i == 0) | (F.get(fields, i - 1)["key"] != f["key"]))

    # Sorted by key and place, the first of equal keys is the one to keep; then back in the order of the text.
    placed = F.transform(F.transform(raw, finish), lambda f, i: F.struct(f["key"].alias("key"), i.alias("place"), f.alias("field")))
    kept = _let(F.array_sort(placed), distinct)
    ordered = F.array_sort(F.transform(kept, lambda f: F.struct(f["place"].alias("place"), f["field"].alias("field"))))
    return F.transform(
        ordered,
        lambda f: F.struct(f["field"]["path"].alias("path"), f["field"]["name"].alias("name"), f["field"]["sql_type"].alias("sql_type")),
    )


def _block_fields(block: Column, converts: Column) -> Column:
    """Fields of one block; ``converts`` are (key, type) of the convert calls on bare columns."""

    def parts(match: Column) -> Column:
        return F.struct(
            F.regexp_extract(match, _DECLARED, 1).alias("column"),
            F.regexp_extract(match, _DECLARED, 2).alias("type"),
            F.regexp_extract(match, _DECLARED, 3).alias("path"),
        )

    def declared(p: Column) -> Column:
        same = F.filter(converts, lambda c: c["key"] == F.lower(p["column"]))
        path = F.when(p["path"] == "", F.concat(F.lit("$."), p["column"])).otherwise(p["path"])
        return F.struct(
            path.alias("path"), F.coalesce(F.try_element_at(same, F.lit(-1))["type"], p["type"]).alias("type")
        )

    return _fields(F.transform(F.transform(_all(block, _DECLARED, 0), parts), declared))


def _blocks(definition: Column) -> Column:
    """The block behind each head that closes, in order. All parentheses of the text are matched at once, so heads that never
    close cost nothing; a block within another is a part of both."""
    cut = F.struct(F.split(definition, _OPEN_WITH, -1).alias("pieces"), _all(definition, _OPEN_WITH, 0).alias("heads"))

    def tokens(c: Column) -> Column:
        head = lambda i: F.when(i < F.size(c["heads"]), F.array(F.get(c["heads"], i))).otherwise(F.array().cast("array<string>"))
        return F.flatten(F.transform(c["pieces"], lambda p, i: F.concat(F.split(p, r"(?<=[()])", -1), head(i))))

    def texts(t: Column) -> Column:
        inside = lambda b: F.array_join(F.slice(t, b["place"] + 2, b["end"] - b["place"]), "")
        return F.transform(F.transform(closing_places(t), inside), lambda x: F.substring(x, F.lit(1), F.length(x) - 1))

    return _let(_let(cut, tokens), texts)


def _declared_fields(definition: Column) -> Column:
    converts = F.transform(
        _all(definition, _CONVERT, 0),
        lambda c: F.struct(
            F.lower(F.regexp_extract(c, _CONVERT, 2)).alias("key"), F.regexp_extract(c, _CONVERT, 1).alias("type")
        ),
    )
    blocks = _blocks(definition)

    def largest(c: Column) -> Column:
        return F.aggregate(
            F.transform(blocks, lambda b: _block_fields(b, c)),
            F.array().cast(FIELD_ARRAY),
            lambda best, fields: F.when(F.size(fields) > F.size(best), fields).otherwise(best),
        )

    return _let(converts, largest)


def _known(sql_type: Column) -> Column:
    """The base type when it is a known one, else NULL (also for no match)."""
    base = base_type(sql_type)
    return F.when(F.upper(base).isin(*_KNOWN_TYPES), base)


def value_type(before: Column, after: Column) -> Column:
    """Type of a JSON_VALUE call from the bytes around it."""
    behind_cast = F.substring_index(F.upper(before), "CAST(", -1)
    depth = 1 + _opens(behind_cast) - F.length(F.regexp_replace(behind_cast, r"[^)]+", ""))
    in_cast = F.upper(before).contains("CAST(") & (depth > 0)
    return F.coalesce(
        _known(F.regexp_extract(before, _CONVERT_TO, 1)),
        F.when(in_cast, _known(F.regexp_extract(after, _AS_TYPE, 1))),
        _known(F.regexp_extract(after, _AS_TYPE_NEXT, 1)),
        F.lit(_DEFAULT_TYPE),
    )


def _value_fields(definition: Column) -> Column:
    cut = F.struct(F.split(definition, _VALUE_CALL, -1).alias("pieces"), _all(definition, _VALUE_CALL, 0).alias("calls"))

    def field(c: Column, call: Column, i: Column) -> Column:
        at = lambda side, j: F.coalesce(F.get(c[side], j), F.lit(""))
        before = F.concat(*[at(side, i - k) for k in range(_NEAR, 0, -1) for side in ("pieces", "calls")], at("pieces", i))
        after = F.concat(at("pieces", i + 1), *[at(side, i + k + int(side == "pieces")) for k in range(1, _NEAR + 1) for side in ("calls", "pieces")])
        context = F.struct(
            F.substring(before.cast("binary"), -_CONTEXT, _CONTEXT).cast("string").alias("before"),
            F.substring(after.cast("binary"), 1, _CONTEXT).cast("string").alias("after"),
        )
        sql_type = _let(context, lambda x: value_type(x["before"], x["after"]))
        return F.struct(F.regexp_extract(call, _VALUE_CALL, 1).alias("path"), sql_type.alias("type"))

    return _fields(_let(cut, lambda c: F.transform(c["calls"], lambda call, i: field(c, call, i))))


def json_fields(definition: Column) -> Column:
    """``array<struct<path,name,sql_type>>`` of a procedure text; empty when it takes no JSON input."""
    by_block = _let(
        _declared_fields(definition),
        lambda fields: F.when(F.size(fields) > 0, fields).otherwise(_value_fields(definition)),
    )
    return F.when(definition.rlike("(?i)OPENJSON"), by_block).otherwise(F.array().cast(FIELD_ARRAY))


def field_contract_type(sql_type: Column) -> Column:
    return contract_type(sql_type, "ms")["type"]
