"""Database type names to contract types and to web types."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from driftledger.functions.text import trim_space

# Contract type -> type names, lower case.
PG_TYPES = {
    "int": ("smallint", "integer", "bigint", "int2", "int4", "int8", "smallserial", "serial", "bigserial"),
    "float": ("real", "double precision", "float4", "float8"),
    "Decimal": ("numeric", "decimal", "money"),
    "bool": ("boolean", "bool"),
    "str": ("character", "character varying", "char", "varchar", "text", "citext", "name"),
    "datetime": ("date", "timestamp", "timestamp without time zone", "timestamp with time zone", "timestamptz"),
    "time": ("time", "time without time zone", "time with time zone", "timetz"),
    "UUID": ("uuid",),
    "bytes": ("bytea",),
    "Any": ("json", "jsonb"),
}
MS_TYPES = {
    "int": ("bigint", "int", "smallint", "tinyint"),
    "float": ("float", "real"),
    "Decimal": ("decimal", "numeric", "money", "smallmoney"),
    "bool": ("bit",),
    "str": ("char", "varchar", "nchar", "nvarchar", "text", "ntext"),
    "datetime": ("date", "datetime", "datetime2", "smalldatetime", "datetimeoffset"),
    "time": ("time",),
    "UUID": ("uniqueidentifier",),
    "bytes": ("varbinary", "binary", "image"),
}
# Web type -> base type names; every other type is "any".
WEB_TYPES = {
    "bigint": ("bigint", "int8", "bigserial"),
    "number": (
        "int", "smallint", "tinyint", "integer", "serial", "smallserial", "float", "real", "double precision",
        "double", "decimal", "numeric", "money", "smallmoney",
    ),
    "boolean": ("bit", "boolean", "bool"),
    "string": (
        "char", "varchar", "character", "character varying", "nchar", "nvarchar", "text", "ntext", "citext",
        "uuid", "uniqueidentifier", "date", "datetime", "datetime2", "smalldatetime", "datetimeoffset",
        "timestamp", "timestamptz", "timestamp with time zone", "timestamp without time zone", "time",
    ),
}


def _look_up(name: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """NULL when no row of the table lists the name. The table is one constant, the name is evaluated once."""
    pairs = [(name, kind) for kind, names in table.items() for name in names]
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs)]), name)


def base_type(data_type: Column) -> Column:
    """The type name without its ``(...)`` part."""
    return trim_space(F.substring_index(data_type, "(", 1))


def _lite_type(data_type: Column) -> Column:
    name = base_type(F.lower(trim_space(F.coalesce(data_type, F.lit("")))))
    # One-element array: the rules below share one evaluation of the name.
    return F.get(F.transform(F.array(name), _lite_rules), F.lit(0))


def _lite_rules(name: Column) -> Column:
    def has(*parts: str) -> Column:
        found = F.lit(False)
        for part in parts:
            found = found | name.contains(part)
        return found

    return (
        F.when(name == "", "bytes")
        .when(name.isin("boolean", "bool"), "bool")
        .when(has("int"), "int")
        .when(name.isin("datetime", "timestamp", "date"), "datetime")
        .when(name == "time", "time")
        .when(name.isin("numeric", "decimal", "money"), "Decimal")
        .when(has("real", "floa", "doub"), "float")
        .when(name == "uuid", "UUID")
        .when(has("char", "clob", "text"), "str")
        .when(has("blob"), "bytes")
    )


def contract_type(data_type: Column, dialect: str) -> Column:
    """``struct<type string, known boolean>``; unknown types are "Any" with ``known`` false."""
    if dialect == "lite":
        found = _lite_type(data_type)
    else:
        found = _look_up(F.lower(data_type), PG_TYPES if dialect == "pg" else MS_TYPES)
    return F.struct(F.coalesce(found, F.lit("Any")).alias("type"), found.isNotNull().alias("known"))


def web_type(data_type: Column) -> Column:
    return F.coalesce(_look_up(base_type(F.lower(trim_space(data_type))), WEB_TYPES), F.lit("any"))


def web_validator(data_type: Column) -> Column:
    """Validator name for a web type; the names coincide with the web types."""
    return web_type(data_type)
