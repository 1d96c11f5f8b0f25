"""Queries on types, names and schema contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftledger.functions import naming, types
from driftledger.plans import contract as K
from driftledger.workload.registry import query

_PG = """CASE
    WHEN lower(data_type) IN ('smallint','integer','bigint','int2','int4','int8','smallserial','serial','bigserial') THEN 'int'
    WHEN lower(data_type) IN ('real','double precision','float4','float8') THEN 'float'
    WHEN lower(data_type) IN ('numeric','decimal','money') THEN 'Decimal'
    WHEN lower(data_type) IN ('boolean','bool') THEN 'bool'
    WHEN lower(data_type) IN ('character','character varying','char','varchar','text','citext','name') THEN 'str'
    WHEN lower(data_type) IN ('date','timestamp','timestamp without time zone','timestamp with time zone','timestamptz') THEN 'datetime'
    WHEN lower(data_type) IN ('time','time without time zone','time with time zone','timetz') THEN 'time'
    WHEN lower(data_type) = 'uuid' THEN 'UUID' WHEN lower(data_type) = 'bytea' THEN 'bytes'
    WHEN lower(data_type) IN ('json','jsonb') THEN 'Any' END"""
_MS = """CASE
    WHEN lower(data_type) IN ('bigint','int','smallint','tinyint') THEN 'int'
    WHEN lower(data_type) IN ('float','real') THEN 'float'
    WHEN lower(data_type) IN ('decimal','numeric','money','smallmoney') THEN 'Decimal'
    WHEN lower(data_type) = 'bit' THEN 'bool'
    WHEN lower(data_type) IN ('char','varchar','nchar','nvarchar','text','ntext') THEN 'str'
    WHEN lower(data_type) IN ('date','datetime','datetime2','smalldatetime','datetimeoffset') THEN 'datetime'
    WHEN lower(data_type) = 'time' THEN 'time' WHEN lower(data_type) = 'uniqueidentifier' THEN 'UUID'
    WHEN lower(data_type) IN ('varbinary','binary','image') THEN 'bytes' END"""
_BASE = "trim(split_part(lower(trim(data_type)), '(', 1))"
_LITE = f"""CASE
    WHEN {_BASE} = '' THEN 'bytes' WHEN {_BASE} IN ('boolean','bool') THEN 'bool' WHEN {_BASE} LIKE '%int%' THEN 'int'
    WHEN {_BASE} IN ('datetime','timestamp','date') THEN 'datetime' WHEN {_BASE} = 'time' THEN 'time'
    WHEN {_BASE} IN ('numeric','decimal','money') THEN 'Decimal'
    WHEN {_BASE} LIKE '%real%' OR {_BASE} LIKE '%floa%' OR {_BASE} LIKE '%doub%' THEN 'float' WHEN {_BASE} = 'uuid' THEN 'UUID'
    WHEN {_BASE} LIKE '%char%' OR {_BASE} LIKE '%clob%' OR {_BASE} LIKE '%text%' THEN 'str' WHEN {_BASE} LIKE '%blob%' THEN 'bytes' END"""
_WEB = f"""CASE
    WHEN {_BASE} IN ('bigint','int8','bigserial') THEN 'bigint'
    WHEN {_BASE} IN ('int','smallint','tinyint','integer','serial','smallserial','float','real','double precision','double',
                     'decimal','numeric','money','smallmoney') THEN 'number'
    WHEN {_BASE} IN ('bit','boolean','bool') THEN 'boolean'
    WHEN {_BASE} IN ('char','varchar','character','character varying','nchar','nvarchar','text','ntext','citext','uuid','uniqueidentifier',
                     'date','datetime','datetime2','smalldatetime','datetimeoffset','timestamp','timestamptz','timestamp with time zone',
                     'timestamp without time zone','time') THEN 'string' ELSE 'any' END"""


def _typed(known: str) -> str:
    return f"""SELECT target, "column", data_type, coalesce({known}, 'Any') AS type, {known} IS NOT NULL AS known FROM columns_d"""


def _contract_types(t, dialect):
    kind = types.contract_type(F.col("data_type"), dialect)
    return t.columns_d.select("target", "column", "data_type", kind["type"].alias("type"), kind["known"].alias("known"))


@query(_typed(_PG))
def type_map_pg(t):
    return _contract_types(t, "pg")


@query(_typed(_MS))
def type_map_ms(t):
    return _contract_types(t, "ms")


@query(_typed(_LITE))
def type_map_lite(t):
    return _contract_types(t, "lite")


@query(f"""SELECT target, "column", trim(split_part(data_type, '(', 1)) AS base_type, {_WEB} AS web_type, {_WEB} AS validator FROM columns_d""")
def web_types(t):
    kind = F.col("data_type")
    return t.columns_d.select(
        "target",
        "column",
        types.base_type(kind).alias("base_type"),
        types.web_type(kind).alias("web_type"),
        types.web_validator(kind).alias("validator"),
    )


@query(f"""SELECT target, concat(schema, '.', "table", '.', "column", ': ', data_type) AS line FROM columns_d WHERE {_PG} IS NULL""")
def unmapped_types(t):
    return K.unmapped_types(t.columns_d, "pg")


def _pascal(x: str) -> str:
    words = f"list_filter(string_split_regex({x}, '[_\\- .]'), lambda w: w <> '')"
    joined = f"coalesce(array_to_string(list_transform({words}, lambda w: upper(w[1]) || lower(w[2:])), ''), '')"
    return f"CASE WHEN {joined} = '' THEN 'Empty' WHEN {joined} SIMILAR TO '[0-9].*' THEN '_' || {joined} ELSE {joined} END"


def _field(x: str) -> str:
    words = (
        "'False','None','True','and','as','assert','async','await','break','class','continue','def','del','elif','else','except',"
        "'finally','for','from','global','if','import','in','is','lambda','nonlocal','not','or','pass','raise','return','try',"
        "'while','with','yield'"
    )
    kept = f"regexp_replace({x}, '[^A-Za-z0-9_]', '', 'g')"
    return f"""CASE WHEN {x} IN ({words}) THEN concat({x}, '_') WHEN {kept} = '' THEN '_'
               WHEN {kept} SIMILAR TO '[0-9].*' THEN concat('_', {kept}) ELSE {kept} END"""


def _web_name(x: str) -> str:
    words = (
        "'break','case','catch','class','const','continue','debugger','default','delete','do','else','enum','export','extends','false',"
        "'finally','for','function','if','import','in','instanceof','new','null','return','super','switch','this','throw','true','try',"
        "'typeof','var','void','while','with','yield','let','static','await','async','implements','interface','package','private',"
        "'protected','public'"
    )
    return f"""CASE WHEN {x} IN ({words}) THEN concat({x}, '_') WHEN regexp_full_match({x}, '[A-Za-z_][A-Za-z0-9_]*') THEN {x}
               ELSE concat('"', {x}, '"') END"""


@query(f"""
    SELECT p_partkey, raw_name, {_pascal('raw_name')} AS pascal_case, {_field('raw_name')} AS safe_field, {_web_name('raw_name')} AS web_name
    FROM names_d""")
def names(t):
    raw = F.col("raw_name")
    return t.names_d.select(
        "p_partkey",
        "raw_name",
        naming.pascal_case(raw).alias("pascal_case"),
        naming.safe_field(raw).alias("safe_field"),
        naming.web_name(raw).alias("web_name"),
    )




def _classes(columns: str) -> str:
    return f"""SELECT target, schema, "table", CASE WHEN count(*) OVER (PARTITION BY target, plain) > 1
                      THEN concat(upper(schema[1]), lower(schema[2:]), plain) ELSE plain END AS class_name
               FROM (SELECT DISTINCT target, schema, "table", {_pascal('"table"')} AS plain FROM {columns})"""


_CLASSES = f"WITH classes AS ({_classes('columns_d')})"


@query(f"{_CLASSES} SELECT * FROM classes")
def class_names(t):
    return K.resolve_class_names(t.columns_d)


# A hyphen next to an underscore, and a table that has another's schema in its name, are what still collides.
_ALIKE = """SELECT target, schema, CASE WHEN ordinal % 3 = 0 THEN replace({q}table{q}, '_', '-')
                                        WHEN ordinal % 3 = 1 THEN concat(schema, ' ', {q}table{q}) ELSE {q}table{q} END AS {q}table{q}
            FROM columns_d"""


@query(f"""
    WITH alike AS ({_ALIKE.format(q='"')}), classes AS ({_classes('alike')}),
    owners AS (SELECT *, first_value((schema, "table")) OVER (PARTITION BY target, class_name ORDER BY schema, "table") AS owner FROM classes)
    SELECT target, class_name, schema, "table",
           concat('class name "', class_name, '" of "', schema, '.', "table", '" is taken by "', owner[1], '.', owner[2], '"') AS error
    FROM owners WHERE (schema, "table") <> owner""")
def class_name_collisions(t):
    return K.class_name_collisions(t.sql(_ALIKE.format(q="`")))


@query(f"""
    {_CLASSES}
    SELECT c.target, c.schema, c."table", k.class_name, c.ordinal, {_field('c."column"')} AS field, c."column" AS alias,
           coalesce({_PG}, 'Any') AS type, {_WEB} AS web_type, {_web_name('c."column"')} AS web_name, c.nullable
    FROM columns_d c JOIN classes k ON k.target = c.target AND k.schema = c.schema AND k."table" = c."table" """)
def schema_contract(t):
    return _contract(t).select(
        "target", "schema", "table", "class_name", "ordinal", "field", "alias", "type", "web_type", "web_name", "nullable"
    )


def _contract(t):
    return K.schema_contract(_full_columns(t.columns_d), "pg")


def _full_columns(columns):
    nothing = F.lit(None).cast("int")
    return columns.withColumns({"max_length": nothing, "precision": nothing, "scale": nothing})


@query(f"""
    {_CLASSES}
    SELECT target, schema, "table", class_name,
           string_agg(concat(ordinal, ' ', field, ':', type, CASE WHEN nullable THEN '?' ELSE '' END), ', ' ORDER BY ordinal) AS fields
    FROM (SELECT c.*, k.class_name, {_field('c."column"')} AS field, coalesce({_PG}, 'Any') AS type
          FROM columns_d c JOIN classes k ON k.target = c.target AND k.schema = c.schema AND k."table" = c."table")
    GROUP BY ALL""")
def nested_contract(t):
    nested = K.nested_contract(_contract(t))
    mark = lambda f: F.when(f["nullable"], "?").otherwise("")
    line = lambda f: F.concat(f["ordinal"].cast("string"), F.lit(" "), f["field"], F.lit(":"), f["type"], mark(f))
    return nested.withColumn("fields", F.array_join(F.transform("fields", line), ", "))


@query(f"""
    SELECT target, bool_or(type = 'Decimal') AS need_decimal, bool_or(type = 'datetime') AS need_datetime, bool_or(type = 'time') AS need_time,
           bool_or(type = 'UUID') AS need_uuid, bool_or(type = 'Any') AS need_any, bool_or(nullable) AS need_optional,
           concat_ws(', ', CASE WHEN bool_or(type = 'Any') THEN 'Any' END, CASE WHEN bool_or(nullable) THEN 'Optional' END) AS typing_imports
    FROM (SELECT *, coalesce({_PG}, 'Any') AS type FROM columns_d) GROUP BY target""")
def contract_needs(t):
    return K.contract_needs(_contract(t))


_OLD = """SELECT target, schema, {q}table{q}, ordinal, {q}column{q},
    CASE WHEN ordinal % 10 = 0 THEN 'uuid' ELSE data_type END AS data_type, CASE WHEN ordinal % 15 = 0 THEN NOT nullable ELSE nullable END AS nullable
    FROM columns_d WHERE ordinal % 7 <> 0 UNION ALL
    SELECT target, schema, {q}table{q}, ordinal + 1000, concat({q}column{q}, '_old'), data_type, nullable FROM columns_d WHERE ordinal % 11 = 0"""


def _stored(t):
    return K.schema_contract(_full_columns(t.sql(_OLD.format(q="`"))), "pg")


_SIDES = f"""
    old AS ({_OLD.format(q='"')}),
    stored AS (SELECT *, coalesce({_PG}, 'Any') AS type, {_WEB} AS web FROM old JOIN ({_classes('old')}) USING (target, schema, "table")),
    live AS (SELECT *, coalesce({_PG}, 'Any') AS type, {_WEB} AS web FROM columns_d JOIN ({_classes('columns_d')}) USING (target, schema, "table")),
    changes AS (
        SELECT coalesce(s.target, l.target) AS target, coalesce(s.schema, l.schema) AS schema, coalesce(s."table", l."table") AS "table",
               coalesce(s."column", l."column") AS "column",
               CASE WHEN s.target IS NULL THEN 'added' WHEN l.target IS NULL THEN 'removed'
                    WHEN s.class_name <> l.class_name OR s.type <> l.type OR s.web <> l.web OR s.nullable <> l.nullable OR s.ordinal <> l.ordinal THEN 'changed' END AS change
        FROM stored s FULL JOIN live l ON s.target = l.target AND s.schema = l.schema AND s."table" = l."table" AND s."column" = l."column")"""


@query(f"WITH {_SIDES.strip()} SELECT * FROM changes WHERE change IS NOT NULL")
def contract_diff(t):
    # A field also changes when its table's class name does, as that depends on the target's other tables.
    return K.contract_diff(_stored(t), _contract(t)).drop("stored", "live")


@query(f"WITH {_SIDES.strip()} SELECT target, count(change) > 0 AS stale FROM changes GROUP BY target")
def contract_stale(t):
    return K.contract_stale(_stored(t), _contract(t))


@query("""
    SELECT target, schema, concat(CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'sp_' END, 'load_', p_partkey, '_payload') AS "table",
           cast(f.n AS int) AS ordinal, f.name AS "column", f.path, f.sql_type AS data_type, f.type, true AS nullable
    FROM procs_d p JOIN part USING (p_partkey), LATERAL (
        SELECT * FROM (VALUES (0, 1, concat('qty', p_size), concat('$.order.qty', p_size), 'BIGINT', 'int'),
                              (0, 2, 'price', '$.price', 'DECIMAL', 'Decimal'), (0, 3, 'doc', '$.doc', 'VARBINARY', 'bytes'),
                              (1, 1, concat('a', p_size), concat('$.a', p_size), 'INT', 'int'), (1, 2, 'b', '$.x.b', 'NVARCHAR', 'str')
                      ) v(k, n, name, path, sql_type, type) WHERE v.k = p_partkey % 4) f""")
def json_contracts(t):
    return K.json_contracts(t.procs_d)
