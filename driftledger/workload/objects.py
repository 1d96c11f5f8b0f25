"""Queries on created, dropped and existing objects."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftledger.operators import objects as J
from driftledger.operators import scripts as S
from driftledger.sources import catalog
from driftledger.workload import oracle_sql as O
from driftledger.workload.registry import query


@query(O.objects(O.CREATE, "pg"))
def created_objects_pg(t):
    return S.created_objects(t.corpus_d, "pg")


@query(O.objects(O.CREATE, "ms"))
def created_objects_ms(t):
    return S.created_objects(t.corpus_d, "ms")


@query(O.objects(O.CREATE, "lite"))
def created_objects_lite(t):
    return S.created_objects(t.corpus_d, "lite")


@query(O.objects(O.DROP, "pg"))
def dropped_objects_pg(t):
    return S.dropped_objects(t.corpus_d, "pg")


@query(O.objects(O.DROP, "ms"))
def dropped_objects_ms(t):
    return S.dropped_objects(t.corpus_d, "ms")


@query(O.objects(O.DROP, "lite"))
def dropped_objects_lite(t):
    return S.dropped_objects(t.corpus_d, "lite")


@query(f"""
    WITH creates AS ({O.objects(O.CREATE, "pg")}), drops AS ({O.objects(O.DROP, "pg")}),
    both_kinds AS (SELECT target, schema, name, kind, version AS c, NULL AS d FROM creates
                   UNION ALL SELECT target, schema, name, kind, NULL, version FROM drops)
    SELECT target, schema, name, kind, max(c) AS last_create, max(d) AS last_drop,
           CASE WHEN max(d) > coalesce(max(c), -1) THEN max(d) END AS gone_at
    FROM both_kinds GROUP BY target, schema, name, kind""")
def drop_lifecycle(t):
    return J.drop_lifecycle(S.created_objects(t.corpus_d, "pg"), S.dropped_objects(t.corpus_d, "pg"))


_SAME = "o.target = c.target AND o.schema = c.schema AND o.name = c.name AND o.kind = c.kind"


@query(f"""
    WITH c AS ({O.objects(O.CREATE, "pg")})
    SELECT c.*, EXISTS (SELECT 1 FROM objects_d o WHERE {_SAME}) AS "exists" FROM c""")
def object_existence(t):
    return J.object_exists(S.created_objects(t.corpus_d, "pg"), t.objects_d)


@query(f"""
    WITH c AS ({O.objects(O.CREATE, "lite")})
    SELECT c.*, EXISTS (SELECT 1 FROM objects_d o WHERE o.target = c.target AND o.name = c.name AND o.kind = c.kind) AS "exists"
    FROM c""")
def object_existence_by_name(t):
    return J.object_exists(S.created_objects(t.corpus_d, "lite"), t.objects_d, ignore_schema=True)


@query(f"""
    WITH c AS ({O.objects(O.CREATE, "pg")})
    SELECT c.* FROM c JOIN ledger_d l USING (target, version)
    WHERE l.status = 'applied' AND NOT EXISTS (SELECT 1 FROM objects_d o WHERE {_SAME})""")
def missing_objects(t):
    applied = t.ledger_d.filter("status = 'applied'").select("target", "version")
    claims = S.created_objects(t.corpus_d, "pg").join(applied, ["target", "version"])
    return J.missing_objects(claims, t.objects_d)


@query(f"""
    WITH c AS ({O.objects(O.CREATE, "pg")})
    SELECT c.* FROM c JOIN ledger_d l USING (target, version)
    WHERE l.status = 'reverted' AND EXISTS (SELECT 1 FROM objects_d o WHERE {_SAME})""")
def leftover_objects(t):
    reverted = t.ledger_d.filter("status = 'reverted'").select("target", "version")
    claims = S.created_objects(t.corpus_d, "pg").join(reverted, ["target", "version"])
    return J.leftover_objects(claims, t.objects_d)


# Catalog snapshots made from orders (objects) and customers (schemas).
_RELATIONS = """SELECT cast(o_custkey % 50 AS {0}) AS target, concat('r', cast(o_orderkey AS {0})) AS name, o_custkey % 3 AS schema_id,
    CASE o_orderkey % 6 WHEN 0 THEN 'r' WHEN 1 THEN 'p' WHEN 2 THEN 'v' WHEN 3 THEN 'm' WHEN 4 THEN 'i' ELSE 'S' END AS code FROM @orders"""
_ROUTINES = """SELECT cast(o_custkey % 50 AS {0}) AS target, concat('f', cast(o_orderkey AS {0})) AS name, o_custkey % 3 AS schema_id,
    CASE o_orderkey % 4 WHEN 0 THEN 'f' WHEN 1 THEN 'w' WHEN 2 THEN 'p' ELSE 'a' END AS code FROM @orders"""
_SCHEMAS = """SELECT DISTINCT cast(c_custkey % 50 AS {0}) AS target, c_custkey % 3 AS schema_id, concat('ns', cast(c_custkey % 3 AS {0})) AS schema FROM @customer"""
_MS_OBJECTS = """SELECT cast(o_custkey % 50 AS {0}) AS target, o_orderkey AS object_id, concat('o', cast(o_orderkey AS {0})) AS name, o_custkey % 3 AS schema_id,
    CASE o_orderkey % 11 WHEN 0 THEN 'U ' WHEN 1 THEN 'P ' WHEN 2 THEN 'PC' WHEN 3 THEN 'V ' WHEN 4 THEN 'FN' WHEN 5 THEN 'IF'
         WHEN 6 THEN 'TF' WHEN 7 THEN 'FS' WHEN 8 THEN 'FT' WHEN 9 THEN 'TR' ELSE 'PK' END AS code FROM @orders"""


@query(f"""
    SELECT r.target, s.schema, r.name, r.kind FROM (
        SELECT target, name, schema_id, CASE WHEN code IN ('r', 'p') THEN 'table' WHEN code IN ('v', 'm') THEN 'view' END AS kind
        FROM ({_RELATIONS.format('varchar')})
        UNION ALL
        SELECT target, name, schema_id, CASE WHEN code IN ('f', 'w') THEN 'function' WHEN code = 'p' THEN 'procedure' END
        FROM ({_ROUTINES.format('varchar')})) r
    JOIN ({_SCHEMAS.format('varchar')}) s ON s.target = r.target AND s.schema_id = r.schema_id WHERE r.kind IS NOT NULL""")
def pg_catalog_objects(t):
    relations = t.sql(_RELATIONS.format("string")).toDF("target", "relname", "relnamespace", "relkind")
    routines = t.sql(_ROUTINES.format("string")).toDF("target", "proname", "pronamespace", "prokind")
    namespaces = t.sql(_SCHEMAS.format("string")).toDF("target", "oid", "nspname")
    return catalog.pg_objects(relations, routines, namespaces)


@query(f"""
    SELECT o.target, s.schema, o.name,
           CASE trim(code) WHEN 'U' THEN 'table' WHEN 'V' THEN 'view' WHEN 'P' THEN 'procedure' WHEN 'PC' THEN 'procedure' ELSE 'function' END AS kind
    FROM ({_MS_OBJECTS.format('varchar')}) o JOIN ({_SCHEMAS.format('varchar')}) s ON s.target = o.target AND s.schema_id = o.schema_id
    WHERE code NOT IN ('TR', 'PK')""")
def ms_catalog_objects(t):
    objects = t.sql(_MS_OBJECTS.format("string")).withColumnRenamed("code", "type").drop("object_id")
    return catalog.ms_objects(objects, t.sql(_SCHEMAS.format("string")).withColumnRenamed("schema", "name"))


_MASTER = """SELECT cast(o_custkey % 50 AS {0}) AS target, concat('m', cast(o_orderkey AS {0})) AS name,
    CASE o_orderkey % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'view' WHEN 2 THEN 'index' ELSE 'trigger' END AS type FROM @orders"""


@query(f"SELECT target, 'main' AS schema, name, type AS kind FROM ({_MASTER.format('varchar')}) WHERE type IN ('table', 'view')")
def lite_catalog_objects(t):
    return catalog.lite_objects(t.sql(_MASTER.format("string")))


_PROC_TEXTS = "SELECT cast(o_custkey % 50 AS {0}) AS target, o_orderkey AS object_id, concat('BEGIN ', o_orderpriority, ' END') AS definition FROM @orders"


@query(f"""
    SELECT m.target, s.schema, o.name, m.definition
    FROM ({_PROC_TEXTS.format('varchar')}) m
    JOIN ({_MS_OBJECTS.format('varchar')}) o ON o.target = m.target AND o.object_id = m.object_id
    JOIN ({_SCHEMAS.format('varchar')}) s ON s.target = o.target AND s.schema_id = o.schema_id
    WHERE trim(o.code) = 'P'""")
def proc_bodies(t):
    objects = t.sql(_MS_OBJECTS.format("string")).withColumnRenamed("code", "type")
    objects = objects.join(t.sql(_SCHEMAS.format("string")), ["target", "schema_id"])
    return catalog.proc_bodies(t.sql(_PROC_TEXTS.format("string")), objects)


_TABLES = """SELECT DISTINCT target, schema, {q}table{q}, CASE WHEN (length(schema) + length({q}table{q})) % 3 = 0 THEN 'VIEW' ELSE 'BASE TABLE' END AS table_type
    FROM columns_d"""
_RAW_COLUMNS = """SELECT target, schema, {q}table{q}, ordinal, {q}column{q}, data_type, CASE WHEN nullable THEN 'yes' ELSE 'NO' END AS is_nullable FROM columns_d"""


@query(f"""
    SELECT c.target, c.schema, c."table", c.ordinal, c."column", c.data_type, c.is_nullable = 'yes' AS nullable
    FROM ({_RAW_COLUMNS.format(q='"')}) c JOIN ({_TABLES.format(q='"')}) t
      ON t.target = c.target AND t.schema = c.schema AND t."table" = c."table" WHERE t.table_type = 'BASE TABLE'""")
def table_columns(t):
    columns = catalog.table_columns(t.sql(_TABLES.format(q="`")), t.sql(_RAW_COLUMNS.format(q="`")), "pg")
    return columns.select("target", "schema", "table", "ordinal", "column", "data_type", "nullable")


@query(f"""
    SELECT c.target, c.schema, c."table", c.ordinal, c."column", c.data_type, c.is_nullable = 'yes' AS nullable
    FROM ({_RAW_COLUMNS.format(q='"')}) c JOIN ({_TABLES.format(q='"')}) t
      ON t.target = c.target AND t.schema = c.schema AND t."table" = c."table" WHERE t.table_type = 'BASE TABLE'""")
def table_columns_ms(t):
    columns = catalog.table_columns(t.sql(_TABLES.format(q="`")), t.sql(_RAW_COLUMNS.format(q="`")), "ms")
    return columns.select("target", "schema", "table", "ordinal", "column", "data_type", "nullable")


_LITE_TABLES = """SELECT DISTINCT target, 'main' AS schema, {q}table{q}, CASE WHEN length({q}table{q}) % 4 = 0 THEN 'VIEW' ELSE 'BASE TABLE' END AS table_type
    FROM (SELECT target, CASE WHEN schema = 's1' THEN concat('sqlite_', {q}table{q}) ELSE concat(schema, {q}table{q}) END AS {q}table{q} FROM columns_d) c"""
_LITE_COLUMNS = """SELECT target, CASE WHEN schema = 's1' THEN concat('sqlite_', {q}table{q}) ELSE concat(schema, {q}table{q}) END AS {q}table{q},
    ordinal, {q}column{q}, data_type, CASE WHEN nullable THEN 0 ELSE 1 END AS not_null, CASE WHEN ordinal % 50 = 1 THEN 1 ELSE 0 END AS pk FROM columns_d"""


@query(f"""
    SELECT c.target, 'main' AS schema, c."table", c.ordinal, c."column", c.data_type, c.not_null = 0 AND c.pk = 0 AS nullable
    FROM ({_LITE_COLUMNS.format(q='"')}) c JOIN ({_LITE_TABLES.format(q='"')}) t ON t.target = c.target AND t."table" = c."table"
    WHERE t.table_type = 'BASE TABLE' AND c."table" NOT LIKE 'sqlite%'""")
def table_columns_lite(t):
    columns = catalog.table_columns(t.sql(_LITE_TABLES.format(q="`")), t.sql(_LITE_COLUMNS.format(q="`")), "lite")
    return columns.select("target", "schema", "table", "ordinal", "column", "data_type", "nullable")


_ODD_KINDS = "SELECT target, version, schema, name, CASE WHEN version % 8 = 1 THEN 'sequence' WHEN version % 8 = 2 THEN NULL ELSE kind END AS kind FROM"


@query(f"""
    WITH c AS ({_ODD_KINDS} ({O.objects(O.CREATE, "pg")}))
    SELECT c.target, c.version, c.schema, c.name, c.kind,
           CASE WHEN kind IN ('table', 'view') THEN EXISTS (SELECT 1 FROM objects_d o WHERE {_SAME}) END AS "exists",
           CASE WHEN coalesce(kind, '') NOT IN ('table', 'view') THEN concat('unknown object kind "', coalesce(kind, ''), '"') END AS error
    FROM c""")
def unknown_kinds(t):
    """Claims with kinds that no dialect has: an error, where others exist or not."""
    claims = S.created_objects(t.corpus_d, "pg").selectExpr(*_ODD_KINDS.removeprefix("SELECT ").removesuffix(" FROM").split(", "))
    shown = J.object_exists(claims, t.objects_d).filter("exists IS NOT NULL").withColumn("error", F.lit(None).cast("string"))
    return shown.unionByName(J.unknown_kinds(claims).withColumn("exists", F.lit(None).cast("boolean")))


@query("""
    SELECT target, schema, "table", count(*) AS n_columns FROM columns_d
    WHERE lower("table") <> 'brand_2_0' AND lower(concat(schema, '.', "table")) <> 's1.brand_7_0' GROUP BY 1, 2, 3""")
def exclude_tables(t):
    kept = catalog.exclude_tables(t.columns_d, [" Brand_2_0", "S1.brand_7_0 "])
    return kept.groupBy("target", "schema", "table").agg(F.count(F.lit(1)).alias("n_columns"))
