"""Object, column and procedure inventories.

The inputs are a database's catalog tables as DataFrames (read over JDBC or from a
stored snapshot), each with a ``target`` column, so that one job covers all targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftledger.schemas import COLUMNS, OBJECTS, PROCS, conform

# Catalog type code -> object kind.
PG_RELATION_KINDS = {"r": "table", "p": "table", "v": "view", "m": "view"}
PG_ROUTINE_KINDS = {"f": "function", "w": "function", "p": "procedure"}
MS_OBJECT_KINDS = {
    "U": "table",
    "P": "procedure",
    "PC": "procedure",
    "V": "view",
    "FN": "function",
    "IF": "function",
    "TF": "function",
    "FS": "function",
    "FT": "function",
}
LITE_OBJECT_KINDS = {"table": "table", "view": "view"}
PG_SYSTEM_SCHEMAS = ("pg_catalog", "information_schema")


def read_jdbc(spark: SparkSession, url: str, table: str, target: str, **options: str) -> DataFrame:
    """One catalog table of one target; pass partitionColumn and bounds to read it in parallel."""
    rows = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return rows.select(F.lit(target).alias("target"), "*")


def kind_of(code: Column, kinds: dict[str, str]) -> Column:
    """Object kind of a catalog code, NULL for codes that are no audited object."""
    return F.coalesce(*[F.when(code == c, F.lit(kind)) for c, kind in kinds.items()])


def objects_in_schema(objects: DataFrame, schemas: DataFrame) -> DataFrame:
    """Attach schema names: ``objects(target, schema_id, name, kind)`` with ``schemas(target, schema_id, schema)``."""
    return conform(objects.join(schemas, ["target", "schema_id"]), OBJECTS)


def pg_objects(relations: DataFrame, routines: DataFrame, namespaces: DataFrame) -> DataFrame:
    """``relations(target, relname, relnamespace, relkind)``, ``routines(target, proname, pronamespace, prokind)``,
    ``namespaces(target, oid, nspname)``."""
    found = relations.select(
        "target",
        F.col("relnamespace").alias("schema_id"),
        F.col("relname").alias("name"),
        kind_of(F.col("relkind"), PG_RELATION_KINDS).alias("kind"),
    ).unionByName(
        routines.select(
            "target",
            F.col("pronamespace").alias("schema_id"),
            F.col("proname").alias("name"),
            kind_of(F.col("prokind"), PG_ROUTINE_KINDS).alias("kind"),
        )
    )
    schemas = namespaces.select("target", F.col("oid").alias("schema_id"), F.col("nspname").alias("schema"))
    return objects_in_schema(found.filter("kind IS NOT NULL"), schemas)


def ms_objects(objects: DataFrame, schemas: DataFrame) -> DataFrame:
    """``objects(target, name, schema_id, type)`` with ``schemas(target, schema_id, name)``."""
    found = objects.select(
        "target", "schema_id", "name", kind_of(F.rtrim(F.col("type")), MS_OBJECT_KINDS).alias("kind")
    )
    return objects_in_schema(
        found.filter("kind IS NOT NULL"), schemas.select("target", "schema_id", F.col("name").alias("schema"))
    )


def lite_objects(master: DataFrame) -> DataFrame:
    """``master(target, type, name)``; the one schema is called main."""
    found = master.select(
        "target", F.lit("main").alias("schema"), "name", kind_of(F.col("type"), LITE_OBJECT_KINDS).alias("kind")
    )
    return conform(found.filter("kind IS NOT NULL"), OBJECTS)


def is_nullable(dialect: str) -> Column:
    """Nullable flag from the raw catalog columns (is_nullable, or not_null and pk)."""
    if dialect == "lite":
        return (F.col("not_null") == 0) & (F.col("pk") == 0)
    return F.upper(F.col("is_nullable")) == "YES"


def table_columns(tables: DataFrame, columns: DataFrame, dialect: str) -> DataFrame:
    """Columns of base tables: ``tables(target, schema, table, table_type)`` joined with raw catalog columns."""
    base = tables.filter(F.col("table_type") == "BASE TABLE").select("target", "schema", "table")
    if dialect == "pg":
        base = base.filter(~F.col("schema").isin(*PG_SYSTEM_SCHEMAS))
    if dialect == "lite":
        base = base.filter(~F.col("table").rlike("(?i)^sqlite.")).withColumn("schema", F.lit("main"))
        columns = columns.withColumn("schema", F.lit("main"))
    joined = columns.withColumn("nullable", is_nullable(dialect)).join(base, ["target", "schema", "table"])
    return conform(joined, COLUMNS)


def proc_bodies(modules: DataFrame, objects: DataFrame) -> DataFrame:
    """Texts of plain procedures: ``modules(target, object_id, definition)`` with
    ``objects(target, object_id, schema, name, type)``."""
    procs = objects.filter(F.rtrim(F.col("type")) == "P").select("target", "object_id", "schema", "name")
    return conform(modules.join(procs, ["target", "object_id"]), PROCS)


def exclude_tables(columns: DataFrame, names: list[str]) -> DataFrame:
    """Drop tables named bare or as schema.table, whatever the case; the list is a configuration entry."""
    unwanted = [n.strip().lower() for n in names]
    qualified = F.lower(F.concat(F.col("schema"), F.lit("."), F.col("table")))
    return columns.filter(~(F.lower(F.col("table")).isin(unwanted) | qualified.isin(unwanted)))


def lake_objects(spark: SparkSession, database: str, target: str) -> DataFrame:
    """Tables, views and functions of a database in the session's own catalog."""
    tables = spark.catalog.listTables(database)
    functions = [f for f in spark.catalog.listFunctions(database) if f.namespace]
    rows = [(target, database, t.name, "view" if "VIEW" in t.tableType else "table") for t in tables]
    rows += [(target, database, f.name, "function") for f in functions]
    return spark.createDataFrame(rows, OBJECTS)


def lake_columns(spark: SparkSession, database: str, target: str) -> DataFrame:
    """Columns of the tables (not views) of a database in the session's own catalog."""
    rows = [
        (target, database, t.name, ordinal, f.name, f.dataType.simpleString(), f.nullable, None, None, None)
        for t in spark.catalog.listTables(database)
        if "VIEW" not in t.tableType and t.tableType != "TEMPORARY"
        for ordinal, f in enumerate(spark.table(f"{database}.{t.name}").schema.fields, start=1)
    ]
    return spark.createDataFrame(rows, COLUMNS)
