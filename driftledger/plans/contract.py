"""Schema contracts: the typed fields each table offers to client code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from driftledger.functions.naming import pascal_case, safe_field, web_name
from driftledger.functions.text import explode_rows
from driftledger.functions.payload import field_contract_type, json_fields
from driftledger.functions.types import contract_type, web_type, web_validator
from driftledger.operators.skew import lookup, row_counts
from driftledger.schemas import COLUMNS, conform
from driftledger.sources.shared import share

TABLE = ["target", "schema", "table"]

COMPARED = ["class_name", "field", "alias", "type", "web_type", "nullable", "ordinal"]


def typed(columns: DataFrame, dialect: str) -> DataFrame:
    """Columns with contract type, field and web names; keeps unknown types as "Any" with ``known`` false."""
    kind = contract_type(F.col("data_type"), dialect)
    return columns.withColumn("_type", kind).select(
        "*",
        F.col("_type.type").alias("type"),
        F.col("_type.known").alias("known"),
        safe_field(F.col("column")).alias("field"),
        web_name(F.col("column")).alias("web_name"),
        web_type(F.col("data_type")).alias("web_type"),
        web_validator(F.col("data_type")).alias("web_validator"),
    ).drop("_type")


def unmapped_types(columns: DataFrame, dialect: str) -> DataFrame:
    """(target, line) with ``schema.table.column: type`` for each type without a mapping."""
    unknown = columns.filter(~contract_type(F.col("data_type"), dialect)["known"])
    line = F.format_string("%s.%s.%s: %s", "schema", "table", "column", "data_type")
    return unknown.select("target", line.alias("line"))


def resolve_class_names(columns: DataFrame) -> DataFrame:
    """(target, schema, table, class_name): Pascal-case names, with the schema's in front where two tables share one.

    Names are counted before they are joined back, so only those that occur more than once take part.
    """
    tables = columns.select(*TABLE).distinct().withColumn("_name", pascal_case(F.col("table")))
    repeated = row_counts(tables, ["target", "_name"]).filter("n_rows > 1")
    marked = lookup(tables, repeated, ["target", "_name"])
    prefixed = F.concat(pascal_case(F.col("schema")), F.col("_name"))
    return marked.select(*TABLE, F.when(F.col("n_rows") > 1, prefixed).otherwise(F.col("_name")).alias("class_name"))


def class_name_collisions(columns: DataFrame) -> DataFrame:
    """(target, class_name, schema, table, error): each table whose class name another one has first, even with the schema
    in front. The first is the smallest by schema and table."""
    named = resolve_class_names(columns)
    owner = F.min(F.struct("schema", "table")).alias("_owner")
    shared = named.groupBy("target", "class_name").agg(F.count(F.lit(1)).alias("n_rows"), owner).filter("n_rows > 1")
    met = lookup(named, shared.drop("n_rows"), ["target", "class_name"], "inner")
    other = met.filter(F.struct("schema", "table") != F.col("_owner"))
    of = lambda *parts: F.concat_ws(".", *parts)
    error = F.format_string('class name "%s" of "%s" is taken by "%s"', "class_name", of("schema", "table"), of("_owner.schema", "_owner.table"))
    return other.select("target", "class_name", "schema", "table", error.alias("error"))


def schema_contract(columns: DataFrame, dialect: str) -> DataFrame:
    """(target, schema, table, class_name, ordinal, field, alias, type, ..., nullable), one row per column."""
    names = resolve_class_names(columns)
    rows = lookup(typed(columns, dialect), names, TABLE)
    return rows.select(
        *TABLE,
        "class_name",
        "ordinal",
        "field",
        F.col("column").alias("alias"),
        "type",
        "known",
        "web_name",
        "web_type",
        "web_validator",
        "nullable",
        "max_length",
        "precision",
        "scale",
    )


def nested_contract(contract: DataFrame) -> DataFrame:
    """One row per table with its fields as an array in column order; a table's own columns are all it holds."""
    fields = F.struct("ordinal", "field", "alias", "type", "web_name", "web_type", "nullable")
    return contract.groupBy(*TABLE, "class_name").agg(F.array_sort(F.collect_list(fields)).alias("fields"))


def contract_needs(contract: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Which imports the contract's types need, per target (or per table with ``by=TABLE``)."""

    def some(condition: Column) -> Column:
        return F.bool_or(condition)

    wanted = {"Decimal": "decimal", "datetime": "datetime", "time": "time", "UUID": "uuid", "Any": "any"}
    flags = [some(F.col("type") == t).alias(f"need_{n}") for t, n in wanted.items()]
    needs = contract.groupBy(*(by or ["target"])).agg(*flags, some(F.col("nullable")).alias("need_optional"))
    imports = F.concat_ws(", ", F.when(F.col("need_any"), "Any"), F.when(F.col("need_optional"), "Optional"))
    return needs.withColumn("typing_imports", imports)


def _fingerprints(stored: DataFrame, live: DataFrame, by: list[str]) -> DataFrame:
    """(by, stale): do the two contracts differ? One aggregate over both sides, combined before its shuffle.

    The fields of a side are a set, whose number, sum and exclusive or of hashes do not depend on their order; what both
    sides have cancels out.
    """

    def side(df: DataFrame, sign: int) -> DataFrame:
        fields = [*TABLE, F.col("alias").alias("column"), *COMPARED]
        rows = df.select(*by, F.xxhash64(F.struct(*fields)).alias("_h"), F.xxhash64(F.lit(sign * sign), F.struct(*fields)).alias("_g"))
        return rows.withColumn("_sign", F.lit(sign))

    wide = lambda h: F.sum(F.col(h).cast("decimal(20,0)") * F.col("_sign"))
    rows = side(stored, 1).unionByName(side(live, -1)).groupBy(*by)
    sums = rows.agg(F.sum("_sign").alias("_n"), wide("_h").alias("_s"), F.bit_xor("_h").alias("_x"), F.bit_xor("_g").alias("_y"))
    same = (F.col("_n") == 0) & (F.col("_s") == 0) & (F.col("_x") == 0) & (F.col("_y") == 0)
    return sums.select(*by, (~same).alias("stale"))


def contract_diff(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Fields that were added, removed or changed since a contract was stored.

    Fingerprints tell first which tables differ; only their fields are compared one by one.
    """
    keys = [*TABLE, "column"]
    differing = share(_fingerprints(stored, live, TABLE).filter("stale").select(*TABLE), "differing")

    def side(df: DataFrame, name: str) -> DataFrame:
        fields = df.select(*TABLE, F.col("alias").alias("column"), F.struct(*COMPARED).alias(name))
        return lookup(fields, differing, TABLE, "left_semi")

    both = side(stored, "stored").join(side(live, "live"), keys, "full")
    change = (
        F.when(F.col("stored").isNull(), "added")
        .when(F.col("live").isNull(), "removed")
        .when(~F.col("stored").eqNullSafe(F.col("live")), "changed")
    )
    return both.withColumn("change", change).filter("change IS NOT NULL").select(*keys, "change", "stored", "live")


def contract_stale(stored: DataFrame, live: DataFrame) -> DataFrame:
    """(target, stale): does the stored contract differ from the live one?"""
    return _fingerprints(stored, live, ["target"])


def json_contracts(procs: DataFrame) -> DataFrame:
    """Columns of the JSON input of procedures: table ``<name without usp_>_payload``, all fields nullable.

    Procedures without JSON input give no rows. The text is dropped in the scan.
    """
    table = F.concat(F.regexp_replace("name", r"\Ausp_", ""), F.lit("_payload"))
    taking = procs.filter(F.col("definition").rlike("(?i)OPENJSON")).withColumn("table", table)
    fields = explode_rows(taking, TABLE, json_fields(F.col("definition")))
    return fields.select(
        *TABLE,
        (F.col("pos") + 1).alias("ordinal"),
        F.col("item.name").alias("column"),
        F.col("item.path").alias("path"),
        F.col("item.sql_type").alias("data_type"),
        field_contract_type(F.col("item.sql_type")).alias("type"),
        F.lit(True).alias("nullable"),
    )


def with_payloads(columns: DataFrame, procs: DataFrame) -> DataFrame:
    """Table columns plus those of JSON payloads, for contracts that cover both."""
    return conform(columns, COLUMNS).unionByName(conform(json_contracts(procs), COLUMNS))
