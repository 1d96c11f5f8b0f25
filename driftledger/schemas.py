"""Canonical table schemas and the one helper that brings a DataFrame into them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

CORPUS = T.StructType(
    [
        T.StructField("target", T.StringType()),
        T.StructField("version", T.LongType()),
        T.StructField("direction", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("body", T.StringType()),
    ]
)

# A directory that serves every target has no target column.
SHARED_CORPUS = T.StructType(CORPUS.fields[1:])

LEDGER = T.StructType(
    [
        T.StructField("target", T.StringType()),
        T.StructField("version", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("recorded_at", T.TimestampType()),
        T.StructField("note", T.StringType()),
        T.StructField("content_sha256", T.StringType()),
    ]
)

CURSOR = T.StructType(
    [
        T.StructField("target", T.StringType()),
        T.StructField("version", T.LongType()),
        T.StructField("dirty", T.BooleanType()),
    ]
)

OBJECTS = T.StructType(
    [
        T.StructField("target", T.StringType()),
        T.StructField("schema", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("kind", T.StringType()),
    ]
)

COLUMNS = T.StructType(
    [
        T.StructField("target", T.StringType()),
        T.StructField("schema", T.StringType()),
        T.StructField("table", T.StringType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("column", T.StringType()),
        T.StructField("data_type", T.StringType()),
        T.StructField("nullable", T.BooleanType()),
        T.StructField("max_length", T.IntegerType()),
        T.StructField("precision", T.IntegerType()),
        T.StructField("scale", T.IntegerType()),
    ]
)

INSTRUCTIONS = T.StructType(
    [
        T.StructField("target", T.StringType()),
        T.StructField("version", T.LongType()),
        T.StructField("status", T.StringType()),
    ]
)

PROCS = T.StructType(
    [
        T.StructField("target", T.StringType()),
        T.StructField("schema", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("definition", T.StringType()),
    ]
)

TARGETS = T.StructType(
    [
        T.StructField("target", T.StringType()),
        T.StructField("engine", T.StringType()),
        T.StructField("url_env", T.StringType()),
        T.StructField("protected", T.BooleanType()),
        T.StructField("error", T.StringType()),
    ]
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the columns of ``schema`` in order; a column that is missing is added as NULL."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name).cast(f.dataType) if f.name in present else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields
        ]
    )


def has_target(corpus: DataFrame) -> bool:
    """False for a corpus that is shared by all targets."""
    return "target" in corpus.columns
