"""Functions on script names and script text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The ASCII white space that the extraction patterns accept. Java's \s has one
# character more (vertical tab), so the set is always written out.
WS = r"[ \t\n\f\r]"

# The names of scripts, for loading and for lint, and the line that ends a batch.
LOADER_NAME = r"\A(\d+)_[^\n]+\.(up|down)\.sql\z"
LINT_NAME = r"\A(\d+)_([a-zA-Z0-9_-]+)\.(up|down)\.sql\z"
BATCH_SEPARATOR = rf"(?imd)^{WS}*GO{WS}*$"

MAX_UINT64 = "18446744073709551615"


def content_hash(body: Column | str) -> Column:
    """Lower-case hex SHA-256 of the text's bytes."""
    return F.sha2(F.col(body) if isinstance(body, str) else body, 256)


def trim_space(text: Column) -> Column:
    """Strip Unicode white space from both ends (``trim`` strips blanks only)."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"(?U)\S")


def keep_if(value: Column, condition) -> Column:
    """``value`` where ``condition(value)`` holds, else NULL; the value is evaluated once."""
    return F.get(F.filter(F.array(value), condition), F.lit(0))


def parse_uint64(digits: Column) -> Column:
    """Digits as decimal(20,0), NULL when they are no unsigned 64-bit number."""
    number = keep_if(digits, lambda d: d.rlike(r"\A[0-9]+\z")).try_cast("decimal(38,0)")
    return keep_if(number, lambda n: n <= F.lit(MAX_UINT64).cast("decimal(38,0)")).cast("decimal(20,0)")


def parse_script_name(filename: Column, pattern: str = LOADER_NAME) -> Column:
    """``struct<version decimal(20,0), direction string>``; both NULL when the name is not a script's."""
    direction_group = 2 if pattern == LOADER_NAME else 3
    direction = keep_if(F.regexp_extract(filename, pattern, direction_group), lambda d: d != "")
    return F.struct(
        parse_uint64(F.regexp_extract(filename, pattern, 1)).alias("version"),
        direction.alias("direction"),
    )


def script_name(version: Column, name: Column) -> Column:
    """File name of a new up script: 14-digit version and the name with blanks as underscores."""
    slug = F.replace(trim_space(name), F.lit(" "), F.lit("_"))
    return F.format_string("%014d_%s.up.sql", version.cast("bigint"), slug)


def batches(text: Column) -> Column:
    """The non-blank pieces between lines that hold only GO, trimmed, in order."""
    pieces = F.transform(F.split(text, BATCH_SEPARATOR, -1), trim_space)
    return F.filter(pieces, lambda p: p != "")


def explode_rows(df: DataFrame, keep: list[str], array: Column, pos: str = "pos", item: str = "item") -> DataFrame:
    """One row per array element, for arrays that are costly to compute.

    The inner explode makes the optimizer filter on the array's size first, which computes the
    array again; the outer one does not, and its rows for empty arrays are dropped right after.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(pos, item)).filter(F.col(pos).isNotNull())


def split_batches(df: DataFrame, text: str, pos: str = "pos", batch: str = "batch") -> DataFrame:
    """One row per batch of ``text``; the text column itself is not carried along."""
    return explode_rows(df, [c for c in df.columns if c != text], batches(F.col(text)), pos, batch)


def detail_text(parts: Column) -> Column:
    """Join the parts of a detail message, skipping NULLs."""
    return F.array_join(parts, "; ")
