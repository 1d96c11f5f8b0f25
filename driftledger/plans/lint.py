"""Checks on a collection of script files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from driftledger import messages as M
from driftledger.functions.text import LINT_NAME, is_blank, parse_script_name
from driftledger.operators.skew import lookup


def lintable(files: DataFrame) -> DataFrame:
    """Files that are looked at: hidden ones and README.md are not. Their number is the report's total."""
    return files.filter(~F.col("filename").startswith(".") & (F.lower("filename") != "readme.md"))


def _parsed(files: DataFrame) -> DataFrame:
    name = parse_script_name(F.col("filename"), LINT_NAME)
    return lintable(files).withColumn("_name", name).withColumn("version", F.col("_name.version"))


def _group(files: DataFrame) -> list[str]:
    return ["target"] if "target" in files.columns else []


def _single_file_findings(parsed: DataFrame) -> DataFrame:
    digits = F.regexp_extract("filename", LINT_NAME, 1)
    findings: list[tuple[Column, str, Column]] = [
        (F.col("_name.direction").isNull(), M.RULE_FILENAME, F.lit(M.LINT_FILENAME)),
        (F.col("version").isNull(), M.RULE_VERSION, F.format_string(M.LINT_VERSION, digits, digits)),
        (is_blank(F.col("body")), M.RULE_EMPTY, F.lit(M.LINT_EMPTY)),
    ]
    first = F.coalesce(*[F.when(c, F.struct(F.lit(rule).alias("rule"), m.alias("message"))) for c, rule, m in findings])
    found = parsed.select(*_group(parsed), F.col("filename").alias("file"), "version", first.alias("_finding"))
    return found.filter("_finding IS NOT NULL").select(*_group(parsed), "file", "version", "_finding.*")


def duplicate_versions(parsed: DataFrame) -> DataFrame:
    """(version, n_rows) of versions that several up scripts share; 01 and 1 are the same version."""
    up = parsed.filter((F.col("_name.direction") == M.UP) & F.col("version").isNotNull())
    return up.groupBy(*_group(parsed), "version").agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def _duplicate_findings(parsed: DataFrame) -> DataFrame:
    keys = [*_group(parsed), "version"]
    repeated = duplicate_versions(parsed)
    up = parsed.filter((F.col("_name.direction") == M.UP) & F.col("version").isNotNull()).select(*keys, "filename")
    # A list for each version: the files that share it, all of which the message names.
    named = up.join(repeated, keys).groupBy(*keys).agg(F.array_sort(F.collect_list("filename")).alias("names"))
    message = F.format_string(M.LINT_DUPLICATE, F.col("version").cast("string"), F.array_join("names", ", "))
    texts = named.select(*keys, message.alias("message"))
    return lookup(up, texts, keys, "inner").select(
        *_group(parsed), F.col("filename").alias("file"), "version", F.lit(M.RULE_DUPLICATE).alias("rule"), "message"
    )


def lint(files: DataFrame) -> DataFrame:
    """(target, file, version, rule, message) for ``files(target, filename, body)``; target is optional.

    A file has at most one of the findings format, version and empty, and may be a duplicate besides.
    """
    parsed = _parsed(files)
    return _single_file_findings(parsed).unionByName(_duplicate_findings(parsed))
