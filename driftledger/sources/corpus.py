"""Script corpora: one row per versioned script."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftledger import messages as M
from driftledger.functions.text import parse_script_name
from driftledger.schemas import CORPUS, SHARED_CORPUS, conform, has_target
from driftledger.sources.folder import scan_files


def corpus_from_files(files: DataFrame) -> DataFrame:
    """Corpus rows of ``(filename, body)`` rows; names that are no script's, or hold no valid version, go, as do files with an
    ``error``: see ``folder.split_files`` to leave out their targets.

    Versions above the ledger's signed 64-bit range are kept out here and reported by
    :func:`out_of_range`. A ``target`` column is carried along when there is one.
    """
    read = files.filter("error IS NULL") if "error" in files.columns else files
    named = read.withColumn("_name", parse_script_name(F.col("filename")))
    version = F.col("_name.version").try_cast("bigint")
    corpus = named.withColumn("version", version).withColumn("direction", F.col("_name.direction"))
    return conform(corpus.filter(version.isNotNull()), CORPUS if has_target(files) else SHARED_CORPUS)


def out_of_range(files: DataFrame) -> DataFrame:
    """Scripts whose version is a number but exceeds the ledger's range, with the reason."""
    named = files.withColumn("_name", parse_script_name(F.col("filename")))
    wide = named.filter(F.col("_name.version").isNotNull() & F.col("_name.version").try_cast("bigint").isNull())
    return wide.select(
        *[c for c in files.columns if c not in ("body", "error")],
        F.col("_name.version").alias("version"),
        F.concat(
            F.lit("migration version "), F.col("_name.version").cast("string"), F.lit(" exceeds the ledger's range")
        ).alias("error"),
    )


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Scan a folder of scripts. A file that cannot be read ends the job; for many folders see ``folder.scan_folders``."""
    return corpus_from_files(_raised(scan_files(spark, path), path))


def _raised(files: DataFrame, path: str) -> DataFrame:
    unread = F.raise_error(F.concat(F.coalesce("filename", F.lit(path)), F.lit(": "), F.col("error"))).cast("string")
    bad = F.col("error").isNotNull()
    return files.select(F.when(bad, unread).otherwise(F.col("filename")).alias("filename"), "body")


def read_corpus_table(spark: SparkSession, path: str) -> DataFrame:
    """A corpus kept as a parquet table, the form to use beyond a few million scripts."""
    df = spark.read.parquet(path)
    return conform(df, CORPUS if has_target(df) else SHARED_CORPUS)


def corpus_up(corpus: DataFrame) -> DataFrame:
    return corpus.filter(F.col("direction") == M.UP)


def corpus_down(corpus: DataFrame) -> DataFrame:
    return corpus.filter(F.col("direction") == M.DOWN)


def versions(corpus: DataFrame) -> DataFrame:
    """Versions of the up scripts in ascending order."""
    keys = ["target", "version"] if has_target(corpus) else ["version"]
    return corpus_up(corpus).select(*keys).orderBy(*keys)
