"""Folders of script files, listed and read in tasks.

A table of folders becomes a table of files, and that a table of contents. Names, sizes and bytes stay on the executors. What
cannot be listed or read is a row with its reason, so one bad folder does not stop the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftledger.operators.skew import lookup
from driftledger.sources.shared import share

#: Bytes that opening a file is counted as, besides its length, and rows and bytes that leave a task together.
OPENING, ROWS, BATCH = 1 << 16, 4096, 1 << 26
_LISTED = "target string, folder string, filename string, length long, error string"


def _at(path: str) -> tuple[fs.FileSystem, str]:
    """File system and the path within it. A local path is taken as it is, as names may hold what URIs read specially."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def _reason(e: Exception) -> str:
    return f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}".rstrip(": ")


def _dealt(files: DataFrame, length: Column | str) -> DataFrame:
    """Files dealt by name over as many tasks as their bytes fill partitions of the size that file scans have in this session."""
    spark = files.sparkSession
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    total = files.agg(F.sum(F.coalesce(length, F.lit(0)) + OPENING)).first()[0] or 0
    return files.repartition(int(max(1, -(-total // size))), F.xxhash64("folder", "filename"))


def list_files(folders: DataFrame) -> DataFrame:
    """(target, folder, filename, length, error): the files directly in each folder of (target, folder), whatever their names.

    An absent folder has no files. One that cannot be listed is one row without a filename. Each folder has a task of its own, up
    to the number of shuffle partitions of this session: a table of folders is small, and would be one task however many files
    they hold.
    """
    tasks = max(1, min(folders.count(), int(folders.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for target, folder in zip(batch["target"].to_pylist(), batch["folder"].to_pylist(), strict=True):
                try:
                    system, path = _at(folder)
                    found = [(f.base_name, f.size, None) for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.type == fs.FileType.File]
                except (OSError, pa.ArrowException, AttributeError) as e:  # no such scheme, no folder at all, not allowed
                    found = [(None, None, _reason(e))]
                for i in range(0, len(found), ROWS):
                    names, sizes, errors = zip(*found[i : i + ROWS], strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([target] * len(names), pa.string()), pa.array([folder] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(errors, pa.string())],
                        names=["target", "folder", "filename", "length", "error"],
                    )

    return folders.select(F.col("target").cast("string"), "folder").repartition(tasks).mapInArrow(listed, _LISTED)


def read_files(listed: DataFrame) -> DataFrame:
    """(target, filename, body, error) of rows of :func:`list_files`.

    The body is the file's bytes taken as text without any change, so its hash is the file's hash. A file that cannot be read, or
    no longer has the length it was listed with, has an error and no body, as an empty body would be a hash that no file has.
    """

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def sent() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*rows, strict=True)] or [[], [], [], []]
            rows.clear()
            kinds = (pa.string(), pa.string(), pa.binary(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["target", "filename", "content", "error"])

        held = 0
        for batch in batches:
            known: dict[str, tuple[fs.FileSystem, str]] = {}
            for target, folder, name, length, error in zip(*(batch[c].to_pylist() for c in ("target", "folder", "filename", "length", "error")), strict=True):
                content = None
                if error is None:
                    try:
                        if folder not in known:
                            known[folder] = _at(folder)
                        system, path = known[folder]
                        with system.open_input_stream(f"{path.rstrip('/')}/{name}") as stream:
                            content = stream.read()
                        if len(content) != length:
                            content, error = None, f"listed with {length} bytes, read with {len(content)}"
                    except (OSError, pa.ArrowException) as e:
                        error = _reason(e)
                rows.append((target, name, content, error))
                held += length or 0
                if held >= BATCH or len(rows) >= ROWS:
                    yield sent()
                    held = 0
        yield sent()

    read = _dealt(listed, "length").mapInArrow(opened, "target string, filename string, content binary, error string")
    return read.select("target", "filename", F.col("content").cast("string").alias("body"), "error")


def scan_folders(folders: DataFrame) -> DataFrame:
    """(target, filename, body, error) of the files in each folder of (target, folder)."""
    return read_files(share(list_files(folders), "listing"))


def split_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files of targets that could be read in full, refused rows with ``error``). Each file is opened once."""
    files = share(files, "files")
    refused = files.filter("error IS NOT NULL").select("target", "filename", "error")
    sound = lookup(files.filter("error IS NULL"), refused.select("target").distinct(), ["target"], "left_anti")
    return sound.select("target", "filename", "body"), refused


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """``(filename, body, error)`` of the files directly in one folder; see :func:`scan_folders`."""
    return scan_folders(spark.createDataFrame([(None, path)], "target string, folder string")).drop("target")


def write_files(files: DataFrame) -> int:
    """Write ``body`` of each row of (folder, filename, body) to a file, in tasks; how many. Existing files are replaced whole.

    The rows are dealt as :func:`read_files` does, since making a file takes far longer than reading its row from a table.
    """

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: dict[str, tuple[fs.FileSystem, str]] = {}
            for folder, name, content in zip(*(batch[c].to_pylist() for c in ("folder", "filename", "content")), strict=True):
                if folder not in made:
                    made[folder] = _at(folder)
                    made[folder][0].create_dir(made[folder][1], recursive=True)
                system, path = made[folder]
                with system.open_output_stream(f"{path.rstrip('/')}/{name}") as stream:
                    stream.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows = files.select("folder", "filename", F.col("body").cast("binary").alias("content"))
    return _dealt(rows, F.octet_length("content")).mapInArrow(written, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
