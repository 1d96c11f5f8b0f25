"""Questions about the script corpus alone, or the corpus and the cursor."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from driftledger import messages as M
from driftledger.functions import ddl
from driftledger.functions.text import content_hash, explode_rows, script_name
from driftledger.operators.intervals import counts_above, pairs_above, pairs_up_to
from driftledger.operators.skew import lookup
from driftledger.schemas import CURSOR, conform, has_target
from driftledger.sources.corpus import corpus_up


def script_keys(corpus: DataFrame) -> list[str]:
    return ["target", "version"] if has_target(corpus) else ["version"]


def latest_by_name(scripts: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per key: of several files with the same version the later file name counts."""
    winner = F.max_by(F.struct("filename", *columns), "filename").alias("_file")
    return scripts.groupBy(*keys).agg(winner).select(*keys, "_file.*")


def script_facts(corpus: DataFrame, dialect: str | None, direction: str = M.UP) -> DataFrame:
    """(keys, filename, sha256, created, dropped): all the audits need to know about a script.

    This is the only place that reads script text; the text stays behind before any shuffle.
    Without a dialect the object arrays are left out.
    """
    scripts = corpus.filter(F.col("direction") == direction)
    keys = script_keys(corpus)
    columns = {"sha256": content_hash("body")}
    if dialect is not None:
        scripts = scripts.withColumn("_text", ddl.executable_text(F.col("body"), dialect))
        columns["created"] = ddl.created(F.col("_text"), dialect)
        columns["dropped"] = ddl.dropped(F.col("_text"), dialect)
    facts = scripts.select(*keys, "filename", *[c.alias(name) for name, c in columns.items()])
    return latest_by_name(facts, keys, list(columns))


def find(corpus: DataFrame, keys: DataFrame, direction: str = M.UP, location: str = "corpus") -> DataFrame:
    """Look up the script of each (target, version); ``error`` says so where there is none."""
    on = script_keys(corpus)
    files = latest_by_name(corpus.filter(F.col("direction") == direction).select(*on, "filename"), on, [])
    text = M.NO_SCRIPT if direction == M.UP else M.NO_DOWN_SCRIPT
    found = with_scripts(keys, files, on)
    missing = F.when(F.col("filename").isNull(), F.format_string(text, F.col("version"), F.lit(location)))
    return found.withColumn("error", missing)


def with_scripts(rows: DataFrame, scripts: DataFrame, on: list[str]) -> DataFrame:
    """Left join of (target, version) rows with one row per script.

    In a shared corpus all targets meet at the same versions, so the join may be split there.
    """
    if on == ["version"]:
        return lookup(rows, scripts, on)
    return rows.join(scripts, on, "left")


def created_objects(corpus: DataFrame, dialect: str) -> DataFrame:
    """(keys, pos, schema, name, kind) of every CREATE in the up scripts, in source order."""
    return _object_rows(corpus, dialect, ddl.created)


def dropped_objects(corpus: DataFrame, dialect: str) -> DataFrame:
    """Same for DROP."""
    return _object_rows(corpus, dialect, ddl.dropped)


def _object_rows(corpus: DataFrame, dialect: str, extract) -> DataFrame:
    text = ddl.executable_text(F.col("body"), dialect)
    scripts = corpus_up(corpus).select(*script_keys(corpus), "filename", text.alias("_text"))
    keep = [*script_keys(corpus), "filename"]
    return explode_rows(scripts, keep, extract(F.col("_text"), dialect)).select(*keep, "pos", "item.*")


def _clock(now: dt.datetime) -> int:
    if now.tzinfo is not None:
        now = now.astimezone(dt.timezone.utc)
    return int(now.strftime("%Y%m%d%H%M%S"))


def next_version(corpus: DataFrame, now: dt.datetime) -> DataFrame:
    """The clock (UTC, yyyyMMddHHmmss), or one more than the highest up version where that is ahead.

    Above the highest version a ledger can hold there is none: ``next_version`` is null and ``error`` says so.
    """
    keys = script_keys(corpus)[:-1]
    highest = F.max(F.when(F.col("direction") == M.UP, F.col("version")))
    clock = F.lit(_clock(now)).cast("bigint")
    found = corpus.groupBy(*keys).agg(highest.alias("_highest"))
    full = F.coalesce(F.col("_highest") == (1 << 63) - 1, F.lit(False))
    error = F.when(full, F.lit("no version is left above 9223372036854775807"))
    return found.select(*keys, F.when(~full, F.greatest(clock, F.col("_highest") + 1)).alias("next_version"), error.alias("error"))


def next_script_name(corpus: DataFrame, now: dt.datetime, name: Column | str) -> DataFrame:
    """File name for the next up script; null where ``error`` is set."""
    label = F.lit(name) if isinstance(name, str) else name
    filename = F.when(F.col("error").isNull(), script_name(F.col("next_version"), label))
    return next_version(corpus, now).withColumn("filename", filename)


def split_dirty(cursor: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean, dirty) rows; a dirty row has ``error``, as nothing may be applied or recorded there."""
    dirty = is_dirty()
    message = F.format_string("migration cursor is dirty at version %d; repair the target to resolve it", "version")
    return cursor.filter(~dirty), cursor.filter(dirty).withColumn("error", message)


def is_dirty() -> Column:
    """A target without a version has nothing that could be half applied, so it is clean."""
    return F.coalesce(F.col("dirty"), F.lit(False)) & F.col("version").isNotNull()


def _positions(cursor: DataFrame) -> DataFrame:
    return conform(cursor, CURSOR).select("target", F.col("version").alias("position"), is_dirty().alias("_dirty"))


def pending(
    corpus: DataFrame,
    cursor: DataFrame,
    columns: list[str] | None = None,
    listed_only: bool = False,
    skip_dirty: bool = False,
) -> DataFrame:
    """Up scripts above the cursor, all of them for a target without a version.

    The cursor decides, not the ledger. ``cursor`` names the targets when the corpus is shared;
    a corpus with targets is pending as a whole where the cursor has no row, unless
    ``listed_only``. With a shared corpus each pair of a target and a script above its cursor is a
    row, as the pairs are the answer; :func:`pending_summary` counts them without forming them. ``skip_dirty`` leaves out targets where nothing may be applied.
    """
    columns = ["filename"] if columns is None else columns
    scripts, places = corpus_up(corpus), _positions(cursor)
    if has_target(corpus):
        scripts = scripts.select("target", "version", *columns)
        placed = lookup(scripts, places, ["target"], "inner" if listed_only else "left")
        if skip_dirty:
            placed = placed.filter(~F.coalesce("_dirty", F.lit(False)))
        return placed.filter("position IS NULL OR version > position").drop("position", "_dirty")
    places = places.filter(~F.col("_dirty")) if skip_dirty else places
    return pairs_above(scripts.select("version", *columns), places).select("target", "version", *columns)


def pending_facts(corpus: DataFrame, cursor: DataFrame) -> DataFrame:
    """(target, n, first) as rows to be added up per target: numbers of pending scripts, and the first of them.

    With a shared corpus scripts are counted per position, so no (target, script) pair is ever formed.
    """
    if has_target(corpus):
        one = F.struct("version", "filename")
        return pending(corpus, cursor).select("target", F.lit(1).cast("long").alias("n"), one.alias("first"))
    scripts = corpus_up(corpus).select("version", "filename")
    return counts_above(scripts, _positions(cursor)).select("target", "n", "first")


def pending_summary(corpus: DataFrame, cursor: DataFrame) -> DataFrame:
    """(target, n_pending, next_version, next_file) for targets with pending scripts."""
    counted = pending_facts(corpus, cursor).groupBy("target").agg(F.sum("n").alias("n_pending"), F.min("first").alias("_next"))
    return counted.select(
        "target", "n_pending", F.col("_next.version").alias("next_version"), F.col("_next.filename").alias("next_file")
    )


def pending_scripts(corpus: DataFrame, cursor: DataFrame) -> DataFrame:
    """Dry run: pending scripts with their text; a dirty target yields one row with ``error`` instead.

    A corpus with targets is filtered as it is read wherever the cursor is small enough to be broadcast: text that is not
    pending is never shuffled. With a shared corpus the pairs of target and script are the result; they are worked out
    without the text, which joins them last.
    """
    _, dirty = split_dirty(cursor)
    if has_target(corpus):
        scripts = pending(corpus, cursor, ["filename", "body"], skip_dirty=True)
    else:
        files = ["version", "filename"]
        wanted = pending(corpus, cursor, skip_dirty=True)
        scripts = lookup(wanted, corpus_up(corpus).select(*files, "body"), files, "inner")
    scripts = scripts.select("target", "version", "filename", "body", F.lit(None).cast("string").alias("error"))
    refused = dirty.select(
        "target",
        F.lit(None).cast("bigint").alias("version"),
        F.lit(None).cast("string").alias("filename"),
        F.lit(None).cast("string").alias("body"),
        "error",
    )
    return scripts.unionByName(refused)


def reached(corpus: DataFrame, cursor: DataFrame) -> DataFrame:
    """(target, version) of up scripts at or below the cursor."""
    scripts = corpus_up(corpus)
    if has_target(corpus):
        places = _positions(cursor).select("target", "position")
        placed = lookup(scripts.select("target", "version"), places, ["target"], "inner")
        return placed.filter("version <= position").select("target", "version").distinct()
    return pairs_up_to(scripts.select("version").distinct(), _positions(cursor)).select("target", "version")
