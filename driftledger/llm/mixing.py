"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftledger.llm.common import cut, n_words, running, stored

WEIGHTS = (5, 2, 1)
#: Copies are counted in units of 1 / SCALE, so that sums stay exact integers.
SCALE = 1 << 24


def source_targets(sources: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sources(source, source_size)`` with rank, weight and target.

    Sources by code point, null last, take the weights in turn and share ``share`` of all sizes. A target stops at ``most``
    times its source's size; what is above goes to the others by weight, until none is above. Each round is one aggregate
    over the sources table: a source once full stays full, as the level only rises.
    """
    ranked = running(sources.withColumn("one", F.lit(1)).withColumn("last", F.col("source").isNull()), ["last", "source"], {"rank": "one"})
    turn = F.array(*map(F.lit, weights))
    ranked = cut(
        ranked.select(
            "source",
            "source_size",
            F.element_at(turn, (F.col("rank") % len(weights) + 1).cast("int")).cast("long").alias("weight"),
            (F.lit(most) * F.col("source_size")).alias("bound"),
        )
    )
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, full_before = 0.0, -1
    while True:
        full = F.col("bound") <= F.lit(level) * F.col("weight") if full_before >= 0 else F.lit(False)
        n_full, taken, open_weight = ranked.agg(
            F.coalesce(F.sum(full.cast("long")), F.lit(0)),
            F.coalesce(F.sum(F.when(full, F.col("bound"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)),
        ).first()
        if n_full == full_before or not open_weight:
            break
        level, full_before = (share * total - taken) / open_weight, n_full
    return ranked.withColumn("target", F.least(F.col("bound").cast("double"), F.lit(float(level)) * F.col("weight")))


def _offset(seed: int) -> Column:
    """A random start in units of 1 / SCALE, the same in every run, another for each source."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 6), 16, 10).cast("long")


def mix(docs: DataFrame, seed: int = 1, share: float = 1.5, most: int = 2) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies): how often each row enters the mix.

    Within its source each row is expected target / source_size times. These expectations are summed up in the order
    of size and doc_id; with one random start per source, a row is emitted once for each integer that its part of the
    sum crosses. Taking rows by size keeps the taken words within about one long document of the target.

    Rows that share doc_id, source and size take a step each, so they may get different copies. A null text has size 0; null
    sources are one source, null doc_ids come first. An empty table gives no rows. Other columns are not looked at.
    """
    rows = stored(docs.select("doc_id", "source", n_words().alias("size"), F.monotonically_increasing_id().alias("row_id"), F.lit(1).alias("one")))
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = cut(source_targets(sources, share, most).withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))))
    rate = F.floor(F.col("target") / F.col("source_size") * SCALE)
    targets = targets.select(
        F.col("source").alias("source__"), "key", "source_size", "target",
        F.least(F.when(F.col("source_size") > 0, rate).otherwise(0), F.lit(most * SCALE)).cast("long").alias("rate"),
        _offset(seed).alias("start"),
    )
    keyed = rows.join(targets, rows["source"].eqNullSafe(targets["source__"])).drop("source__")
    # Only rows that nothing tells apart are ordered by row_id, so another reading of the table gives the same result.
    placed = running(keyed, ["size", "doc_id", "row_id"], {"before": "one"}, ["key"])
    # Long arithmetic is exact up to 2.7e11 documents a source.
    copies = F.expr(f"CAST(((before + 1) * rate + start) DIV {SCALE} - (before * rate + start) DIV {SCALE} AS INT)")
    return placed.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def mixed(docs: DataFrame, seed: int = 1) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; the columns stay.

    Rows that share doc_id, source and size share their copies as evenly as whole numbers allow: they are numbered in the order
    of their texts' hashes, and the first ones get what is left over. Only such rows are written and numbered.
    """
    units = mix(docs, seed).groupBy("doc_id", "source", "size").agg(F.count("*").alias("n_rows"), F.sum("copies").alias("copies")).where("copies > 0")
    plan = stored(
        units.select(*[F.col(c).alias(f"{c}__") for c in ("doc_id", "source", "size", "n_rows", "copies")], F.monotonically_increasing_id().alias("unit__"))
    )
    rows = docs.select(F.struct("*").alias("row__"), n_words().alias("row_size__"))
    same = (
        F.col("row__.doc_id").eqNullSafe(F.col("doc_id__"))
        & F.col("row__.source").eqNullSafe(F.col("source__"))
        & (F.col("row_size__") == F.col("size__"))
    )
    taken = rows.join(plan.where("n_rows__ = 1"), same).select("row__", F.col("copies__").alias("n__"))
    repeated = plan.where("n_rows__ > 1")
    if not repeated.isEmpty():
        several = rows.join(repeated, same).select(
            "row__", "unit__", "n_rows__", "copies__", F.lit(1).alias("one__"),
            F.xxhash64("row__.text").alias("hash__"), F.monotonically_increasing_id().alias("row_id__"),
        )
        numbered = running(several, ["hash__", "row_id__"], {"number__": "one__"}, ["unit__"])
        own = F.expr("copies__ DIV n_rows__ + CAST(number__ < copies__ % n_rows__ AS LONG)")
        taken = taken.unionByName(numbered.select("row__", own.alias("n__")).where("n__ > 0"))
    return taken.withColumn("copy__", F.explode(F.sequence(F.lit(1).cast("long"), "n__"))).select("row__.*")
