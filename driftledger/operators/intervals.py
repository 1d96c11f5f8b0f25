"""``version > cursor`` between a shared corpus and many targets, without comparing every pair.

Versions and cursor positions are points on one line, each value once. The line is cut into ranges of about as many points,
counted within each range and across the few ranges, so each position knows how many scripts lie above it, and each version
its place in falling order. Nothing grows faster than the scripts and targets do. Pairs are formed by place, the wanted ones only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from driftledger.operators.skew import lookup

RANGES = 256  # a power of two
CHUNK = 4096  # places listed in one array
POINT = ["known", "at"]


def _point(value: str) -> list[Column]:
    """The keys of a value on the line. NULL is a point below all others."""
    return [F.col(value).isNotNull().alias("known"), F.coalesce(value, F.lit(0)).cast("bigint").alias("at")]


def _range() -> Column:
    """How many of ``cuts`` are at most ``at``, by binary search."""
    steps = F.array(*[F.lit(RANGES >> i) for i in range(1, RANGES.bit_length())])
    found = F.aggregate(steps, F.lit(0), lambda i, step: F.when(F.element_at("cuts", i + step) <= F.col("at"), i + step).otherwise(i))
    return F.when(F.col("known"), found).otherwise(0)


def line(scripts: DataFrame, places: DataFrame) -> DataFrame:
    """(known, at, n, file, above, higher, first, versions): each version of ``scripts`` and position of ``places`` once.

    ``n`` scripts have the version, ``file`` being the first by name; ``above`` scripts, of ``higher`` versions, lie above it,
    the lowest of which is ``first``; there are ``versions`` in all.
    """
    one = F.struct(*[c for c in ("version", "filename") if c in scripts.columns]).alias("file")
    marked = scripts.select(*_point("version"), F.lit(1).alias("n"), one)
    marked = marked.unionByName(places.select(*_point("position"), F.lit(0).alias("n")), allowMissingColumns=True)
    shares = [i / RANGES for i in range(1, RANGES)]
    cuts = marked.filter("known").agg(F.percentile_approx("at", shares)).scalar()
    points = marked.groupBy(*POINT).agg(F.sum("n").alias("n"), F.min("file").alias("file"))
    points = points.withColumn("cuts", cuts).withColumn("range", _range()).drop("cuts")

    version = (F.col("n") > 0).cast("long")
    ranges = points.groupBy("range").agg(F.sum("n").alias("n"), F.sum(version).alias("m"), F.min("file").alias("file"))
    every = Window.orderBy(F.desc("range"))  # RANGES rows at most
    over = every.rowsBetween(Window.unboundedPreceding, -1)
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = ranges.select(
        "range",
        F.sum("n").over(over).alias("_n"),
        F.sum("m").over(over).alias("_m"),
        F.min("file").over(over).alias("_file"),
        F.sum("m").over(whole).alias("versions"),
    )
    within = Window.partitionBy("range").orderBy(F.desc("known"), F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    points = points.select(
        "*",
        F.sum("n").over(within).alias("_above"),
        F.sum(version).over(within).alias("_higher"),
        F.min("file").over(within).alias("_first"),
    )
    none = F.lit(0)
    return points.join(ranges, "range").select(
        *POINT,
        "n",
        "file",
        (F.coalesce("_above", none) + F.coalesce("_n", none)).alias("above"),
        (F.coalesce("_higher", none) + F.coalesce("_m", none)).alias("higher"),
        F.coalesce("_first", "_file").alias("first"),
        "versions",
    )


def counts_above(scripts: DataFrame, places: DataFrame) -> DataFrame:
    """``places`` with ``n`` and ``first`` of the scripts above the position, where there are any; all of them for NULL."""
    points, own = line(scripts, places), ~F.col("known")
    first = F.when(own, F.coalesce("file", "first")).otherwise(F.col("first"))
    found = points.select(*POINT, (F.col("above") + F.when(own, F.col("n")).otherwise(0)).alias("n"), first.alias("first"))
    return lookup(places.select("*", *_point("position")), found.filter("n > 0"), POINT, "inner").drop(*POINT)


def _pairs(scripts: DataFrame, places: DataFrame, points: DataFrame, start: Column, end: Column) -> DataFrame:
    """``places`` with each script from the place ``start`` to the place ``end`` of falling versions.

    The join is an outer one although each place has a script: the side with the pairs, which the optimizer takes for as small
    as the targets, cannot be broadcast then.
    """
    versions = points.filter("n > 0").select(*POINT, (F.col("higher") + 1).alias("place"))
    files = lookup(scripts.select("*", *_point("version")), versions, POINT, "inner").drop(*POINT)
    wanted = points.select(*POINT, start.alias("_from"), end.alias("_to")).filter("_from <= _to")
    wanted = lookup(places.select("*", *_point("position")), wanted, POINT, "inner").drop(*POINT)
    wanted = wanted.withColumn("_from", F.explode(F.expr(f"sequence(_from, _to, {CHUNK}L)")))
    wanted = wanted.withColumn("place", F.explode(F.expr(f"sequence(_from, least(_from + {CHUNK - 1}, _to))")))
    return lookup(wanted.drop("_from", "_to"), files, ["place"], "left").drop("place")


def pairs_above(scripts: DataFrame, places: DataFrame) -> DataFrame:
    """``places`` with each script above the position; all of them for a NULL position."""
    points = line(scripts, places)
    end = F.when(F.col("known"), F.col("higher")).otherwise(F.col("versions"))
    return _pairs(scripts, places, points, F.lit(1).cast("bigint"), end)


def pairs_up_to(scripts: DataFrame, places: DataFrame) -> DataFrame:
    """``places`` with each script at or below the position; none for a NULL position."""
    scripts, places = scripts.filter("version IS NOT NULL"), places.filter("position IS NOT NULL")
    return _pairs(scripts, places, line(scripts, places), F.col("higher") + 1, F.col("versions"))
