"""Claims about database objects against the objects that really exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from driftledger import messages as M
from driftledger.operators.skew import lookup

OBJECT = ["schema", "name", "kind"]
#: Kinds of objects that can be looked for; anything else is an error, not an object that is missing.
KINDS = ("table", "view", "function", "procedure")


def unknown_kinds(claims: DataFrame) -> DataFrame:
    """Claims on objects of no known kind, with ``error``: whether they exist cannot be told."""
    return claims.filter(~_known()).withColumn("error", F.format_string(M.UNKNOWN_KIND, F.coalesce("kind", F.lit(""))))


def _known() -> Column:
    return F.coalesce(F.lower("kind").isin(*KINDS), F.lit(False))


def _keyed(df: DataFrame, ignore_schema: bool, case_sensitive: bool) -> tuple[DataFrame, list[str]]:
    """Add the identity of an object: target, schema, name and kind, or less where a dialect looks at less."""
    parts = ["target", *(c for c in OBJECT if not (ignore_schema and c == "schema"))]
    exact = [c for c in parts if case_sensitive or c == "target"]
    keys = {f"k_{c}": F.col(c) if c in exact else F.lower(F.col(c)) for c in parts}
    return df.withColumns(keys), list(keys)


def _match(claims: DataFrame, objects: DataFrame, how: str, ignore_schema: bool, case_sensitive: bool) -> DataFrame:
    many, keys = _keyed(claims, ignore_schema, case_sensitive)
    there, _ = _keyed(objects, ignore_schema, case_sensitive)
    there = there.select(*keys).distinct()
    if how == "left":
        there = there.withColumn("_there", F.lit(True))
    return lookup(many, there, keys, how).drop(*keys)


def object_exists(
    claims: DataFrame, objects: DataFrame, ignore_schema: bool = False, case_sensitive: bool = True
) -> DataFrame:
    """Claims with a flag ``exists``, which is NULL for an unknown kind."""
    matched = _match(claims, objects, "left", ignore_schema, case_sensitive)
    return matched.withColumn("exists", F.when(_known(), F.col("_there").isNotNull())).drop("_there")


def missing_objects(
    claims: DataFrame, objects: DataFrame, ignore_schema: bool = False, case_sensitive: bool = True
) -> DataFrame:
    """Claims whose object does not exist; for those of an unknown kind see :func:`unknown_kinds`."""
    return _match(claims.filter(_known()), objects, "left_anti", ignore_schema, case_sensitive)


def leftover_objects(
    claims: DataFrame, objects: DataFrame, ignore_schema: bool = False, case_sensitive: bool = True
) -> DataFrame:
    """Claims whose object still exists; for those of an unknown kind see :func:`unknown_kinds`."""
    return _match(claims.filter(_known()), objects, "left_semi", ignore_schema, case_sensitive)


def gone_at() -> Column:
    """Version that dropped an object for good, from its last drop and last create; NULL when it should exist.

    Within one script creates win over drops, whatever their order.
    """
    return F.when(F.col("last_drop") > F.coalesce(F.col("last_create"), F.lit(-1)), F.col("last_drop"))


def drop_lifecycle(created: DataFrame, dropped: DataFrame) -> DataFrame:
    """(target, object, last_create, last_drop, gone_at) from what applied scripts create and drop.

    Two maxima per object stand for replaying the scripts in order; both combine before the shuffle.
    """
    number = F.lit(None).cast("bigint")
    events = created.select("target", *OBJECT, F.col("version").alias("c"), number.alias("d")).unionByName(
        dropped.select("target", *OBJECT, number.alias("c"), F.col("version").alias("d"))
    )
    lives = events.groupBy("target", *OBJECT).agg(F.max("c").alias("last_create"), F.max("d").alias("last_drop"))
    return lives.withColumn("gone_at", gone_at())
