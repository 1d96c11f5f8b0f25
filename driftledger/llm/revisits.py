"""Not-modified revisits of a crawl: what each one stands for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Header fields that a not-modified answer may bring up to date.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Spans of time that each page's captures are dealt into.
SPANS = 4096


def canonical_url(url: Column) -> Column:
    """Scheme, user, ``www`` and fragment go; so do default ports, index pages, closing slashes and tracking parameters.
    The host is lower case. A null stays null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r"^www[0-9]?\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/(index\.[a-z]+)?$", "")
    query = F.regexp_replace(F.regexp_extract(bare, r"\?(.*)$", 1), r"(^|&)(utm_[a-z]+|ref|sessionid|fbclid|gclid)=[^&]*", "")
    query = F.regexp_replace(query, r"^&+", "")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _strong(etag: Column) -> Column:
    """An entity tag for weak comparison: 304 answers may weaken it."""
    return F.regexp_replace(etag, "^W/", "")


def resolve(captures: DataFrame) -> DataFrame:
    """Each revisit with the latest earlier full response of its canonical URL.

    ``captures``: record_id, kind (response or revisit), url, time (long), headers (map with lower-case names), digest. A
    response of the same time is not earlier; of several at one latest time the largest record_id counts. Returns record_id,
    url_key, time, origin_id, verdict, digest, headers:

    - ``unresolved``: no earlier response, or no URL or time. Digest null, headers as they are.
    - ``etag``: both have an ETag and they agree (weak comparison). ``last-modified``: not both have an ETag, both have
      Last-Modified and they agree. ``unchecked``: no validator that both have. In these the digest is the response's and
      the headers are the response's, updated by the permitted ones of the revisit.
    - ``mismatch``: the validators that both have differ; digest null, headers as they are.

    The as-of join is one window: responses and revisits of a URL in the order of time. So that a URL with very many
    captures is not one task, time is dealt into spans: within a span the last response is found by a window, and the last
    one of all earlier spans comes from one row per URL and span. Payloads are not moved. Null headers are empty. Repeated
    rows give repeated results; an empty table gives no rows; other columns are not looked at.
    """
    rows = captures.select(
        "record_id", "kind", canonical_url(F.col("url")).alias("url_key"), F.col("time").cast("long").alias("time"),
        F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), "digest",
    )
    first, last = rows.agg(F.min("time"), F.max("time")).first()
    width = ((last - first) // SPANS + 1) if first is not None else 1
    rows = rows.withColumn("span", F.floor((F.col("time") - F.lit(first or 0)) / F.lit(width)))
    usable = F.col("url_key").isNotNull() & F.col("time").isNotNull()
    origin = F.struct("time", F.col("record_id").alias("id"), "headers", "digest")

    responses = rows.where((F.col("kind") == "response") & usable)
    order = F.struct("time", "record_id")
    ends = responses.groupBy("url_key", "span").agg(F.max_by(origin, order).alias("end"))
    before = Window.partitionBy("url_key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.where(usable).select("url_key", "span").distinct().join(ends, ["url_key", "span"], "left")
    carried = spans.select("url_key", "span", F.last("end", ignorenulls=True).over(before).alias("carried"))

    # Rows of one time see what is strictly earlier: all of them have the same range in the window.
    within = Window.partitionBy("url_key", "span").orderBy("time").rangeBetween(Window.unboundedPreceding, -1)
    newest = F.max(F.when(F.col("kind") == "response", F.struct("time", "record_id"))).over(within)
    seen = rows.where(usable).withColumn("newest", newest).where("kind = 'revisit'").drop("kind")
    own = responses.select(F.col("url_key").alias("u__"), F.col("span").alias("s__"), F.struct("time", "record_id").alias("r__"), origin.alias("inside")).dropDuplicates(["u__", "s__", "r__"])
    met = seen.join(own, (seen["url_key"] == own["u__"]) & (seen["span"] == own["s__"]) & (seen["newest"] == own["r__"]), "left")
    met = met.join(carried, ["url_key", "span"], "left").withColumn("origin", F.coalesce("inside", "carried"))
    met = met.select("record_id", "url_key", "time", "headers", "origin")
    lost = rows.where(~usable & (F.col("kind") == "revisit")).select("record_id", "url_key", "time", "headers", F.lit(None).cast(met.schema["origin"].dataType).alias("origin"))
    met = met.unionByName(lost)

    ours, theirs = F.col("headers"), F.col("origin.headers")
    by = lambda name, of=lambda x: x: (of(ours[name]), of(theirs[name]))
    (tag, tag_before), (date, date_before) = by("etag", _strong), by("last-modified")
    verdict = (
        F.when(F.col("origin").isNull(), "unresolved")
        .when(tag.isNotNull() & tag_before.isNotNull(), F.when(tag == tag_before, "etag").otherwise("mismatch"))
        .when(date.isNotNull() & date_before.isNotNull(), F.when(date == date_before, "last-modified").otherwise("mismatch"))
        .otherwise("unchecked")
    )
    taken = F.col("verdict").isin("etag", "last-modified", "unchecked")
    updates = F.map_filter(ours, lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter(theirs, lambda k, v: ~F.array_contains(F.map_keys(updates), k))
    return met.withColumn("verdict", verdict).select(
        "record_id", "url_key", "time", F.when(F.col("origin").isNotNull(), F.col("origin.id")).alias("origin_id"), "verdict",
        F.when(taken, F.col("origin.digest")).alias("digest"),
        F.when(taken, F.map_concat(kept, updates)).otherwise(ours).alias("headers"),
    )
