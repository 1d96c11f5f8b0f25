"""Near duplicates by banded MinHash candidates, sequential Bayesian verification and an exact check."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftledger.llm import hashing
from driftledger.llm.common import cut, n_words, stored

SHINGLE = 5
#: Documents are linked if PER * intersection >= SHARE * union.
SHARE, PER = 75, 100
#: A pair at similarity 0.75 shares none of 32 bands of 4 rows with probability 5e-6.
BANDS, ROWS = 32, 4
#: Values of the signature after which a pair may be dropped; those beyond the bands exist for candidates only. And the
#: chance of dropping a similar pair at one of these decisions.
STEPS, MISS = (32, 64, 96, 128, 256, 512), 1e-5
#: Members of a bucket that one task compares with as many others.
BLOCK = 1024


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; of the whole sequence if it is shorter; none without words."""
    h = hashing.hashes(hashing.words(text, lower=True))
    return np.unique(hashing.runs(h, SHINGLE) if len(h) >= SHINGLE else hashing.runs(h, len(h), 64) if len(h) else h)


def _signature(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The low 16 bits of each hash function's minimum; long texts go through in pieces, so memory stays bounded."""
    least = np.full(len(a), ~np.uint64(0))
    for i in range(0, len(found), 2048):
        np.minimum(least, (found[None, i : i + 2048] * a[:, None] + b[:, None]).min(axis=1), out=least)
    return hashing.mixed(least).astype(np.uint16)


def least_agreements(threshold: float = SHARE / PER, steps: tuple[int, ...] = STEPS, miss: float = MISS) -> dict[int, int]:
    """After n compared values, the fewest agreements with which a pair stays.

    With a flat prior the similarity given m of n agreements is Beta(m + 1, n - m + 1), and the chance that it reaches the
    threshold is that of at most m successes in n + 1 trials of that probability. Below ``miss`` a pair is dropped.
    """
    found = {}
    for n in steps:
        below, m = 0.0, -1
        while below < miss:
            m += 1
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        found[n] = m
    return found


def _survivors(x: np.ndarray, y: np.ndarray, rows: np.ndarray, bounds: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows at which ``x`` and ``y`` are compared, batch by batch, those that stay, and all rows' agreements."""
    agree, done = np.zeros(len(y), np.int64), 0
    for n, least in bounds.items():
        if n > y.shape[1]:
            break
        agree[rows] += (x[rows, done:n] == y[rows, done:n]).sum(axis=1)
        rows, done = rows[agree[rows] >= least], n
    return rows, agree


def _functions() -> tuple[np.ndarray, np.ndarray]:
    """Factors and summands of all hash functions, the same in every task."""
    random = np.random.default_rng(20240607)
    a, b = random.integers(0, 1 << 63, (2, STEPS[-1]), dtype=np.uint64)
    return a * np.uint64(2) + np.uint64(1), b


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, fingerprint, signature): 128 values of 16 bits in 32 longs, one for each band."""
    a, b = (x[: BANDS * ROWS] for x in _functions())

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, prints, signs = [], [], []
            for text in batch["text"]:
                found = shingles(text.as_py())
                counts.append(len(found))
                if not len(found):
                    prints.append(None)
                    signs.append(None)
                    continue
                spread = hashing.mixed(found)
                prints.append(np.array([spread.sum(), np.bitwise_xor.reduce(spread * spread), len(found)], np.uint64).tobytes())
                signs.append(_signature(found, a, b).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(prints, pa.binary()), pa.array(signs, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "fingerprint", "signature"],
            )

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n_shingles long, fingerprint binary, signature array<long>")


def _longs(column: pa.Array) -> np.ndarray:
    """Signatures of a batch as a matrix with a column for each band."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), BANDS)


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that the signatures do not rule out, with the number of agreements."""
    bounds = least_agreements()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_longs(batch[c]).view(np.uint16) for c in ("sa", "sb"))
            rows, agree = _survivors(x, y, np.arange(len(x)), bounds)
            yield pa.RecordBatch.from_arrays([batch["a"].take(pa.array(rows)), batch["b"].take(pa.array(rows)), pa.array(agree[rows])], names=["a", "b", "agree"])

    left = nodes.select(F.col("uid").alias("a"), F.col("signature").alias("sa"))
    right = nodes.select(F.col("uid").alias("b"), F.col("signature").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long, agree long")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for i, (x, y) in enumerate(zip(batch["xa"], batch["xb"], strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y)
                same = both - len(np.union1d(x, y))
                if PER * same >= SHARE * (both - same):
                    kept.append(i)
            kept = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch["a"].take(kept), batch["b"].take(kept)], names=["a", "b"])

    left = sets.select(F.col("uid").alias("a"), F.col("found").alias("xa"))
    right = sets.select(F.col("uid").alias("b"), F.col("found").alias("xb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "xa", "xb").mapInArrow(check, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(uid, component): the smallest id reachable from each linked id, by alternating large-star and small-star.

    Both operations only need the smallest neighbour of each id, an aggregate that is combined before the shuffle, so an id
    with very many links is no problem. Edges are written in each round.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large-star: larger neighbours are joined to the smallest of the neighbourhood.
        edges = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = cut(edges)
        # Small-star: smaller neighbours, and the id itself, are joined to the smallest.
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        near = edges.join(low, "u")
        edges = cut(near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("uid"), F.col("v").alias("component"))
        state = now


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs (a, b) that are not in one component."""
    side = lambda c: comps.select(F.col("uid").alias(c), F.col("component").alias(f"c{c}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _across(members: DataFrame, comps: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Likely pairs within buckets whose members are in several components, between components.

    A bucket's first member has been compared with all others already. The others are dealt into blocks; each pair of blocks
    is compared in one task, where only the pairs that the signatures allow come out.
    """
    bounds = least_agreements()
    known = members.join(comps, "uid", "left").withColumn("comp", F.coalesce("component", "uid")).drop("component")
    bucket = ["band", "key"]
    mixed = known.groupBy(*bucket).agg(F.count("*").alias("n"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("n > 2 and x <> y")
    rows = known.where("uid <> lead").join(mixed.select(*bucket, "n"), bucket)
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("uid"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("uid", "comp", *bucket, "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    rows = rows.join(nodes.select("uid", "signature"), "uid").join(sets.select("uid", "more"), "uid")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        uid, comp, own = (table[c].to_numpy() for c in ("uid", "comp", "own"))
        bands, band = _longs(table["signature"].chunk(0)), table["band"][0].as_py()
        values = np.hstack([bands.view(np.uint16), np.frombuffer(b"".join(table["more"].to_pylist()), np.uint16).reshape(len(uid), -1)])
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        left, right = [], []
        for x in np.flatnonzero(own == i):
            rows = np.flatnonzero((own == j) & (comp != comp[x]) & ((uid > uid[x]) if i == j else True))
            # A pair that shares several bands is compared in the first of them.
            rows = rows[(bands[rows, :band] != bands[x, :band]).all(axis=1)]
            rows, _ = _survivors(np.broadcast_to(values[x], values.shape), values, rows, bounds)
            left.append(np.minimum(uid[rows], uid[x]))
            right.append(np.maximum(uid[rows], uid[x]))
        join = lambda found: pa.array(np.concatenate(found) if found else [], pa.int64())
        return pa.table({"a": join(left), "b": join(right)})

    return rows.groupBy(*bucket, "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): documents with a Jaccard similarity of 0.75 or more on five-word shingles
    are linked; a component is named by its smallest doc_id, which is kept.

    1. Documents with equal sets are one node, so copies, however many, meet in no comparison.
    2. In each band's bucket every node is compared with the bucket's first. The signatures drop what cannot be similar.
    3. Each node's best candidate is checked on the full sets. Then follow the other candidates of step 2 that would still
       join two components, and last the pairs of other members of a bucket whose members are not in one component.
       So a pair that shares a band is left unchecked only if the signatures rule it out or it would change nothing.

    A null text, or one without words, has no shingles and is in no link. A row without doc_id is linked with nothing
    (component_id null, kept). Rows that share a doc_id and a text have the same result; if the texts differ, each row
    goes with its own text. An empty table gives no rows. Other columns are not looked at.
    """
    signed = stored(signatures(docs))
    usable = signed.where("fingerprint is not null and doc_id is not null")
    nodes = stored(usable.groupBy("fingerprint").agg(F.min("doc_id").alias("uid"), F.first("signature").alias("signature")))
    banded = nodes.select("uid", F.posexplode("signature").alias("band", "key"))
    leads = banded.groupBy("band", "key").agg(F.min("uid").alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = stored(banded.join(leads, ["band", "key"]))
    first = stored(likely(members.where("uid <> lead").select(F.col("lead").alias("a"), F.col("uid").alias("b")).distinct(), nodes))

    needed = stored(members.select("uid").distinct())
    sets = stored(_sets(docs, needed))
    best = stored(first.groupBy("b").agg(F.max_by("a", F.struct("agree", -F.col("a"))).alias("a")).select("a", "b"))
    links = stored(confirmed(best, sets))
    comps = components(links)
    rest = stored(_apart(first.select("a", "b").join(best, ["a", "b"], "left_anti"), comps))
    links = stored(links.unionByName(confirmed(rest, sets)))
    comps = components(links)
    others = stored(_apart(_across(members, comps, nodes, sets).distinct(), comps))
    comps = components(links.unionByName(confirmed(others, sets)))

    found = signed.join(nodes.select("fingerprint", "uid"), "fingerprint", "left").join(comps, "uid", "left")
    smallest = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "uid", "doc_id"))
    return found.select(
        "doc_id", "n_shingles", smallest.alias("component_id"), F.coalesce(F.col("doc_id") == smallest, F.lit(True)).alias("kept")
    )


def _sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(uid, found, more): the sorted shingle hashes, and the rest of the signature, of documents in some candidate pair."""
    a, b = (x[BANDS * ROWS :] for x in _functions())

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py()) for t in batch["text"]]
            more = [_signature(x, a, b).tobytes() for x in found]
            yield pa.RecordBatch.from_arrays([batch["uid"], pa.array([x.tobytes() for x in found], pa.binary()), pa.array(more, pa.binary())], names=["uid", "found", "more"])

    texts = docs.select(F.col("doc_id").cast("long").alias("uid"), "text").join(needed, "uid", "left_semi")
    return texts.mapInArrow(collect, "uid long, found binary, more binary")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest doc_id.

    Of rows that share doc_id and text one stays, whichever comes first; rows that share a doc_id only stay or go together.
    Rows without doc_id stay, and so do all rows without words, which are in no component.
    """
    found = stored(near_duplicates(docs).where("doc_id is not null").select("doc_id", "n_shingles", "kept"))
    dropped = found.where("not kept").select(F.col("doc_id").alias("dropped__")).distinct()
    rows = docs.select(F.struct("*").alias("row__"))
    stay = rows.join(dropped, F.col("row__.doc_id") == F.col("dropped__"), "left_anti")
    repeated = stored(found.where("kept and n_shingles > 0").groupBy(F.col("doc_id").alias("repeated__")).agg(F.count("*").alias("n")).where("n > 1"))
    if not repeated.isEmpty():
        stay = stay.join(repeated, F.col("row__.doc_id") == F.col("repeated__"), "left")
        several = F.coalesce(F.col("n") > 1, F.lit(False)) & (n_words("row__.text") > 0)
        one = stay.where(several).groupBy("row__.doc_id", "row__.text").agg(F.first("row__").alias("row__")).select("row__")
        stay = stay.where(~several).select("row__").unionByName(one)
    return stay.select("row__.*")
