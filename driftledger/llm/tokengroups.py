"""Jaccard join of documents by n-grams: a token-group matrix, whose groups are opened only where their bound allows it."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftledger.llm import hashing
from driftledger.llm.common import stored
from driftledger.llm.neardup import components

SHINGLE = 3
#: Documents are linked if PER * intersection >= SHARE * union.
SHARE, PER = 90, 100
#: Classes of shingles beyond those that two linked sets may differ in, so that one that is empty proves nothing.
SPARE = 2
#: About as many members, and shingles of all members, as a group has; and queries that meet a group in one task.
MEMBERS, TOKENS, QUERIES = 64, 1 << 18, 256
_SEED = np.uint64(0xD6E8FEB86659FD93)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the three-word shingles; of the whole sequence if it is shorter; none without words."""
    h = hashing.hashes(hashing.words(text, lower=True))
    return np.unique(hashing.runs(h, SHINGLE) if len(h) >= SHINGLE else hashing.runs(h, len(h), 64) if len(h) else h)


def fingerprint(found: np.ndarray) -> bytes:
    spread = hashing.mixed(found)
    return np.array([spread.sum(), np.bitwise_xor.reduce(spread * spread), len(found)], np.uint64).tobytes()


@cache
def _interval(number: int) -> tuple[int, int]:
    """(first size of this interval of sizes, the most shingles that are in one only of two linked sets, the smaller of which
    is in it). The larger one is in the same interval or the next."""
    first = 1 if number == 0 else _after(_interval(number - 1)[0])
    most = _after(first) - 1
    return first, (most + most * PER // SHARE) * (PER - SHARE) // (PER + SHARE)


def _after(first: int) -> int:
    return first * PER // SHARE + 1


@cache
def interval(size: int) -> int:
    number = 0
    while _interval(number + 1)[0] <= size:
        number += 1
    return number


@cache
def _classes(number: int) -> tuple[np.ndarray, np.ndarray]:
    """For sets whose smaller one is in this interval: the least hash of each class, and a number that names it."""
    n = _interval(number)[1] + 1 + SPARE
    return np.array([(c << 64) // n for c in range(n)], np.uint64), np.uint64(number << 40) + np.arange(n, dtype=np.uint64)


def probes(found: np.ndarray) -> np.ndarray:
    """Hashes of which two linked, unequal sets have at least one in common.

    Sets whose smaller one is in a given interval differ in at most d shingles. All shingles are dealt by their hash into
    d + 1 + SPARE classes; so in 1 + SPARE classes at least two linked sets are equal. A set with at most SPARE empty
    classes names its others only, as one of them must be equal; a set with more names all.
    """
    own, out = interval(len(found)), []
    before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashing.mixed(found ^ _SEED), dtype=np.uint64)])
    for number in (own - 1, own):
        if number < 0 or not _interval(number)[1]:
            continue
        least, names = _classes(number)
        # Classes are ranges of hashes, so they are slices of the sorted set.
        edges = np.append(np.searchsorted(found, least), len(found))
        sums = before[edges[1:]] - before[edges[:-1]]
        names = hashing.mixed(sums * _SEED + names)
        filled = edges[1:] > edges[:-1]
        out.append(names[filled] if (~filled).sum() <= SPARE else names)
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _likeness(found: np.ndarray) -> int:
    """The least hash and the interval of sizes, in one number: alike for most linked sets, seldom for others."""
    least = hashing.mixed(found ^ ~_SEED).min(keepdims=True)
    return int(hashing.mixed(least + np.uint64(interval(len(found)))).view(np.int64)[0])


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, fingerprint, likeness, probes) of each document."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                found = shingles(text.as_py())
                rows.append((len(found), fingerprint(found), _likeness(found), probes(found).view(np.int64)) if len(found) else (0, None, None, None))
            n, prints, alike, names = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].cast(pa.int64()), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(alike, pa.int64()), pa.array(names, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "fingerprint", "likeness", "probes"],
            )

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n_shingles long, fingerprint binary, likeness long, probes array<long>")


def _found(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(fingerprint, likeness, found): the sorted shingle hashes of the texts of some ids, the least that can be broadcast."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [found for found in map(shingles, batch["text"].to_pylist()) if len(found)]
            columns = [pa.array([fingerprint(f) for f in sets], pa.binary()), pa.array([_likeness(f) for f in sets], pa.int64()), pa.array([f.tobytes() for f in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["fingerprint", "likeness", "found"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    return texts.join(ids, "doc_id", "left_semi").mapInArrow(collect, "fingerprint binary, likeness long, found binary")


def _dealt(rows: DataFrame, deals: DataFrame) -> DataFrame:
    """``rows`` with their group: sets that are alike, in as many groups as ``deals`` (likeness, deals) says, or one."""
    dealt = rows.join(deals, "likeness", "left")
    return dealt.withColumn("gid", F.xxhash64("likeness", F.pmod(F.xxhash64("fingerprint"), F.coalesce("deals", F.lit(1))))).drop("deals", "likeness")


def matrix(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(gid, members, sizes, tokens, bits): a row of the matrix for each group, from (gid, fingerprint, found) and (gid,
    fingerprint, node). ``tokens`` is the sorted union of the members' shingles, and ``bits`` tells which member has which
    of them. Rows of one doc_id may have several texts, so sets that are no node's go."""

    def build(sets: pa.Table, known: pa.Table) -> pa.Table:
        nodes = dict(zip(known["fingerprint"].to_pylist(), known["node"].to_pylist(), strict=True))
        by = {nodes[p]: np.frombuffer(f.as_buffer(), np.uint64) for p, f in zip(sets["fingerprint"].to_pylist(), sets["found"], strict=True) if p in nodes}
        kinds = {"gid": pa.int64(), "members": pa.list_(pa.int64()), "sizes": pa.list_(pa.int64()), "tokens": pa.binary(), "bits": pa.binary()}
        values: dict[str, list] = {name: [] for name in kinds}
        if by:
            tokens = np.unique(np.concatenate(list(by.values())))
            rows = np.zeros((len(by), len(tokens)), bool)
            for row, own in zip(rows, by.values(), strict=True):
                row[np.searchsorted(tokens, own)] = True
            values = {"gid": [known["gid"][0].as_py()], "members": [list(by)], "sizes": [[len(f) for f in by.values()]], "tokens": [tokens.tobytes()], "bits": [np.packbits(rows, axis=1).tobytes()]}
        return pa.table({name: pa.array(values[name], kind) for name, kind in kinds.items()})

    rows = found.groupBy("gid").cogroup(nodes.select("gid", "fingerprint", "node").groupBy("gid"))
    return rows.applyInArrow(build, "gid long, members array<long>, sizes array<long>, tokens binary, bits binary")


def members_of(groups: DataFrame) -> DataFrame:
    """(node, found): the sets that the matrix holds."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members, tokens, bits in zip(batch["members"].to_pylist(), batch["tokens"], batch["bits"], strict=True):
                tokens = np.frombuffer(tokens.as_buffer(), np.uint64)
                rows = np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8).reshape(len(members), -1), axis=1, count=len(tokens)).astype(bool)
                yield pa.RecordBatch.from_arrays([pa.array(members, pa.int64()), pa.array([tokens[row].tobytes() for row in rows], pa.binary())], names=["node", "found"])

    return groups.select("members", "tokens", "bits").mapInArrow(unpack, "node long, found binary")


class Opened:
    """One group of the matrix in a task."""

    def __init__(self, members: np.ndarray, sizes: np.ndarray, tokens: bytes, bits: bytes):
        self.members, self.sizes, self.tokens = members, sizes, np.frombuffer(tokens, np.uint64)
        self.bits = np.frombuffer(bits, np.uint8).reshape(len(members), -1)
        self.rows: np.ndarray | None = None

    def linked(self, found: np.ndarray) -> np.ndarray:
        """Which members are linked with the set. The group stays closed if even its union has too few of the shingles."""
        places = np.minimum(np.searchsorted(self.tokens, found), len(self.tokens) - 1)
        places = places[self.tokens[places] == found]
        if PER * len(places) < SHARE * max(len(found), int(self.sizes.min())):
            return np.zeros(len(self.members), bool)
        if self.rows is None:
            self.rows = np.unpackbits(self.bits, axis=1, count=len(self.tokens)).astype(bool)
        same = self.rows[:, places].sum(axis=1)
        return PER * same >= SHARE * (len(found) + self.sizes - same)


def links(pairs: DataFrame, sets: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b): links between the nodes and the members of the groups that ``pairs`` (node, gid) names; enough of them that
    whoever is linked is connected."""
    pieces = pairs.groupBy("gid").agg(F.ceil(F.count("*") / F.lit(QUERIES)).cast("int").alias("pieces"))
    asked = pairs.join(pieces, "gid").select("node", "gid", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int").alias("piece"))
    asked = asked.join(sets.select("node", "found"), "node")
    held = groups.join(pieces, "gid").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        a: list[int] = []
        b: list[int] = []
        if left.num_rows and right.num_rows:
            group = Opened(*(np.array(left[c][0].as_py()) for c in ("members", "sizes")), left["tokens"][0].as_buffer(), left["bits"][0].as_buffer())
            first: dict[int, int] = {}  # a node of the same component, up to the one that stands for it

            def root(x: int) -> int:
                while first.setdefault(x, x) != x:
                    first[x] = first[first[x]]
                    x = first[x]
                return x

            for node, found in zip(right["node"].to_pylist(), right["found"], strict=True):
                for member in group.members[group.linked(np.frombuffer(found.as_buffer(), np.uint64))].tolist():
                    x, y = root(node), root(member)
                    if x != y:
                        first[y] = x
                        a.append(node)
                        b.append(member)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return held.groupBy("gid", "piece").cogroup(asked.groupBy("gid", "piece")).applyInArrow(meet, "a long, b long")


def _others(members: DataFrame, home: DataFrame, comps: DataFrame, asked: DataFrame) -> DataFrame:
    """(node, gid): sets against groups that share a probe with theirs and are not all in their component, one way round.

    Groups are paired first, whatever the number of their members that share a probe; then the members of the smaller one
    are asked.
    """
    known = home.join(comps.withColumnRenamed("uid", "node"), "node", "left").select("node", "gid", F.coalesce("component", "node").alias("comp"))
    known = stored(known)
    there = members.join(known, "node").groupBy("probe", "gid").agg(F.count("*").alias("n"), F.min("comp").alias("x"), F.max("comp").alias("y"))
    there = stored(there)
    mixed = there.groupBy("probe").agg(F.sum("n").alias("n"), F.min("x").alias("x"), F.max("y").alias("y")).where("n > 2 and x <> y").select("probe")
    there = stored(there.drop("n").join(mixed, "probe"))
    other = there.select("probe", F.col("gid").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    pairs = there.join(other, "probe").where("gid < other and not (x = y and ox = oy and x = ox)").select("gid", "other").distinct()
    sizes = known.groupBy("gid").agg(F.count("*").alias("n"), F.min("comp").alias("x"), F.max("comp").alias("y"))
    both = pairs.join(sizes.select("gid", "n"), "gid").join(sizes.select(F.col("gid").alias("other"), F.col("n").alias("m")), "other")
    both = both.select(F.when(F.col("n") <= F.col("m"), F.col("gid")).otherwise(F.col("other")).alias("ask"), F.when(F.col("n") <= F.col("m"), F.col("other")).otherwise(F.col("gid")).alias("gid"))
    each = stored(both).join(known.withColumnRenamed("gid", "ask"), "ask").join(sizes.drop("n"), "gid").where("comp <> x or comp <> y")
    return each.select("node", "gid").join(asked, ["node", "gid"], "left_anti")


def similar(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents with a Jaccard similarity of 0.9 or more on three-word shingles are linked;
    a component is named by its smallest doc_id.

    1. Documents with equal sets are one node. Nodes that are alike form groups, of bounded size, and the matrix has the token
       union of each group.
    2. Which groups can reach the bound for a node? Those with a member that shares a probe (see ``probes``), an exact
       condition. For each, the node's overlap with the group's union bounds that with every member; if it is too small
       the group stays closed, else the members' own columns are compared.
    3. First each node meets its own group and, for each probe, that of the probe's first node. After that only probes whose
       nodes are in several components remain, and there groups meet unless they are in one component.
    So no link is lost but those that join what is joined already.

    A null text, or one without words, has no shingles and is in no link. A row without doc_id is linked with nothing
    (component_id null). Rows that share a doc_id are told apart by their texts. An empty table gives no rows. Other
    columns are not looked at.
    """
    rows = stored(signed(docs))
    usable = rows.where("fingerprint is not null and doc_id is not null")
    nodes = usable.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("likeness").alias("likeness"), F.first("probes").alias("probes"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()))
    probed = nodes.select("node", F.explode("probes").alias("probe"))
    shared = probed.groupBy("probe").agg(F.count("*").alias("n")).where("n > 1").select("probe")
    members = stored(probed.join(shared, "probe"))
    leads = members.groupBy("probe").agg(F.min("node").alias("lead"))

    needed = members.select("node").distinct()
    picked = stored(nodes.drop("probes").join(needed, "node", "left_semi"))
    most = F.greatest(F.ceil(F.count("*") / F.lit(MEMBERS)), F.ceil(F.sum("n_shingles") / F.lit(TOKENS)))
    deals = stored(picked.groupBy("likeness").agg(most.alias("deals")).where("deals > 1"))
    grouped = stored(_dealt(picked, deals))
    groups = stored(matrix(_dealt(_found(docs, stored(picked.select("doc_id").distinct())), deals), grouped))
    sets = members_of(groups)
    home = grouped.select("node", "gid")
    first = members.join(leads, "probe").where("node <> lead").select("node", "lead").distinct().join(home.withColumnRenamed("node", "lead"), "lead").select("node", "gid")
    own = home.join(groups.where("size(members) > 1").select("gid"), "gid", "left_semi").select("node", "gid")
    asked = stored(first.unionByName(own).distinct())
    met = stored(links(asked, sets, groups))
    rest = stored(_others(members, home, components(met), asked))
    comps = components(met.unionByName(links(rest, sets, groups)))

    named = nodes.select("node", "fingerprint", "doc_id").join(comps.withColumnRenamed("uid", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = stored(named.join(least, "component").select("fingerprint", "component_id"))
    out = rows.select("doc_id", "n_shingles", "fingerprint").join(named, "fingerprint", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
