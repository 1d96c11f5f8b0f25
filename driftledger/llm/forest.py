"""Nearest neighbours by a forest of sorted hash strings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftledger.llm.common import stored

#: Trees, and bits of each one's hash strings.
TREES, BITS = 64, 24
#: Share of a block's rows that a query collects as candidates before it stops ascending. On vectors without any clusters
#: (the hardest case, as in the test tables) 0.4 gives a recall of 0.9; clustered vectors need far less.
SHARE = 0.5
#: Rows of a block of the index, and queries that meet it in one task.
ROWS, QUERIES = 16384, 2048


class Forest:
    """Sorted arrays of hash strings over one block of vectors, one array for each tree.

    A bit of a string is the side of a random hyperplane through the block's mean. Rows that share a prefix of any length
    are a range of the sorted array, so a tree needs no nodes: descending is a binary search for ever longer prefixes.
    """

    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 11):
        self.vectors, self.bits = vectors, bits
        self.middle = vectors.mean(axis=0)
        random = np.random.default_rng(seed)
        self.planes = [random.standard_normal((vectors.shape[1], bits)) for _ in range(trees)]
        codes = [self.codes(vectors, t) for t in range(trees)]
        self.order = [np.argsort(c, kind="stable") for c in codes]
        self.sorted = [c[o] for c, o in zip(codes, self.order, strict=True)]

    def codes(self, vectors: np.ndarray, tree: int) -> np.ndarray:
        sides = (vectors - self.middle) @ self.planes[tree] > 0
        return sides @ (1 << np.arange(self.bits - 1, -1, -1))

    def ranges(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[length of the prefix, tree, query]: where the rows that share it begin and end."""
        begin, end = (np.empty((self.bits + 1, len(self.sorted), len(queries)), np.int32) for _ in range(2))
        for t, known in enumerate(self.sorted):
            own = self.codes(queries, t)
            for length in range(self.bits + 1):
                rest = self.bits - length
                begin[length, t] = np.searchsorted(known, own >> rest << rest)
                end[length, t] = np.searchsorted(known, (own >> rest << rest) + (1 << rest) - 1, side="right")
        return begin, end

    def candidates(self, begin: np.ndarray, end: np.ndarray, enough: int) -> np.ndarray:
        """Rows that share the longest prefixes with one query: all trees ascend together, bit by bit, until there are
        enough; on the last level tree by tree."""
        met = np.zeros(len(self.vectors), bool)
        for length in range(self.bits, -1, -1):
            level = [(o, b, e) for o, b, e in zip(self.order, begin[length], end[length], strict=True) if e > b]
            last = sum(e - b for _, b, e in level) >= enough // 2
            for o, b, e in level:
                met[o[b:e]] = True
                if last and met.sum() >= enough:
                    return met
            if met.sum() >= enough:
                return met
        return met


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, share: float = SHARE, trees: int = TREES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose vec_id is divisible by ``every``, by Euclidean
    distance, ties to the smaller vec_id.

    The index covers all rows, dealt into blocks by hash; each block has a forest of its own, built in the task that
    searches it, and gives its k best for a query. So nothing is fitted on a sample, and a task holds one block and one
    chunk of queries. Equal vectors are collected together in every tree; of very many only the k + 1 smallest vec_ids can
    be in a result, so no more than those are indexed. Distances are computed in double precision on the original vectors.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without vec_id and those
    whose length is not the most frequent one. Repeated rows count once; another vector under the query's own vec_id is not
    a candidate. With fewer than k candidates all are returned. An empty table gives no rows; other columns are ignored.
    """
    parts = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    sound = parts.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite)
    size = sound.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    sound = stored(sound.where(F.size("v") == (size.n if size else 0)).dropDuplicates())
    copies = Window.partitionBy("v").orderBy("vec_id")
    index = stored(sound.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy"))
    queries = sound.where(F.col("vec_id") % every == 0)
    blocks, chunks = max(1, -(-index.count() // ROWS)), max(1, -(-queries.count() // QUERIES))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.select("vec_id", "v", deal(blocks).alias("block")).withColumn("chunk", each(chunks))
    right = queries.select("vec_id", "v", deal(chunks).alias("chunk")).withColumn("block", each(blocks))

    def search(rows: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        if rows.num_rows and asked.num_rows:
            rows, asked = rows.sort_by("vec_id"), asked.sort_by("vec_id")
            matrix = lambda t: t["v"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
            x, q, ids, own = matrix(rows), matrix(asked), rows["vec_id"].to_numpy(), asked["vec_id"].to_numpy()
            forest, norms = Forest(x, trees), (x * x).sum(axis=1)
            begin, end = forest.ranges(q)
            enough = min(len(x), max(4 * k, int(np.ceil(share * len(x)))))
            for i in range(len(q)):
                met = np.flatnonzero(forest.candidates(begin[:, :, i], end[:, :, i], enough) & (ids != own[i]))
                near = norms[met] - 2 * (x @ q[i])[met]
                if len(met) > k:  # what is nearest but for rounding; the exact distance decides
                    limit = np.partition(near, k - 1)[k - 1]
                    met = met[near <= limit + 1e-9 * (abs(limit) + norms.max() + 1)]
                exact = np.sqrt(((x[met] - q[i]) ** 2).sum(axis=1))
                for j in np.lexsort((ids[met], exact))[:k]:
                    found.append((own[i], ids[met[j]], exact[j]))
        columns = list(zip(*found, strict=True)) or [[], [], []]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "vec_id", "score"])

    met = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = met.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
