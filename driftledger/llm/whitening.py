"""Whitening of embeddings: exact covariances from bit planes, components by falling variance."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftledger.llm.common import stored

#: An entry c becomes the integer floor(SCALE * c) + SHIFT; beyond 2^62 in size it stays at that bound.
SCALE, SHIFT, FAR = 1024.0, 100_000, float(1 << 62)
#: Exact sums leave the tasks in this many parts of so many bits, which add up as longs.
PARTS, BITS = 4, 42
#: Numbers of the scatter matrices that are gathered in one pass; a single length takes a pass however long it is.
MATRIX = 1 << 22


def integers(vectors: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(vectors * SCALE), -FAR, FAR).astype(np.int64) + SHIFT


def planes(y: np.ndarray) -> np.ndarray:
    """[bit, dimension, word]: each dimension's bits of one weight across all rows, 64 rows in a word."""
    n, bits = len(y), max(1, int(y.max()).bit_length())
    rows = np.ascontiguousarray(y.T)
    out = np.zeros((bits, y.shape[1], -(-n // 64) * 8), np.uint8)
    for b in range(bits):
        out[b, :, : -(-n // 8)] = np.packbits(((rows >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=1)
    return out.view(np.uint64)


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, cross-products) of the columns of ``x``, exact Python integers.

    The least value of each column is taken off first, so the planes are those of small numbers without sign. Two planes
    have as many ones in common as their AND has; weighted by both bits' values these counts are the cross-products.
    """
    n, d = x.shape
    least = x.min(axis=0)
    packed = planes((x - least).view(np.uint64))
    bits = len(packed)
    # Whether the largest sum of products fits into 64 bits; if not, Python's integers take over.
    kind = np.int64 if 2 * bits + n.bit_length() < 63 else object
    weighted = lambda counts, b: counts.astype(kind) * (1 << b)
    sums = sum(weighted(np.bitwise_count(p).sum(axis=1, dtype=np.int64), b) for b, p in enumerate(packed)).astype(object)
    products = np.zeros((d, d), kind)
    step = max(1, (1 << 20) // (d * packed.shape[2]))
    for b in range(bits):
        for c in range(b + 1):
            counts = np.vstack([np.bitwise_count(packed[b, i : i + step, None] & packed[c, None]).sum(axis=2, dtype=np.int64) for i in range(0, d, step)])
            products += weighted(counts if b == c else counts + counts.T, b + c)
    least = least.astype(object)
    raw = products.astype(object) + np.outer(least, sums) + np.outer(sums, least) + n * np.outer(least, least)
    return sums + n * least, raw


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch["dim"].to_numpy()
    for d in np.unique(dims):
        yield int(d), batch.filter(pa.array(dims == d))


def scatters(sound: DataFrame) -> DataFrame:
    """(dim, i, j, p0..p3) for j >= i: the exact sum of x_i * x_j over all rows of a length, in parts; i = -1 has the sums of
    x_j, and i = j = -1 the number of rows."""
    mask = (1 << BITS) - 1
    names = [f"p{k}" for k in range(PARTS)]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for d, rows in _by_length(batch):
                sums, products = scatter(integers(_matrix(rows["v"])))
                was = found.get(d, [0, 0, 0])
                found[d] = [was[0] + rows.num_rows, was[1] + sums, was[2] + products]
        for d, (n, sums, products) in found.items():
            for i in range(-2, d):
                values = [n] if i == -2 else list(sums) if i == -1 else list(products[i, i:])
                first = -1 if i == -2 else max(i, 0)
                parts = [[v >> BITS * k if k == PARTS - 1 else v >> BITS * k & mask for v in values] for k in range(PARTS)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d] * len(values), pa.int32()), pa.array([max(i, -1)] * len(values), pa.int32()), pa.array(range(first, first + len(values)), pa.int32()), *[pa.array(p, pa.int64()) for p in parts]],
                    names=["dim", "i", "j", *names],
                )

    each = sound.select("dim", "v").mapInArrow(gather, "dim int, i int, j int, " + ", ".join(f"{c} long" for c in names))
    return each.groupBy("dim", "i", "j").agg(*[F.sum(c).alias(c) for c in names])


class Fit:
    """Mean and components of one length, from exact sums."""

    def __init__(self, n: int, sums: np.ndarray, products: np.ndarray, k: int):
        self.n = n
        # x = base + z with 0 <= sum of z < n: small numbers, whatever the shift.
        self.base = np.array([s // n for s in sums], object)
        self.rest = sums - n * self.base
        centred = n * products - np.outer(sums, sums)
        covariance = np.array(centred / (n * n), np.float64)
        values, vectors = np.linalg.eigh(covariance)
        kept = [c for c in np.argsort(-values, kind="stable")[:k] if values[c] > len(values) * np.finfo(float).eps * values.max()]
        self.axes = vectors[:, kept] / np.sqrt(values[kept])
        self.explained = [float(values[c] / np.trace(covariance)) for c in kept]

    def whiten(self, x: np.ndarray) -> tuple[list[int], np.ndarray]:
        """(sum over dimensions of (n * x - S)^2, exact; projections on the components) of each row."""
        z = x - self.base.astype(np.int64)
        far, d = max(1, abs(int(z.min())), abs(int(z.max()))), x.shape[1]
        exact = lambda most: np.int64 if d * far * most < 1 << 62 else object
        squares = (z.astype(exact(far)) ** 2).sum(axis=1)
        kind = exact(max(int(r) for r in self.rest) or 1)
        shared = (z.astype(kind) * self.rest.astype(kind)).sum(axis=1)
        own = sum(int(r) ** 2 for r in self.rest)
        deviation = [self.n * (self.n * int(s) - 2 * int(r)) + own for s, r in zip(squares, shared, strict=True)]
        return deviation, (z - np.array(self.rest / self.n, np.float64)) @ self.axes


def _fits(sound: DataFrame, k: int) -> dict[int, Fit]:
    """Sums of one pass, brought to the driver: as many numbers as the scatter matrices of these lengths have, whatever the
    number of rows."""
    found = scatters(sound).toPandas()
    value = sum(found[f"p{p}"].astype(object) * (1 << BITS * p) for p in range(PARTS))
    fits = {}
    for d, rows in found.assign(value=value).groupby("dim"):
        i, j, v = rows["i"].to_numpy(), rows["j"].to_numpy(), rows["value"].to_numpy()
        sums, products = np.zeros(d, object), np.zeros((d, d), object)
        own = (i == -1) & (j >= 0)
        sums[j[own]] = v[own]
        products[i[i >= 0], j[i >= 0]] = v[i >= 0]
        products[j[i >= 0], i[i >= 0]] = v[i >= 0]
        fits[int(d)] = Fit(int(v[j == -1][0]), sums, products, k)
    return fits


def _identity_error(rows: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """The largest absolute entry of the covariance of the whitened rows minus the identity, for each length."""
    k = max(len(f.explained) for f in fits.values())
    at = lambda a: F.get("w", F.lit(a))
    pairs = [(a, b) for a in range(k) for b in range(a + 1)]
    sums = rows.groupBy("dim").agg(F.count("*").alias("n"), *[F.sum(at(a)).alias(f"s{a}") for a in range(k)], *[F.sum(at(a) * at(b)).alias(f"s{a}_{b}") for a, b in pairs])
    found = {}
    for r in sums.collect():
        own = [(a, b) for a, b in pairs if a < len(fits[r["dim"]].explained)]
        found[r["dim"]] = max((abs(r[f"s{a}_{b}"] / r["n"] - r[f"s{a}"] * r[f"s{b}"] / r["n"] ** 2 - (a == b)) for a, b in own), default=0.0)
    return found


def _sound() -> Column:
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col("v").isNotNull() & (F.size("v") > 0) & finite


def _whitened(sound: DataFrame, k: int) -> DataFrame:
    fits = _fits(sound, k)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows in _by_length(batch):
                fit = fits[d]
                deviation, w = fit.whiten(integers(_matrix(rows["v"])))
                fitting = [Decimal(v) if v < 10**38 else None for v in deviation]
                n = pa.array([fit.n] * len(w), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [rows["vec_id"], rows["dim"], n, pa.array(fitting, pa.decimal128(38, 0)), pa.array(list(w), pa.list_(pa.float64()))], names=["vec_id", "dim", "n", "deviation", "w"]
                )

    rows = stored(sound.mapInArrow(project, "vec_id long, dim int, n long, deviation decimal(38,0), w array<double>"))
    errors = _identity_error(rows, fits)
    by_dim = lambda values: F.create_map(*[F.lit(x) for d, v in values.items() for x in (d, v)])[F.col("dim")]
    explained = by_dim({d: f.explained for d, f in fits.items()})
    each = rows.select("*", explained.alias("shares"), by_dim(errors).alias("identity_error"), F.posexplode("w").alias("at", "whitened"))
    return each.select("vec_id", "dim", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.get("shares", F.col("at")).alias("explained"), "identity_error")


def whiten(vectors: DataFrame, k: int = 8) -> DataFrame:
    """(vec_id, dim, component, n, deviation, whitened, explained, identity_error): each row's coordinates on the k components
    of largest variance, scaled to variance 1.

    Entries become integers (see SCALE). Every task packs the bits of its rows into words, dimension by dimension, and counts
    the ones of all pairs of planes, which gives exact sums and cross-products; they are added up in Spark, centred as
    integers and divided once. The eigenvectors of that matrix, whose size depends on the dimensions only, are found on the
    driver and sent to the tasks. All rows are fitted; there is no sample.

    Rows whose vector is null, empty, or holds null or non-finite entries are dropped. Vectors of one length are a fit list of
    their own (``dim``), with n, components and identity_error of their own; lengths are handled in passes of bounded size.
    Components without variance beyond rounding are left out, so equal vectors, or a single one, give no rows. Repeated rows
    and rows without vec_id count like others. ``deviation`` is a decimal, null above 38 digits. Other columns are ignored.
    """
    parts = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    sound = parts.where(_sound()).withColumn("dim", F.size("v"))
    passes: list[list[int]] = []
    for (d,) in sorted(sound.select("dim").distinct().collect()):
        if passes and sum(x * x for x in passes[-1]) + d * d <= MATRIX:
            passes[-1].append(d)
        else:
            passes.append([d])
    found = [_whitened(sound.where(F.col("dim").isin(dims)) if len(passes) > 1 else sound, k) for dims in passes]
    if not found:
        kinds = "vec_id long, dim int, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], kinds)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
