"""Embedding whitening: a distributed covariance whose float32 eigenvectors are refined in higher precision.

Entries are put on a grid of whole numbers, x = floor(SCALE * c). The covariance is that of the distinct x vectors. It is exact:
vectors are centred by the whole numbers next to their mean before they are multiplied, products are sums of whole numbers that
doubles hold without rounding (Python's integers where they would not), partial sums are added as whole numbers, and what the
whole numbers miss of the mean is put right in integers too. Tasks send one row of sums for each dimension, so the driver gets
dimensions x dimensions numbers, whatever the number of vectors.

Eigenvectors of the covariance in float32 are corrected by Ogita-Aishima steps: with R = I - X'X and S = X'AX, formed in extended
precision, X + XE takes the place of X, where E comes from entries of S and R and the gaps of eigenvalues. Eigenvalues that lie too
near to each other for that are clusters: for each the small problem X_J'(A - mI)X_J is solved after a shift by the cluster's mean
m, which shows the gaps that the shift had hidden, and X_J is turned by its eigenvectors. Steps end once corrections no longer
shrink; equal eigenvalues then have some orthonormal basis of their space.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped, and so are vectors of another length
than the commonest (of equally common ones the longest) and those of no entries; entries beyond the range of long become its ends;
rows with a null id or a repeated one keep their own rows; vectors that repeat count once in the fit; vectors of fewer than four
dimensions have as many components; a component without variance (a single vector, or fewer independent ones) has explained 0,
whitened null, and no part in identity_error, which is 0 if there is none with variance; deviation is null where it is beyond long;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import materialize, partitions_for, read_table, release, sum_rows

SCALE, COMPONENTS = 256, 4
ROWS = 1 << 12  # of one product: (2^20)^2 * 2^12 < 2^53
SMALL = 1 << 20
STEPS = 30
LONG = (1 << 63) - 1
Exact = np.longdouble


def grid_vectors(column: pa.Array | pa.ChunkedArray, dims: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(x as rows of long, their row numbers) of the cells that hold `dims` finite entries."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dims)
    cells = column.take(pa.array(rows)).flatten().cast(pa.float64())
    flat = cells.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(rows), dims)
    good = np.isfinite(flat).all(axis=1)
    with np.errstate(over="ignore"):
        whole = np.floor(flat[good] * float(scale))
    x = np.where(whole >= 2.0**63, LONG, np.where(whole < -(2.0**63), -LONG - 1, np.clip(whole, -(2.0**63), 2.0**62 * 1.99).astype(np.int64)))
    return x.astype(np.int64), rows[good]


def _pack(x: np.ndarray) -> list[bytes]:
    """Rows as bytes of the least width that holds them, so that equal rows have equal bytes."""
    out: list[bytes | None] = [None] * len(x)
    most = np.maximum(x.max(axis=1), -(x.min(axis=1) + 1)) if len(x) else np.zeros(0, np.int64)
    for width, low, high in (("<i1", -1, 1 << 7), ("<i2", 1 << 7, 1 << 15), ("<i4", 1 << 15, 1 << 31), ("<i8", 1 << 31, None)):
        for i in np.flatnonzero((most >= low) & (most < high if high else True)).tolist():
            out[i] = x[i].astype(width).tobytes()
    return out


def _unpack(cells: list[bytes], dims: int) -> np.ndarray:
    out = np.zeros((len(cells), dims), np.int64)
    width = np.array([len(c) // dims for c in cells])
    for w in (1, 2, 4, 8):
        at = np.flatnonzero(width == w)
        if len(at):
            out[at] = np.frombuffer(b"".join(cells[i] for i in at.tolist()), f"<i{w}").reshape(-1, dims)
    return out


def _products(x: np.ndarray, centre: list[int]) -> np.ndarray:
    """Sums of products of all two dimensions of x - centre, as Python's integers."""
    total = np.zeros((x.shape[1],) * 2, object)
    mid = np.array(centre, object)
    small = np.abs(x.astype(np.float64) - mid.astype(np.float64)).max(axis=1, initial=0) < SMALL
    near = (x[small] - mid.astype(np.int64)).astype(np.float64) if small.any() else np.zeros((0, x.shape[1]))
    for at in range(0, len(near), ROWS):
        part = near[at : at + ROWS]
        total = total + (part.T @ part).astype(np.int64).astype(object)
    for at in np.flatnonzero(~small).tolist():
        row = x[at].astype(object) - mid
        total = total + row[:, None] * row[None, :]
    return total


@dataclass
class Whitening:
    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, the greatest first
    vectors: np.ndarray  # columns
    trace: float

    @property
    def found(self) -> int:
        """Components with variance: those above what rounding leaves of an eigenvalue that is 0."""
        return int((self.values > self.trace * len(self.values) * 2.0**-50).sum())

    def whiten(self, x: np.ndarray, components: int) -> np.ndarray:
        """x - S/n on the components over the square roots of their eigenvalues; only components with variance."""
        k = min(components, self.found)
        return self.centred(x) @ (self.vectors[:, :k] / np.sqrt(self.values[:k]))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: exact up to the whole number next to S/n, whose remainder is taken off as a double."""
        mid = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        rest = np.array([(s - m * self.n) / self.n for s, m in zip(self.sums, mid)])
        whole = x.astype(np.float64) - np.array(mid, np.float64) if np.abs(x.astype(np.float64)).max(initial=0) > 2.0**52 else (x - np.array(mid, np.int64)).astype(np.float64)
        return whole - rest

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2 by 64-bit integers, whose overflow cancels out where the sum is no more than long holds."""
        with np.errstate(over="ignore"):
            about = ((float(self.n) * x.astype(np.float64) - np.array(self.sums, np.float64)) ** 2).sum(axis=1)
            wrap = np.array([s & (2 * LONG + 1) for s in self.sums], np.uint64)
            off = x.view(np.uint64) * np.uint64(self.n & (2 * LONG + 1)) - wrap
            total = (off * off).sum(axis=1)
        safe = about < 2.0**62
        out: list[int | None] = total.astype(np.int64).tolist()
        for i in np.flatnonzero(~safe).tolist():
            exact = sum((self.n * int(v) - s) ** 2 for v, s in zip(x[i].tolist(), self.sums))
            out[i] = exact if exact <= LONG else None
        return out


def _turned(a: np.ndarray, x: np.ndarray, groups: list[np.ndarray], refine: bool) -> np.ndarray:
    """x with the columns of each group turned to the eigenvectors of the small problem that the group spans.

    refine: the group's own eigenvectors are refined in turn, which its shift makes worth while."""
    for j in groups:
        own = x[:, j]
        t = own.T @ a @ own
        mean = np.trace(t) / len(j)
        # of X_J'(A - mI)X_J only what is symmetric counts
        t = t - mean * (own.T @ own)
        t = (t + t.T) / 2
        size = np.abs(t).max()
        if not size > 0:
            continue
        vector = np.linalg.eigh((t / size).astype(np.float64))[1].astype(Exact)
        if refine and len(j) < x.shape[1]:
            vector = refined(t / size, vector, depth=1)[1]
        x[:, j] = own @ vector
    return x


def refined(a: np.ndarray, x: np.ndarray, depth: int = 0, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors) of the symmetric a from approximate eigenvectors x, by Ogita-Aishima steps in the precision of a."""
    size, tiny = len(a), np.finfo(a.dtype).eps
    one = np.eye(size, dtype=a.dtype)
    norm = np.abs(a).sum(axis=1).max()
    turned = 0
    for _ in range(steps):
        r = one - x.T @ x
        s = x.T @ a @ x
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        # of eigenvalues that are nearer than this, or than rounding can tell, a step can't tell the vectors
        near = 2 * (np.sqrt((off**2).sum()) + norm * np.sqrt((r**2).sum())) + 8 * size * tiny * norm
        order = np.argsort(values)
        cuts = np.flatnonzero(np.diff(values[order]) > near) + 1
        groups = [g for g in np.split(order, cuts) if len(g) > 1]
        apart = ~np.eye(size, dtype=bool)
        for g in groups:
            apart[np.ix_(g, g)] = False
        with np.errstate(divide="ignore", invalid="ignore"):
            e = np.where(apart, (s + values[None, :] * r) / (values[None, :] - values[:, None]), r / 2)
        x = x + x @ e
        if np.abs(e).max() < 8 * size * tiny and (not groups or turned > 1 or depth):
            break
        if groups and not depth:
            x = _turned(a, x, groups, refine=turned > 0)
            turned += 1
    for _ in range(4):  # what the last step left
        r = one - x.T @ x
        if np.abs(r).max() < 8 * size * tiny:
            break
        x = x + x @ r / 2
    values = np.diag(x.T @ a @ x) / np.diag(x.T @ x)
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order]


def eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, the greatest first, and unit eigenvectors of the symmetric a: float32 ones, refined."""
    size = np.abs(a).max(initial=0)
    if not size > 0:
        return np.zeros(len(a)), np.eye(len(a))
    scaled = a / size
    first = np.linalg.eigh(scaled.astype(np.float32))[1].astype(Exact)
    values, vectors = refined(scaled, first)
    return (values * size).astype(np.float64), vectors.astype(np.float64)


def _ratio(numbers: np.ndarray, divisor: int) -> np.ndarray:
    """Whole numbers over a divisor, rounded to the extended precision: a double and what it misses."""
    out = np.zeros(numbers.shape, Exact)
    for at, v in np.ndenumerate(numbers):
        high = v / divisor
        p, q = high.as_integer_ratio()
        out[at] = Exact(high) + Exact((int(v) * q - p * divisor) / (divisor * q))
    return out


def _common_length(df: DataFrame, vector: Column) -> int:
    sizes = df.where(vector.isNotNull()).groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n")).where("d > 0")
    top = sizes.orderBy(F.desc("n"), F.desc("d")).head()
    return int(top["d"]) if top else 0


def distinct_grid(df: DataFrame, vector: Column, dims: int, scale: float) -> DataFrame:
    """cell: each distinct x vector, packed. Copies meet within tasks first, so many of them are no large group."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = _pack(grid_vectors(batch.column(0), dims, scale)[0])
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.binary())], ["cell"])

    return df.select(vector.alias("v")).mapInArrow(pack, "cell binary").groupBy("cell").agg(F.lit(1).alias("_")).select("cell")


def fit(cells: DataFrame, dims: int) -> Whitening | None:
    """The whitening of distinct x vectors (cell, as distinct_grid packs them); None without any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dims, object), 0
        for batch in batches:
            x = _unpack(batch.column(0).to_pylist(), dims)
            n += len(x)
            safe = len(x) == 0 or np.abs(x.astype(np.float64)).max() * len(x) < 2.0**62
            total = total + (x.sum(axis=0) if safe else x.astype(object).sum(axis=0)).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([",".join(map(str, [n, *total]))], pa.string())], ["i", "cells"])

    merged = sum_rows(cells.mapInArrow(count, "i int, cells string"), "i", 1)
    n, *sums = merged[0] if merged else [0]
    if not n:
        return None
    centre = [(2 * s + n) // (2 * n) for s in sums]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims), object)
        for batch in batches:
            total = total + _products(_unpack(batch.column(0).to_pylist(), dims), centre)
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([",".join(map(str, row)) for row in total], pa.string())], ["i", "cells"])

    products = np.array(sum_rows(cells.mapInArrow(multiply, "i int, cells string"), "i", min(dims, partitions_for(cells.sparkSession, 0, 1))), object)
    rest = np.array([s - n * c for s, c in zip(sums, centre)], object)
    covariance = _ratio(n * products - rest[:, None] * rest[None, :], n * n)
    values, vectors = eigenvectors(covariance)
    return Whitening(n, sums, np.maximum(values, 0), vectors, float(np.trace(covariance)))


def identity_error(cells: DataFrame, model: Whitening, components: int) -> float:
    """Largest absolute entry of the whitened vectors' covariance over the fit list minus the identity."""
    k, dims = min(components, model.found), len(model.sums)
    if not k:
        return 0.0
    shared = cells.sparkSession.sparkContext.broadcast(model)  # dims x dims numbers

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mean = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            w = shared.value.whiten(_unpack(batch.column(0).to_pylist(), dims), k)
            total += w.T @ w
            mean += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([float(v)], pa.float64()) for v in [*total.reshape(-1), *mean]], [f"s{i}" for i in range(k * k + k)])

    names = [f"s{i}" for i in range(k * k + k)]
    row = np.array(cells.mapInArrow(spread, ", ".join(f"{c} double" for c in names)).agg(*[F.sum(c) for c in names]).head(), float)
    total, mean = row[: k * k].reshape(k, k) / model.n, row[k * k :] / model.n
    return float(np.abs(total - mean[:, None] * mean[None, :] - np.eye(k)).max())


RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten_embeddings(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for each vector and component up to `components`."""
    kind = dict(df.dtypes)[id_col]
    vector = F.col(vector_col)
    schema = f"vec_id {kind}, {RESULT}"
    dims = _common_length(df, vector)
    model = None
    if dims:
        cells = materialize(distinct_grid(df, vector, dims, scale), "cells")
        model = fit(cells, dims)
        error = identity_error(cells, model, components) if model else 0.0
        release(cells)
    if not model:
        return df.sparkSession.createDataFrame([], schema)
    shared = df.sparkSession.sparkContext.broadcast(model)
    shown = min(components, dims)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        k = min(own.found, shown)
        share = [float(own.values[c] / own.trace) if c < k else 0.0 for c in range(shown)]
        for batch in batches:
            x, rows = grid_vectors(batch.column(1), dims, scale)
            w = np.full((len(x), shown), np.nan)
            w[:, :k] = own.whiten(x, shown)
            ids = batch.column(0).take(pa.array(np.repeat(rows, shown)))
            deviation = [d for d in own.deviation(x) for _ in range(shown)]
            flat = w.reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [
                    ids, pa.array(np.tile(np.arange(1, shown + 1, dtype=np.int32), len(x))), pa.array(np.full(len(flat), own.n, np.int64)), pa.array(deviation, pa.int64()),
                    pa.array(flat, pa.float64(), mask=np.isnan(flat)), pa.array(share * len(x), pa.float64()), pa.array(np.full(len(flat), error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return df.select(F.col(id_col).alias("vec_id"), vector.alias("v")).mapInArrow(project, schema)


def op13_refined_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten_embeddings(read_table(spark, sf_dir, "embeddings"))
