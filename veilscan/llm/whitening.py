"""Whitening of embeddings from bit-sliced cross-products.

Entries are whole numbers x = floor(64 * c) + 1000000. In each batch of rows every dimension is
shifted by its least value there, and its bit planes are packed across rows: bit r of a word says
whether row r has that bit. The cross-product of two dimensions is the sum over pairs of planes
of 2^(a+b) times the set bits of their AND, so it is exact, and so are the shifts back. Tasks
send the sums of their batches in limbs of 40 bits; Spark adds the limbs. The number of sums
depends on the dimensions alone, and only they go to the driver, which centres them as whole
numbers (n * sum(x y) - sum(x) sum(y)) and takes eigenvectors. Rows are then projected where
they lie; nothing is shuffled but sums.

Defined results. A vector that is null, empty or holds a null, NaN or infinite entry is dropped.
So is one whose length is not the most frequent one (the longest of equally frequent ones), as it
has no place in the space. Numbers beyond a long saturate. deviation is null where it does not
fit into a long; deviation_exact (38 digits) has it there. A component without variance (an
eigenvalue at rounding level, e.g. all vectors equal) has whitened null, and explained 0 or, when
nothing varies, null; identity_error is taken over the others. Equal eigenvalues come in the
order of the solver, and the largest entry of a component is positive. Null and repeated ids pass
through, row by row. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: entries are counted in 64ths and shifted
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
LIMB, LIMBS = 40, 5
#: words of an AND of planes held at a time
_WORDS = 1 << 20


def usable(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id and vector of the rows whose vector has only finite entries."""
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    vector = F.col(vec_col).cast("array<double>")
    return rows.select(F.col(id_col).alias("vec_id"), vector.alias("vector")).where(
        F.col("vector").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", bad)
    )


def whole(c: np.ndarray) -> np.ndarray:
    """floor(64 * c) as long, saturated so that the offset fits."""
    with np.errstate(over="ignore"):
        y = np.floor(c * float(SCALE))
    top = float(2**63)
    inside = np.abs(y) < top
    out = np.where(inside, y, 0).astype(np.int64)
    out[~inside & (y > 0)] = 2**63 - 1 - OFFSET
    out[~inside & (y < 0)] = -(2**63)
    return np.minimum(out, 2**63 - 1 - OFFSET)


def planes(u: np.ndarray, bits: int) -> np.ndarray:
    """Bit planes of unsigned numbers packed across rows: (bits, words, dimensions)."""
    rows, dims = u.shape
    words = -(-rows // 64)
    out = np.zeros((bits, words * 8, dims), np.uint8)
    for b in range(bits):
        packed = np.packbits(((u >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=0)
        out[b, : packed.shape[0]] = packed
    # eight bytes of a column make a word; which bit is which row does not matter
    return np.ascontiguousarray(out.reshape(bits, words, 8, dims).transpose(0, 1, 3, 2)).view(np.uint64)[..., 0]


def set_bits_of_ands(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each pair of dimensions, the set bits of the AND of two planes (words, dimensions)."""
    words, dims = p.shape
    out = np.zeros((dims, dims), np.int64)
    step = max(1, _WORDS // (dims * dims))
    for first in range(0, words, step):
        both = p[first : first + step, :, None] & q[first : first + step, None, :]
        out += np.bitwise_count(both).sum(axis=0, dtype=np.int64)
    return out


def cross_products(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and cross-products of the columns of ``y``, as Python integers."""
    low = y.min(axis=0)
    u = y.astype(np.uint64) - low.astype(np.uint64)
    bits = int(u.max()).bit_length()
    p = planes(u, bits)
    rows, dims = y.shape
    sums = np.zeros(dims, object)
    products = np.zeros((dims, dims), object)
    narrow = np.zeros((dims, dims), np.int64)
    small = 2 * bits + rows.bit_length() < 62
    for a in range(bits):
        sums += np.bitwise_count(p[a]).sum(axis=0, dtype=np.int64).astype(object) * (1 << a)
        for b in range(a, bits):
            count = set_bits_of_ands(p[a], p[b])
            if a != b:
                count = count + count.T
            if small:
                narrow += count << (a + b)
            else:
                products += count.astype(object) * (1 << (a + b))
    products += narrow.astype(object)
    low = low.astype(object)
    # shift back: (u + l)(v + m) = uv + l v + m u + l m
    products += np.outer(low, sums) + np.outer(sums, low) + np.outer(low, low) * rows
    return sums + low * rows, products


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


_SUMS = "i int, j int, " + ", ".join(f"l{k} bigint" for k in range(LIMBS))


def _limbs(value: int) -> list[int]:
    """Limbs of 40 bits, the last one signed and as large as it takes."""
    out = [(value >> (LIMB * k)) & ((1 << LIMB) - 1) for k in range(LIMBS - 1)]
    return [*out, value >> (LIMB * (LIMBS - 1))]


def _sum_rows(dims: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of a task: (-1, -1) rows, (-1, j) of a dimension, (i, j) of a product."""
        n, sums, products = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for batch in batches:
            if batch.num_rows:
                s, c = cross_products(whole(_matrix(batch, dims)))
                n, sums, products = n + batch.num_rows, sums + s, products + c
        if not n:
            return
        i, j = np.triu_indices(dims)
        keys = [(-1, -1), *((-1, k) for k in range(dims)), *zip(i.tolist(), j.tolist(), strict=True)]
        values = np.array([_limbs(int(v)) for v in (n, *sums, *products[i, j])], np.int64)
        columns = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32())]
        yield pa.RecordBatch.from_arrays(
            [*columns, *(pa.array(values[:, k]) for k in range(LIMBS))], names=["i", "j", *(f"l{k}" for k in range(LIMBS))]
        )

    return add


class Whitening:
    """Exact sums of the fit list, and its components."""

    def __init__(self, n: int, sums: list[int], products: list[list[int]], components: int = COMPONENTS) -> None:
        dims = len(sums)
        self.n, self.sums, self.dims = n, sums, dims
        centred = np.array([[n * products[i][j] - sums[i] * sums[j] for j in range(dims)] for i in range(dims)], object)
        self.trace = int(np.trace(centred))
        # whole numbers divided by whole numbers: rounded once
        covariance = np.array([[int(v) / (n * n) for v in row] for row in centred])
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[:components]
        vectors = vectors[:, order]
        vectors /= np.sqrt((vectors**2).sum(axis=0))
        largest = np.abs(vectors).argmax(axis=0)
        self.vectors = vectors * np.where(vectors[largest, np.arange(len(order))] < 0, -1.0, 1.0)
        # eigenvalues again from the vectors, in longer numbers
        wide = covariance.astype(np.longdouble)
        self.values = np.array([float(v @ wide @ v) for v in self.vectors.T.astype(np.longdouble)])
        self.varies = self.values > max(values.max(), 0) * dims * np.finfo(float).eps if self.trace else np.zeros(len(order), bool)
        trace = self.trace / (n * n)
        self.explained = [max(v, 0.0) / trace if self.trace else None for v in self.values.tolist()]

    def scaled(self) -> np.ndarray:
        return self.vectors[:, self.varies] / np.sqrt(self.values[self.varies])

    def deviations(self, y: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """n * y - sums by entry as doubles, and the exact sum of their squares of each row."""
        largest = self.n * (int(np.abs(y.astype(object)).max()) if y.size else 0) + max(abs(s) for s in self.sums)
        if largest < 2**50:
            d = y * self.n - np.array(self.sums, np.int64)
            high, low = d >> 25, d & ((1 << 25) - 1)
            parts = [(high * high).sum(axis=1), (high * low).sum(axis=1), (low * low).sum(axis=1)]
            squares = [(a << 50) + (b << 26) + c for a, b, c in zip(*(p.tolist() for p in parts), strict=True)]
            return d.astype(float), squares
        d = y.astype(object) * self.n - np.array(self.sums, object)
        return d.astype(float), [int(s) for s in (d * d).sum(axis=1)]

    def whiten(self, y: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Whitened values of the components that vary, and exact deviations."""
        d, squares = self.deviations(y)
        return (d / self.n) @ self.scaled(), squares


def most_frequent_length(vectors: DataFrame) -> int | None:
    lengths = vectors.groupBy(F.size("vector").alias("dims")).agg(F.count(F.lit(1)).alias("rows"))
    top = lengths.orderBy(F.desc("rows"), F.desc("dims")).first()
    return top and top["dims"]


def fit(vectors: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of all ``vectors`` of ``dims`` entries."""
    sums = vectors.select("vector").mapInArrow(_sum_rows(dims), _SUMS)
    sums = sums.groupBy("i", "j").agg(*(F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)))
    total = {(r["i"], r["j"]): sum(r[f"l{k}"] << (LIMB * k) for k in range(LIMBS)) for r in sums.collect()}
    products = [[total[min(i, j), max(i, j)] for j in range(dims)] for i in range(dims)]
    return Whitening(total[-1, -1], [total[-1, j] for j in range(dims)], products, components)


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of all whitened rows minus the identity."""
    k = int(model.varies.sum())
    if not k:
        return 0.0

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            if batch.num_rows:
                w, _ = model.whiten(whole(_matrix(batch, model.dims)))
                total[0] += w.sum(axis=0)
                total[1:] += w.T @ w
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "v"]
        )

    sums = vectors.select("vector").mapInArrow(moments, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    found = np.zeros((k + 1, k))
    for r in sums.collect():
        found[r["i"], r["j"]] = r["v"]
    found /= model.n
    return float(np.abs(found[1:] - np.outer(found[0], found[0]) - np.eye(k)).max())


def whitened(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row for each usable row and component: vec_id, component, n, deviation, whitened,
    explained, identity_error, deviation_exact."""
    vectors = usable(rows, id_col, vec_col)
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    each = "component int, whitened double, explained double"
    dims = most_frequent_length(vectors)
    if dims is None:
        empty = f"vec_id {id_type}, n bigint, deviation bigint, identity_error double, deviation_exact decimal(38,0), {each}"
        return rows.sparkSession.createDataFrame([], empty).select(_COLUMNS)
    vectors = vectors.where(F.size("vector") == dims)
    model = fit(vectors, dims, components)
    error = identity_error(vectors, model)
    k = len(model.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            w, squares = model.whiten(whole(_matrix(batch, dims)))
            values = np.zeros((batch.num_rows, k))
            values[:, model.varies] = w
            missing = np.broadcast_to(~model.varies, values.shape)
            flat = pa.array(values.ravel(), mask=missing.ravel())
            offsets = pa.array(np.arange(0, values.size + 1, k, dtype=np.int32))
            limbs = np.array([(s >> 62, s & (2**62 - 1)) if s < 2**124 else (-1, 0) for s in squares], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(limbs[:, 0]), pa.array(limbs[:, 1]), pa.ListArray.from_arrays(offsets, flat)],
                names=["vec_id", "high", "low", "whitened"],
            )

    found = vectors.mapInArrow(project, f"vec_id {id_type}, high bigint, low bigint, whitened array<double>")
    decimal = lambda name: F.col(name).cast("decimal(38,0)")
    two62 = F.lit(2**62).cast("decimal(19,0)")
    explained = F.array(*(F.lit(v).cast("double") for v in model.explained))
    return (
        found.select(
            "vec_id",
            F.lit(model.n).cast("bigint").alias("n"),
            F.when(F.col("high").between(0, 1), F.col("high") * F.lit(2**62) + F.col("low")).alias("deviation"),
            F.lit(error).alias("identity_error"),
            F.when(
                F.col("high") >= 0, F.try_add(F.try_multiply(F.col("high").cast("decimal(19,0)"), two62).cast("decimal(38,0)"), decimal("low")).cast("decimal(38,0)")
            ).alias("deviation_exact"),
            F.posexplode("whitened").alias("at", "whitened"),
        )
        .withColumns({"component": F.col("at") + 1, "explained": F.element_at(explained, F.col("at") + 1)})
        .select(_COLUMNS)
    )


_COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"]
