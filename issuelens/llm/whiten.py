"""Embedding whitening from an exact, bit-sliced scatter matrix.

Entries become integers x = floor(scale * c) + offset.  Per block of rows each dimension's x is shifted by its smallest
value there and cut into bit planes; a plane is packed across the rows into 64-bit words.  The cross-product of two
dimensions is the sum over their planes p, q of 2^(p+q) times the number of rows that have both bits, which is the
popcount of the two planes' AND.  The shift is undone with the exact sums.  A block's products fit 64 bits by choice of
its planes (wider entries go through Python integers), a task adds its blocks exactly, and tasks are added by Spark:
each number travels as limbs of 40 bits, so no sum overflows or rounds however many rows there are.

The driver receives one number per pair of dimensions, D (D + 1) / 2 in all, whatever the number of rows.  They are
centred as integers (n * sum(x_i x_j) - S_i S_j), and only then become doubles for ``eigh``.  The projection, D times at
most ``limit`` numbers, travels back inside the function that whitens the rows.

Edge cases: rows whose vector is null, holds null or non-finite entries, or entries beyond +-2^61 / scale (they do
not fit the integers) are dropped, and so are vectors of another length than the most frequent one (of ties, the
longest), which lack entries or have too many; vectors of length 0 only, or no vectors at all, give no rows.  Components
without variance (repeated rows, constant dimensions, fewer rows than dimensions) have whitened 0.0 and explained 0.0
and do not count for ``identity_error``.  Null or repeated ids come back row by row.  Ties among eigenvalues are
resolved by ``eigh``, once on the driver, so all rows share one basis; the sign of a component makes its largest entry
positive.  Other columns pass through by the caller's choice (``keep``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
ROWS = 1 << 14
LIMB = 40
LARGEST = float(1 << 61)


def usable(vectors: DataFrame, vec_col: str, dims: int, scale: int) -> DataFrame:
    """Rows with a vector of ``dims`` finite entries whose integers are safe."""
    v = F.col(vec_col)
    good = F.forall(v, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(LARGEST / scale)))  # NaN compares as largest
    return vectors.where(v.isNotNull() & (F.size(v) == dims) & good)


def dimension(vectors: DataFrame, vec_col: str) -> int:
    """The most frequent length of a vector (of ties, the longest); 0 without vectors."""
    sizes = vectors.where(F.col(vec_col).isNotNull()).groupBy(F.size(vec_col).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    found = sizes.agg(F.max(F.struct("n", "d")).alias("m")).first()["m"]
    return found["d"] if found else 0


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The rows of a list column without nulls as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def integers(rows: np.ndarray, scale: int, offset: int) -> np.ndarray:
    return np.floor(rows * scale).astype(np.int64) + offset


def planes(y: np.ndarray) -> np.ndarray:
    """Bit planes (plane, dimension, word) of non-negative rows (row, dimension), packed across the rows."""
    width = max(int(y.max()).bit_length(), 1)
    pad = -len(y) % 64
    bits = np.empty((width, y.shape[1], (len(y) + pad) // 64), np.uint64)
    column = np.zeros((y.shape[1], len(y) + pad), np.int64)
    column[:, : len(y)] = y.T
    for p in range(width):
        bits[p] = np.packbits((column >> p & 1).astype(np.uint8), axis=1, bitorder="little").view(np.uint64)
    return bits


def products(y: np.ndarray) -> np.ndarray:
    """Exact cross-products of non-negative rows: Python integers where 64 bits could overflow."""
    bits, dims = planes(y), y.shape[1]
    width = len(bits)
    exact = 2 * width + len(y).bit_length() < 63
    out = np.zeros((dims, dims), np.int64 if exact else object)
    for i in range(dims):
        for p in range(width):
            row = bits[p, i]
            if not row.any():
                continue
            both = np.bitwise_count(bits[:, i:] & row).sum(axis=2, dtype=np.int64)  # (plane, dimension)
            for q in range(width):
                out[i, i:] += (both[q] << (p + q)) if exact else both[q].astype(object) * (1 << (p + q))
    return out + np.triu(out, 1).T


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and upper cross-products of integer rows as Python integers."""
    low = x.min(axis=0)
    y = x - low
    t = y.sum(axis=0, dtype=np.int64).astype(object) if int(y.max()) * len(x) < 1 << 62 else y.astype(object).sum(axis=0)
    low = low.astype(object)
    c = products(y).astype(object) + np.outer(low, t) + np.outer(t, low) + len(x) * np.outer(low, low)
    return t + len(x) * low, c


def limbs(value: int) -> list[int]:
    """Parts of 40 bits, lowest first; the last one carries the sign."""
    parts = []
    while not -(1 << LIMB) < value < 1 << LIMB:
        parts.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*parts, value]


@dataclass
class Basis:
    """Everything ``whiten`` needs: n, the sums S, and per component projection, share of the variance; the error."""

    n: int
    sums: list[int]
    projection: np.ndarray  # (dimension, component), divided by sqrt(e); zero columns without variance
    explained: list[float]
    identity_error: float


def fit(vectors: DataFrame, vec_col: str, dims: int, scale: int = SCALE, offset: int = OFFSET, limit: int = COMPONENTS) -> Basis | None:
    """The whitening basis of all usable rows; None without any."""

    def run(batches):
        n, sums, cross = 0, 0, 0
        for b in batches:
            rows = matrix(b.column(0), dims)
            for a in range(0, len(rows), ROWS):
                x = integers(rows[a : a + ROWS], scale, offset)
                s, c = scatter(x)
                n, sums, cross = n + len(x), sums + s, cross + c
        out = []
        if n:
            named = [(-1, -1, n), *[(-1, i, int(sums[i])) for i in range(dims)]]
            named += [(i, j, int(cross[i, j])) for i in range(dims) for j in range(i, dims)]
            out = [(i, j, k, part) for i, j, v in named for k, part in enumerate(limbs(v))]
        columns = list(zip(*out)) or [()] * 4
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["i", "j", "limb", "part"])

    rows = usable(vectors, vec_col, dims, scale).select(F.col(vec_col).cast("array<double>").alias("v"))
    added = rows.mapInArrow(run, "i int, j int, limb int, part long").groupBy("i", "j", "limb").agg(F.sum("part").alias("part"))
    values: dict[tuple[int, int], int] = {}
    for r in added.collect():  # one row per pair of dimensions and limb
        values[r.i, r.j] = values.get((r.i, r.j), 0) + (r.part << (LIMB * r.limb))
    n = values.pop((-1, -1), 0)
    if not n:
        return None
    sums = [values[-1, i] for i in range(dims)]
    centred = [[n * values[min(i, j), max(i, j)] - sums[i] * sums[j] for j in range(dims)] for i in range(dims)]
    return basis(n, sums, centred, limit)


def basis(n: int, sums: list[int], centred: list[list[int]], limit: int) -> Basis:
    """Components of the covariance centred / n^2."""
    dims = len(sums)
    v = np.array([[x / (n * n) for x in row] for row in centred])  # correctly rounded quotients of integers
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    u = u * np.where(u[np.abs(u).argmax(axis=0), np.arange(dims)] < 0, -1.0, 1.0)
    real = e > max(e[0], 0.0) * dims * 8 * np.finfo(float).eps if dims else e > 0
    count = min(limit, dims)
    w = np.where(real, u / np.sqrt(np.where(real, e, 1.0)), 0.0)[:, :count]
    trace = sum(centred[i][i] for i in range(dims)) / (n * n)
    seen = w.T.astype(np.longdouble) @ v.astype(np.longdouble) @ w.astype(np.longdouble)  # the whitened rows' covariance
    use = real[:count]
    error = np.abs(seen - np.eye(count))[np.ix_(use, use)]
    share = [float(x / trace) if ok and trace else 0.0 for x, ok in zip(e[:count], use)]
    return Basis(n, sums, w, share, float(error.max()) if error.size else 0.0)


def squares(a: np.ndarray) -> list[int]:
    """Exact sums of squares of integer rows."""
    top = int(np.abs(a).max()) if a.size else 0
    if top.bit_length() * 2 + a.shape[1].bit_length() < 63:
        return (a * a).sum(axis=1).tolist()
    if top < 1 << 56:
        # Two limbs: a = h * 2^28 + l; the squares of 64 dimensions fit 64 bits.
        h, low = a >> 28, a & ((1 << 28) - 1)
        total = [0] * len(a)
        for k in range(0, a.shape[1], 64):
            p, q = h[:, k : k + 64], low[:, k : k + 64]
            parts = zip((p * p).sum(axis=1).tolist(), (p * q).sum(axis=1).tolist(), (q * q).sum(axis=1).tolist())
            total = [t + (x << 56) + (y << 29) + z for t, (x, y, z) in zip(total, parts)]
        return total
    return [sum(x * x for x in row) for row in a.tolist()]


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", keep: list[str] | None = None,
    scale: int = SCALE, offset: int = OFFSET, limit: int = COMPONENTS,
) -> DataFrame:
    """Usable rows as (id, n, deviation, whitened, explained, identity_error) and the columns ``keep``.

    ``whitened`` and ``explained`` are arrays by component; ``deviation`` is the exact sum of (n x - S)^2 over the dimensions
    as decimal(38, 0), null beyond 38 digits.  Two passes over the table, no shuffle of rows.
    """
    keep = keep or []
    dims = dimension(vectors, vec_col)
    found = fit(vectors, vec_col, dims, scale, offset, limit) if dims else None
    rows = (usable(vectors, vec_col, dims, scale) if found else vectors.where(F.lit(False))).select(
        F.col(vec_col).cast("array<double>").alias("_v"), F.col(id_col).alias("id"), *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)]
    )
    n, sums = (found.n, found.sums) if found else (0, [])
    weight = found.projection if found else np.zeros((0, 0))
    explained = found.explained if found else []
    error = found.identity_error if found else 0.0
    middle = [s // n for s in sums] if n else []  # x is near it: what is left is exact as a double
    rest = np.array([(s % n) / n for s in sums]) if n else np.zeros(0)

    def run(batches):
        for b in batches:
            x = integers(matrix(b.column(0), dims), scale, offset)
            near = x - np.array(middle, np.int64)
            if n * (int(np.abs(near).max(initial=0)) + 1) < 1 << 62:
                deviation = squares(near * n - np.array([s % n for s in sums], np.int64))
            else:
                deviation = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
            white = (near - rest) @ weight
            parts = pa.array(white.reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * weight.shape[1], pa.int32()), parts)
            texts = [str(d) if d < 10**38 else None for d in deviation]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[1:], pa.array(texts, pa.string()), lists], names=[*b.schema.names[1:], "_deviation", "_whitened"]
            )

    out = rows.mapInArrow(run, rows.drop("_v").schema.add("_deviation", "string").add("_whitened", T.ArrayType(T.DoubleType())))
    return out.select(
        "id",
        F.lit(n).cast("long").alias("n"),
        F.col("_deviation").cast("decimal(38,0)").alias("deviation"),
        F.col("_whitened").alias("whitened"),
        F.array(*[F.lit(x) for x in explained]).cast("array<double>").alias("explained"),
        F.lit(error).alias("identity_error"),
        *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)],
    )
