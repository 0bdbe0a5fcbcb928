"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Entries are quantised to integers, x = floor(scale * c) + offset, so sums are exact and a row is centred
without loss: y = (n x - S) / n with the numerator in integers. The centred rows are the matrix Y, which
is never formed as a covariance. One step of the bidiagonalisation is one pass over the rows:

    u = Y v_j - beta u_(j-1)       (alpha = its length)        Y V = U B
    v = Y'u_j - alpha v_j          (beta = its length)         B upper bidiagonal

Both bases are fully reorthogonalised, twice a step. A left vector is as long as the table, so it is kept
as its coefficients w instead, u_j = Y w_j: a task computes Y [w_1 .. w_(j-1), w] for its rows, and returns
the products of the new u with the earlier ones, with itself and with Y, d + j + 1 numbers a task, which
Spark adds up. The first reorthogonalisation needs no pass, since <u_i, Y v> = <Y'u_i, v> is known; the
second takes the products of the pass. A right vector that vanishes (an invariant subspace, as with equal
eigenvalues) is replaced by a fixed pseudo-random one orthogonal to the rest, with beta = 0. Steps end when
the basis is full (d vectors), or, in long vectors, when the residual of every wanted component is below
1e-13 of the largest singular value. The singular value decomposition of the small bidiagonal matrix gives
the components (V Q) and deviations s / sqrt(n).

The driver holds d x steps numbers, never anything of the table's length; rows stay in blocks of packed
integers in the shared folder, and a lost task is computed again from its block.

Edge cases: rows whose vector is null, empty, of another length than most, or holds a null or non-finite
entry return nothing and do not count. Components whose singular value is at most 1e-10 of the largest
(a flat direction, as in a table of one row, of equal rows, or of fewer rows than components) are not
returned, as whitening would divide by nothing. Repeated rows count each. A deviation beyond a long is
null; entries beyond 2^53 / scale are read as that bound. An empty table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import owns_worker, work_dir
from footfall.llm.vectors import matrix, of_one_length, usable

BLOCK_BYTES = 4 << 20     # of a block as doubles
RESULT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
_ROWS = pa.schema([("ids", pa.list_(pa.int64())), ("size", pa.int32()), ("data", pa.binary())])
LEAST = 1e-10             # singular values below this share of the largest count as zero
DONE = 1e-13              # residual of a converged component, as a share of the largest singular value


def pack(values: np.ndarray) -> tuple[int, bytes]:
    """(bytes an entry, entries) in the smallest integer type that holds them."""
    low, high = int(values.min(initial=0)), int(values.max(initial=0))
    for size in (1, 2, 4, 8):
        if -(1 << 8 * size - 1) <= low and high < 1 << 8 * size - 1:
            break
    return size, values.astype(f"<i{size}").tobytes()


class Centred:
    """What a task needs to centre its blocks: the number of rows and the exact sums (both of x - offset,
    as centring takes the offset away again)."""

    def __init__(self, d: int, n: int, sums: list[int]):
        self.d, self.n, self.sums = d, n, sums
        self.top = max(map(abs, sums), default=0)

    def numerators(self, size: int, data: bytes) -> np.ndarray:
        """n x - S of a block's rows: longs, or exact objects where longs would overflow."""
        x = np.frombuffer(data, f"<i{size}").reshape(-1, self.d)
        if self.n * (1 << 8 * size - 1) + self.top < 1 << 63:
            return x.astype(np.int64) * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def rows(self, size: int, data: bytes) -> np.ndarray:
        """Centred rows as doubles."""
        return (self.numerators(size, data) / self.n).astype(np.float64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    owns_worker("whitening")
    for b in batches:
        yield from zip(b.column("ids"), b.column("size").to_pylist(), b.column("data").to_pylist())


def _pack_rows(d: int, scale: int):
    step = max(1, BLOCK_BYTES // (8 * d))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, step):
                piece = b.slice(i, step)
                x = np.floor(np.clip(matrix(piece.column(1), d) * scale, -2.0**53, 2.0**53)).astype(np.int64)
                size, data = pack(x)
                ids = pa.ListArray.from_arrays(pa.array([0, piece.num_rows], pa.int32()), piece.column(0).cast(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([size], pa.int32()), pa.array([data], pa.binary())], schema=_ROWS)

    return run


class Blocks:
    """The table's packed rows in the shared folder, and sums over them."""

    def __init__(self, rows: DataFrame, d: int, scale: int):
        self.spark, self.d = rows.sparkSession, d
        path = f"{work_dir(self.spark, 'whitening')}/rows"
        # small row groups: a reader holds few blocks at once
        rows.mapInArrow(_pack_rows(d, scale), "ids array<long>, size int, data binary").write.option("parquet.block.size", 8 << 20).parquet(path)
        self.table = self.spark.read.schema("ids array<long>, size int, data binary").parquet(path)

    def integer_sums(self) -> list[int]:
        d, schema = self.d, pa.schema([("place", pa.int32()), ("total", pa.decimal128(38, 0))])

        def run(batches):
            from decimal import Decimal
            total = [0] * d
            for _, size, data in _blocks(batches):
                x = np.frombuffer(data, f"<i{size}").reshape(-1, d)
                # sums of the high and low halves cannot overflow
                high, low = (x >> 24).sum(0, dtype=np.int64), (x & 0xFFFFFF).sum(0, dtype=np.int64) if size == 8 else None
                own = [(int(h) << 24) + int(v) for h, v in zip(high, low)] if size == 8 else x.sum(0, dtype=np.int64).tolist()
                total = [a + v for a, v in zip(total, own)]
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([Decimal(x) for x in total], pa.decimal128(38, 0))], schema=schema)

        rows = self.table.mapInArrow(run, "place int, total decimal(38,0)").groupBy("place").agg(F.sum("total").alias("total")).collect()
        return [int(x) for _, x in sorted(rows)]

    def sums(self, per_block, length: int, shared) -> np.ndarray:
        """``per_block(rows, shared)``, ``length`` numbers, added up over all blocks. A task adds its own
        blocks, Spark adds the tasks' sums by place: nothing grows with the number of tasks."""
        value = self.spark.sparkContext.broadcast(shared)
        schema = pa.schema([("place", pa.int32()), ("total", pa.float64())])

        def run(batches):
            centred, given = value.value
            total, seen = np.zeros(length), False
            for _, size, data in _blocks(batches):
                total, seen = total + per_block(centred.rows(size, data), given), True
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(length, dtype=np.int32)), pa.array(total)], schema=schema)

        rows = self.table.mapInArrow(run, "place int, total double").groupBy("place").agg(F.sum("total").alias("total")).collect()
        value.unpersist()
        out = np.zeros(length)
        for place, total in rows:
            out[place] = total
        return out


def _step(y: np.ndarray, given: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Products of u = Y w with the earlier left vectors, with the rows, and with itself."""
    earlier, w = given
    u = y @ w
    return np.concatenate([(y @ earlier).T @ u, y.T @ u, [u @ u]])


def _squares(y: np.ndarray, _) -> np.ndarray:
    return np.array([np.einsum("ij,ij->", y, y)])


def _whitened_moments(y: np.ndarray, axes: np.ndarray) -> np.ndarray:
    z = y @ axes
    return np.concatenate([(z.T @ z).ravel(), z.sum(0)])


def _against(basis: np.ndarray, x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = x - basis @ (basis.T @ x)
    return x


def bidiagonalise(product, d: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(right singular vectors, singular values) of a matrix known by ``product(W, w)``: the products of
    Y w with Y W, with Y itself (Y'Y w) and with itself."""
    draw = np.random.default_rng(11)
    right, coefficients, images = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))
    alphas: list[float] = []
    betas: list[float] = []
    v = draw.standard_normal(d)
    v /= np.linalg.norm(v)
    top = 0.0
    while True:
        # the first reorthogonalisation of u = Y v, by known products
        w = v - coefficients @ (images.T @ v)
        p = product(coefficients, w)
        j = coefficients.shape[1]
        c, image, square = p[:j], p[j:j + d], p[-1]
        alpha = float(np.sqrt(max(square - c @ c, 0.0)))
        top = max(top, alpha)
        right = np.column_stack([right, v])
        if alpha > 1e-300 and alpha > LEAST * 1e-4 * top:
            # the second, by the products of this pass
            coefficients = np.column_stack([coefficients, (w - coefficients @ c) / alpha])
            images = np.column_stack([images, (image - images @ c) / alpha])
            r = _against(right, images[:, -1] - alpha * v)
        else:  # Y v lies in the span of the earlier left vectors: a zero singular direction
            alpha = 0.0
            coefficients, images = np.column_stack([coefficients, np.zeros(d)]), np.column_stack([images, np.zeros(d)])
            r = np.zeros(d)
        alphas.append(alpha)
        m = len(alphas)
        if m == d:
            break
        beta = float(np.linalg.norm(r))
        top = max(top, beta)
        if beta <= 1e-13 * top:
            beta, r = 0.0, _against(right, draw.standard_normal(d))
        elif m >= wanted:
            left, s, _ = np.linalg.svd(_bidiagonal(alphas, betas))
            if beta * np.abs(left[-1, :wanted]).max() <= DONE * s[0]:
                break
        betas.append(beta)
        v = _against(right, r / np.linalg.norm(r))
        v /= np.linalg.norm(v)
    _, s, q = np.linalg.svd(_bidiagonal(alphas, betas))
    return right @ q.T, s


def _bidiagonal(alphas: list[float], betas: list[float]) -> np.ndarray:
    return np.diag(alphas) + np.diag(betas[:len(alphas) - 1], 1)


def _project(value):
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                        ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centred, axes, explained, error = value.value
        k = axes.shape[1]
        step = max(1, (1 << 16) // k)                      # rows of a result batch
        for ids, size, data in _blocks(batches):
            ids = ids.values
            entries = centred.d * size
            for i in range(0, len(ids), step):
                own = ids.slice(i, step)
                part = data[i * entries:(i + len(own)) * entries]
                nominal = centred.numerators(size, part)
                z = (nominal / centred.n).astype(np.float64) @ axes
                at = pa.array(np.repeat(np.arange(len(own)), k))
                yield pa.RecordBatch.from_arrays([
                    own.take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(own))),
                    pa.array(np.full(k * len(own), centred.n)), _squared(nominal).take(at), pa.array(z.ravel()),
                    pa.array(np.tile(explained, len(own))), pa.array(np.full(k * len(own), error))], schema=schema)

    return run


def _squared(x: np.ndarray) -> pa.Array:
    """Exact sum of squares of each row; null beyond a long."""
    if x.dtype != object and int(np.abs(x).max(initial=0)) ** 2 * x.shape[1] < 1 << 63:
        return pa.array((x * x).sum(1))
    exact = (x.astype(object) ** 2).sum(1)
    return pa.array([int(v) if v < 1 << 63 else None for v in exact], pa.int64())


def whiten(df: DataFrame, components: int = 32, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row a usable vector and component: the whitened coordinate, the component's share of the
    variance, the exact deviation of the vector, and the largest error of the whitened covariance.

    The offset of the quantised entries is left out inside: centring takes it away, exactly."""
    spark = df.sparkSession
    rows, d, n, _ = of_one_length(usable(df, id_col, vector_col))
    empty = spark.createDataFrame([], RESULT)
    if not n:
        return empty
    blocks = Blocks(rows, d, scale)
    centred = Centred(d, n, blocks.integer_sums())
    variance = float(blocks.sums(_squares, 1, (centred, None))[0])
    if not variance:
        return empty
    product = lambda earlier, w: blocks.sums(_step, earlier.shape[1] + d + 1, (centred, (earlier, w)))
    axes, s = bidiagonalise(product, d, min(components, d))
    keep = min(components, int((s > LEAST * s[0]).sum()))
    axes, e = axes[:, :keep], s[:keep] ** 2 / n
    axes = axes / np.linalg.norm(axes, axis=0)
    scaled = axes / np.sqrt(e)
    moments = blocks.sums(_whitened_moments, keep * keep + keep, (centred, scaled)) / n
    mean = moments[keep * keep:]
    error = float(np.abs(moments[:keep * keep].reshape(keep, keep) - np.outer(mean, mean) - np.eye(keep)).max())
    shared = spark.sparkContext.broadcast((centred, scaled, e / (variance / n), error))
    return blocks.table.mapInArrow(_project(shared), RESULT)
