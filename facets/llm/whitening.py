"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Vectors become rows of whole numbers; each distinct row counts once. With X the distinct rows less
their mean, two orthonormal bases are built in turn: u from X v, v from X'u, each made orthogonal to
all vectors of its side before it (twice, so that rounding leaves nothing behind). Between the bases
X is a small bidiagonal matrix, whose singular values and right vectors give the deviations and
components of the rows.

u has an entry per row, so it never leaves the executors, nor is it stored: each u lies in the column
space, u = X c, and the coefficients c are as short as a vector. They hold the whole
re-orthogonalisation, as the products of X v with earlier u follow from the X'u already known. One
pass over the rows per step forms u = X c in its blocks and adds up X'u and the length of u; only
these sums, one number per dimension, travel.

Steps end when the wanted components have settled, and a fresh direction orthogonal to all so far has
settled too without changing them (equal deviations need that), or when the space is used up.

Defined cases: a vector that is null, empty, or holds null or non-finite entries is dropped, as is
one whose length is not the commonest (of equally common ones the longest); negative zero counts as
zero; repeated rows get a result each and count once in the fit; directions without deviation have no
component, so a table of one distinct vector, or an empty one, gives no rows; columns beside those
named are left out. The exact deviation of a row is a decimal, as it outgrows a long in large tables.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facets.operators.features import sum_matrices
from facets.session import cut, ship_package

SCALE = 256
SEED = 17
# A component has settled when its residual is this small a part of the largest deviation.
SETTLED = 1e-14
_BLOCK = 4096
_DECIMAL = pa.decimal128(38, 0)


@dataclass
class Whitening:
    """What a fit returns: sums and number of the distinct rows, components, and their deviations."""

    n: int
    sums: list[int]
    components: np.ndarray  # a row per component
    eigenvalues: np.ndarray
    trace: float
    identity_error: float | None
    largest: int  # the largest absolute entry

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums]) if self.n else np.empty(0)


def whole_vectors(table: DataFrame, vec: str, scale: int = SCALE, *keep: str) -> DataFrame:
    """Kept columns and ``x``, the whole-number vector, of the rows that take part."""
    entries = F.transform(F.col(vec), lambda c: c.cast("double"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = table.select(*keep, entries.alias("x")).where(F.col("x").isNotNull() & finite
                                                         & (F.size("x") > 0))
    sizes = rows.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n"))
    width = sizes.agg(F.max(F.struct("n", "size")).getField("size")).first()[0]
    return rows.where(F.size("x") == F.lit(width or 0)).withColumn(
        "x", F.transform("x", lambda c: F.floor(c * scale)))


def _blocks(distinct: DataFrame) -> DataFrame:
    """Rows packed into blocks of 64-bit numbers, which later passes read as they are."""
    def pack(batches):
        for batch in batches:
            for at in range(0, len(batch), _BLOCK):
                part = batch.column(0).slice(at, _BLOCK)
                flat = part.flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([flat.tobytes()], pa.binary())], ["block"])

    ship_package(distinct.sparkSession)
    return cut(distinct.mapInArrow(pack, "block binary"))


def _totals(blocks: DataFrame, width: int) -> tuple[int, list[int], int]:
    """Exact number of rows, sums per dimension, and the largest absolute entry."""
    def add(batches):
        n, sums, largest = 0, np.zeros(width, object), 0
        for batch in batches:
            for raw in batch.column(0):
                x = np.frombuffer(raw.as_buffer(), np.int64).reshape(-1, width)
                n += len(x)
                # Halves of 32 bits cannot overflow while they are added.
                low = (x & 0xFFFFFFFF).sum(axis=0).astype(object)
                sums = sums + (x >> 32).sum(axis=0).astype(object) * (1 << 32) + low
                largest = max(largest, abs(int(x.max())), abs(int(x.min())))
        yield pa.RecordBatch.from_arrays(
            [pa.array([n]), pa.array([[int(s) for s in sums]], pa.list_(_DECIMAL)),
             pa.array([largest], _DECIMAL)], ["n", "sums", "largest"])

    parts = blocks.mapInArrow(add, "n long, sums array<decimal(38,0)>, largest decimal(38,0)")
    sums = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)]
    row = parts.agg(F.sum("n").alias("n"), F.max("largest").alias("largest"), *sums).first()
    return row["n"], [int(row[f"s{i}"]) for i in range(width)], int(row["largest"])


class _Rows:
    """The centred rows as a linear operator whose products are passes over the blocks."""

    def __init__(self, blocks: DataFrame, n: int, sums: list[int], width: int):
        self.blocks, self.width = blocks, width
        self.mean = np.array([s / n for s in sums])

    def _add(self, shape, kernel) -> np.ndarray:
        width, mean = self.width, self.mean

        def partial(batches):
            total = None
            for batch in batches:
                for raw in batch["block"]:
                    x = np.frombuffer(raw, np.int64).reshape(-1, width) - mean
                    total = kernel(x) if total is None else total + kernel(x)
            return total

        return sum_matrices(self.blocks, partial, shape)

    def step(self, c: np.ndarray) -> tuple[np.ndarray, float]:
        """X'u and u'u of u = X c."""
        def kernel(x):
            u = x @ c
            return np.r_[x.T @ u, u @ u]

        total = self._add((self.width + 1,), kernel)
        return total[:-1], float(total[-1])

    def square(self) -> float:
        return float(self._add((1,), lambda x: np.array([(x * x).sum()]))[0])

    def scores_gram(self, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums and products of the scores X turn."""
        def kernel(x):
            scores = x @ turn
            return np.vstack([scores.sum(axis=0), scores.T @ scores])

        total = self._add((turn.shape[1] + 1, turn.shape[1]), kernel)
        return total[0], total[1:]


def _orthogonal(vector: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for b in basis:
            vector = vector - (b @ vector) * b
    return vector


def _fresh(rng, basis: list[np.ndarray], width: int) -> np.ndarray:
    """A random unit vector orthogonal to the basis."""
    vector = _orthogonal(rng.normal(size=width), basis)
    return vector / np.linalg.norm(vector)


def bidiagonalise(step, width: int, k: int, seed: int = SEED,
                  settled: float = SETTLED) -> tuple[np.ndarray, np.ndarray]:
    """The k largest singular values of X and their right vectors (as rows), by passes ``step``.

    ``step`` maps c to (X'X c, |X c|^2).
    """
    rng = np.random.default_rng(seed)
    right: list[np.ndarray] = [_fresh(rng, [], width)]
    coefficients: list[np.ndarray] = []  # c of every u, zeros for a direction without deviation
    back: list[np.ndarray] = []  # X'u
    alphas, betas, beta, probed = [], [], 0.0, None
    while True:
        v = right[-1]
        # The products of X v with earlier u, from their X'u: u is what is left of X v.
        c = v
        for _ in range(2):
            for known, seen in zip(coefficients, back):
                c = c - (seen @ c) * known
        w, square = step(c)
        alpha = np.sqrt(max(square, 0.0))
        top = max([alpha, *alphas, *betas])
        # Below the rounding of the rows themselves X v adds no direction.
        empty = alpha <= 1e-13 * top * np.sqrt(width)
        alphas.append(0.0 if empty else alpha)
        coefficients.append(np.zeros(width) if empty else c / alpha)
        back.append(np.zeros(width) if empty else w / alpha)
        if len(right) == width:
            betas.append(0.0)
            break
        following = _orthogonal(back[-1], right)
        beta = float(np.linalg.norm(following))
        worn = beta <= 1e-13 * top * np.sqrt(width)
        betas.append(0.0 if worn else beta)
        small = np.diag(alphas) + np.diag(betas[:-1], 1)
        left, values, _ = np.linalg.svd(small)
        residuals = np.abs(betas[-1] * left[-1, :k])
        done = len(values) >= k and (residuals <= settled * values[0]).all()
        if done and probed is not None and len(right) - probed[0] >= k \
                and np.allclose(values[:k], probed[1], rtol=1e-12):
            break
        if done or worn:
            # Equal deviations hide from one starting direction; a fresh one finds the others.
            betas[-1] = 0.0
            if done and probed is None or done and not np.allclose(values[:k], probed[1],
                                                                   rtol=1e-12):
                probed = len(right), values[:k]
            right.append(_fresh(rng, right, width))
        else:
            right.append(following / beta)
    small = np.diag(alphas) + np.diag(betas[:-1], 1)
    _, values, turn = np.linalg.svd(small)
    return values[:k], turn[:k] @ np.array(right)


def fit(table: DataFrame, vec: str = "embedding", k: int = 4, scale: int = SCALE,
        seed: int = SEED) -> Whitening:
    """Components of the distinct whole-number vectors of a table."""
    return fit_rows(whole_vectors(table, vec, scale), k, seed)


def fit_rows(rows: DataFrame, k: int = 4, seed: int = SEED) -> Whitening:
    """``fit`` for a table that already has ``x``."""
    distinct = cut(rows.select("x").distinct())
    first = distinct.select(F.size("x")).first()
    if first is None:
        return Whitening(0, [], np.empty((0, 0)), np.empty(0), 0.0, None, 0)
    width = first[0]
    blocks = _blocks(distinct)
    n, sums, largest = _totals(blocks, width)
    centred = _Rows(blocks, n, sums, width)
    square = centred.square()
    values, vectors = np.empty(0), np.empty((0, width))
    if square > 0:
        values, vectors = bidiagonalise(centred.step, width, min(k, width), seed)
        real = values > 1e-12 * values[0] * np.sqrt(width)
        values, vectors = values[real], vectors[real]
        vectors = vectors / np.linalg.norm(vectors, axis=1)[:, None]
        vectors *= np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])[:, None]
    eigenvalues, error = values ** 2 / n, None
    if len(values):
        total, gram = centred.scores_gram(vectors.T / np.sqrt(eigenvalues))
        covariance = gram / n - np.outer(total / n, total / n)
        error = float(np.abs(covariance - np.eye(len(values))).max())
    return Whitening(n, sums, vectors, eigenvalues, square / n, error, largest)


def whiten(rows: DataFrame, model: Whitening, key: str = "vec_id") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of rows with ``x``.

    A row per component. ``deviation`` is the exact sum of (n*x - S)^2 as a decimal; it is null where
    38 digits do not hold it.
    """
    kind = rows.schema[key].dataType.simpleString()
    schema = (f"`{key}` {kind}, component int, n long, deviation decimal(38,0), whitened double, "
              "explained double, identity_error double")
    count = len(model.eigenvalues)
    if not count:
        return rows.sparkSession.createDataFrame([], schema)
    ship_package(rows.sparkSession)
    width, n = len(model.sums), model.n
    turn, mean = model.components.T / np.sqrt(model.eigenvalues), model.mean
    explained = model.eigenvalues / model.trace
    # Plain 64-bit numbers hold the deviation if even its bound fits.
    bound = (n * model.largest + max(map(abs, model.sums))) ** 2 * width
    exact = np.int64 if bound < 1 << 63 else object
    sums, error, largest = np.array(model.sums, dtype=exact), model.identity_error, 10 ** 38

    def kernel(batches):
        for batch in batches:
            for at in range(0, len(batch), _BLOCK):
                part = batch.slice(at, _BLOCK)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                gap = x.astype(exact) * n - sums
                deviation = (gap * gap).sum(axis=1)
                if exact is object:
                    deviation = pa.array([int(d) if d < largest else None for d in deviation],
                                         _DECIMAL)
                else:
                    deviation = pa.array(deviation).cast(_DECIMAL)
                size = len(x)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(np.repeat(np.arange(size), count))),
                     pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), size)),
                     pa.array(np.full(size * count, n)),
                     deviation.take(pa.array(np.repeat(np.arange(size), count))),
                     pa.array(((x - mean) @ turn).ravel()), pa.array(np.tile(explained, size)),
                     pa.array(np.full(size * count, error))],
                    [key, "component", "n", "deviation", "whitened", "explained",
                     "identity_error"])

    return rows.select(key, "x").mapInArrow(kernel, schema)


def whiten_table(table: DataFrame, vec: str = "embedding", key: str = "vec_id", k: int = 4,
                 scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """Fit and apply on one table: the first k whitened components of every row that takes part."""
    rows = cut(whole_vectors(table, vec, scale, key))
    return whiten(rows, fit_rows(rows, k, seed), key)
