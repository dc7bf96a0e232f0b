"""Numeric, latent-semantic and principal-component features.

Vectors are ``array<double>`` columns of the row they describe, so nothing is joined by position.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA, ElementwiseProduct, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facets.constants import LSA_DIMS, NUMERIC_WEIGHT, PCA_DIMS, SEED, TEXT_WEIGHT
from facets.session import cut, ship_package

_FAN_IN = 32
_SENT_BYTES = 1 << 20
_CHUNK_CELLS, _CHUNK_ROWS = 65_536, 256
# Rows of a packed piece, the commonest columns that rows are told apart by, and their directions.
_PIECE_ROWS, _TOLD_BY, _KINDS = 128, 256, 8


def standardize(df: DataFrame, cols, suffix: str = "_std") -> DataFrame:
    """Columns minus mean over population deviation; a constant column becomes zero."""
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
                   *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    return df.withColumns({
        f"{c}{suffix}": (F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"] or 1.0)
        for c in cols})


def fuse(df: DataFrame, parts, name: str = "fused") -> DataFrame:
    """One vector from (array column, or list of number columns; weight) parts."""
    def weighted(cols, weight):
        values = F.col(cols) if isinstance(cols, str) else \
            F.array(*[F.col(c).cast("double") for c in cols])
        return F.transform(values, lambda v: v * float(weight))

    return df.withColumn(name, F.concat(*[weighted(cols, weight) for cols, weight in parts]))


def sum_matrices(df: DataFrame, partial, shape) -> np.ndarray:
    """Sum of one matrix per partition, added up in rounds of at most ``_FAN_IN`` per task.

    ``partial`` maps an iterator of pandas batches to an array of ``shape`` (or None). The driver gets
    one matrix, or at most ``_FAN_IN`` that together have ``_SENT_BYTES``, however many partitions
    there are.
    """
    def first(batches):
        total = partial(batches)
        if total is not None:
            yield pd.DataFrame({"m": [np.ascontiguousarray(total, "f8").tobytes()]})

    def add(batches):
        total = None
        for batch in batches:
            for raw in batch["m"]:
                matrix = np.frombuffer(raw, "f8").reshape(shape)
                total = matrix.copy() if total is None else total + matrix
        if total is not None:
            yield pd.DataFrame({"m": [total.tobytes()]})

    left = df.rdd.getNumPartitions()
    ship_package(df.sparkSession)
    sums = df.mapInPandas(first, "m binary")
    size = 8 * math.prod(shape)
    while left > _FAN_IN or left > 1 and left * size > _SENT_BYTES:
        left = math.ceil(left / _FAN_IN)
        sums = sums.repartition(left).mapInPandas(add, "m binary")
    total = np.zeros(shape)
    for row in sums.collect():
        total = total + np.frombuffer(bytes(row["m"]), "f8").reshape(shape)
    return total


def _chunks(batch: pd.DataFrame):
    """Sparse rows as (row numbers, columns, dense matrix of these columns), a bounded number at a
    time: a product of dense matrices takes far less time than gathering rows for every cell."""
    sizes = batch["indices"].map(len).to_numpy()
    group = np.maximum(np.cumsum(sizes) // _CHUNK_CELLS, np.arange(len(batch)) // _CHUNK_ROWS)
    for g in np.unique(group):
        at = np.flatnonzero(group == g)
        indices = np.concatenate(batch["indices"].to_numpy()[at]).astype(np.int64)
        columns, place = np.unique(indices, return_inverse=True)
        dense = np.zeros((len(at), len(columns)))
        dense[np.repeat(np.arange(len(at)), sizes[at]), place] = np.concatenate(
            batch["values"].to_numpy()[at])
        yield at, columns, dense


def _alike(sizes: np.ndarray, indices: np.ndarray, values: np.ndarray) -> np.ndarray:
    """An order of sparse rows that puts rows of like columns and lengths side by side.

    Rows go by the leading direction of the commonest columns that they point to most.
    """
    common, at = np.unique(indices, return_inverse=True)
    chosen = np.argsort(-np.bincount(at, minlength=len(common)), kind="stable")[:_TOLD_BY]
    place = np.full(len(common), -1)
    place[chosen] = np.arange(len(chosen))
    row, at = np.repeat(np.arange(len(sizes)), sizes), place[at]
    dense = np.zeros((len(sizes), len(chosen)))
    dense[row[at >= 0], at[at >= 0]] = values[at >= 0]
    turn = np.random.default_rng(SEED).normal(size=(len(chosen), min(_KINDS, len(chosen))))
    for _ in range(3):
        turn = np.linalg.qr(dense.T @ (dense @ turn))[0]
    lean = dense @ turn
    most = np.abs(lean).argmax(axis=1)
    return np.lexsort((sizes, 2 * most + (lean[np.arange(len(lean)), most] > 0)))


def packed(vectors: DataFrame) -> DataFrame:
    """Sparse rows as pieces for ``_dense``: a row holds the cells of up to ``_PIECE_ROWS`` rows.

    Rows of an Arrow batch are put together by likeness, so that a piece has few columns; each pass
    over the pieces then reads and multiplies far less than one over the rows.
    """
    names = ["sizes", "columns", "places", "vals"]

    def kernel(batches):
        for batch in batches:
            lists = batch.column(0)
            sizes = np.diff(lists.offsets.to_numpy())
            indices = lists.flatten().to_numpy(zero_copy_only=False).astype("i4")
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            if not len(indices):
                continue
            starts, order = np.cumsum(sizes) - sizes, _alike(sizes, indices, values)
            filled = np.cumsum(sizes[order]) // _CHUNK_CELLS
            group = np.maximum(filled, np.arange(len(order)) // _PIECE_ROWS)
            out = []
            for rows in np.split(order, np.flatnonzero(np.diff(group)) + 1):
                long = sizes[rows]
                cells = np.arange(long.sum()) + np.repeat(
                    starts[rows] - np.cumsum(long) + long, long)
                columns, places = np.unique(indices[cells], return_inverse=True)
                out.append([long.astype("i4").tobytes(), columns.tobytes(),
                            places.astype("i4").tobytes(), values[cells].tobytes()])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], names)

    ship_package(vectors.sparkSession)
    rows = vectors.select("indices", F.col("values").cast("array<double>").alias("values"))
    return rows.mapInArrow(kernel, ", ".join(f"{n} binary" for n in names))


def _dense(batch: pd.DataFrame):
    """(columns, dense matrix of these columns) of every piece."""
    for sizes, columns, places, values in zip(
            batch["sizes"], batch["columns"], batch["places"], batch["vals"]):
        sizes, columns = np.frombuffer(sizes, "i4"), np.frombuffer(columns, "i4")
        dense = np.zeros((len(sizes), len(columns)))
        dense[np.repeat(np.arange(len(sizes)), sizes), np.frombuffer(places, "i4")] = \
            np.frombuffer(values, "f8")
        yield columns, dense


def fit_lsa(vectors: DataFrame, width: int, k: int = LSA_DIMS, seed: int = SEED,
            rounds: int = 5, oversample: int = 10):
    """Right singular vectors of the (uncentred) sparse rows and the share each one explains.

    Randomised subspace iteration: rows are packed once, and every round is one pass over the pieces
    that adds up ``X'(X Q)``, a ``width x (k + oversample)`` matrix, so the data never leave the executors.
    Signs are fixed so that each vector's largest entry is positive.
    """
    context = vectors.sparkSession.sparkContext
    k = min(k, width)
    size = min(k + oversample, width)
    pieces = cut(packed(vectors))
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, size)))[0]

    def gram(basis):
        shared = context.broadcast(basis)

        def partial(batches):
            total = None
            for batch in batches:
                if total is None:
                    total = np.zeros(shared.value.shape)
                for columns, dense in _dense(batch):
                    total[columns] += dense.T @ (dense @ shared.value[columns])
            return total
        out = sum_matrices(pieces, partial, basis.shape)
        shared.destroy()
        return out

    for _ in range(rounds):
        basis = np.linalg.qr(gram(basis))[0]
    energy, turn = np.linalg.eigh(basis.T @ gram(basis))
    best = np.argsort(energy)[::-1][:k]
    loadings = basis @ turn[:, best]
    loadings *= np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(k)])
    return loadings, np.maximum(energy[best], 0)


def lsa_variance(vectors: DataFrame, n_docs: int, loadings: np.ndarray,
                 energy: np.ndarray) -> np.ndarray:
    """Explained share of total variance per component; documents without terms count as zeros."""
    width = loadings.shape[0]

    def partial(batches):
        total = np.zeros((2, width))
        for batch in batches:
            if len(batch):
                at, values = (np.concatenate(batch[c].to_numpy()) for c in ("indices", "values"))
                total += [np.bincount(at, v, width) for v in (values, values * values)]
        return total

    sums = sum_matrices(vectors.select("indices", "values"), partial, (2, width)) / n_docs
    mean, square = sums[0], sums[1].sum()
    total = square - float(mean @ mean)
    return (energy / n_docs - (mean @ loadings) ** 2) / total


def lsa_ratios(vectors: DataFrame, n_docs: int, loadings: np.ndarray,
               energy: np.ndarray) -> DataFrame:
    """``lsa_variance`` as a table (pc, ratio), like that of ``pca``."""
    shares = lsa_variance(vectors, n_docs, loadings, energy) if n_docs else []
    return vectors.sparkSession.createDataFrame(
        [(i + 1, float(r)) for i, r in enumerate(shares)], "pc int, ratio double")


def project(vectors: DataFrame, loadings: np.ndarray, key: str = "Id",
            name: str = "text_vec") -> DataFrame:
    """Rows times loadings: (key, name)."""
    shared = vectors.sparkSession.sparkContext.broadcast(loadings)

    def times(batches):
        for batch in batches:
            for at, columns, dense in _chunks(batch):
                out = dense @ shared.value[columns]
                yield pd.DataFrame({key: batch[key].to_numpy()[at], name: list(out)})

    key_type = dict(vectors.dtypes)[key]
    ship_package(vectors.sparkSession)
    return vectors.mapInPandas(times, f"{key} {key_type}, {name} array<double>")


def lsa(df: DataFrame, vectors: DataFrame, width: int, k: int = LSA_DIMS, key: str = "Id",
        seed: int = SEED):
    """Add ``text_vec`` to ``df``; documents without terms get zeros. Also returns the loadings."""
    loadings, energy = fit_lsa(vectors, width, k, seed)
    zeros = F.array(*[F.lit(0.0)] * loadings.shape[1])
    out = (df.join(project(vectors, loadings, key), key, "left")
           .withColumn("text_vec", F.coalesce("text_vec", zeros)))
    return out, loadings, energy


def pca(df: DataFrame, vec: str = "fused", k: int = PCA_DIMS, name: str = "pca"):
    """Add the first ``k`` principal components of centred ``vec``; also a (pc, ratio) table."""
    width = df.select(F.size(vec)).first()[0]
    k = min(k, width)
    rows = df.withColumn("_v", array_to_vector(vec))
    centre = StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_c").fit(rows)
    rows = centre.transform(rows)
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(rows)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(k)])
    turned = ElementwiseProduct(scalingVec=Vectors.dense(signs), inputCol="_p", outputCol="_q")
    out = turned.transform(model.transform(rows)).withColumn(name, vector_to_array("_q"))
    ratios = df.sparkSession.createDataFrame(
        [(i + 1, float(r)) for i, r in enumerate(model.explainedVariance)], "pc int, ratio double")
    return out.drop("_v", "_c", "_p", "_q"), ratios, loadings * signs


def map2d(df: DataFrame, vec: str = "fused") -> DataFrame:
    """Two-dimensional map coordinates ``map_x``, ``map_y`` of the rows."""
    out, _, _ = pca(df, vec, 2, "_map")
    return (out.withColumns({"map_x": F.get("_map", F.lit(0)), "map_y": F.get("_map", F.lit(1))})
            .drop("_map"))


def fused_features(df: DataFrame, text_vec: str, numeric, name: str = "fused",
                   text_weight: float = TEXT_WEIGHT,
                   numeric_weight: float = NUMERIC_WEIGHT) -> DataFrame:
    """Standardise the numeric columns and join them to the text vector."""
    scaled = standardize(df, numeric, "_std")
    names = [f"{c}_std" for c in numeric]
    return fuse(scaled, [(text_vec, text_weight), (names, numeric_weight)], name).drop(*names)
