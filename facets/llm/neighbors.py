"""Nearest neighbours by multi-index hashing.

A rotation learned on a bounded sample turns vectors into binary codes whose bits lose little
(iterative quantisation). Codes are cut into substrings, and every block of rows has one index per
substring. A code within Hamming radius r of a query is, in at least one of m substrings, within
the radius that the pigeonhole principle leaves for that substring, so probing all buckets that
near retrieves every such code. Full codes are then checked, and the floats decide.

The radius is measured on the sample, so that it covers the wanted share of true neighbours. A
query that finds too few is asked again with twice the radius, up to all bits. Queries go round in
blocks of bounded size against rows that stay where they are; each task returns its best few.

Defined cases: vectors that are null, of zero length or of another dimension than most, or that
hold null or non-finite components, take no part; rows with the query's id count as its own, and
of several query rows with one id the smallest vector asks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facets.session import cut, ship_package

K = 10
SAMPLE = 20_000
MOST_BITS = 64
SUBSTRING = 8
COVER = 0.98
QUERY_BLOCK = 4096
_INDEX_ROWS = 1 << 16


@dataclass
class Codes:
    """A learned rotation; ``radius`` covers most neighbours of the sample."""
    mean: np.ndarray
    rotation: np.ndarray
    radius: int

    @property
    def bits(self) -> int:
        return self.rotation.shape[1]

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """Substring values, one row of bytes per vector."""
        return np.packbits((vectors - self.mean) @ self.rotation > 0, axis=1, bitorder="little")


def learn(sample: np.ndarray, k: int = K, cover: float = COVER, rounds: int = 30,
          seed: int = 5) -> Codes:
    """Iterative quantisation, then the radius: alternately choose signs and the best rotation."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    bits = min(MOST_BITS, sample.shape[1])
    axes = axes[:, ::-1][:, :bits]
    reduced = centred @ axes
    rng = np.random.default_rng(seed)
    turn = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(reduced @ turn > 0, 1.0, -1.0).T @ reduced)
        turn = (u @ v).T
    codes = Codes(mean, axes @ turn, 0)
    coded = codes.encode(sample)
    asked = rng.permutation(len(sample))[:300]
    apart = []
    square = (sample ** 2).sum(axis=1)
    for q in asked:
        far = square - 2 * sample @ sample[q]
        far[q] = np.inf
        near = np.argsort(far, kind="stable")[:min(k, len(sample) - 1)]
        apart.append(np.bitwise_count(coded[near] ^ coded[q]).sum(axis=1, dtype=int))
    apart = np.concatenate(apart) if apart else np.zeros(1)
    codes.radius = int(np.quantile(apart, cover, method="higher")) if len(apart) else bits
    return codes


class MultiIndex:
    """One index per substring over a block of rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray):
        self.ids, self.vectors, self.codes = ids, vectors, codes
        self.order = [np.argsort(c, kind="stable") for c in codes.T]
        self.counts = [np.bincount(c, minlength=256) for c in codes.T]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code differs in at most ``radius`` bits.

        With radius = m * a + b, either one of the first b + 1 substrings differs in at most a
        bits, or one of the others in at most a - 1.
        """
        m = len(code)
        deep, extra = divmod(radius, m)
        seen = np.zeros(len(self.ids), bool)
        values = np.arange(256, dtype=np.uint8)
        for j in range(m):
            reach = deep if j <= extra else deep - 1
            near = np.bitwise_count(values ^ code[j]) <= reach
            seen[self.order[j][np.repeat(near, self.counts[j])]] = True
        rows = np.flatnonzero(seen)
        apart = np.bitwise_count(self.codes[rows] ^ code).sum(axis=1, dtype=np.int64)
        return rows[apart <= radius]

    def nearest(self, query: int, vector: np.ndarray, code: np.ndarray, radius: int, k: int):
        rows = self.within(code, radius)
        rows = rows[self.ids[rows] != query]
        far = np.sqrt(((self.vectors[rows] - vector) ** 2).sum(axis=1))
        if len(rows) > k:
            keep = far <= np.partition(far, k - 1)[k - 1]
            rows, far = rows[keep], far[keep]
        best = np.lexsort((self.ids[rows], far))[:k]
        return self.ids[rows[best]], far[best]


def usable(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v): vectors that take part, as doubles."""
    rows = df.select(F.col(id_col).cast("long").alias("id"),
                     F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & (F.size("v") > 0) & F.forall(
        "v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
        & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"))
    common = sizes.agg(F.max(F.struct("rows", "n"))["n"]).first()[0]
    return rows.where(F.size("v") == (common or 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def nearest(df: DataFrame, k: int = K, every: int = 100, sample: int = SAMPLE,
            query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): neighbours of every row whose id ``every`` divides."""
    spark = df.sparkSession
    ship_package(spark)
    rows = usable(df)
    total = rows.count()
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    schema = "query_id long, vec_id long, score double"
    if total == 0:
        return _ranked(spark.createDataFrame([], schema), k)
    chosen = rows
    if total > sample:
        share = int(sample / total * (1 << 32))
        chosen = rows.where(F.xxhash64("id").bitwiseAND(F.lit((1 << 32) - 1)) < share)
    learned = chosen.limit(2 * sample).toArrow().column("v").combine_chunks()
    if not len(learned):
        learned = rows.limit(2 * sample).toArrow().column("v").combine_chunks()
    codes = learn(_matrix(learned), k)
    results = None
    for block in _blocks(asked, query_block):
        found = _ask(rows, block, codes, codes.radius, k, total)
        results = found if results is None else results.union(found)
    if results is None:
        results = spark.createDataFrame([], schema)
    return _ranked(results, k)


def _blocks(asked: DataFrame, size: int):
    ids, vectors = [], []
    for r in asked.toLocalIterator():
        ids.append(r[0])
        vectors.append(r[1])
        if len(ids) == size:
            yield np.array(ids), np.array(vectors)
            ids, vectors = [], []
    if ids:
        yield np.array(ids), np.array(vectors)


def _ask(rows: DataFrame, block, codes: Codes, radius: int, k: int, total: int) -> DataFrame:
    """All queries of a block against all rows; those left short ask again, further out."""
    found = None
    while True:
        ids, vectors = block
        part = cut(_ranked(rows.mapInArrow(
            _searcher(rows.sparkSession.sparkContext.broadcast((ids, vectors, codes, radius, k))),
            "query_id long, vec_id long, score double"), k).drop("rank"))
        got = {r[0]: r[1] for r in part.groupBy("query_id").agg(F.count("*")).collect()}
        short = np.array([got.get(i, 0) < min(k, total - 1) for i in ids.tolist()], bool)
        done = ids[~short].tolist()
        if radius >= codes.bits or not short.any():
            return part if found is None else found.union(part)
        if done:
            part = part.where(F.col("query_id").isin(done))
            found = part if found is None else found.union(part)
        block, radius = (ids[short], vectors[short]), max(1, 2 * radius)


def _searcher(shared):
    def kernel(batches):
        ids, vectors, codes, radius, k = shared.value
        asked = codes.encode(vectors)
        best_id = [np.zeros(0, np.int64)] * len(ids)
        best = [np.zeros(0)] * len(ids)

        def ask(held):
            index = MultiIndex(np.concatenate([i for i, _ in held]),
                               (all_ := np.concatenate([v for _, v in held])), codes.encode(all_))
            for q in range(len(ids)):
                near, far = index.nearest(ids[q], vectors[q], asked[q], radius, k)
                near, far = np.append(best_id[q], near), np.append(best[q], far)
                keep = np.lexsort((near, far))[:k]
                best_id[q], best[q] = near[keep], far[keep]

        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), _matrix(batch.column(1))))
                n += batch.num_rows
            if n >= _INDEX_ROWS:
                ask(held)
                held, n = [], 0
        if held:
            ask(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(ids, [len(b) for b in best])),
             pa.array(np.concatenate(best_id) if len(ids) else np.zeros(0, np.int64)),
             pa.array(np.concatenate(best) if len(ids) else np.zeros(0))],
            ["query_id", "vec_id", "score"])
    return kernel


def _ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return (found.withColumn("rank", place.cast("int")).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
