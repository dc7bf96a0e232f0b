"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

A word is a run of non-blank bytes. Its letters and its shape (trailing punctuation, capitals) are
hashed apart, a word that repeats its predecessor becomes one repeat mark, and pairs of neighbours
are hashed from the hashes of their words. A document is the unit-length vector of its counts.

Defined cases: a null text is an empty one, whose score is that of the intercept; a label that is
null or not 0 or 1, or whose document is missing, is not learned from; with nothing to learn from,
every score is one half; if one id has several texts or labels, each pair is one example.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facets.llm.batches import texts, tidy
from facets.session import ship_package

BITS = 18
SAMPLE = 8_000
EPOCHS = 4
THRESHOLD = 0.7
_REPEAT = 0x5BD1E995
_PAIR = np.uint32(0x9E3779B1)
_CACHE_WORDS = 200_000
_hashes: dict[bytes, int] = {}


def _word_hash(word: bytes) -> int:
    """Hash of the letters above, of the shape below; a plain word has shape 0."""
    core = word.rstrip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    shape = word[len(core):] + (b"^" if len(core) > 1 and core.isupper() else b"")
    return zlib.crc32(core.lower()) << 32 | (zlib.crc32(shape) if shape else 0)


def forget() -> None:
    """A task's word hashes are soon made again; the worker should not keep them."""
    _hashes.clear()
    tidy()


def features(text: bytes | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram buckets of a whole text, and their values (unit length)."""
    words = text.split() if text else []
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    if len(_hashes) > _CACHE_WORDS:
        _hashes.clear()
    for w in {*words}.difference(_hashes):
        _hashes[w] = _word_hash(w)
    both = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    core = (both >> np.uint64(32)).astype(np.uint32)
    shape = both.astype(np.uint32)
    same = np.concatenate(([False], core[1:] == core[:-1]))
    core[same] = _REPEAT
    pairs = (core[:-1] * _PAIR) ^ core[1:]
    grams = np.concatenate((core, shape[shape > 0], pairs)) >> np.uint32(32 - bits)
    at, n = np.unique(grams, return_counts=True)
    return at.astype(np.int64), n / np.sqrt(np.dot(n, n.astype(float)))


@dataclass
class Model:
    weights: np.ndarray
    intercept: float
    bits: int

    def score(self, text: bytes | None) -> float:
        at, value = features(text, self.bits)
        z = float(self.weights[at] @ value) + self.intercept
        return float(1 / (1 + np.exp(-np.clip(z, -700, 700))))


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS,
          epochs: int = EPOCHS, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.0,
          l2: float = 0.01, seed: int = 7) -> Model:
    """FTRL-proximal over the examples in a seeded order; the last place is the intercept."""
    size = (1 << bits) + 1
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    for epoch in range(epochs if examples else 0):
        for k in np.random.default_rng(seed + epoch).permutation(len(examples)):
            at, value, y = examples[k]
            at, value = np.append(at, size - 1), np.append(value, 1.0)
            p = 1 / (1 + np.exp(-np.clip(w[at] @ value, -700, 700)))
            g = (p - y) * value
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w[at]
            n[at] += g * g
            lead = np.sign(z[at]) * l1 - z[at]
            w[at] = np.where(np.abs(z[at]) <= l1, 0.0,
                             lead / ((beta + np.sqrt(n[at])) / alpha + l2))
    return Model(w[:-1].astype(np.float32), float(w[-1]), bits)


def crc_part(parts: int) -> Column:
    """Remainder of the checksum of the id written as text; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None,
        sample: int = SAMPLE, bits: int = BITS) -> Model:
    """Train on about ``sample`` labelled documents (at most twice as many), chosen by a hash.

    The bound keeps what the training task holds, a few hundred numbers per document, independent
    of the table. Features are computed on the executors from whole texts.
    """
    ship_package(docs.sparkSession)
    usable = labels.where(F.col("quality").isin(0, 1))
    if learn_from is not None:
        usable = usable.where(learn_from)
    usable = usable.select("doc_id", F.col("quality").cast("int").alias("quality"))
    total = usable.count()
    if total > sample:
        # The id's hash decides, so the choice does not depend on how rows are partitioned.
        share = int(sample / total * (1 << 32))
        usable = usable.where(F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 32) - 1)) < share)
    ids = usable.limit(2 * sample)
    rows = ids.join(docs.select("doc_id", F.col("text").cast("string").alias("text")), "doc_id")

    def kernel(batches):
        for batch in batches:
            got = [features(t, bits) for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2),
                 pa.array([a.astype(np.int32).tobytes() for a, _ in got], pa.binary()),
                 pa.array([v.astype(np.float32).tobytes() for _, v in got], pa.binary())],
                ["doc_id", "quality", "at", "value"])
        forget()

    def learn(batches):
        got = []
        for batch in batches:
            got.extend(zip(*(c.to_pylist() for c in batch.columns)))
        got.sort(key=lambda r: (str(r[0]), *r[1:]))
        model = train([(np.frombuffer(a, np.int32), np.frombuffer(v, np.float32), y)
                       for _, y, a, v in got], bits)
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.weights.tobytes()], pa.binary()),
             pa.array([model.intercept], pa.float64())], ["weights", "intercept"])
        del got, model
        tidy()

    id_type = docs.schema["doc_id"].dataType.simpleString()
    made = rows.select("doc_id", "text", "quality").mapInArrow(
        kernel, f"doc_id {id_type}, quality int, at binary, value binary").limit(4 * sample)
    # One task trains: the sample is bounded, and only the weights reach the driver.
    learned = made.repartition(1).mapInArrow(learn, "weights binary, intercept double").first()
    if learned is None:
        return train([], bits)
    return Model(np.frombuffer(bytes(learned["weights"]), np.float32), learned["intercept"], bits)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row's whole text."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** bits weights

    def kernel(batches):
        for batch in batches:
            got = [shared.value.score(t) for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())],
                                             ["doc_id", "score"])
        forget()

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        kernel, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least ``threshold``, with all their columns."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text_at = docs.columns.index("text")

    def kernel(batches):
        for batch in batches:
            keep = [shared.value.score(t) >= threshold for t in texts(batch.column(text_at))]
            yield batch.filter(pa.array(keep, pa.bool_()))
        forget()

    return docs.mapInArrow(kernel, docs.schema)
