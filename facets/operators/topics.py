"""Topics inside every group.

Online variational inference for all groups together: a document's terms are numbered within its
group's stretch of one matrix, a step adds up what a part of the documents says of every group's
topics in one aggregation, and the driver moves the matrix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facets.constants import (LDA_MAX_DF, LDA_MAX_FEATURES, LDA_MIN_DF, LDA_MIN_ROWS, LDA_PASSES,
                              LDA_TOPICS, SEED, STOP_WORDS)
from facets.operators.counting import Known, common_terms, text_parts
from facets.operators.features import sum_matrices
from facets.session import cut, ship_package

# Parts of a pass, and how the steps shrink: the t-th has the rate (OFFSET + t) ** -DECAY.
BATCHES = 4
OFFSET, DECAY = 10.0, 0.7
# A document has settled when its mean change is below this, or after so many rounds.
SETTLED, MAX_ROUNDS = 1e-3, 100
CHUNK_CELLS = 32_768


def topic_count(rows: int, n_topics: int = LDA_TOPICS) -> int:
    return min(n_topics, max(2, rows // 50))


def group_vocabularies(df: DataFrame, group: str = "cluster", text: str = "clean_text",
                       max_features: int = LDA_MAX_FEATURES, min_df: int = LDA_MIN_DF,
                       max_df: float = LDA_MAX_DF, stop_words=STOP_WORDS) -> DataFrame:
    """The commonest terms of every group within the document-frequency bounds, in one job:
    (group, rank, term, cf, df)."""
    common, _ = common_terms(df, text, group, max_features, min_df, max_df, stop_words)
    return common.select(F.col("g").alias(group), "rank", "term", "cf", "df")


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of the log gamma function, minus infinity at zero."""
    with np.errstate(divide="ignore", invalid="ignore"):
        low, x = np.zeros_like(x), x.copy()
        for _ in range(8):  # recurrence up to where the series holds
            low -= 1 / x
            x += 1
        r = 1 / (x * x)
        return low + np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r / 240)))


class _Model:
    """Topics of all groups in one matrix: a group owns a stretch of columns, one for each of its
    terms, and the first rows, one for each of its topics."""

    def __init__(self, vocab: dict, sizes: dict, n_topics: int, seed: int):
        self.groups = sorted(vocab)
        self.topics = np.array([topic_count(sizes[g], n_topics) for g in self.groups])
        self.rows = np.array([sizes[g] for g in self.groups], "f8")
        self.ends = np.cumsum([len(vocab[g]) for g in self.groups])
        self.owner = np.repeat(np.arange(len(self.groups)), [len(vocab[g]) for g in self.groups])
        # Whether a topic (row) exists in the group of a term (column).
        self.real = np.arange(self.topics.max())[:, None] < self.topics[self.owner][None]
        starts = [np.random.default_rng([seed, g]).gamma(100, 0.01, (len(self.real), len(vocab[k])))
                  for g, k in enumerate(self.groups)]
        self.weight = np.where(self.real, np.hstack(starts), 0.0)

    def terms(self) -> np.ndarray:
        """exp(E[log beta]) of every topic and term, zero where there is no such topic."""
        at = self.ends - np.diff(np.r_[0, self.ends])
        total = np.add.reduceat(self.weight, at, axis=1)[:, self.owner]
        with np.errstate(invalid="ignore"):
            return np.where(self.real, np.exp(digamma(self.weight) - digamma(total)), 0.0)

    def step(self, found: np.ndarray, seen: np.ndarray, rate: float) -> None:
        """Move the topics of the groups that had rows towards what these rows say of the whole."""
        scale = (self.rows / np.maximum(seen, 1))[self.owner]
        target = 1 / self.topics[self.owner] + scale * found
        mixed = (1 - rate) * self.weight + rate * target
        self.weight = np.where(self.real & (seen > 0)[self.owner], mixed, self.weight)


def document_topics(group, rows, terms, counts, beta, topics):
    """Topic weights of documents and the last share of every cell's topics.

    Each document is iterated until it settles, whatever documents are beside it.
    """
    real = np.arange(len(beta))[None] < topics[group][:, None]
    alpha = np.where(real, 1 / topics[group][:, None], 0.0)
    gamma, last = real.astype("f8"), np.zeros((len(group), len(beta)))
    sizes = np.bincount(rows, minlength=len(group))
    if (np.diff(rows) < 0).any():
        raise ValueError("cells stand by rows")
    cells = beta[:, terms]
    # Documents still moving stay together with their cells; settled ones are left out once they are
    # a fourth of these.
    at, alive, held, weights = np.arange(len(group)), np.ones(len(group), bool), cells, counts
    for _ in range(MAX_ROUNDS):
        if alive.sum() * 4 <= len(at) * 3:
            kept = np.repeat(alive, sizes[at])
            held, weights, at = held[:, kept], weights[kept], at[alive]
            alive = np.ones(len(at), bool)
        was, size = gamma[at], sizes[at]
        parts = np.exp(digamma(np.column_stack([was, was.sum(axis=1)])))
        theta = np.where(real[at], parts[:, :-1], 0.0) / parts[:, -1:]
        mixed = np.zeros(len(weights))
        for k, row in enumerate(held):
            mixed += np.repeat(theta[:, k], size) * row
        np.divide(weights, np.maximum(mixed, 1e-100, out=mixed), out=mixed)
        new, some = alpha[at], size > 0
        starts = (np.cumsum(size) - size)[some]
        for k, row in enumerate(held if len(starts) else ()):
            new[some, k] += theta[some, k] * np.add.reduceat(mixed * row, starts)
        moved = np.abs(new - was).sum(axis=1) / topics[group[at]]
        gamma[at[alive]], last[at[alive]] = new[alive], theta[alive]
        alive &= moved > SETTLED
        if not alive.any():
            break
    share = cells * np.repeat(last, sizes, axis=0).T
    share *= counts / np.maximum(share.sum(axis=0), 1e-100)
    return gamma, share.T


def _cells(batch: pd.DataFrame):
    """Bounded parts of a batch as positions, groups and flat (row, term, count) cells."""
    sizes = batch["indices"].map(len).to_numpy()
    part = np.cumsum(sizes + 1) // CHUNK_CELLS
    for p in np.unique(part):
        at = np.flatnonzero(part == p)
        yield (at, batch["g"].to_numpy()[at], np.repeat(np.arange(len(at)), sizes[at]),
               np.concatenate(batch["indices"].to_numpy()[at]).astype(np.int64),
               np.concatenate(batch["counts"].to_numpy()[at]).astype("f8"))


def _encoded(rows: DataFrame, group: str, text: str, id_col: str, vocab: dict,
             stop_words) -> DataFrame:
    """(id, g, indices, counts): a row's terms as columns of the model, counted where it lies."""
    shared = rows.sparkSession.sparkContext.broadcast([(k, vocab[k]) for k in sorted(vocab)])
    dropped = list(stop_words)

    def encode(batches):
        stops, known, first = pa.array(dropped, pa.string()), [], 0
        for name, words in shared.value:
            known.append((name, first, Known(words)))
            first += len(words)
        for batch in batches:
            for part in text_parts(batch, 2):
                for g, (name, first, words) in enumerate(known):
                    mine = part.filter(pc.equal(part.column(1), pa.scalar(name, part.column(1).type)))
                    if not len(mine):
                        continue
                    row, place, tf = words.cells(mine.column(2), stops)
                    ends = pa.array(np.searchsorted(row, np.arange(len(mine) + 1)), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [mine.column(0), pa.array(np.full(len(mine), g), pa.int32()),
                         pa.ListArray.from_arrays(ends, pa.array(first + place, pa.int32())),
                         pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32()))],
                        ["_id", "g", "indices", "counts"])

    texts = rows.select(F.col(id_col).alias("_id"), F.col(group).alias("_group"),
                        F.col(text).cast("string").alias("text"))
    return texts.mapInArrow(encode, f"_id {texts.schema['_id'].dataType.simpleString()}, g int, "
                                    "indices array<int>, counts array<int>")


def _statistics(rows: DataFrame, model: _Model) -> np.ndarray:
    """What a batch of documents of all groups says of the topics, added up in one job."""
    shared = rows.sparkSession.sparkContext.broadcast((model.terms(), model.topics))

    def partial(batches):
        beta, topics = shared.value
        total = None
        for batch in batches:
            for _, group, row, term, count in _cells(batch):
                total = np.zeros_like(beta) if total is None else total
                _, part = document_topics(group, row, term, count, beta, topics)
                for k, share in enumerate(part.T):
                    total[k] += np.bincount(term, share, beta.shape[1])
        return total

    out = sum_matrices(rows, partial, model.weight.shape)
    shared.destroy()
    return out


def _likeliest(rows: DataFrame, model: _Model, id_col: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((model.terms(), model.topics))

    def label(batches):
        beta, topics = shared.value
        for batch in batches:
            for at, group, row, term, count in _cells(batch):
                gamma, _ = document_topics(group, row, term, count, beta, topics)
                yield pd.DataFrame({id_col: batch["_id"].to_numpy()[at],
                                    "sub_topic": gamma.argmax(axis=1).astype("i4")})

    return rows.mapInPandas(label, f"`{id_col}` {dict(rows.dtypes)['_id']}, sub_topic int")


def topics_per_group(df: DataFrame, group: str = "cluster", text: str = "clean_text",
                     id_col: str = "Id", n_topics: int = LDA_TOPICS, top: int = 10,
                     passes: int = LDA_PASSES, seed: int = SEED, stop_words=STOP_WORDS,
                     batches: int = BATCHES):
    """Online LDA inside every group of at least 20 rows, all groups in the same steps.

    Returns the topics (group, sub_topic, top_words) and ``df`` with a nullable ``sub_topic``, the
    likeliest topic of the row (the first on a tie). Groups without a vocabulary and rows without a
    group get none. A pass goes over the rows in ``batches`` parts drawn by id, whatever the size of
    a group, and a step is one job for all groups, however many there are. The driver holds
    ``n_topics`` numbers for each of a group's at most 2,000 terms.
    """
    rows = cut(df.select(id_col, group, text).where(F.col(group).isNotNull()))
    sizes = {r[group]: r["count"] for r in rows.groupBy(group).count().collect()}
    large = [g for g, n in sizes.items() if n >= LDA_MIN_ROWS]
    rows = rows.where(F.col(group).isin(large))
    vocab: dict = {}
    for r in group_vocabularies(rows, group, text, stop_words=stop_words).collect():
        vocab.setdefault(r[group], []).append(r["term"])
    vocab = {g: sorted(words) for g, words in vocab.items()}
    kind = dict(df.dtypes)[group]
    topic_schema = f"{group} {kind}, sub_topic int, top_words array<string>"
    if not vocab:
        return (df.sparkSession.createDataFrame([], topic_schema),
                df.withColumn("sub_topic", F.lit(None).cast("int")))
    ship_package(df.sparkSession)
    model = _Model(vocab, sizes, n_topics, seed)
    rows = rows.where(F.col(group).isin(list(vocab)))
    drawn = F.pmod(F.xxhash64(F.lit(seed), "_id"), F.lit(batches))
    encoded = cut(_encoded(rows, group, text, id_col, vocab, stop_words).withColumn("part", drawn))
    seen = np.zeros((batches, len(vocab)))
    for r in encoded.groupBy("part", "g").count().collect():
        seen[r["part"], r["g"]] = r["count"]
    parts = [cut(encoded.where(F.col("part") == b)) if batches > 1 else encoded
             for b in range(batches)]
    for t in range(passes * batches):
        b = t % batches
        if seen[b].any():
            model.step(_statistics(parts[b], model), seen[b], (OFFSET + t + 1) ** -DECAY)
    found, first = [], 0
    for g, name in enumerate(model.groups):
        words = vocab[name]
        for k in range(model.topics[g]):
            best = np.argsort(-model.weight[k, first:model.ends[g]], kind="stable")[:top]
            found.append((name, k, [words[i] for i in best]))
        first = model.ends[g]
    labels = cut(_likeliest(encoded, model, id_col))
    return (df.sparkSession.createDataFrame(found, topic_schema),
            df.join(labels, id_col, "left"))


def topic_grid(topics: DataFrame, group: str = "cluster", n_topics: int = LDA_TOPICS,
               words: int = 6) -> DataFrame:
    """One row per group and one column per topic with its first words, blank where there is none."""
    short = topics.select(
        F.concat(F.lit("C"), F.col(group)).alias(group),
        F.concat(F.lit("T"), F.col("sub_topic")).alias("_t"),
        F.array_join(F.slice("top_words", 1, words), " | ").alias("_w"))
    names = [f"T{i}" for i in range(n_topics)]
    return short.groupBy(group).pivot("_t", names).agg(F.first("_w")).na.fill("", names)
