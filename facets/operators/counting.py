"""Counting terms where their texts lie.

A task counts the terms of its rows in a table of bounded size. When the table is full, its rarest
terms leave it, and the largest count that left is noted: no term occurs more often than its counts
in all tables and the notes of all tasks add up to. These first counts name the candidates for the
commonest terms; a second pass counts the candidates exactly, probing a broadcast dictionary inside
each row. If no term ever left a table the first counts are exact already. The result is exact in
any case: where the notes leave room for a term that is no candidate, or there are too many
candidates to broadcast, full tables are handed on instead of thinned out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facets.constants import STOP_WORDS
from facets.operators.features import sum_matrices
from facets.session import attach, cut, ship_package

# Terms in a task's table, the part of them that a task hands on at its end, and candidates that are
# broadcast at most.
TABLE_TERMS = 1 << 19
HANDED_ON = 4
DICTIONARY = 200_000
_PART_BYTES = 1 << 20
_OUT_ROWS = 50_000
# A kept word that no dictionary knows.
_UNKNOWN = (1 << 31) - 1


def ranked(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows per group; hash-split groups are cut first, so that no task sorts one."""
    split = F.pmod(F.xxhash64("term"), F.lit(64))
    part = Window.partitionBy(group, split).orderBy(*order)
    whole = Window.partitionBy(group).orderBy(*order)
    return (df.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= n)
            .withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= n).drop("_r"))


def text_parts(batch, text_at: int) -> Iterator:
    """Slices of a batch whose texts together are of bounded size, or that are a single row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy())
    at = 0
    while at < len(batch):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + _PART_BYTES, side="right")))
        yield batch.slice(at, to - at)
        at = to


def term_keys(texts: pa.Array, numbers, stop_words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every term: words of two letters or more without stop words, then the pairs of
    neighbouring words.

    ``numbers`` maps a list of words to numbers from 1 on; a key is the number of the first word
    times 2^32, plus that of the second if there is one.
    """
    lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
    coded = lists.flatten().dictionary_encode()
    shown = coded.dictionary
    keep = pc.and_(pc.greater(pc.utf8_length(shown), 1),
                   pc.invert(pc.is_in(shown, value_set=stop_words)))
    number = np.zeros(len(shown), np.int64)
    # As objects of an array, which takes a small part of the time that a list of scalars does.
    known = shown.filter(keep).to_numpy(zero_copy_only=False).tolist()
    number[keep.to_numpy(zero_copy_only=False)] = numbers(known)
    words = number[coded.indices.to_numpy()]
    rows = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    rows, words = rows[words > 0], words[words > 0]
    pair = rows[1:] == rows[:-1]
    return (np.concatenate([rows, rows[1:][pair]]),
            np.concatenate([words << 32, (words[:-1][pair] << 32) | words[1:][pair]]))


def _added_up(keys, occurs, rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else order
    return (keys[starts], np.add.reduceat(occurs[order], starts) if len(keys) else occurs,
            np.add.reduceat(rows[order], starts) if len(keys) else rows)


class _Table:
    """Occurrences and rows of the terms of each group, as far as they fit."""

    def __init__(self, room: int):
        self.room = room
        self.words: dict[str, int] = {}
        self.counts: dict[object, tuple] = {}  # group: sorted keys, occurrences, rows
        self.fresh: dict[object, list] = {}
        self.waiting = 0
        self.left: dict[object, int] = {}  # per group: the largest counts that left, added up
        self.seen: dict[object, int] = {}  # rows of each group

    def numbers(self, words: list[str]) -> list[int]:
        known = self.words
        return [known.setdefault(w, len(known) + 1) for w in words]

    def add(self, groups: pa.Array, texts: pa.Array, stop_words: pa.Array) -> None:
        rows, keys = term_keys(texts, self.numbers, stop_words)
        coded = groups.dictionary_encode(null_encoding="encode")
        member = coded.indices.to_numpy()
        for code, group in enumerate(coded.dictionary.to_pylist()):
            self.seen[group] = self.seen.get(group, 0) + int((member == code).sum())
            mine = member[rows] == code
            key, row = keys[mine], rows[mine]
            # Rows stand in order under each key, so a row's cells come together.
            order = np.lexsort((row, key))
            key, row = key[order], row[order]
            once = np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])][:len(key)]
            self.fresh.setdefault(group, []).append(_added_up(
                key, np.ones(len(key), np.int64), once.astype(np.int64)))
            self.waiting += len(self.fresh[group][-1][0])

    def settle(self) -> int:
        """Add what came in; the number of terms held."""
        for group, parts in self.fresh.items():
            held = [self.counts[group]] if group in self.counts else []
            self.counts[group] = _added_up(*map(np.concatenate, zip(*held, *parts)))
        self.fresh, self.waiting = {}, 0
        return sum(len(c[0]) for c in self.counts.values())

    def thin(self, keep: int) -> None:
        """Let the rarest terms go until at most ``keep`` are held."""
        counts = np.concatenate([c[1] for c in self.counts.values()])
        limit = np.partition(counts, len(counts) - keep - 1)[len(counts) - keep - 1]
        for group, (keys, occurs, rows) in self.counts.items():
            gone = occurs <= limit
            self.left[group] = self.left.get(group, 0) + int(occurs[gone].max(initial=0))
            self.counts[group] = keys[~gone], occurs[~gone], rows[~gone]
        if len(self.words) > self.room // 2:
            self._forget_words()

    def _forget_words(self) -> None:
        """Number the words anew, those of held terms only."""
        held = np.unique(np.concatenate(
            [x for c in self.counts.values() for x in (c[0] >> 32, c[0] & 0xFFFFFFFF)]))
        held = held[held > 0]
        names = list(self.words)
        self.words = {names[i - 1]: n + 1 for n, i in enumerate(held)}
        for group, (keys, occurs, rows) in self.counts.items():
            first = np.searchsorted(held, keys >> 32) + 1
            second = np.where(keys & 0xFFFFFFFF, np.searchsorted(held, keys & 0xFFFFFFFF) + 1, 0)
            self.counts[group] = _added_up((first << 32) | second, occurs, rows)

    def empty(self) -> Iterator[tuple]:
        """Columns (g, term, cf, df) of all terms, a bounded number at a time; they are forgotten."""
        names = ["", *self.words]
        for group, counts in self.counts.items():
            for at in range(0, len(counts[0]), _OUT_ROWS):
                keys, occurs, rows = (c[at:at + _OUT_ROWS] for c in counts)
                terms = [f"{names[k >> 32]} {names[k & 0xFFFFFFFF]}" if k & 0xFFFFFFFF
                         else names[k >> 32] for k in keys.tolist()]
                yield [group] * len(terms), terms, occurs, rows
        self.words, self.counts = {}, {}


def _first_counts(rows: DataFrame, stop_words, room: int, thin: bool) -> DataFrame:
    """(g, term, cf, df) of every task; the row without a term has what left, and the row count."""
    dropped = list(stop_words)
    ship_package(rows.sparkSession)

    def kernel(batches):
        table, names, stops = _Table(room), ["g", "term", "cf", "df"], pa.array(dropped, pa.string())
        kind = None

        def out(columns):
            g, term, cf, df = columns
            return pa.RecordBatch.from_arrays(
                [pa.array(g, kind), pa.array(term, pa.string()), pa.array(cf, pa.int64()),
                 pa.array(df, pa.int64())], names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for part in text_parts(batch, 1):
                table.add(part.column(0), part.column(1), stops)
                if table.waiting > room and table.settle() > room:
                    if thin:
                        table.thin(room // 2)
                    else:
                        yield from map(out, table.empty())
        if kind is not None:
            if table.settle() > room // HANDED_ON and thin:
                table.thin(room // HANDED_ON)
            yield from map(out, table.empty())
            groups = list(table.seen)
            yield out((groups, [None] * len(groups), [table.left.get(g, 0) for g in groups],
                       [table.seen[g] for g in groups]))

    kind = rows.schema["g"].dataType.simpleString()
    return cut(rows.mapInArrow(kernel, f"g {kind}, term string, cf long, df long"))


class Known:
    """A list of terms to be met again: the sorted keys of those in it and their places."""

    def __init__(self, terms: list[str]):
        self.words: dict[str, int] = {}
        keys = []
        for term in terms:
            first, _, second = term.partition(" ")
            a, b = (self.words.setdefault(w, len(self.words) + 1) if w else 0
                    for w in (first, second))
            keys.append((a << 32) | b)
        self.places = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.array(keys, np.int64)[self.places]

    def numbers(self, words: list[str]) -> list[int]:
        return [self.words.get(w, _UNKNOWN) for w in words]

    def cells(self, texts: pa.Array, stop_words: pa.Array):
        """(row, place, tf) of the known terms of some texts, in this order."""
        rows, keys = term_keys(texts, self.numbers, stop_words)
        if not len(self.keys):
            return (np.empty(0, np.int64),) * 3
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        cells, tf = np.unique(rows[hit] * len(self.keys) + self.places[at[hit]], return_counts=True)
        return cells // len(self.keys), cells % len(self.keys), tf


def _merged(first: DataFrame) -> DataFrame:
    return first.where(F.col("term").isNotNull()).groupBy("g", "term").agg(
        F.sum("cf").alias("cf"), F.sum("df").alias("df"))


def _count_candidates(rows: DataFrame, known: list[tuple], stop_words) -> np.ndarray:
    """Occurrences and rows of each known (group as text, term)."""
    listed: dict = {}
    for i, (group, term) in enumerate(known):
        listed.setdefault(group, []).append((i, term))
    shared = rows.sparkSession.sparkContext.broadcast(
        {g: (np.array([i for i, _ in pairs]), Known([t for _, t in pairs]))
         for g, pairs in listed.items()})
    shape, dropped = (2, len(known)), list(stop_words)

    def partial(batches):
        total, stops = None, pa.array(dropped, pa.string())
        for frame in batches:
            total = np.zeros(shape) if total is None else total
            batch = pa.RecordBatch.from_arrays([pa.array(frame["g"], pa.string()),
                                                pa.array(frame["text"], pa.string())], ["g", "text"])
            for part in text_parts(batch, 1):
                for group, (places, terms) in shared.value.items():
                    mine = pc.is_null(part.column(0)) if group is None else \
                        pc.fill_null(pc.equal(part.column(0), group), False)
                    texts = part.column(1).filter(mine)
                    if len(texts):
                        _, at, tf = terms.cells(texts, stops)
                        np.add.at(total[0], places[at], tf)
                        np.add.at(total[1], places[at], 1)
        return total

    # Groups as text: pandas would turn numbers beside a null into floating ones.
    texts = rows.select(F.col("g").cast("string").alias("g"), "text")
    return sum_matrices(texts, partial, shape).astype(np.int64)


def _with(table: DataFrame, other: DataFrame) -> DataFrame:
    """Left join by group; the null group is a group like any other."""
    key = F.struct("g").alias("_key")
    joined = attach(table.select("*", key), other.select(
        key, *[c for c in other.columns if c != "g"]), "_key", "left")
    return joined.drop("_key")


def _bounded(table: DataFrame, sizes: DataFrame, min_df: int, max_df: float) -> DataFrame:
    enough = table.where(F.col("df") >= min_df)
    if max_df >= 1:
        return enough
    return (_with(enough, sizes.select("g", "n_docs"))
            .where(F.col("df") <= max_df * F.col("n_docs")).drop("n_docs"))


def _commonest(table, sizes, n: int, min_df: int, max_df: float) -> DataFrame:
    order = [F.desc("cf"), F.col("term")]
    return ranked(_bounded(table, sizes, min_df, max_df), "g", order, n).select(
        "g", "rank", "term", "cf", "df")


def common_terms(df: DataFrame, text: str, group: str | None, n: int, min_df: int = 1,
                 max_df: float = 1.0, stop_words=STOP_WORDS, room: int = TABLE_TERMS,
                 dictionary: int = DICTIONARY):
    """The ``n`` commonest terms of each group within the document-frequency bounds, exactly.

    Two tables: (g, rank, term, cf, df) by falling cf, then term; and (g, n_docs) with the rows of
    each group. ``group=None`` takes all rows as group 0.
    """
    rows = df.select((F.lit(0) if group is None else F.col(group)).alias("g"),
                     F.col(text).cast("string").alias("text"))
    first = _first_counts(rows, stop_words, room, thin=True)
    sizes = cut(first.where(F.col("term").isNull()).groupBy("g").agg(
        F.sum("df").alias("n_docs"), F.sum("cf").alias("error")))
    exact = _merged(first)
    if sizes.agg(F.max("error")).first()[0]:
        found = _from_candidates(rows, cut(exact), sizes, n, min_df, max_df, stop_words,
                                 dictionary)
        if found is not None:
            return found, sizes.select("g", "n_docs")
        exact = _merged(_first_counts(rows, stop_words, room, thin=False))
    return _commonest(exact, sizes, n, min_df, max_df), sizes.select("g", "n_docs")


def _from_candidates(rows, lower, sizes, n, min_df, max_df, stop_words, dictionary):
    """The commonest terms from an exact count of candidates, or None if it cannot be proved.

    A term that is no candidate occurs less often than ``reach``, or is in no table at all and so
    occurs at most ``error`` times. So the result stands for a group if its n-th term is beyond both,
    or if such terms are too rare to count.
    """
    order = [F.desc("cf"), F.col("term")]
    deep = ranked(lower, "g", order, 2 * n).groupBy("g").agg(
        F.min(F.when(F.col("rank") == 2 * n, F.col("cf"))).alias("_cf"))
    limits = cut(_with(sizes, deep).select(
        "g", "error", F.greatest(F.lit(min_df), F.coalesce("_cf", F.lit(0))).alias("reach")))
    candidates = (_with(lower.select("g", "term", "cf"), limits)
                  .where(F.col("cf") + F.col("error") >= F.col("reach"))
                  .select("g", "term", F.col("g").cast("string").alias("as_text")))
    known = candidates.limit(dictionary + 1).collect()
    if len(known) > dictionary:
        return None
    counts = _count_candidates(rows, [(r["as_text"], r["term"]) for r in known], stop_words)
    spark = rows.sparkSession
    table = spark.createDataFrame(
        [(r["g"], r["term"], int(c), int(d)) for r, c, d in zip(known, *counts)],
        f"g {rows.schema['g'].dataType.simpleString()}, term string, cf long, df long")
    found = cut(_commonest(table, sizes, n, min_df, max_df))
    last = found.groupBy("g").agg(F.count("*").alias("_n"), F.min("cf").alias("_last"))
    unseen = F.greatest(F.col("reach") - 1, F.col("error"))
    open_ = _with(limits, last).where(
        (unseen >= min_df)
        & ((F.coalesce("_n", F.lit(0)) < n) | (F.col("_last") <= unseen)))
    return found if open_.isEmpty() else None


def weighted_vectors(df: DataFrame, text: str, key: str, vocabulary: list[tuple],
                     stop_words=STOP_WORDS) -> DataFrame:
    """(key, indices, values): (1 + ln tf) x weight of the known terms of each text, at length one.

    ``vocabulary`` lists (term, weight), a term's place being its index. Each vector is built where
    its text lies; texts without a known term have no row.
    """
    spark, dropped = df.sparkSession, list(stop_words)
    shared = spark.sparkContext.broadcast(
        (Known([t for t, _ in vocabulary]), np.array([w for _, w in vocabulary], "f8")))
    ship_package(spark)

    def kernel(batches):
        known, weights = shared.value
        stops = pa.array(dropped, pa.string())
        for batch in batches:
            for part in text_parts(batch, 1):
                rows, places, tf = known.cells(part.column(1), stops)
                values = (1 + np.log(tf)) * weights[places] if len(rows) else np.empty(0)
                kept, starts = np.unique(rows, return_index=True)
                square = np.bincount(rows, values * values, minlength=len(part))
                values = values / np.sqrt(square[rows])
                ends = pa.array(np.r_[starts, len(rows)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(kept)),
                     pa.ListArray.from_arrays(ends, pa.array(places, pa.int32())),
                     pa.ListArray.from_arrays(ends, pa.array(values, pa.float64()))],
                    [key, "indices", "values"])

    rows = df.select(key, F.col(text).cast("string").alias("text"))
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(kernel, f"`{key}` {kind}, indices array<int>, values array<double>")
