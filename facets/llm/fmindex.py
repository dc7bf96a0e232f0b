"""Benchmark decontamination with an FM-index for every shard of training documents.

A shard is a bounded run of documents of one partition. Its words become symbols: a number for
each word that occurs in the benchmark, and a border for any other. Only stretches between borders
that are as long as the shortest window can hold an occurrence, so only they are indexed. Windows
are searched backwards, all of them in step, over ranks of a wavelet matrix; occurrences are
located through sampled suffix positions; overlapping ones merge into removal spans.

Defined cases: a null text has no words; a benchmark item without id or without words takes no
part; items that share an id count once; whole-number item ids come back as long, all others as
string; rows with the same document id each keep their row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from facets.llm.batches import texts, tidy
from facets.session import cut, ship_package

WINDOW = 10
SHARD_WORDS = 1_000_000
# Benchmark text searched in one pass; a larger benchmark takes more passes over the documents.
BLOCK_BYTES = 32 << 20
SAMPLE = 8
# Windows searched in step.
SLICE = 1 << 17

# Every ASCII byte that is neither digit nor letter separates words.
_BLANKED = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of digits, a-z and characters beyond ASCII."""
    return text.translate(_BLANKED).lower().split() if text else []


class Bits:
    """A bit vector with constant-time ranks."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(
            ([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))[:-1]

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Set bits before place i."""
        word = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """Ranks of any symbol in a sequence of small numbers."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = []
        for shift in range(max(1, int(top).bit_length()) - 1, -1, -1):
            bit = (symbols >> shift) & 1
            self.levels.append((shift, Bits(bit), int(len(bit) - bit.sum())))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))

    def walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where prefixes of length i end once all levels have sorted ``symbol`` together."""
        for shift, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where((symbol >> shift) & 1, zeros + ones, i - ones)
        return i

    def symbol_at(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at places i, and where the walk ends."""
        symbol = np.zeros(len(i), np.int64)
        for shift, bits, zeros in self.levels:
            bit = bits.at(i).astype(np.int64)
            symbol |= bit << shift
            ones = bits.rank(i)
            i = np.where(bit, zeros + ones, i - ones)
        return symbol, i


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; a border (0) sorts by its place and ends every suffix."""
    n = len(symbols)
    border = symbols == 0
    n_borders = int(border.sum())
    rank = np.where(border, np.cumsum(border) - 1, symbols + n_borders).astype(np.int64)
    step = 1
    order = np.argsort(rank, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.cumsum(np.concatenate(([0], np.diff(rank[order]) != 0)))
    # Only suffixes that still tie are sorted further.
    while True:
        ranked = place[order]
        same = np.concatenate((ranked[1:] == ranked[:-1], [False]))
        tied = same | np.concatenate(([False], same[:-1]))
        if not tied.any():
            return order
        slots = np.flatnonzero(tied)
        who = order[slots]
        follow = place[np.minimum(who + step, n - 1)]
        mixed = np.lexsort((follow, place[who]))
        who = who[mixed]
        order[slots] = who
        group, follow = place[who], follow[mixed]
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])))
        fresh = np.maximum.accumulate(np.where(new, slots, 0))
        # A rank is the slot at which its group begins, so ranks of settled suffixes stay valid.
        settled = np.flatnonzero(~tied)
        renewed = np.empty(n, np.int64)
        renewed[order[settled]] = settled
        renewed[who] = fresh
        place = renewed
        step *= 2


class FmIndex:
    """Counts and locates symbol strings in a text whose stretches each end with a border (0)."""

    def __init__(self, symbols: np.ndarray, top: int, sample: int = SAMPLE):
        order = suffix_order(symbols)
        last = symbols[order - 1]
        self.size = len(symbols)
        self.ranks = WaveletMatrix(last, top)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=top + 1))))
        border = symbols == 0
        begins = np.concatenate(([0], np.flatnonzero(border)[:-1] + 1))
        lengths = np.diff(np.concatenate((begins, [len(symbols)])))
        offset = np.arange(len(symbols)) - np.repeat(begins, lengths)
        sampled = (offset % sample == 0)[order]
        self.marks = Bits(sampled)
        self.places = order[sampled]
        self.base = self.ranks.walk(np.arange(top + 1), np.zeros(top + 1, np.int64))

    def search(self, patterns: np.ndarray, lengths: np.ndarray):
        """Ranges of suffixes that begin with each pattern (rows, padded at the right)."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.size)
        for back in range(1, patterns.shape[1] + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            if not len(live):
                break
            c = patterns[live, lengths[live] - back]
            both = self.ranks.walk(np.concatenate((c, c)), np.concatenate((low[live], high[live])))
            at = self.first[c] - self.base[c]
            low[live], high[live] = at + both[:len(live)], at + both[len(live):]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of the given suffixes, stepping back to the nearest sampled one."""
        rows, found, steps = rows.copy(), np.full(len(rows), -1), 0
        open_ = np.arange(len(rows))
        while len(open_):
            hit = self.marks.at(rows[open_]).astype(bool)
            done = open_[hit]
            found[done] = self.places[self.marks.rank(rows[done])] + steps
            open_ = open_[~hit]
            c, end = self.ranks.symbol_at(rows[open_])
            rows[open_] = self.first[c] + end - self.base[c]
            steps += 1
        return found


def run_names(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A number for each run of words, the same exactly where the runs are the same.

    Runs of doubled length are named by the names of their halves; any other run by the two runs of
    the next smaller power of two that cover it.
    """
    names = np.zeros(len(starts), np.int64)
    level, span, taken = words.astype(np.int64), 1, 0
    width = len(words) + 1
    for n in np.unique(lengths).tolist():
        while 2 * span <= n:
            halves = level * width
            halves[:-span] += level[span:]
            level = np.unique(halves, return_inverse=True)[1]
            span *= 2
        at = np.flatnonzero(lengths == n)
        found, number = np.unique(level[starts[at]] * width + level[starts[at] + n - span],
                                  return_inverse=True)
        names[at] = number + taken
        taken += len(found)
    return names


class Windows:
    """The distinct windows of a block of benchmark items, as slices of the items' word numbers.

    It is built once on the driver and broadcast: beside the vocabulary, four bytes for each word
    of the items and about twenty for each distinct window.
    """

    def __init__(self, items: list[tuple], size: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        owners, parts = [], []
        for item, text in items:
            part = np.fromiter((number(w, len(self.vocabulary) + 1) for w in words_of(text)),
                               np.int32)
            if len(part):
                owners.append(item)
                parts.append(part)
        self.top = len(self.vocabulary)
        self.items = sorted(set(owners))
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        sizes = np.array([len(p) for p in parts], np.int64)
        counts = np.maximum(1, sizes - size + 1)
        shift = np.cumsum(sizes) - sizes - np.cumsum(counts) + counts
        starts = np.arange(counts.sum()) + np.repeat(shift, counts)
        lengths = np.repeat(np.minimum(sizes, size), counts)
        names = run_names(self.words, starts, lengths)
        _, first = np.unique(names, return_index=True)
        self.starts, self.lengths = starts[first].astype(np.int32), lengths[first].astype(np.int32)
        self.shortest = int(lengths.min()) if len(lengths) else 0
        place = {item: k for k, item in enumerate(self.items)}
        owner = np.repeat(np.array([place[o] for o in owners], np.int64), counts)
        owned = np.unique(names * max(1, len(self.items)) + owner)
        self.owner = (owned % max(1, len(self.items))).astype(np.int32)
        self.owner_start = np.searchsorted(owned // max(1, len(self.items)),
                                           np.arange(len(first) + 1))

    def held_by(self, symbols: np.ndarray) -> np.ndarray:
        """Windows all of whose words are among the symbols; no other can occur in them."""
        present = np.zeros(self.top + 1, bool)
        present[symbols] = True
        known = np.concatenate(([0], np.cumsum(present[self.words], dtype=np.int32)))
        return np.flatnonzero(known[self.starts + self.lengths] - known[self.starts]
                              == self.lengths)

    def patterns(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of word numbers, padded at the right, and their lengths."""
        lengths = self.lengths[which].astype(np.int64)
        column = np.arange(lengths.max())
        at = np.minimum(self.starts[which][:, None] + column, len(self.words) - 1)
        return np.where(column < lengths[:, None], self.words[at], 0).astype(np.int64), lengths


def search_shard(sizes: np.ndarray, symbols: np.ndarray, windows: Windows):
    """Per document of a shard: hit words, items, merged spans of word places [start, end).

    ``symbols`` are all words of the shard in order, ``sizes`` the words of each document.
    """
    n_docs = len(sizes)
    hits = np.zeros(n_docs, np.int64)
    items = [[] for _ in range(n_docs)]
    spans = [[] for _ in range(n_docs)]
    doc = np.repeat(np.arange(n_docs), sizes)
    known = symbols > 0
    begins = known & ~np.concatenate(([False], known[:-1] & (doc[1:] == doc[:-1])))[:len(known)]
    stretch = np.cumsum(begins) * known
    length = np.bincount(stretch)
    wide = known & (length[stretch] >= max(1, windows.shortest))
    if not windows.shortest or not wide.any():
        return hits, items, spans
    place = np.flatnonzero(wide)
    # One border behind each stretch.
    ends = np.concatenate((np.diff(stretch[place]) != 0, [True]))
    at = np.arange(len(place)) + np.concatenate(([0], np.cumsum(ends)[:-1]))
    text = np.zeros(len(place) + int(ends.sum()), np.int64)
    text[at] = symbols[place]
    word_at = np.full(len(text), -1)
    word_at[at] = place
    held = windows.held_by(text)
    if not len(held):
        return hits, items, spans
    index = FmIndex(text, windows.top)
    change = np.zeros(len(text) + 1, np.int64)
    pairs = []
    for lo in range(0, len(held), SLICE):
        names = held[lo:lo + SLICE]
        patterns, lengths = windows.patterns(names)
        low, high = index.search(patterns, lengths)
        counts = np.maximum(high - low, 0)
        if not counts.any():
            continue
        which = np.repeat(np.arange(len(counts)), counts)
        ahead = np.concatenate(([0], np.cumsum(counts)[:-1]))
        where = index.locate(low[which] + np.arange(len(which)) - ahead[which])
        change += np.bincount(where, minlength=len(change))
        change -= np.bincount(where + lengths[which], minlength=len(change))
        pairs.append(np.unique(np.stack((doc[word_at[where]], names[which])), axis=1))
    if not pairs:
        return hits, items, spans
    covered = np.cumsum(change)[:-1] > 0
    hit_words = word_at[covered]
    hits += np.bincount(doc[hit_words], minlength=n_docs)
    offset = np.concatenate(([0], np.cumsum(sizes)))
    breaks = np.flatnonzero((np.diff(hit_words) != 1) | (np.diff(doc[hit_words]) != 0))
    for a, b in zip(hit_words[np.concatenate(([0], breaks + 1))].tolist(),
                    hit_words[np.concatenate((breaks, [len(hit_words) - 1]))].tolist()):
        d = int(doc[a])
        spans[d].append((a - int(offset[d]), b + 1 - int(offset[d])))
    pairs = np.concatenate(pairs, axis=1)
    pairs = pairs[:, np.argsort(pairs[0], kind="stable")]
    hit_docs, begin = np.unique(pairs[0], return_index=True)
    owned = windows.owner_start
    for d, names in zip(hit_docs.tolist(), np.split(pairs[1], begin[1:])):
        found = np.unique(np.concatenate([windows.owner[owned[w]:owned[w + 1]] for w in names]))
        items[d] = [windows.items[i] for i in found.tolist()]
    return hits, items, spans


def search_batches(batches, windows: Windows, shard_words: int, column: int):
    """Shards of record batches with what was found in each: (batches, sizes, hits, items, spans)."""
    held, sizes, symbols, total = [], [], [], 0
    number = windows.vocabulary.get

    def flush():
        found = search_shard(np.array(sizes, np.int64),
                             np.concatenate(symbols) if symbols else np.zeros(0, np.int64), windows)
        return (held, sizes, *found)

    for batch in batches:
        held.append(batch)
        for text in texts(batch.column(column)):
            words = words_of(text)
            sizes.append(len(words))
            symbols.append(np.fromiter((number(w, 0) for w in words), np.int64, len(words)))
            total += len(words)
        if total >= shard_words:
            yield flush()
            held, sizes, symbols, total = [], [], [], 0
    if held:
        yield flush()
    tidy()


def item_type(benchmark: DataFrame) -> str:
    """Whole-number item ids come back as long, all others as string."""
    return "long" if isinstance(benchmark.schema["item_id"].dataType, IntegralType) else "string"


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list]:
    """Benchmark items in blocks of bounded size; the driver holds one block at a time."""
    block, size = [], 0
    rows = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("item_id").cast(item_type(benchmark)).alias("item_id"),
        F.col("text").cast("string").alias("text"))
    for item, text in rows.toLocalIterator():
        raw = text.encode()
        if block and size + len(raw) > block_bytes:
            yield block
            block, size = [], 0
        block.append((item, raw))
        size += len(raw)
    yield block


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) of every row; spans are word places [start, end).

    A document is searched where it lies: no shuffle. The windows of a block are broadcast. A
    benchmark beyond ``block_bytes`` is searched in several passes, each adding its spans to those
    found before.
    """
    ship_package(docs.sparkSession)
    share = docs.sparkSession.sparkContext.broadcast
    items = f"array<{item_type(benchmark)}>"
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumns({
        "items": F.lit(None).cast(items),
        "spans": F.lit(None).cast("array<struct<start:long,end:long>>")})
    schema = (f"doc_id {id_type}, text string, n_words long, n_hit long, items {items}, "
              "spans array<struct<start:long,end:long>>")
    blocks, ahead = item_blocks(benchmark, block_bytes), []
    ahead = next(blocks)
    while ahead is not None:
        block, ahead = ahead, next(blocks, None)
        rows = rows.select("doc_id", "text", "items", "spans").mapInArrow(
            _searcher(share(Windows(block, window)), shard_words, ahead is None), schema)
        if ahead is not None:
            rows = cut(rows)
    return rows.select("doc_id", "n_words", "n_hit", "items", "spans")


def _searcher(windows, shard_words, last):
    def kernel(batches):
        for held, sizes, _, items, spans in search_batches(batches, windows.value, shard_words, 1):
            at = 0
            for batch in held:
                n = batch.num_rows
                ids = batch.column(2).type
                old_items = [x or [] for x in batch.column(2).to_pylist()]
                old = [[(s["start"], s["end"]) for s in x or []]
                       for x in batch.column(3).to_pylist()]
                now = [_merged(a + b) for a, b in zip(old, spans[at:at + n])]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0),
                    pa.nulls(n, pa.string()) if last else batch.column(1).cast(pa.string()),
                    pa.array(sizes[at:at + n], pa.int64()),
                    pa.array([sum(b - a for a, b in x) for x in now], pa.int64()),
                    pa.array([sorted({*a, *b}) for a, b in zip(old_items, items[at:at + n])],
                             pa.list_(ids.value_type)),
                    pa.array([[{"start": a, "end": b} for a, b in x] for x in now], _SPANS)],
                    ["doc_id", "text", "n_words", "n_hit", "items", "spans"])
                at += n
    return kernel


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                      shard_words: int = SHARD_WORDS,
                      block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents in which no benchmark window occurs, with all their columns."""
    ship_package(docs.sparkSession)
    share = docs.sparkSession.sparkContext.broadcast
    text_at = docs.columns.index("text")
    blocks = item_blocks(benchmark, block_bytes)
    ahead = next(blocks)
    while ahead is not None:
        block, ahead = ahead, next(blocks, None)

        def kernel(batches, windows=share(Windows(block, window))):
            for held, _, hits, _, _ in search_batches(batches, windows.value, shard_words, text_at):
                at = 0
                for batch in held:
                    yield batch.filter(pa.array(hits[at:at + batch.num_rows] == 0))
                    at += batch.num_rows

        docs = docs.mapInArrow(kernel, docs.schema)
        if ahead is not None:
            docs = cut(docs)
    return docs
