"""Spelling variant grouping by dense prefix-suffix tiling.

Words that differ by one inserted, deleted or replaced code point agree on a prefix and a suffix that
together cover the longer word but for one code point. Laid out as padded code-point matrices, a
block of words is compared with another one column by column: the length of the common prefix plus
that of the common suffix tells all single edits of the block pair at once.

Which blocks meet follows from the same fact. Cut a word of length m into ``PARTS`` parts: a single
edit lies in one of them, so near words share all that stands before and behind it. Every word is
entered under (m, part, what surrounds the part), once as the shorter and once as the longer word of
a pair; words under one key form a tile. A pair that shares several keys is reported under the first
only. A key with more words than ``TILE_ROWS`` (or code points than ``TILE_CELLS``) is dealt into
blocks by hash, and each pair of blocks is a tile of its own, so no task holds a whole key. Links
leave a tile as one row per word, holding their number and the best of them.

Defined cases: a null or empty text has no words; repeated rows of a document count again; a null
doc_id is spelled as nothing in the noise hash; ties between forms go to the smallest word in
code-point order; words without near words have n_near 0 and no form; an empty table gives no words;
columns beside those named are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facets.session import attach, cut, ship_package

RUNS = r"[A-Za-zÀ-ÿ]"
PARTS = 3
TILE_ROWS = 1024
TILE_CELLS = 1 << 22
# Keys of fewer words are compared pair by pair, many keys in one numpy call.
_DENSE = 32
_PAIRS = 1 << 17


def lower_ascii(run: Column) -> Column:
    """Lower-case A-Z alone; a run without other letters takes the short way."""
    letters = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    return (F.when(F.octet_length(run) == F.length(run), F.lower(run))
            .otherwise(F.translate(run, letters, letters.lower())))


def word_counts(docs: DataFrame, min_length: int = 7, min_count: int = 2,
                drop_every: int | None = None) -> DataFrame:
    """(word, n): lower-cased letter runs of whole texts, by their number of occurrences.

    With ``drop_every``, a run whose crc32 of ``<doc_id>:<run>`` it divides loses the code point at
    that hash modulo its length, which plants misspellings.
    """
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"{RUNS}{{{min_length},}}"),
                                F.lit(0))
    words = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"),
                        F.explode(runs).alias("_run"))
    words = words.select("_id", lower_ascii(F.col("_run")).alias("word"))
    if drop_every is not None:
        hashed = F.crc32(F.concat("_id", F.lit(":"), "word").cast("binary"))
        at = (F.col("_h") % F.length("word")).cast("int")
        kept = F.concat(F.substring("word", F.lit(1), at),
                        F.substring("word", at + 2, F.length("word")))
        words = words.withColumn("_h", hashed).withColumn(
            "word", F.when(F.col("_h") % drop_every == 0, kept).otherwise(F.col("word")))
    return (words.where(F.length("word") >= min_length)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count))


def _entries(words: DataFrame, parts: int) -> DataFrame:
    """Every word under its keys: (m, part, key, longer, word, n)."""
    size = F.length("word")
    offers = []
    for longer in (0, 1):
        m = size - longer
        for part in range(parts):
            before = F.floor(m * part / parts).cast("int")
            behind = m - F.floor(m * (part + 1) / parts).cast("int")
            key = F.xxhash64(m, F.lit(part), F.substring("word", F.lit(1), before),
                             F.substring("word", size - behind + 1, behind))
            offers.append(F.struct(m.alias("m"), F.lit(part).alias("part"), key.alias("key"),
                                   F.lit(longer).alias("longer")))
    shortest = F.col("m") > 0
    return words.select("word", "n", F.inline(F.array(*offers))).where(shortest)


def _tiles(entries: DataFrame, tile_rows: int, tile_cells: int) -> DataFrame:
    """Entries with the tile (x, y) they take part in; a full key becomes pairs of blocks."""
    keys = ["m", "part", "key"]
    room = F.greatest(F.lit(1), F.least(F.lit(tile_rows),
                                        F.floor(F.lit(tile_cells) / (F.col("m") + 1))))
    full = (entries.groupBy(*keys).agg(F.count("*").alias("_n"))
            .withColumn("blocks", F.ceil(F.col("_n") / room).cast("int"))
            .where(F.col("blocks") > 1).select(*keys, "blocks"))
    dealt = attach(entries, full, keys, "left")
    block = F.coalesce(F.pmod(F.xxhash64("word", F.lit(7)), F.col("blocks")).cast("int"), F.lit(0))
    others = F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1)
    return (dealt.withColumn("block", block).withColumn("_other", F.explode(others))
            .select(*keys, F.least("block", "_other").alias("x"),
                    F.greatest("block", "_other").alias("y"), "block", "longer", "word", "n"))


def code_points(words: list[str], width: int) -> np.ndarray:
    """Words as rows of code points, padded with zeros, in the narrowest type that holds them."""
    cells = np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width)
    top = int(cells.max(initial=0))
    return cells.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)


def _agree(equal, shape: tuple, m: int) -> np.ndarray:
    """How many of the first m columns agree without a gap; ``equal`` gives one column."""
    alive, length = np.ones(shape, bool), np.zeros(shape, np.uint8 if m < 255 else np.int32)
    for c in range(m):
        alive &= equal(c)
        if not alive.any():
            break
        length += alive
    return length


def _first_part(prefix: np.ndarray, suffix: np.ndarray, m: int, parts: int) -> np.ndarray:
    """The first part whose surroundings agree, given the common prefix and suffix."""
    out = np.full(prefix.shape, parts)
    for part in reversed(range(parts)):
        shared = (prefix >= m * part // parts) & (suffix >= m - m * (part + 1) // parts)
        out[shared] = part
    return out


def compare_block(a: np.ndarray, b: np.ndarray, m: int, more: int, part: int,
                  parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) of one tile that are a single edit apart and belong to ``part``.

    Words of ``a`` have length m, those of ``b`` length m + more; all are different words.
    """
    shape = len(a), len(b)
    prefix = _agree(lambda c: a[:, c][:, None] == b[:, c][None], shape, m)
    suffix = _agree(lambda c: a[:, m - 1 - c][:, None] == b[:, m + more - 1 - c][None], shape, m)
    i, j = np.nonzero(prefix.astype(np.int32) + suffix >= m + more - 1)
    mine = _first_part(prefix[i, j], suffix[i, j], m, parts) == part
    return i[mine], j[mine]


def _compare_pairs(cells, i, j, m: int, more: int, part: int, parts: int) -> np.ndarray:
    """The same for listed pairs of rows: which of them are near and belong to ``part``."""
    near = np.zeros(len(i), bool)
    step = max(1, _PAIRS * 8 // (m + 1))
    for at in range(0, len(i), step):
        a, b = cells[i[at:at + step]], cells[j[at:at + step]]
        shape = len(a)
        prefix = _agree(lambda c: a[:, c] == b[:, c], shape, m)
        suffix = _agree(lambda c: a[:, m - 1 - c] == b[:, m + more - 1 - c], shape, m)
        hit = np.flatnonzero(prefix.astype(np.int32) + suffix >= m + more - 1)
        mine = _first_part(prefix[hit], suffix[hit], m, parts) == part
        near[at + hit[mine]] = True
    return near


def _tile_links(cells, longer, side, starts, ends, m: int, part: int, parts: int):
    """Near pairs (i, j) inside tiles of one length and part; rows of a tile are starts to ends.

    ``side`` is -1 for a tile of a block with itself, else which of its two blocks a row belongs to.
    """
    found = []
    sizes = ends - starts
    for s, e in zip(starts[sizes >= _DENSE], ends[sizes >= _DENSE]):
        rows = np.arange(s, e)
        short, long_ = rows[longer[s:e] == 0], rows[longer[s:e] == 1]
        within = side[s] < 0
        meetings = [(short, short, 0), (short, long_, 1)] if within else [
            (short[side[short] == 0], short[side[short] == 1], 0),
            (short[side[short] == 0], long_[side[long_] == 1], 1),
            (short[side[short] == 1], long_[side[long_] == 0], 1)]
        for left, right, more in meetings:
            if len(left) and len(right):
                i, j = compare_block(cells[left], cells[right], m, more, part, parts)
                i, j = left[i], right[j]
                keep = i < j if within and not more else slice(None)
                found.append((i[keep], j[keep]))
    small = sizes < _DENSE
    tile = np.repeat(np.arange(int(small.sum())), sizes[small])
    rows = np.concatenate([np.arange(s, e) for s, e in zip(starts[small], ends[small])] or [[]])
    rows = rows.astype(np.int64)
    for step in range(1, int(sizes[small].max(initial=0))):
        same = np.flatnonzero(tile[step:] == tile[:-step])
        i, j = rows[same], rows[same + step]
        meet = (side[i] < 0) | (side[i] != side[j])
        for more in (0, 1):
            mine = meet & (longer[i] + longer[j] == more)
            a, b = i[mine], j[mine]
            swap = longer[a] > longer[b]
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            near = _compare_pairs(cells, a, b, m, more, part, parts)
            found.append((a[near], b[near]))
    i = np.concatenate([f[0] for f in found] or [np.empty(0, np.int64)])
    j = np.concatenate([f[1] for f in found] or [np.empty(0, np.int64)])
    return np.concatenate([i, j]), np.concatenate([j, i])


def _near_rows(table: pa.Table, parts: int, tile_cells: int):
    """(word, links, minus_n, form) of sorted whole tiles: number and best of each word's links."""
    m, part, key, x, y, block, longer, n = (
        table[c].to_numpy() for c in ("m", "part", "key", "x", "y", "block", "longer", "n"))
    words = table["word"]
    change = np.zeros(len(m), bool)
    for column in (m, part, key, x, y):
        change[1:] |= column[1:] != column[:-1]
    starts = np.flatnonzero(np.r_[True, change[1:]])
    ends = np.r_[starts[1:], len(m)]
    side = np.where(x == y, -1, (block == y).astype(np.int64))
    first = 0
    while first < len(starts):
        # As many tiles of one length and part as fit the room for code points.
        length, k = m[starts[first]], part[starts[first]]
        reach = np.searchsorted(ends, starts[first] + max(1, 2 * tile_cells // (length + 1)),
                                side="right")
        odd = np.flatnonzero((m[starts[first:reach]] != length) | (part[starts[first:reach]] != k))
        last = max(first + 1, min(reach, first + odd[0]) if len(odd) else reach)
        lo, hi = starts[first], ends[last - 1]
        spelled = words.slice(lo, hi - lo).to_pylist()
        i, j = _tile_links(code_points(spelled, int(length) + 1), longer[lo:hi], side[lo:hi],
                           starts[first:last] - lo, ends[first:last] - lo, int(length), int(k),
                           parts)
        first = last
        if not len(i):
            continue
        # Rows of a tile are in order of their words, so the row number settles ties.
        mine = n[lo:hi]
        order = np.lexsort((j, -mine[j], i))
        i, j = i[order], j[order]
        at = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        yield pa.RecordBatch.from_arrays(
            [pa.array([spelled[r] for r in i[at]], pa.string()),
             pa.array(np.diff(np.r_[at, len(i)]), pa.int64()),
             pa.array(-mine[j[at]], pa.int64()),
             pa.array([spelled[r] for r in j[at]], pa.string())],
            ["word", "links", "minus_n", "form"])


def near_words(words: DataFrame, parts: int = PARTS, tile_rows: int = TILE_ROWS,
               tile_cells: int = TILE_CELLS) -> DataFrame:
    """(word, links, minus_n, form): parts of each word's near words, to be added up per word."""
    ship_package(words.sparkSession)
    order = ["m", "part", "key", "x", "y"]
    tiles = (_tiles(_entries(words, parts), tile_rows, tile_cells)
             .repartition("key", "x", "y").sortWithinPartitions(*order, "word"))

    def kernel(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            # The last tile may go on in the next batch.
            same = np.ones(len(rows), bool)
            for column in order:
                values = rows[column].to_numpy()
                same &= values == values[-1]
            whole = len(rows) - (int(np.argmin(same[::-1])) if not same.all() else len(rows))
            if whole:
                yield from _near_rows(rows.slice(0, whole).combine_chunks(), parts, tile_cells)
            held = rows.slice(whole)
        if held is not None and len(held):
            yield from _near_rows(held.combine_chunks(), parts, tile_cells)

    return tiles.mapInArrow(kernel, "word string, links long, minus_n long, form string")


def follow(forms: DataFrame) -> DataFrame:
    """(word, root): where the chain of forms that starts at each word ends.

    ``forms`` has (word, form) without cycles. Chains are followed by doubling, so a chain of length
    l takes log2(l) joins.
    """
    hooks = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        above = hooks.select(F.col("word").alias("root"), F.col("root").alias("up"))
        jumped = cut(hooks.join(above, "root", "left").select(
            "word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")))
        hooks = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            return hooks


def variants(words: DataFrame, ratio: int = 10, parts: int = PARTS, tile_rows: int = TILE_ROWS,
             tile_cells: int = TILE_CELLS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for distinct words with counts (word, n).

    A word's form is its near word of largest n, if that is at least ``ratio`` times its own.
    """
    words = cut(words.select("word", "n"))
    itself = words.select("word", F.lit(0).cast("long").alias("links"),
                          F.lit(None).cast("long").alias("minus_n"),
                          F.lit(None).cast("string").alias("form"), "n")
    near = near_words(words, parts, tile_rows, tile_cells).withColumn(
        "n", F.lit(None).cast("long"))
    best = F.min(F.when(F.col("form").isNotNull(), F.struct("minus_n", "form")))
    summed = itself.union(near).groupBy("word").agg(
        F.max("n").alias("n"), F.sum("links").alias("n_near"), best.alias("_best"))
    chosen = -F.col("_best.minus_n") >= ratio * F.col("n")
    found = cut(summed.select(
        "word", F.when(chosen, F.col("_best.form")).alias("form"), "n", "n_near",
        F.when(chosen, -F.col("_best.minus_n")).alias("form_n")))
    roots = follow(found.where(F.col("form").isNotNull()))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
