"""Best-fit packing of token sequences.

Documents are cut into pieces of at most the capacity. Best-fit decreasing only looks at lengths,
and bins with the same room left are alike. So the driver packs the histogram of lengths, which
has at most ``capacity`` entries however many documents there are: for each length, longest first,
a segment tree over remaining capacities gives the tightest open room, and as many pieces as there
are such bins go there at once. What comes out are runs: the k-th to l-th piece of a length go to
consecutive bins at one offset. Pieces are numbered within their length by a range sort, and each
looks its run up.

Defined cases: a null text is an empty one; every document, also an empty one, ends with the end
token; equal lengths are dealt by id, then checksum; rows with the same id are packed as they are.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facets.llm.batches import texts, tidy
from facets.llm.bytebpe import byte_characters
from facets.operators.rows import with_index
from facets.session import cut, ship_package

CAPACITY = 4096
END = 1
# Parts a Python worker remembers (two generations of this many), and the longest one worth it.
_GENERATION = 250_000
_LONG_PART = 64
# How tokenizer files of this family normalise and cut texts.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# White space, printable ASCII and the letters U+00C0 to U+00FF: NFC leaves such a text as it is,
# lower-casing goes letter by letter, and the cut is this one.
_PLAIN = re.compile("[ \t-\r!-~À-ÖØ-öø-ÿ]*")
_PLAIN_CUT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t-\ra-zß-öø-ÿ0-9]+")


class ChunkTokens:
    """Token ids of texts, part by part, as bytes of unsigned 32-bit numbers.

    For a tokenizer that drops white space and lets no token cross it, the ids of a text are those
    of its blank-separated chunks in order. Where the file cuts chunks the known way, plain text is
    cut here into the file's own pieces, so that ``Word``, ``word,`` and ``(word`` share what the
    library says about ``word``; any other chunk goes to the library whole. Parts repeat, so their
    ids are remembered.
    """

    def __init__(self, path: str):
        # Spark runs a worker per core already.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        settings = json.loads(self.tokenizer.to_str())
        steps = [n["type"] for n in (settings["normalizer"] or {}).get("normalizers", [])]
        cuts = [p.get("pattern", {}).get("Regex")
                for p in (settings["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.known_cut = steps == _NORMALIZERS and cuts == [_CUT, None]
        # A piece needs neither normalising nor cutting, only its bytes spelled as the model does.
        self.model, shown = self.tokenizer.model, byte_characters()
        self.spelling = str.maketrans({c: "".join(shown[b] for b in chr(c).encode())
                                       for c in range(0x80, 0x100)})
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _parts(self, text: str) -> list[str]:
        if self.known_cut and _PLAIN.fullmatch(text):
            return _PLAIN_CUT.findall(text.lower())
        parts = []
        for chunk in text.encode().split():
            chunk = chunk.decode()
            if self.known_cut and _PLAIN.fullmatch(chunk):
                parts += _PLAIN_CUT.findall(chunk.lower())
            else:
                parts.append(chunk)
        return parts

    def _learn(self, parts: list[str]) -> dict[str, bytes]:
        pieces = [p for p in parts if self.known_cut and _PLAIN.fullmatch(p)]
        spelled, tokens = self.spelling, self.model.tokenize
        out = {p: array("I", [t.id for t in tokens(p.translate(spelled))]).tobytes()
               for p in pieces}
        others = [p for p in parts if p not in out]
        coded = self.tokenizer.encode_batch_fast(others, add_special_tokens=False)
        out.update((p, array("I", e.ids).tobytes()) for p, e in zip(others, coded))
        return out

    def ids(self, text: bytes | None) -> bytes:
        parts = self._parts(text.decode()) if text else []
        if len(self.young) > _GENERATION:
            self.young, self.old = {}, self.young
        fresh = {*parts}.difference(self.young)
        if not fresh:
            return b"".join(map(self.young.__getitem__, parts))
        known = {p: self.old[p] for p in fresh if p in self.old}
        learned = self._learn(list(fresh.difference(known)))
        self.young.update(known)
        self.young.update((p, i) for p, i in learned.items() if len(p) <= _LONG_PART)
        if any(len(p) > _LONG_PART for p in learned):
            return b"".join(learned[p] if p in learned else self.young[p] for p in parts)
        return b"".join(map(self.young.__getitem__, parts))


_coders: dict[str, ChunkTokens] = {}


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY,
           end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document, cut at the capacity."""
    ship_package(docs.sparkSession)

    def kernel(batches):
        coder = _coders.get(tokenizer_path)
        if coder is None:
            coder = _coders[tokenizer_path] = ChunkTokens(tokenizer_path)
        last = array("I", [end]).tobytes()
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for k, text in enumerate(texts(batch.column(1))):
                raw = coder.ids(text) + last
                count = len(raw) // 4
                for n, at in enumerate(range(0, count, capacity)):
                    size = min(capacity, count - at)
                    row.append(k)
                    piece.append(n)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(raw[4 * at:4 * (at + size)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                 pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"])
        tidy()

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(kernel, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, "
                                   "piece int, start long, length long, ids_crc32 long")


class RoomTree:
    """Segment tree over remaining capacities: which rooms have open bins."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = np.zeros(2 * self.leaves, bool)

    def put(self, room: int, open_: bool) -> None:
        at = room + self.leaves
        self.any[at] = open_
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, need: int) -> int | None:
        """The smallest room of at least ``need`` with an open bin, in logarithmic time."""
        at = need + self.leaves
        if self.any[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit_runs(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple]:
    """Best-fit decreasing on a histogram of lengths: runs (length, first, count, bin, offset).

    Pieces ``first`` .. ``first + count - 1`` of a length go to bins ``bin``, ``bin + 1``, ... at
    ``offset``. Open bins with the same room are kept as ranges of bin numbers.
    """
    tree, rooms, bins, out = RoomTree(capacity), {}, 0, []
    for length in sorted(histogram, reverse=True):
        left, dealt = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, count = capacity, bins, left
            else:
                first, count = rooms[room].pop()
            # The bin just used is now the tightest, so it takes this length until it is full.
            fits = room // length
            whole, more = divmod(left, fits)
            if whole >= count:
                whole, more = count, 0
            used = 0
            for many, deep in ((whole, fits), (1, more)):
                if not many or not deep:
                    continue
                for k in range(deep):
                    out.append((length, dealt, many, first + used, capacity - room + k * length))
                    dealt += many
                rest = room - deep * length
                if rest:
                    rooms.setdefault(rest, []).append((first + used, many))
                    tree.put(rest, True)
                used += many
                left -= many * deep
            if first == bins:
                bins += used
            elif used < count:
                rooms[room].append((first + used, count - used))
            elif not rooms[room]:
                tree.put(room, False)
    return out


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset; the packing is that of best-fit decreasing."""
    ship_package(cut_pieces.sparkSession)
    # Written first: the range sort reads its input twice, once for the ranges.
    placed = with_index(cut(cut_pieces), F.desc("length"), F.col("doc_id"), F.col("ids_crc32"),
                        F.col("piece"), name="_idx")
    placed = cut(placed)
    histogram = {r[0]: r[1] for r in placed.groupBy("length").agg(
        F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    ahead, at = {}, 0
    for length in sorted(histogram, reverse=True):
        ahead[length], at = at, at + histogram[length]
    runs = best_fit_runs(histogram, capacity)
    first = np.array([ahead[r[0]] + r[1] for r in runs], np.int64)
    order = np.argsort(first)
    first = first[order]
    bins = np.array([r[3] for r in runs], np.int64)[order]
    offsets = np.array([r[4] for r in runs], np.int64)[order]
    shared = cut_pieces.sparkSession.sparkContext.broadcast((first, bins, offsets))
    index_at = placed.columns.index("_idx")
    names = [c for c in placed.columns if c != "_idx"]

    def kernel(batches):
        first, bins, offsets = shared.value
        for batch in batches:
            idx = batch.column(index_at).to_numpy()
            run = np.searchsorted(first, idx, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(names_at) for names_at in range(batch.num_columns)
                 if names_at != index_at]
                + [pa.array(bins[run] + idx - first[run]), pa.array(offsets[run])],
                [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields
                       if f.name != "_idx")
    return placed.mapInArrow(kernel, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY,
                   end: int = END) -> DataFrame:
    """All documents as pieces placed in sequences of at most ``capacity`` tokens."""
    return pack(pieces(docs, tokenizer_path, capacity, end), capacity)
