"""Byte-level BPE: texts to token ids and back.

A rank file names tokens as bytes, each with its rank; merging always takes the lowest-ranked
neighbouring pair, leftmost first. The tokenizers library wants vocabulary entries as characters and
the pair each token is merged from, so bytes are mapped to 256 printable characters and the last
merge of every token is found by merging its own bytes: whatever surrounds a token, the merges inside
it run in that order, so there is one such pair. The compiled tokenizer goes to the workers as text.

Texts are split by the pattern inside each Arrow batch; the distinct pieces a worker has not met
lately go through the library together, and a text's ids are those of its pieces in order. Offsets
come from the byte lengths of the tokens: a byte belongs to the character that holds it, so a token
that starts inside a character starts at that character. Decoding turns each entry's characters back
into bytes and joins those of a row before any of them is read as UTF-8, so characters split between
tokens come out whole.

Defined cases: a null or empty text has no tokens; rows are encoded one by one, so repeated ids and
rows stay as they are; ids that are null, hold a null or are not in the vocabulary decode to null;
bytes that are no UTF-8 (a row cut inside a character) become U+FFFD in the text column and stay as
they are in the byte column; columns beside those named are left out.
"""

from __future__ import annotations

import base64
import os
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facets.llm.batches import texts, tidy
from facets.session import ship_package

# Pieces a worker remembers (two generations of this many), the longest piece worth remembering, and
# the bytes of ids after which a result batch is handed on.
_GENERATION = 150_000
_LONG_PIECE = 64
_OUT_BYTES = 8_000_000
_ROWS = 64


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable in Latin-1, else from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(0x100 + hidden.index(b)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: a base64 token and a number per line."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines)
        return {base64.b64decode(p[0]): int(p[1]) for p in pairs if p}


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts whose merge gives the token, or None if merging never arrives at it."""
    parts = [token[i:i + 1] for i in range(len(token))]
    while len(parts) > 2:
        pairs = [(ranks.get(a + b), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        known = [p for p in pairs if p[0] is not None]
        if not known:
            return None
        at = min(known)[1]
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


@cache
def compile_ranks(path: str) -> str:
    """A rank file as the text of a tokenizers model; its size is that of the vocabulary."""
    from tokenizers import Tokenizer, models, pre_tokenizers
    ranks, shown = read_ranks(path), byte_characters()

    def spelled(token: bytes) -> str:
        return "".join(shown[b] for b in token)

    found = (last_merge(t, ranks) for t in sorted(ranks, key=ranks.get) if len(t) > 1)
    merges = [(spelled(a), spelled(b)) for a, b in filter(None, found)]
    # A piece that is an entry itself is that token, also where merging would not lead to it.
    model = models.BPE(vocab={spelled(t): r for t, r in ranks.items()}, merges=merges,
                       ignore_merges=True)
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return tokenizer.to_str()


def _load(compiled: str):
    # Spark runs a worker per core already.
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer
    return Tokenizer.from_str(compiled)


def token_bytes(tokenizer) -> dict[int, bytes]:
    """The bytes of every id: the byte table turned round."""
    back = {c: b for b, c in enumerate(byte_characters())}
    return {i: bytes(back[c] for c in t) for t, i in tokenizer.get_vocab().items()}


class Encoder:
    """Ids of texts, as bytes of little-endian unsigned 32-bit numbers."""

    def __init__(self, compiled: str, pattern: str):
        self.tokenizer = _load(compiled)
        self.pieces = regex.compile(pattern).findall
        sizes = token_bytes(self.tokenizer)
        self.sizes = np.zeros(max(sizes, default=0) + 1, np.int64)
        for i, spelled in sizes.items():
            self.sizes[i] = len(spelled)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        coded = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return {p: np.array(e.ids, "<u4").tobytes() for p, e in zip(pieces, coded)}

    def ids(self, text: str) -> bytes:
        pieces = self.pieces(text)
        if len(self.young) > _GENERATION:
            self.young, self.old = {}, self.young
        fresh = {*pieces}.difference(self.young)
        if not fresh:
            return b"".join(map(self.young.__getitem__, pieces))
        known = {p: self.old[p] for p in fresh if p in self.old}
        learned = self._learn([p for p in fresh if p not in known])
        self.young.update(known)
        self.young.update((p, i) for p, i in learned.items() if len(p) <= _LONG_PIECE)
        if any(len(p) > _LONG_PIECE for p in learned):
            return b"".join(learned[p] if p in learned else self.young[p] for p in pieces)
        return b"".join(map(self.young.__getitem__, pieces))

    def offsets(self, raw: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First code point of every token, and the one behind its last."""
        leads = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
        character = np.cumsum(leads) - 1
        ends = np.cumsum(self.sizes[ids])
        return character[ends - self.sizes[ids]], character[ends - 1] + 1


_encoders: dict[tuple[str, str], Encoder] = {}
_decoders: dict[str, dict[int, bytes]] = {}


def encode(docs: DataFrame, ranks_path: str, pattern: str, offsets: bool = False,
           packed: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids) of every text, with ``offsets`` also (starts, ends) in code points.

    ``ids`` is an array, or with ``packed`` the bytes of little-endian unsigned 32-bit numbers.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(compile_ranks(ranks_path))
    id_kind = pa.binary() if packed else pa.list_(pa.int32())

    def column(raw: list[bytes]):
        if packed:
            return pa.array(raw, pa.binary())
        ends = np.cumsum([0, *map(len, raw)]) // 4
        flat = np.frombuffer(b"".join(raw), "<i4")
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))

    def kernel(batches):
        key = ranks_path, pattern
        coder = _encoders.get(key)
        if coder is None:
            coder = _encoders[key] = Encoder(shared.value, pattern)
        for batch in batches:
            start, size, raw, starts, ends = 0, 0, [], [], []

            def result():
                arrays = [batch.column(0).slice(start, len(raw)),
                          pa.array([len(r) // 4 for r in raw], pa.int64()), column(raw)]
                names = ["doc_id", "n_tokens", "ids"]
                if offsets:
                    arrays += [pa.array(x, pa.list_(pa.int32())) for x in (starts, ends)]
                    names += ["starts", "ends"]
                return pa.RecordBatch.from_arrays(arrays, names)

            for text in texts(batch.column(1)):
                found = coder.ids(text.decode()) if text else b""
                raw.append(found)
                size += len(found) * (5 if offsets else 1)
                if offsets:
                    first, last = coder.offsets(text or b"", np.frombuffer(found, "<u4"))
                    starts.append(first)
                    ends.append(last)
                if size > _OUT_BYTES:
                    yield result()
                    start, size, raw, starts, ends = start + len(raw), 0, [], [], []
            if raw:
                yield result()
        tidy()

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = (f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, "
              f"ids {'binary' if id_kind == pa.binary() else 'array<int>'}")
    return rows.mapInArrow(kernel, schema + (", starts array<int>, ends array<int>"
                                             if offsets else ""))


def decode(rows: DataFrame, ranks_path: str, text: bool = True, keep=()) -> DataFrame:
    """(doc_id, bytes[, text]) and kept columns of (doc_id, ids); ids may be packed or an array."""
    spark = rows.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(compile_ranks(ranks_path))
    rows = rows.select("doc_id", *keep, F.col("ids").alias("_ids"))
    packed = rows.schema["_ids"].dataType.simpleString() == "binary"
    kept = rows.columns[:-1]

    def kernel(batches):
        table = _decoders.get(ranks_path)
        if table is None:
            table = _decoders[ranks_path] = token_bytes(_load(shared.value))
        for batch in batches:
            for at in range(0, len(batch), _ROWS):
                part = batch.slice(at, _ROWS)
                ids = part.column(len(kept)).to_pylist()
                raw = []
                for row in ids:
                    if packed and row is not None:
                        row = np.frombuffer(row, "<u4").tolist()
                    try:
                        raw.append(None if row is None else b"".join([table[i] for i in row]))
                    except KeyError:
                        raw.append(None)
                arrays = [*part.columns[:-1], pa.array(raw, pa.binary())]
                names = [*kept, "bytes"]
                if text:
                    arrays.append(pa.array([None if r is None else r.decode("utf-8", "replace")
                                            for r in raw], pa.string()))
                    names.append("text")
                yield pa.RecordBatch.from_arrays(arrays, names)
        tidy()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(kernel, schema + ", bytes binary" + (", text string" if text else ""))
