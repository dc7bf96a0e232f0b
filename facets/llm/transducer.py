"""Token counts by a compiled finite-state tokenizer.

Two machines read a text. The splitter is a small automaton over character classes that marks where
words of a byte-level tokenizer begin. It is run on all chunks of a batch at once: each chunk first
yields a map from every possible entry state to its exit state, a parallel prefix scan composes
these maps, and then each chunk knows the state in which it begins. The coder is a deterministic
transducer over bytes whose transitions carry the change in the number of tokens. Its states are
compiled when first met: a state holds the longest suffix of the word that could still grow into
a token, and the last token of every prefix that reaches into that suffix. That is all that decides
how byte-pair merging ends a longer word, because a sequence of tokens is what merging yields
exactly if each neighbouring pair is.

Defined cases: a null text is an empty one, with no tokens; the text of a special token counts as
that one token; every row is counted by itself.
"""

from __future__ import annotations

import json
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facets.session import ship_package

CHUNK = 256
# Compiled states that a worker keeps; beyond that it starts anew.
_MOST_STATES = 400_000
_LANES = 1 << 16

# Character classes of the word pattern.
_SPACE, _BLANK, _LETTER, _NUMBER, _OTHER, _QUOTE = range(6)
_LETTERS_AFTER_QUOTE = "stmdrevl"
_S, _T, _M, _D, _R, _E, _V, _L = range(6, 14)
N_CLASSES = 14


def _byte_characters() -> dict[str, int]:
    """The printable stand-ins that vocabulary files use for bytes."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    table = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        table[chr(256 + n)] = b
    return table


def _class_of(ch: str) -> int:
    if ch == " ":
        return _SPACE
    if ch == "'":
        return _QUOTE
    if ch in _LETTERS_AFTER_QUOTE:
        return 6 + _LETTERS_AFTER_QUOTE.index(ch)
    kind = unicodedata.category(ch)
    if kind[0] == "L":
        return _LETTER
    if kind[0] == "N":
        return _NUMBER
    if ch in "\t\n\r\x0b\x0c\x85  " or kind == "Zs":
        return _BLANK
    return _OTHER


def character_classes() -> np.ndarray:
    return np.fromiter((_class_of(chr(c)) if not 0xD800 <= c < 0xE000 else _OTHER
                        for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)


class Splitter:
    """Where words begin: contractions, or runs of letters, numbers or others with one space ahead,
    or blanks, of which a run before a word leaves the last one out.

    A state is what was read of the open word. A step says whether a word begins at the character
    just read (1), or also at the one before it (2), as when a run of blanks lends its last space,
    or gives up a last blank that is no space.
    """

    def __init__(self):
        self.states: dict[str, int] = {}
        names = ["begin", "space", "blank", "spaces", "blanks", "letters", "numbers", "others",
                 "quote", "quote_r", "quote_v", "quote_l", "whole"]
        for name in names:
            self.states[name] = len(self.states)
        n = len(names)
        self.next = np.zeros((n, N_CLASSES), np.int64)
        self.mark = np.zeros((n, N_CLASSES), np.int64)
        for name in names:
            for c in range(N_CLASSES):
                to, mark = self._step(name, c)
                self.next[self.states[name], c] = self.states[to]
                self.mark[self.states[name], c] = mark

    @staticmethod
    def _fresh(c: int) -> str:
        return {_SPACE: "space", _BLANK: "blank", _NUMBER: "numbers", _OTHER: "others",
                _QUOTE: "quote"}.get(c, "letters")

    def _step(self, name: str, c: int) -> tuple[str, int]:
        fresh = self._fresh(c)
        blank = c in (_SPACE, _BLANK)
        letter = c == _LETTER or c >= 6
        if name == "begin":
            return fresh, 1
        if name in ("space", "blank", "spaces", "blanks"):
            last_space = name in ("space", "spaces")
            if blank:
                return "spaces" if c == _SPACE else "blanks", 0
            if last_space:
                # The last space opens the word that follows; a quote behind it is an other.
                to = "others" if c in (_QUOTE, _OTHER) else fresh
                return to, 2 if name == "spaces" else 0
            return fresh, 3 if name == "blanks" else 1
        if blank:
            return fresh, 1
        if name == "letters":
            return ("letters", 0) if letter else (fresh, 1)
        if name == "numbers":
            return ("numbers", 0) if c == _NUMBER else (fresh, 1)
        if name == "others":
            return ("others", 0) if c in (_OTHER, _QUOTE) else (fresh, 1)
        if name == "quote":
            if c in (_S, _T, _M, _D):
                return "whole", 0
            if c in (_R, _V, _L):
                return {_R: "quote_r", _V: "quote_v", _L: "quote_l"}[c], 0
            return ("others", 0) if c in (_OTHER, _QUOTE) else (fresh, 1)
        if name in ("quote_r", "quote_v", "quote_l"):
            if c == (_L if name == "quote_l" else _E):
                return "whole", 0
            # No contraction after all: the quote was a word, and a letter began behind it.
            return ("letters", 2) if letter else (fresh, 3)
        return fresh, 1  # behind a whole contraction

    def closing(self) -> np.ndarray:
        """At the end of a text: an unfinished contraction still splits behind its quote."""
        return np.isin(np.arange(len(self.states)),
                       [self.states[s] for s in ("quote_r", "quote_v", "quote_l")])

    def starts(self, classes: np.ndarray, first: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
        """Marks of word starts in texts laid end to end; ``first`` holds the text starts."""
        n, n_states = len(classes), len(self.states)
        out = np.zeros(n + 1, bool)
        if not n:
            return out
        lengths = np.diff(np.append(first, n))
        per_text = -(-lengths // chunk)
        chunk_at = np.repeat(first - np.concatenate(([0], np.cumsum(per_text)[:-1])) * chunk,
                             per_text) + np.arange(per_text.sum()) * chunk
        ends = np.minimum(chunk_at + chunk, np.repeat(first + lengths, per_text))
        opens = np.zeros(len(chunk_at), bool)
        opens[(np.cumsum(per_text) - per_text)[per_text > 0]] = True
        # The map of each chunk, from every entry state at once.
        maps = np.tile(np.arange(n_states), (len(chunk_at), 1))
        for k in range(chunk):
            live = np.flatnonzero(chunk_at + k < ends)
            if not len(live):
                break
            maps[live] = self.next[maps[live], classes[chunk_at[live] + k][:, None]]
        # The first chunk of a text does not depend on what came before.
        maps[opens] = maps[opens, self.states["begin"]][:, None]
        entry = self._scan(maps)
        state = np.full(len(chunk_at), self.states["begin"])
        state[1:] = entry[:-1]
        state[opens] = self.states["begin"]
        for k in range(chunk):
            live = np.flatnonzero(chunk_at + k < ends)
            if not len(live):
                break
            at = chunk_at[live] + k
            c = classes[at]
            mark = self.mark[state[live], c]
            state[live] = self.next[state[live], c]
            out[at[(mark == 1) | (mark == 3)]] = True
            out[at[mark >= 2] - 1] = True
        closing = np.append(opens[1:], True) & self.closing()[state]
        out[ends[closing] - 1] = True
        return out

    @staticmethod
    def _scan(maps: np.ndarray) -> np.ndarray:
        """Exit state of every chunk: maps composed with all before them, by doubling."""
        maps, step = maps.copy(), 1
        while step < len(maps):
            maps[step:] = np.take_along_axis(maps[step:], maps[:-step], axis=1)
            step *= 2
        return maps[:, 0]


class Coder:
    """The transducer over the bytes of a word, compiled while it reads."""

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.rank = {pair: k for k, pair in enumerate(merges)}
        # A token that merging never leaves standing is none.
        self.tokens = {t for t in vocabulary if self.merge(t) == [t]}
        # What can still grow into a token.
        self.prefixes = {t[:k] for t in self.tokens for k in range(len(t))}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.known: list[tuple] = []
        self.next = np.full((1024, 256), -1, np.int32)
        self.gain = np.zeros((1024, 256), np.int16)
        self._state(b"", (None,), (0,))

    def merge(self, word: bytes) -> list[bytes]:
        """Byte-pair merging of a short string."""
        part = [word[i:i + 1] for i in range(len(word))]
        while len(part) > 1:
            best = min((self.rank.get((a, b), 1 << 60), i)
                       for i, (a, b) in enumerate(zip(part, part[1:])))
            if best[0] == 1 << 60:
                break
            pair = (part[best[1]], part[best[1] + 1])
            merged, i = [], 0
            while i < len(part):
                if i + 1 < len(part) and (part[i], part[i + 1]) == pair:
                    merged.append(part[i] + part[i + 1])
                    i += 2
                else:
                    merged.append(part[i])
                    i += 1
            part = merged
        return part

    def follows(self, left: bytes | None, right: bytes) -> bool:
        """Whether merging leaves these two tokens side by side."""
        if left is None:
            return True
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merge(left + right) == [left, right]
        return known

    def _state(self, suffix: bytes, last: tuple, counts: tuple) -> int:
        """Number of a state: ``last[k]`` ends the prefix that stops before ``suffix[k:]``.

        Counts are kept relative to that of the whole word read so far. A place from which no token
        can grow any more is forgotten, so that states which go on alike are one.
        """
        grows = [suffix[k:] in self.prefixes for k in range(len(suffix) + 1)]
        key = (suffix, tuple(t if g else None for t, g in zip(last, grows)),
               tuple(c - counts[-1] if g else 0 for c, g in zip(counts, grows)))
        found = self.ids.get(key)
        if found is None:
            found = self.ids[key] = len(self.known)
            self.known.append(key)
            if found >= len(self.next):
                self.next = np.concatenate((self.next, np.full_like(self.next, -1)))
                self.gain = np.concatenate((self.gain, np.zeros_like(self.gain)))
        return found

    def compile(self, state: int, byte: int) -> None:
        suffix, last, counts = self.known[state]
        grown = suffix + bytes([byte])
        # The one token that can end here, whose predecessor merging leaves beside it.
        for k in range(len(grown)):
            token = grown[k:]
            if grown[k:-1] in self.prefixes and token in self.tokens and self.follows(
                    last[k], token):
                count = counts[k] + 1
                break
        else:
            raise ValueError("the vocabulary does not hold every single byte")
        last, counts = (*last, token), (*counts, count)
        keep = 0
        while grown[keep:] not in self.prefixes:
            keep += 1
        self.next[state, byte] = self._state(grown[keep:], last[keep:], counts[keep:])
        self.gain[state, byte] = count

    def count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each word [start, end); words advance in step, the longest last."""
        if len(self.known) > _MOST_STATES:
            self.reset()
        total = np.zeros(len(starts), np.int64)
        for at in range(0, len(starts), _LANES):
            part = slice(at, at + _LANES)
            total[part] = self._lanes(data, starts[part], ends[part] - starts[part])
        return total

    def _lanes(self, data, starts, lengths) -> np.ndarray:
        order = np.argsort(-lengths, kind="stable")
        at, left = starts[order].copy(), lengths[order]
        state = np.zeros(len(at), np.int32)
        total = np.zeros(len(at), np.int64)
        shrink = np.searchsorted(-left, -np.arange(1, (left[0] if len(left) else 0) + 1),
                                 side="right")
        for live in shrink.tolist():
            byte = data[at[:live]]
            now = state[:live]
            to = self.next[now, byte]
            missing = to < 0
            if missing.any():
                for s, b in {*zip(now[missing].tolist(), byte[missing].tolist())}:
                    self.compile(s, b)
                to = self.next[now, byte]
            total[:live] += self.gain[now, byte]
            state[:live] = to
            at[:live] += 1
        out = np.empty(len(at), np.int64)
        out[order] = total
        return out


class TokenCounter:
    """Counts tokens of whole texts as the tokenizer file has them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if (pre["type"], model["type"], spec["normalizer"]) != ("ByteLevel", "BPE", None) \
                or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("a byte-level tokenizer with the usual word pattern is needed")
        byte = _byte_characters()

        def raw(text: str) -> bytes:
            return bytes(byte[c] for c in text)

        self.special = [a["content"] for a in spec["added_tokens"]]
        vocabulary = {raw(t): i for t, i in model["vocab"].items() if t not in self.special}
        merges = [tuple(map(raw, m.split(" ") if isinstance(m, str) else m))
                  for m in model["merges"]]
        self.coder, self.splitter = Coder(vocabulary, merges), Splitter()
        self.classes = character_classes()

    def _pieces(self, text: str) -> tuple[list[str], int]:
        """The text between special tokens, and how many of those there are."""
        if not any(s in text for s in self.special):
            return [text], 0
        parts, found, rest = [], 0, text
        while True:
            hits = [(rest.find(s), -len(s), s) for s in self.special if s in rest]
            if not hits:
                return [*parts, rest], found
            at, _, s = min(hits)
            parts.append(rest[:at])
            rest, found = rest[at + len(s):], found + 1

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; a batch is laid end to end and read in step."""
        out = np.zeros(len(texts), np.int64)
        parts, owner = [], []
        for k, text in enumerate(texts):
            if text:
                pieces, found = self._pieces(text)
                out[k] = found
                for piece in pieces:
                    if piece:
                        parts.append(piece)
                        owner.append(k)
        if not parts:
            return out.tolist()
        whole = "".join(parts)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        marks = self.splitter.starts(self.classes[points], first)
        marks[first] = True
        words = np.flatnonzero(marks[:len(points)])
        data = np.frombuffer(whole.encode(), np.uint8)
        wide = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        byte_at = np.concatenate(([0], np.cumsum(wide)))
        begin = byte_at[words]
        got = self.coder.count(data, begin, np.append(begin[1:], byte_at[-1]))
        text_of = np.searchsorted(first, words, side="right") - 1
        per_part = np.bincount(text_of, weights=got, minlength=len(parts)).astype(np.int64)
        np.add.at(out, np.array(owner), per_part)
        return out.tolist()


_counters: dict[str, TokenCounter] = {}
_BATCH_CHARS = 2_000_000


def token_counts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row's whole text."""
    ship_package(docs.sparkSession)

    def kernel(batches):
        counter = _counters.get(tokenizer_path)
        if counter is None:
            counter = _counters[tokenizer_path] = TokenCounter(tokenizer_path)
        for batch in batches:
            texts, tokens, held, size = batch.column(1).to_pylist(), [], [], 0
            for text in texts:
                held.append(text)
                size += len(text or "")
                if size >= _BATCH_CHARS:
                    tokens += counter.counts(held)
                    held, size = [], 0
            tokens += counter.counts(held)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(tokens, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"])

    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text.alias("text"),
                       F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(kernel, f"doc_id {id_type}, n_bytes long, n_tokens long")
