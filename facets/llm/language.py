"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read in windows of bytes that cover it whole. In each, one recurrent layer reads forward
and one backward; both states label every byte, and the mean of the byte probabilities is that of
the document. The network is trained in numpy by backpropagation through time on windows from a
bounded, hash-chosen number of documents per language.

Defined cases: a text that is null or has no letter is ``und`` with score 0; a null language is not
learned from; with no language to learn, every text is ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facets.session import ship_package

WINDOW = 96
HIDDEN = 8
PER_LANGUAGE = 300
WINDOWS_PER_DOCUMENT = 6
STEPS = 360
BATCH = 128
UNKNOWN = "und"
_LANES = 4096
_PAD = 0x20


@dataclass
class Network:
    """Parameters: per direction byte inputs (3H, 256), recurrence (3H, H), candidate bias (H, 1);
    output (C, 2H) and bias (C, 1). Gates in order: update, reset, candidate."""
    languages: list[str]
    p: dict[str, np.ndarray]

    def _run(self, way: str, windows: np.ndarray, keep: bool):
        """States for every place, in reading order; ``keep`` also holds what training needs."""
        e, u, bias = (self.p[f"{way}_{k}"] for k in ("in", "rec", "bias"))
        h_size = u.shape[1]
        h = np.zeros((h_size, len(windows)), np.float32)
        times = range(windows.shape[1])
        out, memo = [None] * windows.shape[1], {}
        for t in times if way == "f" else reversed(times):
            x = e[:, windows[:, t]]
            a = u @ h
            gates = np.tanh((x[:2 * h_size] + a[:2 * h_size]) * 0.5) * 0.5 + 0.5
            z, r = gates[:h_size], gates[h_size:]
            inner = a[2 * h_size:] + bias
            n = np.tanh(x[2 * h_size:] + r * inner)
            if keep:
                memo[t] = (h, z, r, inner, n)
            h = n + z * (h - n)
            out[t] = h
        return out, memo

    def _softmax(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        w, h = self.p["out"], forward.shape[0]
        score = w[:, :h] @ forward + w[:, h:] @ backward + self.p["out_bias"]
        score -= score.max(axis=0)
        np.exp(score, out=score)
        return score / score.sum(axis=0)

    def probabilities(self, windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sum over the bytes of each window of their language probabilities: (windows, C)."""
        forward, _ = self._run("f", windows, False)
        backward, _ = self._run("b", windows, False)
        total = np.zeros((len(self.languages), len(windows)), np.float32)
        for t in range(windows.shape[1]):
            total += self._softmax(forward[t], backward[t]) * (t < lengths)
        return total.T

    def gradients(self, windows: np.ndarray, lengths: np.ndarray, labels: np.ndarray):
        """Mean cross-entropy over all bytes and its gradients, through time."""
        n_bytes = max(1, int(lengths.sum()))
        ways = {w: self._run(w, windows, True) for w in "fb"}
        h = self.p["f_rec"].shape[1]
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        wanted = np.arange(len(self.languages))[:, None] == labels
        loss, into = 0.0, {"f": {}, "b": {}}
        for t in range(windows.shape[1]):
            f, b = ways["f"][0][t], ways["b"][0][t]
            live = t < lengths
            prob = self._softmax(f, b)
            loss -= float((np.log(prob[labels, np.arange(len(labels))] + 1e-9) * live).sum())
            d = ((prob - wanted) * live / n_bytes).astype(np.float32)
            grads["out"] += d @ np.concatenate((f, b)).T
            grads["out_bias"] += d.sum(axis=1, keepdims=True)
            into["f"][t], into["b"][t] = np.split(self.p["out"].T @ d, [h])
        for way in "fb":
            u, memo = self.p[f"{way}_rec"], ways[way][1]
            carry = np.zeros((h, len(windows)), np.float32)
            times = range(windows.shape[1])
            for t in reversed(times) if way == "f" else times:
                before, z, r, inner, n = memo[t]
                dh = carry + into[way][t]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (before - n) * z * (1 - z)
                dr = dn * inner * r * (1 - r)
                d_inner = dn * r
                rec = np.concatenate((dz, dr, d_inner))
                grads[f"{way}_rec"] += rec @ before.T
                grads[f"{way}_bias"] += d_inner.sum(axis=1, keepdims=True)
                np.add.at(grads[f"{way}_in"].T, windows[:, t], np.concatenate((dz, dr, dn)).T)
                carry = dh * z + u.T @ rec
        return loss / n_bytes, grads


def new_network(languages: list[str], hidden: int = HIDDEN, seed: int = 11) -> Network:
    rng = np.random.default_rng(seed)

    def random(*shape, scale):
        return (rng.normal(size=shape) * scale).astype(np.float32)

    p = {}
    for way in "fb":
        p[f"{way}_in"] = random(3 * hidden, 256, scale=0.5)
        p[f"{way}_rec"] = random(3 * hidden, hidden, scale=1 / np.sqrt(hidden))
        p[f"{way}_bias"] = np.zeros((hidden, 1), np.float32)
    p["out"] = random(len(languages), 2 * hidden, scale=1 / np.sqrt(2 * hidden))
    p["out_bias"] = np.zeros((len(languages), 1), np.float32)
    return Network(languages, p)


def train(windows: np.ndarray, lengths: np.ndarray, labels: np.ndarray, languages: list[str],
          steps: int = STEPS, rate: float = 0.02, seed: int = 11) -> Network:
    """Adam on seeded mini-batches, as many for a small sample as for a large one."""
    net = new_network(languages, seed=seed)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    rng, order = np.random.default_rng(seed), np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        if not len(order):
            order = rng.permutation(len(windows))
        pick, order = order[:BATCH], order[BATCH:]
        _, grads = net.gradients(windows[pick], lengths[pick], labels[pick])
        now = rate * (1 - (step - 1) / steps)
        for k, g in grads.items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.001 * (g * g - second[k])
            net.p[k] -= now * (first[k] / (1 - 0.9 ** step)) / (
                np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return net


def cut_windows(text: bytes, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text, the last one padded, and their lengths."""
    n = -(-len(text) // size)
    flat = np.full(n * size, _PAD, np.uint8)
    flat[:len(text)] = np.frombuffer(text, np.uint8)
    lengths = np.full(n, size)
    if n:
        lengths[-1] = len(text) - (n - 1) * size
    return flat.reshape(n, size), lengths


def fit(docs: DataFrame, learn_from: Column | None = None, per_language: int = PER_LANGUAGE,
        windows_per_document: int = WINDOWS_PER_DOCUMENT) -> Network | None:
    """Train on windows of about ``per_language`` documents of each language (never above twice).

    The bound keeps the training set, and what the driver holds, independent of the table.
    Documents are chosen by a hash of their id and text.
    """
    ship_package(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0))
    if learn_from is not None:
        known = known.where(learn_from)
    counts = {r[0]: r[1] for r in known.groupBy("lang").agg(F.count("*")).collect()}
    if not counts:
        return None
    share = F.element_at(F.create_map(*[x for lang, n in sorted(counts.items()) for x in (
        F.lit(lang), F.lit(int(min(1.0, per_language / n) * (1 << 32))))]), F.col("lang"))
    drawn = F.xxhash64("doc_id", F.xxhash64("text"))
    chosen = known.where(drawn.bitwiseAND(F.lit((1 << 32) - 1)) < share).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"),
        drawn.alias("drawn"))

    def kernel(batches):
        for batch in batches:
            lang, drawn, rows, size = [], [], [], []
            for k, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                all_, lengths = cut_windows(text)
                seed = batch.column(2)[k].as_py()
                rng = np.random.default_rng(seed % (1 << 63))
                for w in rng.permutation(len(all_))[:windows_per_document].tolist():
                    lang.append(k)
                    drawn.append(seed)
                    rows.append(all_[w].tobytes())
                    size.append(int(lengths[w]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(lang, pa.int64())),
                 pa.array(drawn, pa.int64()), pa.array(rows, pa.binary()),
                 pa.array(size, pa.int64())], ["lang", "drawn", "bytes", "n"])

    bound = 2 * per_language * len(counts) * windows_per_document
    made = chosen.mapInArrow(kernel, "lang string, drawn long, bytes binary, n long").limit(bound)
    got = sorted((r[0], r[1], bytes(r[2]), r[3]) for r in made.toLocalIterator())
    languages = sorted({r[0] for r in got})
    if not languages:
        return None
    return train(np.stack([np.frombuffer(r[2], np.uint8) for r in got]),
                 np.array([r[3] for r in got]),
                 np.array([languages.index(r[0]) for r in got]), languages)


def predict(net: Network | None, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
    """Language and probability of each text; windows of many texts advance in step."""
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if net is None:
        return names, scores
    held, owner, size, lanes = [], [], [], 0
    sums: dict[int, np.ndarray] = {}

    def flush():
        windows, lengths = np.concatenate(held), np.concatenate(size)
        of = np.concatenate(owner)
        for at in range(0, len(windows), _LANES):
            part = slice(at, at + _LANES)
            got = net.probabilities(windows[part], lengths[part])
            first = np.flatnonzero(np.concatenate(([True], np.diff(of[part]) != 0)))
            for k, s in zip(of[part][first].tolist(), np.add.reduceat(
                    got.astype(np.float64), first, axis=0)):
                sums[k] = sums.get(k, 0) + s

    for k, text in enumerate(texts):
        if text is None or not any(map(str.isalpha, text.decode())):
            continue
        windows, lengths = cut_windows(text)
        held.append(windows)
        size.append(lengths)
        owner.append(np.full(len(windows), k))
        lanes += len(windows)
        if lanes >= 4 * _LANES:
            flush()
            held, owner, size, lanes = [], [], [], 0
    if held:
        flush()
    for k, s in sums.items():
        best = int(np.argmax(s))
        names[k] = net.languages[best]
        scores[k] = float(min(1.0, s[best] / s.sum()))
    return names, scores


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row's whole text."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand numbers

    def kernel(batches):
        for batch in batches:
            names, scores = predict(shared.value, batch.column(1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "lang_pred", "score"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(kernel, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, "
                                   "lang_pred string, score double")
