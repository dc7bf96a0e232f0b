"""Whitening, spelling variants, and byte-level BPE against plain versions."""

import base64
import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from facets.llm import bytebpe, spelling, whitening
from facets.llm.queries import QUERIES, tokenizer_path

RANKS = tokenizer_path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


# Whitening

def operator(x):
    def step(c):
        u = x @ c
        return x.T @ u, float(u @ u)
    return step


@pytest.mark.parametrize("case", ["spread", "equal", "flat", "rank two", "one wide"])
def test_bidiagonalisation_finds_the_singular_vectors(case):
    rng = np.random.default_rng(3)
    x = {"spread": rng.normal(size=(300, 40)) * np.linspace(1, 5, 40),
         "equal": np.vstack([np.eye(12), -np.eye(12)]),
         "flat": rng.normal(size=(4000, 30)),
         "rank two": rng.normal(size=(60, 2)) @ rng.normal(size=(2, 9)),
         "one wide": rng.normal(size=(6, 1))}[case]
    x = x - x.mean(axis=0)
    k = min(4, x.shape[1])
    values, vectors = whitening.bidiagonalise(operator(x), x.shape[1], k)
    want = np.linalg.svd(x, compute_uv=False)[:k]
    np.testing.assert_allclose(values, want, atol=1e-12 * want[0])
    np.testing.assert_allclose(vectors @ vectors.T, np.eye(k), atol=1e-12)
    np.testing.assert_allclose(x.T @ (x @ vectors.T), vectors.T * values ** 2,
                               atol=1e-12 * want[0] ** 2)


def plain_whitening(vectors, k=4):
    x = np.floor(256 * np.asarray(vectors, "f8")).astype(np.int64)
    fitted = np.unique(x, axis=0)
    n, sums = len(fitted), fitted.sum(axis=0)
    centred = fitted - sums / n
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
    return (n, ((n * x - sums) ** 2).sum(axis=1), (x - sums / n) @ turn / np.sqrt(values),
            values / np.trace(centred.T @ centred / n))


def check_whitening(rows, ids, vectors):
    n, deviation, whitened, explained = plain_whitening(vectors)
    order = np.argsort(ids, kind="stable")
    by_component = [sorted((r for r in rows if r["component"] == c), key=lambda r: r["vec_id"])
                    for c in range(1, 5)]
    assert len(rows) == 4 * len(ids)
    for c, got in enumerate(by_component):
        assert [r["vec_id"] for r in got] == np.asarray(ids)[order].tolist()
        assert [int(r["deviation"]) for r in got] == deviation[order].tolist()
        mine, want = np.array([r["whitened"] for r in got]), whitened[order, c]
        np.testing.assert_allclose(mine * np.sign(mine @ want), want, atol=1e-9)
        np.testing.assert_allclose([r["explained"] for r in got], explained[c], rtol=1e-9)
    assert {r["n"] for r in rows} == {n}
    assert len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-9


def test_whitening_of_the_table(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    rows = QUERIES["op11_embedding_whitening"](spark, folder).collect()
    assert isinstance(rows[0]["deviation"], int)
    check_whitening(rows, table["vec_id"].to_numpy(), np.stack(table["embedding"]))


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(80, 6)).astype(np.float32)
    vectors[40:70] = vectors[0]
    vectors[70] = -0.0
    rows = [(i, v.tolist(), 1.0, 2) for i, v in enumerate(vectors)]
    rows.append((3, vectors[3].tolist(), 1.0, 2))  # a repeated row
    bad = [(90, None), (91, []), (92, [None] + [1.0] * 5), (93, [float("nan")] * 6),
           (94, [float("inf")] + [0.0] * 5), (95, [1.0, 2.0])]
    schema = "vec_id long, embedding array<float>, whitened double, n int"
    table = spark.createDataFrame(rows + [(*b, 0.0, 0) for b in bad], schema)
    for parts in (1, 7):
        found = whitening.whiten_table(table.repartition(parts)).collect()
        check_whitening(found, np.array([r[0] for r in rows]), np.array([r[1] for r in rows]))
    assert whitening.whiten_table(table.limit(0)).count() == 0
    same = spark.createDataFrame([(1, [1.0, 2.0], 0.0, 0)] * 3, schema)
    assert whitening.whiten_table(same).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i], 0.0, 0) for i in range(5)], schema)
    assert [r["component"] for r in whitening.whiten_table(line).collect()] == [1] * 5


def test_whitening_of_entries_beyond_long_products(spark):
    rows = [(i, [float(i * 10 ** 14), float(-i * i)]) for i in range(1, 9)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = [[int(np.floor(256 * c)) for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    got = {r["vec_id"]: int(r["deviation"]) for r in whitening.whiten_table(table).collect()}
    assert got == {i + 1: sum((8 * c - s) ** 2 for c, s in zip(v, sums)) for i, v in enumerate(x)}


# Spelling variants

def plain_counts(docs, every=31):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            crc = zlib.crc32(f"{doc_id}:{run}".encode())
            if crc % every == 0:
                run = run[:crc % len(run)] + run[crc % len(run) + 1:]
            counts[run] += len(run) >= 7
    return {w: n for w, n in counts.items() if n >= 2}


def plain_variants(counts, ratio=10):
    """Near words by deleting each code point of each word."""
    without, near = defaultdict(set), {w: set() for w in counts}
    for w in counts:
        for i in range(len(w)):
            without[i, w[:i] + w[i + 1:]].add(w)
            if w[:i] + w[i + 1:] in counts:
                near[w].add(w[:i] + w[i + 1:])
                near[w[:i] + w[i + 1:]].add(w)
    for group in without.values():
        for w in group:
            near[w] |= group - {w}
    form = {w: min(near[w], key=lambda v: (-counts[v], v), default=None) for w in counts}
    form = {w: f if f is not None and counts[f] >= ratio * counts[w] else None
            for w, f in form.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), counts[w], len(near[w]), counts.get(form[w])) for w in counts}


def found_variants(df):
    rows = df.collect()
    found = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(found) == len(rows)
    return found


def test_spelling_of_the_table(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet")
            .select("doc_id", "text").collect()]
    got = found_variants(QUERIES["op12_spelling_variants"](spark, folder))
    want = plain_variants(plain_counts(docs))
    assert got == want and sum(w[0] is not None for w in want.values()) > 5


@pytest.mark.parametrize("parts,rows", [(3, 1024), (2, 8), (4, 3), (1, 40)])
def test_tiles_of_any_size_lose_no_link(spark, parts, rows):
    rng = np.random.default_rng(parts)
    words = {"".join(rng.choice(list("abé"), rng.integers(1, 7))) for _ in range(400)}
    words |= {"abcdefgh" * 20, "abcdefgh" * 20 + "x", "x" + "abcdefgh" * 20, "😀b", "😀", "a😀b"}
    counts = {w: int(10 ** rng.integers(0, 5)) for w in words}
    table = spark.createDataFrame([(w, n, "") for w, n in counts.items()],
                                  "word string, n long, form string")
    got = found_variants(spelling.variants(table, parts=parts, tile_rows=rows))
    assert got == plain_variants(counts)


def test_spelling_odd_rows(spark):
    long = "lengthyword" * 3000
    texts = [None, "", "short", "Straßenzüge straßenzüge STRAßENZüGE", "ÀÉÎÕÜØÞ ÀÉÎÕÜØÞ àéîõüøþ",
             f"{long} {long} {long}x {long}x", "twelve12twelve", "someword someword",
             "someword someword", "somewird somewird"] + ["somewordy " * 30] * 3
    rows = [(i // 2 if i < 8 else i, t, 1, "z") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, word string")
    got = found_variants(spelling.variants(spelling.word_counts(docs, drop_every=31)))
    assert got == plain_variants(plain_counts([r[:2] for r in rows]))
    assert got[long][3] == 1
    plain = found_variants(spelling.variants(spelling.word_counts(docs)))
    assert plain["somewird"][:2] == (None, "somewird")
    assert plain["someword"][:2] == ("somewordy", "somewordy")
    unnamed = spark.createDataFrame([(None, "nameless nameless")], "doc_id long, text string")
    assert spelling.word_counts(unnamed, drop_every=1).count() == 1
    assert spelling.variants(spelling.word_counts(docs.limit(0))).count() == 0


def test_roots_of_long_chains(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [("a", "w3"), ("b", "c")]
    got = dict(spelling.follow(spark.createDataFrame(forms, "word string, form string")).collect())
    assert got == {**{f"w{i}": "w37" for i in range(37)}, "a": "w37", "b": "c"}


# Byte-level BPE

@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bytebpe.Encoder(bytebpe.compile_ranks(RANKS), PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]),
                                  st.sampled_from("aabber 's\n\t12é中😀ͅ")), max_size=80))
def test_ids_of_any_text(library, coder, text):
    assert np.frombuffer(coder.ids(text), "<u4").tolist() == library.encode_ordinary(text)


def test_bpe_of_the_table(spark, folder, library):
    docs = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    rows = QUERIES["op13_byte_bpe"](spark, folder).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r["doc_id"]] or ""
        ids = library.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_odd_rows(spark, library):
    texts = [None, "", "héllo wörld", "日本語 😀👩‍👩‍👧 <|endoftext|>", "x" * 300_000, "\u0000 \u0085",
             "héllo wörld", " \n" * 5000]
    rows = [(i // 2, t, 7, [1]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids array<int>")
    coded = bytebpe.encode(docs, RANKS, PATTERN, offsets=True)
    got = coded.collect()
    assert [list(r["ids"]) for r in got] == [library.encode_ordinary(t or "") for t in texts]
    for r, text in zip(got, texts):
        character = [k for k, c in enumerate(text or "") for _ in c.encode()]
        ends = np.cumsum([len(library.decode_single_token_bytes(i)) for i in r["ids"]], dtype=int)
        assert list(r["ends"]) == [character[e - 1] + 1 for e in ends]
        assert list(r["starts"]) == [character[s] for s in [0, *ends[:-1]][:len(ends)]]
    back = bytebpe.decode(coded, RANKS).collect()
    assert [r["text"] for r in back] == [t or "" for t in texts]
    packed = bytebpe.decode(bytebpe.encode(docs, RANKS, PATTERN, packed=True), RANKS).collect()
    assert packed == back
    split = library.encode_ordinary("👩‍👩‍👧")[:1]
    assert library.decode_single_token_bytes(split[0]).decode(errors="ignore") == ""
    odd = spark.createDataFrame([(1, None), (2, [None]), (3, [10 ** 6]), (4, split), (5, [])],
                                "doc_id long, ids array<int>")
    found = {r["doc_id"]: (r["bytes"], r["text"]) for r in bytebpe.decode(odd, RANKS).collect()}
    assert found[1] == found[2] == found[3] == (None, None) and found[5] == (b"", "")
    assert found[4] == (library.decode_single_token_bytes(split[0]), "\ufffd")
    assert bytebpe.encode(docs.limit(0), RANKS, PATTERN).count() == 0


def test_every_token_comes_from_its_last_merge():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"xyz": 259}
    assert bytebpe.last_merge(b"abc", ranks) == (b"ab", b"c")
    assert bytebpe.last_merge(b"xyz", ranks) is None
